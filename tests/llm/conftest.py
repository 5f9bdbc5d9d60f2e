import pyarrow as pa
import pyarrow.parquet as pq
import pytest


@pytest.fixture
def stored(spark, tmp_path):
    """stored(columns, schema): the rows as a parquet table, read by Spark."""
    made = iter(range(100))

    def make(columns: dict, schema: list[tuple]):
        path = str(tmp_path / f"{next(made)}.parquet")
        pq.write_table(pa.table(columns, schema=pa.schema(schema)), path)
        return spark.read.parquet(path)

    return make


DOCUMENTS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]


@pytest.fixture
def documents(stored):
    """documents(texts, langs): a table of documents, doc_id being the place in the list."""

    def make(texts: list, langs: list | None = None, ids: list | None = None):
        n = len(texts)
        size = [None if t is None else len(t) for t in texts]
        return stored({"doc_id": ids or list(range(n)), "text": texts, "lang": langs or [None] * n, "source": ["web"] * n, "n_chars": size}, DOCUMENTS)

    return make
