"""Corpus pipeline: documents of a known language, one of each group of near copies, personal data replaced, packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written to the shared folder and read again, so a lost executor costs one stage at most; what a stage
wrote besides is deleted then.

Null, empty and letterless texts go in the first stage. Rows with a null doc_id stay, each for itself. Rows repeated with
their doc_id count once. Columns other than doc_id, text, lang and n_chars pass unchanged up to the last stage, which
reads doc_id and text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import language, ngram_join, packing, surrogates
from ripplegraph.llm.common import delete, folders, written
from ripplegraph.llm.queries import TEST_KEY, tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents without text or letters, or mostly of letters that no taught language has. The rest get the language found as lang."""
    return language.accepted(docs, language.learn(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stays: of each group of near copies (five words, similarity 0.8), the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; the setting spark.ripplegraph.surrogates.key holds the key."""
    key = spark.conf.get("spark.ripplegraph.surrogates.key", TEST_KEY)
    return surrogates.replaced(docs, key).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", ngram_jaccard_join), ("pii", pii), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = folders()
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            made = folders()
            docs = written(docs)
            for path in made - before:
                delete(spark, path)
    return docs
