"""Queries over the driver's tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, html_text, language, licenses, ngram_join, packing, prefix_forest, surrogates, token_files
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
#: For the given tables only, which hold invented persons; a real corpus needs a secret one.
TEST_KEY = "public key for invented data"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op4_token_files(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, TEST_KEY)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("text_hash")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_prefix_forest, op3_licenses, op4_token_files, op5_packing, op6_language, op7_bpe, op8_surrogates, op9_html_text, op10_ngram_join)}


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

COSINE = """WITH RECURSIVE dims AS (SELECT len(embedding) AS d FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 1),
    numbered AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    usable AS (SELECT * FROM numbered WHERE vec_id IS NOT NULL AND len(v) = (SELECT d FROM dims) AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
    near AS (SELECT a.r AS a, b.r AS b, a.vec_id AS va, b.vec_id AS vb FROM usable a JOIN usable b ON a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    reach(id, other) AS (SELECT va, vb FROM near UNION SELECT reach.id, near.vb FROM reach JOIN near ON near.va = reach.other),
    lowest AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY 1)
    SELECT vec_id, (SELECT count(*) FROM near WHERE near.a = n.r) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), true) AS kept FROM numbered n LEFT JOIN lowest ON id = vec_id"""

JACCARD = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
    grams AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
    coded AS (SELECT r, dense_rank() OVER (ORDER BY g) AS g FROM grams), sizes AS (SELECT r, count(*) AS n FROM coded GROUP BY 1),
    pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM coded a JOIN coded b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
    half AS (SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
    links AS (SELECT p.doc_id AS x, q.doc_id AS y, a, b FROM (SELECT a, b FROM half UNION ALL SELECT b, a FROM half) JOIN docs p ON p.r = a JOIN docs q ON q.r = b),
    reach(id, other) AS (SELECT x, y FROM links UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.other),
    lowest AS (SELECT id, least(id, min(other)) AS class_id FROM reach GROUP BY 1),
    counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
    SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(d.doc_id = coalesce(class_id, d.doc_id), true) AS kept
    FROM (SELECT r, doc_id FROM docs UNION ALL SELECT NULL, doc_id FROM documents WHERE doc_id IS NULL) d LEFT JOIN counted ON a = r LEFT JOIN lowest ON id = d.doc_id"""


def licence_sql() -> str:
    """Each template's words are matched by position; a place counts if enough of them stand there, and all of its key phrase."""
    rows = []
    for k, (label, words, key) in enumerate([(label, words, words) for label, words in licenses.BASE] + licenses.TEMPLATES):
        words, key = words.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        share = 1.0 if k < len(licenses.BASE) else 0.8
        rows += [f"({k}, '{label}', {i}, '{w}', {at <= i < at + len(key)}, {len(words)}, {len(key)}, {share})" for i, w in enumerate(words)]
    return f"""WITH templates(k, label, q, word, key, size, keys, share) AS (VALUES {', '.join(rows)}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
    words AS (SELECT r, p - 1 AS p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM docs) WHERE w[p] IN (SELECT word FROM templates)),
    total AS (SELECT count(*) AS n FROM docs), df AS (SELECT t.word, count(DISTINCT r) AS df FROM (SELECT DISTINCT word FROM templates) t LEFT JOIN words USING (word) GROUP BY 1),
    weights AS (SELECT word, ln(1 + (n - df + 0.5) / (df + 0.5)) + 1e-9 AS weight FROM df, total), whole AS (SELECT k, sum(weight) AS whole FROM templates JOIN weights USING (word) GROUP BY 1),
    places AS (SELECT r, k, any_value(label) AS label, p - q AS start, sum(weight) AS weight, any_value(size) AS size FROM words JOIN templates USING (word) JOIN weights USING (word) GROUP BY r, k, p - q
        HAVING count(*) >= any_value(share) * any_value(size) AND count(*) FILTER (key) = any_value(keys)),
    found AS (SELECT r, count(*) FILTER (k < {len(licenses.BASE)}) AS n_base, min(start) FILTER (k < {len(licenses.BASE)}) AS first_word, max(start) FILTER (k < {len(licenses.BASE)}) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (k < {len(licenses.BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(least(weight / whole, 1)) AS score FROM places JOIN whole USING (k) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score FROM docs LEFT JOIN found USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others have tests against brute force in tests/llm."""
    return {"op1_embedding_dedup": COSINE, "op3_licenses": licence_sql(), "op10_ngram_join": JACCARD}
