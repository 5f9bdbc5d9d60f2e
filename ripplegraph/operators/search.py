"""BM25 over sections of prose."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, described, tokens

K1, B = 1.5, 0.75


def indexable(sections: DataFrame) -> DataFrame:
    """chunk_id, source, text of the sections that have a body; headings above a section count as its text."""
    return described(sections).where("not is_empty").select("chunk_id", "source", F.col("indexable").alias("text"))


def unwritten(sections: DataFrame) -> DataFrame:
    """Sections without a body, but for the title of a source that has written sections."""
    written = sections.where("body <> ''").select("source").distinct()
    titles = sections.where("body = '' and size(heading_path) <= 1").join(written, "source", "left_semi").select("chunk_id")
    return sections.where("body = ''").join(titles, "chunk_id", "left_anti").select("chunk_id", "source", "heading")


def load_corpus(spark: SparkSession, root: str, *folders: str) -> DataFrame:
    """(source, text) of the markdown files in folders below root; source is the path below root."""
    top = root.rstrip("/")
    read = spark.read.text([f"{top}/{f}/*.md" for f in folders] or f"{top}/*.md", wholetext=True)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    whole = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    path = F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), r"^(\w+):/+", "$1:/")
    prefix = whole.replace(":///", ":/").replace("://", ":/").rstrip("/") + "/"
    return read.select(F.substring(path, len(prefix) + 1, 4096).alias("source"), F.col("value").alias("text"))


def term_stats(texts: DataFrame) -> DataFrame:
    """(term, n_chunks, n_total) over chunk_id, text."""
    each = texts.select("chunk_id", F.explode(tokens("text")).alias("term")).groupBy("chunk_id", "term").count()
    return each.groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("count").alias("n_total"))


def exact_sum(x: Column) -> Column:
    """Sum of doubles from 0 to 2 ** 33, rounded once, so equal in any order of the rows: copies of a text tie.

    Sums of doubles differ in their last digits by that order, and rounding them tells some apart that are equal. So each is
    summed as two whole numbers, of 2 ** -30 and of 2 ** -62.
    """
    high = F.floor(x * 2.0**30)
    low = F.floor((x * 2.0**30 - high) * 2.0**32)
    return (F.sum(high).cast("double") + F.sum(low) / F.lit(2.0**32)) / F.lit(2.0**30)


@dataclass
class Index:
    """postings: term, chunk_id, tf, length; stats: one row with the number of chunks, n, and their average length."""

    postings: DataFrame
    stats: DataFrame

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """(query_id, rank, chunk_id, score): the k best for each query_id, query; fewer if fewer match.

        A term that a query repeats counts as often. Ties of whole scores go to the smaller chunk_id, as text; scores are
        rounded to 6 places for output only.
        """
        if k < 0:
            raise ValueError("k must not be negative")
        asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        postings = self.postings.join(asked.select("term").distinct(), "term", "left_semi")
        seen = postings.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        gain = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("average")))
        scores = postings.join(seen, "term").join(asked, "term").join(F.broadcast(self.stats))  # one row
        scores = scores.groupBy("query_id", "chunk_id").agg(exact_sum(gain).alias("score")).where("score > 0")
        # rounded, as logarithms differ in their last digits between machines, which must not decide
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id"))
        return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def index(texts: DataFrame, keep: bool = True) -> Index:
    """Of chunk_id, text; chunks without tokens count for the average. keep: for more than one search, the tables are cached."""
    lengths = texts.select("chunk_id", tokens("text").alias("terms")).withColumn("length", F.coalesce(F.size("terms"), F.lit(0)))
    average = F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0))
    stats = lengths.agg(F.count("*").alias("n"), average.alias("average"))
    postings = lengths.select("chunk_id", "length", F.explode("terms").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    if keep:
        postings, stats = postings.persist(StorageLevel.MEMORY_AND_DISK), stats.persist(StorageLevel.MEMORY_AND_DISK)
    return Index(postings, stats)


def search(texts: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """One search without an index kept: only the queries' terms are shuffled."""
    lengths = texts.select("chunk_id", tokens("text").alias("terms")).withColumn("length", F.coalesce(F.size("terms"), F.lit(0)))
    wanted = queries.select(F.explode(tokens("query")).alias("term")).distinct()
    found = lengths.select("chunk_id", "length", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    postings = found.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return Index(postings, index(texts, keep=False).stats).search(queries, k)


class Retriever(Protocol):
    """What answers a search: hits as source, heading, line_start, line_end, score, body by rank."""

    def search(self, query: str, k: int = 3) -> DataFrame: ...


class KeywordRetriever:
    """BM25 over the sections of prose (source, text), indexed once."""

    def __init__(self, prose: DataFrame):
        self.sections = chunks(prose).persist(StorageLevel.MEMORY_AND_DISK)
        self.index = index(indexable(self.sections))

    @classmethod
    def from_corpus(cls, spark: SparkSession, root: str, *folders: str) -> KeywordRetriever:
        return cls(load_corpus(spark, root, *folders))

    def search(self, query: str, k: int = 3) -> DataFrame:
        asked = self.sections.sparkSession.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))
        found = self.index.search(asked, k).join(described(self.sections), "chunk_id")
        return found.select("rank", "source", "heading", "breadcrumb", "citation", "line_start", "line_end", F.bround("score", 3).alias("score"), "body").orderBy("rank")

    def unwritten(self) -> DataFrame:
        return unwritten(self.sections)

    def __repr__(self) -> str:
        return f"KeywordRetriever({self.index.stats.first()['n']} sections indexed, {self.unwritten().count()} unwritten)"


def rendered(hits: DataFrame) -> DataFrame:
    """(rank, line) of a retriever's hits as text."""
    return hits.select("rank", F.format_string("%d. %s [%s] (score %s)\n%s", "rank", "breadcrumb", "citation", F.col("score").cast("string"), "body").alias("line"))
