"""What the operators of this package share: scratch tables, components, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: set[str] = set()
_kept: dict = {}


def kept(name, make):
    """A worker process's one large object (a model, a tokenizer): another's takes its place."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def released() -> None:
    """For tasks that need memory and no such object, at their start and end: it goes, and what is free."""
    _kept.clear()
    trimmed()


def trimmed() -> None:
    """At a task's end: what is free goes back to the system, as this worker may rest beside others that work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names no such folder (tests in local mode) a temporary one is made and set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="ripplegraph-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/ripplegraph-{uuid.uuid4().hex}"
    _folders.add(path)
    return path


class Scratch:
    """Tables in the shared folder, each deleted as soon as no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, *done: DataFrame) -> DataFrame:
        """df, written and read again: lineage ends here and lost executors cost no recomputation. Then the tables `done` go."""
        path = shared_dir(self.spark)
        df.write.parquet(path)
        self.drop(*done)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = table, path
        return table

    def gather(self, parts: Iterable[DataFrame]) -> DataFrame:
        """All rows of parts of one schema, one at least, which are computed one after another."""
        path = shared_dir(self.spark)
        for df in parts:
            df.write.mode("append").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.tables.pop(id(table))
            delete(self.spark, path)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle is deleted as soon as they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    return Scratch(df.sparkSession).write(df)


def delete(spark: SparkSession, path: str) -> None:
    """A folder that this process made, on any file system."""
    if path in _folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _folders.discard(path)


def folders() -> set[str]:
    """Those made and not deleted so far; a result that isn't saved yet may read any of them."""
    return set(_folders)


def matching(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", most_rows: int = 200_000) -> DataFrame:
    """The rows whose `on` stand in keys (left_anti: don't). keys: a written table of whole numbers.

    Up to most_rows keys, some MB, are broadcast and no row moves; beyond that both sides are shuffled by the keys.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= most_rows else keys, on, how)


def bounded(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column holds about max_bytes at most; one row is never split."""
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        rows = batch.num_rows
        step = max(1, rows * max_bytes // max(size, 1)) if size > max_bytes else max(rows, 1)
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of undirected edges reaches. Nodes are whole numbers.

    Large-star and small-star rounds of Kiveris et al. (2014): every neighbourhood hooks on its smallest node until the
    edges are stars. A round is hash aggregates and equi-joins; no neighbourhood is gathered. A star's centre is hot only as
    `low` of the first join, whose result is dealt anew, so that AQE can split it. Every round is written to the shared
    folder, in place of the one before. The driver sees two numbers a round.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high <> low").distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        least = now.groupBy("high").agg(F.min("low").alias("m"))
        large = now.join(least.withColumnsRenamed({"high": "low", "m": "lower"}), "low", "left").select("high", F.coalesce("lower", "low").alias("low"))
        large = large.union(least).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = scratch.write(small.union(least).distinct(), now)
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(now.select(F.col("low").alias("node")).distinct().withColumn("component", F.col("node")))


def whole_groups(batches: Iterable[pa.RecordBatch], *keys: str, most_rows: int = 20_000) -> Iterator[pa.Table]:
    """Rows sorted by keys, as tables of about most_rows that hold groups of equal keys whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(n - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        apart = np.flatnonzero(~same)
        cut = int(apart[-1]) + 1 if len(apart) else 0
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_numbers(table: pa.Table, *keys: str) -> np.ndarray:
    """0, 1, ... for runs of rows with equal keys (whole numbers)."""
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


class Forest:
    """Disjoint sets of rows; label holds each row's smallest row after settle()."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label[a] != self.label[b]
        if not apart.any():
            return
        up = self.label
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        self.label = up


def block_pairs(rows: DataFrame, chunk_rows: int, salt: str) -> DataFrame:
    """rows (with their group's row count n), dealt into blocks of bounded size that hold every pair of a group once.

    A group of more than chunk_rows rows falls into n / chunk_rows chunks by a hash of `salt`; block (a, b) holds the
    chunks a and b, whose pairs it compares: within the chunk where a = b, else across. Adds chunk, a, b.
    """
    chunks = F.ceil(F.col("n") / chunk_rows).cast("int")
    chunk = F.when(F.col("n") > chunk_rows, F.pmod(F.xxhash64(F.col(salt), F.lit(7)), chunks).cast("int")).otherwise(0)
    dealt = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select(*rows.columns, "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).drop("other")
