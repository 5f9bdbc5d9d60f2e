"""Nearest neighbours by inner product with a forest of hash prefixes (Bawa, Condie and Ganesan, 2005).

Vectors are lifted by one component so that all have the largest norm (then the nearest by angle has the largest inner
product). A tree hashes them to strings of `bits` bits: on which side of a plane's median they lie. The planes of all trees are at
right angles, as far as the dimension allows, so that trees complement each other; medians come from a bounded sample. Equal
vectors share one entry, which holds their smallest ids, as many as can be results. A tree is dealt into buckets of its
first bits, a bucket into chunks of bounded size, each a sorted array of hashes whose equal strings form a cell.

1. Descending: a query's own string is its longest prefix match; a cell that differs from it in some bits costs the sum of
   the squared distances of the query to those bits' planes.
2. Ascending, in all trees at once: cells are taken in the order of their costs until they hold as many entries as wanted:
   share times the number of entries, counted over all trees, and some times what k results need. The number of entries of every cell,
   trees * 2 ** bits numbers, is known to all tasks, so a query knows the cost at which it stops, and goes only to the chunks
   that hold a cell of at most that cost.
3. The inner products of these cells' entries are computed in their chunks; each chunk returns a query's best, and the best of
   all are ranked.

The rule is the same for tables of any size. share is of all entries because vectors without structure need it: on
independent directions in 64 dimensions no hash separates the nearest from the rest. Lower it, with more bits, where vectors
cluster. Measured recall stands in the README.

Null ids and vectors that are null, zero, of another length than the commonest, or hold null or non-finite components take
no part. Ties go to the smaller id. Repeated rows are results of their own, and a query never finds rows of its own id. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, group_numbers, released, whole_groups
from .vectors import dimension, keyed, matrix

FOUND = "query_id long, k1 long, k2 long, score double, ids array<long>"


class Planes:
    """Each tree's planes, and the hash strings of lifted rows."""

    def __init__(self, dim: int, trees: int, bits: int, scale: float, sample: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)
        turns = [np.linalg.qr(draw.standard_normal((dim + 1, dim + 1)))[0] for _ in range(ceil(trees * bits / (dim + 1)))]
        self.trees, self.bits, self.scale = trees, bits, scale
        self.normals = np.concatenate(turns, 1)[:, : trees * bits]
        self.medians = np.median(self.lifted(sample) @ self.normals, 0) if len(sample) else np.zeros(trees * bits)
        self.weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        self.strings = (np.arange(1 << bits)[:, None] & self.weights > 0).astype(np.float64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]

    def hashes(self, x: np.ndarray) -> np.ndarray:
        """[row, tree]"""
        bits = (self.lifted(x) @ self.normals > self.medians).reshape(len(x), self.trees, self.bits)
        return bits.astype(np.int64) @ self.weights

    def sides(self, q: np.ndarray) -> np.ndarray:
        """[query, tree, bit]: signed distances of queries, which are scaled to the same norm and not lifted."""
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        return (q @ self.normals[:-1] - self.medians).reshape(len(q), self.trees, self.bits)

    def costs(self, sides: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """[query, string] of one tree: sums of squared distances to the planes of bits that differ."""
        square = sides * sides
        own = (sides > 0).astype(np.float64)
        bits = self.strings[strings]
        return (square * own).sum(1)[:, None] + (square * (1 - 2 * own)) @ bits.T


def hashed(entries: DataFrame, planes: Planes, dim: int) -> DataFrame:
    """entries with an array of hashes, one for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = planes.hashes(matrix(batch.column("vector"), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], [*batch.schema.names, "hashes"])

    return entries.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in entries.dtypes) + ", hashes array<long>")


def aimed(queries: DataFrame, planes: Planes, dim: int, sizes: np.ndarray, wanted: int, depth: int) -> DataFrame:
    """(query_id, vector, stop, tree, bucket): where each query goes, and the cost up to which it takes cells. sizes: [tree, string]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        full = [np.flatnonzero(s) for s in sizes]
        tree = np.repeat(np.arange(planes.trees), [len(f) for f in full])
        held = np.concatenate([s[f] for s, f in zip(sizes, full, strict=True)])
        bucket = np.concatenate(full) >> (planes.bits - depth)
        block = tree << depth | bucket
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sides = planes.sides(matrix(batch.column("vector"), dim))
                cost = np.concatenate([planes.costs(sides[:, t], f) for t, f in enumerate(full)], 1)
                rows, stops, blocks = [], [], []
                for i, c in enumerate(cost):
                    order = np.argsort(c, kind="stable")
                    last = min(int(np.searchsorted(np.cumsum(held[order]), wanted)), len(order) - 1)
                    stop = c[order[last]] + 1e-12
                    to = np.unique(block[c <= stop])
                    rows.append(np.full(len(to), i))
                    stops.append(np.full(len(to), stop))
                    blocks.append(to)
                if rows:
                    rows, to = pa.array(np.concatenate(rows)), np.concatenate(blocks)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id").take(rows), batch.column("vector").take(rows), pa.array(np.concatenate(stops)), pa.array(to >> depth, pa.int32()), pa.array(to & (1 << depth) - 1, pa.int64())],
                        ["query_id", "vector", "stop", "tree", "bucket"],
                    )

    kind = dict(queries.dtypes)["vector"]
    return queries.select("query_id", "vector").mapInArrow(run, f"query_id long, vector {kind}, stop double, tree int, bucket long")


def block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Each block's (entries, queries), entries in the order of their hashes."""
    for table in whole_groups(batches, "block", "part", most_rows=4000):
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group_numbers(table, "block", "part")))])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            block = table.slice(lo, hi - lo)
            is_query = block.column("query_id").is_valid()
            yield block.filter(pa.compute.invert(is_query)), block.filter(is_query)


def best(x: np.ndarray, first: np.ndarray, q: np.ndarray, cells: np.ndarray, taken: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of each query's best entries, `most` at most, in the cells it takes. cells: bounds of each cell's entries."""
    size = np.diff(cells)
    room = int((taken * size).sum(1).max(initial=0))
    scores = np.full((len(q), max(room, 1)), -np.inf)
    which = np.zeros(scores.shape, np.int32)
    filled = np.zeros(len(q), np.int64)
    for c in np.flatnonzero(taken.any(0)).tolist():
        rows, lo, hi = np.flatnonzero(taken[:, c]), cells[c], cells[c + 1]
        to = filled[rows][:, None] + np.arange(hi - lo)
        scores[rows[:, None], to] = q[rows] @ x[lo:hi].T
        which[rows[:, None], to] = np.arange(lo, hi)
        filled[rows] += hi - lo
    least = np.partition(scores, -most, axis=1)[:, -most] if room > most else np.full(len(q), -np.inf)
    error = 1e-12 * (np.abs(q).max(1) + 1e-300) * max(np.abs(x).max(), 1e-300) * x.shape[1]
    i, at = np.nonzero((scores >= (least - error)[:, None]) & (scores > -np.inf))
    j = which[i, at]
    exact = np.concatenate([np.empty(0), *((q[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536))])
    order = np.lexsort((first[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[keep], j[keep], exact[keep]


def scored(dealt: DataFrame, planes: Planes, dim: int, most: int) -> DataFrame:
    """FOUND: each block's best entries for each of its queries, `most` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, queries in block_tables(batches):
            if not entries.num_rows or not queries.num_rows:
                continue
            x, q, stop = matrix(entries.column("vector"), dim), matrix(queries.column("vector"), dim), queries.column("stop").to_numpy()
            tree, hashes = entries.column("tree")[0].as_py(), entries.column("hash").to_numpy()
            strings, start = np.unique(hashes, return_index=True)
            cells = np.concatenate([start, [len(hashes)]])
            sides, ids, names = planes.sides(q)[:, tree], entries.column("ids").combine_chunks(), queries.column("query_id").combine_chunks()
            first = pa.compute.list_element(ids, 0).to_numpy()
            keys = [entries.column(k).combine_chunks() for k in ("k1", "k2")]
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                taken = planes.costs(sides[part], strings) <= stop[part, None]
                i, j, score = best(x, first, q[part], cells, taken, most)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i + at)), *(k.take(pa.array(j)) for k in keys), pa.array(score), ids.take(pa.array(j))], ["query_id", "k1", "k2", "score", "ids"])
        released()

    return dealt.mapInArrow(run, FOUND)


def search(vectors: DataFrame, is_query: str, k: int = 20, trees: int = 5, bits: int = 12, share: float = 0.5, spare: int = 4, chunk_rows: int = 16384, sample_rows: int = 8192, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds (SQL over the id).

    share is summed over the trees: of 0.5 with 5 trees, each takes a tenth of the entries. Besides, spare times as many entries
    are taken as k results need at least, since a table of which k is a large part has no few near ones. sample_rows bounds the rows that
    medians are taken from (twice as many at most).
    """
    dim, key, scratch = dimension(vectors, vector_column), ["k1", "k2"], Scratch(vectors.sparkSession)
    rows = scratch.write(keyed(vectors, id_column, vector_column, dim).where("k1 is not null"))
    # a key's k + 1 smallest ids can be results; Spark drops the rest before the shuffle
    ranked = rows.select(*key, "id", F.row_number().over(Window.partitionBy(*key).orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
    ids = ranked.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = scratch.write(rows.groupBy(*key).agg(F.first("vector").alias("vector")).join(ids, key).select("vector", *key, "ids"))
    n, scale = entries.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(vector, double(0), (a, x) -> a + double(x) * double(x)))"))).first()
    if not n:
        return rows.selectExpr("id as query_id", "1 as rank", "id as vec_id", "double(0) as score")
    sample = entries.where(F.pmod("k1", F.lit(max(1, n // sample_rows))) == 0).orderBy(*key).limit(2 * sample_rows).select("vector").toArrow()
    planes = Planes(dim, trees, bits, scale, matrix(sample.column(0), dim), seed)
    depth = min(bits, max(0, ceil(log2(n / chunk_rows))))
    index = scratch.write(hashed(entries, planes, dim), entries)
    index = index.select("vector", *key, "ids", F.posexplode("hashes").alias("tree", "hash")).withColumn("bucket", F.shiftright("hash", bits - depth))
    # trees * 2 ** bits rows at most
    counts = index.groupBy("tree", "hash").agg(F.count("*").alias("n")).toArrow()
    sizes = np.zeros((trees, 1 << bits), np.int64)
    sizes[counts.column("tree").to_numpy(), counts.column("hash").to_numpy()] = counts.column("n").to_numpy()
    # trees * (k + 1) entries, counted over the trees, are k + 1 different ones at least, if there are as many
    wanted = ceil(share * n) + spare * trees * (k + 1) + 1
    parts = np.ceil(sizes.reshape(trees, 1 << depth, -1).sum(2) / chunk_rows).astype(np.int32)
    blocks = pa.table({"tree": pa.array(np.repeat(np.arange(trees), 1 << depth), pa.int32()), "bucket": pa.array(np.tile(np.arange(1 << depth), trees), pa.int64()), "parts": pa.array(parts.ravel())})
    blocks = vectors.sparkSession.createDataFrame(blocks).where("parts > 0").withColumn("block", F.expr(f"shiftleft(tree, {depth}) + bucket"))
    narrow = ["block", "part", "hash"]
    stored = index.join(blocks, ["tree", "bucket"]).withColumn("part", F.pmod(F.xxhash64(*key), "parts").cast("int")).select(*narrow, "tree", "vector", *key, "ids")
    asked = rows.where(is_query).select("vector", F.col("id").alias("query_id"), *key).dropDuplicates(["query_id", *key])
    goes = aimed(asked, planes, dim, sizes, wanted, depth).join(blocks, ["tree", "bucket"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    both = stored.unionByName(goes.select("block", "part", F.lit(-1).cast("long").alias("hash"), "tree", "vector", "query_id", "stop"), allowMissingColumns=True)
    found = scored(both.repartition("block", "part").sortWithinPartitions("block", "part", "hash"), planes, dim, k + 1)
    found = scratch.write(found.dropDuplicates(["query_id", *key]))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    each = few.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
