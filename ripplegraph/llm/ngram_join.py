r"""Jaccard self-join of documents on word n-grams, with Bayesian pruning of candidates (Satuluri and Parthasarathy, 2012).

1. A document becomes its set of word n-grams (hashed to 64 bits), a content key (128 bits of the set) and a MinHash signature.
   Documents of one key are copies: one of them, the smallest doc_id, stands for all.
2. Representatives that share a band (four neighbouring values of the signature) are candidates. Their signatures are
   compared a part at a time; a pair goes as soon as the posterior probability of similarity >= threshold (uniform prior)
   falls below tolerance.
3. What survives joins representatives into clusters; within these every pair is pruned likewise and the rest verified
   exactly on their n-gram sets.

No list of pairs leaves a task: a block of a bucket gives a spanning forest of its survivors, a block of a cluster gives
each row's number of links and a spanning forest. Buckets and clusters of any size are dealt into blocks of bounded size.
Texts move only for representatives in clusters, and not at all where those are few enough to broadcast their ids.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text. A text of fewer words than n, but one at least, has
one n-gram of all its words. Null texts and texts without a word link with nothing and are their own class. Rows with a
null doc_id take no part: their class is null. Repeated rows are copies of each other; rows of one doc_id with different
texts are judged each for itself, but what links to either is of one class. An empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, block_pairs, bounded, components, group_numbers, matching, released, whole_groups

HASHES, ROWS = 64, 4
STEP = 16
SLICE = 1 << 20
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_random = np.random.default_rng(20_240_601)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
A = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    edges = np.flatnonzero(np.diff(IS_WORD[raw], prepend=False))
    start, length = edges[::2], edges[1::2] - edges[::2]
    count = np.bincount(np.searchsorted(np.cumsum(size), start, side="right"), minlength=len(texts))
    if not len(start):
        return [np.empty(0, np.uint64)] * len(texts)
    inside = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    local = inside - np.repeat(start, length)
    word = mixed(np.add.reduceat(BYTE[raw[inside]] * POWER[local % len(POWER)] + (local // len(POWER)).astype(np.uint64), np.cumsum(length) - length))
    first = np.cumsum(count) - count
    gram = np.zeros(len(word), np.uint64)
    for j in range(n):
        gram[: len(word) - j] += word[j:] * POWER[j]
    gram = mixed(gram)
    found = []
    for at, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= n:
            found.append(np.unique(gram[at : at + c - n + 1]))
        elif c:
            found.append(mixed((word[at : at + c] * POWER[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            found.append(gram[:0])
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, hash]: MinHash values of 32 bits of non-empty sets."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if sets:
        flat, start = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
        for i in range(HASHES):
            out[:, i] = np.minimum.reduceat(((flat * A[i] + B[i]) >> np.uint64(32)).astype(np.uint32), start)
    return out


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: fewer matches than this make the posterior fall below tolerance.

    With a uniform prior the posterior of m matches in n is Beta(m + 1, n - m + 1), whose tail above t is the chance of at
    most m successes in n + 1 trials of chance t.
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        found.append(m)
    return tuple(found)


def surviving(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which rows of the signatures a and b, compared a part at a time, stay candidates."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (a[left, part] == b[left, part]).sum(1, dtype=np.int32)
        keep = matches >= m
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


def values(signature: pa.ChunkedArray) -> np.ndarray:
    """[row, hash]: MinHash values of 16 bits; a signature is stored as one number for each band."""
    flat = [c.flatten().to_numpy() for c in (signature.chunks if isinstance(signature, pa.ChunkedArray) else [signature])]
    return np.concatenate(flat).view("<u2").reshape(-1, HASHES)


def sketched(docs: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, k1 and k2 (the content key), size, signature of every row; the last four null without an n-gram or id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in bounded(batches, "text", SLICE):
            sets = shingles([(t or "").lower().encode("utf-8", "replace") for t in batch.column(2).to_pylist()], n)
            none = np.fromiter((not len(s) for s in sets), bool, len(sets))
            sets = [s for s in sets if len(s)]
            keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            sign = signatures(sets).astype("<u2").view("<i8")
            every = np.cumsum(~none) - 1
            filled = lambda x: pa.array(x[every] if len(sets) else np.zeros(len(none), np.int64), mask=none)
            bounds = np.concatenate([[0], np.cumsum(~none)]) * (HASHES // ROWS)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sign.ravel()))
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), filled(keys[:, 0]), filled(keys[:, 1]), filled(size), lists], ["doc_id", "text_hash", "k1", "k2", "size", "signature"])
        released()

    doc_id = F.col(id_column).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.when(doc_id.isNotNull(), F.col(text_column)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, size long, signature array<long>")


def clusters(reps: DataFrame, least: tuple[int, ...], chunk_rows: int) -> DataFrame:
    """(node, component) of representatives that candidates surviving on their whole signatures join."""
    banded = reps.select("doc_id", "k1", "k2", F.posexplode("signature").alias("place", "band"))
    shared = banded.groupBy("place", "band").agg(F.count("*").alias("n")).where("n > 1")
    members = banded.join(shared, ["place", "band"]).join(reps.select("doc_id", "k1", "k2", "signature"), ["doc_id", "k1", "k2"])
    blocks = block_pairs(members, chunk_rows, "k1").repartition("place", "band", "a", "b").sortWithinPartitions("place", "band", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "place", "band", "a", "b"):
            group = group_numbers(table, "place", "band", "a", "b")
            across = table.column("a").to_numpy() != table.column("b").to_numpy()
            chunk, node, sign = table.column("chunk").to_numpy(), table.column("doc_id").to_numpy(), values(table.column("signature"))
            forest, rows = Forest(len(group)), np.arange(len(group))
            for d in range(1, int(np.bincount(group).max())):
                rows = rows[: np.searchsorted(rows, len(group) - d)]
                rows = rows[group[rows] == group[rows + d]]
                i = rows[~across[rows] | (chunk[rows] != chunk[rows + d])]
                i = i[forest.label[i] != forest.label[i + d]]
                for at in range(0, len(i), 1 << 16):
                    some = i[at : at + (1 << 16)]
                    some = some[surviving(sign[some], sign[some + d], least)]
                    forest.link(some, some + d)
            moved = np.flatnonzero(forest.label != np.arange(len(group)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[forest.label[moved]])], ["a", "b"])
        released()

    edges = blocks.select("place", "band", "a", "b", "chunk", "doc_id", "signature").mapInArrow(run, "a long, b long")
    return components(edges)


def verified(members: DataFrame, docs: DataFrame, n: int, threshold: float, least: tuple[int, ...], chunk_rows: int, chunk_grams: int, id_column: str, text_column: str) -> DataFrame:
    """(k1, k2, node, links, root): what each block finds for each of its rows.

    members, a written table: doc_id, text_hash, k1, k2, copies, signature, cluster, n (rows of the cluster, or as many as its n-grams count for).
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    texts = matching(texts, members.select("doc_id", "text_hash"), ["doc_id", "text_hash"])
    rows = members.join(texts, ["doc_id", "text_hash"]).select("cluster", "doc_id", "k1", "k2", "copies", "signature", "n", "text")
    rows = rows.dropDuplicates(["k1", "k2"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", SLICE):
            sets = shingles([t.lower().encode("utf-8", "replace") for t in batch.column(7).to_pylist()], n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array([s.tobytes() for s in sets], pa.binary())], [*batch.schema.names[:7], "grams"])

    hashed = rows.mapInArrow(grams, "cluster long, doc_id long, k1 long, k2 long, copies long, signature array<long>, n long, grams binary")
    blocks = block_pairs(hashed, chunk_rows, "k1").repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cluster", "a", "b", most_rows=1000):
            group = group_numbers(table, "cluster", "a", "b")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(group))])
            links, root = np.zeros(len(group), np.int64), np.arange(len(group))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                links[lo:hi], root[lo:hi] = block_links(table.slice(lo, hi - lo), threshold, least)
                root[lo:hi] += lo
            node, some = table.column("doc_id").to_numpy(), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([*(pa.array(table.column(k).to_numpy()[some]) for k in ("k1", "k2")), pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["k1", "k2", "node", "links", "root"])
        released()

    return blocks.select("cluster", "a", "b", "chunk", "doc_id", "k1", "k2", "copies", "signature", "grams").mapInArrow(run, "k1 long, k2 long, node long, links long, root long")


def block_links(table: pa.Table, threshold: float, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's links in one block, counted with copies, and its first row in the block's spanning forest."""
    m = table.num_rows
    across = table.column("a")[0] != table.column("b")[0]
    chunk, copies = table.column("chunk").to_numpy(), table.column("copies").to_numpy()
    sign = values(table.column("signature"))
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    size = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), size)
    _, number, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df[number] > 1
    number, owner = number[common], owner[common]
    order = np.argsort(number, kind="stable")
    posting = owner[order]
    end = np.cumsum(np.bincount(number, minlength=len(df)))
    mine = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
    links, forest = np.zeros(m, np.int64), Forest(m)
    for i in range(m - 1):
        later = np.arange(i + 1, m)
        if across:
            later = later[chunk[later] != chunk[i]]
        if len(later):
            later = later[surviving(np.broadcast_to(sign[i], (len(later), HASHES)), sign[later], least)]
        if not len(later):
            continue
        own = number[mine[i] : mine[i + 1]]
        if len(later) <= 4:
            inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in later])
        else:
            n = df[own]
            at = np.repeat(end[own] - np.cumsum(n), n) + np.arange(n.sum())
            inter = np.bincount(posting[at], minlength=m)[later]
        linked = later[inter >= threshold * (size[i] + size[later] - inter) - 1e-9]
        links[i] += copies[linked].sum()
        links[linked] += copies[i]
        forest.link(np.full(len(linked), i), linked)
    return links, forest.label


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, chunk_rows: int = 4096, chunk_grams: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id that links reach), n_links, kept (doc_id = class_id) of every row.

    n_links counts the other rows with similarity >= threshold, copies included.
    """
    least, key, scratch = least_matches(threshold, tolerance), ["k1", "k2"], Scratch(docs.sparkSession)
    sketches = scratch.write(sketched(docs, n, id_column, text_column))
    # rows of one key agree in size and signature
    reps = sketches.where("k1 is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    reps = scratch.write(reps.select(*key, "first.*", "copies", "size", "signature"))
    clustered = scratch.write(clusters(reps, least, chunk_rows))
    members = scratch.write(clustered.withColumnsRenamed({"node": "doc_id", "component": "cluster"}).join(reps, "doc_id"), clustered)
    size = members.groupBy("cluster").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") * (chunk_rows // 4) / chunk_grams)).alias("n"))
    members = scratch.write(members.drop("size").join(size, "cluster"), members)
    found = scratch.write(verified(members, docs, n, threshold, least, chunk_rows // 4, chunk_grams, id_column, text_column), members)
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy(*key, "node").agg(F.sum("links").alias("links")).join(groups, "node", "left")
    linked = scratch.write(linked.select(*key, "links", F.coalesce("component", "node").alias("class_id")), found)
    known = reps.select(*key, "copies", "doc_id").join(linked, key, "left").select(*key, F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = scratch.write(known.where("n_links > 0"), linked, reps)
    rows = sketches.select("doc_id", "text_hash", *key).join(known, key, "left")
    rows = rows.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of docs, columns as they are, without all but one of each class; a class keeps its smallest doc_id.

    Rows move only where those that go, or those repeated, are too many to broadcast their ids.
    """
    found, scratch = join(docs, id_column=id_column, text_column=text_column, **options), Scratch(docs.sparkSession)
    noted = found.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("rows"))
    on = ["__doc_id", "__text_hash"]
    noted = scratch.write(noted.where("not kept or rows > 1").select(F.col("doc_id").alias(on[0]), F.col("text_hash").alias(on[1]), "kept"))
    keyed = docs.withColumns({on[0]: F.col(id_column).cast("long"), on[1]: F.xxhash64(text_column)})
    left = matching(keyed, noted.select(*on), on, "left_anti")
    again = noted.where("kept").select(*on)
    if not again.isEmpty():
        left = left.unionByName(matching(keyed, again, on).dropDuplicates(on))
    return left.select(*docs.columns)
