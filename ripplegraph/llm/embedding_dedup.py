"""Near-duplicate vectors by cosine, with an inverted multi-index (Babenko and Lempitsky, 2012).

1. Equal vectors are copies: one, the smallest id, stands for all.
2. Each half of the unit vectors has a codebook of its own, fitted by k-means on a bounded sample; pairs of codewords form a
   grid of cells, and every representative lies in one cell.
3. A row visits every cell whose distance bound, summed over the halves, is at most r2, the squared distance of vectors at
   the threshold. The bound of a codeword is the distance to its Voronoi border, so no link is missed, whatever the
   vectors' distribution. Cells are visited in the order of their bound, codeword by codeword of one half, until none is
   near enough. Vectors that point anywhere alike are near most borders: there nearly all pairs are compared.
   recall < 1 is a cut for such vectors only: a neighbour at squared distance r2 in d dimensions crosses a border at
   distance t with a chance of at most exp(-t * t * d / (2 * r2)) where differences point anywhere alike, so cells up to
   t * t = r2 / d * 2 * ln(1 / (1 - recall)) are visited. Where components differ in scale it misses more than 1 - recall.
4. Rows in a cell are compared with each other and with its visitors, in double precision. Of two cells the lower-numbered
   one's rows visit, so a pair is compared once. Cells of any size are dealt into blocks of bounded size, and a block
   returns each row's number of links and a spanning forest, no pairs.
5. Ranges of cells are dealt and compared one after another, each with about as many rows as there are distinct vectors, and
   what it shuffled is deleted. So disk grows with the table and not with its visits. A range has one cell at least.

Null ids and vectors that are null, zero, of another length than the commonest (the cosine of two lengths is undefined), or
hold null or non-finite components link with nothing; a null id's component is null. Repeated rows are copies of each other;
rows of one id with different vectors are compared each for itself, but what links to either is of one component. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Scratch, components, group_numbers, released, shuffles_deleted, whole_groups
from .vectors import dimension, keyed, matrix, unit

def codebook(half: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spaced rows; a codeword left without rows stays."""
    words = half[np.linspace(0, len(half) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = distances(half, words).argmin(1)
        n = np.bincount(nearest, minlength=k)
        for j in np.flatnonzero(n):
            words[j] = half[nearest == j].mean(0)
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)


def borders(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codeword, and its squared distance to the border of every other codeword's region."""
    d = distances(x, words)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(distances(words, words), 0))[own]
    gap = np.maximum(d - d.min(1, keepdims=True), 0)
    return own, np.where(apart > 1e-9, gap / (2 * np.maximum(apart, 1e-9)), 0) ** 2


def visited(left: np.ndarray, right: np.ndarray, reach: float) -> np.ndarray:
    """Cells (numbers of the product grid) of one row whose bounds in both halves sum to at most reach, by both halves' sorted bounds."""
    first, second = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    n = np.searchsorted(right[second], reach - left[first], side="right")
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) * len(right) + second[at]


Books = tuple[np.ndarray, np.ndarray]


def placed(reps: DataFrame, books: Books, dim: int) -> DataFrame:
    """reps with their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = unit(matrix(batch.column("vector"), dim))
                a, b = (distances(half, words).argmin(1) for half, words in zip((x[:, : dim // 2], x[:, dim // 2 :]), books, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a * len(books[1]) + b, pa.int32())], [*batch.schema.names, "cell"])

    kind = dict(reps.dtypes)["vector"]
    return reps.select("k1", "k2", "node", "copies", "vector").mapInArrow(run, f"k1 long, k2 long, node long, copies long, vector {kind}, cell int")


def visits(batch: pa.RecordBatch, books: Books, dim: int, reach: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the cells from lo to hi, those that rows visit, higher-numbered than their own: row and cell of each visit."""
    k, cell = len(books[1]), batch.column("cell").to_numpy()
    some = np.flatnonzero(cell < hi - 1)
    if not len(some):
        return some, some
    x = unit(matrix(batch.column("vector").take(pa.array(some)), dim))
    first, last = lo // k, (hi - 1) // k + 1
    left, right = borders(x[:, : dim // 2], books[0])[1][:, first:last], borders(x[:, dim // 2 :], books[1])[1]
    found = [first * k + visited(p, q, reach) for p, q in zip(left, right, strict=True)]
    row, found = np.repeat(some, [len(v) for v in found]), np.concatenate(found)
    fine = (found > cell[row]) & (found >= lo) & (found < hi)
    return row[fine], found[fine]


def loads(cells: DataFrame, books: Books, dim: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's number of rows and of visitors."""
    size = len(books[0]) * len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                n[0] += np.bincount(batch.column("cell").to_numpy(), minlength=size)
                n[1] += np.bincount(visits(batch, books, dim, reach, 0, size)[1], minlength=size)
        some = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0][some]), pa.array(n[1][some])], ["cell", "n", "m"])

    found = cells.select("cell", "vector").mapInArrow(run, "cell int, n long, m long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    n = np.zeros((2, size), np.int64)
    n[:, found.column("cell").to_numpy()] = found.column("n").to_numpy(), found.column("m").to_numpy()
    return n[0], n[1]


def waves(n: np.ndarray, m: np.ndarray, chunk_rows: int, most_rows: int) -> list[tuple[int, int]]:
    """Ranges of cells whose blocks hold about most_rows rows each, one cell at least; cells without rows of their own count nothing."""
    mine, theirs = -(-n // chunk_rows), -(-m // chunk_rows)
    dealt = np.where(n + m <= chunk_rows, n + m, n * (mine + theirs) + m * mine) * (n > 0)
    number = np.cumsum(dealt) // most_rows
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(n)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def blocks(cells: DataFrame, books: Books, dim: int, reach: float, n: np.ndarray, m: np.ndarray, chunk_rows: int, lo: int, hi: int) -> DataFrame:
    """Rows and visitors of the cells from lo to hi, dealt into blocks (cell, a, b) of at most about two chunks; visitors' chunks follow the rows'."""
    n, m = n[lo:hi], m[lo:hi]
    small, mine, theirs = n + m <= chunk_rows, -(-n // chunk_rows), -(-m // chunk_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cell = batch.column("cell").to_numpy()
                inside = np.flatnonzero((cell >= lo) & (cell < hi))
                guest, place = visits(batch, books, dim, reach, lo, hi)
                row, place = np.concatenate([inside, guest]), np.concatenate([cell[inside], place]) - lo
                own = np.arange(len(row)) < len(inside)
                row, place, own = row[n[place] > 0], place[n[place] > 0], own[n[place] > 0]
                key = (batch.column("k2").to_numpy()[row].view(np.uint64) >> np.uint64(8)).astype(np.int64)
                chunk = np.where(small[place], 0, np.where(own, key % np.maximum(mine[place], 1), mine[place] + key % np.maximum(theirs[place], 1)))
                times = np.where(small[place], 1, np.where(own, mine[place] + theirs[place], mine[place]))
                ends = np.cumsum(times)
                for begin in range(0, int(times.sum()), 8192):
                    nth = np.arange(begin, min(begin + 8192, int(ends[-1])))
                    i = np.searchsorted(ends, nth, side="right")
                    other = nth - (ends - times)[i]
                    kept = batch.select(["k1", "k2", "node", "copies", "vector"]).take(pa.array(row[i]))
                    dealt = {"cell": place[i] + lo, "a": np.minimum(chunk[i], other), "b": np.maximum(chunk[i], other), "chunk": chunk[i]}
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in dealt.values()), pa.array(own[i]), *kept.columns], [*dealt, "own", *kept.schema.names])

    kind = dict(cells.dtypes)["vector"]
    return cells.mapInArrow(run, f"cell int, a int, b int, chunk int, own boolean, k1 long, k2 long, node long, copies long, vector {kind}")


def block_links(table: pa.Table, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's links in one block, counted with copies, and its first row in the block's spanning forest."""
    x, n = unit(matrix(table.column("vector"), dim)), table.num_rows
    copies, chunk = table.column("copies").to_numpy(), table.column("chunk").to_numpy()
    own = table.column("own").to_numpy(zero_copy_only=False)
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    left = np.flatnonzero(own if a == b else chunk == a)
    right = np.arange(n) if a == b else np.flatnonzero(chunk == b)
    links, forest = np.zeros(n, np.int64), Forest(n)
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        near = x[some] @ x[right].T >= threshold
        if a == b:
            near &= (right > some[:, None]) | ~own[right]
        links[some] += near @ copies[right]
        links[right] += copies[some] @ near
        for i in np.flatnonzero(near.any(1)):
            linked = right[near[i]]
            forest.link(np.full(len(linked), some[i]), linked)
    return links, forest.label


def compared(dealt: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(k1, k2, node, links, root) of the rows with links, once for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell", "a", "b", most_rows=2000):
            bounds = np.concatenate([[0], np.cumsum(np.bincount(group_numbers(table, "cell", "a", "b")))])
            links, root = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                links[lo:hi], root[lo:hi] = block_links(table.slice(lo, hi - lo), dim, threshold)
                root[lo:hi] += lo
            some, node = np.flatnonzero(links), table.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([*(pa.array(table.column(k).to_numpy()[some]) for k in ("k1", "k2")), pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["k1", "k2", "node", "links", "root"])
        released()

    whole = dealt.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return whole.mapInArrow(run, "k1 long, k2 long, node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 1.0, rows_per_cell: int = 1024, sample_rows: int = 8192, chunk_rows: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", wave_rows: int = 1_000_000) -> DataFrame:
    """id, n_links (other rows with cosine >= threshold, copies included), component_id (smallest id that links reach), kept.

    sample_rows bounds the rows that the codebooks are fitted on (twice as many at most), and an eighth of it the codewords.
    wave_rows, or the number of distinct vectors if larger, bounds the rows that are dealt into blocks at once.
    """
    with shuffles_deleted(vectors.sparkSession):
        return deduplicated(vectors, threshold, recall, rows_per_cell, sample_rows, chunk_rows, id_column, vector_column, wave_rows)


def deduplicated(vectors: DataFrame, threshold: float, recall: float, rows_per_cell: int, sample_rows: int, chunk_rows: int, id_column: str, vector_column: str, wave_rows: int) -> DataFrame:
    dim, key, scratch = dimension(vectors, vector_column), ["k1", "k2"], Scratch(vectors.sparkSession)
    each = keyed(vectors, id_column, vector_column, dim)
    rows = scratch.write(each.select("id", *key))
    reps = each.where("k1 is not null").groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = scratch.write(reps)
    n = reps.count()
    if n:
        share = max(1, n // sample_rows)
        sample = reps.where(F.pmod("k1", F.lit(share)) == 0).orderBy(*key).limit(2 * sample_rows).select("vector").toArrow()
        if not sample.num_rows:
            sample = reps.orderBy(*key).limit(sample_rows).select("vector").toArrow()
        x = unit(matrix(sample.column(0), dim))
        k = min(max(ceil(sqrt(n / rows_per_cell)), 4), max(4, sample_rows // 8), len(x))
        books = codebook(x[:, : dim // 2], k), codebook(x[:, dim // 2 :], k)
        r2 = 2 - 2 * threshold
        reach = (r2 if recall >= 1 else min(r2, r2 / dim * 2 * log(1 / (1 - recall)))) + 1e-9
        reps = scratch.write(placed(reps, books, dim), reps)
        load = loads(reps, books, dim, reach)
        parts = (compared(blocks(reps, books, dim, reach, *load, chunk_rows, lo, hi), dim, threshold) for lo, hi in waves(*load, chunk_rows, max(wave_rows, n)))
        found = scratch.gather(parts)
    else:
        found = scratch.write(reps.selectExpr("k1", "k2", "node", "copies as links", "node as root"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy(*key, "node").agg(F.sum("links").alias("links")).join(groups, "node", "left")
    linked = scratch.write(linked.select(*key, "links", F.coalesce("component", "node").alias("component_id")), found)
    known = reps.select(*key, "copies", "node").join(linked, key, "left")
    known = known.select(*key, F.coalesce("component_id", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = scratch.write(known.where("n_links > 0"), linked, reps)
    all_rows = rows.select("id", *key).join(known, key, "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return all_rows.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
