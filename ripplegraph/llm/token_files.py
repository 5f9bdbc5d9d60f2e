"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

A dataset is a folder of shards in ascending doc_id order. Shard k has three flat little-endian files:
``<k>.ids`` (unsigned, the narrowest width that holds every id), ``<k>.idx`` (int64, rows + 1 offsets counted in
ids) and ``<k>.doc`` (int64 doc ids; the smallest int64 stands for a null). ``manifest.json`` lists the shards with
their base, the number of ids in all shards before them, taken from prefix sums.

Order: range partitions on doc_id, each sorted, make the shards, so a document's place is its shard's base plus its
offset. Each task attempt writes files of its own name; only the attempt whose row reaches the driver is listed, so a
lost executor costs one task and leaves unlisted files at most. Rows with null text hold the end id alone; equal
doc_ids keep all their rows. Empty input gives an empty dataset. Other columns are not read, whatever their names. A reader's
task takes the byte ranges of its documents alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, trimmed
from .pieces import encoder

NULL_ID = np.iinfo(np.int64).min
SHARD = "shard int, name string, n_docs long, n_ids long, width int"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, keep_space: bool, id_column: str = "doc_id", text_column: str = "text") -> list[dict]:
    """Encodes docs into folder, on any file system that driver and executors share; returns the manifest."""
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, keep_space)
        bits = np.uint16 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        out, files, rows, total = filesystem(folder), {}, 0, 0
        for batch in bounded(batches, "text", 3 << 20):
            if not batch.num_rows:
                continue
            if not files:
                out[0].create_dir(out[1], recursive=True)
                files = {k: out[0].open_output_stream(f"{out[1]}/{name}.{k}") for k in ("ids", "idx", "doc")}
                files["idx"].write(np.zeros(1, "<i8").tobytes())
            ids, bounds = encode.encode(batch.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype(bits)
            bounds = bounds + np.arange(len(bounds))
            files["ids"].write(ids.astype(ids.dtype.newbyteorder("<")).tobytes())
            files["idx"].write((bounds[1:] + total).astype("<i8").tobytes())
            files["doc"].write(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            rows, total = rows + batch.num_rows, total + len(ids)
        for f in files.values():
            f.close()
        ids = bounds = batch = None
        trimmed()
        if rows:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "name": [name], "n_docs": [rows], "n_ids": [total], "width": pa.array([bits().itemsize], pa.int32())})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(shard, SHARD).collect()), key=lambda r: r["shard"])
    base = 0
    for r in manifest:
        r["base"] = base
        base += r["n_ids"]
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps({"shards": manifest, "n_ids": base}).encode())
    return manifest


def mapped(fs: pa.fs.FileSystem, path: str, kind: str, first: int, last: int) -> np.ndarray:
    """Numbers first to last of a flat file: memory-mapped where it is local, else read as a range of bytes."""
    import pyarrow.fs

    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, kind, "r")[first:last] if last > first else np.empty(0, kind)
    width = np.dtype(kind).itemsize
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at((last - first) * width, first * width), kind)


def read(spark: SparkSession, folder: str, most_docs: int = 20_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the folder, from its files.

    The manifest, one entry a shard, is all the driver reads. A task reads at most most_docs documents of a shard.
    """
    fs, at = filesystem(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    parts = [(s["name"], s["base"], s["width"], i, min(i + most_docs, s["n_docs"])) for s in shards for i in range(0, s["n_docs"], most_docs)]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(folder)
        for batch in batches:
            for part in batch.to_pylist():
                path = f"{top}/{part['name']}"
                offsets = mapped(fs, f"{path}.idx", "<i8", part["first"], part["last"] + 1)
                doc_ids = np.array(mapped(fs, f"{path}.doc", "<i8", part["first"], part["last"]))
                ids, at = mapped(fs, f"{path}.ids", f"<u{part['width']}", int(offsets[0]), int(offsets[-1])), int(offsets[0])
                sums = [zlib.crc32(ids[a - at : b - at].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(offsets[:-1] + part["base"]), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    plan = spark.createDataFrame(spark.sparkContext.parallelize(parts, max(1, len(parts))), "name string, base long, width int, first long, last long")
    return plan.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = shared_dir(spark)
    write(docs, folder, tokenizer, end_id=1, keep_space=False)
    return read(spark, folder)
