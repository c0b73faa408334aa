"""Operator 2, token-ID output: shards of concatenated ids with Elias-Fano document boundaries.

A shard is one file: ids as little-endian uint16 (uint32 for larger vocabularies), the Elias-Fano code of the ends of its
documents, the Elias-Fano code of their doc_ids (above the first one), and a footer that says where each part lies and how many null
doc_ids come first. Shards are ranges of doc_id in ascending order, one per Spark partition, of about SHARD_BYTES of text or less, and
rows keep that order inside. `start` over all shards is the running sum of a manifest with one row per shard.

Nulls and edge cases: a null text counts as empty and gives the end id alone; a null doc_id sorts first; rows that share a doc_id (or
have none) follow one another in the order of their texts' hashes, by which they are dealt over shards too; rows that are the same in
both lie in one shard; an empty table gives no documents. Other columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import block_count, shuffle_partitions
from .elias_fano import EliasFano, encode
from .tokens import encode_slice, tokenizer

#: Bytes of text encoded at once: the larger, the fewer times a pre-token is looked up.
SLICE_BYTES = 3 << 20
#: Bytes of text that a shard aims at: a table of more than so many for each shuffle partition makes more shards.
SHARD_BYTES = 256 << 20
MAGIC = b"SLTK0002"
FOOT = "<QQQQqBxxx8s"
FOOT_SIZE = struct.calcsize(FOOT)
MANIFEST = "shard int, path string, n_docs long, n_ids long"
ROWS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("shard", T.IntegerType()),
])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode docs.text and write the shards and their manifest under folder; returns the manifest.

    A task that runs again writes the same file anew and moves it into place, so a lost executor leaves nothing half-written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        wide = tokenizer(tokenizer_path).get_vocab_size() > 1 << 16
        kind = "<u4" if wide else "<u2"
        system, base = _filesystem(folder)
        path = f"{base}/shard-{shard:06d}.tok"
        part = f"{path}.{task.taskAttemptId()}.part"
        lengths, keys, nulls, out = [], [], 0, None
        for batch in batches:
            for rows, text in K.slices(batch, limit=SLICE_BYTES):
                if out is None:
                    out = system.open_output_stream(part)
                    out.write(MAGIC)
                ids, n = encode_slice(text, tokenizer_path)
                at = np.cumsum(n) + np.arange(len(n))
                whole = np.full(len(ids) + len(n), end_id, kind)
                keep = np.ones(len(whole), bool)
                keep[at] = False
                whole[keep] = ids
                out.write(whole.tobytes())
                lengths.append(n + 1)
                key = rows.column(rows.schema.get_field_index("doc_id"))
                nulls += key.null_count
                keys.append(np.asarray(key.drop_null(), np.int64))
        if out is None:
            return
        ends = np.cumsum(np.concatenate(lengths))
        boundary, known = encode(ends), np.concatenate(keys)
        first = int(known[0]) if len(known) else 0
        with out:
            out.write(boundary)
            out.write(encode(known.view(np.uint64) - np.uint64(first % (1 << 64))))
            out.write(struct.pack(FOOT, int(ends[-1]), len(ends), len(boundary), nulls, first, wide, MAGIC))
        system.move(part, path)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"shard-{shard:06d}.tok"], "n_docs": [len(ends)], "n_ids": [int(ends[-1])]})

    spark = docs.sparkSession
    system, base = _filesystem(folder)
    if folder.startswith("file:") or "://" not in folder:
        system.create_dir(base, recursive=True)
    n = shards or max(shuffle_partitions(spark), block_count(docs, block_bytes=shard_bytes))
    order = F.col("doc_id").asc_nulls_first(), "lot"
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("lot")).repartitionByRange(n, *order)
    dealt.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Shard:
    """Random access to one file: only the footer, the two codes and the ids that are asked for are read."""

    def __init__(self, uri: str):
        system, path = _filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size() - FOOT_SIZE
        self.n_ids, self.n, boundary, self.nulls, self.first, wide, magic = struct.unpack(FOOT, self.file.read_at(FOOT_SIZE, size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.kind = np.dtype("<u4" if wide else "<u2")
        at = len(MAGIC) + self.n_ids * self.kind.itemsize
        self.ends = EliasFano(self.file.read_at(boundary, at))
        self.keys = EliasFano(self.file.read_at(size - at - boundary, at + boundary))

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """doc_ids of documents i..j-1, nulls first."""
        known = self.keys.slice(max(0, i - self.nulls), max(0, j - self.nulls)) + np.int64(self.first)
        return pa.concat_arrays([pa.nulls(max(0, min(j, self.nulls) - i), pa.int64()), pa.array(known, pa.int64())])

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i..j-1 begin, and the end of the last."""
        head = [0] if i == 0 else [self.ends.select(i - 1)]
        return np.concatenate([head, self.ends.slice(i, j)]).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - begin) * size, len(MAGIC) + begin * size), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i, i + 1))


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start over all shards, n_tokens, crc32 of its ids as little-endian uint32, shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(f"{folder}/{row['path']}")
                i = 0
                while i < shard.n:
                    j = min(i + 512, shard.n)
                    at = shard.bounds(i, j)
                    ids = shard.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes()
                    cuts = ((at - at[0]) * 4).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([
                        shard.doc_ids(i, j), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(np.full(j - i, row["shard"], np.int32)),
                    ], names=ROWS.names)
                    i = j

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per shard: the only step that isn't dealt out
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    return based.repartition(shuffle_partitions(spark), "shard").mapInArrow(read, ROWS)
