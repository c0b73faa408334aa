"""Helpers shared by the operators: durable intermediate tables and block-wise dictionary joins."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents aims at in block-wise jobs.
BLOCK_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session was given it.

    Where nobody set it, a run on one machine gets a folder of its own; on a cluster no local folder would do, so that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
    return base.rstrip("/")


#: Folders of local sessions, by application.
_OWN: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Drops a query's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of executors.

    What the write has shuffled is of no use after it, so those files go at once and not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = path or fresh_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Durable tables of one job under a folder of its own; each goes after its last use, so that they don't add up on the disk."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.base, self.made, self.paths = spark, fresh_path(spark, job), 0, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{name}-{self.made}"
        kept = durable(df, name, path)
        self.paths[id(kept)] = kept, path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[1])


#: Rows of a few numbers up to which a counted table is broadcast (16 MB or so); beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Bytes of an Arrow batch, so that long texts don't meet by the thousand in a Python worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a smaller bound already."""
    now = spark.conf.get(BATCH).lower().rstrip("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, column: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about block_bytes of text the rows make; follows the size of the input, so a block stays small."""
    total = docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / block_bytes))


def block_of(key: str, blocks: int) -> Column:
    """The block that a key's hash deals it to; a null key has a block too."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
