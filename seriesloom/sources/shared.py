"""Tables that a job writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session was given it. A local session that was given none gets a folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or _OWN.get(context.applicationId)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what is below is computed once, plans above stay short, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
