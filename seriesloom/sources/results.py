"""Result tables, configurations and run records of a study: written once, never over something that is there."""

from __future__ import annotations

import contextlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The line that ends a complete record.
END_MARK = "-- end of record --"
FORMATS = ("csv", "parquet", "json")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _path(spark, path)
    return system.exists(at)


def require(spark: SparkSession, paths: list[str], hint: str = "") -> None:
    """Raise FileNotFoundError that names all that is missing, in any store that Spark reads."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}" + f". {hint}" * bool(hint))


def write_table(table: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table; an error if there is one already. CSV has a header, and an empty field for null."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    table.write.mode("errorifexists").format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """A result table as write_table() left it; the schema is given, never guessed."""
    return spark.read.schema(schema).format(kind).options(**({"header": True} if kind == "csv" else {})).load(path)


def chosen_as_json(chosen: DataFrame, keys: list[str], name: str = "strategy") -> DataFrame:
    """(strategy, config): each strategy's chosen values as JSON, null where a strategy has none (NaN counts as none)."""
    kinds = dict(chosen.dtypes)
    values = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in keys]
    return chosen.select(name, F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("config"))


@contextlib.contextmanager
def claimed(spark: SparkSession, path: str):
    """Only one session at a time holds the claim on path: a file beside it that is created if it isn't there, in one step.

    Whoever comes second gets FileExistsError. The claim goes when its holder is done, even by an error; a session that was killed leaves it, to be
    deleted by hand.
    """
    system, at = _path(spark, f"{path}.claim")
    jvm, there = spark._jvm, f"{path} is being written by another session (or one that was killed: then delete {path}.claim)"
    local = system.getScheme() == "file"
    if local:  # Hadoop's local store looks first and creates then; the operating system does both at once
        plain = jvm.java.nio.file.Paths.get(at.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        jvm.java.nio.file.Files.createDirectories(plain.getParent(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
    try:
        if local:
            jvm.java.nio.file.Files.createFile(plain, spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            system.create(at, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            raise FileExistsError(there) from None
        raise
    try:
        yield
    finally:
        system.delete(at, False)


def freeze(spark: SparkSession, config: dict, path: str) -> None:
    """Write a configuration once; an error if one is frozen already. Of two sessions that try at once one wins."""
    with claimed(spark, path):
        if exists(spark, path):
            raise FileExistsError(f"{path} is frozen already")
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def frozen(spark: SparkSession, path: str) -> dict:
    require(spark, [path], "freeze a configuration first")
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))  # one configuration


def guard(spark: SparkSession, config: dict, frozen_path: str, record_path: str) -> None:
    """What must hold before the evaluation: a frozen configuration equal to the one derived anew, and no complete record."""
    if frozen(spark, frozen_path) != json.loads(json.dumps(config)):
        raise ValueError("the frozen configuration isn't the one that the tables choose")
    if exists(spark, record_path) and complete(spark, record_path):
        raise FileExistsError(f"{record_path} holds a complete outcome")


def record(spark: SparkSession, lines: list[str], path: str) -> None:
    """The lines of a run and the end mark. One that broke off before its mark is replaced; of two sessions that write at once one wins."""
    with claimed(spark, path):
        if exists(spark, path) and complete(spark, path):
            raise FileExistsError(f"{path} holds a complete outcome")
        rows = [(i, line) for i, line in enumerate([*lines, END_MARK])]
        spark.createDataFrame(rows, "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def complete(spark: SparkSession, path: str) -> bool:
    return not spark.read.text(path).where(F.col("value") == END_MARK).isEmpty()
