"""Operator 13, line deduplication by sorted hashes. DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of least_chars code points or more become
rows (128-bit hash, doc_id, row, position). They are range-partitioned by hash and bucket and sorted inside by document (the largest
doc_id first) and position; the stream then passes on the first line of each row with the key. Counts and largest documents of
keys come from these first lines, combined before they are shuffled. A key that least_docs or more documents hold loses its lines
in all of them but those of the largest doc_id. What is returned for a text is no text but its keep bitmap, compressed to the
places where the bit changes (0: kept up to the first of them).

Hot keys: rows of one key are dealt over as many buckets as there are partitions, so a line that all documents hold is no single task's.
Lines meet the keys that lose by a join that broadcasts these keys if a count finds few of them, and shuffles otherwise; the same
goes for texts and bitmaps. Nothing is cut or sampled.

Nulls and edge cases: a null text counts as empty: one empty line. Each row is a document of its own, so rows that are the same count
as often as they occur; all rows of the largest doc_id keep the key's lines. A null doc_id is less than any other. If all lines go,
the kept text is empty. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, shuffle_partitions, small

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bytes of bitmaps up to which they are broadcast to the texts; beyond it the texts are shuffled to them.
BROADCAST_BYTES = 64 << 20
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hash(x: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits as two columns: the second hash is seeded by the first's constant."""
    return [F.xxhash64(x).alias(names[0]), F.xxhash64(F.lit(1), x).alias(names[1])]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): a row is known by its doc_id and its text's hash; rows that agree in both have one bitmap."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", whole.alias("text"), *_hash(whole, ("t1", "t2")))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, tables: Tables | None = None) -> DataFrame:
    """(doc_id, t1, t2, n_dropped, flips) for each text that loses lines.

    flips: ascending line numbers (from 0) at which the keep bit changes. The table lies in the shared folder.
    """
    spark = docs.sparkSession
    tables, n = tables or Tables(spark, "line-dedup"), shuffle_partitions(spark)
    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("doc_id", "t1", "t2", "row", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "t1", "t2", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    keyed = tables.keep(keyed.select("doc_id", "t1", "t2", "row", "pos", *_hash(F.col("key"), ("h1", "h2"))), "lines")
    bucketed = keyed.select("h1", "h2", F.pmod("row", F.lit(n)).cast("int").alias("bucket"), "doc_id", "row", "pos")
    stream = bucketed.repartitionByRange(n, "h1", "h2", "bucket")
    w = Window.partitionBy("h1", "h2", "bucket").orderBy(F.desc_nulls_last("doc_id"), "row", "pos")
    first = stream.withColumn("before", F.lag("row").over(w)).where("before is null or before <> row")
    losing = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs).select("h1", "h2", "last")
    losing = tables.keep(losing, "losing")
    gone = keyed.join(small(losing), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    # a set: rows that are the same send the same positions
    each = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    after = F.transform("gone", lambda x: x + 1)
    flips = F.sort_array(F.concat(F.array_except("gone", after), F.array_except(after, F.col("gone"))))
    made = tables.keep(each.select("doc_id", "t1", "t2", F.size("gone").cast("long").alias("n_dropped"), flips.alias("flips")), "bitmaps")
    tables.drop(keyed, losing)
    return made


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of docs: its lines where the keep bit is set, joined by line feeds."""
    size = bitmaps.select(F.sum(64 + 4 * F.size("flips")).alias("n")).first()["n"] or 0
    own = bitmaps.withColumnRenamed("doc_id", "of")
    own = F.broadcast(own) if size <= BROADCAST_BYTES else own
    texts = _texts(docs)
    # equal hashes are asked for first; null doc_ids agree
    met = texts.join(own, (texts.t1 == own.t1) & (texts.t2 == own.t2) & texts.doc_id.eqNullSafe(own["of"]), "left").select("doc_id", "text", "n_dropped", "flips")
    lines = F.split("text", "\n")
    split = met.select("doc_id", "text", "n_dropped", "flips", lines.alias("lines"))
    # kept runs lie between edges 0 and 1, 2 and 3, ...
    edges = F.concat(F.array(F.lit(0)), "flips", F.array(F.size("lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("flips"), F.lit(2)), lambda k: F.slice("lines", F.get(edges, k) + 1, F.get(edges, k + 1) - F.get(edges, k)))
    kept = F.when(F.col("flips").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept"))


def deduplicated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of docs."""
    return apply_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs))
