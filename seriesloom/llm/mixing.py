"""Operator 1, mixing sources to target weights by temperature.

Shares of tokens by source are raised to an exponent a in [0, 1] and normalised. Weights flatten as a falls: their entropy rises and
small sources repeat more. Bisection finds the greatest a whose weights reach the target entropy (a fraction of the logarithm of the number of sources)
and the least a whose weights repeat no source more than repeat_limit times; the greater of the two is used, so the limit wins. Weights
times the token budget are the sources' budgets, rounded by largest remainders so that they sum to the budget.

A source's documents are dealt into blocks by a hash. Each epoch has its own permutation of the source's blocks; epochs that fit the
rest of the budget are taken whole, the last one up to its budget: a document is taken if fewer tokens than the budget come before it,
so a source is over its budget by less than a document. `place` in [0, 1) is the share of its source's budget that comes before the
row; ordering by it interleaves all sources evenly.

The driver gets one row per source and no more than MOST_SOURCES of them (an error beyond that). A hot source has many blocks, so its
rows are dealt over many tasks; its blocks are ordered in BUCKETS ranges of their hash, each by itself, and the ranges by their sums.
Rows that are the same in every column are counted first and numbered as copies, so they are dealt over blocks like any others.

Nulls and edge cases: a null source is a source of its own; null, empty and blank texts have no tokens and are left out, as they fill
no budget; rows that share a doc_id are mixed as rows, repeated rows are taken each by itself; ties of the hash are broken by doc_id, row and
copy; an empty table gives no rows. Extra columns may have any name and type: the plan drops them, mixture() gives them back as they
are. Maps are told apart with the order of their entries. Rows are known by 128 bits of hashes: of n different ones, two share a name
with a chance of about n * n / 2^129.
Tokens are words between ASCII white space.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

BLOCK_TOKENS, BUCKETS, MOST_SOURCES = 50_000, 4096, 10_000_000
#: Copies of a row that are numbered together.
COPIES = 65_536


def weights_of(shares: np.ndarray, exponent: float) -> np.ndarray:
    w = shares**exponent
    return w / w.sum()


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def _bisect(reached, rounds: int = 60) -> float:
    """The greatest a in [0, 1] at which reached(a) holds, for a condition that holds from 0 up to some a; 0 if nowhere."""
    if reached(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) else (low, middle)
    return low


def temperature(tokens: np.ndarray, budget: float, target_entropy: float, repeat_limit: float) -> float:
    """The exponent for sources with these token counts."""
    shares = tokens / tokens.sum()
    wanted = target_entropy * math.log(len(tokens)) if len(tokens) > 1 else 0.0
    flat = _bisect(lambda a: entropy(weights_of(shares, a)) >= wanted - 1e-12)
    over = lambda a: (weights_of(shares, a) * budget / tokens).max() > repeat_limit * (1 + 1e-12)
    # repetition falls as a rises: the least a within the limit is where `over` stops; a budget beyond the limit has none
    least = 1.0 if over(1.0) else (_bisect(over) if over(0.0) else 0.0)
    return min(1.0, max(flat, least + 1e-15 if least else 0.0))


def budgets(tokens: np.ndarray, budget: int, exponent: float) -> np.ndarray:
    exact = weights_of(tokens / tokens.sum(), exponent) * budget
    whole = np.floor(exact).astype(np.int64)
    order = np.argsort(-(exact - whole), kind="stable")
    whole[order[: budget - int(whole.sum())]] += 1
    return whole


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def row_hash(docs: DataFrame) -> Column:
    """A 128-bit name of whole rows, as a struct of two hashes: rows that differ anywhere differ in it."""
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    values = [F.to_json(F.struct(c)) if _holds_map(f.dataType) else c for c, f in zip(columns, docs.schema.fields, strict=True)]
    whole = [*values, *(c.isNull() for c in columns)]
    return F.struct(F.xxhash64(F.lit(1), *whole).alias("a"), F.xxhash64(F.lit(2), *whole).alias("b"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `copy`, 0 and up among rows that are the same; many copies are numbered by many tasks."""
    classes = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    single = classes.where("copies = 1").select(*rows.columns, F.lit(0).cast("long").alias("copy"))
    chunk = classes.where("copies > 1").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    apart = chunk.repartition(shuffle_partitions(rows.sparkSession), "row", "chunk")
    many = apart.select(*rows.columns, F.explode(F.expr(f"sequence(chunk * {COPIES}, least(copies, (chunk + 1) * {COPIES}) - 1)")).alias("copy"))
    return single.unionByName(many)


def mix_plan(docs: DataFrame, budget: int | None = None, target_entropy: float = 0.95, repeat_limit: float = 4.0, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, row, source, n_tokens, epoch, block, place): a row for each time that a document is taken.

    row: row_hash(), which tells rows of one doc_id apart. budget: tokens of the mixture, by default those of the input.
    """
    spark = docs.sparkSession
    counted = docs.select("doc_id", row_hash(docs).alias("row"), "source", F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_tokens")).where("n_tokens > 0")
    totals = sorted(counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).limit(MOST_SOURCES + 1).collect(), key=lambda r: (r["source"] is not None, r["source"]))
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    schema = "s string, blocks long, own long, budget long"
    plan = []
    if totals:
        tokens = np.array([r["n"] for r in totals], float)
        total = int(tokens.sum()) if budget is None else budget
        shares = budgets(tokens, total, temperature(tokens, total, target_entropy, repeat_limit))
        plan = [(r["source"], max(1, -(-r["n"] // block_tokens)), r["n"], int(b)) for r, b in zip(totals, shares, strict=True)]
    sources = spark.createDataFrame(plan, schema)  # one row per source
    sources = F.broadcast(sources) if len(plan) <= 100_000 else sources
    same = F.col("source").eqNullSafe(F.col("s"))
    dealt = numbered(counted).join(sources, same).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row", "copy"), F.col("blocks")))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "row", "copy"), "doc_id", "row", "copy")
    rows = dealt.select("doc_id", "row", "copy", "source", "block", "n_tokens").withColumn("before", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    # each epoch's permutation of blocks, with the tokens that come before each block
    sized = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("own").alias("own"), F.first("budget").alias("budget"))
    epochs = sized.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("budget") / F.col("own")).cast("long")))).where("epoch * own < budget")
    lot = F.xxhash64(F.lit(seed + 2), "source", "epoch", "block")
    drawn = epochs.withColumn("lot", lot).withColumn("bucket", F.floor(F.col("lot") / (2.0**64 / BUCKETS)))
    permuted = Window.partitionBy("source", "epoch", "bucket").orderBy("lot", "block")
    ordered = drawn.withColumn("begin", F.sum("tokens").over(permuted) - F.col("tokens"))
    ranges = Window.partitionBy("source", "epoch").orderBy("bucket")
    offsets = drawn.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("sum")).select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"), (F.sum("sum").over(ranges) - F.col("sum")).alias("offset"))
    begins = ordered.join(offsets, same & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b"))).withColumn("begin", F.col("epoch") * F.col("own") + F.col("offset") + F.col("begin"))
    taken = begins.where("begin < budget").select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "begin", "budget")
    met = rows.join(taken, same & (F.col("block") == F.col("b"))).where(F.col("begin") + F.col("before") < F.col("budget"))
    return met.select("doc_id", "row", "source", "n_tokens", "epoch", "block", ((F.col("begin") + F.col("before")) / F.col("budget")).alias("place"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """docs' rows as the plan takes them, each as often as it is taken, with docs' columns.

    Rows that are the same in every column are one class: the plan's rows for it are made from one of them.
    """
    # packed, so that no name of docs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("doc"), row_hash(docs).alias("row"))
    times = mix_plan(docs, **options).groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    copies = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    met = rows.join(times.join(copies, "row"), "row")
    whole = met.where("copies = 1").unionByName(met.where("copies > 1").dropDuplicates(["row"]))
    return whole.select("doc", F.explode(F.expr("sequence(1L, times)"))).select("doc.*")
