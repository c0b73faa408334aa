"""Recursions and order statistics over (series_id, seq) without a list of past rows: running sums, a few lags, and counts by digit of rank."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import by_series, running

#: Orders of magnitude (base e) that a block of a discounted sum spans; three blocks back is below what a double can hold.
SPAN, BACK = 230.0, 3
#: Bits of a digit of rank, and children of a node of the rank tree.
BITS = 4
RADIX = 1 << BITS
#: Rows of a series up to which it may be a group of one task (some 100 MB).
TOGETHER = 1 << 20


def with_ewm(df: DataFrame, value: str, decay: float, name: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Adds name: v_0 = x_0, v_t = decay * v_(t-1) + (1 - decay) * x_t over the rows where value isn't null, as known at each row.

    A step is an affine map, so maps of neighbouring rows compose. Known rows form blocks; inside a block the composition is a running
    sum of terms over powers of decay, which can't overflow there, and a block's end is carried into the blocks after it. Each row is
    visited a fixed number of times, whatever the decay or the length of the series. Null before the first known value.
    """
    size = max(1, int(SPAN / -math.log(decay)))
    series = by_series(*keys)
    n = F.count(value).over(running(series))
    numbered = df.withColumns({"ewm n": n, "ewm x0": F.first(value, ignorenulls=True).over(running(series))})
    numbered = numbered.withColumns({"ewm block": F.floor((F.col("ewm n") - 1) / size), "ewm k": F.pmod(F.col("ewm n") - 1, F.lit(size))})
    up, down = F.pow(F.lit(decay), -F.col("ewm k")), F.pow(F.lit(decay), F.col("ewm k"))
    inside = running(Window.partitionBy(*keys, "ewm block").orderBy("seq"))
    local = numbered.withColumn("ewm local", down * F.sum(F.col(value) * (1 - decay) * up).over(inside))
    by_block = Window.partitionBy(*keys).orderBy("ewm block")
    # what the blocks before hand on; before the first one it is x_0
    ends = {f"ewm end {j}": F.coalesce(F.max_by("ewm local", "ewm n").over(by_block.rangeBetween(-j, -j)), F.when(F.col("ewm block") == j - 1, F.col("ewm x0")), F.lit(0.0)) for j in range(1, BACK + 1)}
    carry = F.lit(0.0)
    for j in range(BACK, 0, -1):
        carry = carry * decay**size + F.col(f"ewm end {j}")
    got = local.withColumns(ends).withColumn(name, F.when(F.col("ewm n") > 0, F.coalesce("ewm local", F.lit(0.0)) + down * decay * carry))
    return got.drop("ewm n", "ewm x0", "ewm block", "ewm k", "ewm local", *ends)


def order_statistics(x: np.ndarray, seen: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each question the k-th smallest (from 0) of the first `seen` values, all at once: bit by bit of the ranks, from the highest.

    At each bit values are dealt stably to zeros and ones; running counts of zeros turn a range of the first values into its part among
    zeros or ones.
    """
    order = np.argsort(x, kind="stable")
    level = np.empty(len(x), np.int64)
    level[order] = np.arange(len(x))
    low, high, found = np.zeros(len(seen), np.int64), seen.copy(), np.zeros(len(seen), np.int64)
    for bit in reversed(range(max(1, (len(x) - 1).bit_length()))):
        one = (level >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        inside = zeros[high] - zeros[low]
        up = k >= inside
        k = np.where(up, k - inside, k)
        found += up.astype(np.int64) << bit
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        level = np.concatenate([level[one == 0], level[one == 1]])
    return x[order[found]]


def expanding_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], least: int = 1, keys: tuple[str, ...] = ("series_id",), together: int = TOGETHER) -> DataFrame:
    """Adds for each name its quantile (linear between neighbours) of all known values up to the row; null before `least` of them.

    Work is n log n, and past rows are never listed. Where no series has more than `together` rows (one number that comes to the driver),
    a series is a bounded group of one task; longer ones are answered by running counts in windows, which stream. Both give the same
    rows. (keys, seq) is a row.
    """
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    if longest > together:
        return _by_counts(df, value, quantiles, least, keys, max(1, -(-(longest - 1).bit_length() // BITS)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        x = rows[value].to_numpy(float)
        known = ~np.isnan(x)
        n = np.cumsum(known)
        ready, out = np.flatnonzero(n >= max(least, 1)), {}
        for name, q in quantiles.items():
            place = q * (n[ready] - 1)
            low = np.floor(place).astype(np.int64)
            one, two = (order_statistics(x[known], n[ready], np.minimum(k, n[ready] - 1)) for k in (low, low + 1))
            filled = np.full(len(x), None, object)
            filled[ready] = one + (two - one) * (place - low)
            out[name] = filled
        return rows.assign(**out)

    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in quantiles)])
    return df.groupBy(*keys).applyInPandas(run, schema)


def _by_counts(df: DataFrame, value: str, quantiles: dict[str, float], least: int, keys: tuple[str, ...], levels: int) -> DataFrame:
    """Each known value has a rank in its series, and the ranks' digits are a tree of RADIX children a node. At each level, running counts
    of a node's children tell every question (row, k) below which child the k-th smallest of the values so far lies."""
    series = by_series(*keys)
    by_value = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value), "seq")
    ranked = df.withColumns({"q n": F.count(value).over(running(series)), "q rank": F.when(F.col(value).isNotNull(), F.row_number().over(by_value).cast("long") - 1)})
    asked, which = [], 0
    for q in quantiles.values():
        low = F.floor(F.lit(q) * (F.col("n") - 1))
        for k in (low, F.least(low + 1, F.col("n") - 1)):
            which += 1
            asked.append(F.struct(F.lit(which).alias("which"), k.alias("k")))
    own = F.struct(F.lit(0).alias("which"), F.lit(0).cast("long").alias("k"))
    slim = ranked.select(*keys, "seq", F.col("q n").alias("n"), F.col("q rank").alias("rank"), F.col(value).cast("double").alias("value"))
    each = slim.withColumn("ask", F.explode_outer(F.when(F.col("n") >= max(least, 1), F.array(own, *asked)).otherwise(F.array(own))))
    is_value = F.col("ask.which") == 0
    each = each.where(~is_value | F.col("rank").isNotNull()).select(*keys, "seq", "ask.which", F.when(~is_value, F.col("ask.k")).alias("k"), F.lit(0).cast("long").alias("node"), F.when(is_value, F.col("rank")).alias("rank"), F.when(is_value, F.col("value")).alias("value"))
    for level in range(levels - 1, -1, -1):
        so_far = running(Window.partitionBy(*keys, "node").orderBy("seq", "which"))
        digit = F.shiftright("rank", BITS * level).bitwiseAND(F.lit(RADIX - 1))
        # upto j: values so far below the node's children 0 to j
        upto = [f"upto {j}" for j in range(RADIX - 1)]
        counted = each.withColumn("digit", digit).withColumns({c: F.count(F.when(F.col("digit") <= j, 1)).over(so_far) for j, c in enumerate(upto)})
        child = sum((F.when(F.col(c) <= F.col("k"), 1).otherwise(0) for c in upto), F.lit(0))
        before = F.greatest(F.lit(0).cast("long"), *(F.when(F.col(c) <= F.col("k"), F.col(c)) for c in upto))
        each = counted.select(*keys, "seq", "which", (F.col("k") - before).alias("k"), (F.col("node") * RADIX + F.coalesce("digit", child)).alias("node"), "rank", "value")
    # a leaf has one value
    found = each.withColumn("found", F.max("value").over(Window.partitionBy(*keys, "node"))).where("which > 0")
    at = found.groupBy(*keys, "seq").agg(*(F.max(F.when(F.col("which") == i, F.col("found"))).alias(f"q at {i}") for i in range(1, which + 1)))
    met = ranked.join(at, [*keys, "seq"], "left")
    between = {}
    for i, (name, q) in enumerate(quantiles.items()):
        place = F.lit(q) * (F.col("q n") - 1)
        between[name] = F.col(f"q at {2 * i + 1}") + (F.col(f"q at {2 * i + 2}") - F.col(f"q at {2 * i + 1}")) * (place - F.floor(place))
    return met.select(*(F.col(f"`{c}`") for c in df.columns), *(v.alias(name) for name, v in between.items()))
