"""Operator 5, benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Texts become arrays of word-shingle hashes. Where a document's shingle is also an item's, one window of the item's length brings the
two to the same place: an aligned start. A window all of whose shared shingles align to its right (left) has a foreign shingle at its
left (right) end, so moving it there never lowers its similarity; the best window thus lies between two aligned starts of its own
shingles, which are less than twice its length apart, and windows are laid at every start between such neighbours. Windows that the
document's end cuts short lose nothing by moving left, so those after the last aligned start are laid too. A text with fewer than
percent of the item's shingles holds no such window and is left out before. Each
window and each item gets a 64-bit SimHash of its weighted shingles (weight: how often a shingle occurs). Fingerprints are cut into
RADIUS + 1 blocks of bits; two that differ in at most RADIUS bits agree in one block or more, so a join on (item, block, value) finds
all windows within RADIUS. Candidates are verified by the exact weighted Jaccard similarity of the two multisets of shingles.

Broadcasts: the items' shingles and the keys of documents with a hit are broadcast if a count finds at most BROADCAST_ROWS of them;
beyond it the same joins shuffle. A hot passage costs one row per place where it stands, not one per pair of documents.

Nulls and edge cases: null texts count as empty; texts and items with fewer words than the shingle size have one shingle, of all
their words; without words they match nothing. Rows with a null doc_id or item_id match nothing. Rows that share a doc_id give the
best window of any of them; equal items match each on its own. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, small

GRAM, PERCENT, RADIUS, BITS = 5, 80, 20, 64


def _with_shingles(df: DataFrame, keys: list[str], gram: int) -> DataFrame:
    """keys and grams, the hashes of the text's word shingles in order: A-Z is lower-cased, words are what ASCII white space separates."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = df.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*keys, F.split(F.trim(F.regexp_replace(lowered, "[\\x20\\x09-\\x0D]+", " ")), " ").alias("words"))
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - gram, F.lit(0)))
    grams = F.transform(places, lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(gram))))
    # rows are exploded by the outer form: the plain one adds a filter that Spark would push below, computing the words anew for each shingle
    return words.select(*keys, grams.alias("grams"))


def _simhash(weighted: DataFrame, by: list[str]) -> DataFrame:
    """SimHash `print` of each group's rows (g, w): the sign, bit by bit, of the weighted sum of +1 and -1."""
    bit = lambda b: F.shiftright("g", b).bitwiseAND(F.lit(1))
    sums = weighted.groupBy(*by).agg(*(F.sum((bit(b) * 2 - 1) * F.col("w")).alias(f"b{b}") for b in range(BITS)))
    value = F.lit(0).cast("long")
    for b in range(BITS):
        value = value.bitwiseXOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return sums.select(*by, value.alias("print"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, mask) of radius + 1 blocks that cover all bits."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _in_blocks(df: DataFrame, name: str, radius: int) -> DataFrame:
    values = F.array(*(F.shiftright(name, a).bitwiseAND(F.lit(m)) for a, m in _blocks(radius)))
    return df.select("*", F.posexplode(values).alias("block", "value"))


def text_key() -> Column:
    """The name of a row's text: all that a window depends on."""
    return F.md5(F.col("text").cast("binary"))


def contaminated(docs: DataFrame, items: DataFrame, gram: int = GRAM, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, similarity): each item that a document holds, with its best window (the first of the best laid).

    start: number of the window's first word; similarity: exact weighted Jaccard of shingles, percent / 100 or more.
    """
    found = contaminated_texts(docs, items, gram, percent, radius)
    held = docs.where("doc_id is not null").select("doc_id", text_key().alias("row")).join(small(found), "row")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return held.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def contaminated_texts(docs: DataFrame, items: DataFrame, gram: int = GRAM, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(row, item_id, start, similarity) by text: row is text_key() of each text that holds an item."""
    texts = docs.select("text", text_key().alias("row"))
    item_rows = durable(_with_shingles(items.where("item_id is not null"), ["item_id"], gram).select("item_id", F.size("grams").alias("n"), F.posexplode_outer("grams").alias("j", "g")), "items")
    places = _with_shingles(texts, ["row"], gram).select("row", F.posexplode_outer("grams").alias("i", "g"))
    start = F.greatest(F.col("i") - F.col("j"), F.lit(0))
    aligned = places.join(small(item_rows), "g").groupBy("row", "item_id", "n", start.alias("start")).agg(F.count(F.lit(1)).alias("shared"))
    pair = Window.partitionBy("row", "item_id", "n")
    hits = aligned.withColumns({"after": F.lead("start").over(pair.orderBy("start")), "shared": F.sum("shared").over(pair)})
    hits = durable(hits.where(F.col("shared") * 100 >= F.col("n") * percent).drop("shared"), "hits")
    held = hits.select("row").distinct()
    sources = _with_shingles(texts.join(small(held), ["row"], "left_semi").dropDuplicates(["row"]), ["row"], gram)
    begin, after, n, length = F.col("start"), F.col("after"), F.col("n"), F.size("grams")
    between = F.when(after - begin < 2 * n, F.sequence(begin, after - 1)).otherwise(F.array(begin))
    cut = F.filter(F.sequence(begin + 1, begin + n), lambda s: (s > length - n) & ((length - s) * 100 >= n * percent))
    laid = F.when(after.isNull(), F.concat(F.array(begin), cut)).otherwise(between)
    windows = hits.join(sources, ["row"]).select("row", "item_id", "n", "grams", F.explode_outer(laid).alias("start"))
    windows = windows.select("row", "item_id", "start", F.explode_outer(F.slice("grams", F.col("start") + 1, n)).alias("g"))
    by = ["row", "item_id", "start"]
    weighted = durable(windows.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("w")), "windows")
    weighted_items = item_rows.groupBy("item_id", "g").agg(F.count(F.lit(1)).alias("w"))
    prints = _in_blocks(_simhash(weighted, by), "print", radius)
    item_prints = _in_blocks(_simhash(weighted_items, ["item_id"]).withColumnRenamed("print", "own"), "own", radius)
    near = prints.join(item_prints, ["item_id", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) <= radius).select(*by).distinct()
    # exact: common weight by a join on shingles, the rest from totals
    common = near.join(weighted, by).join(weighted_items.withColumnRenamed("w", "v"), ["item_id", "g"], "left").groupBy(*by).agg(F.sum("w").alias("size"), F.sum(F.when(F.col("v").isNotNull(), F.least("w", "v")).otherwise(0)).alias("common"))
    sizes = weighted_items.groupBy("item_id").agg(F.sum("w").alias("whole"))
    either = F.col("size") + F.col("whole") - F.col("common")
    found = common.join(sizes, "item_id").where(F.col("common") * 100 >= either * percent).withColumn("similarity", F.col("common") / either)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return found.groupBy("row", "item_id").agg(best).select("row", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))
