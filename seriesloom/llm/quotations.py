"""Operator 8, chat formatting by quotation linking. DataFrame functions only.

Lines of a message are parsed for their quote level (the number of '>' before the text). Lines of one level that follow one another
are a passage. Quoted passages are normalised (ASCII lower case, white space to one space, ends trimmed), hashed and matched with what
the conversation's earlier messages say themselves: whole bodies, passages, paragraphs, and every run of as many lines as some quote of the
conversation has. A passage belongs to the last such message; failing that, to the last one that holds all of its lines in order,
with others between them; failing that, its paragraphs are looked up one by one. A message replies to the origin of its outermost quote that has one (the first of them), else to the turn before it. Its text is
what it doesn't quote. Conversations are ordered by depth in the reply tree, then by turn, so a message follows what it replies to.

The origin is found by a window over each (conversation, hash), not by a join of all quotes with all originals, so a passage that is
said and quoted often costs one sort; runs of lines are named by rolling hashes over their words, linear in a message's length; only quotes of several lines that no run equals are joined to originals line by line. Depths are found by pointer doubling: rounds grow with the logarithm of the longest chain.

Nulls and edge cases: a null text counts as empty; a null role stays null; rows without conv_id or turn give no row; rows that share
both are messages of their own, in the order of role (null first) and text, each before the next; messages with nothing but quotes have an empty text; quotes without an origin
are left out of the text all the same. An empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Moduli and base of the rolling hashes: products of two residues fit a long, three moduli make 93 bits.
PRIMES, BASE = (2147483647, 2147483629, 2147483587), 1_000_003


def normalised(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, "[\\x20\\x09-\\x0D]+", " "))


def _lines(text: Column) -> Column:
    """The normalised lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")


def _paragraphs(text: Column) -> Column:
    return F.split(text, "\n(?:[\\x20\\x09-\\x0D]*\n)+")


def _power(base: int, at: Column, prime: int) -> Column:
    """base ** at modulo prime for 0 <= at < 2^31, by the bits of at."""
    value = F.lit(1).cast("long")
    for bit in range(31):
        value = value * F.when(F.shiftright(at, bit).bitwiseAND(F.lit(1)) == 1, F.lit(pow(base, 1 << bit, prime)).cast("long")).otherwise(F.lit(1).cast("long")) % prime
    return value


def _rolled(words: Column) -> list[Column]:
    """Per modulus, the sum of the words' hashes times BASE ** place."""
    start = F.struct(*(F.lit(v).cast("long").alias(f"{name}{i}") for name, v in (("sum", 0), ("unit", 1)) for i in range(len(PRIMES))))

    def step(acc: Column, word: Column) -> Column:
        sums = [((acc[f"sum{i}"] + F.pmod(F.xxhash64(word), F.lit(p)) * acc[f"unit{i}"]) % p).alias(f"sum{i}") for i, p in enumerate(PRIMES)]
        return F.struct(*sums, *((acc[f"unit{i}"] * BASE % p).alias(f"unit{i}") for i, p in enumerate(PRIMES)))

    return F.aggregate(words, start, step)


def _name(n: Column, values: list[Column]) -> Column:
    return F.concat_ws("-", n, *values)


def _runs(bodies: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, turn, h): names of all runs of k lines, for each k that lengths gives a conversation.

    Sums over words run on through a message's lines, so a run's sum is the difference of two of them, moved to its first word: time follows
    the number of lines for each k, and line breaks within a run make no difference.
    """
    count = range(len(PRIMES))
    lines = bodies.join(lengths.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.posexplode_outer(_lines(F.col("text"))).alias("at", "line")).where("line is not null")
    lines = lines.select("conv_id", "turn", "at", F.split("line", " ").alias("words")).select("conv_id", "turn", "at", F.size("words").cast("long").alias("n"), _rolled(F.col("words")).alias("own"))
    so_far = Window.partitionBy("conv_id", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("through", F.sum("n").over(so_far)).withColumn("ahead", F.col("through") - F.col("n"))
    lines = lines.withColumns({f"here{i}": F.col(f"own.sum{i}") * _power(BASE, F.col("ahead"), p) % p for i, p in enumerate(PRIMES)} | {f"back{i}": _power(pow(BASE, -1, p), F.col("ahead"), p) for i, p in enumerate(PRIMES)})
    lines = lines.withColumns({f"sum{i}": F.sum(f"here{i}").over(so_far) for i in count})
    ends = F.struct("at", "ahead", "through", *(f"back{i}" for i in count), *(f"sum{i}" for i in count), *((F.col(f"sum{i}") - F.col(f"here{i}")).alias(f"before{i}") for i in count))
    whole = lines.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(ends)).alias("ends")).join(lengths, "conv_id").where(F.size("ends") >= F.col("k"))

    def run(a: Column) -> Column:
        first, last = F.get("ends", a), F.get("ends", a + F.col("k") - 1)
        return _name(last["through"] - first["ahead"], [(last[f"sum{i}"] - first[f"before{i}"]) % p * first[f"back{i}"] % p for i, p in enumerate(PRIMES)])

    return whole.select("conv_id", "turn", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("ends") - F.col("k")), run)).alias("h"))


def _in_order(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, level, origin): the last earlier message that holds all lines of a quote, in order."""
    wanted = quotes.select("conv_id", "turn", "nth", "level", F.size("lines").alias("k"), F.posexplode("lines").alias("at", "line"))
    said = bodies.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("origin"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    said = said.groupBy("conv_id", "origin", "line").agg(F.sort_array(F.collect_list("place")).alias("places"))
    met = wanted.join(said, ["conv_id", "line"]).where("origin < turn")
    each = met.groupBy("conv_id", "turn", "nth", "level", "k", "origin").agg(F.sort_array(F.collect_list(F.struct("at", "places"))).alias("all")).where(F.size("all") == F.col("k"))
    # the least place after the one before; null once there is none
    last = F.aggregate("all", F.lit(-1), lambda before, x: F.array_min(F.filter(x["places"], lambda p: p > before)))
    return each.where(last.isNotNull()).groupBy("conv_id", "turn", "nth", "level").agg(F.max("origin").alias("origin"))


def _passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, level, text): passages in order."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    mark = F.regexp_extract("raw", "^((?:[\\x20\\x09]*>)*)", 1)
    lines = lines.select("conv_id", "turn", "line", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.when(mark == "", F.col("raw")).otherwise(F.regexp_replace("raw", "^(?:[\\x20\\x09]*>)+[\\x20\\x09]?", "")).alias("text"))
    w = Window.partitionBy("conv_id", "turn").orderBy("line")
    new = F.when(F.col("level") == F.lag("level").over(w), 0).otherwise(1)
    lines = lines.withColumn("new", new).withColumn("nth", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = lines.groupBy("conv_id", "turn", "nth", "level").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("all"))
    return grouped.select("conv_id", "turn", "nth", "level", F.array_join(F.col("all.text"), "\n").alias("text"))


def reply_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, reply_to, depth, quoted): one row per message."""
    by = Window.partitionBy("conv_id").orderBy("turn", F.asc_nulls_first("role"), "text")
    rows = conversations.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("own_turn"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # from here on turn is the place in the conversation, so that messages of one turn are told apart
    messages = rows.withColumn("turn", F.row_number().over(by).cast("long"))
    tables = Tables(conversations.sparkSession, "quotations")
    passages = tables.keep(_passages(messages), "passages")
    said = passages.where("level = 0").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("all"))
    bodies = said.select("conv_id", "turn", F.trim(F.array_join(F.col("all.text"), "\n")).alias("text"))
    hashed = lambda df: df.withColumn("h", F.md5(normalised(F.col("text")))).where(normalised(F.col("text")) != "")
    parts = passages.where("level = 0").select("conv_id", "turn", "text")
    lines = parts.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("text"))
    paragraphs = bodies.select("conv_id", "turn", F.explode(_paragraphs(F.col("text"))).alias("text"))
    quoted = passages.where("level > 0").select("conv_id", "turn", F.col("nth").cast("int").alias("nth"), F.col("level").cast("int").alias("level"), "text", _lines(F.col("text")).alias("lines"))
    lengths = quoted.select("conv_id", F.size("lines").alias("k")).where("k > 1").distinct()
    originals = hashed(bodies.unionByName(parts).unionByName(lines).unionByName(paragraphs)).select("conv_id", "turn", "h").unionByName(_runs(bodies, lengths)).select("conv_id", "turn", "h", *(F.lit(None).cast("int").alias(c) for c in ("nth", "level", "part"))).distinct()
    # part: 0 for a whole passage, 2 and more for its paragraphs, where it has several
    pieces = quoted.select("*", _paragraphs(F.col("text")).alias("pieces"))
    pieces = pieces.where(F.size("pieces") > 1).select("conv_id", "turn", "nth", "level", F.posexplode("pieces").alias("part", "text")).withColumn("part", F.col("part") + 2)
    quotes = hashed(quoted.drop("lines").withColumn("part", F.lit(0)).unionByName(pieces)).select("conv_id", "turn", "h", "nth", "level", "part")
    # a passage of several lines is looked up among runs too, by its name there
    several = quoted.where(F.size("lines") > 1).withColumn("words", F.split(F.array_join("lines", " "), " ")).withColumn("own", _rolled(F.col("words")))
    several = several.select("conv_id", "turn", _name(F.size("words").cast("long"), [F.col(f"own.sum{i}") for i in range(len(PRIMES))]).alias("h"), "nth", "level", F.lit(0).alias("part"))
    quotes = quotes.unionByName(several)
    before = Window.partitionBy("conv_id", "h").orderBy(F.col("turn").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    found = originals.unionByName(quotes).withColumn("origin", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).where("level is not null and origin is not null")
    found = tables.keep(found.groupBy("conv_id", "turn", "nth", "level", "part").agg(F.max("origin").alias("origin")), "origins")
    found_first = found
    rest = quoted.where(F.size("lines") > 1).join(found.where("part = 0"), ["conv_id", "turn", "nth", "level"], "left_anti")
    found = found.unionByName(_in_order(rest, bodies).withColumn("part", F.lit(1)))
    origin = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "nth", "part", "origin")).alias("o"))
    count = passages.where("level > 0").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("quoted"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    linked = messages.select("conv_id", "turn", "role", "own_turn").withColumn("previous", F.lag("turn").over(by_turn))
    linked = linked.join(origin, ["conv_id", "turn"], "left").join(count, ["conv_id", "turn"], "left").join(bodies, ["conv_id", "turn"], "left")
    linked = tables.keep(linked.select("conv_id", "turn", "own_turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("o.origin", "previous").alias("reply_to"), F.coalesce("quoted", F.lit(0)).cast("long").alias("quoted")), "replies")
    tables.drop(passages, found_first)

    # pointer doubling: up is the ancestor `steps` replies above, null once the first message is passed; such rows rest from then on
    hops = linked.select("conv_id", "turn", F.col("reply_to").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    rounds = 0
    while True:
        above = hops.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        moved = hops.where("up is not null").join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.col("further").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        last, hops = hops, tables.keep(hops.where("up is null").unionByName(moved), "hops")
        if rounds:
            tables.drop(last)
        rounds += 1
        if hops.where("up is not null").isEmpty():
            break
    placed = linked.join(hops.select("conv_id", "turn", F.col("steps").alias("depth")), ["conv_id", "turn"])
    order = Window.partitionBy("conv_id").orderBy("depth", "turn")
    placed = placed.withColumn("position", F.row_number().over(order).cast("long"))
    turns = linked.select("conv_id", F.col("turn").alias("reply_to"), F.col("own_turn").alias("replied"))
    return placed.join(turns, ["conv_id", "reply_to"], "left").select("conv_id", "position", F.col("own_turn").alias("turn"), "role", "text", F.col("replied").alias("reply_to"), "depth", "quoted")
