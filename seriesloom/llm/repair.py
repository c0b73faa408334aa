"""Operator 12, conversation structure repair by Dijkstra's algorithm on an implicit lattice.

A node is (turn index, grammar state); edges are edits. Keep (K) costs 0, Rerole (R) to user or assistant 2, Delete (D) 3, Insert (I)
of an empty user or assistant turn 2; blank rows and duplicates must be deleted; truncated rows that stay add 1. The roles' first
letters must give `(s?(ua)+)?`. Nodes are popped by (cost, audit), audit being the edits' letters so far, and the search stops at the
first accepting end node: the cheapest edits, the least audit in ASCII among them. Of two ways of one cost to the same node neither
audit begins with the other (what it had more would be inserts, which cost), so their order lasts whatever follows.

That is why a long conversation can be split: its rows, sorted by ranges and numbered by counts of ranges, form blocks of
BLOCK rows. Each block's search starts from each grammar state (only the first state in a conversation's first block) and settles all
of its end nodes; these few (entry, exit, cost, audit) are then put together in order, block by block, and each block learns its way.
Rows are edited block by block, so no task ever holds a conversation's texts, however long it is. What is a letter a row in one place
is the audit alone, which is one value of the result. Groups are read as sorted streams, many to a task, not one Python call each.

Nulls and edge cases: a null role or text counts as one space. A null turn comes first and has no part in gaps; null conv_ids are one
conversation. Rows that share a turn are in the order of role and text. The first letter of a role is its initial; an empty role has none, and its row can't be
kept as it is. A conversation without rows has an empty audit, zeros, and the hash of nothing. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .merkle import numbered

BLOCK = 1024
#: Grammar: what an initial leads to from each state. 0: nothing yet, 1: after s, 2: after u, 3: after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What an inserted or reroled turn must be, by state; where a conversation may end.
TURN, ENDS = {0: "user", 1: "user", 2: "assistant", 3: "user"}, (0, 3)
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Faults, in the order in which the first counts.
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
LEGAL = ("su", "ua", "au")


# ---- damage, as the query's contract has it


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of `conv_id:turn` mod 20: 0 drops a row, 1 empties its text, 2 removes its
    `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls count as one space, but for conv_id and turn themselves."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    # an array of 0, 1 or 2 copies
    return rows.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies", "copy")


# ---- faults


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, idx, role, text, ...) with fault: blank, duplicate (the conversation has role and text before) or truncated, else null.

    First occurrences are found by an aggregation that tasks begin before the shuffle, so copies without number are no one task's.
    """
    named = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    first = named.groupBy("conv_id", "h1", "h2").agg(F.min("idx").alias("first")).select(F.col("conv_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    met = named.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(last == "", BLANK).when(F.col("idx") > F.col("first"), DUPLICATE).when(~last.isin(".", "!", "?"), CUT)
    return met.withColumn("fault", fault).drop("of", "g1", "g2", "h1", "h2", "first")


# ---- the search


def ways(rows: list[tuple[str, str | None]], entries: Iterable[int], last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit): the cheapest edits of rows (initial, fault) from each entry state to each state that can be
    reached; if last, to the first accepting one that is popped."""
    out = []
    for entry in entries:
        heap, settled = [(0, "", 0, entry)], set()
        while heap:
            cost, audit, i, state = heapq.heappop(heap)
            if (i, state) in settled:
                continue
            settled.add((i, state))
            if i == len(rows) and (not last or state in ENDS):
                out.append((entry, state, cost, audit))
                if last:
                    break
            ahead = STEPS[state, TURN[state][0]]
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, ahead))
            if i == len(rows):
                continue
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault in (BLANK, DUPLICATE):
                continue
            more = TRUNCATED if fault == CUT else 0
            if (state, initial) in STEPS:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEPS[state, initial]))
            heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, ahead))
    return out


def together(blocks: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, for each block the state it starts from and its audit) of the cheapest ways through all blocks in order.

    Audits so far are compared whole, as of two states one's may begin with the other's.
    """
    best: dict[int, tuple[int, str, list]] = {0: (0, "", [])}
    for found in blocks:
        after: dict[int, tuple[int, str, list]] = {}
        for entry, exit_, cost, audit in found:
            if entry in best:
                before, said, way = best[entry]
                new = before + cost, said + audit
                if exit_ not in after or new < after[exit_][:2]:
                    after[exit_] = *new, (way, entry, audit)
        best = after
    cost, _, way = min((v for s, v in best.items() if s in ENDS), key=lambda v: v[:2])
    out = []
    while way:
        way, entry, audit = way
        out.append((entry, audit))
    return cost, out[::-1]


def edited(rows: Iterable[tuple[str, str]], entry: int, audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of rows after the audit's edits, from a grammar state on."""
    state, given = entry, iter(rows)
    for letter in audit:
        role, text = (TURN[state], "") if letter == "I" else next(given)
        if letter == "D":
            continue
        role = TURN[state] if letter == "R" else role
        state = STEPS[state, role[:1]]
        yield role, text


# ---- streams


def _stream(df: DataFrame, dealt: list[str], order: list[str], keys: int, each: Callable, schema: str) -> DataFrame:
    """each(key, rows) for runs of rows whose first `keys` columns are the same: dealt by columns, sorted, and read in Arrow batches as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        made = itertools.chain.from_iterable(each(key, group) for key, group in itertools.groupby(rows, key=lambda r: r[:keys]))
        while chunk := list(itertools.islice(made, 2048)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(*dealt).sortWithinPartitions(*order).mapInArrow(run, schema)


WAYS = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _search(key: tuple, group: Iterable) -> Iterator[tuple]:
    """A block: its ways, its counts of faults and of illegal neighbours, and its first and last initials."""
    rows, faults, illegal, n_blocks = [], dict.fromkeys((BLANK, DUPLICATE, CUT), 0), 0, 1
    for _, block, _, initial, fault, n_blocks in group:  # noqa: B007
        illegal += bool(rows) and rows[-1][0] + initial not in LEGAL
        rows.append((initial, fault))
        if fault:
            faults[fault] += 1
    found = ways(rows, (0,) if key[1] == 0 else range(4), key[1] + 1 == n_blocks)
    yield *key, [dict(zip(("entry", "exit", "cost", "audit"), w, strict=True)) for w in found], *faults.values(), illegal, rows[0][0], rows[-1][0]


def _choose(key: tuple, group: Iterable) -> Iterator[tuple]:
    """A conversation's blocks in order: the way of each, and in each row the conversation's totals."""
    rows = list(group)
    cost, chosen = together([[(w["entry"], w["exit"], w["cost"], w["audit"]) for w in r[2]] for r in rows])
    counts = [sum(r[i] for r in rows) for i in range(3, 7)]
    counts[3] += sum(a[8] + b[7] not in LEGAL for a, b in itertools.pairwise(rows))
    for r, (entry, audit) in zip(rows, chosen, strict=True):
        yield *r[:2], entry, audit, cost, *counts


def _edit(key: tuple, group: Iterable) -> Iterator[tuple]:
    """A block's way, which comes first, and then its rows: the repaired rows."""
    rows = iter(group)
    *_, entry, audit = next(rows)
    for place, (role, text) in enumerate(edited(((r[3], r[4]) for r in rows), entry, audit)):
        yield *key, place, role, text


def _digest(key: tuple, group: Iterable) -> Iterator[tuple]:
    """The hash of a conversation's repaired rows, as they come."""
    h = hashlib.sha256()
    for n, (_, _, _, role, text) in enumerate(group):
        h.update(f"{chr(10) if n else ''}{role}:{text}".encode())
    yield *key, h.hexdigest()


class Repair:
    """The repair of conversations (conv_id, turn, role, text)."""

    def __init__(self, conversations: DataFrame, block: int = BLOCK):
        """Whatever is read more than once is written to the shared folder."""
        tables = self.tables = Tables(conversations.sparkSession, "repair")
        spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
        rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
        # the number tells rows apart that are the same, so that ranges can split them
        rows = tables.keep(rows.withColumn("nth", F.monotonically_increasing_id()), "rows")
        order: list[Column] = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("nth")]
        placed = tables.keep(numbered(rows, order, tables, "conv_id").drop("nth"), "placed")
        tables.drop(rows)
        self.rows = placed.withColumn("block", F.floor(F.col("idx") / block))
        letters = with_faults(self.rows).select("conv_id", "block", "idx", F.substring("role", 1, 1).alias("initial"), "fault")
        sizes = placed.groupBy("conv_id").agg((F.floor((F.count(F.lit(1)) - 1) / block) + 1).alias("blocks")).withColumnRenamed("conv_id", "of")
        letters = letters.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
        searched = _stream(letters, ["conv_id", "block"], ["conv_id", "block", "idx"], 2, _search, f"conv_id long, block long, ways {WAYS}, blank long, duplicate long, truncated long, illegal long, first string, last string")
        chosen = _stream(searched, ["conv_id"], ["conv_id", "block"], 1, _choose, "conv_id long, block long, entry int, audit string, cost long, blank long, duplicate long, truncated long, illegal long")
        #: (conv_id, block, entry, audit, cost, counts): the way through each block.
        self.chosen = tables.keep(chosen, "chosen")

    def repaired(self) -> DataFrame:
        """(conv_id, block, place, role, text): the repaired rows; block and place give their order."""
        none = lambda kind: F.lit(None).cast(kind)
        heads = self.chosen.select("conv_id", "block", F.lit(-1).cast("long").alias("idx"), none("string").alias("role"), none("string").alias("text"), "entry", "audit")
        rows = self.rows.select("conv_id", "block", "idx", "role", "text", none("int").alias("entry"), none("string").alias("audit"))
        return _stream(heads.unionByName(rows), ["conv_id", "block"], ["conv_id", "block", "idx"], 2, _edit, "conv_id long, block long, place int, role string, text string")

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows.

        gaps: turns that are missing between the least and the greatest.
        """
        missing = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long"))
        gaps = self.rows.groupBy("conv_id").agg(missing.alias("gaps"))
        totals = self.chosen.groupBy("conv_id").agg(*(F.first(c).alias(c) for c in (*COUNTS, "cost")), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        own = totals.withColumnRenamed("conv_id", "of")
        return gaps.join(own, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "gaps", *COUNTS, "cost", "audit")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of conversations that have rows after the repair: role:text, joined by line feeds."""
        return _stream(self.repaired(), ["conv_id"], ["conv_id", "block", "place"], 1, _digest, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame, after: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conv_id of conversations: what was wrong with its rows in `after`, the cheapest edits and the repaired text's hash."""
    done = Repair(after, block)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    got = ids.join(done.summary().withColumnRenamed("conv_id", "of"), same("of"), "left").join(done.digests().withColumnRenamed("conv_id", "of2"), same("of2"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return got.select("conv_id", *(zero(c) for c in ("gaps", *COUNTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
