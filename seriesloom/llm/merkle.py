"""Operator 11, Merkle dataset manifest with a broadcast upper tree.

A row's leaf is the hash of its columns; each `tree` (lang) has its leaves in ascending order of doc_id. While several nodes remain,
every ARITY of them in order become their hash; the last node is the tree's subroot. Subroots in order of tree are the leaves of
one more tree, whose last node is the root. Hashes are SHA-256 in lowercase hex, of inputs put one after the other.

Leaves are sorted by ranges and numbered by counts of the ranges, so no tree is sorted or numbered in one task. Groups of ARITY^LEVELS
neighbours (a block) are reduced to one node each, apart from one another. What remains (a node for each block) is small: the
driver reduces it, and broadcasts for each block the siblings above it, up to the root. The executors then go through the blocks once more
and finish each row's proof: siblings inside the block, then those of the suffix. Only digests of leaves are shuffled, never texts.

If more than MOST_TOP nodes remain (beyond some 4 * 10^9 leaves, or where there are very many trees), the driver's part is done by the
executors instead: blocks of nodes are reduced again and again, also those of the subroots, and paths are joined instead of broadcast.

Nulls and edge cases: a null column counts as `-` in the leaf; a null tree is a tree of its own, the first; null doc_ids come first; rows of
one doc_id are ordered by their leaf; rows that are the same in all hashed columns have the same leaf and stand next to one another. A row
without siblings has the hash of nothing as its proof's. A row with a null doc_id isn't tampered with. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, fresh_path, shuffle_partitions, small

ARITY, LEVELS = 8, 5
#: Nodes that the driver reduces: at most so many rows of some 100 bytes come to it, and paths of some 2 KB go back.
MOST_TOP = 1 << 17
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row of documents; named columns are taken instead of the row's own."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels_of(digests: list[str], most: int | None = None) -> list[list[str]]:
    """The nodes of each level, from the given ones up: to a single one, or by `most` levels whether or not one remains before."""
    out = [digests]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        below = out[-1]
        out.append([digest(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def sibling_runs(levels: list[list[str]], i: int) -> list[tuple[list[str], int]]:
    """For each level but the last: (the siblings of node i's ancestor, left to right, how many of them are on its left)."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % ARITY
        run = nodes[first : first + ARITY]
        out.append((run[: i - first] + run[i - first + 1 :], i - first))
        i //= ARITY
    return out


def fold(node: str, runs: Iterable[tuple[list[str], int]]) -> str:
    """The top node that a node and its siblings give."""
    for others, left in runs:
        node = digest([*others[:left], node, *others[left:]])
    return node


# ---- numbering


def numbered(rows: DataFrame, order: list[Column], tables: Tables, tree: str = "tree") -> DataFrame:
    """rows with idx, their place in their tree from 0: sorted by ranges of order (the tree first), counted by range and tree."""
    n = shuffle_partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = tables.keep(ranged.withColumn("part", F.shiftright("at", 33)), "ordered")
    counts = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # a row for each range and each tree in it
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select(F.col(tree).alias("of"), F.col("part").alias("of_part"), "shift")
    met = placed.join(small(starts), F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return met.withColumn("idx", F.col("at") + F.col("shift")).drop("of", "of_part", "part", "at", "shift")


# ---- blocks


PATH = "array<struct<others: array<string>, left: int>>"


def _blocked(nodes: DataFrame, size: int) -> DataFrame:
    """nodes (tree, idx, ...) with the number of their block, and whether the tree has no other."""
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("tree", "of")
    met = nodes.join(small(sizes), F.col("tree").eqNullSafe(F.col("of"))).drop("of")
    return met.withColumn("block", F.floor(F.col("idx") / size)).withColumn("alone", F.col("n") <= size).drop("n")


def _reduced(blocked: DataFrame, height: int) -> DataFrame:
    """(tree, idx, digest): the node of each block. A tree of one block is reduced to its subroot, whatever its height."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        top = levels_of(rows["digest"].tolist(), None if rows["alone"].iloc[0] else height)[-1][0]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "idx": rows["block"].iloc[:1], "digest": [top]})

    return blocked.groupBy("tree", "block").applyInPandas(run, "tree string, idx long, digest string")


def _with_runs(blocked: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(tree, idx, path) of each node of blocks: what is inside, then the block's own path above (tree, idx, path)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        levels = levels_of(rows["digest"].tolist(), None if rows["alone"].iloc[0] else height)
        suffix = rows["path"].iloc[0]
        paths = [[{"others": o, "left": k} for o, k in sibling_runs(levels, i)] + list(suffix) for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "path": paths})

    met = _joined(blocked.select("tree", "idx", "block", "alone", "digest"), above)
    return met.groupBy("tree", "block").applyInPandas(run, f"tree string, idx long, path {PATH}")


def _joined(blocked: DataFrame, above: DataFrame) -> DataFrame:
    own = above.select(F.col("tree").alias("of"), F.col("idx").alias("of_block"), *(c for c in above.columns if c not in ("tree", "idx")))
    return blocked.join(own, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))).drop("of", "of_block")


# ---- what stands above the blocks


TOP = f"tree string, idx long, path {PATH}, subroot string, root string"


def _top_on_driver(tops: DataFrame) -> DataFrame:
    """For each block: the path from its node to the root, its tree's subroot and the root. At most MOST_TOP rows."""
    rows = sorted(((r["tree"] is not None, (r["tree"] or "").encode(), r["tree"], r["idx"], r["digest"]) for r in tops.collect()), key=lambda r: (r[:2], r[3]))
    trees = [(name[2], [r[4] for r in group]) for name, group in itertools.groupby(rows, key=lambda r: r[:3])]
    within = [levels_of(nodes) for _, nodes in trees]
    upper = levels_of([x[-1][0] for x in within])
    out = []
    for t, ((name, nodes), levels) in enumerate(zip(trees, within, strict=True)):
        rest = sibling_runs(upper, t)
        out += [(name, i, sibling_runs(levels, i) + rest, levels[-1][0], upper[-1][0]) for i in range(len(nodes))]
    return F.broadcast(tops.sparkSession.createDataFrame(out, TOP))


def _top_on_executors(tops: DataFrame, tables: Tables, height: int) -> DataFrame:
    """The same without the driver: passes over blocks of nodes until each tree has one, then over the tree of subroots."""

    def up(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(single nodes (tree, digest), paths (tree, idx, path) from nodes up to them)."""
        passes = []
        while True:
            blocked = tables.keep(_blocked(nodes, ARITY**height), "blocks")
            nodes = tables.keep(_reduced(blocked, height), "nodes")
            passes.append(blocked)
            if blocked.where(~F.col("alone")).isEmpty():
                break
        paths = nodes.select("tree", "idx", F.array().cast(PATH).alias("path"))
        for blocked in reversed(passes):
            paths = tables.keep(_with_runs(blocked, paths, height), "paths")
        return nodes.select("tree", "digest"), paths

    subroots, lower = up(tops)
    ordered = numbered(subroots.select(F.col("tree").alias("name"), F.lit("").alias("tree"), F.col("digest")), [F.col("tree"), F.asc_nulls_first("name")], tables)
    ordered = tables.keep(ordered, "subroots")
    root, upper = up(ordered.select("tree", "idx", "digest"))
    named = ordered.select("name", F.col("idx").alias("place"), F.col("digest").alias("subroot"))
    rest = named.join(upper.select(F.col("idx").alias("place"), F.col("path").alias("rest")), "place").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one root
    met = lower.join(rest, F.col("tree").eqNullSafe(F.col("name")))
    return met.select("tree", "idx", F.concat("path", "rest").alias("path"), "subroot", "root")


# ---- the manifest


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _rows_of(height: int):
    """Finish a block's proofs, and fold what was found now (`seen`) with the original siblings."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        levels = levels_of(rows["leaf"].tolist(), None if rows["alone"].iloc[0] else height)
        suffix = [(list(x["others"]), x["left"]) for x in rows["path"].iloc[0]]
        subroot, root = rows["subroot"].iloc[0], rows["root"].iloc[0]
        beyond = "".join(itertools.chain.from_iterable(o for o, _ in suffix))
        proofs, folded = [], []
        for i, seen in enumerate(rows["seen"]):
            inside = sibling_runs(levels, i)
            proofs.append(digest([*itertools.chain.from_iterable(o for o, _ in inside), beyond]))
            folded.append(fold(seen, itertools.chain(inside, suffix)))
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    return run


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = LEVELS, most_top: int = MOST_TOP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs.

    tampered: a condition on the columns of documents; where it holds the row is folded as if its text were in lower case (A-Z).
    height: levels of a block. most_top: nodes up to which the driver reduces what stands above the blocks.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "merkle")
    now = leaf_of() if tampered is None else F.when(tampered, leaf_of(text=lowered(F.col("text")))).otherwise(leaf_of())
    leaves = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("leaf"), now.alias("seen"))
    # the number tells rows apart that are the same in all columns, so that ranges can split them
    leaves = tables.keep(leaves.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    order = [F.asc_nulls_first("tree"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("nth")]
    placed = numbered(leaves, order, tables).drop("nth")
    blocked = tables.keep(_blocked(placed, ARITY**height), "blocked")
    tables.drop(leaves)
    tops = tables.keep(_reduced(blocked.withColumnRenamed("leaf", "digest"), height), "tops")
    above = _top_on_driver(tops) if tops.count() <= most_top else _top_on_executors(tops, tables, height)
    return _joined(blocked, above).groupBy("tree", "block").applyInPandas(_rows_of(height), MANIFEST)


def write_manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The manifest as a table at path (in the shared folder if none is given), read back."""
    path = path or fresh_path(docs.sparkSession, "manifest")
    manifest(docs).write.parquet(path)
    return docs.sparkSession.read.schema(MANIFEST).parquet(path)
