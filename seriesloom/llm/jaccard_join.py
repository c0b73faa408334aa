"""Operator 9, n-gram Jaccard join by PartEnum signatures.

Two sets link when 100 * intersection >= percent * union. Equal sets are one node, and only one document of each node is signed. Set
sizes are cut into bands, each at most 1 / similarity wide, so linked sets lie in one band or in neighbouring ones; for each pair of
neighbouring bands the links' symmetric difference is at most k = floor((s1 + s2) * (1 - t) / (1 + t)). The domain of hashes is cut into
k + 1 + m equal parts, and a set has one signature per part: the hash of its elements there. Two linked sets differ in at most k parts,
so they agree in m + 1 parts or more. Empty parts would put unlike sets together; a set with at most m of them leaves them out, as it
agrees with each partner in m + 1 - (its empty parts) others or more. A set with more than m emits those too, which suffices, as two
sets that agree in empty parts only both have more than m.

Frequent signatures (a passage that many texts share) are left out as far as these spare agreements go: all sets order their
signatures by one global order, rarest first, and each leaves out as many of its last ones as it has agreements to spare; of the
signatures that two linked sets share, the rarest is then kept by both.

Pairs of a signature are not all formed. Each node meets the least node (hub) of its signature; exact verification gives links and
components. Signatures whose nodes are all in one component are done. Nodes of the others are partitioned anew as finely as can be, with
one element to a part, and subsets of one part enumerated in the order of a global rank, rarest element first. A linked pair's first
common element then has so low a rank in both sets that each has as many elements after it as the overlap needs: a bound that
ties each row to the sizes of partners that it still admits. In each element's group every node meets the node that has the fewest
elements before it (the nearest to what the group has in common), which joins nearly all that is linked; after that, components of a
group meet as wholes, by the bounds of their members, and only members of pairs that pass are compared. Components of all verified
links are those of all links: a pair that isn't compared lies in one component already or is ruled out by a bound.

Nulls and edge cases: a null text counts as empty; a text without words has an empty set (n_shingles 0) and links with nothing, not
even another empty one; fewer words than n make one shingle of the whole sequence; a row with a null doc_id has no component_id (null),
but its text links others; rows that share a doc_id are each a document of their own, with the size and the class of its own text;
repeated rows are repeated in the result; an empty table gives no rows. Extra columns are dropped but for those named in `carry`,
which may have any name but those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .common import Tables, small
from .components import components

_U = np.uint64
GRAM, PERCENT = 5, 80


def shingle_sets(text: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all rows, n+1 offsets): A-Z lower-cased, words between ASCII white space."""
    data, offsets = K.raw(text)
    starts, ends, first = K.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    words = K.span_hashes(K.byte_values(True)[data], starts, ends)
    count = np.diff(first)
    shingles = np.where(count == 0, 0, np.maximum(count - gram + 1, 1))
    at = K.ranges(first[:-1], shingles)
    size = np.minimum(np.repeat(count, shingles), gram)
    total = np.zeros(len(at), _U)
    for j in range(gram):
        inside = j < size
        value = words[np.minimum(at + j, len(words) - 1)]
        total += np.where(inside, K.mix(value + _U(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))), _U(0))
    total = K.mix(total + size.astype(_U))
    cuts = np.concatenate([[0], np.cumsum(shingles)])
    sets = [np.unique(total[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def node_keys(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 63-bit name for each set, the same for equal sets; 0 for the empty one."""
    total = np.concatenate([[_U(0)], np.cumsum(K.mix(elements ^ _U(0xA0761D6478BD642F)), dtype=_U)])
    n = np.diff(offsets).astype(_U)
    keys = K.mix(total[offsets[1:]] - total[offsets[:-1]] + K.mix(n))
    return np.where(n == 0, 0, np.maximum(keys >> _U(1), _U(1)).astype(np.int64))


def size_bands(largest: int, percent: int) -> np.ndarray:
    """Upper ends of the size bands up to one beyond the largest size; index 0 is unused."""
    ends, low = [0], 1
    while True:
        ends.append(low * 100 // percent)
        if low > largest:
            return np.array(ends, np.int64)
        low = ends[-1] + 1


def _parts(top: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(spare parts m, all parts k + 1 + m) for sets up to size `top`; m is more than even the smallest sets leave empty, but for one in hundreds."""
    differ = 2 * top * (100 - percent) // (100 + percent)
    spare = differ // 5 + 2
    return spare, differ + 1 + spare


def slack(elements: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """For the joins of a set's own band and of the next one: spare parts less empty parts; below 0 where empty parts count too.

    A set shares more signatures than this with each linked set of that join (one at least).
    """
    sizes = np.diff(offsets)
    if not len(elements):
        return [np.zeros(len(sizes), np.int64)] * 2
    ends = size_bands(int(sizes.max()), percent)
    band = np.searchsorted(ends, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for step in (0, 1):
        spare, parts = _parts(ends[np.minimum(band + step, len(ends) - 1)], percent)
        part = ((elements >> _U(32)) * parts[owner].astype(_U)) >> _U(32)
        new = np.ones(len(elements), bool)
        new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        out.append(np.where(sizes > 0, spare - (parts - np.bincount(owner[new], minlength=len(sizes))), 0))
    return out


def own_parity(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The lowest bit of the number of each size's band: signatures carry it, as it tells the two joins of a set apart."""
    return (np.searchsorted(size_bands(int(sizes.max(initial=1)), percent), sizes) & 1).astype(np.int64)


def signatures(elements: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of its set) over all sets: each set takes part in its own band's join and in the next band's."""
    sizes = np.diff(offsets)
    if not len(elements):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = size_bands(int(sizes.max()), percent)
    band = np.searchsorted(ends, sizes)
    out, owners = [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for step in (0, 1):
        top = ends[np.minimum(band + step, len(ends) - 1)]
        spare, parts = _parts(top, percent)
        parts = np.where(parts > spare + 1, parts, 0)  # no difference is allowed: only equal sets link, and these are one node
        part = ((elements >> _U(32)) * parts[owner].astype(_U)) >> _U(32)  # ascending in each set, as its elements are
        new = np.ones(len(elements), bool)
        new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        total = np.add.reduceat(K.mix(elements + _U(0x9E3779B97F4A7C15)), heads)
        some = parts[owner[heads]] > 0
        heads, total = heads[some], total[some]
        salt = (((band + step)[owner[heads]]).astype(_U) << _U(32)) + part[heads]
        odd = ((band + step) & 1).astype(_U)
        out.append((K.mix(total ^ K.mix(salt)) & ~_U(1)) | odd[owner[heads]])
        owners.append(owner[heads])
        lacking = parts - np.bincount(owner[heads], minlength=len(sizes))
        for i in np.flatnonzero((lacking > spare) & (sizes > 0) & (parts > 0)):
            have = part[heads[owner[heads] == i]].astype(np.int64)
            empty = np.setdiff1d(np.arange(parts[i]), have).astype(_U)
            out.append((K.mix(K.mix((_U(band[i] + step) << _U(32)) + empty) ^ _U(1)) & ~_U(1)) | odd[i])
            owners.append(np.full(len(empty), i))
    return np.concatenate(out).view(np.int64), np.concatenate(owners)


def _map_texts(docs: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """make(rows, texts without nulls) over slices of a few MB; the text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.slices(batch, "text"):
                yield make(rows, text)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link, by their sets of (node, elements)."""
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    both = right.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    sized = both.select("a", "b", F.size(F.array_intersect("ea", "eb")).alias("common"), (F.size("ea") + F.size("eb")).alias("sum"))
    return sized.where(F.col("common") * (100 + percent) >= F.col("sum") * percent).select("a", "b")


def _partitioned(docs: DataFrame, named: DataFrame, heads: DataFrame, key: str, gram: int, percent: int) -> DataFrame:
    """(sig, node, hub, rows) of signatures that several nodes have. hub: the least of them, rows: how many."""

    def signed(rows: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
        elements, offsets = shingle_sets(text, gram)
        sig, owner = signatures(elements, offsets, percent)
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node_keys(elements, offsets)[owner])], names=["sig", "node"])

    # keys whose texts are all copies of others' texts aren't signed
    marked = named.where(F.col(key).isNotNull()).join(heads.select("node", "least"), "node", "left")
    copies = marked.groupBy(key).agg(F.max(F.coalesce(F.col(key) == F.col("least"), F.lit(False))).alias("head")).where("not head").select(key)
    by_sig = Window.partitionBy("sig")
    first = _map_texts(docs.join(small(copies), key, "left_anti"), [], signed, "sig long, node long")
    counted = first.withColumn("hub", F.min("node").over(by_sig)).withColumn("top", F.max("node").over(by_sig)).withColumn("rows", F.count(F.lit(1)).over(by_sig))
    return counted.where("top > hub").select("sig", "node", "hub", "rows")


def _without_spare(shared: DataFrame, heads: DataFrame) -> DataFrame:
    """Of each node and join of bands, the signatures but for as many of the most frequent ones as there are agreements to spare."""
    odd = F.col("sig").bitwiseAND(F.lit(1))
    spare = F.when(odd == F.col("odd"), F.col("own")).otherwise(F.col("above"))
    order = Window.partitionBy("node", "parity").orderBy(F.desc("rows"), "sig")
    with_spare = shared.join(heads.select("node", "own", "above", "odd"), "node").select("sig", "node", "hub", odd.alias("parity"), "rows", spare.alias("spare"))
    return with_spare.withColumn("from_last", F.row_number().over(order)).where("from_last > spare").select("sig", "node", "hub", "spare")


def _of_several(rows: DataFrame, by: str) -> DataFrame:
    """Rows whose group has nodes of more than one component."""
    spread = rows.groupBy(by).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(by)
    return rows.join(spread, by)


def _joined(labels: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """Labels (node, component) of all nodes, after links between nodes of different components."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias("of_" + c))
    edges = links.join(end("a"), "a").join(end("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    merged = components(edges, tables)
    whole = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    out = tables.keep(labels.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "joined")
    tables.drop(labels, merged)
    return out


def _ranked(sets: DataFrame, open_nodes: DataFrame, percent: int) -> DataFrame:
    """(element, node, n, rank, most): one row per element that links of the node may have as their first common one.

    rank: elements of the set that come before it in the global order; most: the largest partner that it admits.
    """
    each = sets.join(open_nodes, "node").select("node", F.size("elements").cast("long").alias("n"), F.explode("elements").alias("element"))
    often = each.groupBy("element").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    met = each.join(often, "element")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("nodes", "element")) - 1
    ranked = met.withColumn("place", place).withColumn("met", F.count(F.lit(1)).over(own)).select("element", "node", "n", (F.col("n") - F.col("met") + F.col("place")).alias("rank"))
    most = F.floor(((F.col("n") - F.col("rank")) * (100 + percent) - F.col("n") * percent) / percent)
    return ranked.withColumn("most", most).where(F.col("most") * 100 >= F.col("n") * percent)


def shingle_components(docs: DataFrame, key: str = "doc_id", gram: int = GRAM, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, n_shingles, node, component, component_id) per row. node names the row's set and component the least node that
    its links reach (both 0 for an empty set); component_id is the least key that they reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), *carry, "text")
    tables = Tables(spark, "jaccard")

    def names(rows: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
        elements, offsets = shingle_sets(text, gram)
        sizes = np.diff(offsets)
        own, above = slack(elements, offsets, percent)
        made = {"n_shingles": sizes, "node": node_keys(elements, offsets), "own": own, "above": above, "odd": own_parity(sizes, percent)}
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], *map(pa.array, made.values())], names=[key, *carry, *made])

    def contents(rows: pa.RecordBatch, text: pa.Array) -> pa.RecordBatch:
        elements, offsets = shingle_sets(text, gram)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(elements.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(node_keys(elements, offsets)), lists], names=["node", "elements"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + ", n_shingles long, node long, own long, above long, odd long"
    named = tables.keep(_map_texts(docs, [key, *carry], names, schema), "nodes")
    heads = tables.keep(named.where("n_shingles > 0").groupBy("node").agg(F.min(key).alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "own", "above", "odd"))), "heads")
    shared = tables.keep(_partitioned(docs, named, heads, key, gram, percent), "shared")
    kept = tables.keep(_without_spare(shared, heads), "kept")
    tables.drop(shared)

    met = tables.keep(kept.select("node").unionByName(kept.select(F.col("hub").alias("node"))).distinct().join(heads.select("node", "least", "n_shingles"), "node"), "met")
    owned = met.select(F.col("least").alias(key)).where(F.col(key).isNotNull()).distinct()
    wanted = docs.where(F.col(key).isNotNull()).join(small(owned), key, "left_semi").unionByName(docs.where(F.col(key).isNull()))
    sets = _map_texts(wanted, [], contents, "node long, elements array<long>").join(small(met.select("node")), "node", "left_semi")
    sets = tables.keep(sets.dropDuplicates(["node"]), "sets")

    # links to hubs; a pair that shares few signatures with its hub waits for the finer partition
    size = lambda c: met.select(F.col("node").alias(c), F.col("n_shingles").alias("n_" + c))
    alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    to_hub = kept.where("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max("spare").alias("spare"))
    likely = to_hub.where("shared * 2 > spare").join(size("a"), "a").join(size("b"), "b").where(alike).select("a", "b")
    links = tables.keep(verify(likely, sets, percent), "links")
    found = components(links, tables)
    labels = tables.keep(met.select("node").join(found.select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "parts")
    tables.drop(links, found)

    # what may still link: nodes of one signature in different components, by single elements
    open_nodes = tables.keep(_of_several(kept.select("sig", "node").join(labels, "node"), "sig").select("node").distinct(), "open")
    tables.drop(kept)
    fine = tables.keep(_ranked(sets, open_nodes, percent), "fine")
    tables.drop(open_nodes, met)
    parted = _of_several(fine.join(labels, "node"), "element")
    hubs = parted.groupBy("element").agg(F.min(F.struct("rank", "node", "n", "most", "component")).alias("h"))
    near = parted.join(hubs, "element").where("component <> h.component and n <= h.most and h.n <= most")
    near = near.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
    links = tables.keep(verify(near, sets, percent), "near-links")
    labels = _joined(labels, links, tables)
    tables.drop(links)

    # components of an element meet by the bounds of their members; one of a pair must admit partners of its own size
    parted = tables.keep(_of_several(fine.join(labels, "node"), "element"), "parted")
    cells = parted.groupBy("element", "component").agg(F.min("n").alias("n"), F.max("most").alias("most"), F.max(F.col("most") >= F.col("n")).alias("core"))
    side = lambda df, x, names: df.select("element", *(F.col(c).alias(f"{c}_{x}") for c in names))
    admit = F.expr("n_x <= most_y and n_y <= most_x")
    pairs = side(cells, "x", cells.columns[1:]).join(side(cells, "y", cells.columns[1:]), "element").where(admit & F.expr("component_x < component_y and (core_x or core_y)"))
    pairs = pairs.select("element", "component_x", "component_y")
    members = lambda x: side(parted, x, ["component", "node", "n", "most"])
    rest = pairs.join(members("x"), ["element", "component_x"]).join(members("y"), ["element", "component_y"]).where(admit)
    rest = rest.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    links = tables.keep(verify(rest, sets, percent), "rest-links")
    labels = _joined(labels, links, tables)
    tables.drop(links, parted, fine, sets)

    grouped = heads.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = tables.keep(grouped.join(least, "component").select("node", "component", "component_id"), "classes")
    tables.drop(labels, heads)
    # many copies share a node, so its class goes to the rows where it is small enough
    return named.select(key, *carry, "n_shingles", "node").join(small(classes), "node", "left").withColumn("component", F.coalesce("component", F.lit(0).cast("long")))


def shingle_classes(docs: DataFrame, key: str = "doc_id", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the least key that links reach."""
    rows = shingle_components(docs, key, gram, percent)
    return rows.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"))
