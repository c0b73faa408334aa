"""Operator 3, document fingerprints by locally consistent parsing.

A text is a sequence of code points. One round of the parse cuts runs of equal symbols into pairs; elsewhere it gives each symbol a
small label by deterministic coin tossing (the lowest bit in which it differs from its left neighbour, repeated until six labels
are left, so neighbours always differ), cuts before each local maximum of the labels, and names each phrase by a hash of its
symbols. Names are the symbols of the next round, until one phrase is left: each round makes a sequence shorter, as a phrase of one
symbol stands only beside a run. Where a cut lies depends on a few symbols around it only, so equal substrings get the same names but
near their ends, whatever their offset. A text's set are the names of all rounds from FIRST on. The fingerprint keeps the KEPT least
hashes of it (a bottom-k sketch); likeness is the share of common hashes among the k least of two sketches' union: exact where both
sets have fewer, otherwise an unbiased estimate of the sets' Jaccard similarity J whose standard error is at most
sqrt(J (1 - J) / KEPT) <= ERROR, whatever the length of the texts.

Nulls and edge cases: a null text counts as empty. The empty text has an empty fingerprint; two empty ones are alike by 1, an empty
and another one by 0. Equal texts have equal fingerprints. Short texts are known by the names of lower rounds too.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import shuffle_partitions

_U = np.uint64
#: The first round (from 0) whose names are in the set.
FIRST = 2
#: Bound of the standard error of a likeness, and the number of hashes that it takes.
ERROR = 0.04
KEPT = math.ceil(1 / (2 * ERROR) ** 2)
#: A text with fewer phrases than this in a round is known by the symbols of the round below too.
SPARSE = 16


def _coin(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit that differs from the left neighbour) + own value of that bit; the first of a text takes bit 0."""
    left = np.empty_like(x)
    left[0] = x[0] ^ x.dtype.type(1)
    left[1:] = x[:-1]
    left[first] = x[first] ^ x.dtype.type(1)
    differ = x ^ left
    if x.dtype == np.uint8:
        bit = _LOW_BIT[differ]
        return ((bit << 1) | ((x >> bit) & 1)).astype(np.uint8)
    low = differ & (~differ + x.dtype.type(1))
    bit = np.frexp(low.astype(np.float64))[1].astype(x.dtype) - x.dtype.type(1)
    return ((bit << x.dtype.type(1)) | ((x >> bit) & x.dtype.type(1))).astype(np.uint8)


_LOW_BIT = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


def parse_round(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each sequence symbols[offsets[i]:offsets[i+1]], and their offsets."""
    n = len(symbols)
    if not n:
        return symbols, offsets
    first = np.zeros(n, bool)
    first[offsets[offsets < n]] = True
    same = np.zeros(n + 1, bool)
    same[1:n] = symbols[1:] == symbols[:-1]
    same[:n] &= ~first
    repeat = same[:-1] | same[1:]
    opens = repeat & ~same[:-1]
    first[1:] |= opens[1:] | (~repeat[1:] & repeat[:-1])
    begin = np.flatnonzero(first)
    label = _coin(symbols, begin)
    for _ in range(3):
        label = _coin(label, begin)
    left = np.empty_like(label)
    left[0] = 255
    left[1:] = label[:-1]
    left[first] = 255
    after = begin + 1
    left[after[after < n]] = 255  # no phrase of one symbol at a stretch's start
    right = np.zeros_like(label)
    right[:-1] = label[1:]
    right[begin[begin > 0] - 1] = 0
    cut = ((label > left) & (label >= right) & ~repeat) | first
    if repeat.any():
        inside = np.flatnonzero(repeat)
        heads = np.flatnonzero(opens)
        place = inside - heads[np.searchsorted(heads, inside, "right") - 1]
        cut[inside[place % 2 == 0]] = True
    cut = np.flatnonzero(cut)
    names = K.span_hashes(symbols, cut, np.append(cut[1:], n))
    return names, np.searchsorted(cut, offsets)


def phrase_sets(points: np.ndarray, offsets: np.ndarray, most: int = KEPT) -> list[np.ndarray]:
    """For each text the hashes of its phrase names in ascending order, the `most` least; the k-th copy of a name counts apart."""
    symbols, at = K.point_values()[points], offsets
    found, where = [], []

    def take(names: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> None:
        n = np.where(wanted, np.diff(at), 0)
        found.append(names[K.ranges(at[:-1], n)])
        where.append(np.repeat(np.arange(len(n)), n))

    for r in itertools.count():
        below = symbols, at
        symbols, at = parse_round(symbols, at)
        if r <= FIRST:
            take(*below, np.diff(at) < SPARSE)  # a short text is known by the round below too
        if r >= FIRST:
            take(symbols, at, (np.diff(below[1]) > 1) | (r == FIRST))
        if r >= FIRST and not (np.diff(at) > 1).any():
            break
    order = np.sort((np.concatenate(where).astype(_U) << _U(32)) | (K.mix(np.concatenate(found)) >> _U(32)))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    heads = np.flatnonzero(new)
    copy = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    again = copy > 0
    name = order[again] & _U(0xFFFFFFFF)
    order[again] = (order[again] ^ name) | (K.mix(name * _U(0xD6E8FEB86659FD93) + copy[again].astype(_U)) >> _U(32))
    order.sort()
    cuts = np.searchsorted(order, np.arange(len(offsets), dtype=_U) << _U(32))
    return [(order[a : min(b, a + most)] & _U(0xFFFFFFFF)).astype(np.uint32) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    return phrase_sets(points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def as_text(sketch: np.ndarray) -> str:
    """Its hashes in base 64, 16 characters for 3 of them."""
    return base64.b64encode(sketch.astype(">u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) >= KEPT or len(b) >= KEPT:
        both = both[:KEPT]
    return float((np.isin(both, a) & np.isin(both, b)).mean())


FIELDS = [
    ("doc_id", T.LongType(), pa.int64()), ("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.StringType(), pa.string()),
    ("edited_fingerprint", T.StringType(), pa.string()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64()),
]
ROW = T.StructType([T.StructField(n, t) for n, t, _ in FIELDS])


def compare_run(rows: list[tuple[int | None, str]]) -> list[tuple]:
    """A row of FIELDS for each of rows but the last, which only serves as the next one of the row before it."""
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:], strict=False)]
    sketches = fingerprints(texts + edited)
    out = []
    for i, (key, text) in enumerate(rows[:-1]):
        own, other, altered = sketches[i], sketches[i + 1], sketches[len(texts) + i]
        out.append((key, len(text), hashlib.sha256(edited[i].encode()).hexdigest(), as_text(own), as_text(altered), likeness(own, altered), likeness(own, other)))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, _, kind) in zip(columns, FIELDS, strict=True)], names=ROW.names)


def _compare_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare rows in order. A border row ends its range: it is the next one of the row before it and no document itself."""
    run, size = [], 0
    for batch in batches:
        for key, text, border in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            run.append((key, text))
            size += len(text)
            if border or size > K.SLICE_BYTES and len(run) > 1:
                if len(run) > 1:
                    yield _batch(compare_run(run))
                run, size = ([], 0) if border else (run[-1:], len(text))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below key, by way of every w-th of them: two short scans, not one of all."""
    w = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + w] for i in range(0, len(bounds), w)]
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    if not chunks:
        return F.lit(0)
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    chunk = below(longs(c[-1] for c in chunks))
    return chunk * w + F.coalesce(below(F.get(F.array(*map(longs, chunks)), chunk)), F.lit(0))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its text edited with the next one's start, and of the next one, by descending doc_id.

    Documents are dealt into ranges of doc_id by quantiles; a task runs through its ranges in order. The last row of a range needs the
    first one of the range after it, so this one's text is sent to both: one text for each range, found by ids alone. Texts move once.
    Rows that share a doc_id follow one another in descending order of their texts; a null doc_id comes last. Rows of one doc_id
    (or of none) lie in one range, as their order is that of their texts.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # several ranges a task, so that tasks are even
    cuts = [i / (4 * n) for i in range(1, 4 * n)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 40 * n)).alias("q")).first()["q"] or []))
    ranged = docs.withColumn("part", F.coalesce(_range_of(F.col("doc_id"), bounds), F.lit(-1)))
    # parts alone are numbered: a row each
    firsts = ranged.groupBy("part").agg(F.max("doc_id").alias("first"))
    before, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("first", F.coalesce(F.lead("part").over(before), F.first("part").over(whole)).alias("of"))
    heads = ranged.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("of").agg(F.max("text").alias("text"))
    rows = ranged.withColumn("border", F.lit(False)).unionByName(heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("of").alias("part"), F.lit(True).alias("border")))
    ordered = rows.repartitionByRange(n, F.desc("part")).sortWithinPartitions(F.desc("part"), "border", F.desc_nulls_last("doc_id"), F.desc("text"))
    return ordered.select("doc_id", "text", "border").mapInArrow(_compare_ranges, ROW)
