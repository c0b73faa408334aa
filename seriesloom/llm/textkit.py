"""Vectorised text kernels. They run inside Spark tasks, on slices of Arrow batches of a few MB."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_P = 0xD6E8FEB86659FD93


def text_column(column: pa.Array) -> pa.Array:
    """A string column without nulls: null counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n+1 offsets of the rows in them."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows with at most `limit` bytes of text (or one row); yields (rows, their text without nulls)."""
    text = text_column(batch.column(batch.schema.get_field_index(column)))
    at, ends = 0, np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, "right")) - 1)
        yield batch.slice(at, to - at), text.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for each span of spans that don't overlap; equal spans have equal hashes wherever they lie.

    Each value is mixed with its place in the span before all are added up. A polynomial modulo 2^64 wouldn't do: spans
    that repeat by the Thue-Morse rule collide in it whatever the base.
    """
    size = ends - starts
    cuts = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size)
    gapless = len(starts) > 0 and cuts[-1] == ends[-1] - starts[0]
    mixed = mix((values[starts[0] : ends[-1]] if gapless else values[place + np.repeat(starts, size)]) + places(int(size.max(initial=0)))[place])
    total = np.zeros(len(mixed) + 1, _U)
    np.cumsum(mixed, dtype=_U, out=total[1:])
    return mix(total[cuts[1:]] - total[cuts[:-1]] + size.astype(_U) * _U(_PRIME))


@functools.cache
def _places(bits: int) -> np.ndarray:
    return mix(np.arange(1 << bits, dtype=_U) * _U(_P) + _U(1))


def places(n: int) -> np.ndarray:
    """A 64-bit value for each place in a span of at most n."""
    return _places(max(10, n.bit_length()))


@functools.cache
def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value for each byte; with fold, A-Z count as a-z."""
    v = mix((np.arange(256, dtype=_U) + _U(1)) * _U(_PRIME))
    if fold:
        v[65:91] = v[97:123]
    return v


@functools.cache
def _separators() -> np.ndarray:
    x = np.zeros(256, bool)
    x[[0x20, 9, 10, 11, 12, 13]] = True
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the first word's number (n+1 values)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~_separators()[data]
    rows = offsets[(offsets < len(data))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[rows] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[rows[rows > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_points(column: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """All rows as one string, its code points, and the n+1 offsets of rows in code points."""
    data, offsets = raw(column)
    text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return text, points, heads[offsets]


SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """For each code point: white space, letter, number or other, as \\s, \\p{L} and \\p{N} have them."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = kind
    return out


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level BPE pattern starts a match: contractions, letter, number and symbol runs with one space before, white space.

    points: code points of all rows; offsets: n+1 row offsets. Matches cover every code point, so a start is also an end.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[offsets[offsets < n]] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    space = kind == SPACE
    blank = points == 32
    # a run of white space gives its last code point away when something follows it in the row
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~first[1:]
    start = change.copy()
    last = space & follows
    start |= last
    # a blank that stands right before a run belongs to it
    joined = np.zeros(n, bool)
    joined[1:] = (blank & last)[:-1]
    start &= ~joined
    # contractions, where a match can begin at the apostrophe
    mark = np.flatnonzero((points == 39) & start)
    if len(mark):
        row_end = offsets[np.searchsorted(offsets, mark, "right")]
        def at(k):  # noqa: E306
            i = mark + k
            return np.where(i < row_end, points[np.minimum(i, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 2), (two, 3)):
            m = mark[hit]
            start[m + 1] = False
            if size == 3:
                start[m + 2] = False
            e = m + size
            start[e[e < n]] = True
    return np.flatnonzero(start)


@functools.cache
def point_values() -> np.ndarray:
    return mix((np.arange(0x110000, dtype=_U) + _U(1)) * _U(_PRIME))


def group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct key, for each key the number of its group)."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.empty(len(s), bool)
    new[:1] = True
    new[1:] = s[1:] != s[:-1]
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)
