"""Byte-level BPE ids by way of distinct pre-tokens: each is encoded once per worker, texts are then put together by gathers."""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa

from . import textkit as K

#: Pre-tokens that a worker remembers; the memory is emptied beyond that, which costs time only.
REMEMBERED = 600_000


@functools.cache
def tokenizer(path: str):
    # a task has one core: threads of the tokenizer would only wait for one another
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _memory(path: str) -> dict[str, bytes]:
    return {}


@functools.cache
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def encode_slice(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, number of ids of each row), the same as the tokenizer's own for each whole text.

    Matches of the tokenizer's pattern are encoded apart from one another, so the ids of a text are those of its pre-tokens in order.
    Texts with the string of a special token go through the tokenizer whole, as it looks for these first.
    """
    whole, points, offsets = K.code_points(text)
    starts = K.pretoken_starts(points, offsets)
    ends = np.append(starts[1:], len(points))[: len(starts)]
    hashes = K.span_hashes(K.point_values()[points], starts, ends)
    one, number = K.group(hashes)
    memory = _memory(path)
    if len(memory) > REMEMBERED:
        memory.clear()
    spans = [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
    new = [s for s in spans if s not in memory]
    for e, s in zip(tokenizer(path).encode_batch_fast(new, add_special_tokens=False), new, strict=True):
        memory[s] = array("I", e.ids).tobytes()
    found = list(map(memory.__getitem__, spans))
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), np.uint32)
    begin = np.cumsum(size) - size
    each = size[number]
    ids = flat[K.ranges(begin[number], each)]
    total = np.concatenate([[0], np.cumsum(each)])
    rows = np.searchsorted(starts, offsets)
    lengths = np.diff(total[rows])
    special = [s for s in special_strings(path) if s in whole]
    if special:
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i, t in enumerate(text.to_pylist()):
            if any(s in t for s in special):
                parts[i] = np.array(tokenizer(path).encode(t, add_special_tokens=False).ids, np.uint32)
        ids, lengths = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return ids, lengths
