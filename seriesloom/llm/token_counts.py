"""Operator 10, token counts by dynamic programming over a trie of distinct pre-tokens.

Pieces of a public vocabulary have unigram scores: the logarithm of a Zipf law over their ranks, as the vocabulary gives ranks and no
probabilities. The count of a pre-token is the number of pieces in its best segmentation (greatest score; then fewest pieces). Its
forward scores need its prefixes only, so pre-tokens are walked in sorted order, which is a depth-first walk of their trie: the
scores of a shared prefix are computed once and stay on a stack. A worker keeps the counts at the trie's terminal nodes, and a
document's count is the sum over its pre-tokens. Characters that no piece covers fall back to one piece per UTF-8 byte.

Documents are read where they lie: no shuffle. Nulls and edge cases: a null text counts as empty and has 0 tokens; rows with null or
repeated doc_ids each give a row; extra columns are dropped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as K

#: Terminal nodes that a worker keeps; beyond that it starts anew, which costs time only.
REMEMBERED = 1_000_000


@functools.cache
def pieces(model_path: str) -> tuple[dict[str, float], int, float]:
    """(score of each piece, longest piece, score of a byte)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.get_piece_size()
    scores = {model.id_to_piece(i): -math.log(i + 2) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return scores, max(map(len, scores)), -2 * math.log(n + 2)


@functools.cache
def _terminals(model_path: str) -> dict[str, int]:
    return {}


def count_sorted(words: list[str], model_path: str) -> list[int]:
    """Counts of distinct pre-tokens in ascending order, by one walk of their trie."""
    scores, longest, byte = pieces(model_path)
    best, count = [0.0], [0]
    last, out = "", []
    for word in words:
        shared, most = 0, min(len(word), len(last))
        while shared < most and word[shared] == last[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, few = best[end - 1] + n * byte, count[end - 1] + n
            for start in range(max(0, end - longest), end):
                s = scores.get(word[start:end])
                if s is not None:
                    value = best[start] + s
                    if value > top or value == top and count[start] + 1 < few:
                        top, few = value, count[start] + 1
            best.append(top)
            count.append(few)
        last = word
        out.append(count[-1])
    return out


def count_slice(text: pa.Array, model_path: str) -> np.ndarray:
    """Token counts of all rows of a slice."""
    whole, points, offsets = K.code_points(text)
    starts = K.pretoken_starts(points, offsets)
    ends = np.append(starts[1:], len(points))[: len(starts)]
    one, number = K.group(K.span_hashes(K.point_values()[points], starts, ends))
    known = _terminals(model_path)
    if len(known) > REMEMBERED:
        known.clear()
    spans = [whole[a:b].replace(" ", "▁") for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
    new = sorted({s for s in spans if s not in known})
    known.update(zip(new, count_sorted(new, model_path), strict=True))
    counts = np.fromiter((known[s] for s in spans), np.int64, len(spans))
    total = np.concatenate([[0], np.cumsum(counts[number])])
    return np.diff(total[np.searchsorted(starts, offsets)])


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_chars) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in K.slices(batch):
                counts = count_slice(text, model_path)
                _, _, offsets = K.code_points(text)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), pa.array(np.diff(offsets))], names=["doc_id", "n_tokens", "n_chars"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
