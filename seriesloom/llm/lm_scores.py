"""Operator 4, LM scoring by cross-entropy difference.

Two word bigram models share one vocabulary: every word `[^\\x20\\x09-\\x0D]+` of the corpus and the end mark. The target's model counts
the target's documents, the background's all others, so between them they count every document once. They are matched: same order,
same prior, and the background's counts are scaled to the target's number of tokens, so that neither is the smoother one for its size.
Bigrams are interpolated with unigrams by a Dirichlet prior of PRIOR counts, unigrams with the uniform distribution over the
vocabulary. A document's own counts are left out of the model that holds them: each is scored by what all others say. The score is the
mean over the document's tokens of target loss minus background loss, in nats: below 0 means nearer to the target.

Documents are dealt into blocks of bounded size. A block sends its distinct words and bigrams, as sorted 64-bit hashes with counts,
packed by ranges of the hash; a range is merged over all blocks, and each block gets the totals back in the order of the hashes it
sent. Blocks and ranges grow in number with the input, not in size, and no table is held whole anywhere. Two words or bigrams of one
hash would be counted as one; of n distinct ones about n * n / 2^64 do.

Nulls and edge cases: a null text counts as empty (its only token is the end mark); rows with a null doc_id are scored and are no
target; rows that share a doc_id are all target if the id is; rows that are repeated count as often as they come and score alike; an
empty target, or one that is the whole corpus, leaves the other model uniform; an empty table gives none; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import Tables, block_count, shuffle_partitions, small

PRIOR = 4.0
#: Bytes of text that a block aims at: some two million distinct words and bigrams.
MODEL_BLOCK_BYTES = 16 << 20
_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def pack(values: np.ndarray) -> bytes:
    """64-bit values by planes of bytes, compressed: small ones take little room."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def word_keys(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(even keys of the words of all rows in order, n+1 offsets of the rows in them)."""
    data, offsets = K.raw(text)
    starts, ends, first = K.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, _U), first
    return K.span_hashes(K.byte_values(False)[data], starts, ends) & ~_U(1), first


def bigram_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Odd keys of the bigrams: for each row its words and the end mark, each with what stands before it (first the start mark)."""
    n = np.diff(first)
    ends = np.cumsum(n + 1) - 1
    token, before = np.full(len(words) + len(n), _END), np.full(len(words) + len(n), _START)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = words
    before[1:] = token[:-1]
    before[ends - n] = _START
    return K.mix(before * _U(0x9E3779B97F4A7C15) + K.mix(token)) | _U(1)


def _block(rows: pa.Table) -> tuple[list, np.ndarray, list]:
    """(slices of a block with their keys, the block's distinct keys in ascending order, numbers of each slice's keys among them)."""
    found = []
    for batch in rows.combine_chunks().to_batches():
        for part, text in K.slices(batch):
            words, first = word_keys(text)
            marked = part.column(part.schema.get_field_index("marked")).to_numpy(zero_copy_only=False).astype(bool)
            found.append((part, first, marked, np.concatenate([words, bigram_keys(words, first)])))
    keys, number = np.unique(np.concatenate([f[3] for f in found]), return_inverse=True)
    return found, keys, np.split(number, np.cumsum([len(f[3]) for f in found])[:-1])


def _sides(first: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Whether the document of each word, then of each bigram of a slice, is the target's."""
    n = np.diff(first)
    return np.concatenate([np.repeat(marked, n), np.repeat(marked, n + 1)])


COUNTS = "blk int, part int, n long, keys binary, nt binary, nb binary, docs_t long, docs_b long"


def _count(parts: int, rows: pa.Table) -> pa.Table:
    """A block's distinct keys with their counts in target and background, one row for each range of keys."""
    found, keys, numbers = _block(rows)
    nt, nb = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for (_, first, marked, _), number in zip(found, numbers, strict=True):
        side = _sides(first, marked)
        nt += np.bincount(number[side], minlength=len(keys))
        nb += np.bincount(number[~side], minlength=len(keys))
    of = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=parts))
    targets, blk = sum(int(f[2].sum()) for f in found), rows.column("blk")[0].as_py()
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        docs = (targets, rows.num_rows - targets) if i == 0 else (0, 0)
        out.append((blk, int(of[a]), int(b - a), pack(np.diff(keys[a:b].view(np.int64), prepend=np.int64(0))), pack(nt[a:b]), pack(nb[a:b]), *docs))
    names = ["blk", "part", "n", "keys", "nt", "nb", "docs_t", "docs_b"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


TOTALS = "blk int, part int, n long, nt binary, nb binary, docs_t long, docs_b long, words_t long, words_b long, vocabulary long"


def _merge(rows: pa.Table) -> pa.Table:
    """Totals over all blocks for each row of a range, in the order of its keys; the first row says how many words the range has."""
    n = rows.column("n").to_pylist()
    read = lambda name: [unpack(x.as_py(), k) for x, k in zip(rows.column(name), n, strict=True)]
    keys = np.concatenate([np.cumsum(x) for x in read("keys")])
    distinct, number = np.unique(keys, return_inverse=True)
    word, cuts = distinct & 1 == 0, np.cumsum(n)[:-1]
    columns, words = [], []
    for name in ("nt", "nb"):
        total = np.bincount(number, np.concatenate(read(name)), len(distinct)).astype(np.int64)
        columns.append(pa.array([pack(x) for x in np.split(total[number], cuts)], pa.binary()))
        words.append(int(total[word].sum()))
    once = [pa.array([k, *[0] * (len(n) - 1)], pa.int64()) for k in (*words, int(word.sum()))]
    names = ["blk", "part", "n", "nt", "nb", "docs_t", "docs_b", "words_t", "words_b", "vocabulary"]
    return pa.table([*(rows.column(c) for c in names[:3]), *columns, *(rows.column(c) for c in names[5:7]), *once], names=names)


SCORES = "doc_id long, target_loss double, background_loss double, n_tokens long"


def _score(whole: dict, prior: float, rows: pa.Table, totals: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64()), "n_tokens": pa.array([], pa.int64())})
    found, keys, numbers = _block(rows)
    order = np.argsort(totals.column("part").to_numpy())
    n = totals.column("n").to_numpy()
    if n.sum() != len(keys):
        raise ValueError("the totals don't fit the block")
    counts = [np.concatenate([unpack(totals.column(c)[int(i)].as_py(), int(n[i])) for i in order]) for c in ("nt", "nb")]
    size = whole["vocabulary"] + 1
    scale = whole["tokens_t"] / whole["tokens_b"] if whole["tokens_t"] and whole["tokens_b"] else 1.0
    out = []
    for (part, first, marked, _), number in zip(found, numbers, strict=True):
        words, length = first[-1], np.diff(first)
        doc = np.repeat(np.arange(len(length)), length + 1)
        at = np.concatenate([np.repeat(np.arange(len(length)), length), doc])
        # how often a document itself has each of its words and bigrams
        _, where, own = np.unique(at * len(keys) + number, return_inverse=True, return_counts=True)
        own, ends = own[where], np.cumsum(length + 1) - 1
        inner = np.ones(len(doc), bool)
        inner[ends] = False
        losses = []
        for total, side, docs, tokens, k in ((counts[0], marked, whole["docs_t"], whole["tokens_t"], 1.0), (counts[1], ~marked, whole["docs_b"], whole["tokens_b"], scale)):
            c = k * (total[number] - own * side[at])
            edge = k * (docs - side)
            token = np.empty(len(doc))
            token[inner], token[ends] = c[:words], edge
            history = np.empty(len(doc))
            history[1:] = token[:-1]
            history[ends - length] = edge
            one = (token + prior / size) / (k * (tokens - side * (length + 1)) + prior)[doc]
            two = (c[words:] + prior * one) / (history + prior)
            losses.append(np.add.reduceat(-np.log(two), ends - length) / (length + 1))
        out.append(pa.table([part.column(part.schema.get_field_index("doc_id")), *map(pa.array, losses), pa.array(length + 1)], names=["doc_id", "target_loss", "background_loss", "n_tokens"]))
    return pa.concat_tables(out)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, prior: float = PRIOR, block_bytes: int = MODEL_BLOCK_BYTES) -> DataFrame:
    """(doc_id, score, target_loss, background_loss, n_tokens) for each row of docs; target_ids: doc_ids of the target's documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks, tables = block_count(docs, block_bytes=block_bytes), Tables(spark, "lm-scores")
    named = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    marked = docs.join(small(named), "doc_id", "left").withColumn("marked", F.coalesce("target", F.lit(False))).drop("target")
    # dealt by id and text, so that neither rows without id nor copies of a text meet in one block
    dealt = marked.withColumn("blk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = dealt.repartition(shuffle_partitions(spark), "blk").groupBy("blk")
    counts = by_block.applyInArrow(lambda rows: _count(blocks, rows), COUNTS)
    totals = tables.keep(counts.groupBy("part").applyInArrow(_merge, TOTALS), "totals")
    sums = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs_t", "docs_b", "words_t", "words_b", "vocabulary"))).first().asDict()
    whole = sums | {f"tokens_{k}": sums[f"words_{k}"] + sums[f"docs_{k}"] for k in "tb"}
    scored = by_block.cogroup(totals.groupBy("blk")).applyInArrow(lambda rows, back: _score(whole, prior, rows, back), SCORES)
    return scored.select("doc_id", (F.col("target_loss") - F.col("background_loss")).alias("score"), "target_loss", "background_loss", "n_tokens")
