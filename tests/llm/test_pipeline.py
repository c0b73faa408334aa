"""The pipeline's run() against a brute-force version, and each stage on odd rows."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from seriesloom.llm import mixing, queries
from seriesloom.llm.quality import THRESHOLD, quality_scores

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def without_near_copies(rows):
    """One row of each class, the least doc_id's; rows without words all stay."""
    sets, parent = [set(grams(r["text"])) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            key = (r["doc_id"] is None, r["doc_id"] or 0)
            best[find(i)] = min(best.get(find(i), (key, i)), (key, i))
    keep = {i for _, i in best.values()}
    return [r for i, r in enumerate(rows) if not sets[i] or i in keep]


def holds(text, items):
    """Whether any window of any item's length is 80 % alike in weighted shingles; every start is tried."""
    part = grams(text)
    for own in items:
        whole, n = collections.Counter(own), len(own)
        if not own or sum(g in whole for g in part) * 100 < 80 * n:
            continue
        for start in range(max(1, len(part) - int(0.8 * n) + 1)):
            window = collections.Counter(part[start : start + n])
            if 100 * sum((whole & window).values()) >= 80 * sum((whole | window).values()):
                return True
    return False


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs, labels, items = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    scores = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    good = [r for r in docs.collect() if scores[r["doc_id"]] >= THRESHOLD]
    own = [grams(r["text"]) for r in items.collect()]
    clean = [r for r in without_near_copies(good) if not holds(r["text"], own)]
    assert 0 < len(clean) < docs.count()
    # the draws of the mixture are hashes: the plan's own properties are tested with operator 1, here it is taken as it is
    plan = mixing.mix_plan(spark.createDataFrame(clean, docs.schema)).collect()
    times, text = collections.Counter(r["doc_id"] for r in plan), {r["doc_id"]: r["text"] for r in clean}
    encoder, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id in sorted(times):
        ids = [*encoder.encode(text[doc_id] or "", add_special_tokens=False).ids, 0]
        for _ in range(times[doc_id]):
            want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want


@pytest.fixture
def odd(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long), (4, long), (4, "another text of six words here"), (4, "another text of six words here"), (5, None), (5, None), (6, ""), (7, long + " x")]
    return spark.createDataFrame([(k, t, "en", "s", 0, 1.0, 2, 3, 4) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, times int, node long")


def test_near_duplicates_of_odd_rows(spark, odd):
    got = corpus_pipeline.near_duplicates(spark, odd, FOLDER)
    assert got.columns == odd.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in got.collect()) == [("4", "another"), ("4", "w0 w1 w"), ("5", ""), ("5", ""), ("6", "")]
    assert corpus_pipeline.near_duplicates(spark, odd.limit(0), FOLDER).count() == 0


def test_other_stages_keep_columns_and_take_empty_tables(spark, odd):
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        got = stage(spark, odd, FOLDER)
        assert got.columns == odd.columns and got.count() >= 0
        assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_a_contaminated_row_without_id_goes(spark, odd):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = odd.limit(1).withColumn("text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(f"before {item} after")).unionByName(odd)
    got = corpus_pipeline.decontaminate(spark, rows, FOLDER)
    assert got.count() == odd.count()
