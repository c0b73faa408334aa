"""The Merkle manifest against a plain recursion over all rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from seriesloom.llm.merkle import manifest, write_manifest

#: Extra columns with the names that the operator uses inside.
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, leaf string, nth int, at int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = [row[0], row[1], row[2], row[3], row[4]]
    if lower and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(top, for each node its siblings as (left, right) by level)."""
    paths, level, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for n, at in enumerate(own):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[n].append((run[: at % 8], run[at % 8 + 1 :]))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        own = [at // 8 for at in own]
    return level[0], paths


def brute_force(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    tops = {name: climb([leaf(r) for r in trees[name]]) for name in names}
    root, above = climb([tops[name][0] for name in names]) if names else ("", [])
    out = []
    for name, upper in zip(names, above, strict=True):
        subroot, paths = tops[name]
        for r, path in zip(trees[name], paths, strict=True):
            proof, node = path + upper, leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in proof:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), subroot, root, h(*(x for a, b in proof for x in a + b)), node, node == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    out = []
    for name, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", " ", "Aé日𝄞", "lower only", "X" * rng.randint(0, 30), "long " * 3000])
            out.append((rng.choice([None, rng.randint(-5, 400)]) if rng.random() < 0.1 else rng.randint(0, 10**6), rng.choice([None, "s", "t:1"]), name, rng.choice([None, 0, 12]), text))
    rng.shuffle(out)
    return out + out[:9]  # repeated rows


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


@pytest.mark.parametrize("height, most_top", [(5, 1 << 17), (1, 1 << 17), (1, 0), (2, 3)])
def test_manifest_equals_recursion(spark, height, most_top):
    rows = rows_of({None: 1, "": 9, "de": 64, "en": 150, "z日": 8, "é": 2})
    assert found(manifest(table(spark, rows), tampered(), height, most_top)) == brute_force(rows)


@pytest.mark.parametrize("most_top", [0, 1 << 17])
def test_many_trees(spark, most_top):
    rows = rows_of({f"t{i}": 1 + i % 3 for i in range(70)}, 2)
    assert found(manifest(table(spark, rows), tampered(), 1, most_top)) == brute_force(rows)


def test_one_row_and_no_rows(spark):
    row = (7, "s", "en", 3, "abc")
    got = manifest(table(spark, [row])).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got] == [(leaf(row),) * 3 + (h(), True)]
    assert manifest(table(spark, [])).count() == 0


def test_rows_that_are_all_the_same(spark, tmp_path):
    rows = [(1, None, None, None, None)] * 200
    got = found(write_manifest(table(spark, rows), f"file://{tmp_path}/manifest"))
    assert {r[6] for r in got} == {True} and sorted(r[:6] for r in got) == sorted((*r[:5], r[3]) for r in brute_force(rows))
