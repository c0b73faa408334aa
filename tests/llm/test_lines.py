"""Line deduplication against a brute-force version, and its edge cases."""

import random
import string

import pytest

from seriesloom.llm.common import Tables
from seriesloom.llm.line_dedup import apply_bitmaps, deduplicated_lines, keep_bitmaps

#: Extra columns with the names that the operator uses inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h1 string, pos int, bucket int, flips string, kept string"
SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(key, text, "en", "s", 0, 1, "x", 2, 3, "y", "z") for key, text in rows], SCHEMA)


def key_of(line):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in line.strip(SPACES))


def brute_force(rows, least_chars=40, least_docs=5):
    held = {}
    for n, (doc, text) in enumerate(rows):
        for k in {key_of(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append((n, doc))
    rank = lambda d: (d is not None, d or 0)
    losing = {k: max((d for _, d in v), key=rank) for k, v in held.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in losing or losing[key_of(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases():
    rng = random.Random(7)
    long = [f"{c} common line number {i} that is quite long, as it has to be" for i, c in enumerate("ABCDÉ日xyz")]
    short = ["", " ", "\t", "short", "x" * 39, " " + "y" * 38 + " ", " " + "z" * 39, "𝄞" * 40]
    one = lambda x: rng.choice((x, x.upper(), f" \t{x}\r", x.lower()))
    rows = [(i, "\n".join(one(rng.choice(long + short)) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(None, long[0]), (None, None), (3, long[1] + "\n" + long[1]), (90, None), (91, ""), (92, "\n"), (93, "\n".join(long * 400))]
    rows += [(100, long[2] + "\nown")] * 7 + [(None, "all documents hold no doc_id here, but forty code points")] * 5
    return rows


def test_lines_equal_brute_force(spark):
    rows = cases()
    assert found(deduplicated_lines(table(spark, rows))) == brute_force(rows)
    assert found(deduplicated_lines(table(spark, rows), 3, 2)) == brute_force(rows, 3, 2)


def test_keys_of_one_length_below_and_at_the_bounds(spark):
    rows = [(i, "a" * 40 + "\n" + "b" * 39) for i in range(5)] + [(i, "c" * 40) for i in range(5, 9)]
    got = found(deduplicated_lines(table(spark, rows)))
    assert got == brute_force(rows) and [r[2] for r in got if r[0] < 4] == [1, 1, 1, 1] and [r[2] for r in got if r[0] >= 4] == [0] * 5


def test_no_rows_and_no_losing_lines(spark):
    assert found(deduplicated_lines(table(spark, []))) == []
    assert found(deduplicated_lines(table(spark, [(1, "x\ny"), (2, None)]))) == [(1, 2, 0, "x\ny"), (2, 1, 0, "")]


def test_bitmaps_hold_places_where_the_bit_changes(spark):
    line, other = "k" * 50, "l" * 60
    rows = [(i, "\n".join([line, line, "own", other, line])) for i in range(5)]
    got = {r["doc_id"]: (r["flips"], r["n_dropped"]) for r in keep_bitmaps(table(spark, rows)).collect()}
    assert got == {i: ([0, 2, 3, 5], 4) for i in range(4)}


@pytest.mark.parametrize("bound", [0, 1 << 40])
def test_results_do_not_depend_on_what_is_broadcast(spark, monkeypatch, bound):
    from seriesloom.llm import common, line_dedup

    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    rows = cases()
    docs = table(spark, rows)
    got = apply_bitmaps(docs, keep_bitmaps(docs, tables=Tables(spark, "test")))
    assert found(got) == brute_force(rows)
