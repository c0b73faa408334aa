"""Conversation repair against an exhaustive search over edits, whole and split into blocks."""

import hashlib
import random
import re
import zlib

import pytest

from seriesloom.llm.repair import Repair, damaged, repair_report, together, ways

#: Extra columns with the names that the operator uses inside.
SCHEMA = "conv_id long, turn long, role string, text string, idx int, block string, fault int, nth int, audit string"
GRAMMAR = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], SCHEMA)


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, lines) over all ways to edit with at most two inserts in a row; grammar is looked at in the end only."""
    marks, best = faults(rows), [(3 * len(rows), "D" * len(rows), [])]

    def go(i, inserts, cost, audit, lines):
        if cost > best[0][0]:
            return
        if i == len(rows) and GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
            best[0] = min(best[0], (cost, audit, lines))
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, inserts + 1, cost + 2, audit + "I", [*lines, (role, "")])
        if i < len(rows):
            (role, text), more = rows[i], int(marks[i] == "truncated")
            go(i + 1, 0, cost + 3, audit + "D", lines)
            if marks[i] not in ("blank", "duplicate"):
                go(i + 1, 0, cost + more, audit + "K", [*lines, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, 0, cost + 2 + more, audit + "R", [*lines, (other, text)])

    go(0, 0, 0, "", [])
    return best[0]


def expected(rows, after, search=exhaustive):
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in after if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = [r[1:] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        marks = faults(said)
        cost, audit, lines = search(said)
        pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), pairs, cost, audit, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases(seed=1, n=70, most=4):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rng.choice(["Yes.", "No!", "cut off", "Why? \t", "", " \n", "日本。", "\x85", None, f"{turn} is right.", "two\nlines."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_repair_equals_exhaustive_search(spark, block):
    rows = cases()
    assert found(repair_report(table(spark, rows), table(spark, rows), block)) == expected(rows, rows)


def test_damage_by_checksum(spark):
    rows = cases(2, 300, 3)
    after = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        after += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = damaged(table(spark, rows))
    assert found(got) == sorted(after, key=repr)
    assert found(repair_report(table(spark, rows), got)) == expected(rows, after)


def test_conversations_without_rows_and_no_table(spark):
    rows = [(5, 1, "user", "a.")]
    empty = hashlib.sha256(b"").hexdigest()
    assert found(repair_report(table(spark, rows), table(spark, []))) == [(5, 0, 0, 0, 0, 0, 0, "", empty)]
    assert found(repair_report(table(spark, []), table(spark, []))) == []


def test_long_conversations_are_repaired_block_by_block(spark):
    rng = random.Random(3)
    turns = [(9, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{i}.", f"{i}", "same.", "  "])) for i in range(700)] + [(9, None, "user", "long " * 20_000)]
    small, large = repair_report(table(spark, turns), table(spark, turns), 16), repair_report(table(spark, turns), table(spark, turns), 10_000)
    assert found(small) == found(large)
    done = Repair(table(spark, turns), 64)
    lines = sorted(map(tuple, done.repaired().collect()))
    assert GRAMMAR.fullmatch("".join(r[3][0] for r in lines))
    assert hashlib.sha256("\n".join(f"{r[3]}:{r[4]}" for r in lines).encode()).hexdigest() == found(large)[0][-1]


def test_blocks_together_are_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randint(1, 12))]
        [(_, _, cost, audit)] = ways(rows, (0,), True)
        size = rng.randint(1, 5)
        cuts = list(range(0, len(rows), size))
        blocks = [ways(rows[c : c + size], range(4), c == cuts[-1]) for c in cuts]
        got, way = together(blocks)
        assert (got, "".join(a for _, a in way)) == (cost, audit)
