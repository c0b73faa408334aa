"""Brute-force versions, exact round trips, and the edge cases that every operator must take."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import elias_fano, fingerprints, html_text, mixing, queries, textkit
from seriesloom.llm.decontamination import contaminated
from seriesloom.llm.fingerprints import compare_with_next
from seriesloom.llm.jaccard_join import shingle_classes
from seriesloom.llm.lm_scores import cross_entropy_difference
from seriesloom.llm.quality import quality_scores
from seriesloom.llm.quotations import reply_order
from seriesloom.llm.token_counts import token_counts
from seriesloom.llm.token_files import Shard, read_token_shards, write_token_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string"
ODD = [None, "", " \n\t", "a", "one two", "A b c d e f", "a b c d e f", "don't  x'll ''s\r\n\n é　日本 \U0001d11e", "w " * 3000]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x") for i, t in enumerate(texts)], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_pretokens_equal_the_pattern():
    import public_tokenizers
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice(" \n\t'stmdrevl12é!$\xa0　日") for _ in range(rng.randint(0, 9))) for _ in range(5)]
        whole, points, offsets = textkit.code_points(pa.array(texts, pa.string()))
        cuts = [*textkit.pretoken_starts(points, offsets).tolist(), len(whole)]
        assert [whole[a:b] for a, b in itertools.pairwise(cuts)] == [m for t in texts for m in pattern.findall(t)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 900])
def test_elias_fano_round_trip(n):
    values = np.sort(np.random.default_rng(n).integers(0, 10**6, n))
    coded = elias_fano.EliasFano(elias_fano.encode(values))
    assert coded.slice(0, n).tolist() == values.tolist() and all(coded.select(i) == values[i] for i in range(0, n, 37))


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    morse = "".join("ab"[i.bit_count() % 2] for i in range(2048))  # runs that a polynomial modulo 2^64 can't tell apart
    texts = [*ODD, "a <|endoftext|> b", morse, morse.translate(str.maketrans("ab", "ba"))]
    folder = f"file://{tmp_path}/out"
    write_token_shards(table(spark, texts), folder, queries.tokenizer_path(), shards=3)
    got = sorted(read_token_shards(spark, folder).collect())
    encoder, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    for row, text in zip(got, texts, strict=True):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = Shard(f"{folder}/shard-000000.tok")
    assert shard.document(0).tolist() == [0]
    write_token_shards(table(spark, []), f"{folder}-none", queries.tokenizer_path())
    assert read_token_shards(spark, f"{folder}-none").count() == 0


@pytest.mark.parametrize("ids", [[-(2**63), -5, -5, 0, 2**63 - 1], [None, None, None], [None, 3, 3, 10**15], [7] * 20_000, list(range(0, 200_000, 3))])
def test_doc_ids_of_shards(spark, tmp_path, ids):
    docs = spark.createDataFrame([(k, None, 5) for k in ids], "doc_id long, text string, shard int")
    write_token_shards(docs, f"file://{tmp_path}/out", queries.tokenizer_path(), shards=1)
    shard = Shard(f"file://{tmp_path}/out/shard-000000.tok")
    assert shard.doc_ids(0, shard.n).to_pylist() == ids and shard.doc_ids(1, 3).to_pylist() == ids[1:3]


def test_shards_follow_bytes_and_rows_without_id_spread(spark, tmp_path):
    texts = [f"text number {i} " * 20 for i in range(200)]
    docs = spark.createDataFrame([(None if i % 3 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, `start` int")
    manifest = write_token_shards(docs, f"file://{tmp_path}/out", queries.tokenizer_path(), shard_bytes=4000).collect()
    assert len(manifest) > 10 and max(r["n_docs"] for r in manifest) < 60
    got = sorted(read_token_shards(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(keys) == 200
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [*ODD, "".join(rng.choice("abcdefgh ") for _ in range(4000))]
    docs = table(spark, texts)
    got = sorted(compare_with_next(docs.unionByName(docs.limit(0))).collect(), key=lambda r: -r["doc_id"])
    order = list(enumerate(texts))[::-1]
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (got[k]["doc_id"], got[k]["n_chars"], got[k]["edited_sha256"]) == (key, len(text), hashlib.sha256(edited.encode()).hexdigest())
    a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    one, moved, other = fingerprints.fingerprints([a, "xyz" + a, "".join(rng.choice("ijklmnop ") for _ in range(4000))])
    assert fingerprints.likeness(one, moved) > 0.8 and fingerprints.likeness(one, other) < 0.1
    assert compare_with_next(table(spark, [])).count() == 0


def plain_labels(x):
    """Labels of a stretch without equal neighbours: the lowest bit that differs from the left one, with its value, four times."""
    for _ in range(4):
        left = [x[0] ^ 1, *x[:-1]]
        bit = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(x, left)]
        x = [2 * b + (a >> b & 1) for a, b in zip(x, bit)]
    return x


def plain_phrases(symbols):
    out = []
    for same, stretch in itertools.groupby(_stretches(symbols), key=lambda s: s[0]):
        for _, x in stretch:
            if same:
                out += [tuple(x[i : i + 2]) for i in range(0, len(x), 2)]
                continue
            l = [*plain_labels(x), 0]
            cuts = [0, *(i for i in range(2, len(x)) if l[i] > l[i - 1] and l[i] >= l[i + 1]), len(x)]
            out += [tuple(x[a:b]) for a, b in itertools.pairwise(cuts)]
    return out


def _stretches(symbols):
    """(whether it is a run of equal symbols, symbols) in order."""
    single = []
    for _, run in itertools.groupby(symbols):
        run = list(run)
        if len(run) == 1:
            single += run
            continue
        if single:
            yield False, single
            single = []
        yield True, run
    if single:
        yield False, single


def test_parse_equals_a_plain_one_up_to_the_top():
    rng = random.Random(5)
    texts = ["", "a", "aa", "aaa", "ab", "abab" * 20, *("".join(rng.choice(kind) for _ in range(rng.randint(2, 400))) for kind in ("ab", "abcdefgh ", "aaaab", "日本é\U0001d11e x") for _ in range(8))]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    symbols, at = textkit.point_values()[points], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    names = {}  # one name for each phrase in all texts
    for _ in range(12):
        want = [plain_phrases([int(v) for v in symbols[a:b]]) for a, b in itertools.pairwise(at)]
        before = np.diff(at)
        symbols, at = fingerprints.parse_round(symbols, at)
        got = [symbols[a:b].tolist() for a, b in itertools.pairwise(at)]
        assert [len(x) for x in got] == [len(x) for x in want]
        for phrase, name in zip(itertools.chain(*want), itertools.chain(*got)):
            assert names.setdefault(phrase, name) == name
        assert (np.diff(at) < np.maximum(before, 2)).all()
    assert len(set(names.values())) == len(names) and np.diff(at).max() == 1


def test_likeness_is_within_its_error(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in itertools.pairwise(texts)]
    both = "".join(texts + edited)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts + edited])]).astype(np.int64)
    points = np.frombuffer(both.encode("utf-32-le"), np.uint32)
    whole, sketches = fingerprints.phrase_sets(points, at, 10**9), fingerprints.phrase_sets(points, at)
    assert max(map(len, whole)) > 4 * fingerprints.KEPT
    errors = []
    for i in range(len(edited)):
        a, b = set(whole[i].tolist()), set(whole[len(texts) + i].tolist())
        exact = len(a & b) / len(a | b) if a and b else float(a == b)
        got = fingerprints.likeness(sketches[i], sketches[len(texts) + i])
        assert len(a | b) > fingerprints.KEPT or got == exact
        errors.append(got - exact)
    assert np.sqrt(np.mean(np.square(errors))) <= fingerprints.ERROR and np.abs(errors).max() <= 4 * fingerprints.ERROR


def test_fingerprints_of_odd_rows(spark):
    long = "a long text of some words " * 8000
    rows = [(None, long), (None, long), (3, "x"), (3, "x"), (3, None), (None, None)]
    docs = spark.createDataFrame([(k, t, 1, 2, "f") for k, t in rows], "doc_id long, text string, part int, border int, fingerprint string")
    got = compare_with_next(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((k, len(t or "")) for k, t in rows)
    assert len({r["fingerprint"] for r in got}) == 3


def test_jaccard_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = list(ODD)
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 120]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(40)]
    # near copies at the threshold: far from one another, but some links run through others
    base = rng.choices(vocabulary, k=90)
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy[: rng.randint(80, 90)]))
    # words that a polynomial modulo 2^64 can't tell apart
    morse = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    texts += [f"x y {morse} z w", f"x y {morse.translate(str.maketrans('ab', 'ba'))} z w"]
    sets = [set(grams(t)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_classes(table(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_classes_of_odd_rows(spark):
    text, other = "a b c d e f g h", "q r s t u v"
    rows = [(None, text), (None, text), (5, text), (5, text), (5, other), (9, other), (3, None), (3, text), (7, "")]
    docs = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in rows], "doc_id long, text string, node long, component long, rows long, sig long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_classes(docs).collect()), key=str)
    assert got == sorted([(None, 4, None), (None, 4, None), (5, 4, 3), (5, 4, 3), (5, 2, 5), (9, 2, 5), (3, 0, 3), (3, 4, 3), (7, 0, 7)], key=str)
    assert shingle_classes(docs.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [" ".join(rng.choices([f"w{i}" for i in range(200)], k=rng.randint(3, 40))) for _ in range(12)] + [None, ""]
    texts = [*ODD, *(" ".join(rng.choices(["a", "b", "c"], k=20)) + " " + (rng.choice(items) or "").upper() + " tail" for _ in range(30))]
    cut = items[0].split()
    texts += [" ".join(cut[:-1] + ["changed", "x"])]
    want = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        own, part = grams(item), grams(text)
        for start in {max(0, p - j) for p, g in enumerate(part) for j, h in enumerate(own) if g == h}:
            a, b = collections.Counter(own), collections.Counter(part[start : start + len(own)])
            similarity = sum((a & b).values()) / sum((a | b).values())
            if similarity >= 0.8:
                want[d, i] = max(want.get((d, i), (0, 0)), (similarity, -start))
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start"]) for r in contaminated(table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_decontamination_slides_over_all_starts(spark):
    rng = random.Random(16)
    item = [f"q{i}" for i in range(59)]
    around = [f"z{i}" for i in range(80)]
    swapped = item[29:] + item[:29]
    edited = ["x1", *item[1:30], "x2", "x3", *item[30:-1], "x4"]
    texts = [around[:40] + swapped + around[40:], around[:40] + edited + around[40:], around + item[11:], item[11:] + around, around + item[:-11], item[:20] + around + item[20:]]
    for _ in range(30):
        copy = list(item)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = rng.choices(around, k=rng.randint(0, 2))
        at = rng.randrange(len(copy))
        texts.append(around[: rng.randint(0, 80)] + (copy[at:] + copy[:at] if rng.random() < 0.4 else copy) + around[: rng.choice([0, 1, 30])])
    texts, own, want = [" ".join(t) for t in texts], collections.Counter(grams(" ".join(item))), {}
    n = sum(own.values())

    def similarity(part, start):
        b = collections.Counter(part[start : start + n])
        return sum((own & b).values()) / sum((own | b).values())

    for d, text in enumerate(texts):
        best = max(similarity(grams(text), start) for start in range(len(grams(text))))
        if best >= 0.8:
            want[d] = best
    assert {0, 1, 2} <= want.keys() and 5 not in want
    got = {r["doc_id"]: r for r in contaminated(table(spark, texts), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert all(got[d]["similarity"] == pytest.approx(want[d]) == similarity(grams(texts[d]), got[d]["start"]) for d in want)


def test_quality_separates_and_takes_odd_rows(spark):
    rng = random.Random(7)
    good = [" ".join(rng.choices(["the", "river", "runs", "past", "old", "mills"], k=rng.randint(20, 80))) + "." for _ in range(120)]
    bad = [" ".join(f"{rng.choice('abc')}$$$ ***" for _ in range(rng.randint(20, 80))) for _ in range(60)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == 180 + len(ODD) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(got[i]["predicted"] == int(i < 120) for i in range(180) if got[i]["held_out"])
    assert quality_scores(table(spark, ["x"]), labels.limit(0)).first()["score"] == 0.5


def test_discriminant_equals_plain_densities(spark):
    from seriesloom.llm import quality

    d, rng = len(quality.STATISTICS), np.random.default_rng(3)
    x, y = rng.normal(size=(120, d)) @ rng.normal(size=(d, d)) / 4, np.arange(120) % 3 == 0
    x[y] += 0.3
    rows = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, label int")
    got, density = quality.fit(rows).score(x), []
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = ((~y).mean() * own[0] + y.mean() * own[1])
    for k in (0, 1):
        c = (1 - quality.POOL) * own[k] + quality.POOL * pooled
        c = (1 - quality.IDENTITY) * c + quality.IDENTITY * np.diag(np.diag(c)) + quality.FLOOR * np.eye(d)
        m = x - x[y == k].mean(axis=0)
        density.append(np.log((y == k).mean()) - np.linalg.slogdet(c)[1] / 2 - np.einsum("ij,jk,ik->i", m, np.linalg.inv(c), m) / 2)
    assert got == pytest.approx(1 / (1 + np.exp(density[0] - density[1])), abs=1e-9)


def test_html_by_hand():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>menu</a></nav><div id="main"><div class="cookie-notice">We use cookies</div>
    <div class="post-body"><h2>T &amp; x</h2><p>One, two, three,  long text here with words, and more.<p>Second&nbsp;para <a href=x>link</a> end<ul><li>item one<li>item two</ul><div class="ad">Buy</div>
    <script>var t="</p>";</script></div><div id="comments"><p>Nice post, I like it, a lot.</p></div></div><aside>side</aside><form>f</form><footer>foot</footer>"""
    assert html_text.main_text(page) == "T & x\nOne, two, three, long text here with words, and more.\nSecond para link end\nitem one\nitem two"
    assert [html_text.main_text(x) for x in (None, "", "plain  text", "<p>", "<", "<!-- a")] == ["", "", "plain text", "", "<", ""]


def test_html_keeps_short_parts_beside_a_long_one():
    paragraph = lambda name: f"{name} " + "word, " * 4 + "w" * 270
    p = lambda names: "".join(f"<p>{paragraph(x)}</p>" for x in names)
    long, one, two = [f"a{i}" for i in range(60)], ["b0", "b1"], ["c0", "c1"]
    want = "\n".join(["Title", *(paragraph(x) for x in [*long, "note", *one, *two])])
    around = lambda x: f"<html><body><nav><a href=x>menu</a></nav>{x}<div><a href=y>other</a></div><footer>foot</footer></body></html>"
    parts = f"<h1>Title</h1><section>{p(long)}</section><h2>{paragraph('note')}</h2><section>{p(one)}</section><section>{p(two)}</section>"
    for page in (f"<article>{parts}<div class=ad>Buy</div></article>", f"<main><div>{parts}</div></main>", f"<div class=page>{parts}</div>"):
        assert html_text.main_text(around(page)) == want
    for tag, item in (("blockquote", "p"), ("ul", "li")):
        rows = "".join(f"<{item}>{paragraph(x)}</{item}>" for x in long)
        assert html_text.main_text(around(f"<article><h1>Title</h1><{tag}>{rows}</{tag}><h2>Short</h2><p>End.</p></article>")) == "\n".join(["Title", *(paragraph(x) for x in long), "Short", "End."])


def test_quotes_of_parts(spark):
    said = {0: "a\nb\nc\nd", 1: "P1 is\nwrapped\n\nP2 too\n\nP3", 2: "other\n\nwords"}
    replies = ["> a\n> b\nanswer", "> b\n> c\nanswer", "> a\n> d\nanswer", "> P2 too\n>\n> P3\nanswer", "> P1 is wrapped\n>\n> unknown\nanswer", "> d\n> a\nanswer", "> P1\n> is wrapped\nanswer"]
    want = [0, 0, 0, 1, 1, 2, 1]
    rows = [(c, t, "user", said[t]) for c in range(len(replies)) for t in said] + [(c, 3, "user", x) for c, x in enumerate(replies)]
    got = {(r["conv_id"], r["turn"]): r for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert [got[c, 3]["reply_to"] for c in range(len(replies))] == want
    assert all(got[c, 3]["text"] == "answer" and got[c, 3]["quoted"] == 1 for c in range(len(replies)))


def test_depths_of_long_and_short_chains(spark):
    rows = [(1, t, "user", f"x{t}") for t in range(37)] + [(2, 0, "user", "y"), (3, 0, "user", "z"), (3, 4, "user", "z")]
    got = {(r["conv_id"], r["turn"]): r["depth"] for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {**{(1, t): t for t in range(37)}, (2, 0): 0, (3, 0): 0, (3, 4): 1}


def test_messages_of_one_turn_all_stay(spark):
    rows = [(1, 0, "a", "q one"), (2, 0, "u", "first"), (2, 0, "u", "second"), (2, 1, "u", "> first\nso"), (2, 1, "u", "> first\nso"), (2, 2, None, "> second")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, own_turn int, replied int")
    got = sorted(((r["conv_id"], r["turn"], r["text"], r["reply_to"]) for r in reply_order(docs).collect()), key=str)
    assert got == sorted([(1, 0, "q one", None), (2, 0, "first", None), (2, 0, "second", 0), (2, 1, "so", 0), (2, 1, "so", 0), (2, 2, "", 0)], key=str)
    assert reply_order(docs.limit(0)).count() == 0


def test_deep_and_stray_tags_take_linear_time():
    import time

    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    for make in (lambda n: "<div>" * n + "word, " * 40 + "</div>" * n, lambda n: "<div>" * n + "<p>some words, here</p></q>" * n, lambda n: "<b>" * n + "x<hr>" * n):
        assert took(make(12000)) < 8 * took(make(3000)) + 0.2


def test_replies_and_quotes(spark):
    rows = [(1, 0, "user", "Hello  there\nHow are you?"), (1, 1, "assistant", "Fine."), (1, 2, "user", "> hello there\n> How are you?\nStill asking."), (1, 3, "assistant", "> > HELLO there\n> Still asking.\nOk\n> unknown"), (2, 0, None, None), (None, 0, "user", "x")]
    got = {(r["conv_id"], r["turn"]): r for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 5
    assert [got[1, t]["reply_to"] for t in range(4)] == [None, 0, 0, 2] and [got[1, t]["depth"] for t in range(4)] == [0, 1, 1, 2]
    assert got[1, 2]["text"] == "Still asking." and got[1, 3]["text"] == "Ok" and got[2, 0]["text"] == ""


def test_token_counts_equal_plain_segmentation(spark):
    import public_tokenizers

    from seriesloom.llm.token_counts import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, longest, byte = pieces(path)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * byte, -best[end - 1][1] - n)]
            options += [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    texts = ["understanding", "unbelievable", "日本é", "zzzqqq", "aaaaaaaaaaaa", "the"]
    got = [r["n_tokens"] for r in sorted(token_counts(table(spark, texts), path).collect())]
    assert got == [plain(t) for t in texts]


def test_mixing(spark):
    tokens = np.array([1000.0, 100.0, 10.0])
    a = mixing.temperature(tokens, 1110, 0.95, 100.0)
    assert mixing.entropy(mixing.weights_of(tokens / tokens.sum(), a)) == pytest.approx(0.95 * np.log(3), abs=1e-6)
    b = mixing.temperature(tokens, 1110, 0.95, 2.0)
    assert (mixing.weights_of(tokens / tokens.sum(), b) * 1110 / tokens).max() == pytest.approx(2.0, abs=1e-6)
    assert mixing.budgets(tokens, 1111, b).sum() == 1111
    texts = ["w " * (1 + i % 7) for i in range(300)] + ODD
    docs = table(spark, texts)
    rows = mixing.mix_plan(docs, block_tokens=20).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(len(words(t)) for t in texts)
    own = collections.Counter()
    for i, t in enumerate(texts):
        own[f"s{i % 3}" if i % 5 else None] += len(words(t))
    order = sorted(own, key=lambda s: (s is not None, s))
    sizes = np.array([own[s] for s in order], float)
    wanted = dict(zip(order, mixing.budgets(sizes, total, mixing.temperature(sizes, total, 0.95, 4.0)), strict=True))
    for s, taken in by.items():
        n = sum(r["n_tokens"] for r in taken)
        assert wanted[s] <= n < wanted[s] + max(r["n_tokens"] for r in taken)
        assert len({(r["doc_id"], r["epoch"]) for r in taken}) == len(taken)
    assert mixing.mixture(docs, block_tokens=20).count() == len(rows) and mixing.mix_plan(table(spark, [])).count() == 0


def test_plan_equals_brute_force(spark):
    """Blocks, their permutations and places anew, from the hashes of rows: epochs laid end to end up to the budget."""
    from pyspark.sql import functions as F

    docs = table(spark, ["w " * (1 + i % 7) for i in range(200)] + ["the same words"] * 60)
    same = spark.createDataFrame([(7, "the same row", "en", "s0", 0, "x")] * 90, SCHEMA)
    docs, seed, size, budget = docs.unionByName(same), 17, 40, 3000
    rows = docs.select("doc_id", "source", mixing.row_hash(docs).alias("row"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n")).collect()
    number, seen = [], collections.Counter()
    for r in rows:
        number.append((r["doc_id"], r["source"], r["row"], r["n"], seen[r["row"]]))
        seen[r["row"]] += 1
    kind = "doc_id long, source string, row struct<a: long, b: long>, n long, copy long"
    hashed = spark.createDataFrame(number, kind).select("*", F.xxhash64(F.lit(seed), "doc_id", "row", "copy").alias("deal"), F.xxhash64(F.lit(seed + 1), "doc_id", "row", "copy").alias("order")).collect()
    own = collections.Counter()
    for r in rows:
        own[r["source"]] += r["n"]
    order = sorted(own, key=lambda s: (s is not None, s))
    sizes = np.array([own[s] for s in order], float)
    wanted = dict(zip(order, mixing.budgets(sizes, budget, mixing.temperature(sizes, budget, 0.95, 4.0)).tolist(), strict=True))
    lots = [(s, e, b) for s in order for e in range(wanted[s] // own[s] + 1) for b in range(-(-own[s] // size))]
    lot = {tuple(r)[:3]: r["lot"] for r in spark.createDataFrame(lots, "source string, epoch long, block long").select("*", F.xxhash64(F.lit(seed + 2), "source", "epoch", "block").alias("lot")).collect()}
    want = []
    for s in order:
        inside = collections.defaultdict(list)
        for r in hashed:
            if r["source"] == s:
                inside[r["deal"] % -(-own[s] // size)].append(r)
        at = 0
        for e in range(wanted[s] // own[s] + 1):
            for b in sorted(inside, key=lambda b: (lot[s, e, b], b)):
                for r in sorted(inside[b], key=lambda r: (r["order"], r["doc_id"], r["row"], r["copy"])):
                    if at < wanted[s]:
                        want.append((s or "", e, b, at / wanted[s], r["doc_id"], r["n"]))
                    at += r["n"]
    got = [(r["source"] or "", r["epoch"], r["block"], r["place"], r["doc_id"], r["n_tokens"]) for r in mixing.mix_plan(docs, budget=budget, block_tokens=size).collect()]
    assert sorted(got) == sorted(want) and max(e for _, e, *_ in got) > 0
    assert len({b for s, _, b, _, k, _ in got if k == 7}) > 3


@pytest.mark.parametrize("together", [1, 2, 10])
def test_copies_are_numbered_in_chunks(spark, monkeypatch, together):
    monkeypatch.setattr(mixing, "COPIES", together)
    rows = spark.createDataFrame([(k, (k, 1)) for k in (1, 1, 1, 1, 1, 2, 3, 3, None, None)], "doc_id long, row struct<a: long, b: long>")
    got = sorted((str(r["doc_id"]), r["copy"]) for r in mixing.numbered(rows).collect())
    assert got == [*(("1", i) for i in range(5)), ("2", 0), ("3", 0), ("3", 1), ("None", 0), ("None", 1)]


def test_mixture_takes_maps_and_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s", {"k": 1}, 5, [{"k": None}]), (1, "a b", "s", {"k": 2}, 5, [{"k": None}]), (2, "c", None, None, 6, None)], "doc_id long, text string, source string, `plan.row` map<string, int>, `a``b` int, doc array<map<string, int>>")
    got = mixing.mixture(docs, budget=50)
    plan = collections.Counter(r["doc_id"] for r in mixing.mix_plan(docs, budget=50).collect())
    assert got.columns == docs.columns and collections.Counter(r["doc_id"] for r in got.collect()) == plan
    assert {str(r["plan.row"]) for r in got.collect()} == {"{'k': 1}", "{'k': 2}", "None"}


def test_mixture_is_the_plan_row_for_row(spark):
    rows = [(1, "a b c", "s", 7), (1, "a b c", "t", 7), (1, "a b c", "t", 7), (1, "a b c", "t", 8), (None, "d e", None, 9), (2, None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `times` int").withColumnsRenamed({}).selectExpr("*", "1 as rows", "2 as copies", "3 as row", "4 as s", "5 as block")
    plan = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix_plan(docs, budget=40).collect())
    got = mixing.mixture(docs, budget=40)
    assert got.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["source"]) for r in got.collect()) == plan and plan


def plain_language_models(rows, targets, prior):
    """Losses by dictionaries: for each document the two models are counted anew without it."""
    tokens = [[None, *re.findall(r"[^\x20\x09-\x0D]+", text or ""), "\n"] for _, text in rows]
    marked = [k in targets for k, _ in rows]
    vocabulary = len({w for t in tokens for w in t[1:]} | {"\n"})
    size = {side: sum(len(t) - 1 for t, m in zip(tokens, marked) if m == side) for side in (True, False)}
    out = []
    for i, t in enumerate(tokens):
        found = []
        for side in (True, False):
            scale = size[True] / size[False] if side is False and size[True] and size[False] else 1.0
            one, two, before = collections.Counter(), collections.Counter(), collections.Counter()
            for j, other in enumerate(tokens):
                if j != i and marked[j] == side:
                    one.update(other[1:])
                    two.update(itertools.pairwise(other))
                    before.update(other[:-1])
            total, loss = sum(one.values()), 0.0
            for a, b in itertools.pairwise(t):
                low = (scale * one[b] + prior / vocabulary) / (scale * total + prior)
                loss -= np.log((scale * two[a, b] + prior * low) / (scale * before[a] + prior))
            found.append(loss / (len(t) - 1))
        out.append((*found, len(t) - 1))
    return out


@pytest.mark.parametrize("targets", [{5, 9, 30}, set(), set(range(100))])
def test_language_models_equal_plain_counts(spark, targets):
    rng = random.Random(4)
    texts = [*ODD, "some other text", "some other text", "é 日本 é", *(" ".join(rng.choice("abcdeABé") for _ in range(rng.randint(0, 40))) for _ in range(40)), "long " * 20_000]
    rows = [*enumerate(texts), (None, "a b"), (None, None), (5, "x y"), (5, "x y")]
    docs = spark.createDataFrame([(k, t, 1.0, 2) for k, t in rows], "doc_id long, text string, score double, blk int")
    ids = spark.createDataFrame([(k,) for k in targets], "doc_id long")
    # a small block size makes several blocks and ranges of keys
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["target_loss"], r["background_loss"], r["score"]) for r in cross_entropy_difference(docs, ids, block_bytes=9000).collect())
    want = sorted((k is None, k or 0, n, t, b, t - b) for (k, _), (t, b, n) in zip(rows, plain_language_models(rows, targets, 4.0)))
    assert len(got) == len(want) and all(g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-9) for g, w in zip(got, want))


def test_language_models_of_empty_tables(spark):
    docs = table(spark, ODD)
    assert cross_entropy_difference(docs.limit(0), docs.select("doc_id")).collect() == []


def test_token_counts_of_odd_texts(spark):
    docs = table(spark, [*ODD, "some other text", "some other text"])
    import public_tokenizers

    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert counted[0] == counted[1] == 0 and counted[3] == 1 and counted[9] == counted[10]


def _plain_replies(rows):
    """Origins of quotes by the docstring of quotations, message by message, for conversations of well-formed quotes; {(conv, turn): replied turn}."""
    fold = lambda text: " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), text).split())
    replied = {}
    for conv in {r[0] for r in rows}:
        told = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = []  # per message: names of all it says, its lines
        for i, (_, turn, _, text) in enumerate(told):
            passages = [[level, [re.sub("^(?:[ ]*>)+[ ]?", "", x) for x in group]] for level, group in itertools.groupby(text.split("\n"), lambda x: re.match("(?:[ ]*>)*", x)[0].count(">"))]
            origin = None
            for level, group in sorted(((level, group) for level, group in passages if level), key=lambda x: x[0]):
                lines = [fold(x) for x in group if fold(x)]
                whole = [k for k in range(i) if " ".join(lines) in said[k][0] or len(lines) > 1 and any(" ".join(said[k][1][a : a + len(lines)]) == " ".join(lines) for a in range(len(said[k][1]) - len(lines) + 1))]

                def in_order(k):
                    rest = iter(said[k][1])
                    return all(x in rest for x in lines)

                apart = [k for k in range(i) if in_order(k)] if len(lines) > 1 and not whole else []
                pieces = [fold(x) for x in re.split("\n(?: *\n)+", "\n".join(group))]
                by_piece = [max(ks) for x in pieces if x and len(pieces) > 1 and (ks := [k for k in range(i) if x in said[k][0]])]
                if whole or apart or by_piece:
                    origin = max(whole) if whole else max(apart) if apart else by_piece[0]
                    break
            replied[conv, turn] = told[origin][1] if origin is not None else told[i - 1][1] if i else None
            own = [group for level, group in passages if not level]
            body = "\n".join(x for g in own for x in g).strip(" ")
            names = {fold(body), *(fold("\n".join(g)) for g in own), *(fold(x) for g in own for x in g), *(fold(x) for x in re.split("\n(?: *\n)+", body))} - {""}
            said.append((names, [fold(x) for x in body.split("\n") if fold(x)]))
    return replied


def test_quotes_equal_a_plain_linker(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["a", "b", "C", "dd"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for conv in range(60):
        texts = []
        for turn in range(rng.randrange(2, 9)):
            out = []
            for _ in range(rng.randrange(3)):
                if texts and rng.random() < 0.8:
                    source = rng.choice(texts).split("\n")
                    a, n = rng.randrange(len(source)), rng.randrange(1, 5)
                    out += ["> " + x for x in source[a : a + n]] + [rng.choice(["", line()])]
            text = "\n".join([*out, *(rng.choice([line(), line(), line(), ""]) for _ in range(rng.randrange(1, 8)))])
            texts.append(text)
            rows.append((conv, turn, "user", text))
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == _plain_replies(rows)


def test_long_messages_of_many_lines(spark):
    lines = [f"line {i} of {i % 7}" for i in range(16000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "none"), (1, 2, "user", "\n".join("> " + x for x in lines[3000:11000]) + "\nwell")]
    got = {r["turn"]: (r["reply_to"], r["text"]) for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn > 0").collect()}
    assert got == {1: (0, "none"), 2: (0, "well")}


def test_decontamination_index_finds_similar_windows(spark):
    """Recall of the Hamming index over windows of a similarity of 0.8 or more, for items of 6 to 90 shingles."""
    from seriesloom.llm import decontamination as d

    rng = random.Random(9)
    pairs = []
    for i in range(400):
        item = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(10, 95))]
        window = list(item)
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.choice([0, 1, 2, len(item) - 1, rng.randrange(len(item))])
            window[at] = f"x{rng.randrange(4000)}"
        pairs.append((i, item, window))
    weights = [{k: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for k, w in (("a", a), ("b", b))} for _, a, b in pairs]
    alike = {i for i, w in enumerate(weights) if sum((w["a"] & w["b"]).values()) >= 0.8 * sum((w["a"] | w["b"]).values())}
    rows = [(i, side, " ".join(x)) for i, a, b in pairs for side, x in (("a", a), ("b", b))]
    grams = d._with_shingles(spark.createDataFrame(rows, "item_id long, side string, text string"), ["item_id", "side"], d.GRAM)
    weighted = grams.selectExpr("item_id", "side", "explode(grams) as g").groupBy("item_id", "side", "g").count().withColumnRenamed("count", "w")
    prints = d._in_blocks(d._simhash(weighted, ["item_id", "side"]), "print", d.RADIUS)
    a, b = (prints.where(f"side = '{s}'").selectExpr("item_id", "block", "value", f"print as {s}") for s in "ab")
    met = a.join(b, ["item_id", "block", "value"]).where(f"bit_count(a ^ b) <= {d.RADIUS}")
    found = {r["item_id"] for r in met.select("item_id").distinct().collect()}
    assert len(alike) > 100 and len(alike & found) >= 0.99 * len(alike)
