"""Operator 7 on pages built from known main texts and known surroundings."""

import random
import time

import pytest

from seriesloom.llm.html_text import extract, main_text

TEXT = " ".join(["Some long, running text, with commas,"] * 6)
P = f"<p>{TEXT}</p>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f'<div class="page-with-sidebar"><article>{P}</article></div>', [TEXT]),
        (f"<form id=f><article>{P}</article><label>Name</label></form>", [TEXT]),
        (f"<form id=f><div><h1>Head</h1>{P}</div></form><footer>foot</footer>", ["Head", TEXT]),
        *((f"<article>{P}<section {name}>{P}</section></article>", [TEXT, TEXT]) for name in ('id="related-work"', 'class="search-results"', 'class="ad-hoc"', 'class="social-studies"', "class=notice-of-law", 'id="discussion"')),
        *((f"<article>{P}<div {name}>{P}</div></article>", [TEXT]) for name in ('class="x ad"', "id=cookieNotice", "class='related-posts'", "role=navigation", "hidden", 'style="color:red; display : none"', "class=comment-list")),
        ('<article><p>One</p><div class="tools-share"><a href=x>Tell all</a> <a href=y>Others</a></div></article>', ["One"]),
        ("<p data-x=it's>Text</p><p>it's here</p>", ["Text", "it's here"]),
        ('<p title="a > b" data-y=\'</p>\'>Text</p>', ["Text"]),
        (f"<article><p>{TEXT} is <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here</p></article>", [TEXT + " is x=1 here"]),
        (f"<article>{P}</article><section class=discussion>{P}</section>", [TEXT]),
        (f"<main><article>{P}</article><section id=discussion>{P}</section></main>", [TEXT]),
        (f"<div class=post>{P}</div><div id=discussion>{P}{P}</div>", [TEXT]),
        (f"<div class=post>{P}</div><div id=comments><article>{P}{P}</article></div>", [TEXT]),
        (f"<div class=thread>{P}</div>", [TEXT]),
        (f"<aside><article><p>teaser</p></article></aside><div>{P}</div>", [TEXT]),
        ("<p>a <a <b", ["a <a <b"]),
        ("<!-->Text<!--x--!> more", ["Text more"]),
    ],
)
def test_marks_and_attributes(page, blocks):
    assert main_text(page) == "\n".join(blocks)


def test_generated_pages_give_their_articles():
    """Blocks of an article, between any number of surroundings inside and outside of it, in containers of four kinds."""
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum,", "dolor", "sit", "amet,"]) for _ in range(n)).strip(",")
    noise = [
        lambda: f'<nav class="c{rng.random()}"><ul><li><a href=/{words(1)}>{words(2)}</a></ul></nav>',
        lambda: f'<div class="ad slot-{rng.randrange(9)}">{words(20)}</div>',
        lambda: f"<aside><p>{words(30)}</p></aside>",
        lambda: f"<form action=x><p>{words(5)}</p><input value='{words(3)}'></form>",
        lambda: f"<script>var x='<p>{words(9)}</p>';</script><!-- {words(5)} -->",
        lambda: f'<section id="comments"><p>{words(60)}</p></section>',
    ]
    for _ in range(200):
        blocks, body = [], []
        for _ in range(rng.randrange(1, 9)):
            blocks.append(words(rng.randrange(3, 80)))
            tag = rng.choice(["p", "h2", "blockquote", "pre"])
            body.append(f"<{tag}>{blocks[-1].replace(' ', rng.choice([' ', '  ', chr(10)]))}</{tag}>")
            if rng.random() < 0.3:
                body.append(rng.choice(noise)())
        inner = "".join(body)
        held = rng.choice(["<article>{}</article>", "<main class=page-with-sidebar>{}</main>", '<div class="post-body">{}</div>', "<form><article id='x>y'>{}</article></form>"]).format(inner)
        around = [rng.choice(noise)() for _ in range(rng.randrange(4))]
        page = f"<html><head><title>{words(4)}</title></head><body><header>{words(5)}</header>{''.join(around)}{held}{''.join(around)}<footer>{words(9)}</footer></body></html>"
        assert main_text(page) == "\n".join(blocks), page


def test_attributes_take_linear_time():
    def took(page):
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    for make in (lambda n: "<p a='" * n, lambda n: "<p " + "a=b c " * n, lambda n: '<p x=">" ' * n, lambda n: "<a " * n + '"', lambda n: "<p a=\"'" * n, lambda n: "<!" * n):
        assert took(make(40000)) < 8 * took(make(10000)) + 0.2


def test_odd_pages(spark):
    long = "<article>" + P * 5000 + "</article>"
    rows = [(1, "u", P), (1, "u", P), (None, None, None), (2, "", ""), (3, "v", long)]
    pages = spark.createDataFrame([(*r, "clash", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    whole = "\n".join([TEXT] * 5000)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "", "", 0), (3, "v", whole, len(whole))], key=str)
    assert extract(pages.limit(0)).count() == 0
