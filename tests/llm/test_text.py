"""Token counts and HTML extraction."""

from __future__ import annotations

import html as entities
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from evalframe.llm import html_text, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return token_counts.Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _odd_texts(pieces):
    pick = random.Random(5)
    names = list(pieces.rank)
    yield from ["", " ", "  a", "a  b ", "a\tb\nc", "<s> </s> <unk>", "a▁b", "\x00b", "日本語テキスト" * 9, "🙂🙂 x", " " * 40 + "x", "aaaa" * 90]
    for _ in range(1500):
        yield "".join(pick.choice(names) for _ in range(pick.randint(1, 25)))
        yield "".join(pick.choice("abcdeinrst ▁\n0.é日") for _ in range(pick.randint(1, 50)))


def test_counts_equal_the_library(pieces, library):
    texts = list(_odd_texts(pieces))
    assert token_counts.count_texts(texts, pieces, {}) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_small_chunks_and_caches_change_nothing(pieces, library, monkeypatch):
    text = "Some words, repeated  again and again   in one long text. " * 40
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 37)
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 3)
    monkeypatch.setattr(token_counts, "MERGED_SYMBOLS", 10)
    assert token_counts.count_texts([text, "", text], pieces, {}) == [len(library.encode(text)), 0, len(library.encode(text))]


def test_count_tokens_rows(documents, library):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "é" * 3, "s"), (4, "word " * 6000, "s")]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(documents(rows), PATH).collect()}
    long = len(library.encode("word " * 6000))
    assert got == {(1, 3, 2, False), (2, 0, 0, False), (None, 6, len(library.encode("ééé")), False), (4, 30_000, long, True)}
    assert token_counts.count_tokens(documents([]), PATH).count() == 0


PROSE = "The river rises in the hills, runs past three small towns, and meets the sea after a long and quiet course."


def test_article_without_furniture():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, a lot, and so on and on.</div>
    <div id=content><article><h1>Title &amp; more</h1><p>{PROSE}<p><b>{PROSE}</b>  two
    lines<br><p>Short.<ul><li>{PROSE}</ul><script>var a="</p>";</script><!-- x --></article>
    <section class="comments"><p>{PROSE} {PROSE}</p></section></div>
    <aside>{PROSE}</aside><form><p>{PROSE}</p></form><div class="ad">{PROSE}</div><footer>&copy; {PROSE}</footer></body></html>"""
    assert html_text.extract(page) == "\n".join(["Title & more", PROSE, f"{PROSE} two lines", "Short.", PROSE])


def test_scoring_finds_the_container_without_an_article():
    links = "".join(f"<li><a href=/{i}>A link with quite a long text, number {i}</a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div class=post><div><h2>Head</h2><p>{PROSE}</p><p>{PROSE}</p></div></div><div>tiny</div>"
    assert html_text.extract(page) == "\n".join(["Head", PROSE, PROSE])


REST = f"<p>{PROSE}</p><p>{PROSE}</p>"
WHOLE = f"{PROSE}\n{PROSE}"


@pytest.mark.parametrize("page, text", [
    (f'<article class="post tag-social">{REST}</article>', WHOLE),
    (f'<div class="layout has-sidebar"><article>{REST}</article><div class="sidebar">{PROSE}</div></div>', WHOLE),
    (f'<div class="widget"><main>{REST}</main></div>', WHOLE),
    (f'<article><div class="entry-header"><h1>Head</h1></div>{REST}<div class="post-comments">{PROSE}</div></article>', f"Head\n{WHOLE}"),
    (f"<article>{REST}<p>Where <math><mi>x</mi> = <mn>2</mn></math> holds.</p></article>", f"{WHOLE}\nWhere x = 2 holds."),
    (f"<body><nav><ul><li><a href=/>Home</a></ul><article>{REST}</article>", WHOLE),
    (f"<div><div><nav><ul><li>Home</div><div>{REST}</div></div>", WHOLE),
    (f'<div class="cookie-notice">{REST}</div><div id="site-footer">{REST}</div><article>{REST}</article>', WHOLE),
    (f'<article>{REST}<span class="share">Share this</span><div class="ad-slot"><p>{PROSE}</p></div></article>', WHOLE),
    (f"<section><p>{PROSE}</p></section><article><div><div><p>{PROSE}</p></div><p>{PROSE}</p></div><table><tr><td>1</table></article>", f"{WHOLE}\n1"),
])
def test_pages_that_name_their_parts(page, text):
    assert html_text.extract(page) == text


def _reference_text(page):
    """The article of a given page, read by patterns: those pages hold one, of headings and paragraphs."""
    (inner,) = re.findall(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    texts = [" ".join(entities.unescape(block).split()) for block in blocks]
    return "\n".join(text for text in texts if text)


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got == {r.page_id: _reference_text(r.html) for r in pages.collect()} and len(got) > 200


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<article>ab", "ab"), ("<p>a&nbsp;b", "a b"),
    ("<script>never closed", ""), ("<div class=ad>x", ""), ("<p>a<p>b<br>c", "a\nb c"), ("<main><td>x</td>&#233;</main>", "x\né"),
])
def test_small_and_broken_pages(page, text):
    assert html_text.extract(page) == text


def test_extract_rows(spark):
    rows = [(1, "u", "<article>" + f"<p>{PROSE}</p>" * 3000, 1), (1, "u", None, 1), (None, None, "", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = html_text.extract_pages(df).collect()
    assert [r.n_chars for r in got] == [3000 * (len(PROSE) + 1) - 1, 0, 0] and got[1].text == ""
    assert html_text.extract_pages(df.limit(0)).count() == 0
