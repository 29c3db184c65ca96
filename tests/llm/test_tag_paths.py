"""Main text of pages: what decides is the tag paths' ratios, in linear time."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from kickstand.llm import op10_tag_paths as op10


@pytest.fixture(scope="module")
def pages():
    return pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def stripped(page):
    """The page without class names, and with plain containers in place of elements that have a meaning."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page))


def test_pages_without_marks_or_names_give_their_article(pages):
    found = [op10.main_text(stripped(p)) == article(p) for p in pages]
    # what is lost are articles shorter than the advert beside them
    assert sum(found) >= 0.95 * len(found)


def test_scores_decide(pages, monkeypatch):
    scores = op10.path_scores
    whole = [op10.main_text(p) for p in pages]
    monkeypatch.setattr(op10, "path_scores", lambda blocks: dict.fromkeys(scores(blocks), 0.0))
    assert all(op10.main_text(p) != text for p, text in zip(pages, whole, strict=True) if text)
    # the largest score to the wrong paths: links and short lines win, and the article goes
    monkeypatch.setattr(op10, "path_scores", lambda blocks: {p: 1 / (1e-9 + s) for p, s in scores(blocks).items()})
    changed = [op10.main_text(p) != text for p, text in zip(pages, whole, strict=True)]
    assert sum(changed) > 0.9 * len(changed)


@pytest.mark.parametrize("opening", ["<div>", '<div class="ad">', "<ul><li>", "<table><tr><td>", "<p><div>", "<b><section id=x>"])
def test_deep_nesting_takes_linear_time(opening):
    def seconds(n):
        start = time.process_time()
        op10.main_text(opening * n + "text, here." + "</p></q></li></div>" * n)
        return time.process_time() - start

    seconds(500)
    assert seconds(40_000) < 20 * max(seconds(10_000), 0.05)


def test_a_hundred_thousand_open_tags():
    start = time.process_time()
    assert op10.main_text("<div>" * 100_000 + "text, here.") == "text, here."
    assert time.process_time() - start < 4


def test_elements_inside_a_sentence_stay():
    page = "<article><p>Let <math>x</math> be <canvas>drawn</canvas> or <object>held</object>, <audio>heard</audio>.</p></article>"
    assert op10.main_text(page) == "Let x be drawn or held, heard."


def test_a_long_page_is_whole():
    body = "".join(f"<p>Sentence number {i}, with a mark.</p>" for i in range(20_000))
    assert op10.main_text(f"<body><nav><a href=x>Home</a></nav><div>{body}</div><footer>All</footer></body>").count("\n\n") == 19_999


def test_comments_that_are_longer_than_the_article_stay_out():
    story = "<p>The article says this, and that, in a sentence.</p>" * 3
    talk = "<p>I liked it, really, and would say so at length, again and again, in many words.</p>" * 9
    page = f"<body><div class=content>{story}</div><div class='comments'>{talk}</div></body>"
    assert op10.main_text(page) == "\n\n".join(["The article says this, and that, in a sentence."] * 3)
