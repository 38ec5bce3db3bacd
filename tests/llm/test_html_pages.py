"""Pages with known main text, with and without semantic elements."""

import os
import random
import re

import pytest

from foldlens.llm import html_text

WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll lagoon marsh north orchard prairie quarry ridge shore tundra".split()


def sentence(rng, low, high):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + "."


def page(rng, kind):
    """(html, main text): a menu, an advert, the article, links, comments and a footer."""
    title = sentence(rng, 2, 4)[:-1]
    blocks = [sentence(rng, 25, 60) if rng.random() < 0.8 else sentence(rng, 2, 4) for _ in range(rng.randint(4, 9))]
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 6)) + "</ul>"
    paragraphs = "".join(f"<p>{b}</p>" for b in blocks)
    more = "<ul>" + "".join(f'<li><a href="/{w}">{sentence(rng, 3, 6)}</a></li>' for w in rng.sample(WORDS, 4)) + "</ul>"
    comments = "".join(f"<p>{sentence(rng, 5, 20)}</p>" for _ in range(3))
    ad = f'<div class="ad">{sentence(rng, 5, 9)}</div>'
    foot = f'<div class="footer">{sentence(rng, 6, 10)}</div>'
    if kind == "semantic":
        html = f"<nav>{menu}</nav>{ad}<article><h1>{title}</h1>{paragraphs}</article><footer>{foot}</footer>"
    elif kind == "plain":
        html = f'<div>{menu}</div>{ad}<div><h1>{title}</h1>{paragraphs}</div><div id="comments">{comments}</div>{foot}'
    else:  # the heading stands beside the body, and a list of links in it
        html = f"<div>{menu}</div>{ad}<div><h1>{title}</h1></div><div>{paragraphs}<div>{more}</div></div><div id='comments'>{comments}</div>{foot}"
    return f"<html><head><title>{title}</title></head><body>{html}</body></html>", "\n".join([title, *blocks])


def wrong_lines(pages):
    total = wrong = 0
    for html, text in pages:
        got, want = html_text.main_text(html).split("\n"), text.split("\n")
        total += len(want)
        wrong += len(set(got) ^ set(want))
    return wrong / total


@pytest.mark.parametrize("kind", ["semantic", "plain", "beside"])
def test_generated_pages(kind):
    rng = random.Random(7)
    assert wrong_lines([page(rng, kind) for _ in range(150)]) <= 0.02


def test_smoothing_decides(monkeypatch):
    rng = random.Random(8)
    pages = [page(rng, "beside") for _ in range(100)]
    with_it = [html_text.main_text(h) for h, _ in pages]
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, sigma=1: ratios)
    assert sum(html_text.main_text(h) != text for (h, _), text in zip(pages, with_it, strict=True)) > 50
    assert wrong_lines(pages) > 0.05


@pytest.mark.parametrize("name", ["has-sidebar", "content no-comments", "post-share", "related-free", "promo"])
@pytest.mark.parametrize("tag", ["div", "form", "section"])
def test_wrappers_keep_their_text(name, tag):
    rng = random.Random(9)
    blocks = [sentence(rng, 20, 40) for _ in range(5)]
    inner = "<h1>A title</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
    html = f'<body><div class="menu"><a>one</a></div><{tag} class="{name}">{inner}</{tag}><div class="ad">Buy it.</div></body>'
    assert html_text.main_text(html) == "\n".join(["A title", *blocks])


def test_comments_outweigh_no_article():
    rng = random.Random(10)
    comments = "".join(f"<p>{sentence(rng, 20, 40)}</p>" for _ in range(40))
    html = f"<article><p>{sentence(rng, 20, 30)}</p></article><div id=comments>{comments}</div>"
    assert html_text.main_text(html).count("\n") == 0 and html_text.main_text(html)


@pytest.mark.parametrize(("html", "text"), [("<p>if a <b", "if a <b"), ("<p>a <b and much more text", "a <b and much more text"), ("<p>one</p><a href=", "one"), ("<p>one</p><div", "one"), ("<p>1 < 2", "1 < 2"), ("<p>x <y", "x <y")])
def test_pages_that_end_after_a_sign(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="fixtures are absent")
def test_fixture_pages_do_not_need_semantic_elements(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(?:article|main|nav)\b", r"<\1div", h) for h in pages]
    assert wrong_lines([(p, html_text.main_text(h)) for h, p in zip(pages, plain, strict=True)]) <= 0.02


def test_long_page():
    rng = random.Random(11)
    blocks = [sentence(rng, 30, 60) for _ in range(8000)]  # about 2 MB
    assert html_text.main_text("<div><a>x</a></div><div>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div>") == "\n".join(blocks)
