"""Pages: the reader against a plain one, decoding against all labellings, main text against the article elements of the given pages."""

import itertools
import os
import random
import re
import time

import numpy as np
import pytest

from plurifit.llm import html_text

from .test_llm import use_package

PIECES = "< > \" ' / = a <p> </p> <b> </b> <li> </li> <ul> </ul> <!-- --> <td> <tr> <table> <hr> <br> </ <div> </div> <option>".split() + [" ", 'text', '<div class="nav">', "<a href='x<y'>"]


def plain_reader(source):
    """Every tag by one expression from its start, every stack search element by element: slow, and easy to follow."""
    tag = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
    elements, stack, out, block, at = [("html", -1)], [0], [], 0, 0

    def say(text):
        if text:
            out.append((stack[-1], block, text))

    def close_nearest(names, bounds):
        for i in range(len(stack) - 1, 0, -1):
            if elements[stack[i]][0] in names:
                del stack[i:]
                return
            if elements[stack[i]][0] in bounds:
                return

    for m in tag.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None or (not m[1] and m[2].lower() == "html"):
            continue
        name = m[2].lower()
        block += name in html_text.BLOCK
        if m[1]:
            close_nearest({name}, ())
            continue
        if name in html_text.BLOCK:
            close_nearest({"p"}, html_text.BLOCK)
        if name in html_text.CLOSES:
            ends, bounds = html_text.CLOSES[name]
            close_nearest(set(ends.split()), bounds)
        if name == "br":
            say(" ")
            continue
        elements.append((name, stack[-1]))
        if name not in html_text.VOID and not m[3].endswith("/"):
            stack.append(len(elements) - 1)
    say(source[at:])
    return elements, out


def test_reader_against_a_plain_one():
    rng = random.Random(11)
    for _ in range(3000):
        source = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        page = html_text.Page(source)
        assert (list(zip(page.tag, page.parent)), page.pieces) == plain_reader(source), source


@pytest.mark.parametrize("source", [
    "<a " * 350_000, '<a "' * 250_000 + ">", "<a<" * 350_000, "<a '\"" * 200_000, '<a b="<' * 150_000, "<a" + "b" * 1_000_000,
    "<div>" * 80_000 + "</b>" * 80_000, "<b>" * 80_000 + "<hr>" * 80_000, "<ul><li><ul>" + "<b>" * 50_000 + "<li></li>" * 50_000,
], ids=lambda s: s[:8])
def test_hostile_pages_take_linear_time(source):
    start = time.process_time()
    html_text.Page(source)
    assert time.process_time() - start < 3


def test_decoding_against_all_labellings():
    rng = np.random.default_rng(4)
    for turn in range(60):
        names = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<form>", "words"]
        page = html_text.Page("".join(rng.choice(names) for _ in range(12)))
        n = len(page.tag)
        if n > 9:
            continue
        margin = rng.normal(size=n) * 2
        yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)

        def likelihood(taken):
            total = 0.0
            for i in range(1, n):
                if taken[i] and (not taken[page.parent[i]] or page.tag[i] in html_text.NEVER):
                    return -np.inf
                total += yes[i] if taken[i] else 0.0 if page.tag[i] in html_text.NEVER else no[i]
            return total

        best = max(likelihood((True, *rest)) for rest in itertools.product((False, True), repeat=n - 1))
        assert likelihood(page.decode(margin)) == pytest.approx(best)


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.96), ("sf0.01", 0.98)])
def test_main_text_is_that_of_the_articles(spark, sf, least):
    """On the given pages the main text is all of ``<article>`` but adverts, asides and comments inside it; training never sees the element marked."""
    path = f"/root/testdata/{sf}/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    use_package(spark)
    pages, right = spark.read.parquet(path), 0
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        page = html_text.Page(r["html"] or "")
        inside = [False] * len(page.tag)
        for i in range(1, len(page.tag)):
            inside[i] = (inside[page.parent[i]] or page.tag[i] == "article") and page.tag[i] not in html_text.NEVER | {"aside", "nav", "footer"} and page.tokens[i] in (0, 1)
        right += found[r["page_id"]] == page.text(inside)
    assert right >= least * len(found)
    print(sf, right, len(found))


def test_short_articles_lose_their_footer(spark):
    use_package(spark)
    page = (
        '<!DOCTYPE html><html><head><title>x</title></head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
        '<div class="ad">Buy one of these today.</div><article><h1>Small news.</h1><p><b>Small news.<br></article>'
        "<footer>&copy; blog.example.net &middot; And a line that is longer than the article is.</footer></body></html>"
    )
    given = spark.createDataFrame([(i, "u", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(given).collect()} == {"Small news.\n\nSmall news."}
