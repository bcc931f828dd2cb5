"""Main text: the cut against brute force over whole pages, what it gains, and odd markup."""

from __future__ import annotations

import itertools
import random
import time
from pathlib import Path

import pytest

from vitrine.llm import maintext

PAGES = Path("/root/testdata/sf0.001/pages.parquet")


def cost(found, keep):
    edges = maintext._edges(found)
    return sum(-b.score if k else 0 for b, k in zip(found, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])


def test_whole_pages_against_every_labelling():
    rnd = random.Random(5)
    line = lambda n: " ".join("word" for _ in range(n))
    for _ in range(40):
        made = []
        for _ in range(rnd.randrange(2, 11)):
            tag, attribute = rnd.choice(["p", "div", "li", "td", "h2"]), rnd.choice(["", "", ' class="ad"', ' class="content"', " hidden"])
            text = line(rnd.choice([1, 2, 5, 12, 40])) + rnd.choice(["", "."])
            made.append(f"<{tag}{attribute}>{f'<a href=x>{text}</a>' if rnd.random() < 0.3 else text}</{tag}>")
        found = maintext.scored(f"<body>{''.join(made)}</body>")
        best = min(cost(found, k) for k in itertools.product([False, True], repeat=len(found)))
        assert cost(found, maintext.labels(found)) == pytest.approx(best)


@pytest.mark.skipif(not PAGES.exists(), reason="no test tables")
def test_the_cut_decides_pages_without_an_article_element(spark):
    """The table's pages with plain divisions for the article and its paragraphs: their text is that of the marked pages."""
    changed = with_cut = without = total = 0
    for row in spark.read.parquet(str(PAGES)).select("html").collect():
        bare = row.html
        for old, new in (("<article>", "<div>"), ("</article>", "</div>"), ("<p>", "<div>"), ("</p>", "</div>")):
            bare = bare.replace(old, new)
        found, truth = maintext.scored(bare), maintext.main_text(row.html)
        keep, own = maintext.labels(found), [b.score > 0 for b in found]
        text = lambda labels, found=found: " ".join(b.text for b, k in zip(found, labels, strict=True) if k)
        total, changed = total + 1, changed + (keep != own)
        with_cut, without = with_cut + (text(keep) == truth), without + (text(own) == truth)
    assert changed > 0.4 * total and with_cut > 0.95 * total and without < 0.6 * total


def test_short_lines_follow_their_neighbours():
    prose = "<div>Here is a paragraph of some length, which goes on for a while and then ends.</div>"
    assert "Short" in maintext.main_text(f"<div>{prose}<div>Short</div>{prose}</div>")
    links = "<div><a href=a>A menu entry</a></div>" * 3
    assert maintext.main_text(f"<div>{links}<div>Short</div>{links}</div>") == ""


def test_wrappers_named_after_a_frame():
    article = "<h1>Title of it</h1>" + "<p>A paragraph of the article, which has some words and ends here.</p>" * 3
    want = "Title of it" + " A paragraph of the article, which has some words and ends here." * 3
    for wrapper in ('class="content with-sidebar"', 'class="sidebar-layout"', 'id="has-footer"', 'class="col-8"', 'class="page-widget"'):
        page = f'<nav><a href=/>Home</a></nav><div {wrapper}>{article}</div><div class="sidebar"><p>Other things that one may want to read as well.</p></div><footer>Me</footer>'
        assert maintext.main_text(page) == want
    beside = "<article>" + article + "</article><div class=c12><p>A remark by a reader, in a division without a telling name.</p></div>"
    assert maintext.main_text(beside) == want
    inner = "<article>" + article + '<div class="ad">' + "<p>Buy this now, as it is so very cheap and good for you.</p>" * 4 + "</div></article>"
    assert maintext.main_text(inner) == want


@pytest.mark.parametrize("unit", ["<a ", "<div>a ", "<a \"'", "<!", "<p>a", "</script", "<!--", "<b><p>x", "</x>", "<td><th>", "<p>a</p><a href=x>bb</a>"])
def test_a_megabyte_of_odd_markup(unit):
    began = time.perf_counter()
    maintext.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_other_columns_and_repeated_rows(spark):
    rows = [(1, "<p>Some text of a page, twice.</p>", "a", 2), (1, "<p>Some text of a page, twice.</p>", "b", 3), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, score long")
    found = [(r.page_id, r.text) for r in maintext.extracted(pages).collect()]
    assert sorted(found, key=repr) == sorted([(1, "Some text of a page, twice.")] * 2 + [(None, "")], key=repr)
