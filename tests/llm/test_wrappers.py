"""Where the slots of a host's wrapper decide: boxes without telling names, by-lines, comments, given pages made neutral."""

import os
import random
import re

import pytest
from helpers import prose

from steadfield.llm import html_wrappers

PLAIN = {"article": "k1", "nav": "k2", "footer": "k4", "header": "k5", "aside": "k6", "main": "k7"}


def neutral(page):
    """The page with all boxes as div elements, whose classes say nothing."""
    page = re.sub(r"<(article|nav|footer|header|aside|main)\b[^>]*>", lambda m: f'<div class="{PLAIN[m[1]]}">', page or "")
    return re.sub(r"</(article|nav|footer|header|aside|main)>", "</div>", page).replace('<div class="ad">', '<div class="k3">')


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_slots_find_the_text_of_given_pages_without_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, neutral(r.html)) for r in pages.collect()]
    bare = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = {r.page_id: r.text for r in html_wrappers.extract_main_text(pages).collect()}
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(bare).collect()}
    alone = {i: "\n".join(t.strip() for *_, own, _, t in html_wrappers.Page(h, None).blocks if own and t.strip()) for i, _, h in rows}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert sum(alone[i] == want[i] for i in want) < 0.1 * len(want)  # a page by itself can't tell


def host_of_stories(n, comments=True):
    rng, rows, want = random.Random(n), [], []
    for k in range(n):
        head, story = prose(rng, 6), [prose(rng, rng.randint(40, 70)) for _ in range(rng.randint(2, 5))]
        said = "".join(f'<div class="c"><b>{prose(rng, 1)}</b><p>{prose(rng, 9)}</p><p>{prose(rng, 2)}</p></div>' for _ in range(rng.randint(1, 4))) if comments else ""
        body = f'<div class="k0"><ul><li>Home page<li>Our terms</ul></div><div class="k1"><h1>{head}</h1><p>By Ann Lee</p>{"".join(f"<p>{p}</p>" for p in story)}</div><div class="k2">{said}</div><div class="k3"><p>All rights reserved by us</p></div>'
        rows.append((k, f"http://stories.example/{k}", f"<html><body>{body}</body></html>"))
        want.append("\n".join([head, "By Ann Lee", *story]))
    return rows, want


@pytest.mark.parametrize("n", [8, 25])
def test_by_lines_stay_and_comments_go(spark, n):
    rows, want = host_of_stories(n)
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(n)] == want


def test_a_very_long_page(spark):
    rows, want = host_of_stories(5)
    long = [prose(random.Random(9), 400) for _ in range(700)]
    rows.append((99, "http://stories.example/99", f'<html><body><div class="k0"><ul><li>Home page<li>Our terms</ul></div><div class="k1"><h1>Long</h1><p>By Ann Lee</p>{"".join(f"<p>{p}</p>" for p in long)}</div><div class="k2"></div><div class="k3"><p>All rights reserved by us</p></div></body></html>'))
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == "\n".join(["Long", "By Ann Lee", *long]) and len(got[99]) > 1_500_000
    assert [got[k] for k in range(5)] == want


def test_numbers_of_boxes():
    assert html_wrappers._words(' class="k1 post-12345 Col12 item4567"') == ["col", "col12", "item", "k", "k1", "post"]
