"""Tag-path ratios: scores against plain loops, what they decide, odd pages and tables."""

import math
import random
import time

import numpy as np
import pytest

from evenkeel.llm import html_text
from evenkeel.llm.html_text import extract

PARA = "<p>A sentence, with commas, and more. Then another one follows it.</p>"
TEXT = "A sentence, with commas, and more. Then another one follows it."


def test_scores_by_plain_loops():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randrange(1, 40)
        size, signs = [rng.randrange(1, 300) for _ in range(n)], [rng.randrange(9) for _ in range(n)]
        linked, paths = [rng.randrange(200) for _ in range(n)], [rng.randrange(5) for _ in range(n)]
        mean = lambda values, k: sum(v for v, p in zip(values, paths) if p == paths[k]) / paths.count(paths[k])
        free = [1 - min(1, a / b) for a, b in zip(linked, size)]
        ratio = [mean(size, k) * (1 + mean(signs, k)) * mean(free, k) for k in range(n)]
        at = lambda k: ratio[min(max(k, 0), n - 1)]
        fused = [math.sqrt(ratio[k] * (at(k - 1) / 4 + at(k) / 2 + at(k + 1) / 4)) for k in range(n)]
        got, of_path = html_text.scores(*[np.array(x, float) for x in (size, signs, linked)], np.array(paths))
        assert np.allclose(got, fused) and np.allclose(of_path, [mean(fused, k) for k in range(n)])


def test_ratios_decide_where_tags_do_not():
    """No article, no telling names: without the ratios the links and the imprint would come along."""
    page = ("<body><div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div><h1>Title</h1>" + PARA * 3
            + "</div><div>Imprint<br>Terms</div></body>")
    assert extract(page) == "\n".join(["Title"] + [TEXT] * 3)
    assert extract(page, 0.0) != extract(page) and "Imprint" in extract(page, 0.0)


def test_nothing_of_the_article_is_lost():
    page = ("<body><header>Site</header><article><header><h1>Title</h1><p>By me</p></header><div class='share-price'>" + PARA
            + "</div><div class='comments-on-the-law'>" + PARA + "</div><div class='comment-list'>" + PARA
            + "</div><div class=shareButtons>Share</div></article><footer>x</footer></body>")
    assert extract(page) == "\n".join(["Title", "By me", TEXT, TEXT])
    assert extract(f"<body><div><h1>Title</h1><p>Lead.</p><div>{PARA * 20}</div></div><div><a>x</a></div>") == "\n".join(["Title", "Lead."] + [TEXT] * 20)


@pytest.mark.parametrize("name, out", [
    ("ad", True), ("ad-banner", True), ("reader-comments", True), ("comments2", False), ("site-header", True), ("article-header", False),
    ("share-price", False), ("shareButtons", True), ("navbar", True), ("content", False), ("related-posts big", True), ("headline", False)])
def test_names(name, out):
    assert html_text.ruled_out(name, False) is out


def test_pages_that_never_close_take_linear_time():
    pages = ["<a " * 350000, "<a \"'" * 200000 + ">", "<svg>" * 200000, "<i>" * 100000 + "<div></div>" * 50000,
             "<div>" * 50000 + "</x>" * 100000, "<div>x" * 100000, "<!" * 300000, "<" * 500000 + ">"]
    for page in pages:
        begun = time.monotonic()
        extract(page)
        assert time.monotonic() - begun < 10


def test_tables(spark):
    """Nulls, empty and long pages, repeated rows, clashing columns and no rows at all."""
    long = "<article>" + PARA * 20000 + "</article>"
    rows = [(1, "u", f"<article>{PARA}</article>", "x"), (1, "u", f"<article>{PARA}</article>", "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", long, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(map(tuple, html_text.extract_pages(pages).collect()), key=str)
    assert out == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", "\n".join([TEXT] * 20000), 20000 * (len(TEXT) + 1) - 1)], key=str)
    assert html_text.extract_pages(pages.where("false")).columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract_pages(pages.where("false")).count() == 0
