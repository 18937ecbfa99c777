"""Main text: the pages' own articles, layouts and hand-made pages that no tree was fitted on, broken and odd pages."""

import html
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillet.llm import extract
from quillet.llm.boosting import BoostedTrees
from quillet.llm.dom import Page


@pytest.fixture(scope="module")
def htmls():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


@pytest.fixture(scope="module")
def model(htmls):
    return extract.fitted(htmls[:120])


def article(page):
    """The blocks of a page whose article holds headings and paragraphs only, ended or not."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
    return "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_articles_of_held_out_pages(htmls, model):
    got, want = extract.main_texts(htmls[120:], model), [article(h) for h in htmls[120:]]
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 1


def test_query_over_pages(spark, sf):
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit("old")).withColumn("more", F.array(F.lit(1)))
    got = {r["page_id"]: r for r in extract.extract_main_text(pages).collect()}
    assert all(r["n_chars"] == len(r["text"]) and r["more"] == [1] for r in got.values())
    assert sum(got[r["page_id"]]["text"] != article(r["html"]) for r in rows) <= len(rows) // 100


def test_unseen_layouts(htmls, model):
    rng, right, wanted, given = random.Random(5), 0, 0, 0
    prose = [t for h in htmls[120:] for t in article(h).split("\n\n") if len(t) > 40]
    for h in htmls[150:220]:
        page = Page(made := extract.laid_out(rng, article(h).split("\n\n"), prose))
        want = set(extract.block_texts(page, extract.marked_by_layout(page)))
        got = set(extract.main_texts([made], model)[0].split("\n\n"))
        right, wanted, given = right + len(want & got), wanted + len(want), given + len(got)
    assert right / wanted > 0.97 and right / given > 0.97


ONE = "Anha, the of, are haedre anti the a theaatnd or it ing thshst the thsh the erntea erthat edti theaeres thhe inonha."
TWO = "Of thinger a edering reednt that. Ateaea shedtion stth esan thoreaon thining, thntly thou to re onlyhe this atshsh erin."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><header class=site><h1>My Site</h1><p>A line about it</p></header><nav><a href=/>Home</a></nav><main>{{}}</main><aside class='sidebar'><h3>Related</h3><p>{ONE}</p></aside><section class='comments'><p>{TWO}</p></section><footer>x</footer></body></html>",
        f"<div id=cookie-notice>We use cookies. <button>OK</button></div><div class='wrap'><div class='post'>{{}}<div class=ad>Buy now and save money.</div></div><div id='comments'><p>{TWO}</p></div></div><div class=footer>(c)</div>",
        f"<article>{{}}<form><p>Our letter</p><input></form><section class='reader-comments'><h3>What readers say</h3><p>{TWO}</p></section></article>",
        "<table><tr><td class=menu><a href=a>x</a><a href=b>y</a></td><td>{}</td></tr></table>",
    ],
)
def test_hand_made_pages(model, page):
    assert extract.main_texts([page.format(f"<p>{ONE}</p><p>{TWO} &eacute;&#33;<p>Tail &lt;b&gt;")], model) == [f"{ONE}\n\n{TWO} é!\n\nTail <b>"]


def test_reader():
    def blocks(h):
        page = Page(h)
        return extract.block_texts(page, np.ones(len(page.pieces), bool))

    assert blocks("<p>a<p>b <b>c</b>d<br>e<li>f<li>g") == ["a", "b cd e", "f", "g"]
    assert blocks("x<script>if (a<b) '</p>'</script>y<style>p{}</style><!-- z -->w") == ["xyw"]
    assert blocks("<div>a<div>b</div>c</div><title>t</title>&amp;&nbsp;&#x41;") == ["a", "b", "c", "& A"]
    assert blocks('<p title="a > b">c</p><p class=x>d</b></p></div>e') == ["c", "d", "e"]
    assert blocks("a < b <3 <!-- never closed") == ["a < b <3"]
    assert blocks("<script>never closed <p>a") == [] and blocks("") == []
    assert blocks("<" * 50_000 + "<div>" * 50_000 + "deep") [-1] == "deep"


def test_decoding_agrees():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        parents = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        p = rng.random(n)
        leaves = [i for i in range(n) if i not in parents]
        best = None
        for mask in range(1 << n):
            y = [mask >> i & 1 for i in range(n)]
            agree = all(parents[i] < 0 or y[i] <= y[parents[i]] for i in range(n)) and all(not y[i] or i in leaves or any(y[c] for c in range(n) if parents[c] == i) for i in range(n))
            total = np.log(np.where(y, p, 1 - p)).sum()
            if agree and (best is None or total > best[0]):
                best = (total, y)
        assert extract.decoded(parents, np.arange(n), p) == [bool(v) for v in best[1]]


def test_trees_learn():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random(3000), rng.random(3000), rng.integers(0, 2, 3000)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0)).astype(float)
    assert ((BoostedTrees(trees=20).fit(x[:2000], y[:2000]).probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.98
    assert BoostedTrees().fit(x, np.ones(3000)).probability(x[:1])[0] > 0.99 and BoostedTrees().fit(x[:0], y[:0]).probability(x[:1])[0] == 0.5


def test_odd_pages(spark, htmls):
    rows = [(1, None), (2, ""), (3, htmls[0]), (3, htmls[0]), (4, "<p>" + "word " * 200_000), (None, "<nav>x</nav>"), (5, "\x00<�>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("n_chars", F.lit("old")).repartition(2)
    got = sorted((tuple(r) for r in extract.extract_main_text(df).select("page_id", "text", "n_chars").collect()), key=repr)
    assert len(got) == len(rows) and got.count((3, article(htmls[0]), len(article(htmls[0])))) == 2
    assert (1, "", 0) in got and (2, "", 0) in got
    assert extract.extract_main_text(df.where("false")).collect() == []
    assert extract.extract_main_text(df.where("page_id < 3")).count() == 2
