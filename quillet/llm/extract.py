"""Main text of web pages: boosted trees judge every node of a page, and a decoding over the tree makes the verdicts agree.

A node's verdict is whether it holds main text. A node below one without main text has none, and a node with main text has
a child with some: of all verdicts that agree so, the decoding takes the most probable (one pass up and one down a page's tree).

No table of marked pages exists, so the trees learn from a bounded sample of the pages themselves. What their own elements
say (article, main, nav, aside, names of classes) marks their blocks; the blocks are then laid out again in many ways, in
other elements, under other names or none, with prose from other pages as comments, notices and adverts between them. So
the trees cannot rest on one layout's elements or on the length of a text alone.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .boosting import BoostedTrees
from .dom import SAID, TAG_BITS, Page, features

#: Pages that the trees are fitted on, their largest size in bytes, and layouts made of each.
TRAIN_PAGES, TRAIN_BYTES, LAYOUTS = 240, 1 << 15, 7
#: Pages and characters that are judged at a time.
SLICE_PAGES, SLICE_CHARS = 256, 2_000_000

BAD_WORDS = sum(b for w, b in SAID.items() if not b & SAID["article"])
BAD_TAGS = sum(TAG_BITS[t] for t in ("nav", "footer", "aside", "form"))
GOOD_TAGS = TAG_BITS["article"] | TAG_BITS["main"]
MARK = re.compile(r'data-main="([01])"')


def marked_by_elements(page: Page) -> np.ndarray:
    """For each piece of text whether the page's own elements make it main text: below an article or main element, or in a page
    without one a run of 15 words with few links, and in either case below nothing that is named as something else."""
    named = any(t in ("article", "main") for t in page.tags)
    out = np.zeros(len(page.pieces), bool)
    words: dict[int, int] = {}
    for leaf, (_, _, text, link) in zip(page.leaf_of, page.pieces, strict=True):
        words[leaf] = words.get(leaf, 0) + (0 if link else len(text.split()))
    for i, (leaf, (owner, _, _, link)) in enumerate(zip(page.leaf_of, page.pieces, strict=True)):
        if leaf < 0:
            continue
        above = page.above_tags[owner] | TAG_BITS.get(page.tags[owner], 0)
        bad = (page.own[owner] | page.above[owner]) & BAD_WORDS or above & BAD_TAGS or above & TAG_BITS["header"] and not above & GOOD_TAGS
        out[i] = not bad and (bool(above & GOOD_TAGS) if named else words[leaf] >= 15 and not link)
    return out


def marked_by_layout(page: Page) -> np.ndarray:
    """The same for a page made by laid_out(), whose elements say it."""
    state = []
    for parent, attributes in zip(page.parents, page.marks, strict=True):
        m = MARK.search(attributes)
        state.append(m[1] == "1" if m else parent >= 0 and state[parent])
    return np.array([leaf >= 0 and state[leaf] for leaf in page.leaf_of], bool)


def node_labels(page: Page, main: np.ndarray) -> np.ndarray:
    """Whether a node holds any piece of main text."""
    out = np.zeros(len(page.tags), bool)
    for leaf, yes in zip(page.leaf_of, main, strict=True):
        while yes and leaf >= 0 and not out[leaf]:
            out[leaf] = True
            leaf = page.parents[leaf]
    return out


def block_texts(page: Page, keep: np.ndarray) -> list[str]:
    """The blocks of the kept pieces in page order, white space in each turned into one space."""
    blocks: dict[int, list[str]] = {}
    for yes, (_, block, text, _), leaf in zip(keep, page.pieces, page.leaf_of, strict=True):
        if yes or leaf < 0:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return [t for t in texts if t]


# Layouts: elements and names that pages commonly use.
BODIES = ("<article{m}>", "<article class='post'{m}>", "<main{m}>", "<div class='content'{m}>", "<div id='main-content'{m}>", "<div class='post-body'{m}>", "<div class='entry-content'{m}>", "<div class='story'{m}>", "<section class='article-text'{m}>", "<section{m}>", "<div{m}>", "<td{m}>")
WRAPS = ("", "", "<main>", "<div class='container'>", "<div id='page'>", "<div class='row wrapper'>", "<section>", "<div>")
NAVS = ("<nav>{l}</nav>", "<div class='menu'>{l}</div>", "<div id='nav'>{l}</div>", "<ul class='navbar'>{i}</ul>", "<nav class='breadcrumb'>{i}</nav>", "<div>{l}</div>", "<ol class='pagination'>{i}</ol>")
HEADERS = ("<header><h1>{t}</h1><p>{s}</p></header>", "<header class='site-header'><a href='/'>{t}</a>{l}</header>", "<div id='header'><h2>{t}</h2><p>{s}</p></div>", "<div class='masthead'>{t}</div>", "<header>{s}</header>")
FOOTERS = ("<footer>&copy; {t} {s}</footer>", "<div id='footer'><p>{s}</p>{l}</div>", "<div class='copyright'>{s}</div>", "<footer><p>{s}</p><p>{t}</p></footer>", "<footer class='site-footer'>{l}</footer>")
SIDES = ("<aside><h3>{t}</h3><p>{s}</p></aside>", "<div class='sidebar'><h3>{t}</h3>{l}</div>", "<div id='sidebar'><p>{p}</p></div>", "<aside class='widget'>{p}</aside>", "<div class='related-posts'><h4>{t}</h4>{l}</div>", "<section class='recommended'><p>{s}</p>{l}</section>", "<aside><p>{p}</p><p>{s}</p></aside>")
NOTICES = ("<div class='cookie-notice'><p>{s}</p><button>{t}</button></div>", "<div id='cookie-banner'>{s}</div>", "<div class='alert'>{s}</div>", "<div role='dialog'><p>{p}</p></div>", "<div class='notice'><p>{s}</p></div>", "<section class='newsletter'><p>{p}</p></section>", "<div class='popup'>{p}</div>")
ADVERTS = ("<div class='ad'>{s}</div>", "<div class='advert'><p>{p}</p></div>", "<ins class='adsbygoogle'>{s}</ins>", "<div id='ad-top'>{s}</div>", "<div class='sponsored'><h4>{t}</h4><p>{p}</p></div>", "<div class='promo banner'><a href='/x'>{s}</a></div>", "<aside class='ads'>{s}</aside>")
FORMS = ("<form><label>{t}</label><input name=q><button>{t}</button></form>", "<form class='search'><p>{s}</p><input></form>", "<div class='login'><form><p>{s}</p></form></div>", "<form action='/subscribe'><h3>{t}</h3><p>{p}</p><input type=email></form>", "<form id='contact'><fieldset><legend>{t}</legend><p>{s}</p></fieldset></form>")
COMMENTS = ("<section id='comments'><h3>{t}</h3><div class='comment'><p>{p}</p></div><div class='comment'><p>{s}</p></div></section>", "<div class='comments'><p>{p}</p><p>{p}</p></div>", "<ol class='commentlist'><li><p>{p}</p></li><li>{s}</li></ol>", "<div id='disqus_thread'><p>{p}</p></div>", "<ul class='replies'><li><b>{t}</b><p>{p}</p></li></ul>", "<section class='discussion'><article class='comment'><p>{p}</p></article><article class='comment'><p>{s}</p></article></section>")
SHARES = ("<div class='share'>{l}</div>", "<ul class='social'>{i}</ul>", "<div class='tags'>{l}</div>", "<p class='byline meta'>{t}</p>", "<footer class='meta'>{s}</footer>")


def _filled(rng: random.Random, template: str, prose: list[str]) -> str:
    """A template with words of other pages: {t} a few, {s} a sentence, {p} a paragraph, {l} and {i} links."""

    def some(low: int, high: int) -> str:
        words = rng.choice(prose).split()
        n = rng.randint(low, high)
        at = rng.randrange(max(1, len(words) - n))
        return escape(" ".join(words[at : at + n]))

    links = [f"<a href='/{k}'>{some(1, 3)}</a>" for k in range(rng.randint(3, 8))]
    kinds = {"t": lambda: some(1, 4), "s": lambda: some(5, 18), "p": lambda: some(20, 90), "l": lambda: rng.choice(("<ul>{}</ul>", "{}")).format("".join(f"<li>{x}</li>" for x in links)) if rng.random() < 0.7 else " | ".join(links), "i": lambda: "".join(f"<li>{x}</li>" for x in links)}
    return re.sub(r"\{([tspli])\}", lambda m: kinds[m[1]](), template)


def laid_out(rng: random.Random, blocks: list[str], prose: list[str]) -> str:
    """A page around blocks of main text, every part marked as main text or not."""
    other = lambda templates: re.sub(r"^<(\w+)", r'<\1 data-main="0"', _filled(rng, rng.choice(templates), prose))
    body, wraps = rng.choice(BODIES), [rng.choice(WRAPS) for _ in range(rng.randint(0, 2))]
    shown = []
    for k, text in enumerate(blocks):
        text, kind = escape(text), rng.random()
        words = text.split(" ")
        if rng.random() < 0.15 and len(words) > 8:
            at = rng.randrange(len(words) - 4)
            words[at : at + 3] = [f"<{'a href=/x' if kind < 0.5 else 'em'}>" + " ".join(words[at : at + 3]) + f"</{'a' if kind < 0.5 else 'em'}>"]
            text = " ".join(words)
        if k == 0 and len(words) < 25:
            shown.append(f"<header{rng.choice(('', " class='entry-header'"))}><h1>{text}</h1></header>" if kind > 0.75 else f"<h{1 + (kind < 0.3)}>{text}</h{1 + (kind < 0.3)}>")
        elif kind < 0.06:
            shown.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.12:
            third = max(1, len(words) // 3)
            shown.append("<ul>" + "".join(f"<li>{' '.join(words[i : i + third])}</li>" for i in range(0, len(words), third)) + "</ul>")
        elif kind < 0.15:
            shown.append(f"<h3>{' '.join(words[:6])}</h3><p>{' '.join(words[6:]) or text}</p>")
        elif kind < 0.18:
            shown.append(f"<table><tr><td>{' '.join(words[: len(words) // 2 + 1])}</td><td>{' '.join(words[len(words) // 2 + 1 :])}</td></tr></table>")
        elif kind < 0.21:
            shown.append(f"<figure><img src=x><figcaption>{' '.join(words[:12])}</figcaption></figure><p>{' '.join(words[12:]) or text}</p>")
        elif kind < 0.24:
            shown.append(f"<div>{text}</div>")
        elif kind < 0.34:
            shown.append(f"<p><b>{text}<br>")
        else:
            shown.append(f"<p>{text}</p>")
        if rng.random() < 0.07:
            shown.append(other(rng.choice((ADVERTS, SIDES, FORMS, SHARES, NOTICES))))
    if rng.random() < 0.3:
        shown.append(other(rng.choice((COMMENTS, COMMENTS, SHARES, SIDES))))
    close = lambda opened: f"</{re.match(r'<(\w+)', opened)[1]}>" if opened else ""
    inner = body.format(m=' data-main="1"') + "".join(shown) + close(body)
    if body.startswith("<td"):
        inner = f"<table><tr>{inner}</tr></table>"
    before = [other(t) for t, share in ((NOTICES, 0.3), (HEADERS, 0.6), (NAVS, 0.8), (FORMS, 0.2), (ADVERTS, 0.5), (SIDES, 0.2)) if rng.random() < share]
    after = [other(t) for t, share in ((COMMENTS, 0.4), (SIDES, 0.4), (SHARES, 0.3), (FORMS, 0.2), (ADVERTS, 0.2), (FOOTERS, 0.85), (NAVS, 0.15), (NOTICES, 0.15)) if rng.random() < share]
    rng.shuffle(before)
    cut = rng.choice((0, 0, len(after)))  # what follows stands inside the wrapping elements or behind them
    page = inner + "".join(after[:cut])
    for w in wraps:
        page = w + page + close(w)
    return "<html><body>" + "".join(before) + page + "".join(after[cut:]) + ("</body></html>" if rng.random() < 0.9 else "")


def fitted(pages: list[str]) -> BoostedTrees:
    """Trees fitted on pages as they are and on LAYOUTS new layouts of each; the same pages give the same trees."""
    read = [Page(h) for h in pages]
    main = [marked_by_elements(p) for p in read]
    blocks = [block_texts(p, m) for p, m in zip(read, main, strict=True)]
    prose = [t for b in blocks for t in b if len(t) > 30] or [t for b in blocks for t in b] or ["text"]
    x, y = [], []

    def learn(page: Page, main: np.ndarray) -> None:
        nodes, rows = features(page)
        x.append(rows)
        y.append(node_labels(page, main)[nodes])

    rng = random.Random(7)
    for page, found, own in zip(read, main, blocks, strict=True):
        learn(page, found)
        for _ in range(LAYOUTS if own else 0):
            made = Page(laid_out(rng, own[: rng.choice((1, 2, 3, 30, 30, 30))], prose))  # short pages too
            learn(made, marked_by_layout(made))
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y).astype(float)) if x else BoostedTrees()


def decoded(parents: list[int], nodes: np.ndarray, probability: np.ndarray) -> list[bool]:
    """Of all consistent verdicts the most probable: none below a node without main text, some child below one with.

    parents: of all nodes of a page, parents before children; nodes: those with text, with their probability. Log-odds are
    summed, so a node without main text adds nothing.
    """
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    gain = dict(zip(nodes.tolist(), np.log(p / (1 - p)).tolist(), strict=True))
    order = sorted(gain, reverse=True)
    children: dict[int, list[int]] = {}
    for i in order:
        if parents[i] >= 0:
            children.setdefault(parents[i], []).append(i)
    best: dict[int, float] = {}  # of the subtree, if its root holds main text
    for i in order:
        below = [best[c] for c in children.get(i, ())]
        best[i] = gain[i] + (sum(b for b in below if b > 0) or max(below) if below else 0.0)
    out = [False] * len(parents)
    roots = [i for i in order if parents[i] < 0 and best[i] > 0]
    while roots:
        i = roots.pop()
        out[i] = True
        below = children.get(i, [])
        if below:
            top = max(below, key=lambda c: (best[c], -c))
            roots += [c for c in below if best[c] > 0 or c == top]
    return out


def main_texts(htmls: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(h) for h in htmls]
    found = [features(p) for p in pages]
    judged = model.probability(np.concatenate([x for _, x in found])) if found else np.zeros(0)
    out, at = [], 0
    for page, (nodes, _) in zip(pages, found, strict=True):
        verdicts = decoded(page.parents, nodes, judged[at : at + len(nodes)])
        at += len(nodes)
        keep = [leaf >= 0 and verdicts[leaf] for leaf in page.leaf_of]
        out.append("\n\n".join(block_texts(page, keep)))
    return out


def training_sample(pages: DataFrame, html: str = "html", most: int = TRAIN_PAGES) -> list[str]:
    """At most `most` whole pages of at most TRAIN_BYTES each, drawn by a hash of their html; equal pages count once."""
    total = pages.count()
    # a few times as many as are wanted pass the hash's threshold, so that tasks and driver hold no more than that
    share = min(1.0, 4 * most / max(total, 1))
    hashed = pages.select(F.col(html).alias("h")).where(F.octet_length("h").between(1, TRAIN_BYTES)).withColumn("x", F.xxhash64("h"))
    drawn = hashed.where(F.pmod("x", F.lit(1_000_003)) < F.lit(int(share * 1_000_003))).orderBy("x").limit(most)
    return list(dict.fromkeys(r["h"] for r in drawn.collect()))


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with the main text of each page and its length in code points.

    Null html counts as empty and has the empty text, like a page without main text; repeated pages get equal texts; columns
    named text or n_chars are replaced, all others stay; no rows give no rows. The whole page is read, however long. Character
    references are decoded, white space inside a block (a line break too) becomes one space, blocks are joined by an empty line.
    """
    model = fitted(training_sample(pages, html))
    kept = pages.drop(text, n_chars)
    at = kept.columns.index(html)
    schema = StructType([*kept.schema.fields, StructField(text, StringType()), StructField(n_chars, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            begin = 0
            while begin < batch.num_rows:
                own, size = [], 0
                while begin + len(own) < batch.num_rows and len(own) < SLICE_PAGES and size < SLICE_CHARS:
                    own.append(column[begin + len(own)].as_py() or "")
                    size += len(own[-1])
                texts = main_texts(own, model)
                part = batch.slice(begin, len(own))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*part.schema.names, text, n_chars])
                begin += len(own)

    return kept.mapInArrow(run, schema)
