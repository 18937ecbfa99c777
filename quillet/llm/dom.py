"""HTML as a tree of nodes that hold text, and numbers that tell main text from the rest.

The reader follows what browsers do where it matters here: tags may be missing or never closed, scripts and styles are no
text, a paragraph ends where a block begins. Nodes are blocks, inline elements that bear a class or id, and the runs of text
between them; nodes without text are left out of the numbers. It is linear in the page and keeps no state across pages.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?|<[!?/][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is taken for no text, up to their end tag.
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "math", "select")
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul button".split())
#: Table parts that a start tag closes, and those beyond which it looks no further.
CLOSES = {"tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
CLOSES |= {x: (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)) for x in ("thead", "tbody", "tfoot")}
#: Blocks that end an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "li", "dd", "dt", "legend", "summary", "button"}
P_SCOPE = frozenset(("table", "td", "th", "caption", "button", "body", "html"))
#: List items, each with those that it ends, and the lists that hold them.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
LISTS = frozenset(("ul", "ol", "menu", "dir", "dl"))

GROUPS = (("article",), ("main",), ("section",), ("div", "center"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("li",), ("ul", "ol", "menu", "dir", "dl", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend", "button", "search", "dialog"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre", "figure", "figcaption", "details", "summary"), ("body", "html"), ("#text",))
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
OTHER = len(GROUPS)
#: Words in attributes, by what they say of an element.
SAYS = (
    "article content main post entry story body text blog prose hentry articlebody",
    "comment comments commentlist reply replies respond disqus discussion thread feedback responses",
    "ad ads advert adverts advertisement advertising adsense adsbygoogle adslot sponsor sponsored promo promotion promoted banner",
    "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager sitemap skip",
    "header masthead topbar logo brand branding toolbar",
    "footer foot bottom copyright legal colophon contentinfo imprint",
    "sidebar side aside widget widgets related recommended recommendations popular trending rail teaser complementary",
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog subscribe newsletter paywall warning disclaimer",
    "share sharing social follow tweet tags meta rating",
    "form search login signin signup register poll contact",
    "hidden none",
)
SAID = {word: 1 << i for i, words in enumerate(SAYS) for word in words.split()}
TAG_BITS = {tag: 1 << i for i, tag in enumerate(("article", "main", "nav", "header", "footer", "aside", "form", "table", "li", "section"))}
N_SAYS, N_TAGS = len(SAYS), len(TAG_BITS)


@lru_cache(maxsize=20_000)
def said(attributes: str) -> tuple[int, bool]:
    """What the words of an element's attributes say, and whether it bears a class or id."""
    mask, named = 0, False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        named |= name in ("class", "id")
        if name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none", value):
            mask |= SAID["hidden"]
        elif name not in ("style", "aria-hidden"):
            for word in WORD.findall(value):
                mask |= SAID.get(word.lower(), 0)
    return mask, named


class Page:
    """Nodes in page order (parents first) and the pieces of text that they own."""

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.own, self.above, self.above_tags, self.marks = ["body"], [-1], [0], [0], [0], [0], [""]
        self.pieces: list[tuple[int, int, str, bool]] = []  # owner, block, text, in a link
        self._read(html)
        self._leaves()

    def _read(self, html: str) -> None:
        tags, pieces = self.tags, self.pieces
        # open elements: (tag, node or that of the element around, links around, open paragraph and list item in reach)
        stack: list[tuple[str, int, int, int, int]] = [("body", 0, 0, 0, 0)]
        opened = Counter(["body"])
        block, at, end = 0, 0, len(html)

        def text(upto: int) -> None:
            if at < upto:
                piece = html[at:upto]
                pieces.append((stack[-1][1], block, unescape(piece) if "&" in piece else piece, stack[-1][2] > 0))

        def close(down_to: int) -> None:
            nonlocal block
            if any(x[0] in BLOCKS for x in stack[down_to:]):
                block += 1
            opened.subtract(x[0] for x in stack[down_to:])
            del stack[down_to:]

        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                text(end)
                break
            text(m.start())
            at = max(m.end(), m.start() + 1)
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                for i in range(len(stack) - 1 if opened[tag] > 0 else 0, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if tag not in BLOCKS and stack[i][0] in BLOCKS:
                        break  # a stray inline end tag closes no block
                continue
            if tag in RAW:
                over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = over.end() if over and not m[3].endswith("/") else at if m[3].endswith("/") else end
                if tag not in ("script", "style", "template", "title"):
                    pieces.append((stack[-1][1], block, " ", False))
                continue
            if tag == "br" or tag in VOID:
                if tag == "hr":
                    block += 1
                pieces.append((stack[-1][1], block, " ", False))
                continue
            if tag in ("html", "body", "head"):
                continue
            if tag in CLOSES:
                closed, scope = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in closed:
                        close(i)
                        if tag not in ("thead", "tbody", "tfoot", "tr"):
                            break
            elif tag in ITEMS:
                item = stack[-1][4]
                if item and stack[item][0] in ITEMS[tag]:
                    close(item)
            elif tag in ENDS_P and stack[-1][3]:
                close(stack[-1][3])
            mask, named = said(m[3]) if m[3] else (0, False)
            node, links = stack[-1][1], stack[-1][2] + (tag == "a")
            if tag in BLOCKS or named and tag not in ("a",):
                if tag in BLOCKS:
                    block += 1
                node = self._add(tag, node, mask, m[3])
            if not m[3].endswith("/") or tag in BLOCKS:
                p, item = (0 if tag in P_SCOPE else stack[-1][3]), (0 if tag in LISTS else stack[-1][4])
                stack.append((tag, node, links, len(stack) if tag == "p" else p, len(stack) if tag in ITEMS else item))
                opened[tag] += 1

    def _add(self, tag: str, parent: int, mask: int, attributes: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.own.append(mask)
        self.above.append(self.above[parent] | self.own[parent])
        self.above_tags.append(self.above_tags[parent] | TAG_BITS.get(self.tags[parent], 0))
        self.marks.append(attributes)
        return len(self.tags) - 1

    def _leaves(self) -> None:
        """Runs of text become nodes of their own where their owner has others beside them. leaf_of: the leaf of each piece."""
        inner = {p for p in self.parents if p >= 0}
        runs: dict[int, set[int]] = {}
        for owner, block, text, _ in self.pieces:
            if not text.isspace():
                runs.setdefault(owner, set()).add(block)
        leaves: dict[tuple[int, int], int] = {}
        self.leaf_of = []
        for owner, block, text, _ in self.pieces:
            if text.isspace():
                self.leaf_of.append(-1)
                continue
            if owner not in inner and len(runs[owner]) == 1:
                self.leaf_of.append(owner)
                continue
            if (owner, block) not in leaves:
                leaves[owner, block] = self._add("#text", owner, 0, "")
            self.leaf_of.append(leaves[owner, block])


COUNTS = ("chars", "words", "links", "marks", "digits", "leaves")
NUMBERS = 18
N_FEATURES = 2 * (OTHER + 1) + 2 * N_SAYS + N_TAGS + NUMBERS


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(nodes with text, their features): tag and the parent's, attribute words here and above, elements above, numbers of the
    subtree, its depth, its place and its siblings."""
    n = len(page.tags)
    parents = np.array(page.parents)
    sums = np.zeros((n, len(COUNTS)))
    first, last = np.full(n, np.inf), np.zeros(n)
    seen = set()
    upto = 0
    for leaf, (_, _, text, link) in zip(page.leaf_of, page.pieces, strict=True):
        if leaf < 0:
            continue
        size = len(text)
        sums[leaf] += (size, text.count(" ") + 1, size if link else 0, text.count(". ") + text.count(", ") + text.endswith((".", "!", "?")), sum(map(text.count, "0123456789")), leaf not in seen)
        seen.add(leaf)
        first[leaf] = min(first[leaf], upto)
        upto += size
        last[leaf] = upto
    nodes = np.ones(n)
    order = np.array(page.depths).argsort(kind="stable")[::-1]
    rows = order[parents[order] >= 0].tolist()
    for i in rows:  # children before parents
        p = page.parents[i]
        sums[p] += sums[i]
        nodes[p] += nodes[i]
        if first[i] < first[p]:
            first[p] = first[i]
        if last[i] > last[p]:
            last[p] = last[i]
    full = np.flatnonzero(sums[:, 0] > 0)
    chars, words, links, marks, digits, leaves = sums[full].T
    total = max(sums[0, 0], 1)
    up = parents[full]
    group = np.array([GROUP_OF.get(t, OTHER) for t in page.tags])
    # siblings with text
    siblings, same = np.zeros(n + 1), np.zeros((n + 1, OTHER + 1))
    weight, index = np.zeros(n + 1), np.zeros(len(full))
    np.add.at(siblings, up, 1)
    np.add.at(weight, up, chars)
    np.add.at(same, (up, group[full]), 1)
    count: dict[int, int] = {}
    for k, p in enumerate(up.tolist()):
        index[k] = count.get(p, 0)
        count[p] = count.get(p, 0) + 1
    children = siblings[full]
    beside = siblings[up]
    one_hot = np.zeros((len(full), 2 * (OTHER + 1)))
    one_hot[np.arange(len(full)), group[full]] = 1
    one_hot[np.arange(len(full)), OTHER + 1 + np.where(up >= 0, group[up], group[0])] = 1
    bits = lambda values, k: (np.array(values)[full, None] >> np.arange(k)) & 1
    numbers = (
        np.array(page.depths)[full], np.log1p(chars), np.log1p(words), links / chars, chars / nodes[full], chars / total, marks / words,
        digits / chars, leaves, words / leaves, children, beside, index / beside, chars * beside / np.maximum(weight[up], 1),
        same[up, group[full]] / beside, first[full] / total, last[full] / total, np.full(len(full), np.log1p(total)),
    )
    return full, np.concatenate([one_hot, bits(page.own, N_SAYS), bits(page.above, N_SAYS), bits(page.above_tags, N_TAGS), np.stack(numbers, axis=1)], axis=1)
