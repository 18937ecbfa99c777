"""Parse trees as rows. Parsers are Python; everything after them is columns.

A parser maps a text to nodes (type, start, end, parent), offsets in characters, parents before children, the root with
parent -1. HTML and JSON use the standard library. Dart and Swift use a small parser of brackets, calls and assignments
with the node types that the edge rules name; its other labels are its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

Nodes = list[tuple[str, int, int, int]]
#: A tree as parallel arrays, a place a node: these pass between Python and the JVM far faster than an array of structs.
COLUMNS = ("start", "end", "parent", "children")
TREE = StructType([StructField("type", ArrayType(StringType())), *[StructField(n, ArrayType(IntegerType())) for n in COLUMNS]])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Node types that the edge rules name, for parsers that yield them.
IDENTIFIERS = ("identifier", "simple_identifier")
ASSIGNMENTS = ("assignment_expression", "variable_declaration", "initialized_identifier", "pattern_assignment")
CALLS = ("call_expression", "method_invocation")


def parse_html(text: str) -> Nodes:
    nodes: Nodes = [("document", 0, len(text), -1)]
    lines = [0]
    for line in text.split("\n"):
        lines.append(lines[-1] + len(line) + 1)
    stack = [0]

    class Reader(HTMLParser):
        def place(self) -> int:
            row, col = self.getpos()
            return min(lines[row - 1] + col, len(text))

        def handle_starttag(self, tag: str, attrs: list) -> None:
            nodes.append((tag, self.place(), self.place(), stack[-1]))
            if tag not in VOID:
                stack.append(len(nodes) - 1)

        def handle_endtag(self, tag: str) -> None:
            for at in range(len(stack) - 1, 0, -1):
                if nodes[stack[at]][0] == tag:
                    t, s, _, p = nodes[stack[at]]
                    nodes[stack[at]] = (t, s, self.place(), p)
                    del stack[at:]
                    return

        def handle_data(self, data: str) -> None:
            if data.strip():
                nodes.append(("text", self.place(), self.place() + len(data), stack[-1]))

    Reader().feed(text)
    return nodes


def parse_json(text: str) -> Nodes:
    nodes: Nodes = []
    todo = [(json.loads(text), -1)]
    while todo:
        value, parent = todo.pop()
        nodes.append((type(value).__name__, 0, len(text), parent))
        if isinstance(value, dict | list):
            todo += [(v, len(nodes) - 1) for v in (value.values() if isinstance(value, dict) else value)]
    return nodes


LEXER = re.compile(r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<number>\d[\w.]*)|(?P<identifier>[^\W\d]\w*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<assign>(?:[-+*/%&|^]|\?\?|<<|>>)?=(?![=>]))|(?P<end>[;,])|(?P<other>=>|==|.)", re.S)
BRACKET = {"(": "arguments", "[": "list", "{": "block"}


def parse_code(text: str) -> Nodes:
    """Statements, brackets, calls (identifier and arguments), assignments (identifier first, then its right side)."""
    nodes: Nodes = [("program", 0, len(text), -1)]
    stack, last, line_end = [0], None, False  # last: the identifier just read, which a call or assignment may take over

    def add(kind: str, s: int, e: int) -> int:
        nodes.append((kind, s, e, stack[-1]))
        return len(nodes) - 1

    def wrap(kind: str, child: int) -> int:
        """The node at child moves under a new node of this kind in its place."""
        t, s, e, p = nodes[child]
        nodes[child] = (kind, s, e, p)
        nodes.append((t, s, e, child))
        return child

    def leave(kinds: tuple[str, ...]) -> None:
        while len(stack) > 1 and nodes[stack[-1]][0] in kinds:
            stack.pop()

    for m in LEXER.finditer(text):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "space":
            if "\n" in m[0] and not m[0].startswith("/*"):
                leave(("assignment_expression", "call_expression"))
                last = None
        elif kind == "identifier":
            last = add("identifier", s, e)
        elif kind == "open":
            if m[0] == "(" and last is not None:
                stack.append(wrap("call_expression", last))
            stack.append(add(BRACKET[m[0]], s, e))
            last = None
        elif kind == "close":
            leave(("assignment_expression", "call_expression"))
            if len(stack) > 1:
                stack.pop()
            leave(("call_expression",))
            last = None
        elif kind == "assign" and last is not None:
            stack.append(wrap("assignment_expression", last))
            last = None
        elif kind == "end":
            leave(("assignment_expression", "call_expression"))
            last = None
        else:
            add({"string": "string", "number": "number"}.get(kind, "operator"), s, e)
            last = None
    return nodes


PARSERS: dict[str, Callable[[str], Nodes]] = {"html": parse_html, "json": parse_json, "dart": parse_code, "swift": parse_code}


def parsed(text: Column, language: str, parsers: dict[str, Callable[[str], Nodes]] = PARSERS) -> Column:
    """The tree of a text, with each node's number of children; empty where the parser fails or the text is null."""
    parse = parsers[language]

    def safe(x: str | None) -> tuple:
        try:
            nodes = parse(x) if x else []
        except Exception:  # a text that does not parse has no tree
            nodes = []
        if not nodes:
            return [], *[np.zeros(0, np.int32)] * 4
        types, start, end, parent = zip(*nodes, strict=True)
        parent = np.array(parent, np.int32)
        children = np.bincount(parent[parent >= 0], minlength=len(nodes)).astype(np.int32)
        return list(types), np.array(start, np.int32), np.array(end, np.int32), parent, children

    @F.pandas_udf(TREE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            columns = list(zip(*map(safe, texts), strict=True)) or [()] * 5
            yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("type", *COLUMNS), columns, strict=True)})

    return run(text)


def node_rows(trees: DataFrame, nodes: str = "nodes") -> DataFrame:
    """trees (key columns, nodes) -> one row a node with node_id, type, start, end, parent, internal."""
    keys = [c for c in trees.columns if c != nodes]
    zipped = F.arrays_zip(*[F.col(f"{nodes}.{n}").alias(n) for n in ("type", *COLUMNS)])
    each = trees.select(*keys, F.posexplode(zipped).alias("node_id", "n"))
    return each.select(*keys, "node_id", "n.type", "n.start", "n.end", "n.parent", (F.col("n.children") > 0).alias("internal"))


def internal_types(nodes: Column) -> Column:
    """Types of the nodes that have children, parents first."""
    return F.filter(nodes["type"], lambda t, i: F.get(nodes["children"], i) > 0)


def add_edges(text: str, nodes: Nodes, out: set[tuple[str, str]]) -> None:
    """Adds to out the edges from identifiers on the right side of an assignment to its target.

    A nested assignment takes over as the target of its own part; arguments of a call have no target. Where a node's
    offsets make no sense this raises; what was found before stays in out.
    """
    kids: list[list[int]] = [[] for _ in nodes]
    for i, n in enumerate(nodes):
        if n[3] >= 0:
            kids[n[3]].append(i)
    name = lambda i: text[nodes[i][1] : nodes[i][2]]
    todo = [(0, None)] if nodes else []
    while todo:
        i, target = todo.pop()
        kind = nodes[i][0]
        if kind in IDENTIFIERS:
            if target is not None and name(i) != target:
                out.add((name(i), target))
        elif kind in ASSIGNMENTS and len(kids[i]) >= 2 and nodes[kids[i][0]][0] in IDENTIFIERS:
            todo += [(k, name(kids[i][0])) for k in kids[i][1:][::-1]]
            continue
        if kind in CALLS:
            todo += [(k, None if nodes[k][0] == "arguments" else target) for k in kids[i][::-1]]
        else:
            todo += [(k, target) for k in kids[i][::-1]]


def edges_of(text: str, nodes: Nodes) -> set[tuple[str, str]]:
    """All edges; where a node is faulty, those of the nodes before it."""
    return edges_and_fault(text, nodes)[0]


def edges_and_fault(text: str, nodes: Nodes) -> tuple[set[tuple[str, str]], str | None]:
    """edges_of(), and the name of what went wrong, if anything did."""
    out: set[tuple[str, str]] = set()
    try:
        add_edges(text, nodes, out)
    except Exception as e:  # the edges found so far count
        return out, f"edges: {type(e).__name__}"
    return out, None


def internal_labels(nodes: Nodes) -> list[str]:
    """Types of the nodes that have children."""
    parents = {n[3] for n in nodes}
    return [n[0] for i, n in enumerate(nodes) if i in parents]


_EDGES = ArrayType(StructType([StructField("source", StringType()), StructField("target", StringType())]))
_SIDE = StructType([StructField("labels", ArrayType(StringType())), StructField("edges", _EDGES), StructField("fault", StringType())])


def analysed(ref: Column, hyp: Column, language: Column, parsers: dict[str, Callable[[str], Nodes]] = PARSERS) -> Column:
    """Struct (ref, hyp) of structs (labels of internal nodes, sorted edges, fault): each text is parsed once, all in one pass.

    A text that is null, empty or does not parse, or has no language, has no labels and no edges. fault says what failed
    (`tree: ` or `edges: ` and the error's name), so that a default can be told from a score.
    """

    def side(x: str | None, name: str | None) -> dict:
        fault = None
        try:
            nodes = parsers[name](x) if x and name else []
        except Exception as e:  # no tree
            nodes, fault = [], f"tree: {type(e).__name__}"
        edges, later = edges_and_fault(x or "", nodes)
        return {"labels": internal_labels(nodes), "edges": [{"source": a, "target": b} for a, b in sorted(edges)], "fault": fault or later}

    @F.pandas_udf(StructType([StructField("ref", _SIDE), StructField("hyp", _SIDE)]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for refs, hyps, names in batches:
            yield pd.DataFrame({"ref": list(map(side, refs, names)), "hyp": list(map(side, hyps, names))})

    return run(ref, hyp, language)


def code_is_whole(text: str) -> bool:
    """Every bracket is closed by its own kind and every string ends: what the parser can tell of an error."""
    stack, close = [], {")": "(", "]": "[", "}": "{"}
    for m in LEXER.finditer(text):
        if m.lastgroup == "open":
            stack.append(m[0])
        elif m.lastgroup == "close":
            if not stack or stack.pop() != close[m[0]]:
                return False
        elif m.lastgroup == "other" and m[0] in "\"'":
            return False
    return not stack


#: For each language, in the order in which a tie tries them, whether a text parses without errors.
CHECKS: dict[str, Callable[[str], bool]] = {"dart": code_is_whole, "swift": code_is_whole}


def first_to_parse(text: Column, checks: dict[str, Callable[[str], bool]] = CHECKS) -> Column:
    """The first language in which a text parses without errors, or null."""

    def first(x: str | None) -> str | None:
        return next((name for name, check in checks.items() if check(x or "")), None)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([first(x) for x in texts], dtype=object)

    return run(text)
