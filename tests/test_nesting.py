"""Trees and edges in columns against a stack and the walk of the Python parser; texts against Python's own functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillet.functions import text
from quillet.operators import nesting, trees


def stack_tree(html):
    """(type, depth, parent, internal) in page order, by the rule that tags of a name match like brackets."""
    tokens = re.findall(nesting.MARKUP, re.sub(nesting.HIDDEN, "", html or ""))
    events, open_by_name = [], {}
    for token in tokens:
        if not token.startswith("<"):
            if token.strip(" \t\n\x0b\f\r"):
                events.append([nesting.TEXT, 0])
            continue
        m = re.match(nesting.TAG, token)
        if not m:
            continue
        name = m[1].lower()
        if name in nesting.VOID:
            if not token.startswith("</"):
                events.append([name, 0])
        elif token.startswith("</"):
            if open_by_name.get(name):
                events[open_by_name[name].pop()][1] = 1
                events.append([name, -1])
        else:
            events.append([name, 0])
            open_by_name.setdefault(name, []).append(len(events) - 1)
    nodes, stack = [[nesting.ROOT, 0, None, False]], [0]
    for name, delta in events:
        if delta < 0:
            stack.pop()
            continue
        nodes[stack[-1]][3] = True
        nodes.append([name, len(stack), stack[-1], False])
        if delta:
            stack.append(len(nodes) - 1)
    return [tuple(n) for n in nodes]


def random_page(r):
    parts = ["<p>", "</p>", "<b>", "</b>", "<DIV class='x y'>", "</div>", "<br>", "</br>", "text", " \n", "<!-- <p> -->", "<script>a < b; '</p>'</script>", "<img src=a>", "<li>", "</li>", "</ul >", "<ul>", "<!DOCTYPE html>", "3 < 4", "<"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 40)))


def test_markup_nodes(spark):
    r = random.Random(1)
    pages = [None, "", "plain", "<p><b>a<br><p>c</p>", "</p></p><p>", "<b><p></b></p>", "<div>" * 300 + "x" + "</div>" * 299] + [random_page(r) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string").withColumn("key", F.lit("extra")).withColumn("at", F.lit(1))
    found = {}
    for row in nesting.markup_nodes(df, "page", "html").orderBy("page", "node").collect():
        found.setdefault(row["page"], []).append(row)
    for page, html in enumerate(pages):
        rows = found[page]
        place = {row["node"]: i for i, row in enumerate(rows)}
        assert [(row["type"], row["depth"], place.get(row["parent"]), row["internal"]) for row in rows] == stack_tree(html), html
    assert nesting.markup_nodes(df.where("false"), "page", "html").collect() == []


def test_markup_is_one_exchange(spark):
    df = spark.createDataFrame([(1, "<p>")], "page int, html string")
    plan = nesting.node_census(nesting.markup_nodes(df, "page", "html"), "page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def random_code(r):
    parts = ["a", "b", "été", "x1", "_y", " = ", " == ", "=>", "+= ", "!=", "(", ")", "[", "]", "{", "}", ",", ";", "\n", " ", " \t", "// c = d\n", "/* e = f\n */", "'s = t'", '"u \\" v"', "3.5e", "+", ".", "??=", "'", "f(", "g (", " = h(", "\xa0"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 45)))


@pytest.fixture(scope="module")
def codes():
    r = random.Random(2)
    fixed = [None, "", "a = b = c;", "x = f(b, c = d);\ny = x", "a =", "x = a = ;", "f(a = (b + c), d)[e = g]", ")a = b) = c", "a[i] = b; c = a[i]", "a = {b: c\n, d = e}", "a = a + b", "// a = b", "a /* c */ = /* d */ b"]
    return fixed + [random_code(r) for _ in range(300)]


def test_edges_and_labels(spark, codes):
    df = spark.createDataFrame(list(enumerate(codes)), "key int, code string").withColumn("token", F.lit("extra"))
    tokens = nesting.code_tokens(df, "key", "code")
    edges, labels = {}, {}
    for row in nesting.code_edges(tokens, "key").collect():
        edges.setdefault(row["key"], []).append((row["source"], row["target"]))
    for row in nesting.code_labels(tokens, "key").collect():
        labels.setdefault(row["key"], []).append(row["label"])
    for key, code in enumerate(codes):
        nodes = trees.parse_code(code or "")
        assert sorted(edges.get(key, [])) == sorted(trees.edges_of(code or "", nodes)), code
        assert sorted(labels.get(key, [])) == sorted(trees.internal_labels(nodes)), code


def test_tokens_and_spaces_of_all_scripts(spark):
    texts = ["a b c\u0085d", "x​y \x1c z", "é_1 ２ ☃☃", "　", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    padded = F.concat(F.lit(" \x85 "), "t", F.lit("  \n\n"))
    for t, row in zip(texts, df.select(text.tokenize(F.col("t")).alias("k"), text.strip(padded).alias("s")).collect(), strict=True):
        assert row["k"] == re.findall(r"\w+|[^\w\s]", t) and row["s"] == t.strip()


@pytest.mark.parametrize("places", [0, 2, 4])
def test_decimals(spark, places):
    r = random.Random(3)
    values = [0.03125, 0.15625, 0.09375, 0.00015, 0.00005, -0.0, 0.0, -0.00001, 1e-300, 0.5, 2.5, 0.99995, 9999.99995, float("nan"), float("inf"), -float("inf"), 8e11, 2 / 3]
    values += [r.random() * 10 ** r.randint(-6, 8) * r.choice((1, -1)) for _ in range(500)] + [(2 * k + 1) / 32 for k in range(-100, 100)] + [round(r.random(), 5) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    got = [row["s"] for row in df.select(text.decimals(F.col("v"), places).alias("s")).collect()]
    assert got == [*(f"{v:.{places}f}" for v in values), None]


def test_partitions_grow_with_the_texts(spark):
    """About a million characters a partition, which adaptive execution leaves as they are."""
    df = spark.range(40).select("id", F.repeat(F.lit("x"), 100_000).alias("t")).coalesce(1)
    assert nesting.code_tokens(df, "id", "t").rdd.getNumPartitions() == 4
    assert nesting.markup_nodes(df, "id", "t").rdd.getNumPartitions() == 4
