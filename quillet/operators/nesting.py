"""Trees and dataflow in columns: nested sets by running sums, no parser and no Python.

Texts are dealt out once by their key and cut into tokens there; everything else is windows over a key's tokens in order.
An opening token counts +1, a closing one -1, and their running sum is the depth. A node's parent is the last node one level
up; the innermost of nested intervals around a place is found in the same way. All windows start with the key, so the tokens
are not dealt out again, and partitions of about a million characters (operators.dealing) keep what a task sorts small. A
text's tokens are one window: a single text of any length is sorted and spilled, never an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, WORD_CLASS
from .dealing import dealt

#: Elements that never hold anything.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What is no part of the tree: comments, and what scripts and styles hold.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
MARKUP = r"<[^>]*>|[^<]+"
TAG = r"^</?([A-Za-z][A-Za-z0-9]*)"
ROOT, TEXT = "#document", "#text"


def _prefix(w, upto: int = 0):
    return w.rowsBetween(Window.unboundedPreceding, upto)


def markup_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """pages (key, html) -> (key, node, type, depth, parent, internal): the tree of each page, nodes numbered in page order.

    Node 0 is the page itself, of depth 0 and without a parent; a null html has just that. Text between tags is a node unless
    it is white space. A tag ends at the first >. By each name tags match like brackets: an opening tag that is never matched
    is an empty element, so what follows stands beside it, and a closing tag without an opening one is left out. What remains
    is balanced, and a closing tag ends the innermost open element. Repeated keys are pooled: give each page its own.
    """
    clean = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, "")
    listed = F.concat(F.array(F.lit(ROOT)), F.regexp_extract_all(clean, F.lit(MARKUP), F.lit(0)))
    tokens = dealt(pages, key, F.col(html)).select(F.col(key).alias("key"), F.posexplode(listed).alias("at", "token"))
    name = F.lower(F.regexp_extract("token", TAG, 1))
    kind = F.when(F.col("at") == 0, ROOT).when(F.startswith("token", F.lit("<")), name).when(F.col("token").rlike(r"[^\x20\x09-\x0D]"), TEXT).otherwise("")
    sign = F.when(F.col("at") == 0, 0).when(F.startswith("token", F.lit("</")), -1).when(F.startswith("token", F.lit("<")) & ~F.col("type").isin(*VOID), 1).otherwise(0)
    tags = tokens.select("key", "at", "token", kind.alias("type")).where("type <> ''").select("key", "at", "type", sign.alias("sign"))
    tags = tags.where(~((F.col("sign") == -1) & F.col("type").isin(*VOID)))
    on, back = Window.partitionBy("key", "type").orderBy("at"), Window.partitionBy("key", "type").orderBy(F.desc("at"))
    low = lambda sums, w: F.least(F.lit(0), F.coalesce(F.min(sums).over(_prefix(w, -1)), F.lit(0)))
    # a closing tag below all before it has no opening one, and the reverse
    summed = tags.withColumn("s", F.sum("sign").over(_prefix(on))).withColumn("low", low("s", on))
    kept = summed.where((F.col("sign") >= 0) | (F.col("s") >= F.col("low"))).select("key", "at", "type", "sign")
    summed = kept.withColumn("s", F.sum(-F.col("sign")).over(_prefix(back))).withColumn("low", low("s", back))
    delta = F.when((F.col("sign") == 1) & (F.col("s") < F.col("low")), 0).otherwise(F.col("sign"))
    events = summed.select("key", "at", "type", "sign", delta.alias("delta"))
    page = Window.partitionBy("key").orderBy("at")
    depth = F.coalesce(F.sum("delta").over(_prefix(page, -1)), F.lit(0)) + F.when(F.col("at") == 0, 0).otherwise(1)
    nodes = events.withColumn("depth", depth).where("sign >= 0")
    nodes = nodes.select("key", F.col("at").alias("node"), "type", "depth", (F.lead("depth").over(page) > F.col("depth")).alias("internal"))
    return with_parents(nodes).select(F.col("key").alias(key), "node", "type", "depth", "parent", F.coalesce("internal", F.lit(False)).alias("internal"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes (key, node, depth, ...) in pre-order, with parent: the last node one level up."""
    # each node stands at its own level and asks one level up
    both = nodes.withColumn("level", F.explode(F.array("depth", F.col("depth") - 1)))
    own = F.when(F.col("level") == F.col("depth"), F.col("node"))
    up = Window.partitionBy("key", "level").orderBy("node", F.desc("level"))
    return both.withColumn("parent", F.last(own, ignorenulls=True).over(_prefix(up, -1))).where("level = depth - 1").drop("level")


def node_census(nodes: DataFrame, key: str) -> DataFrame:
    """(key, n_nodes, n_internal, n_leaves) over the rows of markup_nodes()."""
    return nodes.groupBy(key).agg(F.count("*").alias("n_nodes"), F.count_if("internal").alias("n_internal"), F.count_if(~F.col("internal")).alias("n_leaves"))


_OPERATOR = r"(?:[-+*/%&|^]|\?\?|<<|>>)?"
#: Comments, strings, numbers, identifiers, comparisons and arrows, assignments, white space, and single characters.
CODE = rf"//[^\n]*|(?s:/\*.*?\*/)|\"[^\"\\]*(?:(?s:\\.)[^\"\\]*)*\"|'[^'\\]*(?:(?s:\\.)[^'\\]*)*'|\p{{Nd}}[{WORD_CLASS}.]*|[\p{{L}}_][{WORD_CLASS}]*|{_OPERATOR}=[=>]|{_OPERATOR}=|[{SPACE_CLASS}]+|(?s:.)"
#: Node types that scores count; all but those of brackets always have children.
PROGRAM, ASSIGNMENT, CALL = "program", "assignment_expression", "call_expression"
BRACKETS = {"(": "arguments", "[": "list", "{": "block"}


def _kind(token: Column) -> Column:
    """c comment or space, n line end, i identifier, o and x brackets, a assignment, e end, v anything else."""
    starts = lambda p: token.rlike(p)
    return (
        F.when(starts(r"^//|(?s)^/\*.*\*/$"), "c").when(starts(rf"^[{SPACE_CLASS}]"), F.when(F.contains(token, F.lit("\n")), "n").otherwise("c"))
        .when(starts(r"^[\p{L}_]"), "i").when(token.isin("(", "[", "{"), "o").when(token.isin(")", "]", "}"), "x").when(token.isin(";", ","), "e")
        .when(starts(rf"^{_OPERATOR}=$"), "a").otherwise("v")
    )


def code_tokens(codes: DataFrame, key: str, code: str) -> DataFrame:
    """codes (key, code) -> (key, at, token, kind, before, behind, level): tokens that are no comment or plain space.

    before and behind are the neighbours' kinds, level the number of open brackets around a token (an opening bracket is
    inside itself). A closing bracket without an open one opens nothing below zero.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(code), F.lit("")), F.lit(CODE), F.lit(0))
    tokens = dealt(codes, key, F.col(code)).select(F.col(key).alias("key"), F.posexplode(found).alias("at", "token"))
    tokens = tokens.select("key", "at", "token", _kind(F.col("token")).alias("kind")).where("kind <> 'c'")
    w = Window.partitionBy("key").orderBy("at")
    sign = F.when(F.col("kind") == "o", 1).when(F.col("kind") == "x", -1).otherwise(0)
    tokens = tokens.select("*", sign.alias("sign"), F.lag("kind").over(w).alias("before"), F.lag("token").over(w).alias("named"), F.lead("kind").over(w).alias("behind"))
    tokens = tokens.withColumn("s", F.sum("sign").over(_prefix(w)))
    depth = F.col("s") - F.least(F.lit(0), F.min("s").over(_prefix(w)))
    tokens = tokens.withColumn("after", depth)
    level = F.when(F.col("kind") == "o", F.col("after")).otherwise(F.coalesce(F.lag("after").over(w), F.lit(0)))
    return tokens.withColumn("level", level).drop("sign", "s", "after")


def code_labels(tokens: DataFrame, key: str) -> DataFrame:
    """(key, label) of every internal node over the rows of code_tokens(): the program, assignments, calls, brackets that hold something."""
    w = Window.partitionBy("key").orderBy("at")
    made = tokens.where("kind in ('i', 'o', 'a', 'v', 'x')")
    inside = F.lead("kind").over(w)
    made = made.select("key", "at", "token", "kind", "before", inside.alias("inside"), F.row_number().over(Window.partitionBy("key").orderBy(F.col("kind") == "x", "at")).alias("place"))
    name = F.lit(None).cast("string")
    for opened, label in BRACKETS.items():
        name = F.when(F.col("token") == opened, label).otherwise(name)
    labels = F.array_compact(
        F.array(
            F.when((F.col("place") == 1) & (F.col("kind") != "x"), PROGRAM),
            F.when((F.col("kind") == "a") & (F.col("before") == "i"), ASSIGNMENT),
            F.when((F.col("kind") == "o") & (F.col("token") == "(") & (F.col("before") == "i"), CALL),
            F.when((F.col("kind") == "o") & (F.col("inside") != "x"), name),
        )
    )
    return made.select(F.col("key").alias(key), F.explode(labels).alias("label"))


def code_edges(tokens: DataFrame, key: str) -> DataFrame:
    """(key, source, target), distinct, over the rows of code_tokens(): from the identifiers on the right of an assignment to its target.

    An assignment, which needs something on its right, reaches to the next line end, comma, semicolon or closing bracket at
    its level; the arguments of a call reach to their closing bracket. The innermost of these around an identifier decides:
    inside arguments there is no target. Targets are no sources, and nothing is an edge to itself.
    """
    back = Window.partitionBy("key", "level").orderBy(F.desc("at"))
    at = F.col("at")
    nearest = lambda found: F.last(F.when(found, at), ignorenulls=True).over(_prefix(back, -1))
    ends = tokens.select("*", nearest(F.col("kind").isin("e", "n", "x")).alias("end"), nearest(F.col("kind") == "x").alias("close"))
    w = Window.partitionBy("key").orderBy("at")
    assigns = (F.col("kind") == "a") & (F.col("before") == "i") & F.col("behind").isNotNull() & (F.lead("at").over(w) < F.coalesce("end", F.lit(1 << 31)))
    calls = (F.col("kind") == "o") & (F.col("token") == "(") & (F.col("before") == "i")
    spans = ends.withColumn("assigns", F.coalesce(assigns, F.lit(False))).withColumn("calls", calls)
    spans = spans.withColumn("is_target", F.coalesce(F.lead("assigns").over(w), F.lit(False)))
    spans = spans.where("assigns or calls or (kind = 'i' and not is_target)").select("key", "at", "token", F.when(F.col("assigns"), F.col("named")).alias("target"), (F.col("assigns") | F.col("calls")).alias("opens"), F.when(F.col("assigns"), F.col("end")).otherwise(F.col("close")).alias("until"))
    # +1 where an interval begins and -1 where it ends: the innermost around a place is the last that began at this depth
    event = lambda place, delta: F.struct(place.cast("long").alias("place"), F.lit(delta).alias("delta"))
    both = F.when(F.col("opens"), F.array_compact(F.array(event(at, 1), F.when(F.col("until").isNotNull(), event(F.col("until"), -1))))).otherwise(F.array(event(at, 0)))
    events = spans.select("key", "token", "target", F.explode(both).alias("e")).select("key", "token", "target", "e.place", "e.delta")
    events = events.withColumn("depth", F.sum("delta").over(_prefix(Window.partitionBy("key").orderBy("place"))))
    around = Window.partitionBy("key", "depth").orderBy("place")
    began = F.when(F.col("delta") == 1, F.struct("target"))
    found = events.withColumn("inner", F.last(began, ignorenulls=True).over(_prefix(around))["target"]).where("delta = 0 and depth > 0 and inner is not null and inner <> token")
    return found.select(F.col("key").alias(key), F.col("token").alias("source"), F.col("inner").alias("target")).distinct()
