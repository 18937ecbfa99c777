"""Registered queries over trees of pages and of code, and their DuckDB SQL.

The SQL numbers nested sets in its own way (matched pairs of tags and brackets, correlated searches), so that it checks the
windows of operators.nesting and the walk of operators.trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import multiset, nesting
from .plans.pairs import pair_number
from .registry import query, table


def quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_VOID = quoted(*nesting.VOID)

#: CTEs that end in nodes (page_id, node, type, depth, internal).
MARKUP_SQL = rf"""
mk AS (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '{nesting.HIDDEN}', '', 'g'), '{nesting.MARKUP}') AS t FROM pages),
mt AS (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM mk),
mn AS (SELECT page_id, pos, CASE WHEN token LIKE '<%' THEN lower(regexp_extract(token, '{nesting.TAG}', 1)) WHEN regexp_matches(token, '[^\x20\x09-\x0D]') THEN '{nesting.TEXT}' ELSE '' END AS type, token LIKE '</%' AS closes, token LIKE '<%' AS tag FROM mt),
mg AS (SELECT page_id, pos, type, CASE WHEN NOT tag OR type IN ({_VOID}) THEN 0 WHEN closes THEN -1 ELSE 1 END AS sign FROM mn WHERE type <> '' AND NOT (closes AND type IN ({_VOID}))),
ms AS (SELECT *, sum(sign) OVER (PARTITION BY page_id, type ORDER BY pos) AS s FROM mg),
-- the level between an opening tag and its closing one: both see the same sum, and they alternate
ml AS (SELECT *, CASE WHEN sign = 1 THEN s ELSE s + 1 END AS lv, min(s) OVER (PARTITION BY page_id, type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM ms),
mp AS (SELECT *, lead(sign) OVER (PARTITION BY page_id, type, lv ORDER BY pos) AS next_sign FROM ml WHERE sign <> 0 AND NOT (sign = -1 AND s < least(0, coalesce(low, 0)))),
me AS (SELECT page_id, pos, type, sign, CASE WHEN sign = 1 AND coalesce(next_sign, 1) <> -1 THEN 0 ELSE sign END AS delta FROM mp UNION ALL SELECT page_id, pos, type, 0 AS sign, 0 AS delta FROM mg WHERE sign = 0),
md AS (SELECT page_id, pos, type, sign, delta, sum(delta) OVER (PARTITION BY page_id ORDER BY pos) AS after FROM me),
nodes AS (SELECT page_id, pos AS node, type, after - delta + 1 AS depth, coalesce(lead(after - delta + 1) OVER (PARTITION BY page_id ORDER BY pos) > after - delta + 1, false) AS internal FROM md WHERE sign >= 0
  UNION ALL SELECT page_id, 0 AS node, '{nesting.ROOT}' AS type, 0 AS depth, page_id IN (SELECT page_id FROM md WHERE sign >= 0) AS internal FROM pages)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.markup_nodes(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {MARKUP_SQL} SELECT page_id, count(*) AS n_nodes, count(*) FILTER (internal) AS n_internal, count(*) FILTER (NOT internal) AS n_leaves FROM nodes GROUP BY page_id")
def node_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each page's tree: the page, its elements and its texts."""
    return nesting.node_census(_pages(spark, sf_dir), "page_id")


@query(f"WITH {MARKUP_SQL} SELECT n.page_id, n.node, n.type, CAST(n.depth AS BIGINT) AS depth, (SELECT max(p.node) FROM nodes p WHERE p.page_id = n.page_id AND p.node < n.node AND p.depth = n.depth - 1) AS parent FROM nodes n WHERE n.internal")
def page_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The internal nodes of each page, with their parents."""
    return _pages(spark, sf_dir).where("internal").select("page_id", F.col("node").cast("long").alias("node"), "type", F.col("depth").cast("long").alias("depth"), F.col("parent").cast("long").alias("parent"))


@query(f"""WITH {MARKUP_SQL},
k AS (SELECT page_id, type, count(*) AS n FROM nodes WHERE internal GROUP BY 1, 2)
SELECT a.page_id AS pair_id, round(CAST(sum(least(a.n, coalesce(b.n, 0))) AS DOUBLE) / sum(a.n), 6) AS value FROM k a LEFT JOIN k b ON b.page_id = xor(a.page_id, 1) AND b.type = a.type GROUP BY 1""")
def tree_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal nodes of each page's tree against those of its neighbour by number, by type."""
    labels = _pages(spark, sf_dir).where("internal").select("page_id", F.col("type").alias("label"))
    side = lambda key, n: labels.select(key.alias("pair_id"), F.lit(n).alias("side"), "label")
    both = side(F.col("page_id"), multiset.HYP).unionAll(side(F.col("page_id").bitwiseXOR(F.lit(1)), 0))
    return multiset.label_match(both).select("pair_id", F.round("value", 6).alias("value"))


#: What is put between the words of a text to make code of it: nested brackets, calls, chained assignments, broken parts.
JOINTS = (" = ", "(", ", ", ") + ", ";\n", " + ", " = ", "[", "] = ", ")\n", "{", "}", " /* = */ ")


def as_code(text: Column, seed: Column) -> Column:
    joint = lambda i: F.get(F.array(*map(F.lit, JOINTS)), ((i * 7 + seed) % len(JOINTS)).cast("int"))
    return F.array_join(F.transform(F.split(text, " "), lambda x, i: F.concat(x, joint(i))), "")


def as_code_sql(text: str, seed: str) -> str:
    joints = "[" + ", ".join(quoted(j).replace("\n", "' || chr(10) || '") for j in JOINTS) + "]"
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda x, i: x || {joints}[CAST(((i - 1) * 7 + {seed}) % {len(JOINTS)} AS INTEGER) + 1]), '')"


def code_sql(codes: str, p: str) -> str:
    """CTEs over codes (a query of key, code) that end in {p}labels (key, label) and {p}edges (key, source, target)."""
    kind = rf"""CASE WHEN regexp_matches(token, '^//|(?s)^/\*.*\*/$') THEN 'c' WHEN regexp_matches(token, '^[{nesting.SPACE_CLASS}]') THEN (CASE WHEN contains(token, chr(10)) THEN 'n' ELSE 'c' END)
 WHEN regexp_matches(token, '^[\p{{L}}_]') THEN 'i' WHEN token IN ('(', '[', '{{') THEN 'o' WHEN token IN (')', ']', '}}') THEN 'x' WHEN token IN (';', ',') THEN 'e' WHEN regexp_matches(token, '^{nesting._OPERATOR}=$') THEN 'a' ELSE 'v' END"""
    pattern = nesting.CODE.replace("'", "''")
    return rf"""{p}t AS (SELECT key, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT key, regexp_extract_all(coalesce(code, ''), '{pattern}') AS t FROM ({codes}))),
{p}k AS (SELECT key, token, kind, row_number() OVER (PARTITION BY key ORDER BY i) AS pos FROM (SELECT key, token, i, {kind} AS kind FROM {p}t) WHERE kind <> 'c'),
{p}s AS (SELECT *, sum(CASE kind WHEN 'o' THEN 1 WHEN 'x' THEN -1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) AS s FROM {p}k),
{p}d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY key ORDER BY pos)) AS d FROM {p}s),
{p}l AS (SELECT key, token, kind, pos, CASE WHEN kind = 'o' THEN d ELSE coalesce(lag(d) OVER w, 0) END AS level, lag(kind) OVER w AS before, lag(token) OVER w AS named FROM {p}d WINDOW w AS (PARTITION BY key ORDER BY pos)),
-- each assignment and call with where it ends, found by a search; it holds what is in between
{p}b AS (SELECT l.key, l.pos, l.kind, CASE WHEN l.kind = 'a' THEN l.named END AS target, coalesce((SELECT min(e.pos) FROM {p}l e WHERE e.key = l.key AND e.level = l.level AND e.pos > l.pos AND (e.kind = 'x' OR l.kind = 'a' AND e.kind IN ('e', 'n'))), 1 << 30) AS until FROM {p}l l WHERE l.before = 'i' AND (l.kind = 'a' OR l.token = '(')),
{p}v AS (SELECT * FROM {p}b b WHERE kind = 'o' OR until > pos + 1 AND EXISTS (SELECT 1 FROM {p}l n WHERE n.key = b.key AND n.pos = b.pos + 1)),
{p}j AS (SELECT x.key, x.token, (SELECT arg_max(struct_pack(t := v.target), v.pos) FROM {p}v v WHERE v.key = x.key AND v.pos < x.pos AND x.pos < v.until) AS inside FROM {p}l x WHERE x.kind = 'i' AND NOT EXISTS (SELECT 1 FROM {p}v v WHERE v.key = x.key AND v.kind = 'a' AND v.pos = x.pos + 1)),
{p}edges AS (SELECT DISTINCT key, token AS source, inside.t AS target FROM {p}j WHERE inside.t IS NOT NULL AND inside.t <> token),
{p}m AS (SELECT *, lead(kind) OVER (PARTITION BY key ORDER BY pos) AS nxt FROM {p}l WHERE kind NOT IN ('e', 'n')),
{p}labels AS (SELECT DISTINCT key, 'program' AS label FROM {p}m WHERE kind <> 'x' UNION ALL SELECT key, 'assignment_expression' AS label FROM {p}m WHERE kind = 'a' AND before = 'i' UNION ALL SELECT key, 'call_expression' AS label FROM {p}m WHERE token = '(' AND kind = 'o' AND before = 'i'
  UNION ALL SELECT key, CASE token WHEN '(' THEN 'arguments' WHEN '[' THEN 'list' ELSE 'block' END AS label FROM {p}m WHERE kind = 'o' AND nxt <> 'x')"""


_TURN_CODE = f"SELECT conv_id * 1048576 + turn AS key, {as_code_sql('text', 'conv_id + turn')} AS code FROM conversations"


def _turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    coded = turns.select(pair_number().alias("key"), as_code(F.col("text"), F.col("conv_id") + F.col("turn")).alias("code"))
    return nesting.code_tokens(coded, "key", "code")


@query(f"WITH {code_sql(_TURN_CODE, 'c')} SELECT key, source, target FROM cedges")
def dataflow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the code that every turn's words are made into."""
    return nesting.code_edges(_turn_tokens(spark, sf_dir), "key")


@query(f"WITH {code_sql(_TURN_CODE, 'c')} SELECT key, label, count(*) AS n FROM clabels GROUP BY 1, 2")
def code_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal nodes of the same code's trees, by type."""
    return nesting.code_labels(_turn_tokens(spark, sf_dir), "key").groupBy("key", "label").agg(F.count("*").alias("n"))
