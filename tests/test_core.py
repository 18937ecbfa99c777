"""Hand-computed cases of the core operators."""

import math
import re

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillet.functions import languages, prompts, text
from quillet.operators import multiset, routing, scores, stats, trees
from quillet.operators.bleu import bleu
from quillet.plans.pairs import evaluate
from quillet.sources import records


def pairs_of(spark, *rows):
    return spark.createDataFrame([(i, list(r), h) for i, (r, h) in enumerate(rows)], "pair_id long, refs array<string>, hyp string")


def values(df):
    return [r.value for r in df.orderBy("pair_id").collect()]


def test_tokens(spark, sf):
    cases = {"x // http://h": ["x"], "'http://h'": ["'", "http", ":"], "/* a // */ b\nc": ["/", "*", "a", "c"], "": [], "a_b1 + Ünï": ["a_b1", "+", "Ünï"]}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r.t for r in df.select("i", text.tokenize(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == list(cases.values())
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.tokenize(F.col("text")).alias("t")).collect()
    assert all(r.t == re.findall(r"\w+|[^\w\s]", docs[r.doc_id]) for r in found)


def test_weighted_precision(spark):
    p = pairs_of(spark, (["if y"], "if x"), (["a"], "a a a"), (["a", "b"], "a b"), (["a"], ""), (["b"], "a"), (["let x = y"], "let x = y"), ([], "a"))
    assert values(multiset.weighted_precision(p, languages.DART_KEYWORDS)) == pytest.approx([5 / 6, 1 / 3, 1, 0, 0, 1, 0])


def test_bleu(spark):
    p = pairs_of(spark, (["a b c d e"], "a b c d e"), (["x"], "a"), (["a"], "a"), (["a b c d e"], ""), (["a b c d e f"], "a b c d"), (["a b x y", "a"], "a b c d"))
    got = values(bleu(p))
    smooth = [2 / 4, 1 / 3, math.log(4) / (2 * 5) / 2, math.log(4) / (4 * 5) / 1]
    assert got == pytest.approx([1, 0, 1, 0, math.exp(1 - 6 / 4), math.exp(sum(math.log(x) for x in smooth) / 4)])


def test_code_trees():
    code = "var a = b + f(c, d);\nx = (y = z);\nprint(q)"
    nodes = trees.parse_code(code)
    kinds = [n[0] for n in nodes]
    assert kinds.count("assignment_expression") == 3 and kinds.count("call_expression") == 2
    assert trees.edges_of(code, nodes) == {("b", "a"), ("f", "a"), ("z", "y")}
    assert all(p < i for i, (*_, p) in enumerate(nodes) if nodes[i][0] != "identifier")
    assert trees.parse_json('{"a": [1, {"b": null}]}')[0][0] == "dict"
    assert [n[0] for n in trees.parse_html("<p>a<br><b>c</b></p>")] == ["document", "p", "text", "br", "b", "text"]


def test_composite(spark):
    p = pairs_of(spark, (["x = y + z;\nf(x);"], "x = y + z;\nf(x);"), (["x = y;"], ""), (["a"], ""))
    got = scores.composite(p, "dart").orderBy("pair_id").collect()
    assert got[0].codebleu == pytest.approx(1) and got[1].codebleu == 0 and got[2].codebleu == 0.25
    with pytest.raises(ValueError):
        scores.composite(p, "dart", (0.3, 0.3, 0.3, 0.0))
    with pytest.raises(ValueError):
        scores.composite(p, "kotlin")
    mean = scores.corpus(scores.composite(p, "dart")).first()
    assert mean.n_pairs == 3 and mean.codebleu == pytest.approx(1.25 / 3)
    rows = scores.corpus_details(scores.composite(p, "dart")).collect()
    assert len(rows) == 4 and [r.codebleu for r in rows if r.is_total] == [pytest.approx(1.25 / 3)]
    assert scores.corpus(scores.composite(p.limit(0), "dart")).first().codebleu is None
    assert scores.composite(p, "dart", all_scores=False).columns == ["pair_id", "codebleu"]
    assert scores.composite(pairs_of(spark, ([], None)), "swift").first().codebleu == 0.25
    told = pairs_of(spark, (["import UIKit\nlet a: Int = 1"], "let a: Int = 1"), (["hm"], "x"), (["hm ("], "x"))
    detected = {r.pair_id: r for r in scores.score_detected(told).collect()}
    assert detected[0].lang == "swift" and detected[0].codebleu > 0 and detected[1].lang == "dart"
    assert detected[2].lang is None and detected[2].codebleu is None
    with pytest.raises(PySparkException):
        scores.score_detected(told, undecided="raise").collect()


def test_composite_plan(spark):
    """One scan, one dealing out and one Python evaluation for all four parts."""
    import contextlib
    import io

    folder = "/root/testdata/sf0.001/conversations.parquet"
    p = spark.read.parquet(folder).select(F.col("turn").alias("pair_id"), F.array("text").alias("refs"), F.col("text").alias("hyp"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        scores.composite(p, "dart").explain()
    plan = out.getvalue()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_edges_before_a_faulty_node():
    code = "a = b; c = d"
    nodes = trees.parse_code(code)
    faulty = [*nodes[:-1], (nodes[-1][0], None, "x", nodes[-1][3])]
    assert trees.edges_of(code, nodes) == {("b", "a"), ("d", "c")} and trees.edges_of(code, faulty) == {("b", "a")}
    assert [trees.code_is_whole(x) for x in ("f(a[1]) {}", "f(", "(]", "'open", "'shut'", ")", "")] == [True, False, False, False, True, False, True]


def test_language_points(spark):
    """Classes are Unicode, and the search for a pattern's text changes nothing."""
    from quillet.functions.languages import DART_MODERATE, DART_STRONG, SWIFT_MODERATE, SWIFT_STRONG

    codes = ["class Größe extends Foo", "éclass A extends B", "class A\u00a0extends B", "Widget", "aWidget", "Widgeté", "$x ${y}", "func ä(b: C) -> D", "let ü: Int", "switch ñ {", "x\nFlutter\ny", "FLUTTER", "late", "late é", ""]

    def points(strong, moderate, code):
        return 2 * sum(bool(re.search(p, code, re.M)) for p in strong) + sum(bool(re.search(p, code, re.M)) for p in moderate)

    got = spark.createDataFrame(list(enumerate(codes)), "i int, c string").select("i", languages.language_points(F.col("c")).alias("p")).orderBy("i").collect()
    for code, r in zip(codes, got, strict=True):
        lower = code.lower()
        assert r.p.dart == points(DART_STRONG, DART_MODERATE, code) + 3 * ("flutter" in lower), code
        assert r.p.swift == points(SWIFT_STRONG, SWIFT_MODERATE, code) + 3 * ("uikit" in lower or "swiftui" in lower), code


def test_zip_raises(spark):
    refs = spark.createDataFrame([(0, ["a"]), (1, ["b"])], "idx long, refs array<string>")
    hyps = spark.createDataFrame([(0, "a")], "idx long, hyp string")
    with pytest.raises(PySparkException):
        scores.zip_pairs(refs, hyps).collect()
    assert scores.zip_pairs(refs.where("idx = 0"), hyps).count() == 1


def test_prompts_and_fences(spark):
    rows = [("### Response:\n```dart\n code \n``` x", "DART"), ("no mark", "dart"), ("### Response: plain ", "dart"), ("### Response: ```swift\nlet```", "swift"), ("### Response: ```dart\nx```", "kotlin")]
    df = spark.createDataFrame(rows, "r string, l string")
    assert [x.c for x in df.select(text.fenced_block(F.col("r"), F.col("l")).alias("c")).collect()] == ["code", "no mark", "plain", "let", "```dart\nx```"]
    one = spark.createDataFrame([("Dart", "mov", "src<e>", "why")], "l string, a string, s string, y string")
    out = one.select(prompts.training_prompt(F.col("l"), F.col("a"), F.col("s"), "<e>", F.col("y")).alias("t")).first().t
    assert out == prompts.HEAD.format("Dart", "Dart", "mov") + "<think>\nwhy\n</think>\n```dart\nsrc<e>\n```\n"
    with pytest.raises(ValueError):
        prompts.fill("{}")


def test_routing(spark):
    df = spark.range(103).withColumnRenamed("id", "k").repartition(5)
    assert [(r.k, r.idx) for r in routing.with_ordinal(df, "k").orderBy("k").collect()] == [(i, i) for i in range(103)]
    split = routing.exact_split(df, "k")
    assert split.where("is_test").count() == 21 and split.count() == 103
    assert routing.nth_record(df, 7, "k").first().k == 7


def test_ordinals_of_wide_tables(spark):
    """Whole rows, each number once: many rows, names that clash, equal and null keys, no rows."""
    wide = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("k"), *[F.sha2(F.concat_ws(":", F.lit(c), "id"), 256).alias(c) for c in ("part", "place", "before", "tie", "hashed", "rank")])
    got = routing.with_ordinal(wide, "k")
    assert got.columns == [*wide.columns, "idx"]
    facts = got.agg(F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx"), F.countDistinct("k"), F.min("part"), F.max("rank")).first()
    assert tuple(facts)[:5] == (300_000, 300_000, 0, 299_999, 300_000)
    assert got.where("k < 1000").count() == wide.where("k < 1000").count()
    assert got.selectExpr("idx - lag(idx) over (order by k) as d").where("d <> 1").count() == 0
    split = routing.exact_split(wide, "k")
    assert split.where("is_test").count() == 60_000 and split.count() == 300_000 and split.columns == [*wide.columns, "is_test"]
    ties = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(5)).alias("k"), F.lit("old").alias("idx"))
    assert routing.with_ordinal(ties, "k").agg(F.countDistinct("idx"), F.max("idx")).first()[:] == (50_000, 49_999)
    assert routing.with_ordinal(wide.limit(0), "k").count() == 0 and routing.exact_split(wide.limit(0), "k").count() == 0


def test_stats_and_sinks(spark, tmp_path):
    one = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "language string, score double")
    got = {r.language: r for r in stats.statistics(one, by="language").collect()}
    assert got["a"].Standard_Deviation == 0 and got["a"].Count == 1 and got["b"].Standard_Deviation == pytest.approx(math.sqrt(2))
    assert stats.statistics_rollup(one, "language").where("is_total").first().Count == 3
    assert not records.write_statistics(stats.statistics(one.limit(0)), str(tmp_path / "none"))
    assert records.write_statistics(stats.statistics(one), str(tmp_path / "stats"))
    assert records.read_statistics(spark, str(tmp_path / "stats")).first().Average == 2.0


def test_progress_and_formats(spark, caplog):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx long, score double")
    with caplog.at_level("INFO", "quillet"):
        records.log_progress(df, 2)
    assert [r.getMessage() for r in caplog.records] == ["scores: 2 rows, mean 0.5000", "scores: 4 rows, mean 1.5000", "scores: 5 rows, mean 2.0000"]
    one = spark.createDataFrame([(1234.56789, "ü", [1, 2])], "x double, t string, l array<int>")
    assert one.select(text.decimals(F.col("x")), text.encoded(F.col("t"))).first()[:] == ("1234.5679", bytearray("ü".encode()))
    assert [r.l for r in scores.flattened(one, "l").collect()] == [1, 2]


def test_sources(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_bytes(b'{"assembly": "m\xff", "language": "Dart", "source": "s"}\r\n\n{"assembly": "n", "language": "Swift", "source": "t"}\n')
    assert {r.assembly for r in records.read_jsonl_lenient(spark, str(good)).collect()} == {"m�", "n"}
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"assembly": 1\n')
    with pytest.raises(Exception, match="MALFORMED"):
        records.read_jsonl(spark, str(bad)).collect()
    titles = tmp_path / "t.txt"
    titles.write_text("One\n\nTwo\n")
    assert records.read_titles(spark, str(titles)).count() == 2


def test_evaluate(spark):
    rows = [(1, "DART", "x = y;", "### Response:\n```dart\nx = y;\n```"), (2, "kotlin", "a", "b"), (3, "swift", "a", "a")]
    got = evaluate(spark.createDataFrame(rows, "record_id long, language string, source string, response string"), "dart").collect()
    assert [r.record_id for r in got] == [1] and got[0].score > 0.9


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_stream(spark, tmp_path):
    from quillet.streaming.scores import read_score_stream, windowed_statistics

    folder = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:10:00", "dart", 1.0), ("2024-01-01 00:20:00", "dart", 3.0)], "ts string, language string, score double").write.json(str(folder))
    stream = read_score_stream(spark, str(folder), "ts timestamp, language string, score double")
    q = windowed_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stats").first().Average == 2.0


def test_node_rows(spark):
    df = spark.createDataFrame([(1, "<p>a<br><b>c</b></p>"), (2, None), (3, "")], "k int, t string").select("k", trees.parsed(F.col("t"), "html").alias("nodes"))
    got = [(r.k, r.node_id, r.type, r.parent, r.internal) for r in trees.node_rows(df).orderBy("k", "node_id").collect()]
    assert got == [(1, 0, "document", -1, True), (1, 1, "p", 0, True), (1, 2, "text", 1, False), (1, 3, "br", 1, False), (1, 4, "b", 1, True), (1, 5, "text", 4, False)]
    assert [r.t for r in df.select(trees.internal_types(F.col("nodes")).alias("t"), "k").orderBy("k").collect()] == [["document", "p", "b"], [], []]
    bad = spark.createDataFrame([("{",), ("[1]",)], "t string").select(F.size(trees.parsed(F.col("t"), "json")["type"]).alias("n"))
    assert [r.n for r in bad.collect()] == [0, 2]
