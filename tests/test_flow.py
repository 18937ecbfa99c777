"""Lines with a quarantine, ordinals, batches, partial states, failures, progress and single files."""

import json
import logging
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillet.operators import batches, ordinals, scores, states, stats, trees
from quillet.sources import lines, records

GOOD = '{"assembly": "mov", "language": "Dart", "source": "é"}'


def test_quarantine(spark, tmp_path):
    bad = {b"{": lines.NOT_JSON, b"[1]": lines.NOT_OBJECT, b"3": lines.NOT_OBJECT, b'{"assembly": "a"}': lines.MISSING, b'{"assembly": 1, "language": "x", "source": "y"}': lines.WRONG_TYPE, b'{"assembly": {}, "language": "x", "source": "y"}': lines.WRONG_TYPE, b"\xff\xfe": lines.NOT_JSON}
    null = b'{"assembly": null, "language": "x", "source": "y", "more": [1]}'
    faulty = b'{"assembly": "a\xe2\x82b\xff", "language": "x", "source": "y"}'
    folder = tmp_path / "in"
    folder.mkdir()
    r, contents, want = random.Random(1), {}, []
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        rows = [r.choice([GOOD.encode(), GOOD.encode(), null, faulty, b"", b"  ", *bad]) for _ in range(400)]
        data = b"".join(x + r.choice([b"\n", b"\r\n"]) for x in rows) + (b"" if name == "a.jsonl" else b"{")
        (folder / name).write_bytes(data)
        contents[name] = data
        want += [bad[x] for x in rows if x in bad] + ([] if name == "a.jsonl" else [lines.NOT_JSON])
    (folder / "good.jsonl").write_text(GOOD + "\n")
    (folder / "none.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several splits a file
    try:
        got = lines.read_records(spark, str(folder))
        found, kept = got.rejected.collect(), got.records.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(x["reason"] for x in found) == sorted(want)
    for x in found:
        piece = contents[os.path.basename(x["file"])][x["offset"] : x["offset"] + x["length"]]
        assert piece.decode(errors="replace") == x["line"] and b"\n" not in piece
    whole = b"".join(contents.values())
    assert len(kept) == whole.count(GOOD.encode()) + 1 + whole.count(null) + whole.count(faulty)
    assert {x["assembly"] for x in kept if x["replaced"]} == {json.loads(faulty.decode(errors="replace"))["assembly"]}
    some = lines.read_records(spark, str(folder), required=("assembly",)).rejected
    assert some.where(F.col("reason") == lines.MISSING).count() == 0


def test_nth_record_opens_one_file(spark):
    df = spark.range(12_000_000, numPartitions=8).select((F.col("id") * 7).alias("id"), F.lit("x").alias("file"), F.lit("y").alias("place"))
    index = ordinals.OrdinalIndex(df, "id")
    far = index.record(10_000_000)
    assert [tuple(x) for x in far.collect()] == [(70_000_000, "x", "y", 10_000_000)] and far.columns == [*df.columns, "idx"]
    assert len(far.inputFiles()) == 1 < index.files.count()
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_place," in plan and "Exchange" not in plan
    assert [x["idx"] for x in index.records(11_999_990, 13_000_000).orderBy("idx").collect()] == list(range(11_999_990, 12_000_000))
    assert index.record(12_000_000).collect() == [] == index.record(-1).collect() and index.count() == 12_000_000
    wide = df.withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    assert ordinals.nth_record(wide, 11_000_000, "id").first()["id"] == 77_000_000
    assert ordinals.nth_record(wide, 12_000_000, "id").count() == 0
    index.drop()


def test_index_of_ties_nulls_and_nothing(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), F.lit(1).alias("idx"))
    index = ordinals.OrdinalIndex(df, "k")
    assert sorted(x["idx"] for x in index.numbered().select("idx").collect()) == list(range(5000))
    assert index.record(0).first()["k"] is None and index.record(4999).first()["k"] == 1
    assert index.shard(1, 4).count() == 1250 and index.records(10, 13).count() == 3
    empty = ordinals.OrdinalIndex(df.where("false"), "k")
    assert empty.count() == 0 and empty.record(0).count() == 0 and empty.records(0, 5).count() == 0 and empty.shard(0, 2).count() == 0


def test_split_with_repeated_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("hash"))
    split = ordinals.exact_split(df, "k", 0.25)
    assert split.where("is_test").count() == 250 and split.count() == 1000 and split.columns == ["k", "hash", "is_test"]
    assert ordinals.exact_split(df, "k", 1.0).where("is_test").count() == 1000 and ordinals.exact_split(df, "k", 0).where("is_test").count() == 0


def test_packed(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), (F.col("id") * 37 % 101).cast("int"))).alias("text"), F.array("id").alias("part")).repartition(3)
    got = batches.packed(df, F.length("text")).collect()
    assert sorted(r["id"] for b in got for r in b["rows"]) == list(range(1003))
    sizes = {}
    for b in got:
        lengths = [len(r["text"] or "") for r in b["rows"]]
        assert b["n"] == len(lengths) <= 4 and b["longest"] == max(lengths) and b["padding"] == max(lengths) * len(lengths) - sum(lengths)
        sizes.setdefault(b["part"], []).append((b["batch"], b["n"]))
    assert all([n for _, n in sorted(x)][:-1] == [4] * (len(x) - 1) for x in sizes.values())
    unsorted = [len(r["text"] or "") for r in df.collect()]
    loose = sum(max(unsorted[i : i + 4]) * len(unsorted[i : i + 4]) - sum(unsorted[i : i + 4]) for i in range(0, 1003, 4))
    assert sum(b["padding"] for b in got) < loose / 20
    back = batches.unpacked(batches.packed(df.drop("part"), F.length("text")))
    assert back.drop("part", "batch").exceptAll(df.drop("part")).count() == 0 and back.count() == 1003
    assert "Exchange" not in batches.packed(spark.range(9), F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert batches.packed(df.where("false"), F.length("text")).count() == 0


def test_map_batches(spark):
    df = spark.range(50, numPartitions=2).select("id", F.lit("old").alias("out"), F.array("id").alias("list"))

    def setup():
        calls = []

        def run(batch):
            calls.append(len(batch["id"]))
            return {"out": [i * 2 for i in batch["id"]], "seen": [[os.getpid(), len(calls)]] * len(batch["id"])}

        return run

    got = batches.map_batches(df, setup, "out long, seen array<long>", ["id"], size=7)
    assert got.columns == ["id", "list", "out", "seen"]
    rows = got.collect()
    assert all(r["out"] == 2 * r["id"] and r["list"] == [r["id"]] for r in rows) and len(rows) == 50
    sizes = {}
    for r in rows:
        sizes[tuple(r["seen"])] = sizes.get(tuple(r["seen"]), 0) + 1
    assert max(sizes.values()) == 7
    for wrong in (lambda: lambda b: {"out": [1], "seen": [[1]]}, lambda: lambda b: {"out": [1] * len(b["id"])}):
        with pytest.raises(PySparkException, match="are declared"):
            batches.map_batches(df, wrong, "out long, seen array<long>", ["id"]).collect()
    assert batches.map_batches(df.where("false"), setup, "out long, seen array<long>").count() == 0


def test_map_batches_hands_answers_on(spark):
    """A worker keeps the answers to about a megabyte of rows, not those to one of Spark's batches of 10,000."""
    df = spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def setup():
        live = [0]

        class Answer(str):
            def __del__(self):
                live[0] -= 1

        def run(batch):
            live[0] += len(batch["id"])
            return {"out": [Answer(i) for i in batch["id"]], "live": [live[0]] * len(batch["id"])}

        return run

    got = batches.map_batches(df, setup, "out string, live long", ["id"]).select("id", "out", "live").collect()
    assert [(r.id, r.out) for r in got] == [(i, str(i)) for i in range(2000)] and max(r.live for r in got) < 300


def test_states_merge(spark, tmp_path):
    path = str(tmp_path / "states")
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("language"), (1e5 + F.sin("id")).alias("score"), "id")
    one = spark.createDataFrame([("only", 5.0), ("none", None)], "language string, score double")
    for k in range(4):
        states.write_shard(df.where(F.col("id") % 4 == k), "score", "language", path, str(k))
    states.write_shard(df.where("id = 0"), "score", "language", path, "3")
    states.write_shard(df.where("id % 4 = 3"), "score", "language", path, "3")
    states.write_shard(one, "score", "language", path, "late")
    got = {r["language"]: r for r in states.as_statistics(states.merged(states.read_states(spark, path), "language"), "language").collect()}
    want = {r["language"]: r for r in stats.statistics(df.select("language", "score").unionAll(one), by="language").collect()}
    assert got.keys() == want.keys() and "none" not in got
    for k, r in want.items():
        assert got[k]["Count"] == r["Count"] and all(got[k][c] == pytest.approx(r[c], rel=1e-9) for c in ("Min", "Max", "Average", "Standard_Deviation"))
    again = states.merged(states.merged(states.read_states(spark, path), "language"), "language")
    assert again.count() == 4


def test_failures_are_told(spark):
    def parse(text):
        if "bad" in text:
            raise ValueError(text)
        nodes = trees.parse_code(text)
        return [*nodes, ("identifier", 0, 1, 10_000)] if "odd" in text else nodes

    rows = [(1, ["a = b"], "a = b"), (2, ["bad"], "odd = b"), (3, ["a"], "bad"), (4, None, None), (5, ["bad"], "bad")]
    df = spark.createDataFrame(rows, "pair_id long, refs array<string>, hyp string")
    got = scores.composite(df, "dart", parsers={"dart": parse}, failures=True)
    found = {r["pair_id"]: r for r in got.collect()}
    assert {k: r["failed"] for k, r in found.items()} == {1: [], 2: ["ref tree: ValueError", "hyp edges: IndexError"], 3: ["hyp tree: ValueError"], 4: [], 5: ["ref tree: ValueError", "hyp tree: ValueError"]}
    assert found[1]["codebleu"] > 0.7 and found[3]["ast_match"] == 0
    assert {tuple(r) for r in scores.failure_counts(got).collect()} == {("ref tree: ValueError", 2), ("hyp tree: ValueError", 2), ("hyp edges: IndexError", 1)}
    assert "failed" not in scores.composite(df, "dart").columns


def test_progress_while_writing(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "quillet")
    df = spark.range(1000, numPartitions=5).select("id", F.when(F.col("id") % 4 > 0, F.col("id") * 0.5).alias("score"))
    seen = records.write_observed(df, lambda d: d.write.parquet(str(tmp_path / "out")), "score")
    assert seen.rows == 1000 == spark.read.parquet(str(tmp_path / "out")).count()
    values = [i * 0.5 for i in range(1000) if i % 4]
    assert seen.total == sum(values) and seen.mean == pytest.approx(sum(values) / len(values)) and "1000 rows, mean" in caplog.text
    none = records.write_observed(df.where("false"), lambda d: d.write.parquet(str(tmp_path / "none")))
    assert (none.rows, none.total, none.mean) == (0, None, None)


def test_single_file(spark, tmp_path):
    path = str(tmp_path / "dart_statistics.csv")
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "language string, score double")
    for target in (path, "file://" + path):
        assert records.write_statistics(stats.statistics(df), target, single=True)
        assert os.path.isfile(path) and open(path).read().splitlines()[0] == "Min,Max,Average,Standard_Deviation,Count"
    assert records.read_statistics(spark, path).first()["Count"] == 2
    before = open(path).read()

    def interrupted(folder):
        df.coalesce(1).write.csv(folder)
        raise RuntimeError("interrupted")

    with pytest.raises(RuntimeError):
        records.write_single(interrupted, spark, path)
    assert not records.write_statistics(stats.statistics(df.where("false")), path, single=True)
    assert open(path).read() == before and [x for x in os.listdir(tmp_path) if "writing" in x] == []
