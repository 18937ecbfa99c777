"""The manifest against a plain tree: groups of one and of many, nulls, repeated rows, several tiers, tampered claims."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillet.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    """Levels of the tree over nodes, the root's last."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, at):
    """(slot, sibling or nothing) upwards from the node at a place."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append((at & 1, level[other] if other < len(level) else ""))
        at >>= 1
    return out


def brute(leaves):
    """leaves (id, group, leaf, claim) -> sorted rows."""
    groups = {}
    for x in sorted(leaves, key=lambda x: (x[1] is not None, (x[1] or "").encode(), x[0] is not None, x[0] or 0, x[2])):
        groups.setdefault(x[1], []).append(x)
    trees = [tree([x[2] for x in rows]) for rows in groups.values()]
    top = tree([t[-1][0] for t in trees])
    out = []
    for g, (rows, t) in enumerate(zip(groups.values(), trees, strict=True)):
        for at, x in enumerate(rows):
            steps = way(t, at) + way(top, g)
            now = x[3]
            for slot, sibling in steps:
                now = sha(sibling + now if slot else now + sibling)
            out.append((x[0], x[1], x[2], t[-1][0], top[-1][0], sha("".join(s for _, s in steps)), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest(spark, levels):
    sizes = {None: 5, "": 1, "a": 2, "é": 19, "b": 33, "z": 16}
    rows = []
    for group, n in sizes.items():
        for i in range(n):
            own = sha(f"{group}{i if i % 5 else 0}")
            rows.append((None if i == 3 else i // 2, group, own, sha(own) if i % 4 == 1 else own))
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "id long, grp string, leaf string, claim string").repartition(6)
    for name in ("tie", "place", "part", "first"):
        df = df.withColumn(name, F.lit("extra"))
    found = merkle.manifest(df, "grp", "id", levels)
    assert found.columns == [*df.columns, "subroot", "root", "proof_sha256", "folded_root", "verified"]
    # rows of one id and digest stand side by side in any order: what they share is compared
    got = sorted((tuple(x) for x in found.select("id", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    want = brute(rows)
    repeated = {(x[0], x[1], x[2]) for x in rows if sum(y[:3] == x[:3] for y in rows) > 1}
    plain = lambda rows: [x for x in rows if x[:3] not in repeated]
    assert plain(got) == plain(want)
    assert sorted({x[:5] for x in got}, key=repr) == sorted({x[:5] for x in want}, key=repr) and len(got) == len(want)


def test_nothing_and_one(spark):
    schema = "id long, grp string, leaf string, claim string"
    assert merkle.manifest(spark.createDataFrame([], schema), "grp", "id").collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "a", sha("x"), sha("y"))], schema), "grp", "id").first()
    assert (one["subroot"], one["root"], one["proof_sha256"], one["folded_root"], one["verified"]) == (sha("x"), sha("x"), sha(""), sha("y"), False)


def test_odd_documents(odd, odd_rows):
    got = merkle.document_manifest(odd).collect()
    assert len(got) == len(odd_rows)
    state = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaves = sorted(sha("".join(map(state, (i, source, lang, n, text)))) for i, text, lang, source, n in odd_rows)
    assert sorted(x["leaf"] for x in got) == leaves
    assert all(x["verified"] == (x["doc_id"] is None or zlib.crc32(str(x["doc_id"]).encode()) % 7 != 0) for x in got)


def test_nothing_of_documents(none):
    assert merkle.document_manifest(none).collect() == []


def test_slots():
    two = "a" * 64 + "b" * 64
    assert merkle.without_slot(two, 0) == "b" * 64 and merkle.without_slot("a" * 64, 0) == ""
    assert merkle.with_slot(two, 1, "c" * 64) == "a" * 64 + "c" * 64
