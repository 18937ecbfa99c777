"""A Merkle manifest of a dataset: a tree of sha256 digests per group, one over the groups' roots, and proofs of membership.

Every parent is stored with its preimage, the hex digests of its two children (or one) one after the other. A leaf that
joins its ancestors' preimages has its proof at hand: each preimage without the leaf's own slot of 64 characters is the
siblings, and with that slot replaced and hashed it is the next digest on the way to the root.

Trees are cut into pages of 1024 nodes, ten levels high, so that the work needs a few rounds whatever the number of leaves:
a tier of the tree is one grouped job over its pages, whose roots are the nodes of the next tier. On the way back every page
gets the path above it, a row for each preimage, and passes it on to the pages below; the last round meets the leaves. A
group that holds most of the rows has as many pages as it needs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.routing import PLACE_BITS
from .common import discard, free_name, stored

#: Levels of a page, which has 2**LEVELS nodes.
LEVELS = 10
DIGEST = 64
#: Steps of a path: heights within a tier's page are added to the tier's number times this; those in the tree of the groups
#: lie above all others.
TIER, TOP = 100, 1_000_000
_NODES = "key string, page long, n long, height int, idx long, preimage string, hash string"
_STEPS = "key string, page long, step int, slot int, preimage string"
_PROOFS = "subroot string, root string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as the leaves state it: `-` for null, else the number of its bytes, a colon and the value itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with pos, their place from 0 among the rows of their key along order, and n, the number of those rows.

    Stored in order once and numbered by the places there; of equal keys any may come first. Nulls come first.
    """
    tie, place, part, first = (free_name(rows, x) for x in ("tie", "place", "part", "first"))
    along = [key, *order, tie]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*along).sortWithinPartitions(*along)
    laid = stored(dealt.drop(tie).withColumn(place, F.monotonically_increasing_id()), "leaves").withColumn(part, F.shiftright(place, PLACE_BITS))
    # a row for each key of each partition
    runs = laid.groupBy(key, part).agg(F.count("*").alias("n"), F.min(place).alias(first))
    of = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(of.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(key, part, (F.col(first) - before).alias(first), F.sum("n").over(of).alias("n"))
    return laid.join(starts, [key, part]).select(*rows.columns, (F.col(place) - F.col(first)).alias("pos"), "n")


def _page_tree(key: tuple, rows: pa.Table, levels: int) -> pa.Table:
    """The parents over a page's nodes (pos, n, hash), and as the last row the page's root; of one node alone, itself."""
    rows = rows.sort_by("pos")
    n, level = rows["n"][0].as_py(), rows["hash"].to_pylist()
    # levels that the group's n nodes still have above them, at most a page's
    heights = min(levels, max(0, n - 1).bit_length())
    out = [(0, 0, None, level[0])] if not heights else []
    for height in range(1, heights + 1):
        both = ["".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        level = [digest(x) for x in both]
        out += [(height, i, p, h) for i, (p, h) in enumerate(zip(both, level, strict=True))]
    height, idx, preimage, hashes = zip(*out, strict=True)
    name, page = (x.as_py() for x in key)
    size = len(out)
    return pa.table({"key": [name] * size, "page": [page] * size, "n": [n] * size, "height": pa.array(height, pa.int32()), "idx": idx, "preimage": pa.array(preimage, pa.string()), "hash": hashes})


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Stored tiers of the trees over nodes (key, pos, n, hash), the leaves' first; the last has one page a key."""
    tiers, page = [], 1 << levels
    while True:
        most = nodes.agg(F.max("n")).first()[0] or 0
        pages = nodes.select("key", F.shiftright("pos", levels).alias("page"), "pos", "n", "hash").groupBy("key", "page")
        tiers.append(stored(pages.applyInArrow(lambda key, rows: _page_tree(key, rows, levels), _NODES), "tree"))
        if most <= page:
            return tiers
        up = F.floor((F.col("n") + (page - 1)) / page).cast("long")
        nodes = _roots(tiers[-1], levels).select("key", F.col("page").alias("pos"), up.alias("n"), "hash")


def _roots(tier: DataFrame, levels: int) -> DataFrame:
    """The root of every page."""
    top = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(levels), F.length(F.bin(F.col("n") - 1))))
    return tier.where(F.col("height") == top)


def _steps(tier: DataFrame, above: DataFrame | None) -> DataFrame:
    """A page's preimages and the path above it, as rows: heights of the page at its tier's steps, slots known later."""
    own = tier.select("key", "page", "n", "height", "idx", "preimage", F.lit(None).cast("int").alias("step"), F.lit(None).cast("int").alias("slot"))
    if above is None:
        return own
    none = F.lit(None).cast("long")
    return own.unionAll(above.select("key", "page", none, F.lit(None).cast("int"), none, "preimage", "step", "slot"))


def _split(rows: pa.Table) -> tuple[int, dict[int, list[str]], list[tuple[int, int, str]]]:
    """n, the page's preimages by height, and the path above it (step, slot, preimage) upwards."""
    n, page, above = 0, defaultdict(list), []
    for x in sorted(rows.to_pylist(), key=lambda x: (x["height"] or 0, x["idx"] or 0)):
        if x["step"] is not None:
            above.append((x["step"], x["slot"], x["preimage"]))
        else:
            n = x["n"]
            if x["height"]:
                page[x["height"]].append(x["preimage"])
    return n, page, sorted(above)


def _page_steps(at: int, page: dict[int, list[str]]) -> list[tuple[int, str]]:
    """(slot, preimage) of each ancestor in the page of its node at this place."""
    return [((at >> height - 1) & 1, page[height][at >> height]) for height in sorted(page)]


def _passed_down(first_step: int, levels: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Function of a page's rows of _steps(): the path of each of its nodes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n, page, up = _split(rows)
        first, name = key[1].as_py() << levels, key[0].as_py()
        out = []
        for at in range(min(1 << levels, n - first)):
            own = [(first_step + h, slot, p) for h, (slot, p) in enumerate(_page_steps(at, page))]
            out += [(name, first + at, *x) for x in own + up]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("key", "page", "step", "slot", "preimage"), columns, kinds, strict=True)})

    return run


def _paths(tiers: list[DataFrame], above: DataFrame | None, offset: int, down_to: int, levels: int) -> DataFrame | None:
    """Steps (key, page, step, slot, preimage) to the root of every page of the tier below `down_to`.

    above: the steps of each key's root in a tree of its own. A page of a tier is a node of the next one.
    """
    for number in range(len(tiers) - 1, down_to - 1, -1):

        down = _passed_down(offset + number * TIER, levels)
        passed, above = above, stored(_steps(tiers[number], above).groupBy("key", "page").applyInArrow(down, _STEPS), "paths")
        if hasattr(passed, "stored_at"):
            discard(passed)
    return above


def without_slot(preimage: str, slot: int) -> str:
    """The siblings in a preimage."""
    return preimage[: DIGEST * slot] + preimage[DIGEST * (slot + 1) :]


def with_slot(preimage: str, slot: int, replacement: str) -> str:
    return preimage[: DIGEST * slot] + replacement + preimage[DIGEST * (slot + 1) :]


def _proof(left: pa.Table, right: pa.Table, levels: int) -> pa.Table:
    """The leaves of a page with what their ancestors' preimages tell of each."""
    _, page, above = _split(right)
    up = [(slot, p) for _, slot, p in above]
    up_siblings = "".join(without_slot(p, slot) for slot, p in up)
    border = [p for step, _, p in above if step < TOP]  # the group's own tree
    out = []
    for pos, own, claim in zip(left["pos"].to_pylist(), left["leaf"].to_pylist(), left["claim"].to_pylist(), strict=True):
        steps = _page_steps(pos % (1 << levels), page)
        inside = border or [p for _, p in steps]
        now = claim
        for slot, p in steps + up:
            now = digest(with_slot(p, slot, now))
        subroot = digest(inside[-1]) if inside else own
        root = digest(up[-1][1]) if up else subroot
        out.append((subroot, root, digest("".join(without_slot(p, slot) for slot, p in steps) + up_siblings), now))
    found = left.drop_columns(["key", "page", "pos"])
    for name, values in zip((c.split()[0] for c in _PROOFS.split(", ")), zip(*out, strict=True), strict=True):
        found = found.append_column(name, pa.array(values, pa.string()))
    return found


def manifest(leaves: DataFrame, group: str, order: str, levels: int = LEVELS) -> DataFrame:
    """leaves (group, order, leaf, claim, ...) with subroot, root, proof_sha256, folded_root and verified added to each row.

    Of each group the leaves stand by order, then leaf; every two consecutive nodes become one parent while more than one is
    left, the last perhaps of one child. The groups' roots, in the order of their UTF-8 bytes, null first, make the root in
    the same way. proof_sha256 hashes the siblings on the way up; folded_root is what `claim` and those siblings come to.

    A null group is a group of its own, a null order comes first; leaf and claim may not be null. Equal rows are leaves of
    their own, side by side. Other columns must not be named like those added here or key, page, pos or n. No rows give no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    laid = stored(numbered(leaves.withColumn("key", key), "key", order, "leaf"), "leaves")
    tiers = _tiers(laid.select("key", "pos", "n", F.col("leaf").alias("hash")), levels)
    subroots = _roots(tiers[-1], levels).select(F.lit("").alias("key"), F.col("key").alias("name"), "hash")
    listed = stored(numbered(subroots, "key", "name"), "subroots")
    top = _tiers(listed.select("key", "pos", "n", "hash"), levels)
    paths = _paths(top, None, TOP, 0, levels)
    by_key = listed.select("name", "pos").join(paths.select(F.col("page").alias("pos"), "step", "slot", "preimage"), "pos")
    above = by_key.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("page"), "step", "slot", "preimage")
    above = _paths(tiers, above, 0, 1, levels)
    pages = laid.drop("n").withColumn("page", F.shiftright("pos", levels)).groupBy("key", "page")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields) + ", " + _PROOFS
    found = pages.cogroup(_steps(tiers[0], above).groupBy("key", "page")).applyInArrow(lambda left, right: _proof(left, right, levels), schema)
    found = stored(found, "proofs")
    discard(laid, listed, *tiers, *top, paths)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, lang, leaf, claim: the claim has one character more where 7 divides the checksum of doc_id.

    The text is hashed where it is read; only digests travel. A null n_chars or doc_id is never tampered with.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [c if i != 3 else F.col("n_chars") + 1 for i, c in enumerate(fields)]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", "lang", leaf(*fields).alias("leaf"), F.when(tampered, leaf(*more)).otherwise(leaf(*fields)).alias("claim"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs, grouped by lang."""
    return manifest(document_leaves(docs), "lang", "doc_id")
