"""Operator 12, Merkle dataset manifest by time-forward processing.

Every row is a leaf; the leaves of a group (``lang``), ordered by id, form a
binary hash tree whose top is the group's subroot; the subroots, ordered by group
(null first, then by UTF-8 bytes), form a tree with the dataset's root.

A node's label is (level, index). Digests travel as messages to the label of the
parent. Within a block of ``2**BLOCK_BITS`` consecutive nodes the messages lie in a
priority queue ordered by label, so that a node is computed when all its children
have reported, and reports to its own parent. Between blocks the queue is external:
the blocks' tops are a saved table, dealt out by the next block they belong to, with
a 4096th of the rows each round. The reversed sweep pops labels from the highest
down and delivers to each child its sibling and its parent's proof suffix; between
blocks these suffixes are joined with the saved messages of the round below.

A proof is the concatenated digests of the siblings from leaf to root; ``steps``
has one character a level: L or R (the side the sibling is on) or ``.`` (none).

Positions come from one range partitioning by (group, id, leaf): no task holds more
than its range or one block, whatever a group's size.

Defined results: null fields are hashed as ``-``; a null id comes first in its group
and is not tampered with; rows that repeat an id are leaves of their own, ordered by
leaf digest (equal rows have equal leaves and different proofs); an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, saved, table

BLOCK_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these


def digest_of(values: list[Column]) -> Column:
    """Hex SHA-256 of the values, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]).cast("binary"), 256)


def _h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def ascend(first: int, digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """The nodes of one block by label, from consecutive level-0 nodes and up
    ``levels`` levels; messages are taken in the order of their labels."""
    node = {}
    queue = [(0, first + k, 0, d) for k, d in enumerate(digests)]  # sorted, so a heap
    while queue:
        level, index, _, digest = heapq.heappop(queue)
        if level:
            parts = [digest]
            while queue and queue[0][:2] == (level, index):
                parts.append(heapq.heappop(queue)[3])
            digest = _h(*parts)
        node[level, index] = digest
        if level < levels:
            heapq.heappush(queue, (level + 1, index >> 1, index & 1, digest))
    return node


def descend(node: dict[tuple[int, int], str], levels: int, top: int, proof: str, steps: str):
    """(index, proof, steps) of a block's level-0 nodes: suffixes go from the
    highest label down."""
    queue = [(-levels, -top, proof, steps)]
    while queue:
        level, index, proof, steps = heapq.heappop(queue)
        level, index = -level, -index
        if not level:
            yield index, proof, steps
            continue
        left, right = node[level - 1, 2 * index], node.get((level - 1, 2 * index + 1))
        if right is None:
            heapq.heappush(queue, (1 - level, -2 * index, proof, "." + steps))
        else:
            heapq.heappush(queue, (1 - level, -2 * index, right + proof, "R" + steps))
            heapq.heappush(queue, (1 - level, -2 * index - 1, left + proof, "L" + steps))


def fold(leaf: str, proof: str, steps: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for side in steps:
        if side == ".":
            leaf = _h(leaf)
            continue
        other = proof[at : at + 64]
        at += 64
        leaf = _h(other, leaf) if side == "L" else _h(leaf, other)
    return leaf


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, their position in ``grp`` by ``order``, and left, the
    number of levels above them. The ranges are saved before they are counted."""
    keys = ["grp", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = saved(ranged).withColumn("part", F.shiftright("at", _LOCAL_BITS))
    counts = ranged.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")  # a row for each range that the group touches
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(whole)
    places = counts.select("part", "grp", (before - F.col("first")).alias("shift"), total.alias("total"))
    levels = F.when(F.col("total") == 1, 0).otherwise(F.length(F.bin(F.col("total") - 1)))
    out = ranged.join(places, ["part", "grp"]).withColumn("idx", F.col("at") + F.col("shift")).withColumn("left", levels.cast("bigint"))
    return out.drop("part", "at", "shift", "total")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", BLOCK_BITS))


def _up(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The saved messages (grp, block, idx, left, digest, ...) of every round and
    the tops (grp, digest, round)."""

    def run(keys, group):
        group = group.sort_by("idx")
        left = group.column("left")[0].as_py()
        levels = min(BLOCK_BITS, left)
        first = group.column("idx")[0].as_py()
        node = ascend(first, group.column("digest").to_pylist(), levels)
        return pa.table({"grp": [keys[0].as_py()], "idx": [first >> levels], "left": [left - levels], "digest": [node[levels, first >> levels]]})

    rounds, tops = [], None
    while True:
        nodes = saved(_blocks(rows))
        if rounds and nodes.isEmpty():
            return rounds, tops
        rounds.append(nodes)
        narrow = nodes.select("grp", "block", "idx", "left", "digest")
        above = saved(narrow.groupBy("grp", "block").applyInArrow(run, "grp string, idx bigint, left bigint, digest string"))
        done = above.where("left = 0").select("grp", "digest", F.lit(len(rounds) - 1).alias("round"))
        tops = done if tops is None else tops.union(done)
        rows = above.where("left > 0")


def _swept(own: list[str]):
    """The function of (nodes of a block, suffix of its top) that gives the nodes'
    columns ``own`` and their proofs."""

    def run(group, above):
        group = group.sort_by("idx")
        levels = min(BLOCK_BITS, group.column("left")[0].as_py())
        first = group.column("idx")[0].as_py()
        node = ascend(first, group.column("digest").to_pylist(), levels)
        top = above.to_pylist()[0]
        found = sorted(descend(node, levels, first >> levels, top["proof"], top["steps"]))
        out = group.select(own)
        out = out.append_column("proof", pa.array([x[1] for x in found], pa.string()))
        out = out.append_column("steps", pa.array([x[2] for x in found], pa.string()))
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array([top[c]] * len(found), pa.string()))
        return out

    return run


def _down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of round 0 with proof, steps, subroot and root, from those of the
    tops (grp, round, proof, steps, subroot, root)."""
    given = "proof string, steps string, subroot string, root string"
    come = None
    for number in reversed(range(len(rounds))):
        nodes = rounds[number]
        suffix = tops.where(F.col("round") == number).select("grp", F.lit(0).cast("bigint").alias("block"), "proof", "steps", "subroot", "root")
        if come is not None:
            suffix = suffix.union(come.select("grp", F.col("idx").alias("block"), "proof", "steps", "subroot", "root"))
        own = [c for c in nodes.columns if c not in ("block", "left")]
        schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in own) + ", " + given

        come = nodes.groupBy("grp", "block").cogroup(suffix.groupBy("grp", "block")).applyInArrow(_swept(own), schema)
        if number:
            come = saved(come)
    return come


def manifest(leaves: DataFrame, order: list[str], group_col: str = "lang", leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` with subroot, root, proof and steps. Leaves are ordered by
    ``order`` within the group; no column may be called grp, idx, block, left,
    digest, proof, steps, subroot or root."""
    prepare(leaves.sparkSession)
    # A null group is the empty key, any other has a mark before its name: nulls come first.
    named = leaves.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit(""))).withColumnRenamed(leaf_col, "digest")
    rounds, tops = _up(_placed(named, [*order, "digest"]))
    tops = saved(tops)
    of_root = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("round").alias("name_round"))
    above, root = _up(_placed(of_root, ["name"]))
    start = root.select("grp", "round", F.lit("").alias("proof"), F.lit("").alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = _down(above, start).select(F.col("name").alias("grp"), F.col("name_round").alias("round"), "proof", "steps", F.col("digest").alias("subroot"), "root")
    return _down(rounds, saved(tops)).drop("grp", "idx").withColumnRenamed("digest", leaf_col)


def folded(rows: DataFrame, leaf_col: str) -> DataFrame:
    """``rows`` with proof_sha256 and folded_root, the root that ``leaf_col`` and
    the proof lead to; proof and steps are dropped."""
    keep = [c for c in rows.columns if c not in ("proof", "steps")]

    def run(batches):
        for b in batches:
            proofs, steps, leaves = (b.column(c).to_pylist() for c in ("proof", "steps", leaf_col))
            cols = [b.column(c) for c in keep]
            cols.append(pa.array([_h(p) for p in proofs], pa.string()))
            cols.append(pa.array([fold(*x) for x in zip(leaves, proofs, steps)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "proof_sha256", "folded_root"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, proof_sha256 string, folded_root string")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    leaves = docs.select(
        "doc_id", "lang", digest_of([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(hit, digest_of([more if c == "n_chars" else F.col(c) for c in FIELDS])).alias("tampered"),
    )
    rows = manifest(leaves, ["doc_id"]).withColumn("checked", F.coalesce("tampered", "leaf"))
    out = folded(rows.select("doc_id", "leaf", "checked", "subroot", "root", "proof", "steps"), "checked")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def brute_force(rows: list[dict]) -> list[dict]:
    """The result of ``op12_merkle`` for rows of documents, one level after the
    other in lists; for tests."""
    import zlib

    def leaf(row):
        values = ["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS]
        return hashlib.sha256("".join(values).encode()).hexdigest()

    def tree(digests):
        level, at, paths = list(digests), list(range(len(digests))), [[] for _ in digests]
        while len(level) > 1:
            for k, i in enumerate(at):
                other = i ^ 1
                paths[k].append((level[other], other < i) if other < len(level) else None)
                at[k] = i // 2
            level = [_h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0], paths

    rows = [dict(r) | {"leaf": leaf(r)} for r in rows]
    groups = sorted({r["lang"] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        mine = sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        trees[g] = (mine, *tree([r["leaf"] for r in mine]))
    if not rows:
        return []
    root, upper = tree([trees[g][1] for g in groups])
    out = []
    for g, above in zip(groups, upper):
        mine, subroot, paths = trees[g]
        for r, path in zip(mine, paths):
            path = path + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % TAMPER == 0
            at = leaf(r | {"n_chars": r["n_chars"] + 1}) if hit and r["n_chars"] is not None else r["leaf"]
            for step in path:
                at = _h(at) if step is None else _h(step[0], at) if step[1] else _h(at, step[0])
            out.append({
                "doc_id": r["doc_id"], "leaf": r["leaf"], "subroot": subroot, "root": root,
                "proof_sha256": _h(*[s[0] for s in path if s]), "folded_root": at, "verified": at == root,
            })
    return out
