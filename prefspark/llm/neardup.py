"""Operator 4, near-duplicate detection by ProbMinHash over weighted shingles.

A document's shingles are its five-word windows (words split at white space,
ASCII lower-cased; a text of fewer words is one shingle), weighted by how often
they occur. Similarity is the probability Jaccard of the two weight vectors,
which for equal weights is the Jaccard similarity of the shingle sets.

1. Sketch: every shingle sends a Poisson process of arrivals with its weight as
   rate; each arrival falls into one of ``REGISTERS`` registers, which keeps its
   earliest. A process stops once its next arrival is later than the latest kept
   one. Two registers agree with the probability Jaccard.
2. Texts with equal weighted shingles are one node (the smallest id).
3. Banding: ``BANDS`` bands of ``ROWS`` registers; at similarity 0.8 a pair
   shares a band with probability 0.9998. Texts that share buckets, directly or
   through others, are a group; each text is tied to its buckets' smallest ids only.
4. Verification inside the groups. A group is dealt into blocks of bounded size; every
   two of them meet in one task, which carries sorted shingle hashes and counts instead of
   texts. Inverted lists give a text's shared mass, the sum of the smaller shares of
   the common shingles, with all texts of the other block at once. Similarity is at most
   this mass m and at least m / (2 - m); between these bounds it is computed.
   Texts that are connected already are not compared any more, and a task
   returns a spanning forest of its links, not its pairs.
5. Classes are the connected components; the class id is the smallest doc id.

Defined results: a null, empty or blank text has no shingles and is a class of
its own; rows that repeat a doc id are one document; a null id is kept, with a
null class, and never compared; an empty table gives no rows; other columns are
ignored by ``classes`` and carried unchanged by ``deduplicate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import mix64, prepare, runs, saved, table, unit, utf8_buffer

SHINGLE = 5
SIMILAR = 0.8
#: Similarities are sums of doubles: one of exactly the threshold may come out below it.
ROUNDING = 1e-9
BANDS, ROWS = 36, 7
#: A block's texts and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Text that is hashed, or sent on as shingles, at once; both take many times its size.
RUN_BYTES = 1 << 18
REGISTERS = BANDS * ROWS
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.full(size, x, np.uint64)) for x in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words start
    (one entry more than texts). Works on the UTF-8 buffer as a whole."""
    base = offsets[0]
    raw = _LOWER[data[base : offsets[-1]]]
    cuts = offsets - base
    ink = ~_BLANK[raw]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    at_cut = cuts[:-1][cuts[:-1] < len(raw)]
    start[at_cut] = ink[at_cut]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    last_of = cuts[1:][cuts[1:] > 0] - 1
    end[last_of] = ink[last_of]
    ends = np.flatnonzero(end) + 1
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, cuts)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text's word hashes (sorted), and counts."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(n, SHINGLE)
    key = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        key += words[k : n - size + 1 + k] * _STEP[k]
    return np.unique(mix64(key + np.uint64(size)), return_counts=True)


def sketch(keys: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each register the shingle whose arrival came first.

    Arrivals are drawn in blocks; an element goes on while its last arrival is
    not later than the latest register."""
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    live, clock, drawn = np.arange(len(keys)), np.zeros(len(keys)), 0
    block = max(2, int(1.5 * registers * np.log(registers) / len(keys)))
    while len(live):
        step = mix64(np.arange(drawn, drawn + block, dtype=np.uint64))
        h = mix64(keys[live][:, None] ^ step[None, :])
        gaps = -np.log(unit(h)) / weights[live][:, None]
        times = clock[live][:, None] + np.cumsum(gaps, axis=1)
        slot = ((h & np.uint64(0xFFFF)) * np.uint64(registers) >> np.uint64(16)).astype(np.int64)
        t, s = times.ravel(), slot.ravel()
        early = np.flatnonzero(t < first.max())
        order = early[np.argsort(-t[early], kind="stable")]  # the earliest is written last
        better = order[t[order] < first[s[order]]]
        first[s[better]] = t[better]
        winner[s[better]] = keys[live][better // block]
        clock[live] = times[:, -1]
        live = live[clock[live] <= first.max()]
        drawn += block
        block = max(2, min(block, 64))
    return winner


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted keys, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1] / a[1].sum()
    y[np.searchsorted(keys, b[0])] = b[1] / b[1].sum()
    both = np.flatnonzero((x > 0) & (y > 0))
    ratio, of = np.unique(y[both] / x[both], return_inverse=True)
    share = np.bincount(of, x[both])
    return float(sum(s / np.maximum(x, y / r).sum() for r, s in zip(ratio, share)))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, bands) per row; n is the number of different shingles. A
    null key and no bands without words."""

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffer(b.column(1))
            keys, sizes, bands = [], [], []
            for i, j in runs(offsets, RUN_BYTES):
                hashes, at = word_hashes(data, offsets[i : j + 1])
                for k in range(j - i):
                    s, w = shingles(hashes[at[k] : at[k + 1]])
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        bands.append([])
                        continue
                    keys.append(hashlib.blake2b(s.tobytes() + w.tobytes(), digest_size=16).digest())
                    rows = sketch(s, w).reshape(BANDS, ROWS)
                    band = mix64(np.arange(BANDS, dtype=np.uint64))
                    for r in range(ROWS):
                        band = mix64(band ^ rows[:, r])
                    bands.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "bands"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, text_key binary, n bigint, bands array<bigint>")


def _rooted(up: DataFrame) -> DataFrame:
    """``up`` (node, up), where every ``up`` is smaller than its node, with the last
    node of each chain as ``up``; a chain's length doubles with every saved table."""
    while True:
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = saved(up.join(jump, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("node", "up")
        up = step.select("node", "up")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the smallest id of each
    connected component. Every node with smaller neighbours hooks to the smallest of
    them, the trees of hooks shrink to their roots, and the edges between roots are
    the next round's: each round has only what the one before left apart."""
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    links = saved(edges.select(*ends).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    links, rounds = links.where("a <> b"), []
    while not links.isEmpty():
        up = _rooted(saved(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))))
        rounds.append(up)
        above = up.select(F.col("node").alias("a"), F.col("up").alias("at"))
        below = up.select(F.col("node").alias("b"), F.col("up").alias("bt"))
        met = links.join(above, "a").join(below, "b", "left").select(F.col("at").alias("a"), F.coalesce("bt", "b").alias("b"))
        links = saved(met.where("a <> b").select(*ends).distinct())
    if not rounds:
        return nodes.select("node", F.col("node").alias("label"))
    found = rounds.pop()
    for up in reversed(rounds):  # a later round's nodes are roots of this one
        last = found.select(F.col("node").alias("up"), F.col("up").alias("root"))
        found = saved(up.join(last, "up", "left").select("node", F.coalesce("root", "up").alias("up")).union(found))
    return nodes.join(found, "node", "left").select("node", F.coalesce("up", "node").alias("label"))


def _grouped(nodes: DataFrame) -> DataFrame:
    """(doc_id, grp) of the nodes (doc_id, bands) that share a bucket with others."""
    entries = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    met = entries.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    edges = entries.join(met.select("bucket", "low"), "bucket").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    return components(edges).select(F.col("node").alias("doc_id"), F.col("label").alias("grp"))


def _meetings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, grp, n) with ``tasks``: each (i, j, asks), the meeting of
    blocks i and j of the group, in which the texts of block j ask those of block i."""
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = nodes.groupBy("grp").agg(parts.alias("k"))
    placed = nodes.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    told = F.transform(F.sequence("block", F.col("k") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(False).alias("asks")))
    asking = F.transform(F.sequence(F.lit(0), F.col("block") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("asks")))
    return placed.withColumn("tasks", F.when(F.col("block") == 0, told).otherwise(F.concat(told, asking)))


def _shingled(keep: list[str]):
    """The function of batches with ``text`` that gives the columns ``keep`` and the
    shingles, a batch for each run of text."""

    def run(batches):
        for b in batches:
            data, offsets = utf8_buffer(b.column("text"))
            for i, j in runs(offsets, RUN_BYTES):
                hashes, at = word_hashes(data, offsets[i : j + 1])
                found = [shingles(hashes[at[k] : at[k + 1]]) for k in range(j - i)]
                keys = pa.array([s.view(np.int64) for s, _ in found], pa.list_(pa.int64()))
                counts = pa.array([w.astype(np.int32) for _, w in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), keys, counts], [*keep, "shingles", "counts"])

    return run


def _with_shingles(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes`` with their texts' sorted shingle hashes and counts."""
    rows = docs.join(nodes, "doc_id")
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_shingled(keep), f"{schema}, shingles array<bigint>, counts array<int>")


def _linked(least: float):
    """The function of a meeting and its rows that gives a spanning forest of the links."""

    def run(meeting, group):
        _, i, j = (x.as_py() for x in meeting)
        ids = group.column("doc_id").to_pylist()
        sets = [(s.view(np.uint64), w) for s, w in zip(group.column("shingles").to_numpy(), group.column("counts").to_numpy())]
        asks = np.array(group.column("asks").to_pylist(), bool)
        root = list(range(len(ids)))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        first = {}
        for k, d in enumerate(ids):  # the texts of one id are one node
            root[k] = first.setdefault(d, k)
        told = np.flatnonzero(~asks)
        sizes = np.array([len(sets[k][0]) for k in told], np.int64)
        keys = np.concatenate([sets[k][0] for k in told] or [np.zeros(0, np.uint64)])
        share = np.concatenate([sets[k][1] / sets[k][1].sum() for k in told] or [np.zeros(0)])
        order = np.argsort(keys, kind="stable")
        keys, share, of = keys[order], share[order], np.repeat(np.arange(len(told)), sizes)[order]
        edges = []
        for k in told if i == j else np.flatnonzero(asks):
            s, w = sets[k]
            a, b = np.searchsorted(keys, s), np.searchsorted(keys, s, side="right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mass = np.bincount(of[at], np.minimum(share[at], np.repeat(w / w.sum(), n)), len(told))
            for c in np.flatnonzero(mass >= least):
                x, y = top(k), top(told[c])
                if x != y and (mass[c] / (2 - mass[c]) >= least or similarity(sets[k], sets[told[c]]) >= least):
                    root[x] = y
                    edges.append((ids[k], ids[told[c]]))
        kind = group.schema.field("doc_id").type
        return pa.table({"a": pa.array([x for x, _ in edges], kind), "b": pa.array([y for _, y in edges], kind)})

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, text_id (the smallest id with the same
    weighted shingles) and class_id (the smallest id of its class)."""
    prepare(docs.sparkSession)
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = saved(sketches(need))
    nodes = rows.where("text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("text_id"))
    of_text = rows.select("doc_id", "text_key").distinct().join(nodes, "text_key", "left")
    of_text = saved(of_text.select("doc_id", F.coalesce("text_id", "doc_id").alias("text_id")))
    own = of_text.where("doc_id = text_id").select("doc_id").distinct()
    distinct = rows.where("size(bands) > 0").join(own, "doc_id", "left_semi")
    groups = saved(_grouped(distinct.select("doc_id", "bands")))
    sizes = distinct.groupBy("doc_id").agg(F.max("n").alias("n"))
    placed = _meetings(groups.join(sizes, "doc_id")).select("doc_id", "grp", "tasks")
    met = _with_shingles(placed, need).select("doc_id", "grp", "shingles", "counts", F.explode("tasks").alias("t"))
    met = met.select("doc_id", "grp", "shingles", "counts", "t.*")
    id_type = need.schema["doc_id"].dataType.simpleString()
    # A sum of doubles may come out below a similarity of exactly the least.
    edges = saved(met.groupBy("grp", "i", "j").applyInArrow(_linked(least - ROUNDING), f"a {id_type}, b {id_type}"))
    labels = components(edges)
    named = of_text.join(labels, of_text["text_id"] == labels["node"], "left")
    return named.select("doc_id", "text_id", F.coalesce("label", "text_id").alias("class_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """``docs`` with only the document of the smallest id of each class; columns
    as they came, rows with a null id stay."""
    found = saved(classes(docs, id_col, text_col, least))
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def brute_force(texts: dict[int, str | None], least: float = SIMILAR) -> dict[int, int]:
    """Classes by comparing all pairs; for tests."""
    from collections import Counter

    def weighted(text):
        words = [w.lower() if w.isascii() else w for w in (text or "").split()]
        size = min(SHINGLE, len(words))
        return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else Counter()

    sets = {d: weighted(t) for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            tx, ty = sum(x.values()), sum(y.values())
            j = 0.0
            for d in x.keys() & y.keys():
                j += 1 / sum(max(x[k] / tx / (x[d] / tx), y[k] / ty / (y[d] / ty)) for k in x.keys() | y.keys())
            if j >= least - 1e-9:
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {d: root(d) for d in texts}
