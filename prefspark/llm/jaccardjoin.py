"""Operator 13, n-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set are its distinct four-word shingles (words split at white space,
ASCII lower-cased; a text of fewer words is one shingle). Two documents link when
100 * |intersection| >= 85 * |union|; the result are the links' components and counts.

1. Candidate groups, without pairs. Linked sets differ by few shingles: at most
   P - 1 of a set x are missing in the other, with P = |x| - ceil(0.85 |x|) + 1. This
   holds also among the shingles whose hash lies below a bound that both sets use, so
   any common order of the shingles puts the rarest shared one among the P rarest of
   either. Only these shingles (about a quarter) are counted: a set of which P
   occur nowhere else has no partner; what else belongs to the P rarest joins
   the set to the other holders, and groups are the connected components of that. Bounds are
   common to sets of ``2**g`` to ``2**(g+1)`` shingles; the largest of these also take
   part under the next bound. A set with fewer than P shingles below its bound would
   break the argument, so then the bounds are raised and the pass is made again.
2. Equal sets are one node, the smallest id.
3. Search. The sets of a group are dealt by size class (sizes of linked sets are at
   most one class apart) into blocks of bounded size, and every two blocks that can
   hold a link meet in one task. There the inverted lists of one block are searched
   with the sets of the other: T = ceil(0.85 |x|) lists must name a partner; the L
   longest lists are set aside, the short ones are merged with a heap, what they
   name T - L times is probed in the long ones by binary search, and what reaches
   the overlap that both sizes require is a link.
4. A task returns a spanning forest of its links and the number of links of each
   document, never the links. Component ids are the smallest doc_id.

Compared pairs grow with the square of the different near copies of one size class of
one group, as each link is counted; rows do not, and no task holds more than two blocks.

Defined results: null, empty or blank texts have an empty set, no links and
their own component; rows that repeat a doc id are rows of the result, one document
where their texts are equal and otherwise judged by each text; a null id is kept, with a null component, and links with nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import mix64, prepare, runs, saved, table, utf8_buffer
from prefspark.llm.neardup import components, word_hashes

SHINGLE = 4
LEAST = 85  # percent
#: The chance that a set has fewer than P shingles below its hash bound.
ODDS = 1e-10
#: A block's documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: DivideSkip's weight of a long list's probe against the merge of short ones.
MU = 0.0085
_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, SHINGLE)
    key = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        key += words[k : n - size + 1 + k] * _STEP[k]
    return np.unique(mix64(key + np.uint64(size)))


def sets_of(column):
    """The sets of a column of texts, one after the other."""
    data, offsets = utf8_buffer(column)
    for i, j in runs(offsets, 1 << 20):
        hashes, at = word_hashes(data, offsets[i : j + 1])
        for k in range(j - i):
            yield shingle_set(hashes[at[k] : at[k + 1]])


def required(n: int) -> int:
    """The least overlap of a set of n shingles with a linked one."""
    return -(-LEAST * n // 100)


def _key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _bound(g: int, odds: float) -> int:
    """The hash bound of the sets of 2**g shingles or more: by Chernoff's inequality
    fewer than P of them lie below it with a chance of at most ``odds``."""
    n = 1 << g
    a = (n - required(n)) / n
    low, high = a, 1.0
    for _ in range(50):
        s = (low + high) / 2
        far = (a * math.log(a / s) if a else 0.0) + (1 - a) * math.log((1 - a) / (1 - s))
        low, high = (s, high) if n * far < -math.log(odds) else (low, s)
    return (1 << 64) - 1 if high > 0.9 else int(high * 2.0**64)


def signatures(docs: DataFrame, odds: float) -> DataFrame:
    """(doc_id, key, n, need, low, next, whole): the shingles below the bound of the
    set's class and, for sets that can link with larger classes, below the next one's;
    each mixed with its class. ``whole`` is false where there are fewer than ``need``."""

    bounds = [_bound(g, odds) for g in range(48)]

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("key", "n", "need", "low", "next", "whole")}
            for s in sets_of(b.column(1)):
                n = len(s)
                need = n - required(n) + 1 if n else 0
                g = max(n.bit_length() - 1, 0)
                parts = []
                for c in (g, g + 1):
                    used = n and (c == g or 100 * n >= LEAST * (1 << c))
                    low = s[: np.searchsorted(s, np.uint64(bounds[c]), side="right")] if used else s[:0]
                    parts.append(low)
                    out["next" if c > g else "low"].append(mix64(low ^ np.uint64(c)).view(np.int64))
                out["key"].append(_key(s))
                out["n"].append(n)
                out["need"].append(need)
                out["whole"].append(len(parts[0]) >= need and (len(parts[1]) >= need or 100 * n < LEAST * (2 << g) or not n))
            types = {"key": pa.binary(), "n": pa.int64(), "need": pa.int64(), "low": pa.list_(pa.int64()), "next": pa.list_(pa.int64()), "whole": pa.bool_()}
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[c], t) for c, t in types.items()]], ["doc_id", *types])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, key binary, n bigint, need bigint, low array<bigint>, next array<bigint>, whole boolean")


def _signed(docs: DataFrame) -> DataFrame:
    odds = ODDS
    while True:
        rows = saved(signatures(docs, odds).withColumn("row", F.monotonically_increasing_id()))
        if rows.where("not whole").isEmpty():
            return rows
        odds **= 2


def _groups(rows: DataFrame) -> DataFrame:
    """(doc_id, grp): the documents with possible partners, and their group."""
    rows = rows.where("doc_id is not null and n > 0")
    part = lambda c, bit: rows.select((F.col("row") * 2 + bit).alias("row"), "doc_id", "need", F.col(c).alias("low"))
    parts = part("low", 0).union(part("next", 1).where("size(low) > 0"))
    entries = parts.select("row", F.explode("low").alias("token"))
    shared = parts.select("doc_id", F.explode("low").alias("token")).groupBy("token")
    shared = shared.agg(F.count("*").alias("df"), F.min("doc_id").alias("least")).where("df > 1")
    held = entries.join(shared, "token").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "token", "least"))).alias("held"))
    # Of the set's P rarest shingles, those that occur nowhere else come first.
    own = parts.select("row", "doc_id", (F.col("need") - F.size("low")).alias("short"))
    left = F.greatest(F.col("short") + F.size("held"), F.lit(0))
    edges = own.join(held, "row").select("doc_id", F.explode(F.array_distinct(F.transform(F.slice("held", 1, left.cast("int")), lambda x: x["least"]))).alias("b"))
    return components(edges.select(F.col("doc_id").alias("a"), "b")).select(F.col("node").alias("doc_id"), F.col("label").alias("grp"))


def _meetings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, grp, n, ...) with ``tasks``: each (cls, up, i, j, asks),
    a meeting of block i of a size class with block j of the same or the next."""
    cls = F.floor(F.log(F.col("n")) / math.log(100 / (LEAST - 0.1))).cast("int")
    nodes = nodes.withColumn("cls", cls)
    counts = nodes.groupBy("grp", "cls").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    counts = saved(counts.select("grp", "cls", "m", parts.alias("k")))
    above = counts.select("grp", (F.col("cls") - 1).alias("cls"), F.col("k").alias("k_up"))
    below = counts.select("grp", (F.col("cls") + 1).alias("cls"), F.col("k").alias("k_down"))
    placed = nodes.join(counts, ["grp", "cls"]).join(above, ["grp", "cls"], "left").join(below, ["grp", "cls"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))

    def tasks(first, last, kind, up, i, j, asks):
        """A meeting for each x from first to last - 1; i and j are functions of x."""
        some = F.transform(F.sequence(first, last - 1), lambda x: F.struct(kind.alias("cls"), F.lit(up).alias("up"), i(x).alias("i"), j(x).alias("j"), asks(x).alias("asks")))
        return F.when(first < last, some)

    zero, block, k = F.lit(0), F.col("block"), F.col("k")
    mine = lambda x: block
    other = lambda x: x
    alone = F.col("m") < 2
    lists = [
        F.when(~alone, tasks(block, k, F.col("cls"), False, mine, other, lambda x: F.lit(False))),
        F.when(~alone, tasks(zero, block, F.col("cls"), False, other, mine, lambda x: F.lit(True))),
        tasks(zero, F.coalesce("k_up", zero), F.col("cls"), True, mine, other, lambda x: F.lit(False)),
        tasks(zero, F.coalesce("k_down", zero), F.col("cls") - 1, True, other, mine, lambda x: F.lit(True)),
    ]
    empty = F.array().cast("array<struct<cls:int,up:boolean,i:int,j:int,asks:boolean>>")
    return placed.withColumn("tasks", F.concat(*[F.coalesce(x, empty) for x in lists])).where("size(tasks) > 0")


class Lists:
    """Inverted lists of some sets: a sorted array of (token number, set number)."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.tokens, of = np.unique(tokens, return_inverse=True)
        self.postings = np.sort(of.astype(np.int64) * self.count + np.repeat(np.arange(self.count), self.sizes))
        self.starts = np.searchsorted(self.postings, np.arange(len(self.tokens) + 1) * self.count)
        self.sets_at = self.postings % max(self.count, 1)

    def partners(self, s: np.ndarray, after: int = -1) -> np.ndarray:
        """Numbers, greater than ``after``, of the sets that link with ``s``."""
        none = np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == s] if len(self.tokens) else at[:0]
        need = required(len(s))
        if len(at) < need:
            return none
        lengths = self.starts[at + 1] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        aside = min(need - 1, int(need / (MU * math.log2(max(2, int(lengths.max()))) + 1)))
        short, long = at[: len(at) - aside], np.sort(at[len(at) - aside :])
        merged = heapq.merge(*[self.sets_at[self.starts[t] : self.starts[t + 1]].tolist() for t in short])
        found = [(k, n) for k, run in itertools.groupby(merged) if k > after and (n := sum(1 for _ in run)) >= need - aside]
        if not found:
            return none
        who, overlap = np.array(found, np.int64).T
        for first in range(0, len(long), max(1, (1 << 20) // len(who))):
            some = long[first : first + max(1, (1 << 20) // len(who))]
            probe = some[:, None] * self.count + who[None, :]
            place = np.searchsorted(self.postings, probe)
            place[place == len(self.postings)] = 0
            overlap = overlap + (self.postings[place] == probe).sum(axis=0)
        union = len(s) + self.sizes[who] - overlap
        return who[100 * overlap >= LEAST * union]


def _search(meeting, group):
    """Links between the sets that ask and the others or, where a block meets itself,
    among its sets: spanning edges (a, b) and numbers of links (a, links)."""
    _, _, up, i, j = (x.as_py() for x in meeting)
    within = i == j and not up
    once = {x: k for k, x in enumerate(zip(*(group.column(c).to_pylist() for c in ("doc_id", "key", "asks"))))}
    group = group.take(sorted(once.values()))
    ids, weights = group.column("doc_id").to_pylist(), np.array(group.column("copies").to_pylist(), np.int64)
    sets = [np.array(x, np.int64).view(np.uint64) for x in group.column("shingles").to_numpy()]
    asks = np.array(group.column("asks").to_pylist(), bool)
    told = np.flatnonzero(~asks)
    lists = Lists([sets[k] for k in told])
    links = np.zeros(len(ids), np.int64)
    root = list(range(len(ids)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b, n = [], [], []
    for place, k in enumerate(told if within else np.flatnonzero(asks)):
        found = told[lists.partners(sets[k], place if within else -1)]
        found = [f for f in found if ids[f] != ids[k]]
        if not found:
            continue
        links[k] += weights[found].sum()
        np.add.at(links, found, weights[k])
        for f in found:
            x, y = top(k), top(f)
            if x != y:
                root[x] = y
                a.append(ids[k])
                b.append(ids[f])
                n.append(0)
    some = np.flatnonzero(links)
    a += [ids[k] for k in some]
    b += [None] * len(some)
    n += links[some].tolist()
    kind = group.schema.field("doc_id").type
    return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind), "links": pa.array(n, pa.int64())})


def _with_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, key, ...) with their shingles."""
    rows = docs.join(nodes, "doc_id")
    keep = [c for c in rows.columns if c != "text"]
    at = keep.index("key")

    def run(batches):
        for b in batches:
            sets = list(sets_of(b.column("text")))
            cols = [b.column(c) for c in keep]
            same = pa.array([_key(s) == k for s, k in zip(sets, cols[at].to_pylist())], pa.bool_())
            shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*cols, shingles], [*keep, "shingles"]).filter(same)

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, shingles array<bigint>")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links."""
    prepare(docs.sparkSession)
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _signed(need)
    members = saved(_groups(rows))
    named = rows.select("doc_id", "key", "n")
    # Equal sets fall into one group, so the nodes are found among the members alone.
    of_key = saved(named.join(members, "doc_id").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.min("n").alias("n"), F.min("grp").alias("grp")))
    several = of_key.groupBy("grp").agg(F.count("*").alias("sets")).where("sets > 1").select("grp")
    nodes = _meetings(of_key.join(several, "grp").withColumnRenamed("rep", "doc_id"))
    nodes = nodes.select("doc_id", "key", "grp", "copies", "tasks")
    met = _with_sets(nodes, need).select("doc_id", "key", "grp", "copies", "shingles", F.explode("tasks").alias("t"))
    met = met.select("doc_id", "key", "grp", "copies", "shingles", "t.*")
    id_type = need.schema["doc_id"].dataType.simpleString()
    found = saved(met.groupBy("grp", "cls", "up", "i", "j").applyInArrow(_search, f"a {id_type}, b {id_type}, links bigint"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    told = of_key.select("key", "rep", "copies").join(links, "rep", "left").join(labels, "rep", "left")
    told = told.withColumnRenamed("rep", "text_id").withColumnRenamed("key", "of")
    out = named.join(told, (F.col("key") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "text_id", "doc_id").alias("component_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    )


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, int]]:
    """doc_id: (n_shingles, component_id, n_links) by comparing all pairs; for tests."""
    import re

    sets = {}
    for d, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        size = min(SHINGLE, len(words))
        sets[d] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()
    links = {d: [e for e in texts if e != d and sets[d] and 100 * len(sets[d] & sets[e]) >= LEAST * len(sets[d] | sets[e])] for d in texts}
    out = {}
    for d in texts:
        seen, todo = {d}, [d]
        while todo:
            todo = [e for x in todo for e in links[x] if e not in seen and not seen.add(e)]
        out[d] = (len(sets[d]), min(seen), len(links[d]))
    return out
