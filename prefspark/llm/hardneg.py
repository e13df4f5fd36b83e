"""Operator 11, hard-negative mining with a cover tree over norm-augmented candidates.

A candidate x becomes (x, sqrt(M^2 - |x|^2)), M the largest norm, and an anchor q
becomes (q, 0). Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a tree over distances
bounds inner products: all candidates within r of a node's centre c have a distance
to q' between d - r and d + r, d = |q' - c'|.

1. The tree's upper level: centres of a cover of a bounded sample of ``SAMPLE`` rows,
   at most ``CELLS``. Every row goes to its nearest centre (a cell); the cell's radius
   is its exact covering radius. This is all that is sent to every task.
2. A cell's rows are dealt into chunks of about ``CHUNK`` rows by a hash of the id, so
   that equal or close vectors spread over as many tasks as they need. Each chunk has
   its own cover tree: a node's children cover it with a ``SHRINK``-th of its radius,
   the first around the node's own centre, and lie further than that from each
   other; every node has its exact covering radius. Children of fewer than
   ``LEAF`` rows are leaves, kept as loose rows of their parent.
3. A window is an interval of scores of one anchor, of which the best k are asked for.
   The search takes the best cell of each window first, then with the k-th score
   found so far all cells whose bounds meet the window above it. In a chunk, nodes
   are taken best bound first; those outside of every window are skipped, leaves are
   scored exactly. Windows are dealt into blocks of anchors, and one task holds a
   chunk and a block.
4. Positives are the best of one window without ends; negatives those of a window for
   each positive.

Scores are exact: all sums stay below 2**53. Results are exact; only the sample's
centres are fitted.

Defined results: rows with a null id, a null label, a null vector, a null or non-finite
component or a scaled norm of 2**26 or more take no part; shorter vectors count as padded
with zeros; equal rows count once; different rows of one id are candidates of their own,
and the one with the smallest label, then vector, is the anchor; a row is never a
candidate of an anchor with its id. Ties go to the smaller id. Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, saved, table

SCALE = 256
SAMPLE, CELLS = 4096, 1024
CHUNK, BLOCK = 2048, 1024
SHRINK, LEAF = 1.3, 16
POSITIVES, NEGATIVES = 5, 3
ANCHORS, RELABEL = 50, 7
LOW, HIGH = 50, 95  # percent of the positive's score
_CELL_BITS = 40
_FAR = 1 << 60  # no score is as large


def vectors(rows: DataFrame, vector: str | Column, vec_id: str | Column, label: str | Column) -> DataFrame:
    """(vec_id, label, v, norm2) of the rows that take part."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    need = rows.select(col(vec_id).cast("bigint").alias("vec_id"), col(label).cast("bigint").alias("label"), col(vector).cast("array<double>").alias("x"))
    good = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(2.0**26 / SCALE)), F.lit(False)))
    need = need.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    scaled = F.transform("x", lambda x: F.floor(x * SCALE).cast("int"))
    out = need.select("vec_id", "label", scaled.alias("v"))
    out = out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.where(F.col("norm2") < 2.0**52)


def matrix(column, width: int) -> np.ndarray:
    """A column of integer arrays as doubles, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    if (sizes == width).all():
        return values.reshape(len(column), width)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def augmented(x: np.ndarray, top2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top2 - (x * x).sum(axis=1)))[:, None]])


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt((d * d).sum(axis=1))


def cover(x: np.ndarray, members: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centre, members, distances) of balls of ``radius`` that cover ``members``,
    the first around ``centre``, the others around rows not covered before."""
    out, rest = [], members
    while len(rest):
        far = _far(x[rest], x[centre])
        near = far <= radius
        out.append((centre, rest[near], far[near]))
        rest = rest[~near]
        if len(rest):
            centre = int(rest[0])
    return out


def centres(x: np.ndarray, most: int) -> np.ndarray:
    """Centres of the finest cover of the sample with at most ``most`` balls."""
    members = np.arange(len(x))
    radius = float(_far(x, x[0]).max())
    found = [0]
    while radius > 0:
        radius /= SHRINK
        balls, rest, centre = [], members, 0
        while len(rest) and len(balls) <= most:  # stops as soon as there are too many
            balls.append(centre)
            rest = rest[_far(x[rest], x[centre]) > radius]
            centre = int(rest[0]) if len(rest) else 0
        if len(balls) > most:
            break
        found = balls
        if radius < 1e-3:
            break
    return x[found]


def bounds(score, norm2, top2: float, radius):
    """The least and greatest score of what lies within ``radius`` of a centre with
    ``score``, for anchors of squared norm ``norm2``; widened by the rounding."""
    far = np.sqrt(np.maximum(0.0, norm2 + top2 - 2 * score))
    slack = 1 + 1e-9 * (norm2 + top2)
    high = (norm2 + top2 - np.maximum(0.0, far - radius) ** 2) / 2
    low = (norm2 + top2 - (far + radius) ** 2) / 2
    reach = np.sqrt(norm2) * radius
    return np.maximum(low, score - reach) - slack, np.minimum(high, score + reach) + slack


class Tree:
    """Cover tree of a chunk. Rows are ordered so that a node's loose rows lie
    together; a node's children have consecutive numbers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top2: float):
        y = augmented(x, top2)
        start = int(np.argmin(ids))
        everyone = np.arange(len(ids))
        todo = [(start, everyone, _far(y, y[start]))]
        order, self.loose, self.children, self.radius, self.label, centre = [], [], [], [], [], []
        placed = 0
        at = 0
        while at < len(todo):
            c, members, far = todo[at]
            at += 1
            radius = float(far.max())
            balls = cover(y, members, c, radius / SHRINK) if radius > 0 and len(members) > LEAF else []
            large = [b for b in balls if len(b[1]) > LEAF]
            small = np.concatenate([b[1] for b in balls if len(b[1]) <= LEAF] or [members[:0]]) if balls else members
            order.append(small)
            self.loose.append((placed, placed + len(small)))
            placed += len(small)
            self.children.append((len(todo), len(todo) + len(large)))
            todo += large
            self.radius.append(radius)
            same = labels[members]
            self.label.append(int(same[0]) if (same == same[0]).all() else None)
            centre.append(c)
        self.centre = x[centre]
        order = np.concatenate(order)
        self.ids, self.labels, self.x, self.top2 = ids[order], labels[order], x[order], top2
        self.radius = np.array(self.radius)


def search(tree: Tree, anchor_ids, labels, q, of, lo, hi, least, k: int, same: bool):
    """(window, row of the tree, score) of the best ``k`` of each window, by score
    and then by id. Window w belongs to anchor ``of[w]`` and asks for scores from
    lo[w] to hi[w]; below ``least[w]`` none is needed."""
    norm2 = (q * q).sum(axis=1)
    floor = np.maximum(lo, least).astype(np.float64)
    best = np.full((len(of), k), -np.inf)
    found = []
    heap = []

    def consider(first: int, last: int, active: np.ndarray):
        """Push the nodes first..last-1 with the active windows that they may serve."""
        if first == last or not len(active):
            return
        who, back = np.unique(of[active], return_inverse=True)
        score = q[who] @ tree.centre[first:last].T
        low, high = bounds(score, norm2[who][:, None], tree.top2, tree.radius[first:last][None, :])
        low, high = low[back], high[back]
        meets = (high >= floor[active][:, None]) & (low <= hi[active][:, None])
        for n in range(first, last):
            label = tree.label[n]
            here = meets[:, n - first]
            if label is not None:
                here = here & ((labels[of[active]] == label) == same)
            if here.any():
                reach = np.minimum(high[here, n - first], hi[active][here])
                heapq.heappush(heap, (-float(reach.max()), n, active[here], high[here, n - first]))

    consider(0, 1, np.arange(len(of)))
    while heap:
        _, n, active, high = heapq.heappop(heap)
        active = active[high >= floor[active]]
        if not len(active):
            continue
        first, last = tree.loose[n]
        if last > first:
            who, back = np.unique(of[active], return_inverse=True)
            score = (q[who] @ tree.x[first:last].T)[back]
            mine = of[active]
            fits = (score >= floor[active][:, None]) & (score <= hi[active][:, None])
            fits &= (labels[mine][:, None] == tree.labels[first:last][None, :]) == same
            fits &= anchor_ids[mine][:, None] != tree.ids[first:last][None, :]
            all_ = np.concatenate([best[active], np.where(fits, score, -np.inf)], axis=1)
            best[active] = np.partition(all_, all_.shape[1] - k, axis=1)[:, -k:]
            floor[active] = np.maximum(floor[active], best[active].min(axis=1))
            w, p = np.nonzero(fits & (score >= floor[active][:, None]))
            found.append((active[w], p + first, score[w, p]))
        consider(*tree.children[n], active)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    w, p, s = (np.concatenate(c) for c in zip(*found))
    keep = s >= floor[w]
    w, p, s = w[keep], p[keep], s[keep]
    order = np.lexsort((tree.ids[p], -s, w))
    w, p, s = w[order], p[order], s[order]
    rank = np.arange(len(w)) - np.searchsorted(w, w)
    return w[rank < k], p[rank < k], s[rank < k].astype(np.int64)


class Index:
    """The saved trees of all rows (chunk, tree) and the cells' centres, radii,
    labels (None where they differ) and numbers of chunks."""

    def __init__(self, rows: DataFrame):
        prepare(rows.sparkSession)
        self.rows = saved(rows)
        told = self.rows.agg(F.count("*").alias("n"), F.max("norm2").alias("m"), F.max(F.size("v")).alias("w")).first()
        self.n, self.top2, self.width = told["n"], told["m"] or 0.0, max(told["w"] or 0, 1)
        if self.n:
            self._build()

    def _build(self):
        width, top2 = self.width, self.top2
        some = self.rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label", "v").limit(SAMPLE).select("v").toArrow()
        middle = centres(augmented(matrix(some.column("v"), width), top2), min(CELLS, -(-self.n // CHUNK)))
        square = (middle * middle).sum(axis=1)

        def nearest(batches):
            for b in batches:
                y = augmented(matrix(b.column("v"), width), top2)
                cell = np.argmin(square - 2 * (y @ middle.T), axis=1)
                far = _far(y, middle[cell])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(far)], [*b.schema.names, "cell", "far"])

        rows = self.rows.select("vec_id", "label", "v")
        placed = saved(rows.mapInArrow(nearest, "vec_id bigint, label bigint, v array<int>, cell bigint, far double"))
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("label").alias("a"), F.max("label").alias("b")).collect()
        cells = sorted(cells, key=lambda c: c["cell"])
        self.cells = [c["cell"] for c in cells]
        self.centre, self.radius = middle[self.cells][:, :width], np.array([c["far"] for c in cells])
        self.label = [c["a"] if c["a"] == c["b"] else None for c in cells]
        self.chunks = [-(-c["n"] // CHUNK) for c in cells]
        parts = rows.sparkSession.createDataFrame(list(zip(self.cells, self.chunks)), "cell bigint, k bigint")  # CELLS rows at most
        chunk = F.shiftleft("cell", _CELL_BITS) + F.pmod(F.xxhash64("vec_id"), F.col("k"))

        def build(key, group):
            ids = group.column("vec_id").to_numpy()
            labels, x = group.column("label").to_numpy(), matrix(group.column("v"), width)
            _, once = np.unique(np.column_stack([ids, labels, x.astype(np.int64)]), axis=0, return_index=True)
            tree = Tree(ids[once], labels[once], x[once], top2)
            tree.x = tree.x.astype(np.int32)  # as doubles again when it is read
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

        chunked = placed.join(F.broadcast(parts), "cell").select(chunk.alias("chunk"), "vec_id", "label", "v")
        self.trees = saved(chunked.groupBy("chunk").applyInArrow(build, "chunk bigint, tree binary"))

    def _visits(self, windows: DataFrame, first: bool, same: bool) -> DataFrame:
        """``windows`` with the chunks to be searched: those of the best cell, or all
        others whose bounds meet the window above ``least``."""
        width, top2, centre, radius, cells, counts = self.width, self.top2, self.centre, self.radius, self.cells, self.chunks
        known = np.array([x is not None for x in self.label])
        label = np.array([x if x is not None else 0 for x in self.label])

        def run(batches):
            for b in batches:
                q = matrix(b.column("v"), width)
                lo, hi, least = (b.column(c).to_numpy() for c in ("lo", "hi", "least"))
                low, high = bounds(q @ centre.T, (q * q).sum(axis=1)[:, None], top2, radius[None, :])
                fits = (high >= lo[:, None]) & (low <= hi[:, None])
                fits &= ~known | ((b.column("label").to_numpy()[:, None] == label) == same)
                reach = np.where(fits, np.minimum(high, hi[:, None]), -np.inf)
                best = reach.argmax(axis=1)
                chosen = np.zeros_like(fits)
                chosen[np.arange(len(q)), best] = fits[np.arange(len(q)), best]
                if not first:
                    chosen = fits & ~chosen & (high >= least[:, None])
                chunks = [[(cells[c] << _CELL_BITS) + k for c in np.flatnonzero(row) for k in range(counts[c])] for row in chosen]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.list_(pa.int64()))], [*b.schema.names, "chunks"])

        given = "anchor_id bigint, w bigint, label bigint, v array<int>, lo bigint, hi bigint, least bigint, block bigint"
        visits = windows.mapInArrow(run, f"{given}, chunks array<bigint>")
        return visits.select("anchor_id", "w", "label", "v", "lo", "hi", "least", "block", F.explode("chunks").alias("chunk"))

    def _searched(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        width = self.width

        def run(asked, trees):
            if not trees.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "w", "id", "score")})
            tree = pickle.loads(trees.column("tree")[0].as_py())
            tree.x = tree.x.astype(np.float64)
            anchors, one, of = np.unique(asked.column("anchor_id").to_numpy(), return_index=True, return_inverse=True)
            q, labels = matrix(asked.column("v"), width)[one], asked.column("label").to_numpy()[one]
            lo, hi, least, names = (asked.column(c).to_numpy() for c in ("lo", "hi", "least", "w"))
            w, p, s = search(tree, anchors, labels, q, of, lo, hi, least, k, same)
            return pa.table({"anchor_id": anchors[of[w]], "w": names[w], "id": tree.ids[p], "score": s})

        visits = saved(visits)
        wanted = visits.select(F.col("chunk").alias("of"), F.col("block").alias("by")).distinct()
        wanted = wanted.join(self.trees, F.col("of") == F.col("chunk")).select("of", "by", "tree")
        out = visits.groupBy("chunk", "block").cogroup(wanted.groupBy("of", "by"))
        return out.applyInArrow(run, "anchor_id bigint, w bigint, id bigint, score bigint")

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, w, id, score, rank): the best ``k`` rows of the same label, or
        of other labels, of each window (anchor_id, w, label, v, lo, hi)."""
        blocks = -(-windows.select("anchor_id").distinct().count() // BLOCK) or 1
        windows = saved(windows.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("bigint")))
        asked = lambda w: w.select("anchor_id", "w", "label", "v", "lo", "hi", "least", "block")
        place = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id"))
        ranked = lambda found: found.withColumn("rank", place).where(F.col("rank") <= k)
        start = windows.withColumn("least", F.lit(-_FAR).cast("bigint"))
        found = saved(ranked(self._searched(self._visits(asked(start), True, same), k, same)))
        told = found.where(F.col("rank") == k).select("anchor_id", "w", F.col("score").alias("least"))
        rest = windows.join(told, ["anchor_id", "w"], "left").withColumn("least", F.coalesce("least", F.lit(-_FAR).cast("bigint")))
        more = self._searched(self._visits(asked(rest), False, same), k, same)
        return saved(ranked(found.drop("rank").union(more)))


def mine(rows: DataFrame, anchors: Column) -> DataFrame:
    """Hard negatives of the ``vectors`` rows for which ``anchors`` holds."""
    index = Index(rows)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not index.n:
        return rows.sparkSession.createDataFrame([], schema)
    chosen = index.rows.where(anchors).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("r"))
    chosen = chosen.select("anchor_id", "r.label", "r.v")
    everything = [F.lit(x).cast("bigint").alias(c) for c, x in (("w", 0), ("lo", -_FAR), ("hi", _FAR))]
    positives = index.best(chosen.select("*", *everything), POSITIVES, True)
    positives = positives.select("anchor_id", F.col("id").alias("w"), F.col("score").alias("positive_score"))
    share = lambda percent: F.col("positive_score") * percent
    lo = F.call_function("div", share(LOW) + F.pmod(-share(LOW), F.lit(100)), F.lit(100))  # rounded up
    hi = F.call_function("div", share(HIGH) - F.pmod(share(HIGH), F.lit(100)), F.lit(100))  # rounded down
    windows = positives.join(chosen, "anchor_id").withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    negatives = index.best(windows.select("anchor_id", "label", "v", "w", "lo", "hi"), NEGATIVES, False)
    out = negatives.join(positives, ["anchor_id", "w"])
    return out.select(
        "anchor_id", F.col("w").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors(rows, "embedding", "vec_id", label), F.col("vec_id") % ANCHORS == 0)


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The result of ``op11_hard_negatives`` for (vec_id, embedding, label) rows with
    different ids, by scoring everything; for tests."""
    some = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        some[vec_id] = ((label + 1) % 10 if vec_id % RELABEL == 0 else label, [math.floor(SCALE * c) for c in x])
    out = []
    for a, (label, q) in some.items():
        if a % ANCHORS:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v)), d) for d, (_, v) in some.items() if d != a)
        for s, p in [x for x in scores if some[x[1]][0] == label][:POSITIVES]:
            fits = [x for x in scores if some[x[1]][0] != label and LOW * -s <= 100 * -x[0] <= HIGH * -s]
            out += [(a, p, k + 1, d, -s, -t) for k, (t, d) in enumerate(fits[:NEGATIVES])]
    return out
