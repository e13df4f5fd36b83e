"""Epochs over pair sets, without sorting them per epoch and without writing them.

A training set is given as *groups*: one narrow row per prompt, with its key columns
(in insertion order) and the number of its pairs. Its pairs need not exist: a question with
n scored answers owns the positions 0 .. n(n-1)/2 - 1, and ``unrank`` turns a position
into the two answers.

- ``ordinals.dense_index`` numbers the groups once (the only range exchange, over the
  narrow keys).
- ``permuted`` maps a number to its rank in an epoch: a Feistel network keyed by
  (seed, epoch) over a grid of at least n cells, with cycle walking where the grid is
  larger. An epoch's order is arithmetic, whatever the number of epochs.
- The pairs before a group are prefix sums over the ranks: sums per block of
  ``BLOCK`` ranks (a short table), then a running sum within the block.
- ``drawn`` turns the groups that meet a range of positions into positions; nothing
  else is emitted, so one batch costs one batch of rows.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.operators import ordinals
from prefspark.session import materialize

ROUNDS = 6
#: Ranks whose running sum is made in one task.
BLOCK = 1 << 16
#: Steps of a cycle walk. A walk visits each surplus cell of the grid once at most, and
#: of n cells fewer than sqrt(n) are surplus: only for n > WALK**2 could more be needed,
#: with a chance of n**(-WALK / 2).
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest nearly square grid of at least ``n`` cells."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(ix: Column, n: int, seed: int, epoch: Column) -> Column:
    """Rank of item ``ix`` (0-based, of ``n``) in the order of the epoch."""
    a, b = grid(n)

    def mixed(j, y):
        text = F.concat_ws("\u0001", F.lit(str(seed)), epoch.cast("string"), j.cast("string"), y.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

    def turn(acc, j):
        first = j % 2 == 0
        left = F.when(first, F.pmod(acc["l"] + mixed(j, acc["r"]), F.lit(a))).otherwise(acc["l"])
        right = F.when(first, acc["r"]).otherwise(F.pmod(acc["r"] + mixed(j, acc["l"]), F.lit(b)))
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def once(x):
        start = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["l"] * b + acc["r"])

    first = once(ix.cast("bigint"))
    if a * b == n:
        return first
    steps = F.sequence(F.lit(1), F.lit(min(WALK, a * b - n + 1)))
    walked = F.aggregate(steps, first, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def unrank(position: Column, n: Column) -> tuple[Column, Column]:
    """The pair (i, j), i < j, at a position of the lexicographic order of the pairs
    of ``n`` items. Counted from the end, the pairs with the same i form a triangle's
    row, whose number is a triangular root; the root of a double is set right by one."""
    back = F.call_function("div", n * (n - 1), F.lit(2)) - 1 - position
    below = lambda k: F.call_function("div", k * (k + 1), F.lit(2))
    root = F.floor((F.sqrt(F.lit(8.0) * back + 1) - 1) / 2).cast("bigint")
    row = F.when(below(root) > back, root - 1).when(below(root + 1) <= back, root + 1).otherwise(root)
    return n - 2 - row, n - 1 - (back - below(row))


class Schedule:
    """Epochs over ``groups``: key columns, in insertion order and unique together,
    and ``n_pairs``. Further columns of the groups are carried along."""

    def __init__(self, groups: DataFrame, keys: list[str], seed: int = 0, shuffle: bool = True):
        self.keys, self.seed, self.shuffle = keys, seed, shuffle
        self.groups = materialize(groups)

    @cached_property
    def _totals(self) -> tuple[int, int]:
        row = self.groups.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).first()
        return int(row["g"]), int(row["n"])

    @property
    def n(self) -> int:
        """Pairs in an epoch."""
        return self._totals[1]

    @cached_property
    def _indexed(self) -> DataFrame:
        return materialize(ordinals.dense_index(self.groups, self.keys, out="_ix"))

    def starts(self, n_epochs: int) -> DataFrame:
        """The groups once per epoch, with ``start``: the number of pairs before theirs."""
        rep = self._indexed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
        ix = F.col("_ix") - 1
        rank = permuted(ix, self._totals[0], self.seed, F.col("epoch")) if self.shuffle else ix
        rep = rep.withColumn("_rank", rank).withColumn("_block", F.call_function("div", F.col("_rank"), F.lit(BLOCK)))
        sums = rep.groupBy(F.col("epoch").alias("_e"), F.col("_block").alias("_b")).agg(F.sum("n_pairs").alias("_s"))
        earlier = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("_e", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
        within = Window.partitionBy("epoch", "_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        rep = rep.withColumn("_in", F.coalesce(F.sum("n_pairs").over(within), F.lit(0)))
        out = rep.join(sums, (F.col("epoch") == F.col("_e")) & (F.col("_block") == F.col("_b")))
        return out.withColumn("start", (F.col("_before") + F.col("_in")).cast("bigint")).drop("_ix", "_rank", "_block", "_e", "_b", "_before", "_in")

    def drawn(self, n_epochs: int, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """(keys, n_pairs, ..., epoch, pair, rn): the pairs at the positions ``first`` to
        ``last - 1`` of each range, counted from 0 in every epoch, as the number of the pair in
        its group; ``rn`` counts from 1. Without ranges, all pairs."""
        starts = self.starts(n_epochs)
        ranges = [(0, self.n)] if ranges is None else ranges
        spans = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in ranges])
        out = starts.withColumn("_r", F.explode(spans)) if len(ranges) != 1 else starts.withColumn("_r", F.element_at(spans, 1))
        low = F.greatest(F.col("_r.a") - F.col("start"), F.lit(0))
        high = F.least(F.col("_r.b") - F.col("start"), F.col("n_pairs")) - 1
        out = out.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
        out = out.withColumn("pair", F.explode(F.sequence("_low", "_high")))
        return out.withColumn("rn", F.col("start") + F.col("pair") + 1).drop("_r", "_low", "_high", "start")


def batch_ranges(n: int, batch_size: int, batches: list[int]) -> list[tuple[int, int]]:
    """Positions of the given batches of an epoch of ``n``; a partial last batch is
    never yielded."""
    full = n // batch_size
    return [(k * batch_size, (k + 1) * batch_size) for k in batches if 0 <= k < full]
