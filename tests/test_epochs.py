"""Epoch permutations, unranking, batches drawn from pair spaces, and their plans."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from prefspark.operators import batching, epochs
from prefspark.sources import records


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000])
def test_permutation_of_every_epoch(spark, n):
    df = spark.range(n).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = df.select("id", "epoch", epochs.permuted(F.col("id"), n, 5, F.col("epoch")).alias("rank")).collect()
    orders = []
    for e in range(3):
        order = [r.rank for r in sorted((r for r in rows if r.epoch == e), key=lambda r: r.id)]
        assert sorted(order) == list(range(n))
        orders.append(order)
    assert n < 16 or len(set(map(tuple, orders))) == 3


@pytest.mark.parametrize("n", [2, 3, 9, 40])
def test_unrank_every_position(spark, n):
    total = n * (n - 1) // 2
    i, j = epochs.unrank(F.col("id"), F.lit(n).cast("bigint"))
    got = [(r.i, r.j) for r in spark.range(total).select("id", i.alias("i"), j.alias("j")).orderBy("id").collect()]
    assert got == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_unrank_of_large_spaces(spark):
    n = 60_000_000
    before = lambda a: a * (2 * n - a - 1) // 2
    wanted = [(0, 1), (0, n - 1), (1, 2), (12_345_678, 12_345_679), (12_345_678, n - 1), (n - 3, n - 1), (n - 2, n - 1)]
    at = [(before(a) + b - a - 1,) for a, b in wanted]
    i, j = epochs.unrank(F.col("p"), F.lit(n).cast("bigint"))
    rows = spark.createDataFrame(at, "p bigint").select("p", i.alias("i"), j.alias("j")).collect()
    assert {r.p: (r.i, r.j) for r in rows} == {p: w for (p,), w in zip(at, wanted)}


def test_starts_are_prefix_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(epochs, "BLOCK", 4)
    groups = spark.createDataFrame([(k, k % 5) for k in range(40)], "first_ord bigint, n_pairs bigint")
    plan = epochs.Schedule(groups, ["first_ord"], seed=3)
    assert plan.n == 80
    for e in (0, 1):
        rows = sorted((r.rn, r.first_ord, r.pair) for r in plan.drawn(2).where(F.col("epoch") == e).collect())
        assert [r[0] for r in rows] == list(range(1, 81))
        blocks = [k for i, (_, k, _) in enumerate(rows) if not i or rows[i - 1][1] != k]
        assert len(blocks) == len(set(blocks)) == 32  # a group's pairs lie together
    part = plan.drawn(1, [(10, 14), (70, 75)]).select("rn").collect()
    assert sorted(r.rn for r in part) == [*range(11, 15), *range(71, 76)]


def test_scored_pairs_are_made_for_the_asked_positions_only(spark):
    rows = [Row(q_ord=q, question=f"q{q}", pos=10 * k, answer=f"a{q}.{k}", pm_score=(k * 7) % 3) for q in range(3) for k in range(q * 4)]
    rows += [Row(q_ord=-1, question="q2", pos=0, answer="old", pm_score=9), Row(q_ord=-1, question="q2", pos=1, answer="older", pm_score=1)]
    pairs = records.ScoredPairs(spark.createDataFrame(rows))
    assert sorted((r.first_ord, r.n_pairs) for r in pairs.groups.collect()) == [(1, 6), (2, 28)]
    drawn = spark.createDataFrame([(2, 8, k) for k in (0, 7, 27)] + [(1, 4, 3)], "first_ord bigint, n bigint, pair bigint")
    got = {(r.first_ord, r.pair): (r.chosen_ix, r.rejected_ix, r.chosen) for r in pairs.rows(drawn).collect()}
    score = [(k * 7) % 3 for k in range(8)]
    for (q, p), (c, r, text) in got.items():
        n = 8 if q == 2 else 4
        i, j = [(a, b) for a in range(n) for b in range(a + 1, n)][p]
        assert (c, r) == ((i, j) if score[i] > score[j] else (j, i))
        assert text == f" a{q}.{c}"


def _plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_texts_are_joined_once_after_the_filters(spark):
    """No text goes through the epochs' exchanges, and more epochs don't add ranges."""
    rows = [Row(dataset="d", dataset_ix=0, prompt=f"p{k // 2}", pair_ix=k % 2, first_ord=k // 2, chosen=f"c{k}", rejected="r") for k in range(40)]
    ex = spark.createDataFrame(rows)
    plan = batching.schedule(ex, seed=1)
    out = batching.assign_batches(batching.epoch_order(ex, 9, plan=plan), 8, plan.n).select("epoch", "rn", "chosen")
    text = _plan(out)
    assert "rangepartitioning" not in text  # the only one, over narrow keys, has been made and saved
    assert plan.groups.columns == ["dataset_ix", "first_ord", "n_pairs"]
    places = _plan(plan.drawn(9))
    assert "chosen" not in places and "prompt" not in places
    assert out.count() == 9 * 40
