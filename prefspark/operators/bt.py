"""Preference-model fits over rank pairs: tallies (A18), the Bradley-Terry
reward fit by full-batch gradient descent (A17), the empirical categorical
policy (A16), the KL-tilted policy (M12) and the true-score sign (M13).

The pair table is pre-aggregated once to ``(winner, loser, n)`` rows - at most
one row per distinct ordered pair - so each gradient step is a join of that
small table with the current rewards plus one grouped sum, not a pass over the
raw samples."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import ensure_checkpoint_dir, materialize


#: Items whose rewards are broadcast, 16 bytes each; more are joined by a shuffle.
MAX_SENT = 100_000


def preference_sign(a: str = "a", b: str = "b"):
    """+1 when a's true score is higher, else -1 (a tie counts as -1)."""
    return F.when(F.col(a) > F.col(b), F.lit(1)).otherwise(F.lit(-1))


def aggregate_pairs(samples: DataFrame, a: str = "winner", b: str = "loser") -> DataFrame:
    """Pre-aggregate samples to ``(w, l, n)`` with w the higher true score; equal
    scores are kept as ``w == l`` rows (they add loss but no gradient)."""
    return samples.select(F.greatest(a, b).alias("w"), F.least(a, b).alias("l")).groupBy("w", "l").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def tally(pairs: DataFrame) -> DataFrame:
    """Wins, losses and ties per item from the aggregated pairs."""
    strict = pairs.filter(F.col("w") != F.col("l"))
    ties = pairs.filter(F.col("w") == F.col("l"))
    parts = (
        strict.select(F.col("w").alias("item"), F.col("n").alias("wins"), F.lit(0).cast("bigint").alias("losses"),
                      F.lit(0).cast("bigint").alias("ties"))
        .unionByName(strict.select(F.col("l").alias("item"), F.lit(0).cast("bigint").alias("wins"),
                                   F.col("n").alias("losses"), F.lit(0).cast("bigint").alias("ties")))
        .unionByName(ties.select(F.col("w").alias("item"), F.lit(0).cast("bigint").alias("wins"),
                                 F.lit(0).cast("bigint").alias("losses"), F.col("n").alias("ties")))
    )
    return parts.groupBy("item").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"),
                                     F.sum("ties").alias("ties"))


def fit_bradley_terry(pairs: DataFrame, steps: int, lr: float = 0.01) -> DataFrame:
    """``steps`` SGD steps on ``-mean logsigmoid(r_w - r_l)`` from zero
    rewards. ``pairs`` is the ``(w, l, n)`` table; ties are part of the mean's
    denominator only. Returns ``(item, reward)``.

    A step is a join of the pair table with the rewards and one grouped sum. It
    reads the rewards three times, so a plan over k steps would grow as 3^k: the
    rewards, one row per item, are checkpointed after every step. The number of
    steps is the caller's; nothing depends on the table's size."""
    pairs = materialize(pairs)  # read by every step
    total = pairs.agg(F.sum("n")).first()[0] or 0
    strict = pairs.filter(F.col("w") != F.col("l"))
    items = pairs.select(F.col("w").alias("item")).union(pairs.select(F.col("l").alias("item"))).distinct()
    rewards = materialize(items.withColumn("reward", F.lit(0.0)))
    for _ in range(steps):
        rw = rewards.select(F.col("item").alias("w"), F.col("reward").alias("rw"))
        rl = rewards.select(F.col("item").alias("l"), F.col("reward").alias("rl"))
        # n * sigmoid(-(r_w - r_l)): the pull of every (w, l) row, on both items.
        pull = F.col("n") / (F.lit(1.0) + F.exp(F.col("rw") - F.col("rl")))
        both = F.array(F.struct(F.col("w").alias("item"), (-pull).alias("d")), F.struct(F.col("l").alias("item"), pull.alias("d")))
        grad = strict.join(rw, "w").join(rl, "l").select(F.explode(both).alias("g")).groupBy("g.item").agg(F.sum("g.d").alias("d"))
        step = F.lit(lr) * F.coalesce(F.col("d"), F.lit(0.0)) / F.lit(float(total))
        rewards = materialize(rewards.join(grad, "item", "left").select("item", (F.col("reward") - step).alias("reward")))
    return rewards


def _descent(strict: DataFrame, state: DataFrame, total: float, few: bool) -> DataFrame:
    """``state`` (item, y, ...) with g, the descent direction (minus the gradient of
    the loss) at the rewards y. ``few`` items are sent to the pairs' tasks."""
    sent = F.broadcast if few else lambda df: df
    one = lambda k: sent(state.select(F.col("item").alias(k), F.col("y").alias(f"y_{k}")))
    pull = F.col("n") / F.lit(total) / (F.exp(F.col("y_w") - F.col("y_l")) + 1)
    both = F.array(F.struct(F.col("w").alias("item"), pull.alias("d")), F.struct(F.col("l").alias("item"), (-pull).alias("d")))
    sums = strict.join(one("w"), "w").join(one("l"), "l").select(F.explode(both).alias("s")).groupBy("s.item").agg(F.sum("s.d").alias("d"))
    return state.join(sent(sums), "item", "left").withColumn("g", F.coalesce("d", F.lit(0.0))).drop("d")


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a small table in the shared folder. A checkpoint would hand the
    constraints of its plan on to the next step's, where they multiply."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/bt-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_to_the_end(pairs: DataFrame, steps: int = 7500, lr: float = 0.01, spans: int | None = None, tol: float = 0.0) -> DataFrame:
    """A17 over thousands of steps: the rewards after ``steps`` of gradient descent
    with rate ``lr``, by integrating the flow that they follow over the time
    ``steps * lr`` in ``spans`` Runge-Kutta steps of fourth order. The flow is smooth: the
    loss is a mean, its curvature at most half of the largest share of pairs that an
    item is in. By default a span's curvature is at most a half, which is within 1e-4 of
    the steps taken one by one.

    Stops before that when no component of the gradient exceeds ``tol``: then the
    rewards are those of the optimum, where there is one. Items of which one always
    wins have none; their rewards grow with the steps, as those of the loop do.

    Descent with rate lr follows the direction not at the rewards but, up to lr
    squared, half a step before them (backward error analysis); the step is that of
    the evaluation before.

    An evaluation is two joins of the pair table with the items and a grouped sum; its
    result, a row per item, is written, so plans don't grow. Only the gradient's
    largest component comes to the driver."""
    pairs = materialize(pairs)
    total = float(pairs.agg(F.sum("n")).first()[0] or 1)
    strict = pairs.filter(F.col("w") != F.col("l"))
    items = pairs.select(F.col("w").alias("item")).union(pairs.select(F.col("l").alias("item"))).distinct()
    zero = [F.lit(0.0).alias(c) for c in ("y", "start", "sum")]
    state = _written(items.select("item", *zero))
    few = state.limit(MAX_SENT + 1).count() <= MAX_SENT
    if spans is None:
        both = F.explode(F.array("w", "l")).alias("item")
        most = strict.select(both, "n").groupBy("item").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        spans = max(1, math.ceil(steps * lr * most / total))
    h = steps * lr / spans
    for number in range(4 * spans):
        weight, reach = ((1, 0.5), (2, 0.5), (2, 1.0), (1, None))[number % 4]
        moved = _descent(strict, state, total, few)
        gathered = F.col("sum") + weight * F.col("g")
        start = F.col("start") if reach else F.col("start") + F.lit(h / 6) * gathered
        ahead = (h * reach if reach else 0.0) - lr / 2
        state = _written(moved.select(
            "item", (start + F.lit(ahead) * F.col("g")).alias("y"), start.alias("start"),
            (gathered if reach else F.lit(0.0)).alias("sum"), F.abs("g").alias("g")))
        if tol and number % 4 == 0 and (state.agg(F.max("g")).first()[0] or 0.0) <= tol:
            break
        state = state.drop("g")
    return state.select("item", F.col("start").alias("reward"))


def categorical_mle(samples: DataFrame, item: str = "item") -> DataFrame:
    """The softmax policy's maximum-likelihood fit is the empirical
    distribution ``count / total`` (the reference approaches it by gradient
    descent)."""
    counts = samples.groupBy(item).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    total = counts.agg(F.sum("count")).first()[0]
    return counts.withColumn("prob", F.col("count") / F.lit(float(total)))


def kl_tilted(policy: DataFrame, rewards: DataFrame, beta: float = 0.1, item: str = "item") -> DataFrame:
    """``p * exp(r / beta) / Z``; ``max(r)`` is subtracted first (same value,
    no overflow). Items without a reward keep r = 0."""
    j = policy.select(item, "prob").join(rewards.select(item, "reward"), item, "left").withColumn(
        "reward", F.coalesce("reward", F.lit(0.0)))
    r_max = j.agg(F.max("reward")).first()[0]
    w = j.withColumn("_u", F.col("prob") * F.exp((F.col("reward") - F.lit(r_max)) / beta))
    z = w.agg(F.sum("_u")).first()[0]
    return w.select(item, "prob", "reward", (F.col("_u") / F.lit(z)).alias("tilted"))
