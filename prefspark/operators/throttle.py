"""The metric log with a minimum interval.

A training loop logs a step's means when more than ``interval`` has passed since the
*last log*, so which steps are logged depends on all earlier ones: a chain, not a
grouping by windows. In Spark the chain is found by pointer jumping:

1. every step points at the first step more than ``interval`` later. In time buckets
   of that length it lies in the next bucket or is the first step of a later one, so
   it is found within (run, bucket), not within a run;
2. steps reached from the first one are marked by doubling: who is marked marks whom
   it points at, then all pointers are replaced by those of their targets. A log of k
   lines takes about log2(k) rounds of joins by (run, time).

A hot run spreads over its buckets and steps; a bucket's steps are one task's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import materialize


def steps_of(rows: DataFrame, run: str, at: str, value: str) -> DataFrame:
    """(run, at, n, mean): one row per step; a null value counts as a row only."""
    rows = rows.where(F.col(at).isNotNull())
    return rows.groupBy(F.col(run).alias("run"), F.col(at).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def _pointers(times: DataFrame, interval: int) -> DataFrame:
    """(run, at, to): the first time more than ``interval`` later, or null."""
    bucket = F.call_function("div", F.col("at") - F.pmod(F.col("at"), F.lit(interval)), F.lit(interval))
    own = times.withColumn("bucket", bucket)
    # A step asks the next bucket for the first time after at + interval; at equal
    # times the question comes after the step, as "more than" is strict. The rows are
    # taken from the last time back, so that the frame only grows (a frame that
    # shrinks towards the end is summed up anew for every row of the bucket).
    asked = own.select("run", "at", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + interval).alias("when"), F.lit(1).alias("asks"))
    told = own.select("run", F.lit(None).cast("bigint").alias("at"), "bucket", F.col("at").alias("when"), F.lit(0).alias("asks"))
    later = Window.partitionBy("run", "bucket").orderBy(F.desc("when"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = asked.unionByName(told).withColumn("near", F.min(F.when(F.col("asks") == 0, F.col("when"))).over(later)).where("asks = 1")
    # Else the first step of the next bucket that has any, two or more after the own.
    firsts = own.groupBy("run", "bucket").agg(F.min("at").alias("first"))
    order = Window.partitionBy("run").orderBy("bucket")  # a row per interval of the run
    following = firsts.select(
        "run", (F.col("bucket") + 1).alias("bucket"),
        F.when(F.lead("bucket").over(order) > F.col("bucket") + 1, F.lead("first").over(order)).otherwise(F.lead("first", 2).over(order)).alias("far"))
    out = near.select("run", "bucket", "at", "near").join(following, ["run", "bucket"])
    return out.select("run", "at", F.coalesce("near", "far").alias("to"))


def throttled(steps: DataFrame, interval: int, last: DataFrame | None = None) -> DataFrame:
    """The steps (run, at, ...) that are logged. ``at`` is an integer time, unique in
    its run, ``interval`` in its unit; ``last`` (run, at) are the logs before these steps."""
    steps = materialize(steps)
    times = steps.select("run", "at")
    start = times
    if last is not None:
        before = last.select(F.col("run").alias("_run"), F.col("at").alias("_last"))
        start = times.join(before, F.col("run").eqNullSafe(F.col("_run")), "left").where(F.col("_last").isNull() | (F.col("at") > F.col("_last") + interval))
    # A null run is a run: names get a mark in front, null is the empty name.
    name = F.coalesce(F.concat(F.lit("="), F.col("run").cast("string")), F.lit(""))
    marked = materialize(start.groupBy(name.alias("run")).agg(F.min("at").alias("at")))
    jump = materialize(_pointers(times.select(name.alias("run"), "at"), interval))
    while True:
        new = materialize(marked.join(jump, ["run", "at"]).where("to is not null").select("run", F.col("to").alias("at")))
        if new.isEmpty():
            break
        marked = materialize(marked.union(new).distinct())
        onward = jump.select("run", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = materialize(jump.join(onward, ["run", "to"]).select("run", "at", F.col("next").alias("to")).where("to is not null"))
    chosen = marked.select(F.col("run").alias("_name"), F.col("at").alias("_at"))
    return steps.join(chosen, (name == F.col("_name")) & (F.col("at") == F.col("_at")), "left_semi")
