"""Structured Streaming forms of the three incremental behaviours.

All three use ``foreachBatch`` writing one folder per micro-batch id with
overwrite, so a retried micro-batch (after a lost executor or a restart from
the checkpoint) rewrites the same folder: the sinks are idempotent and the
streams resume from their checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.operators import matching, throttle
from prefspark.session import materialize


def _batches_of(spark: SparkSession, root: str) -> DataFrame | None:
    """The table below ``root``; None when nothing was written yet. Any other
    failure to read it surfaces."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(root)


def keep_first_stream(spark: SparkSession, source: DataFrame, out: str, checkpoint: str,
                      fetch: Callable[[list[str]], DataFrame], key: str = "instruction", order=("shard", "ord"),
                      value: str = "output") -> dict | None:
    """Incremental keep-first ingest of files. The state store keeps, per key, its
    digest and the place (``order``, file) of the row that comes first, no text: its
    size doesn't depend on how long texts are. Update mode emits the keys whose
    first row changed in the micro-batch; only then the texts are read, by
    ``fetch(files)`` from the micro-batch's own files, and written as
    ``out/batch_id=<id>`` (work per batch is bounded by the batch, not by everything
    ingested so far). ``read_latest`` reads the table, ``compact_latest`` merges it.
    Returns the last progress of the stream."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256))
    place = F.struct(*order)
    first = source.select(digest.alias("_key"), F.col("_metadata.file_path").alias("_file"), *order).groupBy("_key").agg(
        F.min(F.struct(place.alias("at"), F.col("_file").alias("file"))).alias("_f"))

    def process(batch: DataFrame, batch_id: int) -> None:
        changed = materialize(batch.select("_key", "_f.file", *[F.col(f"_f.at.{c}").alias(f"_{c}") for c in order]))
        files = [r[0] for r in changed.select("file").distinct().collect()]  # of this micro-batch
        if not files:
            return
        rows = fetch(files).withColumn("_d", digest)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
        found = rows.join(changed, [F.col("_d") == F.col("_key"), *same]).dropDuplicates(["_key"])
        found.select(key, value, *order).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (first.writeStream.outputMode("update").foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress


def compact_latest(spark: SparkSession, out: str, key: str) -> None:
    """Merge the batches of an update-mode table. The merged rows become a folder
    with a number below all others, so whatever is still there wins over them; then
    the merged folders go, the oldest first. Readers between two steps, and a run after
    a failure at any of them, find every key's latest version."""
    whole = _batches_of(spark, out)
    if whole is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path(out))]
    old = sorted(int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id="))
    read_latest(spark, out, key).write.parquet(f"{out}/batch_id={min(old[0], 0) - 1}")
    for number in old:
        fs.delete(path(f"{out}/batch_id={number}"), True)


def read_latest(spark: SparkSession, out: str, key: str, schema: str | None = None) -> DataFrame:
    """Latest version of every key in an update-mode ``foreachBatch`` table; an empty
    table of ``schema`` when nothing was written yet."""
    versions = _batches_of(spark, out)
    if versions is None:
        return spark.createDataFrame([], schema or f"{key} string")
    cols = [c for c in versions.columns if c not in (key, "batch_id")]
    return versions.groupBy(key).agg(F.max_by(F.struct(*cols), "batch_id").alias("_v")).select(key, "_v.*")


def throttled_log(spark: SparkSession, source: DataFrame, out: str, checkpoint: str, interval: int, run: str = "run",
                  at: str = "at", value: str = "value") -> DataFrame:
    """X2 as a stream: the log with a minimum interval between its lines
    (``operators.throttle``). The only state is each run's last log, a row per run,
    written with the lines of its micro-batch; a retried batch starts from the state of
    the batch before it and rewrites the same folders. Steps are expected in the order of
    their times, a step's rows in one micro-batch. An empty stream gives no rows."""

    def process(batch: DataFrame, batch_id: int) -> None:
        steps = throttle.steps_of(batch, run, at, value)
        logged = _batches_of(spark, f"{out}/lines")
        last = None
        if logged is not None:
            last = logged.where(F.col("batch_id") < batch_id).groupBy("run").agg(F.max("at").alias("at"))
        throttle.throttled(steps, interval, last).write.mode("overwrite").parquet(f"{out}/lines/batch_id={batch_id}")

    q = (source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    lines = _batches_of(spark, f"{out}/lines")
    if lines is None:
        kind = source.schema[run].dataType.simpleString()
        return spark.createDataFrame([], f"run {kind}, at bigint, n bigint, mean double")
    return lines.drop("batch_id")


def windowed_means(spark: SparkSession, source: DataFrame, out: str, checkpoint: str, ts: str = "ts",
                   value: str = "value", every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """One mean per tumbling window (the throttled metric log); null values
    count as rows, not in the mean.

    Every micro-batch writes its own partial sums per window, and a window's
    result is their sum: no state is kept and no row is lost, however late it
    comes. Rows more than ``delay`` behind the newest event of their batch are
    counted in ``n_late``, so that a consumer that closes windows early sees what
    arrives after. The partial sums are one row per window and batch."""
    seconds = F.expr(f"cast(interval {delay} as interval day to second)")

    def process(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(ts)).first()[0]
        late = (F.col(ts) < F.lit(newest) - seconds).cast("bigint") if newest is not None else F.lit(0).cast("bigint")
        batch.groupBy(F.window(ts, every).alias("w")).agg(
            F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.sum(late).alias("n_late")
        ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "n_values", "total", "n_late") \
            .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    written = _batches_of(spark, out)
    if written is None:  # an empty stream
        return spark.createDataFrame([], "window_start timestamp, window_end timestamp, n bigint, mean_value double, n_late bigint")
    parts = written.groupBy("window_start", "window_end")
    sums = parts.agg(*[F.sum(c).alias(c) for c in ("n", "n_values", "total", "n_late")])
    mean = F.when(F.col("n_values") > 0, F.col("total") / F.col("n_values"))
    return sums.select("window_start", "window_end", "n", mean.alias("mean_value"), "n_late")


def cache_bucket(key: str = "key"):
    """Cache partition of a request: the first two hex digits of its sha256 key
    (256 evenly filled buckets)."""
    return F.substring(F.col(key), 1, 2)


def write_cache(df: DataFrame, cache_root: str, batch_id: int, key: str = "key") -> None:
    """Cache rows of one micro-batch, partitioned by bucket (overwrite = idempotent retry)."""
    df.withColumn("bucket", cache_bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{cache_root}/batch_id={batch_id}")


def cache_backfill(spark: SparkSession, requests: DataFrame, cache_root: str, checkpoint: str,
                   complete: Callable[[pd.DataFrame], pd.DataFrame], key: str = "key") -> None:
    """Resumable backfill. Each micro-batch of requests is answered from the
    cache table where possible; misses go through ``complete`` and are appended
    to the cache (``cache_root/batch_id=<id>/bucket=<xx>``), so a restart only
    pays for requests never completed before. A cached answer keeps how it ended
    (``finish_reason``), so one that was cut off stays cut off. The cache scan is pruned to the
    key buckets present in the micro-batch (at most 256 values), so a small
    batch reads a small part of a large cache."""

    def process(batch: DataFrame, batch_id: int) -> None:
        reqs = batch.dropDuplicates([key])
        buckets = [r[0] for r in reqs.select(cache_bucket(key)).distinct().collect()]  # <= 256 values
        stored = _batches_of(spark, cache_root)
        if stored is None:
            stored = spark.createDataFrame([], T.StructType([
                T.StructField(key, T.StringType()), T.StructField("response", T.StringType()),
                T.StructField("finish_reason", T.StringType())]))
        else:
            stored = stored.filter(F.col("bucket").isin(buckets) & (F.col("batch_id") != batch_id)).select(
                key, "response", "finish_reason")
        done = matching.cached_completions(reqs, stored, complete, key=key)
        new = done.filter(F.col("source") == "miss").select(key, "instruction", "response", "finish_reason")
        write_cache(new, cache_root, batch_id, key)

    q = (requests.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
