"""Streaming queries (X1-X3). Each runs the stream to completion with
``availableNow`` and returns the sink's contents; the oracle is the batch
result over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.plans.match_queries import stub_completion
from prefspark.operators import throttle
from prefspark.plans.registry import register
from prefspark.sources import io
from prefspark.sources.fixtures import table, view
from prefspark.streaming import jobs

_SAMPLED_SCHEMA = "model string, shard int, ord bigint, instruction string, output string"


@register("stream_dedupe", "X1 A5", views=("v_completions",), sql="""
    select instruction, output, cast(shard as bigint) as shard from (
      select *, row_number() over (partition by instruction order by shard, ord) as rn
      from v_completions where model = 'sampled') z
    where rn = 1""")
def stream_dedupe(spark, sf_dir):
    """Sampler shards arrive one after another (the stream is restarted from its
    checkpoint after each shard lands); the first arrived row per instruction
    is kept."""
    root = io.scratch_path(spark, "stream_dedupe")
    src_dir, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    sampled = view(spark, sf_dir, "v_completions").filter(F.col("model") == "sampled")
    shards = [r[0] for r in sampled.select("shard").distinct().orderBy("shard").collect()]  # a few shard ids
    for s in shards:
        sampled.filter(F.col("shard") == s).write.mode("append").json(src_dir)
        stream = spark.readStream.schema(_SAMPLED_SCHEMA).json(src_dir)
        jobs.keep_first_stream(spark, stream, out, ckpt, lambda files: spark.read.schema(_SAMPLED_SCHEMA).json(files))
    jobs.compact_latest(spark, out, "instruction")
    res = jobs.read_latest(spark, out, "instruction", "instruction string, output string, shard int, ord bigint")
    return res.select("instruction", "output", F.col("shard").cast("bigint").alias("shard"))


@register("stream_metric_windows", "X2 A7", sql="""
    select cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as window_start,
           cast(epoch(time_bucket(interval '1 hour', ts) + interval '1 hour') as bigint) as window_end,
           cast(count(*) as bigint) as n, round(avg(value), 6) as mean_value
    from events group by 1, 2""")
def stream_metric_windows(spark, sf_dir):
    """Hourly means of the event stream; windows reported as epoch seconds. The
    wall-clock event time is read as UTC, so the result does not depend on the
    session time zone (a watermark needs a TIMESTAMP, not TIMESTAMP_NTZ)."""
    root = io.scratch_path(spark, "stream_windows")
    # The stream reads folders, the table may be one file: its rows go through a
    # folder of several files in the shared scratch, one micro-batch each.
    events = table(spark, sf_dir, "events")
    events.repartition(4).write.parquet(f"{root}/in")
    schema = events.schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    if schema["ts"].dataType.simpleString() == "timestamp_ntz":
        raw = raw.withColumn("ts", _utc("ts"))
    means = jobs.windowed_means(spark, raw, f"{root}/out", f"{root}/ckpt")
    return means.select(F.unix_seconds("window_start").alias("window_start"),
                        F.unix_seconds("window_end").alias("window_end"),
                        "n", F.round("mean_value", 6).alias("mean_value"))


# ----------------------------------------------------------------- X2: the throttled log
LOG_SECONDS = 5400
_LOG_SQL = f"""
    with recursive steps as (
      select user_id % 4 as run, cast(epoch_us(ts) as bigint) as t, count(*) as n, avg(value) as mean from events
      where ts is not null group by 1, 2),
    chain(run, t) as (
      select run, min(t) from steps group by run
      union all
      select run, t from (
        select c.run, (select min(s.t) from steps s where s.run = c.run and s.t > c.t + {LOG_SECONDS * 10**6}) as t from chain c) z
      where t is not null)
    select s.run, s.t as logged_at, s.n, round(s.mean, 6) as mean from steps s join chain c on s.run = c.run and s.t = c.t"""


def _metric_rows(spark, sf_dir):
    """Events as metric rows of four runs, times in microseconds."""
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(_utc("ts") if events.schema["ts"].dataType.simpleString() == "timestamp_ntz" else F.col("ts"))
    return events.select((F.col("user_id") % 4).alias("run"), at.alias("at"), "value")


def _utc(ts: str):
    """A wall-clock time as the instant at which UTC clocks show it."""
    return F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.date_part(F.lit("SECOND"), F.col(ts)), F.lit("UTC"))


@register("metric_log", "X2 A7", sql=_LOG_SQL)
def metric_log(spark, sf_dir):
    """A step's means when more than 90 minutes have passed since the run's last log."""
    steps = throttle.steps_of(_metric_rows(spark, sf_dir), "run", "at", "value")
    return throttle.throttled(steps, LOG_SECONDS * 10**6).select("run", F.col("at").alias("logged_at"), "n", F.round("mean", 6).alias("mean"))


@register("stream_metric_log", "X2", sql=_LOG_SQL)
def stream_metric_log(spark, sf_dir):
    """The same log from a stream of files in the order of their times."""
    root = io.scratch_path(spark, "stream_log")
    rows = _metric_rows(spark, sf_dir)
    # Each range of times is written as many files, then the stream goes on from its
    # checkpoint and takes them as one micro-batch.
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    parts = 3 if low is not None else 1
    for k in range(parts):
        edge = lambda j: low + (high - low + 1) * j // parts
        part = rows.where((F.col("at") >= edge(k)) & (F.col("at") < edge(k + 1))) if low is not None else rows
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        out = jobs.throttled_log(spark, stream, f"{root}/out", f"{root}/ckpt", LOG_SECONDS * 10**6)
    return out.select("run", F.col("at").alias("logged_at"), "n", F.round("mean", 6).alias("mean"))


@register("stream_cache_backfill", "X3 J4 G3", views=("v_completions",), sql="""
    with r as (select distinct instruction, sha256(concat_ws(chr(1), 'gpt4', instruction)) as key
               from v_completions where model = 'teacher'),
    c as (select sha256(concat_ws(chr(1), 'gpt4', instruction)) as key, min_by(output, ord) as response
          from v_completions where model = 'sampled' and shard = 1
          group by sha256(concat_ws(chr(1), 'gpt4', instruction)))
    select r.key, r.instruction, coalesce(c.response, 'stub:' || cast(length(r.instruction) as varchar)) as response
    from r left join c on r.key = c.key""")
def stream_cache_backfill(spark, sf_dir):
    """Requests arrive in two overlapping waves; the cache is seeded with the
    shard-1 samples; every request ends up answered exactly once."""
    root = io.scratch_path(spark, "stream_cache")
    v = view(spark, sf_dir, "v_completions")
    keyed = F.sha2(F.concat_ws("\u0001", F.lit("gpt4"), "instruction"), 256)
    seed = (v.filter((F.col("model") == "sampled") & (F.col("shard") == 1)).withColumn("key", keyed)
            .groupBy("key").agg(F.min_by("instruction", "ord").alias("instruction"),
                                F.min_by("output", "ord").alias("response"),
                                F.lit("stop").alias("finish_reason")))
    jobs.write_cache(seed, f"{root}/cache", -1)
    req = v.filter(F.col("model") == "teacher").select("instruction", "ord").withColumn("key", keyed)
    waves = [req.filter(F.col("ord") < 10), req]
    for wave in waves:
        wave.select("key", "instruction").write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema("key string, instruction string").json(f"{root}/in")
        jobs.cache_backfill(spark, stream, f"{root}/cache", f"{root}/ckpt", stub_completion)
    cache = spark.read.parquet(f"{root}/cache").select("key", "response")
    requests = req.select("key", "instruction").dropDuplicates(["key"])
    return requests.join(cache, "key").select("key", "instruction", "response")
