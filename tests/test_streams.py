"""The streaming jobs on several files, late rows, nulls and cut-off answers."""

from __future__ import annotations

import pandas as pd
import pytest

from prefspark.sources import io, registry
from prefspark.streaming import jobs
from conftest import SMALL


def _stream(spark, rows, schema, root):
    """One file per row, in order of arrival."""
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{root}/in/part={k:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_windows_keep_late_rows_and_skip_nulls(spark):
    root = io.scratch_path(spark, "t-windows")
    at = lambda h, m=0: pd.Timestamp(2024, 1, 1, h, m).to_pydatetime()
    rows = [(at(9), 4.0), (at(9, 30), None), (at(1), 1.0), (at(5), 2.0), (at(1, 10), 3.0)]
    source = _stream(spark, rows, "ts timestamp, value double", root)
    got = jobs.windowed_means(spark, source, f"{root}/out", f"{root}/ckpt").collect()
    assert sorted((r.n, r.mean_value) for r in got) == [(1, 2.0), (2, 2.0), (2, 4.0)]


def test_cut_off_answer_stays_cut_off(spark):
    root = io.scratch_path(spark, "t-cache")
    calls = []

    def complete(pdf):
        out = pdf.copy()
        out["response"] = "answer"
        out["finish_reason"] = ["length" if i == "long" else "stop" for i in out["instruction"]]
        return out

    for wave in (["long", "short"], ["long", "short", "new"]):
        spark.createDataFrame([(f"k-{i}", i) for i in wave], "key string, instruction string").write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema("key string, instruction string").json(f"{root}/in")
        jobs.cache_backfill(spark, stream, f"{root}/cache", f"{root}/ckpt", complete)
    cached = {r.instruction: r.finish_reason for r in spark.read.parquet(f"{root}/cache").collect()}
    assert cached == {"long": "length", "short": "stop", "new": "stop"} and not calls


def test_unreadable_cache_is_an_error(spark, tmp_path):
    assert jobs._batches_of(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        jobs._batches_of(spark, str(tmp_path / "bad")).count()


def test_repeated_key_keeps_first_place_and_last_value(spark, tmp_path):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    (tmp_path / "m.json").write_text('{"a": ["1"], "b": ["2"], "a": ["3"]}')
    got = sorted((r.pos, r.prompt, r.completions) for r in io.read_completion_maps(spark, str(tmp_path)).collect())
    assert [(p, c) for _, p, c in got] == [("a", ["3"]), ("b", ["2"])]


def test_preference_mode_needs_pairs(spark):
    with pytest.raises(ValueError, match="no table of preference pairs"):
        registry.mixture(spark, SMALL, ["hh", "ultrachat"])


def test_empty_streams_give_no_rows(spark):
    root = io.scratch_path(spark, "t-empty")
    schema = "run int, at bigint, ts timestamp, value double"
    spark.createDataFrame([], schema).write.parquet(f"{root}/in")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{root}/none")
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/none"))
    assert jobs.windowed_means(spark, stream(), f"{root}/w", f"{root}/c1").count() == 0
    log = jobs.throttled_log(spark, stream(), f"{root}/l", f"{root}/c2", 10)
    assert log.columns == ["run", "at", "n", "mean"] and log.count() == 0
    assert jobs.read_latest(spark, f"{root}/nothing", "instruction").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_throttled_log_follows_the_last_log(spark, seed):
    import random

    from prefspark.operators import throttle

    rnd = random.Random(seed)
    rows = [(rnd.choice([None, "a", "b"]), rnd.randrange(0, 400) * rnd.choice([1, 1, 7]), float(k)) for k in range(250)]
    df = spark.createDataFrame(rows, "run string, at bigint, value double")
    got = {(r.run, r["at"]) for r in throttle.throttled(throttle.steps_of(df, "run", "at", "value"), 25).collect()}
    want = set()
    for run in {r[0] for r in rows}:
        last = None
        for at in sorted({r[1] for r in rows if r[0] == run}):
            if last is None or at - last > 25:
                want.add((run, at))
                last = at
    assert got == want


def test_streamed_log_equals_the_whole_one(spark):
    from prefspark.operators import throttle

    root = io.scratch_path(spark, "t-log")
    rows = [(1, at, float(at)) for at in (0, 3, 9, 10, 11, 30, 31, 42, 100, 101)]
    source = _stream(spark, rows, "run int, at bigint, value double", root)
    got = jobs.throttled_log(spark, source, f"{root}/out", f"{root}/ckpt", 10)
    whole = throttle.throttled(throttle.steps_of(spark.createDataFrame(rows, "run int, at bigint, value double"), "run", "at", "value"), 10)
    assert sorted(r["at"] for r in got.collect()) == sorted(r["at"] for r in whole.collect()) == [0, 11, 30, 42, 100]


def test_state_of_keep_first_holds_no_texts(spark):
    schema = "shard int, ord bigint, instruction string, output string"
    sizes = []
    for text in ("x", "x" * 20_000):
        root = io.scratch_path(spark, "t-state")
        spark.createDataFrame([(0, k, f"{text}{k}", f"out {k}") for k in range(60)], schema).write.json(f"{root}/in")
        last = jobs.keep_first_stream(spark, spark.readStream.schema(schema).json(f"{root}/in"), f"{root}/out", f"{root}/ckpt",
                                      lambda files: spark.read.schema(schema).json(files))
        sizes.append(sum(s["memoryUsedBytes"] for s in last["stateOperators"]))
        assert jobs.read_latest(spark, f"{root}/out", "instruction").count() == 60
    assert sizes[1] < 1.2 * sizes[0]


def test_an_earlier_row_replaces_and_compaction_keeps_it(spark):
    root, schema = io.scratch_path(spark, "t-first"), "shard int, ord bigint, instruction string, output string"
    for wave in ([(1, 5, "a", "late"), (1, 6, "b", "b1")], [(0, 9, "a", "early"), (2, 0, "b", "b2"), (2, 1, None, "none")]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").json(f"{root}/in")
        jobs.keep_first_stream(spark, spark.readStream.schema(schema).json(f"{root}/in"), f"{root}/out", f"{root}/ckpt",
                               lambda files: spark.read.schema(schema).json(files))
    want = {("a", "early"), ("b", "b1"), (None, "none")}
    for _ in range(2):
        assert {(r.instruction, r.output) for r in jobs.read_latest(spark, f"{root}/out", "instruction").collect()} == want
        jobs.compact_latest(spark, f"{root}/out", "instruction")


def test_pointers_use_growing_frames_only(spark):
    from prefspark.operators import throttle

    times = spark.createDataFrame([("a", k) for k in (0, 5, 10, 11, 25)], "run string, at bigint")
    pointers = throttle._pointers(times, 10)
    assert {r["at"]: r["to"] for r in pointers.collect()} == {0: 11, 5: 25, 10: 25, 11: 25, 25: None}
    assert "unboundedfollowing" not in pointers._jdf.queryExecution().toString().lower()


def test_stream_log_takes_its_ranges_in_many_files(spark, tmp_path, monkeypatch):
    import datetime

    from prefspark.plans import stream_queries

    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=k), k % 8, float(k)) for k in range(900)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stream_queries.io, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = sorted(map(tuple, stream_queries.stream_metric_log(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, stream_queries.metric_log(spark, str(tmp_path)).collect())) and len(got) == 4 * 10
    assert len(list((tmp_path / "stream_log" / "in").glob("part-*"))) > 3
    assert len(list((tmp_path / "stream_log" / "out" / "lines").glob("batch_id=*"))) == 3
