"""JSON arrays and objects read by blocks; snapshots and the completion store."""

from __future__ import annotations

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefspark.operators.cache import CompletionCache
from prefspark.sources import io, jsonfiles
from prefspark.sources.snapshots import Conflict, Snapshots


def _odd_text(rng):
    parts = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", ",", ":", "\n", "é", "\U0001f600", "a b", "\t", '"}, {"', " "]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))


@pytest.mark.parametrize("indent, ascii_", [(None, True), (2, False)])
def test_arrays_of_objects_in_small_blocks(spark, tmp_path, indent, ascii_):
    rng = random.Random(7)
    data = [{"id": k, "t": _odd_text(rng), "l": [{"x": _odd_text(rng)} for _ in range(rng.randrange(4))]} for k in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(data, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text('[{"id": 1, "t": null, "l": []}, {}]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonfiles.read_array(spark, str(tmp_path), "id bigint, t string, l array<struct<x: string>>")
        got = sorted((r.file.rsplit("/")[-1], r.pos, r.record.asDict(True)) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[2] for r in got if r[0] == "a.json"] == data
    assert [(r[1], r[2]["id"]) for r in got if r[0] == "c.json"] == [(0, 1), (1, None)]


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({f"key {k}": ["x" * 500, f"y{k}"] for k in range(2000)}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        pieces = spark.read.option("lineSep", '"').text(str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 8
        assert pieces.agg(F.max(F.length("value"))).first()[0] == 500  # no row holds more than a string
        rows = jsonfiles.read_object(spark, str(tmp_path), "array<string>").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.pos: (r.key, list(r.value)) for r in rows} == {k: (f"key {k}", ["x" * 500, f"y{k}"]) for k in range(2000)}


def test_damaged_file_is_an_error(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id": 1}, {"id": oops}]')
    with pytest.raises(Exception):
        jsonfiles.read_array(spark, str(tmp_path), "id bigint").select("record.id").collect()


def test_written_files_are_json(spark, tmp_path):
    rows = spark.createDataFrame([(k, 0, f'p "{k % 3}"\n', f"c{k}") for k in range(9)], "ord bigint, sample_ix int, prompt string, completion string")
    path = io.write_completion_maps(rows, str(tmp_path / "maps"), files=2)
    files = sorted(f for f in (tmp_path / "maps").iterdir() if f.suffix == ".txt")
    merged = {k: v for f in files for k, v in json.loads(f.read_text()).items()}
    assert merged == {f'p "{k}"\n': [f"c{j}" for j in (k, k + 3, k + 6)] for k in range(3)}
    got = {r.prompt: list(r.completions) for r in io.read_completion_maps(spark, path).collect()}
    assert got == merged
    empty = io.write_completion_maps(rows.limit(0), str(tmp_path / "none"))
    assert io.read_completion_maps(spark, empty).count() == 0


# -- snapshots ------------------------------------------------------------------


def test_a_reader_sees_the_old_or_the_new_dump(spark, tmp_path):
    row = lambda text: spark.createDataFrame([("m", 0, 1, "p", 0, text)], io.SAMPLE_SCHEMA)
    path = str(tmp_path / "dump")
    assert io.read_completion_rows(spark, path).count() == 0
    io.write_completions(row("old"), path)
    during = io.read_completion_rows(spark, path)  # a reader that starts before the rewrite
    io.write_completions(row("new"), path)
    assert [r.completion for r in during.collect()] == ["old"]
    assert [r.completion for r in io.read_completion_rows(spark, path).collect()] == ["new"]
    broken = row("x").withColumn("completion", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        io.write_completions(broken, path)
    assert [r.completion for r in io.read_completion_rows(spark, path).collect()] == ["new"]
    table = Snapshots(spark, path)
    table.vacuum(keep=1)
    assert len([f for f in (tmp_path / "dump").iterdir() if f.name.startswith("data-")]) == 1
    assert [r.completion for r in io.read_completion_rows(spark, path).collect()] == ["new"]


def test_two_writers_from_one_state(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    base, _ = table.state()
    table.commit([], base)
    with pytest.raises(Conflict):
        table.commit([], base)


# -- completion store ------------------------------------------------------------


def _answer(tag):
    def complete(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        out["response"] = [f"{tag}:{i}" for i in out["instruction"]]
        return out

    return complete


def test_store_replaces_and_survives_a_failed_compaction(spark, tmp_path, monkeypatch):
    keyed = lambda names: spark.createDataFrame([(i,) for i in names], "instruction string").select(F.sha2("instruction", 256).alias("key"), "instruction")
    store = CompletionCache(spark, str(tmp_path / "store"))
    told = lambda df: {r.instruction: r.response for r in df.collect()}
    assert store.rows().count() == 0 and store.get(keyed(["a"])).count() == 0
    assert told(store.complete(keyed("abc"), _answer("1"))) == {x: f"1:{x}" for x in "abc"}
    second = store.complete(keyed("abd"), _answer("2"))
    assert told(second) == {"a": "1:a", "b": "1:b", "d": "2:d"}
    assert {r.instruction: r.source for r in second.collect()} == {"a": "hit", "b": "hit", "d": "miss"}
    assert told(store.complete(keyed("a"), _answer("3"), no_cache=True)) == {"a": "3:a"}
    whole = {"a": "3:a", "b": "1:b", "c": "1:c", "d": "2:d"}
    assert told(store.rows()) == whole
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.compact()
    assert told(store.rows()) == whole and told(store.get(keyed("ad"))) == {"a": "3:a", "d": "2:d"}
    store.compact()
    store.table.vacuum(keep=1)
    assert len(store.table.state()[1]) == 1
    assert told(store.get(keyed("abcdx"))) == whole


def test_a_miss_costs_no_scan(spark, tmp_path, monkeypatch):
    keyed = lambda names: spark.createDataFrame([(i,) for i in names], "instruction string").select(F.sha2("instruction", 256).alias("key"), "instruction")
    store = CompletionCache(spark, str(tmp_path / "store"))
    store.complete(keyed([f"i{k}" for k in range(500)]), _answer("1"))
    folder = store.table.state()[1][0]
    assert store._maybe(keyed([f"i{k}" for k in range(500)]), folder).count() == 500
    assert store._maybe(keyed([f"other{k}" for k in range(500)]), folder).count() <= 40
    monkeypatch.setattr(CompletionCache, "_maybe", lambda self, keys, folder: keys.limit(0))
    monkeypatch.setattr(CompletionCache, "_rows", lambda *a: pytest.fail("answers were read"))
    assert store.get(keyed(["unknown"])).count() == 0


def test_more_text_gives_more_files_and_small_chunks_read_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jsonfiles, "FILE_BYTES", 2000)
    monkeypatch.setattr(jsonfiles, "CHUNK_BITS", 3)
    rng = random.Random(5)
    said = [(c, p, rng.choice(["human", "gpt"]), _odd_text(rng) + "x" * 40) for c in range(60) for p in range(rng.randrange(1, 6))]
    turns = spark.createDataFrame(said, "conv_id bigint, pos bigint, role string, text string")
    path = io.write_dialogues(turns, str(tmp_path / "d"), files=3)
    back = io.read_dialogues(spark, path).orderBy("ord").select("role", "text").collect()
    assert len(list((tmp_path / "d").glob("part-*"))) > 3
    assert [tuple(r) for r in back] == [r[2:] for r in sorted(said, key=lambda r: r[:2])]
    maps = spark.createDataFrame([(k, 0, f"p{k}", "y" * 100) for k in range(90)], "ord bigint, sample_ix int, prompt string, completion string")
    path = io.write_completion_maps(maps, str(tmp_path / "m"), files=2)
    assert len(list((tmp_path / "m").glob("part-*"))) > 2
    got = io.read_completion_maps(spark, path).orderBy("file", "pos").collect()
    assert [(r.prompt, list(r.completions)) for r in got] == [(f"p{k}", ["y" * 100]) for k in range(90)]


def test_longer_requests_are_answered_too():
    from prefspark.plans import match_queries
    from prefspark.plans.registry import QUERIES

    answers = match_queries.stub_completion(pd.DataFrame({"instruction": ["x" * 350, "x" * 400]}))
    assert list(answers["finish_reason"]) == ["stop", "length"]
    assert "length(r.instruction) < 400" in QUERIES["cache_misses"].oracle
