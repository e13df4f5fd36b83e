"""Sources and sinks on hand-made files in the reference's layouts, and the
pluggable tokenizer hook."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from prefspark.functions import tokens as K
from prefspark.operators import reports
from prefspark.sources import io


def test_completion_map_files(spark):
    d = tempfile.mkdtemp(prefix="maps-", dir="/tmp")
    with open(os.path.join(d, "r1_claude_completions.json"), "w") as f:
        json.dump({"Human: b\n\nAssistant: ": ["B1", "B2"], "Human: a\n\nAssistant: ": ["A1"]}, f, indent=2)
    with open(os.path.join(d, "r2_gpt4_completions.json"), "w") as f:
        json.dump({"Human: c\n\nAssistant: ": ["C1"]}, f)
    rows = io.read_completion_maps(spark, d, "*claude_completions.json").orderBy("file", "pos").collect()
    assert [(r.pos, r.prompt, list(r.completions)) for r in rows] == [
        (0, "Human: b\n\nAssistant: ", ["B1", "B2"]), (1, "Human: a\n\nAssistant: ", ["A1"])]


def test_completion_map_files_to_sft_records(spark):
    from prefspark.sources import records

    d = tempfile.mkdtemp(prefix="maps-", dir="/tmp")
    with open(os.path.join(d, "a_claude_completions.json"), "w") as f:
        json.dump({"x": ["X1", "X2"], "y": ["Y1"]}, f)
    with open(os.path.join(d, "b_claude_completions.json"), "w") as f:
        json.dump({"z": ["Z1"], "x": ["X-late"]}, f)
    maps = io.read_completion_maps(spark, d, "*claude_completions.json")
    got = sorted((r.first_ord, r.prompt, r.sft_target) for r in records.completion_map_sft(maps).collect())
    # x keeps its first position (file a) and takes the last value (file b)
    assert got == [(1, "Human: x\n\nAssistant: ", "X-late"), (2, "Human: y\n\nAssistant: ", "Y1"),
                   (3, "Human: z\n\nAssistant: ", "Z1")]
    test = records.completion_map_sft(maps, split="test", test_n=2).collect()
    assert sorted(r.prompt for r in test) == ["Human: x\n\nAssistant: ", "Human: y\n\nAssistant: "]
    half = records.completion_map_sft(maps, data_fraction=0.5).collect()  # first 2 of 4 entries
    assert sorted(r.sft_target for r in half) == ["X1", "Y1"]


def test_single_pass_sample_outputs_equal_two_step(spark):
    import random

    from prefspark.operators import matching

    rnd = random.Random(4)
    # positions are unique per dump line, as in a real dump; samples of an entry share it
    rows = [("m", rnd.randint(0, 2), i // 3, f"Human: p{(i // 3) % 10}\n\nAssistant: ", i % 3, f"c{i}")
            for i in rnd.sample(range(300), 300)]
    df = spark.createDataFrame(rows, io.SAMPLE_SCHEMA)
    one = sorted(tuple(r) for r in matching.sample_outputs_from_rows(df).collect())
    two = sorted(tuple(r) for r in matching.sample_outputs(io.first_samples(df)).collect())
    assert one == two


def test_registry_names_and_unknown_name(spark):
    import pytest

    from prefspark.sources import registry

    assert len(registry.DATASETS) == 11
    with pytest.raises(ValueError):
        registry.get_dataset(spark, "/root/testdata/sf0.001", "no_such_dataset")
    with pytest.raises(ValueError):
        registry.get_dataset(spark, "/root/testdata/sf0.001", "shareclaude").sft


def test_leaderboard_folders(spark):
    root = tempfile.mkdtemp(prefix="evals-", dir="/tmp")

    def put(path, text):
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w") as f:
            f.write(text)

    put("final_ds_a/name.txt", "llama7b_a_e0\nignored second line\n")
    put("final_ds_a/gpt4/leaderboard.csv", "ref,50.0\nllama7b_a_e0,55.5\nllama7b_a_e0,56.25\n")
    put("final_ds_a/claude_1/leaderboard.csv", "llama7b_a_e0,61.0\n")
    put("DS_c2_b/name.txt", "llama7b_b_e1\n")  # excluded run
    put("DS_c2_b/gpt4/leaderboard.csv", "llama7b_b_e1,70.0\n")
    put("final_ds_c/gpt4/leaderboard.csv", "llama7b_c_e0,40.0\n")  # no name.txt: skipped
    got = {(r.name, r.evaluator): r.win_rate for r in reports.scan_leaderboards(spark, root).collect()}
    assert got == {("llama7b_a_e0", "gpt4"): 56.25, ("llama7b_a_e0", "claude_1"): 61.0}


def test_pandas_tokenizer_hook(spark):
    tok = K.pandas_tokenizer(lambda t: [len(w) for w in t.split()])
    df = spark.createDataFrame([("a bb ccc",), ("",), (None,)], ["t"])
    got = [list(r.ids) for r in df.select(tok("t").alias("ids")).collect()]
    assert got == [[1, 2, 3], [], []]


def test_alpaca_form_strips_spaces_only(spark):
    df = spark.createDataFrame([("Human: q\n\nAssistant: ", "  out \n")], ["prompt", "completion"])
    r = io.alpaca_form(df).first()
    assert (r.instruction, r.output) == ("q", "out \n")


def test_completion_dump_roundtrip_and_first_sample(spark):
    rows = spark.createDataFrame(
        [("m", 0, 5, "p", 1, "second"), ("m", 0, 5, "p", 0, "first"), ("m", 0, 9, "p", 0, "later row"),
         ("m", 1, 2, "p", 0, "other shard")], io.SAMPLE_SCHEMA)
    path = io.write_completions(rows, io.scratch_path(spark, "roundtrip"))
    back = io.first_samples(io.read_completion_rows(spark, path)).orderBy("shard").collect()
    assert [(r.shard, r.completion, r.n_samples) for r in back] == [(0, "first", 3), (1, "other shard", 1)]
    assert F is not None
