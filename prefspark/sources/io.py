"""File sources and sinks: JSON completion maps (S10, O1, O4), alpaca-form
dumps (O2), comparison inputs (O3), prediction lines (O5), win-rate tables
(O6) and leaderboard CSVs (S15).

Scratch output goes under the session's checkpoint folder, which on a cluster
is the shared location named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.session import ensure_checkpoint_dir
from prefspark.sources import jsonfiles
from prefspark.sources.snapshots import Snapshots


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/prefspark-scratch/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------- S10
def read_completion_maps(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files that each hold one JSON object ``{prompt: [completion, ...]}``.
    Rows ``(file, pos, prompt, completions)``; files are ordered by path and keys
    by their position in the file (dict order). Duplicate keys keep the last
    value, as ``json.load`` does. Large files are read by many tasks."""
    return jsonfiles.read_object(spark, path, "array<string>", glob).select(
        "file", "pos", F.col("key").alias("prompt"), F.col("value").alias("completions"))


def write_completion_maps(samples: DataFrame, path: str, files: int = 1) -> str:
    """O1 in the reference's layout: ``{prompt: [sample, ...]}``, keys in the order of
    their first row, a prompt's samples in the order (ord, sample_ix). Prompts are
    ranged over ``files`` files, or more where there is much text; use ``write_completions`` where a prompt may have very
    many samples."""
    entries = samples.groupBy("prompt").agg(
        F.min("ord").alias("ord"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample_ix", "completion"))), lambda x: x["completion"]).alias("samples"),
    )
    size = jsonfiles.text_bytes(samples, "completion")
    return jsonfiles.write_object(jsonfiles.ranged(entries, "ord", files, size), path, "prompt", "samples")


DIALOGUE = "id bigint, conversations array<struct<`from`: string, value: string>>"


def write_dialogues(turns: DataFrame, path: str, files: int = 1) -> str:
    """Conversations as arrays of ``{id, conversations: [{from, value}, ...]}``, ranged
    over ``files`` files, or more where there is much text."""
    said = F.struct("pos", F.col("role").alias("from"), F.col("text").alias("value"))
    convs = turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(said)).alias("t"))
    convs = convs.select("id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))
    size = jsonfiles.text_bytes(turns, "role", "text")
    return jsonfiles.write_array(jsonfiles.ranged(convs, "id", files, size), path)


def read_dialogues(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S10 for dialogue files: turns (conv_id, pos, role, text, ord). ``conv_id`` and
    ``ord`` are places (file, record) and (file, record, turn); an entry's index is its pos."""
    rows = jsonfiles.read_array(spark, path, DIALOGUE, glob)
    turns = rows.select("file", F.col("pos").alias("record"), F.posexplode("record.conversations").alias("pos", "turn"))
    return turns.select(
        F.struct("file", "record").alias("conv_id"), F.col("pos").cast("bigint").alias("pos"), F.col("turn.from").alias("role"),
        F.col("turn.value").alias("text"), F.struct("file", "record", "pos").alias("ord"))


ANNOTATION = "instruction string, output_1 string, output_2 string, preference double"


def read_annotations(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S10 for judge annotations: (ord, instruction, output_1, output_2, preference)."""
    rows = jsonfiles.read_array(spark, path, ANNOTATION, glob)
    return rows.select(F.struct("file", "pos").alias("ord"), "record.*")


SAMPLE_SCHEMA = "model string, shard int, ord bigint, prompt string, sample_ix int, completion string"


def read_completion_rows(spark: SparkSession, path: str) -> DataFrame:
    """S10 for the JSON-lines layout written by ``write_completions``: one line
    per sample ``(model, shard, ord, prompt, sample_ix, completion)``."""
    return Snapshots(spark, path).read(lambda folders: spark.read.schema(SAMPLE_SCHEMA).json(folders[0]), SAMPLE_SCHEMA)


# ------------------------------------------------------------------- O1/O4
def write_completions(df: DataFrame, path: str) -> str:
    """The completion dump as JSON lines, one line per sample, partitioned
    by model. A rewrite is a new folder that replaces the old one in one step
    (``sources.snapshots``): a reader, or a crash, sees the old dump or the new one. The
    reference's ``{prompt: [samples...]}`` object is the same data grouped; writing samples
    as lines keeps a prompt repeated many times from becoming one huge row."""
    Snapshots(df.sparkSession, path).replace(lambda folder: df.write.partitionBy("model").json(folder))
    return path


def first_samples(samples: DataFrame, key=("model", "shard", "prompt")) -> DataFrame:
    """A4+W11: the samples of a prompt in one dump are appended in order and
    consumers read the first (``v[0]``). That first sample is a map-side
    ``min_by`` on (position, sample index), so a prompt repeated across many
    rows is reduced before the shuffle and no list is gathered."""
    return samples.groupBy(*key).agg(
        F.min("ord").alias("ord"),
        F.min_by("completion", F.struct("ord", "sample_ix")).alias("completion"),
        F.count(F.lit(1)).cast("bigint").alias("n_samples"),
    )


# ------------------------------------------------------------------- O2/O3
def alpaca_form(responses: DataFrame, prompt: str = "prompt", completion: str = "completion",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """O2: ``{instruction, output}`` with the template trimmed and the first
    completion (``first_samples``) stripped of spaces only; ``keep`` carries
    extra columns along."""
    from prefspark.functions import text as T

    return responses.select(
        *keep,
        T.strip_template(prompt).alias("instruction"),
        T.strip_spaces(F.col(completion)).alias("output"),
    )


def write_comparison_inputs(rows: DataFrame, path: str) -> str:
    """O3: one folder per generator holding ``{instruction, output, generator}``."""
    rows.write.mode("overwrite").partitionBy("generator").json(path)
    return path


def write_predictions(df: DataFrame, path: str) -> str:
    """``acc,loss`` lines."""
    df.select("acc", "loss").write.mode("overwrite").csv(path)
    return path


def save_table(df: DataFrame, path: str) -> str:
    """Win-rate table persisted as Parquet (the reference pickles a dict)."""
    df.write.mode("overwrite").parquet(path)
    return path


# ------------------------------------------------------------------- S15
def read_run_names(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``<root>/<run>/name.txt``; the first line is the run's name. Line
    order inside these one-line files is the read order (one split per file)."""
    names = (
        spark.read.text(f"{root}/{pattern}/name.txt")
        .select(F.col("_metadata.file_path").alias("f"), "value")
        .withColumn("run_dir", F.regexp_extract("f", r"^(?:file:)?(.*)/name\.txt$", 1))
        .withColumn("line_no", F.monotonically_increasing_id())
    )
    return names.groupBy("run_dir").agg(F.min_by("value", "line_no").alias("name"))


def read_leaderboard_rows(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``<root>/<run>/<evaluator>/leaderboard.csv`` rows ``(c0 name, c1 win
    rate)`` with their run folder, evaluator and read order (``line_no``)."""
    return (
        spark.read.schema("c0 string, c1 string").csv(f"{root}/{pattern}/*/leaderboard.csv")
        .select(F.col("_metadata.file_path").alias("f"), "c0", "c1")
        .withColumn("run_dir", F.regexp_extract("f", r"^(?:file:)?(.*)/[^/]+/leaderboard\.csv$", 1))
        .withColumn("evaluator", F.regexp_extract("f", r"/([^/]+)/leaderboard\.csv$", 1))
        .withColumn("line_no", F.monotonically_increasing_id())
        .drop("f")
    )
