"""JSON files that are one array of objects or one object, read in parallel.

Such a file has no record separator, and often no line break. It is split at
quotation marks instead, which Spark's text reader can do by byte ranges on any store:
a file of many blocks is read by many tasks, and no row holds more than a string.
What a piece means depends on everything before it, but only through sums:

1. a piece that ends with an odd number of backslashes is followed by an escaped mark,
   so the number of unescaped marks before a piece tells whether it lies in a string;
2. outside of strings, opened less closed brackets are the depth;
3. commas at depth 1 count the records.

Each sum is made within a chunk (up to ``CHUNK`` pieces of the block that one task
read) and completed by the sums of the file's earlier chunks, a row per chunk: how
much a task sorts doesn't depend on the size of a block or a file. The pieces of a
record are then put together and parsed. A record must fit into a row, as it does in
the file; text between two quotation marks as well.

A file is written by one task, so more files are written where there is more text
(``ranged``).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.session import materialize

CHUNK_BITS = 13
CHUNK = 1 << CHUNK_BITS
FILE_BYTES = 32 << 20
_BLOCK = ["file", "block", "chunk"]


def _sum_before(df: DataFrame, value: Column, order: list[str], out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the file."""
    df = df.withColumn("_v", value)
    earlier = Window.partitionBy(*_BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("chunk").alias("_c")).agg(F.sum("_v").alias("_t"))
    previous = Window.partitionBy("_f").orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_f", "_b", "_c", F.coalesce(F.sum("_t").over(previous), F.lit(0)).alias("_o"))
    rows = df.withColumn("_w", F.coalesce(F.sum("_v").over(earlier), F.lit(0)))
    rows = rows.join(blocks, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")) & (F.col("chunk") == F.col("_c")))
    return rows.withColumn(out, F.col("_w") + F.col("_o")).drop("_v", "_w", "_f", "_b", "_c", "_o")


def records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, pos, text): the elements of the files' arrays, or the ``key: value``
    entries of their objects, as JSON text; ``pos`` is the place in the file (from 0)."""
    reader = spark.read.option("lineSep", '"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    pieces = materialize(reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value")).withColumn("chunk", F.shiftright("at", CHUNK_BITS)))
    # The mark after a piece is real unless an odd number of backslashes ends the piece.
    real = (F.length(F.regexp_extract("value", r"(\\*)$", 1)) + 1) % 2
    marked = _sum_before(pieces, real, ["at"], "marks").withColumn("inside", F.col("marks") % 2 == 1)
    whole = F.concat("value", F.lit('"'))  # after the file's last piece it is dropped with the depth below 1
    parts = F.when(F.col("inside"), F.array(whole)).otherwise(F.split(whole, r"(?<=[\[\]{},])|(?=[\[\]{},])"))
    tokens = materialize(marked.select(*_BLOCK, "at", "inside", F.posexplode(parts).alias("place", "token")))
    order = ["at", "place"]
    outside = ~F.col("inside")
    step = F.when(outside & F.col("token").isin("[", "{"), 1).when(outside & F.col("token").isin("]", "}"), -1).otherwise(0)
    deep = _sum_before(tokens, step, order, "depth")
    comma = outside & (F.col("token") == ",") & (F.col("depth") == 1)
    placed = _sum_before(deep, F.when(comma, 1).otherwise(0), order, "pos")
    ends = outside & (F.col("depth") == 1) & F.col("token").isin(",", "]", "}")
    kept = placed.where((F.col("depth") >= 1) & ~ends)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "place", "token"))), lambda x: x["token"]), "")
    return kept.groupBy("file", "pos").agg(F.trim(F.regexp_replace(joined, r"^\s+|\s+$", "")).alias("text")).where("text <> ''")


def read_array(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """Files that each hold one array of objects: (file, pos, record)."""
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    return records(spark, path, glob).select("file", "pos", parsed.alias("record"))


def read_object(spark: SparkSession, path: str, value: str, glob: str | None = None) -> DataFrame:
    """Files that each hold one object: (file, pos, key, value). A repeated key keeps
    its first position and its last value, as a dict does."""
    entry = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), f"map<string,{value}>", {"mode": "FAILFAST"})
    entries = records(spark, path, glob).select("file", "pos", F.explode(entry).alias("key", "value"))
    return entries.groupBy("file", "key").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos")).select(
        "file", "pos", "key", "value")


def ranged(df: DataFrame, key: str, files: int, size: int) -> DataFrame:
    """``df`` in ranges of ``key``, one per file to write: ``files``, or more where
    ``size`` bytes of text would give a file more than ``FILE_BYTES``."""
    return df.repartitionByRange(max(files, -(-size // FILE_BYTES)), key).sortWithinPartitions(key)


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes in the text columns."""
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in columns]
    return sum(df.agg(*(x.alias(f"_{k}") for k, x in enumerate(sizes))).first())


def _written(df: DataFrame, path: str, opens: str, closes: str, item) -> str:
    """One file per partition: ``opens``, the items and ``closes``, a line each."""

    def run(batches):
        before = opens
        for b in batches:
            lines = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(before + item(*row))
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([closes if before == "," else opens + closes])], ["value"])

    df.mapInArrow(run, "value string").write.mode("overwrite").text(path)
    return path


def write_array(df: DataFrame, path: str) -> str:
    """The rows as JSON files of one array each, in the order of the partitions."""
    return _written(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})), path, "[", "]", lambda x: x)


def write_object(df: DataFrame, path: str, key: str, value: str) -> str:
    """``{key: value, ...}`` per file; keys are written as often as they occur."""
    return _written(df.select(key, F.to_json(value)), path, "{", "}", lambda k, v: f"{json.dumps(k)}: {v}")
