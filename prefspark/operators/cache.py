"""A store of completions that can replace what it holds.

A write is a delta: a folder of rows partitioned by key bucket, numbered by the state
of the table it makes (``sources.snapshots``). A key's value is that of its latest
delta, found on reading. ``compact`` merges the deltas into one folder; until its
manifest is renamed into place readers see the deltas, and nothing is lost if it fails.

Every folder has a Bloom filter of its keys: per bucket, words of 64 bits as rows. A
request's bits are looked up by a join of narrow rows; only the requests that may be in a
folder, and only their buckets, are read there. A request that was never answered
costs no scan of answers (but for one in a hundred, the filter's false share).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators import matching
from prefspark.session import materialize
from prefspark.sources.snapshots import Snapshots

BITS_PER_KEY, HASHES = 10, 7
COLUMNS = "key string, instruction string, response string, finish_reason string"


def bucket(key: str = "key"):
    """The first two hex digits of a sha256 key: 256 evenly filled buckets."""
    return F.substring(F.col(key), 1, 2)


def _bits(keys: DataFrame, words) -> DataFrame:
    """(key, bucket, word, bit): the places of each key in its bucket's filter."""
    spots = F.explode(F.array(*[F.struct(F.pmod(F.xxhash64("key", F.lit(2 * k)), words).alias("word"),
                                         F.pmod(F.xxhash64("key", F.lit(2 * k + 1)), F.lit(64)).cast("int").alias("bit")) for k in range(HASHES)]))
    return keys.select("key", bucket().alias("bucket"), spots.alias("s")).select("key", "bucket", "s.word", "s.bit").distinct()


class CompletionCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Snapshots(spark, root)

    def _write(self, rows: DataFrame, folder: str) -> None:
        """``rows`` (key, ..., version) with one row per key, and their filter."""
        rows.withColumn("bucket", bucket()).write.partitionBy("bucket").parquet(f"{folder}/rows")
        stored = self.spark.read.parquet(f"{folder}/rows").select("key")
        words = F.lit(max(1, -(-stored.count() * BITS_PER_KEY // (256 * 64)))).cast("bigint")
        held = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits")
        _bits(stored, words).groupBy("bucket", "word").agg(held).withColumn("words", words).write.parquet(f"{folder}/filter")

    def put(self, rows: DataFrame) -> int:
        """Store (key, instruction, response, finish_reason), over what a key had; of a
        key's several rows any one."""
        base, _ = self.table.state()
        once = rows.groupBy("key").agg(F.max(F.struct("instruction", "response", "finish_reason")).alias("v"))
        once = once.select("key", "v.*", F.lit(base + 1).cast("bigint").alias("version"))
        return self.table.append(lambda folder: self._write(once, folder))

    def _maybe(self, keys: DataFrame, folder: str) -> DataFrame:
        """The keys that the folder's filter doesn't exclude."""
        filters = self.spark.read.parquet(f"{folder}/filter")
        first = filters.select("words").first()
        if first is None:
            return keys.limit(0)
        bits = _bits(keys, F.lit(first["words"]).cast("bigint"))
        on = (F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1))) == 1
        found = bits.join(filters.select("bucket", "word", "bits"), ["bucket", "word"]).where(on).groupBy("key").agg(F.count(F.lit(1)).alias("on"))
        asked = bits.groupBy("key").agg(F.count(F.lit(1)).alias("all"))
        return asked.join(found, "key").where(F.col("on") == F.col("all")).select("key")

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{COLUMNS}, version bigint, bucket string").parquet(f"{folder}/rows")

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, instruction, response, finish_reason) of the keys that are stored."""
        _, folders = self.table.state()
        keys = materialize(keys.select("key").distinct())
        out = self.spark.createDataFrame([], f"{COLUMNS}, version bigint")
        for folder in folders:  # a few deltas and the last compaction
            maybe = materialize(self._maybe(keys, folder))
            wanted = [r[0] for r in maybe.select(bucket().alias("b")).distinct().collect()]  # 256 at most
            if wanted:
                out = out.unionByName(self._rows(folder).where(F.col("bucket").isin(wanted)).drop("bucket").join(maybe, "key", "left_semi"))
        return self._latest(out)

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("instruction", "response", "finish_reason"), "version")
        return rows.groupBy("key").agg(best.alias("v")).select("key", "v.*")

    def _all(self, folders: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{COLUMNS}, version bigint")
        for folder in folders:
            out = out.unionByName(self._rows(folder).drop("bucket"))
        return out

    def rows(self) -> DataFrame:
        """Everything stored, each key's latest value."""
        return self._latest(self._all(self.table.state()[1]))

    def compact(self) -> None:
        """One folder instead of all; readers go on with the old ones until it is done."""
        base, folders = self.table.state()
        if len(folders) > 1:
            whole = self._latest(self._all(folders)).withColumn("version", F.lit(base + 1).cast("bigint"))
            folder = self.table.new_folder()
            self._write(whole, folder)
            self.table.commit([folder], base)

    def complete(self, requests: DataFrame, complete: Callable[[pd.DataFrame], pd.DataFrame], no_cache: bool = False) -> DataFrame:
        """Requests (key, instruction) with response, finish_reason and source: stored
        answers, and computed ones for the others, or for all with ``no_cache``. What is computed
        is stored, over older answers."""
        requests = materialize(requests.dropDuplicates(["key"]))
        stored = self.spark.createDataFrame([], COLUMNS) if no_cache else self.get(requests)
        done = materialize(matching.cached_completions(requests, stored, complete, no_cache=no_cache))
        self.put(done.where(F.col("source") == "miss").select("key", "instruction", "response", "finish_reason"))
        return done
