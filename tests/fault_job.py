"""Run a positions + last-wins pipeline with injected task failures.

Usage: python fault_job.py <inject 0|1>  -> prints one JSON line of results.
Run with master local[4,4] so a failed task attempt is retried."""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from prefspark.operators import ordinals  # noqa: E402
from prefspark.session import ensure_checkpoint_dir, ship_package  # noqa: E402
from prefspark.sources.dialogue import last_wins  # noqa: E402

INJECT = sys.argv[1] == "1"
FAIL_LOG = sys.argv[2] if len(sys.argv) > 2 else None


@F.pandas_udf(T.LongType())
def flaky(x: pd.Series) -> pd.Series:
    ctx = TaskContext.get()
    if INJECT and ctx is not None and ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 1:
        if FAIL_LOG:
            with open(FAIL_LOG, "a") as f:
                f.write(f"{ctx.stageId()}:{ctx.partitionId()}\n")
        raise RuntimeError("injected task failure")
    return x


def main() -> None:
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "6").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    df = spark.range(0, 20000, numPartitions=8).select(
        flaky(F.col("id")).alias("ord"),
        (F.col("id") % 37).cast("string").alias("prompt"),
        F.concat(F.lit("t"), (F.col("id") * 7 % 1000).cast("string")).alias("target"),
    )
    ranked = ordinals.dense_index(df, "ord", "rn", partitions=5)
    within = ordinals.index_within(ranked, ["prompt"], "ord", "k", partitions=5)
    agg = last_wins(within.select("prompt", "target", "ord"))
    out = {
        "rn": sorted(tuple(r) for r in within.select("ord", "rn", "k").collect()),
        "last": sorted(tuple(r) for r in agg.collect()),
    }
    print(json.dumps({"rn_sum": sum(x[1] * 31 + x[2] for x in out["rn"]), "n": len(out["rn"]),
                      "rn_ok": [x[1] for x in out["rn"]] == list(range(1, 20001)),
                      "last": out["last"][:5], "n_last": len(out["last"])}))
    spark.stop()


if __name__ == "__main__":
    main()
