"""Plan checks over every registered query: no unpartitioned window except the
running offset over per-partition counts (at most #partitions rows), no
cartesian products, and no row-at-a-time Python UDF."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from conftest import SMALL
from prefspark.plans.catalog import all_queries

OWN = all_queries()
QUERIES = {k: v for k, v in E.queries().items() if k in OWN}
# What may feed a single-partition exchange: a map-side partial global aggregate
# (one row per task), the per-partition count table of ordinals (keys=[_pid]),
# or a limit that is the feature (top-k).
_SINGLE_OK = re.compile(
    r"(Hash|ObjectHash|Sort)Aggregate\(keys=\[(\]|_pid#)"
    r"|LocalLimit|GlobalLimit|TakeOrderedAndProject"
)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    lines = _plan(QUERIES[name](spark, SMALL)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            assert _SINGLE_OK.search(child), f"all rows into one task: {child.strip()[:200]}"
        assert "CartesianProduct" not in line
        assert "BroadcastNestedLoopJoin" not in line, line.strip()[:200]
        assert "BatchEvalPython" not in line, f"row-at-a-time Python UDF: {line.strip()[:200]}"


def test_plan_check_sees_the_offset_window(spark):
    plan = _plan(QUERIES["hash_split_1pct"](spark, SMALL))
    assert "Exchange SinglePartition" in plan and "HashAggregate(keys=[_pid#" in plan


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from prefspark.sources.fixtures import table

    df = table(spark, SMALL, "events").filter(F.col("event_type") == "click").select("event_id", "value")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan
