"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive rounded values)."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as E
from conftest import SMALL
from prefspark.plans.catalog import all_queries

OWN = all_queries()
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in OWN}
QUERIES = {k: v for k, v in E.queries().items() if k in OWN}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_oracle_or_is_marked():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"html_paragraphs"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["prompt", "sft_target", "first_ord"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert _rows(scols, srows) == _rows(dcols, drows)
