"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from prefspark.plans import dialogue_queries  # noqa: F401
from prefspark.plans.registry import QUERIES, Query

_OPTIONAL = (
    "prefspark.plans.record_queries",
    "prefspark.plans.batch_queries",
    "prefspark.plans.match_queries",
    "prefspark.plans.metric_queries",
    "prefspark.plans.report_queries",
    "prefspark.plans.bt_queries",
    "prefspark.plans.html_queries",
    "prefspark.plans.registry_queries",
    "prefspark.plans.stream_queries",
)

for _mod in _OPTIONAL:
    try:
        __import__(_mod)
    except ModuleNotFoundError as exc:  # module not written yet
        if exc.name != _mod:
            raise


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)
