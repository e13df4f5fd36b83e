"""Operator 5, URL filters by a temporal list join [native].

A list is a set of dated entries (key, action, on): from that day on, ``key`` is
blocked, allowed, or removed. A key is a host or a parent domain, or a host with
its first path segment (``host/segment``). Entries become validity intervals:
an entry holds until the key's next one. A capture asks for all its keys as of
its fetch day; of the entries active then, the most specific decides.

Plan: entries are first reduced to one per key and day (so a key has at most one
row per day of history, whatever the list's size), then windowed by key. Captures
are reduced to their distinct (host, segment, day), whose keys meet the intervals
in an equi-join on (key, month) with the interval test on top: intervals are laid
out by month, so that a host with a third of all captures is spread over months
and days. The verdicts go back to the captures by an equi-join with one row per
key. No join emits more than one interval per key and day.

Defined results: a null or unparsable URL has no host, meets no entry and is
``unlisted``; a null day meets no entry; entries with a null key, day or action
are void; of entries of one key and day, remove wins over allow over block; empty
tables give ``unlisted`` or no rows; repeated captures are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import table

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)"
ACTIONS = ("block", "allow", "remove")


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; empty without one."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) of the blocking and allowing entries;
    valid_to is exclusive, null while open."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    days = entries.where(F.col("key").isNotNull() & F.col("on").isNotNull() & F.col("action").isin(*ACTIONS))
    days = days.groupBy("key", F.col("on").cast("date").alias("valid_from")).agg(F.max(rank).alias("rank"))
    then = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    out = days.withColumn("valid_to", then).withColumn("action", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")))
    return out.where(F.col("action") != "remove").select("key", "action", "valid_from", "valid_to")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (with url and fetched_on) with host, verdict (blocked, allowed
    or unlisted), matched_key and valid_from; columns of these names are replaced."""
    new = ("host", "verdict", "matched_key", "valid_from")
    keep = [F.col(f"`{c}`") for c in captures.columns if c.lower() not in new]
    asked_by = [host_of(F.col("url")).alias("_host"), segment_of(F.col("url")).alias("_segment"), F.col("fetched_on").cast("date").alias("_day")]
    rows = captures.select(*keep, *asked_by)
    asked = rows.select("_host", "_segment", "_day").where("_host <> '' and _day is not null").distinct()
    labels = F.split("_host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = F.concat(domains, F.when(F.col("_segment") != "", F.array(F.concat_ws("/", "_host", "_segment"))).otherwise(F.array()))
    keyed = asked.select("*", F.explode(keys).alias("_key"))
    spans = intervals(entries)
    # An open interval reaches to the last day that is asked for.
    last = rows.agg(F.max("_day").alias("d")).first()["d"]
    end = F.least(F.coalesce("valid_to", F.lit(last)), F.lit(last))
    spans = spans.where(F.col("valid_from") <= F.lit(last)).select("*", F.explode(F.sequence(_month(F.col("valid_from")), _month(end))).alias("_month"))
    active = keyed.join(spans, (F.col("_key") == F.col("key")) & (_month(F.col("_day")) == F.col("_month")))
    active = active.where((F.col("valid_from") <= F.col("_day")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))))
    # All keys of a capture are suffixes of its host, or the host and more: longer is more specific.
    found = active.groupBy("_host", "_segment", "_day").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "valid_from")).alias("_found"))
    out = rows.join(found, ["_host", "_segment", "_day"], "left")
    verdict = F.when(F.col("_found.action") == "block", "blocked").when(F.col("_found.action") == "allow", "allowed").otherwise("unlisted")
    return out.select(
        *keep, F.col("_host").alias("host"), verdict.alias("verdict"), F.col("_found.key").alias("matched_key"), F.col("_found.valid_from").alias("valid_from")
    )


def _int(text: Column, first: int, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(text), first, 6), 16, 10).cast("int"), F.lit(modulus))


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day: one of the 730 days from 2023-01-01, by id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")).alias("fetched_on"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list from the pages' own hosts: every host is blocked on one day
    and removed on a later one, every second-level domain is blocked and later
    allowed, and every first path segment is allowed from some day on."""
    start = F.lit("2023-01-01").cast("date")
    hosts = pages.select(host_of(F.col("url")).alias("h"), segment_of(F.col("url")).alias("s")).where("h <> ''").distinct()
    hosts = hosts.select("h", "s", F.substring_index("h", ".", -2).alias("d"))

    def entry(key, action, day):
        return F.struct(key.alias("key"), F.lit(action).alias("action"), F.date_add(start, day).alias("on"))

    h, d, hs = F.col("h"), F.col("d"), F.concat_ws("/", "h", "s")
    both = F.array(
        entry(h, "block", _int(h, 1, 500)),
        entry(h, "remove", _int(h, 1, 500) + 1 + _int(h, 7, 300)),
        entry(d, "block", _int(d, 1, 300)),
        entry(d, "allow", _int(d, 1, 300) + 1 + _int(d, 7, 300)),
        F.when(F.col("s") != "", entry(hs, "allow", _int(hs, 1, 1000))),
    )
    return hosts.select(F.explode(both).alias("e")).where("e is not null").select("e.*").distinct()


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(dated_captures(pages), dated_list(pages))
