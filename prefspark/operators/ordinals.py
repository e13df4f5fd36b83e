"""Row positions without a single-partition window.

The reference works on Python lists, so "first N", "first fraction", "row i of
the shuffled list" and "pair index inside a prompt" all depend on a position.
A global ``row_number()`` with no ``partitionBy`` would drag every row into one
task, so positions are computed the way ``zipWithIndex`` does it, but on
DataFrames:

1. range-partition by the ordering key (Spark samples the bounds, so a hot key
   value range is spread over several partitions) and sort inside partitions;
2. ``monotonically_increasing_id`` then encodes (partition, local index);
3. per (partition[, group]) counts form a small table whose running sum gives
   each partition's offset; it is joined back.

The ordering columns must be a unique key (ties would make positions depend on
shuffle fetch order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def _cols(cols: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _located(df: DataFrame, keys: list[Column], partitions: int | None) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys`` with (partition, local index).

    The result is checkpointed (eagerly, into the shared checkpoint folder)
    before the count branch and the main branch read it: each branch would
    otherwise plan its own range exchange, and Spark seeds the bound sampling
    with the RDD id, so on large partitions the two could disagree on which
    partition a row belongs to. The checkpoint also survives lost executors."""
    # Without an explicit count AQE may coalesce adjacent range partitions to its
    # advisory size; a coalesced partition reads its ranges in order and is
    # re-sorted, so partition index order still follows key order.
    if partitions:
        ranged = df.repartitionByRange(partitions, *keys)
    else:
        ranged = df.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    located = (
        ranged.withColumn("_mid", mid)
        .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_mid")
    )
    return materialize(located)


def _keyed(df: DataFrame, keys: list[Column], prefix: str) -> tuple[DataFrame, list[str]]:
    names = [f"_{prefix}{i}" for i in range(len(keys))]
    return df.select("*", *[k.alias(n) for k, n in zip(keys, names)]), names


def _with_positions(keyed: DataFrame, positions: DataFrame, names: list[str], out: str) -> DataFrame:
    """``keyed`` joined once with the narrow table of positions; null-safe, as a
    null key is a key and its row must not vanish."""
    right = positions.select(*[F.col(n).alias(f"{n}r") for n in names], F.col("_rn").alias(out))
    rows = keyed.drop(out) if out in keyed.columns else keyed
    same = [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names]
    return rows.join(right, same).drop(*names, *[f"{n}r" for n in names])


def dense_index(
    df: DataFrame,
    order_cols: str | Column | Sequence[str | Column],
    out: str = "rn",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: 1-based position of each row in the total order ``order_cols``.

    Only the order columns are ranged and checkpointed; the rows themselves move
    once, in the join with their positions."""
    keyed, names = _keyed(df, _cols(order_cols), "k")
    located = _located(keyed.select(*names), [F.col(n) for n in names], partitions)
    counts = located.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # At most `partitions` rows: the unpartitioned window is over this tiny table only.
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    positions = located.join(F.broadcast(offsets), "_pid").withColumn("_rn", (F.col("_off") + F.col("_loc") + 1).cast("bigint"))
    return _with_positions(keyed, positions, names, out)


def index_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: str | Column | Sequence[str | Column],
    out: str = "rn",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: 1-based position of each row inside its group, ordered by
    ``order_cols`` (group + order must be unique).

    One path for groups of any size: a digest of the group and the order columns
    are range-partitioned, so a large group spreads over many partitions; counts
    per (partition, group) give each part's offset. Only these narrow keys are
    ranged and checkpointed; the rows move once, in the join with their positions."""
    digest = F.md5(F.to_json(F.struct(*group_cols), {"ignoreNullFields": "false"}))
    keyed, names = _keyed(df, [digest, *_cols(order_cols)], "k")
    located = _located(keyed.select(*names), [F.col(n) for n in names], partitions)
    group = names[0]
    per_part = located.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_loc").alias("_loc0"))
    # One row per (partition, group): a group spans at most `partitions` rows here.
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select(
        F.col("_pid").alias("_b_pid"), F.col(group).alias("_b_group"), "_loc0",
        F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_before"),
    )
    positions = located.join(before, (F.col("_pid") == F.col("_b_pid")) & (F.col(group) == F.col("_b_group"))).withColumn(
        "_rn", (F.col("_before") + F.col("_loc") - F.col("_loc0") + 1).cast("bigint"))
    return _with_positions(keyed, positions, names, out)


def prefix_fraction(df: DataFrame, order_col: str, fraction: float, partitions: int | None = None) -> DataFrame:
    """Keep the first ``int(n * fraction)`` rows in ``order_col`` order.

    ``n * fraction`` is evaluated in DOUBLE like Python (``100 * 0.29`` -> 28)."""
    if fraction >= 1.0:
        return df
    n = df.count()
    k = int(n * fraction)
    return dense_index(df, order_col, "_rn", partitions).filter(F.col("_rn") <= k).drop("_rn")


def first_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order_col``; planned as TakeOrderedAndProject
    (each partition keeps its own top n, so at most n rows per task move)."""
    return df.orderBy(order_col).limit(n)


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """Deterministic pseudo-random 60-bit sort key from md5(seed || key)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]
    digest = F.md5(F.concat_ws("\u0001", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
