"""Operator 7, sharding by a permutation-filled lookup table [native].

Every shard has a preference order over the slots of a prime-sized table: it
starts at ``offset`` and goes on in steps of ``skip``, both hashes of its name.
The shards take turns; in its turn a shard claims the first slot of its order
that is free. A key's slot is its hash modulo the table's size, so placement is
one lookup in a broadcast table of ``slots`` rows, and a change of the shard list
moves few keys. Shares differ by about ``shards / slots``.

The table is one row's fold over the turns, in SQL; ``slots`` is a parameter and
at most ``MAX_SLOTS``, which bounds the broadcast whatever is placed. Nothing is
shuffled, so a key that holds a third of the rows costs nothing extra.

Defined results: a null key is placed as the empty text; equal keys share a slot;
an empty table gives no rows; shard names are taken once each and in the order of
their names; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import table

SHARDS = 32
SLOTS = 4093
MAX_SLOTS = 65_537


def _hash(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("bigint")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for all slots of the prime ``slots``."""
    names = sorted(set(shards))
    if not names or slots > MAX_SLOTS or slots < 100 * len(names) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime, at least 100 for each shard and at most {MAX_SLOTS}")
    n, size = F.lit(len(names)), F.lit(slots)
    given = F.array(*map(F.lit, names))
    # Taken to the driver once, as literals: one number per shard, not one per turn.
    orders = spark.range(1).select(
        F.transform(given, lambda s: F.pmod(_hash(s, 1, 8), size)).alias("offset"),
        F.transform(given, lambda s: F.pmod(_hash(s, 9, 8), size - 1) + 1).alias("skip"),
    )
    orders = orders.first()
    offset, skip = F.lit(orders.offset), F.lit(orders.skip)

    def slot_of(shard, j):
        return F.pmod(offset[shard] + j * skip[shard], size).cast("int")

    def once(value, use):  # evaluates value once, not at each use in a lambda
        return F.transform(F.array(value), use)[0]

    def claimed(state, shard, free, slot):
        return F.struct(
            F.transform(state["owner"], lambda o, i: F.when(i == slot, shard).otherwise(o)).alias("owner"),
            F.transform(state["tried"], lambda j, i: F.when(i == shard, free + 1).otherwise(j)).alias("tried"),
        )

    def turn(state, step):
        shard = F.pmod(step, n)
        free = F.filter(F.sequence(state["tried"][shard], size - 1), lambda j: state["owner"][slot_of(shard, j)] < 0)[0]
        return once(free, lambda f: once(slot_of(shard, f), lambda slot: claimed(state, shard, f, slot)))

    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0), len(names)).alias("tried"))
    filled = F.aggregate(F.sequence(F.lit(0), size - 1), start, turn, lambda state: state["owner"])
    return spark.range(1).select(F.posexplode(filled).alias("slot", "owner")).select(
        F.col("slot").cast("bigint").alias("slot"), given[F.col("owner")].alias("shard")
    )


def place(rows: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with the columns ``slot`` and ``shard`` of ``key`` (an expression
    over ``rows``); columns of these names are replaced."""
    lookup = F.broadcast(lookup_table(rows.sparkSession, shards, slots))  # slots rows
    keep = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard")]
    slot = F.pmod(_hash(F.coalesce(key.cast("string"), F.lit("")), 1, 15), F.lit(slots))
    return rows.select(*keep, slot.alias("slot")).join(lookup, "slot").select(*keep, "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, F.col("doc_id"), shard_names())


def brute_force(shards: list[str], slots: int) -> list[str]:
    """The table by the rule's own loop; for tests."""
    import hashlib

    names = sorted(set(shards))
    digest = [hashlib.md5(s.encode()).hexdigest() for s in names]
    orders = [[(int(d[:8], 16) % slots + j * (int(d[8:16], 16) % (slots - 1) + 1)) % slots for j in range(slots)] for d in digest]
    owner: dict[int, str] = {}
    turns = [iter(o) for o in orders]
    while len(owner) < slots:
        for k, name in enumerate(names):
            if len(owner) < slots:
                owner[next(s for s in turns[k] if s not in owner)] = name
    return [owner[s] for s in range(slots)]
