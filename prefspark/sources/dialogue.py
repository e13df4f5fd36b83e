"""Dialogue sources: multi-turn SFT rows (S4) and first-exchange rows.

Input is the long turn table D4: ``(conv_id, pos, role, text, ord)`` where
``pos`` is the 0-based entry position inside the conversation and ``ord`` a
global, unique row order (conversation order first). Roles ``human``/``user``
and ``gpt``/``assistant`` are recognised; any other role is ignored but still
occupies an entry slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import text as T
from prefspark.operators import ordinals


def role_code(role: str = "role"):
    """'h' for a human turn, 'g' for a model turn, 'o' for anything else."""
    r = F.lower(F.col(role))
    return F.when(r.isin("human", "user"), "h").when(r.isin("gpt", "assistant"), "g").otherwise("o")


def flagged_conversations(turns: DataFrame, tokens=T.SPECIAL_TOKENS_3) -> DataFrame:
    """ids of conversations with a special token in any turn. A partial
    (map-side) aggregate, so a conversation with very many turns is combined
    before the shuffle."""
    return turns.filter(T.has_any(["text"], tokens)).select("conv_id").distinct()


def conversation_prefix(turns: DataFrame, data_fraction: float) -> DataFrame:
    """W1 on conversations: keep turns of the first ``int(n * f)`` conversations."""
    if data_fraction >= 1.0:
        return turns
    convs = turns.groupBy("conv_id").agg(F.min("ord").alias("conv_ord"))
    kept = ordinals.prefix_fraction(convs, "conv_ord", data_fraction).select("conv_id")
    return turns.join(kept, "conv_id", "left_semi")


def sharegpt_sft_rows(turns: DataFrame, num_turns: int = 2, data_fraction: float = 1.0,
                      tokens=T.SPECIAL_TOKENS_3) -> DataFrame:
    """S4 before de-duplication: one (prompt, target, ord) per model turn among the
    first ``2*num_turns+1`` entries of every clean conversation (T4 prompt fold)."""
    turns = conversation_prefix(turns, data_fraction)
    limit = 2 * num_turns + 1
    # Only a bounded head of each conversation is folded, so the window below
    # sees at most `limit` rows per key no matter how long a dialogue is.
    head = (
        turns.filter(F.col("pos") < limit)
        .join(flagged_conversations(turns, tokens), "conv_id", "left_anti")
        .withColumn("r", role_code())
    )
    w = Window.partitionBy("conv_id").orderBy("pos")
    piece = (
        F.when(F.col("r") == "h", F.concat(F.col("text"), F.lit(T.ASSISTANT_SUFFIX)))
        .when(F.col("r") == "g", F.concat(F.col("text"), F.lit("\n\nHuman: ")))
        .otherwise(F.lit(""))
    )
    folded = head.select(
        "conv_id", "pos", "ord", "r", "text",
        F.first(F.when(F.col("r") != "o", F.col("r")), ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_r"),
        F.array_join(F.collect_list(piece).over(w.rowsBetween(Window.unboundedPreceding, -1)), "").alias("acc"),
    )
    return folded.filter((F.col("r") == "g") & (F.col("first_r") == "h")).select(
        F.concat(F.lit(T.HUMAN_PREFIX), F.col("acc")).alias("prompt"),
        F.col("text").alias("target"),
        "ord",
    )


def last_wins(rows: DataFrame, key: str = "prompt", value: str = "target", order: str = "ord",
              value_out: str = "sft_target") -> DataFrame:
    """A2: keyed overwrite - the value of the last row wins, the key keeps the
    position of its first row (dict insertion order). Both aggregates combine
    map-side, so a hot key is pre-aggregated before the shuffle."""
    return rows.groupBy(key).agg(
        F.max_by(F.col(value), F.col(order)).alias(value_out),
        F.min(order).alias("first_ord"),
    )


def split_prompts(records: DataFrame, split: str, test_n: int = 256) -> DataFrame:
    """W2: 'test' is the first ``test_n`` prompts in insertion order; 'train' and
    any other split name are all prompts (test overlaps train by design)."""
    if split == "test":
        return ordinals.first_n(records, "first_ord", test_n)
    return records


def sharegpt_sft(turns: DataFrame, split: str = "train", num_turns: int = 2, data_fraction: float = 1.0,
                 test_n: int = 256) -> DataFrame:
    """``(prompt, sft_target, first_ord)``."""
    rows = sharegpt_sft_rows(turns, num_turns=num_turns, data_fraction=data_fraction)
    return split_prompts(last_wins(rows), split, test_n)


def ultrachat_first_turn(turns: DataFrame) -> DataFrame:
    """S11 (+F6): conversations whose first two entries are user then assistant
    give one SFT row; last wins per prompt; no test cut."""
    head = turns.filter(F.col("pos") < 2).withColumn("r", role_code())
    firsts = head.groupBy("conv_id").agg(
        F.max(F.when(F.col("pos") == 0, F.col("r"))).alias("r0"),
        F.max(F.when(F.col("pos") == 1, F.col("r"))).alias("r1"),
        F.max(F.when(F.col("pos") == 0, F.col("text"))).alias("t0"),
        F.max(F.when(F.col("pos") == 1, F.col("text"))).alias("t1"),
        F.max(F.when(F.col("pos") == 1, F.col("ord"))).alias("ord"),
    )
    rows = firsts.filter((F.col("r0") == "h") & (F.col("r1") == "g")).select(
        T.single_turn_prompt("t0").alias("prompt"), F.col("t1").alias("target"), "ord"
    )
    return last_wins(rows)
