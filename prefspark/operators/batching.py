"""Training-example ordering and batching (W4-W9) and tokenised examples (K1-K8).

The reference walks a Python list epoch by epoch. Here the whole schedule is
one DataFrame of narrow rows (``operators.epochs``): epochs are a generator column, the
shuffle is a keyed permutation of the prompts' numbers, and batch ids, drop-last,
example budget and rank slices are arithmetic on positions. Texts are joined last.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import tokens as K
from prefspark.operators import epochs


def schedule(examples: DataFrame, seed: int = 0, shuffle: bool = True, order_col: str = "first_ord") -> epochs.Schedule:
    """W4+W5: the epochs over a table of examples. A prompt is a (dataset_ix,
    ``order_col``); its pairs stay adjacent, in the order of ``pair_ix`` (dense from 0). SFT
    rows have no pair_ix. Only these narrow columns are read and kept."""
    keys = [c for c in ("dataset_ix", order_col) if c in examples.columns]
    return epochs.Schedule(examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs")), keys, seed, shuffle)


def epoch_order(examples: DataFrame, n_epochs: int, seed: int = 0, shuffle: bool = True, order_col: str = "first_ord",
                plan: epochs.Schedule | None = None) -> DataFrame:
    """W4+W5: the examples with ``epoch`` and ``rn`` (1-based position inside the epoch).
    Without shuffle the datasets follow one another in the mixture's list order
    (``dataset_ix``), each in insertion order (``order_col``, then pair_ix).

    The positions are narrow rows; the examples are joined to them once, after whatever
    is filtered by position (Catalyst moves such filters below the join)."""
    plan = plan or schedule(examples, seed, shuffle, order_col)
    places = plan.drawn(n_epochs).select("epoch", "rn", *[F.col(c).alias(f"_{c}") for c in plan.keys], F.col("pair").alias("_pair"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in plan.keys]
    if "pair_ix" in examples.columns:
        same.append(F.col("pair_ix") == F.col("_pair"))
    return examples.join(places, same).drop("_pair", *[f"_{c}" for c in plan.keys])


def assign_batches(ordered: DataFrame, batch_size: int, n_per_epoch: int) -> DataFrame:
    """``batch_id = floor((rn-1)/b)`` inside an epoch; the partial last batch
    of every epoch is dropped."""
    full = (n_per_epoch // batch_size) * batch_size
    return ordered.filter(F.col("rn") <= full).withColumn(
        "batch_id", F.floor((F.col("rn") - 1) / batch_size).cast("bigint")
    ).withColumn("pos_in_batch", ((F.col("rn") - 1) % batch_size).cast("bigint"))


def budget_stop(n_per_epoch: int, batch_size: int, n_examples: int) -> tuple[int, int]:
    """(epochs needed, examples counted when the last batch is yielded).
    Counting includes the dropped partial batches of earlier epochs, so after
    batch k of epoch e the count is ``e*N + (k+1)*b``; the reference stops right
    after the first batch whose count reaches ``n_examples``."""
    full_batches = n_per_epoch // batch_size
    if full_batches == 0:
        raise ValueError("fewer examples than one batch: the reference would never yield a batch")
    e = 0
    while e * n_per_epoch + full_batches * batch_size < n_examples:
        e += 1
    k = max(0, math.ceil((n_examples - e * n_per_epoch) / batch_size) - 1)
    return e + 1, e * n_per_epoch + (k + 1) * batch_size


def budget_schedule(examples: DataFrame, batch_size: int, n_examples: int, seed: int = 0,
                    shuffle: bool = True, n_epochs: int | None = None, plan: epochs.Schedule | None = None) -> DataFrame:
    """The batches that are yielded when stopping by example count, or after
    ``n_epochs`` epochs when these end first."""
    plan = plan or schedule(examples, seed, shuffle)
    n = plan.n
    needed, stop = budget_stop(n, batch_size, n_examples)
    needed = needed if n_epochs is None else min(needed, n_epochs)
    batched = assign_batches(epoch_order(examples, needed, plan=plan), batch_size, n)
    count_after = F.col("epoch") * F.lit(n) + (F.col("batch_id") + 1) * F.lit(batch_size)
    return batched.filter(count_after <= F.lit(stop))


def shard_slices(batched: DataFrame, world: int, batch_size: int) -> DataFrame:
    """Each batch split into ``world`` chunks of ``floor(b/world)``; the
    remainder is dropped."""
    chunk = batch_size // world
    if chunk == 0:
        return batched.limit(0).withColumn("shard", F.lit(0).cast("bigint"))
    return batched.withColumn("shard", F.floor(F.col("pos_in_batch") / chunk).cast("bigint")).filter(
        F.col("shard") < world
    )


# --------------------------------------------------------------------- tokens
def tokenize_examples(pairs: DataFrame, max_length: int, max_prompt_length: int, tokenize=K.default_tokenize,
                      eos_id: int = K.EOS_ID, sft_mode: bool = False, mode_col: str = "truncation_mode") -> DataFrame:
    """K1-K5: tokenise prompt/chosen/rejected (EOS appended to responses),
    truncate the prompt by the row's truncation mode when too long, then the
    responses to ``max_length - max_prompt_length``; build input ids, attention
    masks and labels. In SFT mode ``sft_target`` is used for chosen and the
    rejected columns are dropped. Rows whose text already tokenises to EOS are
    not dropped here; use ``eos_violations`` for the reference's assertion."""
    chosen_text = F.col("sft_target") if sft_mode else F.col("chosen")
    rejected_text = F.col("sft_target") if sft_mode else F.col("rejected")
    p = tokenize(F.col("prompt"))
    df = pairs.withColumn("_p", p).withColumn("_c", K.with_eos(tokenize(chosen_text), eos_id)).withColumn(
        "_r", K.with_eos(tokenize(rejected_text), eos_id)
    )
    longer = F.greatest(F.size("_c"), F.size("_r"))
    mode = F.col(mode_col)
    trunc_p = (
        F.when(F.size("_p") + longer <= max_length, F.col("_p"))
        .when(mode == "keep_start", K.take_first("_p", max_prompt_length))
        .when(mode == "keep_end", K.take_last("_p", max_prompt_length))
        .otherwise(F.raise_error(F.concat(F.lit("Unknown truncation mode: "), mode)).cast("array<bigint>"))
    )
    df = df.withColumn("_p", trunc_p)
    still = F.size("_p") + longer > max_length
    resp_n = max_length - max_prompt_length
    df = df.select(
        "*",
        F.when(still, F.slice("_c", 1, resp_n)).otherwise(F.col("_c")).alias("_c2"),
        F.when(still, F.slice("_r", 1, resp_n)).otherwise(F.col("_r")).alias("_r2"),
    ).drop("_c", "_r").withColumnRenamed("_c2", "_c").withColumnRenamed("_r2", "_r")
    out = df.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected")],
        F.concat(F.col("prompt"), chosen_text).alias("chosen"),
        F.concat(F.col("prompt"), rejected_text).alias("rejected"),
        chosen_text.alias("chosen_response_only"),
        rejected_text.alias("rejected_response_only"),
        F.col("_p").alias("prompt_input_ids"),
        K.ones_like("_p").alias("prompt_attention_mask"),
        F.concat("_p", "_c").alias("chosen_input_ids"),
        K.ones_like(F.concat("_p", "_c")).alias("chosen_attention_mask"),
        K.label_mask("_p", "_c").alias("chosen_labels"),
        F.concat("_p", "_r").alias("rejected_input_ids"),
        K.ones_like(F.concat("_p", "_r")).alias("rejected_attention_mask"),
        K.label_mask("_p", "_r").alias("rejected_labels"),
    )
    if sft_mode:
        out = out.drop(*[c for c in out.columns if "rejected" in c])
    return out


def eos_violations(pairs: DataFrame, tokenize=K.default_tokenize, eos_id: int = K.EOS_ID) -> DataFrame:
    """rows whose prompt or responses tokenise to a sequence containing EOS
    (the reference asserts); a quarantine table instead of a job failure."""
    has = lambda c: F.array_contains(tokenize(F.col(c)), F.lit(eos_id).cast("bigint"))
    return pairs.filter(has("prompt") | has("chosen") | has("rejected"))


def collate(batched: DataFrame, pad_id: int = K.PAD_ID, batch_cols=("epoch", "batch_id")) -> DataFrame:
    """K6: pad every id/mask/label column to its batch maximum; prompt columns
    are padded on the left, the others on the right; pad values pad_id / 0 /
    -100 by suffix. A batch holds ``batch_size`` rows, so the window is bounded."""
    w = Window.partitionBy(*batch_cols)
    out = batched
    for c in batched.columns:
        if not (c.endswith("_input_ids") or c.endswith("_attention_mask") or c.endswith("_labels")):
            continue
        value = pad_id if c.endswith("_input_ids") else (K.IGNORE if c.endswith("_labels") else 0)
        longest = F.max(F.size(c)).over(w)
        pad = K.pad_left if "prompt" in c else K.pad_right
        out = out.withColumn(c, pad(c, longest, value))
    return out


def concat_pad(collated: DataFrame, batch_cols=("epoch", "batch_id")) -> DataFrame:
    """K8+U3: chosen and rejected padded to their joint batch maximum (ids and
    masks with 0, labels with -100) and stacked, chosen block first."""
    w = Window.partitionBy(*batch_cols)
    longest = F.greatest(F.max(F.size("chosen_input_ids")).over(w), F.max(F.size("rejected_input_ids")).over(w))
    sides = []
    for side, rank in (("chosen", 0), ("rejected", 1)):
        sides.append(collated.select(
            *batch_cols, "pos_in_batch", F.lit(side).alias("side"), F.lit(rank).alias("side_rank"),
            K.pad_right(f"{side}_input_ids", longest, 0).alias("concatenated_input_ids"),
            K.pad_right(f"{side}_attention_mask", longest, 0).alias("concatenated_attention_mask"),
            K.pad_right(f"{side}_labels", longest, K.IGNORE).alias("concatenated_labels"),
        ))
    return sides[0].unionByName(sides[1])
