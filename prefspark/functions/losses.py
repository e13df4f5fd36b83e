"""Preference losses, rewards and metrics (M1-M14, A6-A10) as Column
expressions over log-prob tables. Everything is computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def logsigmoid(x) -> Column:
    """Stable ``log(sigmoid(x)) = -(max(-x, 0) + log1p(exp(-|x|)))``."""
    x = _c(x)
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def dpo_logits(pc="pc", pr="pr", rc="rc", rr="rr", reference_free: bool = False) -> Column:
    """M1: ``(pc - pr) - (rc - rr)``; ``reference_free`` drops the reference term."""
    pi = _c(pc) - _c(pr)
    return pi if reference_free else pi - (_c(rc) - _c(rr))


def preference_loss(beta: float, pc="pc", pr="pr", rc="rc", rr="rr", reference_free: bool = False,
                    ipo: bool = False, robust_eps: float = 0.0, importance_correction: bool = False,
                    sft_reg: float = 0.0) -> Column:
    """M2-M6 (G5: the variant is chosen by keyword options).

    IPO takes precedence; otherwise the robust loss when ``robust_eps > 0``
    (divided by beta, as in the reference) or plain DPO; the importance weight
    ``exp(pr - rr)`` multiplies non-IPO losses; ``sft_reg > 0`` subtracts
    ``sft_reg * pc``."""
    logits = dpo_logits(pc, pr, rc, rr, reference_free)
    if ipo:
        loss = F.pow(logits - F.lit(1.0 / (2 * beta)), 2)
    else:
        if robust_eps > 0.0:
            loss = (-logsigmoid(beta * logits) * (1.0 - robust_eps) - logsigmoid(-beta * logits) * robust_eps) / beta
        else:
            loss = -logsigmoid(beta * logits)
        if importance_correction:
            loss = loss * F.exp(_c(pr) - _c(rr))
    if sft_reg > 0.0:
        loss = loss - F.lit(sft_reg) * _c(pc)
    return loss


def rewards(beta: float, pc="pc", pr="pr", rc="rc", rr="rr") -> tuple[Column, Column]:
    """M7: implicit rewards (unaffected by ``reference_free``)."""
    return F.lit(beta) * (_c(pc) - _c(rc)), F.lit(beta) * (_c(pr) - _c(rr))


def dpo_metric_columns(beta: float, split: str = "train", **loss_kw) -> dict[str, Column]:
    """M7, M8, A10: the per-example metric bag of a DPO step, named as the
    reference logs them (``rewards_<split>/...``, ``loss/<split>``)."""
    chosen, rejected = rewards(beta)
    r, lp = f"rewards_{split}", f"logps_{split}"
    return {
        f"{r}/chosen": chosen,
        f"{r}/chosen_logprob_ratio": chosen / beta,
        f"{r}/rejected": rejected,
        f"{r}/rejected_logprob_ratio": rejected / beta,
        f"{r}/accuracies": (chosen > rejected).cast("double"),
        f"{r}/margins": chosen - rejected,
        f"{r}/beta_normalized_margin": (chosen - rejected) / beta,
        f"{lp}/chosen": F.col("pc"),
        f"{lp}/rejected": F.col("pr"),
        f"{lp}/reference_chosen": F.col("rc"),
        f"{lp}/reference_rejected": F.col("rr"),
        f"importance_weights_{split}/rejected": F.exp(F.col("pr") - F.col("rr")),
        f"loss/{split}": preference_loss(beta, **loss_kw),
    }


def metric_bag(df: DataFrame, metrics: dict[str, Column], keys=("step", "example_id")) -> DataFrame:
    """Long ``(keys..., metric, value)`` table via ``stack`` (no shuffle)."""
    pairs = []
    for name, col in metrics.items():
        pairs += [F.lit(name), col.cast("double")]
    n = len(metrics)
    stacked = F.inline(F.array(*[F.struct(pairs[2 * i].alias("metric"), pairs[2 * i + 1].alias("value"))
                                  for i in range(n)]))
    return df.select(*keys, stacked)


def mean_metrics(bag: DataFrame, keys=("step",)) -> DataFrame:
    """A7 (+A8): mean of every metric over examples; metrics whose name contains
    ``ppl`` are reported as ``exp(-mean)``."""
    agg = bag.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))
    return agg.withColumn("value", F.when(F.col("metric").contains("ppl"), F.exp(-F.col("value")))
                          .otherwise(F.col("value")))


def mean_of_metrics(df: DataFrame, metrics: dict[str, Column], keys=("step",)) -> DataFrame:
    """``mean_metrics`` of metrics that are columns: one row per key with all means,
    and only these rows are turned into (keys..., metric, value)."""
    means = df.groupBy(*keys).agg(*[F.avg(c.cast("double")).alias(f"_{k}") for k, c in enumerate(metrics.values())])
    bag = metric_bag(means, {name: F.exp(-F.col(f"_{k}")) if "ppl" in name else F.col(f"_{k}") for k, name in enumerate(metrics)}, keys)
    return bag.select(*keys, "metric", "value")


def sequence_logps(tokens: DataFrame, keys=("example_id",)) -> DataFrame:
    """A6/M9 over long token rows ``(example_id, pos, logp, label)``: the label
    sequence is shifted by one (position 0 never counts) and -100 is masked.
    Returns the sum, the mean (null when every token is masked, where the
    reference yields NaN) and the counts before and after the shift."""
    counted = (F.col("label") != -100) & (F.col("pos") >= 1)
    return tokens.groupBy(*keys).agg(
        F.sum(F.when(counted, F.col("logp")).otherwise(F.lit(0.0))).alias("logp_sum"),
        F.count_if(counted).cast("bigint").alias("n_tokens"),
        F.count_if(F.col("label") != -100).cast("bigint").alias("n_unmasked"),
    ).withColumn("logp_mean", F.try_divide(F.col("logp_sum"), F.col("n_tokens")))


def perplexity_macro(seq: DataFrame, keys=("step",)) -> DataFrame:
    """``exp(-mean over examples of the per-example mean log-prob)``."""
    return seq.groupBy(*keys).agg(F.exp(-F.avg("logp_mean")).alias("ppl_macro"))


def perplexity_micro(seq: DataFrame, keys=("step",)) -> DataFrame:
    """``exp(-sum logp / unmasked tokens)``; the denominator counts labels
    before the one-token shift, the numerator after it."""
    return seq.groupBy(*keys).agg(
        F.exp(-F.try_divide(F.sum("logp_sum"), F.sum("n_unmasked"))).alias("ppl_micro"))


def reward_model_metrics(chosen="chosen", rejected="rejected") -> dict[str, Column]:
    """Pairwise reward-model loss and accuracy (ties count as wrong)."""
    return {
        "loss": -logsigmoid(_c(chosen) - _c(rejected)),
        "accuracy": (_c(chosen) > _c(rejected)).cast("double"),
    }


def throughput(batch_size: int, step_seconds="step_seconds") -> dict[str, Column]:
    """Examples per second and seconds per example (null on a zero time)."""
    return {
        "examples_per_second": F.try_divide(F.lit(float(batch_size)), _c(step_seconds)),
        "seconds_per_example": F.try_divide(_c(step_seconds), F.lit(float(batch_size))),
    }
