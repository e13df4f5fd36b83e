"""Loss and metric queries: M1-M14, A6-A10, J6, J8, O5, G5."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import losses as L
from prefspark.plans.registry import register
from prefspark.sources import io
from prefspark.sources.fixtures import table, view

BETA = 0.1
EPS = 0.1
SFT_REG = 0.5
BATCH = 8


def _lsig(x: str) -> str:
    return f"(-(greatest(-({x}), 0.0) + ln(1 + exp(-abs({x})))))"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) as {name}"


def _policy_reference(spark, sf_dir):
    """The policy and the reference log-prob tables joined per example."""
    lp = view(spark, sf_dir, "v_logps")
    policy = lp.select("example_id", "step", "pc", "pr")
    reference = lp.select("example_id", "rc", "rr")
    return policy.join(reference, "example_id")


_LOGITS = "((pc - pr) - (rc - rr))"


@register("dpo_loss_variants", "M1 M2 M3 M4 M5 M6 J6 G5 D11",views=("v_logps",), sql=f"""
    select example_id,
      {_r(_LOGITS, 'logits')},
      {_r(f"-{_lsig(f'{BETA} * {_LOGITS}')}", 'loss_dpo')},
      {_r(f"-{_lsig(f'{BETA} * (pc - pr)')}", 'loss_reference_free')},
      {_r(f"power({_LOGITS} - {1 / (2 * BETA)}, 2)", 'loss_ipo')},
      {_r(f"(-{_lsig(f'{BETA} * {_LOGITS}')} * {1 - EPS} - {_lsig(f'-{BETA} * {_LOGITS}')} * {EPS}) / {BETA}",
          'loss_robust')},
      {_r(f"-{_lsig(f'{BETA} * {_LOGITS}')} * exp(pr - rr)", 'loss_importance')},
      {_r(f"-{_lsig(f'{BETA} * {_LOGITS}')} - {SFT_REG} * pc", 'loss_sft_reg')}
    from v_logps""")
def dpo_loss_variants(spark, sf_dir):
    df = _policy_reference(spark, sf_dir)
    cols = {
        "logits": L.dpo_logits(),
        "loss_dpo": L.preference_loss(BETA),
        "loss_reference_free": L.preference_loss(BETA, reference_free=True),
        "loss_ipo": L.preference_loss(BETA, ipo=True, robust_eps=EPS, importance_correction=True),
        "loss_robust": L.preference_loss(BETA, robust_eps=EPS),
        "loss_importance": L.preference_loss(BETA, importance_correction=True),
        "loss_sft_reg": L.preference_loss(BETA, sft_reg=SFT_REG),
    }
    return df.select("example_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


def _metric_sql() -> str:
    ch, rj = f"({BETA} * (pc - rc))", f"({BETA} * (pr - rr))"
    items = [
        ("rewards_train/chosen", ch), ("rewards_train/chosen_logprob_ratio", f"{ch} / {BETA}"),
        ("rewards_train/rejected", rj), ("rewards_train/rejected_logprob_ratio", f"{rj} / {BETA}"),
        ("rewards_train/accuracies", f"case when {ch} > {rj} then 1.0 else 0.0 end"),
        ("rewards_train/margins", f"{ch} - {rj}"),
        ("rewards_train/beta_normalized_margin", f"({ch} - {rj}) / {BETA}"),
        ("logps_train/chosen", "pc"), ("logps_train/rejected", "pr"), ("logps_train/reference_chosen", "rc"),
        ("logps_train/reference_rejected", "rr"), ("importance_weights_train/rejected", "exp(pr - rr)"),
        ("loss/train", f"-{_lsig(f'{BETA} * {_LOGITS}')}"),
    ]
    union = "\n      union all ".join(f"select step, '{m}' as metric, cast({e} as double) as value from v_logps"
                                     for m, e in items)
    return f"""
    with bag as ({union})
    select step, metric, round(avg(value), 6) as value from bag group by step, metric"""


@register("dpo_metrics", "M7 M8 A7 A10 D13", views=("v_logps",), sql=_metric_sql())
def dpo_metrics(spark, sf_dir):
    df = _policy_reference(spark, sf_dir)
    return L.mean_of_metrics(df, L.dpo_metric_columns(BETA)).select("step", "metric", F.round("value", 6).alias("value"))


_SEQ_SQL = """seq as (select example_id, example_id % 4 as step,
                    sum(case when label <> -100 and pos >= 1 then logp else 0.0 end) as logp_sum,
                    count_if(label <> -100 and pos >= 1) as n_tokens,
                    count_if(label <> -100) as n_unmasked
             from v_token_logps group by example_id)"""


def _seq(spark, sf_dir):
    tok = view(spark, sf_dir, "v_token_logps")
    return L.sequence_logps(tok).withColumn("step", F.col("example_id") % 4)


@register("seq_logps", "A6 M9 D12", views=("v_token_logps",), sql=f"""
    with {_SEQ_SQL}
    select example_id, round(logp_sum, 6) as logp_sum, round(-logp_sum, 6) as sft_loss,
           round(case when n_tokens = 0 then null else logp_sum / n_tokens end, 6) as logp_mean,
           cast(n_tokens as bigint) as n_tokens
    from seq""")
def seq_logps(spark, sf_dir):
    s = _seq(spark, sf_dir)
    return s.select("example_id", F.round("logp_sum", 6).alias("logp_sum"), F.round(-F.col("logp_sum"), 6).alias("sft_loss"),
                    F.round("logp_mean", 6).alias("logp_mean"), "n_tokens")


@register("perplexity_macro", "A8", views=("v_token_logps",), sql=f"""
    with {_SEQ_SQL}
    select step, round(exp(-avg(case when n_tokens = 0 then null else logp_sum / n_tokens end)), 6) as ppl_macro
    from seq group by step""")
def perplexity_macro(spark, sf_dir):
    return L.perplexity_macro(_seq(spark, sf_dir)).select("step", F.round("ppl_macro", 6).alias("ppl_macro"))


@register("perplexity_micro", "A9", views=("v_token_logps",), sql=f"""
    with {_SEQ_SQL}
    select step, round(exp(-(sum(logp_sum) / sum(n_unmasked))), 6) as ppl_micro from seq group by step""")
def perplexity_micro(spark, sf_dir):
    return L.perplexity_micro(_seq(spark, sf_dir)).select("step", F.round("ppl_micro", 6).alias("ppl_micro"))


@register("rm_loss", "M10 A10 A7", views=("v_logps",), sql=f"""
    select step, round(avg(-{_lsig('pc - pr')}), 6) as loss,
           round(avg(case when pc > pr then 1.0 else 0.0 end), 6) as accuracy
    from v_logps group by step""")
def rm_loss(spark, sf_dir):
    lp = view(spark, sf_dir, "v_logps").select("step", F.col("pc").alias("chosen"), F.col("pr").alias("rejected"))
    m = L.reward_model_metrics()
    return lp.groupBy("step").agg(*[F.round(F.avg(c), 6).alias(n) for n, c in m.items()])


@register("throughput", "M14", sql=f"""
    select event_type,
           round(avg(case when value = 0 then null else {float(BATCH)} / value end), 6) as examples_per_second,
           round(avg(value / {float(BATCH)}), 6) as seconds_per_example,
           cast(count_if(value = 0) as bigint) as n_zero_time
    from events group by event_type""")
def throughput(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumnRenamed("value", "step_seconds")
    m = L.throughput(BATCH)
    return ev.groupBy("event_type").agg(
        *[F.round(F.avg(c), 6).alias(n) for n, c in m.items()],
        F.count_if(F.col("step_seconds") == 0).cast("bigint").alias("n_zero_time"),
    )


@register("eval_predictions", "O5 J8 A10", views=("v_logps",), sql=f"""
    select round(case when {BETA} * (pc - rc) > {BETA} * (pr - rr) then 1.0E0 else 0.0E0 end, 6) as acc,
           round(-{_lsig(f'{BETA} * {_LOGITS}')}, 6) as loss
    from v_logps""")
def eval_predictions(spark, sf_dir):
    """Per-example accuracies and losses zipped by example id, written as
    ``acc,loss`` lines (O5) and read back."""
    chosen, rejected = L.rewards(BETA)
    zipped = _policy_reference(spark, sf_dir).select(
        F.round((chosen > rejected).cast("double"), 6).alias("acc"), F.round(L.preference_loss(BETA), 6).alias("loss"))
    path = io.write_predictions(zipped, io.scratch_path(spark, "predictions"))
    back = spark.read.schema("acc double, loss double").csv(path)
    return back.select("acc", "loss")
