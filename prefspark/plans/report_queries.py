"""Report queries: A12-A15, S15, J5, U4, F10, T11, T12, O6."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import reports
from prefspark.plans.registry import register
from prefspark.sources import io
from prefspark.sources.fixtures import view

CHECKPOINTS = ("e0", "e1", "e2")
FRACTIONS = (0, 5, 10, 25, 50, 100)

_RATE_SQL = """round(100 * avg(outcome), 6) as win_rate,
           round(100 * stddev_samp(outcome) / sqrt(count(outcome)), 6) as std_err,
           cast(count(outcome) as bigint) as n,
           cast(count_if(outcome = 1.0) as bigint) as wins, cast(count_if(outcome = 0.5) as bigint) as ties"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("win_rate", "std_err", "gain", "delta") else c
                       for c in df.columns])


@register("win_rates", "A12 D15", views=("v_battles",), sql=f"""
    select generator, evaluator, {_RATE_SQL} from v_battles group by generator, evaluator""")
def win_rates(spark, sf_dir):
    return _rounded(reports.win_rates(view(spark, sf_dir, "v_battles")))


# Run naming of the scaling runs: 'llama7b_<generator>_e<checkpoint>'.
def _runs(spark, sf_dir):
    b = view(spark, sf_dir, "v_battles")
    ck = (F.col("event_id") % 3).cast("string")
    return b.withColumn("name", F.concat(F.lit("llama7b_"), "generator", F.lit("_e"), ck))


_RUNS_SQL = """runs as (select *, 'llama7b_' || generator || '_e' || cast(event_id % 3 as varchar) as name
                       from v_battles)"""


@register("winrate_pivot", "A13 T11", views=("v_battles",), sql=f"""
    with {_RUNS_SQL},
    r as (select name, evaluator, 100 * avg(outcome) as win_rate from runs group by name, evaluator),
    m as (select substr(name, 9, length(name) - 11) as model, evaluator,
                 regexp_extract(name, '_(e[0-9])$', 1) as checkpoint, win_rate from r)
    select model, evaluator,
           round(max(case when checkpoint = 'e0' then win_rate end), 6) as e0,
           round(max(case when checkpoint = 'e1' then win_rate end), 6) as e1,
           round(max(case when checkpoint = 'e2' then win_rate end), 6) as e2
    from m group by model, evaluator""")
def winrate_pivot(spark, sf_dir):
    rates = reports.win_rates(_runs(spark, sf_dir), ["name", "evaluator"])
    m = rates.select(reports.model_of_run("name").alias("model"), "evaluator",
                     F.regexp_extract("name", r"_(e[0-9])$", 1).alias("checkpoint"), "win_rate")
    p = reports.checkpoint_pivot(m, CHECKPOINTS)
    return p.select("model", "evaluator", *[F.round(c, 6).alias(c) for c in CHECKPOINTS])


_METHOD_SQL = """case cast(floor(user_id / 4) as bigint) % 3 when 0 then 'sft100' when 1 then 'sft10'
                      else 'sft10+pref' end"""


@register("method_deltas", "A14", views=("v_battles",), sql=f"""
    with r as (select 'model' || cast(user_id % 4 as varchar) as model, evaluator, {_METHOD_SQL} as method,
                      100 * avg(outcome) as win_rate
               from v_battles group by 1, 2, 3)
    select model, evaluator,
           round(max(case when method = 'sft10' then win_rate end), 6) as base_rate,
           round(max(case when method = 'sft10+pref' then win_rate end), 6) as tuned_rate,
           round(max(case when method = 'sft10+pref' then win_rate end)
                 - max(case when method = 'sft10' then win_rate end), 6) as delta
    from r group by model, evaluator""")
def method_deltas(spark, sf_dir):
    """Gain of preference tuning over SFT on 10% per model (method and model
    are read from the battle's user id)."""
    b = view(spark, sf_dir, "v_battles").withColumn(
        "model", F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string"))
    ).withColumn("method", F.expr(_METHOD_SQL))
    rates = reports.win_rates(b, ["model", "evaluator", "method"])
    d = reports.method_deltas(rates, "sft10", "sft10+pref")
    return d.select("model", "evaluator", F.round(F.col("`sft10`"), 6).alias("base_rate"),
                    F.round(F.col("`sft10+pref`"), 6).alias("tuned_rate"), F.round("delta", 6).alias("delta"))


_FRACTION_SQL = "case user_id % 6 " + " ".join(f"when {i} then {f}" for i, f in enumerate(FRACTIONS)) + " end"


@register("scaling_curve", "A15 A12", views=("v_battles",), sql=f"""
    with r as (select cast({_FRACTION_SQL} as bigint) as fraction, evaluator, {_RATE_SQL}
               from v_battles group by 1, evaluator)
    select *, round(win_rate - lag(win_rate) over (partition by evaluator order by fraction), 6) as gain from r""")
def scaling_curve(spark, sf_dir):
    b = view(spark, sf_dir, "v_battles").withColumn("fraction", F.expr(_FRACTION_SQL).cast("bigint"))
    rates = _rounded(reports.win_rates(b, ["fraction", "evaluator"]))
    return _rounded(reports.scaling_curve(rates))


_RUN_DIR = ("case when generator in ('m0', 'm1') then 'final_ds_' else 'DS_' end || generator"
            " || '_maxlen512_temp0.7/epoch-' || cast(3 * (event_id % 3 + 1) as varchar)")


@register("leaderboard_scan", "S15 J5 F10 O6 D14",views=("v_battles",), sql=f"""
    with {_RUNS_SQL},
    d as (select *, {_RUN_DIR} as run_dir from runs)
    select run_dir, name, evaluator, round(100 * avg(outcome), 6) as win_rate
    from d
    where not (contains(run_dir, 'DS_') and (contains(run_dir, 'c2') or contains(run_dir, 'epoch-9')
                                             or contains(run_dir, 'epoch-12')))
    group by run_dir, name, evaluator""")
def leaderboard_scan(spark, sf_dir):
    """Evaluation outputs written per run directory (a name file and one
    leaderboard per evaluator, with a reference row that must not match), then
    scanned back: excluded runs skipped (F10), rows looked up by run name (J5)."""
    runs = _runs(spark, sf_dir).withColumn("run_dir", F.expr(_RUN_DIR.replace("varchar", "string")))
    rates = reports.win_rates(runs, ["run_dir", "name", "evaluator"])
    root = io.scratch_path(spark, "evals")
    runs.select("run_dir", F.col("name").alias("value")).distinct().write.partitionBy("run_dir").text(f"{root}/names")
    board_rows = rates.select("run_dir", "evaluator", F.col("name").alias("c0"),
                              F.round("win_rate", 6).cast("string").alias("c1")).unionByName(
        rates.select("run_dir", "evaluator").distinct().select(
            "run_dir", "evaluator", F.lit("gpt4_reference").alias("c0"), F.lit("50.0").alias("c1")))
    board_rows.write.partitionBy("run_dir", "evaluator").csv(f"{root}/boards")
    # The table is also saved as Parquet and the report reads that copy.
    boards = (spark.read.schema("c0 string, c1 string, run_dir string, evaluator string").csv(f"{root}/boards")
              .withColumn("line_no", F.monotonically_increasing_id()))
    names = (spark.read.schema("value string, run_dir string").text(f"{root}/names")
             .withColumn("line_no", F.monotonically_increasing_id())
             .groupBy("run_dir").agg(F.min_by("value", "line_no").alias("name")))
    kept_names = names.filter(~reports.excluded_run("run_dir"))
    found = reports.lookup_scores(boards, kept_names)
    saved = io.save_table(found, f"{root}/winrates")
    out = spark.read.parquet(saved)
    return out.select("run_dir", "name", "evaluator", F.round("win_rate", 6).alias("win_rate"))


@register("winrate_merge", "U4 O6", views=("v_battles",), sql="""
    with old as (select generator, evaluator, round(100 * avg(case when outcome = 0.5 then 0.0 else outcome end), 6)
                      as win_rate from v_battles group by generator, evaluator),
    new as (select generator, evaluator, round(100 * avg(outcome), 6) as win_rate
            from v_battles where evaluator = 'j0' group by generator, evaluator)
    select o.generator, o.evaluator, coalesce(n.win_rate, o.win_rate) as win_rate
    from old o left join new n on o.generator = n.generator and o.evaluator = n.evaluator""")
def winrate_merge(spark, sf_dir):
    """U4: a saved win-rate table (ties scored as losses, written as Parquet by
    O6) updated by a newer table for judge j0; the newer row wins."""
    b = view(spark, sf_dir, "v_battles")
    old = b.withColumn("outcome", F.when(F.col("outcome") == 0.5, F.lit(0.0)).otherwise(F.col("outcome")))
    old_rates = reports.win_rates(old).select("generator", "evaluator", F.round("win_rate", 6).alias("win_rate"))
    path = io.save_table(old_rates, io.scratch_path(spark, "winrate_old"))
    new_rates = reports.win_rates(b.filter(F.col("evaluator") == "j0")).select(
        "generator", "evaluator", F.round("win_rate", 6).alias("win_rate"))
    return reports.merge_right_wins(spark.read.parquet(path), new_rates, ["generator", "evaluator"])
