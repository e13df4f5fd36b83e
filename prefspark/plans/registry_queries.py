"""Every registered dataset built through the registry, counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.plans import dialogue_queries, record_queries  # noqa: F401  (oracles below reuse theirs)
from prefspark.plans.registry import QUERIES, register
from prefspark.sources import registry
from prefspark.sources.fixtures import view, with_views

# dataset -> (oracle of its SFT rows, oracle of its pair rows); None = no pairs
_PARTS = {
    "shp": ("shp_sft_target", "shp_pairs", None),
    "hh": ("hh_sft_target", "hh_pairs", None),
    "se": ("se_sft_target", None, None),
    "wiki": ("wikitext_split", None, "train"),
    "sharegpt": ("aiprefs_pairs", "aiprefs_pairs", None),
    "ultrachat": ("ultrachat_first_turn", None, None),
    "ultrafeedback": ("ultrafeedback_pairs", "ultrafeedback_pairs", None),
    "ultrafeedbacknarrow": ("ultrafeedback_narrow_routing", "ultrafeedback_narrow_routing", "train"),
    "alpaca_eval": ("alpaca_prompts", None, None),
    "shareclaude": ("maps:teacher", None, None),
    "sharegpt4": ("maps:student", None, None),
}

# Completion-map datasets read the teacher / student completions of
# v_completions as map rows (file = model, position = ord).
_MAP_MODELS = {"shareclaude": "teacher", "sharegpt4": "student"}


def _maps_count_sql(model: str) -> str:
    return "(" + with_views(["v_completions"], f"""
        select cast(count(distinct instruction) as bigint) from v_completions where model = '{model}'""") + ")"


def _completion_maps(spark, sf_dir, model):
    v = view(spark, sf_dir, "v_completions").filter(F.col("model") == model)
    return v.select(F.col("model").alias("file"), F.col("ord").alias("pos"), F.col("instruction").alias("prompt"),
                    F.array("output").alias("completions"))


# The SE train split drops the first 1% of question rows by seeded md5 rank (W3);
# its SFT rows are the distinct questions left.
_SE_TRAIN_SQL = "(" + with_views(["v_answers"], """
    select cast(count(distinct question) as bigint) from v_answers where q_ord in (
      select q_ord from (
        select q_ord, row_number() over (order by substr(md5(concat_ws(chr(1), '42', cast(q_ord as varchar))), 1, 15),
                                          q_ord) as rn,
               count(*) over () as n
        from (select distinct q_ord from v_answers) q) z
      where rn > cast(floor(n * 0.01E0) as bigint))""") + ")"


def _count(name, split):
    if name is None:
        return "cast(0 as bigint)"
    if name == "se_sft_target":
        return _SE_TRAIN_SQL
    if name.startswith("maps:"):
        return _maps_count_sql(name.split(":", 1)[1])
    where = f" where split = '{split}'" if split else ""
    return f"(select cast(count(*) as bigint) from ({QUERIES[name].oracle}) z{where})"


_SQL = "\nunion all\n".join(
    f"select '{ds}' as dataset, {_count(s, split)} as n_sft, {_count(p, split)} as n_pairs"
    for ds, (s, p, split) in _PARTS.items())


@register("dataset_registry", "S14 G6 U1 S5 S6 W3", sql=_SQL)
def dataset_registry(spark, sf_dir):
    """Each dataset name goes through ``get_dataset`` (train split) and its
    record tables are counted; conformed schemas are part of the build."""
    ann = view(spark, sf_dir, "v_annotations")
    sft_parts, pair_parts = [], []
    for name in _PARTS:
        extra = {"maps": _completion_maps(spark, sf_dir, _MAP_MODELS[name])} if name in _MAP_MODELS else {}
        ds = registry.get_dataset(spark, sf_dir, name, "train", prefs=ann if name == "sharegpt" else None, **extra)
        sft_parts.append(ds.sft.select(F.lit(name).alias("dataset")))
        if ds.has_pairs:
            pair_parts.append(ds.pairs.select(F.lit(name).alias("dataset")))
    names = spark.createDataFrame([(n,) for n in _PARTS], ["dataset"])
    sft = sft_parts[0]
    for p in sft_parts[1:]:
        sft = sft.unionByName(p)
    pairs = pair_parts[0]
    for p in pair_parts[1:]:
        pairs = pairs.unionByName(p)
    n_sft = sft.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_sft"))
    n_pairs = pairs.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_pairs"))
    return (names.join(n_sft, "dataset", "left").join(n_pairs, "dataset", "left")
            .select("dataset", F.coalesce("n_sft", F.lit(0)).cast("bigint").alias("n_sft"),
                    F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs")))
