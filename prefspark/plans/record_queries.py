"""Record-source queries: S1-S3, S7-S9, S12, S13, S14 and the U1 mixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.plans.registry import register
from prefspark.sources import records, registry
from prefspark.sources.fixtures import table, view

NN = "chr(10) || chr(10)"
TPL_OPEN = "'Human: ' || "
TPL_CLOSE = f" || {NN} || 'Assistant: '"


def _flag(cols, tokens):
    return "(" + " or ".join(f"contains({c}, '{t}')" for c in cols for t in tokens) + ")"


FLAG3 = ("<s>", "</s>", "<|endoftext|>")
FLAG2 = ("<s>", "</s>")

# ------------------------------------------------------------------ S1
_SE_LATEST = """latest as (select question, max(q_ord) as q_ord from v_answers group by question),
    a as (select v.* from v_answers v join latest l on v.question = l.question and v.q_ord = l.q_ord)"""


@register("se_pairs", "S1 J7 A3 D5 T3",views=("v_answers",), sql=f"""
    with {_SE_LATEST},
    x as (select question, pos, ' ' || answer as response, pm_score as score,
                 count(*) over (partition by question) as n,
                 rank() over (partition by question order by pm_score) as rk,
                 row_number() over (partition by question, pm_score order by pos) as eq
          from a)
    select {NN} || 'Human: ' || question || {NN} || 'Assistant:' as prompt, pos, response, score,
           cast(rk + eq - 2 as bigint) as wins, cast(n - rk + 1 - eq as bigint) as losses
    from x""")
def se_pairs(spark, sf_dir):
    return records.se_pair_tally(view(spark, sf_dir, "v_answers"))


@register("se_sft_target", "S1 A3 A2", views=("v_answers",), sql=f"""
    with {_SE_LATEST},
    t as (select question, q_ord, ' ' || answer as response, min_by(pm_score, pos) as eff, min(pos) as first_pos
          from a group by question, q_ord, ' ' || answer),
    r as (select *, row_number() over (partition by question order by eff desc, first_pos) as rn from t)
    select {NN} || 'Human: ' || question || {NN} || 'Assistant:' as prompt, response as sft_target,
           q_ord as first_ord
    from r where rn = 1""")
def se_sft_target(spark, sf_dir):
    return records.se_sft_target(view(spark, sf_dir, "v_answers"))


# ------------------------------------------------------------------ S2
_SHP_KEPT = f"""k as (select *, {NN} || 'Human: ' || history || {NN} || 'Assistant:' as prompt,
                     row_number() over (partition by {NN} || 'Human: ' || history || {NN} || 'Assistant:'
                                        order by ord) - 1 as pair_ix
              from v_shp
              where coalesce(greatest(cast(score_a as double) / nullif(score_b, 0),
                                      cast(score_b as double) / nullif(score_a, 0)) >= 2, false))"""


@register("shp_pairs", "S2 F4 A1 M11", views=("v_shp",), sql=f"""
    with {_SHP_KEPT}
    select prompt, cast(pair_ix as bigint) as pair_ix,
           cast(case when labels = 1 then 2 * pair_ix else 2 * pair_ix + 1 end as bigint) as chosen_ix,
           cast(case when labels = 1 then 2 * pair_ix + 1 else 2 * pair_ix end as bigint) as rejected_ix,
           case when labels = 1 then ' ' || human_ref_a else ' ' || human_ref_b end as chosen,
           case when labels = 1 then ' ' || human_ref_b else ' ' || human_ref_a end as rejected
    from k""")
def shp_pairs(spark, sf_dir):
    return records.shp_pairs(view(spark, sf_dir, "v_shp")).select(
        "prompt", F.col("pair_ix").cast("bigint").alias("pair_ix"),
        F.col("chosen_ix").cast("bigint").alias("chosen_ix"),
        F.col("rejected_ix").cast("bigint").alias("rejected_ix"), "chosen", "rejected")


@register("shp_sft_target", "S2 A1 A3", views=("v_shp",), sql=f"""
    with {_SHP_KEPT},
    r as (select prompt, ord, 2 * pair_ix as idx, ' ' || human_ref_a as response, score_a as score from k
          union all
          select prompt, ord, 2 * pair_ix + 1, ' ' || human_ref_b, score_b from k),
    t as (select prompt, response, min_by(score, idx) as eff, min(idx) as first_idx from r group by prompt, response),
    b as (select prompt, response, row_number() over (partition by prompt order by eff desc, first_idx) as rn from t)
    select b.prompt, b.response as sft_target, f.first_ord
    from b join (select prompt, min(ord) as first_ord from k group by prompt) f on b.prompt = f.prompt
    where rn = 1""")
def shp_sft_target(spark, sf_dir):
    return records.shp_sft_target(view(spark, sf_dir, "v_shp"))


# ------------------------------------------------------------------ S3
_HH_ROWS = f"""h as (select ord, chosen, rejected,
                  regexp_extract(chosen, '(?s)^(.*' || {NN} || 'Assistant:)', 1) as prompt from v_hh),
    hr as (select ord, prompt, substr(chosen, length(prompt) + 1) as chosen,
                  substr(rejected, length(prompt) + 1) as rejected from h where prompt <> '')"""


@register("hh_pairs", "S3 T1 A1", views=("v_hh",), sql=f"""
    with {_HH_ROWS},
    k as (select *, row_number() over (partition by prompt order by ord) - 1 as pair_ix from hr)
    select prompt, cast(pair_ix as bigint) as pair_ix, cast(2 * pair_ix as bigint) as chosen_ix,
           cast(2 * pair_ix + 1 as bigint) as rejected_ix, chosen, rejected
    from k""")
def hh_pairs(spark, sf_dir):
    return records.hh_pairs(view(spark, sf_dir, "v_hh")).select(
        "prompt", F.col("pair_ix").cast("bigint").alias("pair_ix"),
        F.col("chosen_ix").cast("bigint").alias("chosen_ix"),
        F.col("rejected_ix").cast("bigint").alias("rejected_ix"), "chosen", "rejected")


@register("hh_sft_target", "S3 T1 A2", views=("v_hh",), sql=f"""
    with {_HH_ROWS}
    select prompt, max_by(chosen, ord) as sft_target, min(ord) as first_ord from hr group by prompt""")
def hh_sft_target(spark, sf_dir):
    return records.hh_sft_target(view(spark, sf_dir, "v_hh"))


@register("prompt_extract", "T1", views=("v_hh",), sql=f"""
    with h as (select ord, regexp_extract(chosen, '(?s)^(.*' || {NN} || 'Assistant:)', 1) as prompt,
                      chosen from v_hh)
    select ord, prompt, cast(length(chosen) - length(prompt) as bigint) as response_chars from h""")
def prompt_extract(spark, sf_dir):
    from prefspark.functions import text as T

    hh = view(spark, sf_dir, "v_hh")
    p = T.transcript_prompt("chosen")
    return hh.select("ord", F.coalesce(p, F.lit("")).alias("prompt"),
                     (F.length("chosen") - F.length(F.coalesce(p, F.lit("")))).cast("bigint").alias("response_chars"))


# ------------------------------------------------------------------ S7
def _aiprefs_sql(fraction: float = 1.0) -> str:
    src = "v_annotations"
    pre = ""
    if fraction < 1.0:
        pre = f"""p as (select * from (select *, row_number() over (order by ord) as rn, count(*) over () as n
                              from v_annotations) z
                     where rn <= cast(floor(cast(n as double) * {fraction!r}E0) as bigint)),"""
        src = "p"
    return f"""
    with {pre}
    k as (select * from {src} where not {_flag(('instruction', 'output_1', 'output_2'), FLAG3)}),
    r as (select {TPL_OPEN}instruction{TPL_CLOSE} as prompt, ord,
                 case when preference = 1 then output_1 else output_2 end as chosen,
                 case when preference = 1 then output_2 else output_1 end as rejected,
                 output_1 as sft_target from k)
    select prompt, min(ord) as first_ord, max_by(chosen, ord) as chosen, max_by(rejected, ord) as rejected,
           max_by(sft_target, ord) as sft_target
    from r group by prompt"""


@register("aiprefs_pairs", "S7 F2 A2 D8",views=("v_annotations",), sql=_aiprefs_sql())
def aiprefs_pairs(spark, sf_dir):
    return records.aiprefs(view(spark, sf_dir, "v_annotations"))


@register("aiprefs_fraction", "S7 W1", views=("v_annotations",), sql=_aiprefs_sql(0.29))
def aiprefs_fraction(spark, sf_dir):
    return records.aiprefs(view(spark, sf_dir, "v_annotations"), data_fraction=0.29)


# ------------------------------------------------------------------ S8 / S9
def _binarized_sql(source: str) -> str:
    tl = f"length('Human: ' || prompt || {NN} || 'Assistant: ')"
    return f"""
    select {TPL_OPEN}prompt{TPL_CLOSE} as prompt, min(ord) as first_ord,
           max_by(substr(chosen, {tl} + 1), ord) as chosen,
           max_by(substr(rejected, {tl} + 1), ord) as rejected,
           max_by(substr(chosen, {tl} + 1), ord) as sft_target
    from v_binarized
    where source = '{source}' and not {_flag(('prompt', 'chosen', 'rejected'), FLAG2)}
    group by {TPL_OPEN}prompt{TPL_CLOSE}"""


@register("ultrafeedback_pairs", "S8 F3 A2", views=("v_binarized",), sql=_binarized_sql("wide"))
def ultrafeedback_pairs(spark, sf_dir):
    b = view(spark, sf_dir, "v_binarized")
    return records.binarized(b.filter(F.col("source") == "wide"))


@register("ultrafeedback_narrow_routing", "S9 W2", views=("v_binarized",), sql=f"""
    select 'train' as split, * from ({_binarized_sql('narrow')}) tr
    union all
    select 'test' as split, * from (select * from ({_binarized_sql('wide')}) te order by first_ord limit 256) te2""")
def ultrafeedback_narrow_routing(spark, sf_dir):
    b = view(spark, sf_dir, "v_binarized")
    train = records.binarized_narrow(b, "train").select(F.lit("train").alias("split"), "*")
    test = records.binarized_narrow(b, "test").select(F.lit("test").alias("split"), "*")
    return train.unionByName(test)


# ------------------------------------------------------------------ S12
def _wiki_sql(n: int) -> str:
    words = "string_split(text, ' ')"
    return f"""
    with c as (select doc_id as ord,
                      array_to_string(list_slice({words}, 1, 10), ' ') || ' ' as prompt,
                      array_to_string(list_slice({words}, 11, len({words})), ' ') as target
               from documents where length(text) > 100),
    f as (select prompt, min(ord) as first_ord from c group by prompt),
    s as (select case when count(*) = {n} then max(first_ord) else (select max(ord) from c) end as stop
          from (select first_ord from f order by first_ord limit {n}) z)
    select prompt, max_by(target, ord) as sft_target, min(ord) as first_ord
    from c where ord <= (select stop from s) group by prompt"""


WIKI_FIXED_DOC = 25  # position of the fixed train entry inside the driver's documents table


@register("wikitext_split", "S12 F8 T8", sql=f"""
    select 'test' as split, * from ({_wiki_sql(128)}) t
    union all
    select 'train' as split, * from (
      select '' as prompt, text as sft_target, cast(-1 as bigint) as first_ord from documents
      where doc_id = {WIKI_FIXED_DOC}
      union all select * from ({_wiki_sql(9)}) w) r""")
def wikitext_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    test = records.wikitext(docs, "test").select(F.lit("test").alias("split"), "*")
    train = records.wikitext(docs, "train", fixed_ord=WIKI_FIXED_DOC).select(F.lit("train").alias("split"), "*")
    return test.unionByName(train)


# Only the SQL stops here: it tells the whole result for tables with fewer prompts.
ALL_PROMPTS = 100_000


@register("wikitext_to_the_end", "S12", sql=_wiki_sql(ALL_PROMPTS))
def wikitext_to_the_end(spark, sf_dir):
    """S12 with more prompts asked for than exist."""
    return records.wikitext(table(spark, sf_dir, "documents"), "test", test_n=None)


# ------------------------------------------------------------------ S13
@register("alpaca_prompts", "S13", sql=f"""
    select {TPL_OPEN}text{TPL_CLOSE} as prompt, cast(null as varchar) as sft_target, min(item_id) as first_ord
    from benchmark group by {TPL_OPEN}text{TPL_CLOSE}""")
def alpaca_prompts(spark, sf_dir):
    return records.alpaca_prompts(table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------------ U1 / S14
@register("mixture_union", "U1 S14 G6", views=("v_annotations", "v_binarized", "v_hh"), sql=f"""
    select 'sharegpt' as dataset, prompt, chosen, rejected, 'keep_end' as truncation_mode
      from ({_aiprefs_sql()}) a
    union all
    select 'ultrafeedback', prompt, chosen, rejected, 'keep_start' from ({_binarized_sql('wide')}) u
    union all
    select 'hh', prompt, chosen, rejected, 'keep_end' from (
      with {_HH_ROWS} select * from hr) h""")
def mixture_union(spark, sf_dir):
    """Concatenation of several datasets' pair rows, no cross-dataset dedupe,
    each tagged with its truncation mode."""
    return registry.mixture(spark, sf_dir, ["sharegpt", "ultrafeedback", "hh"]).select(
        "dataset", "prompt", "chosen", "rejected", "truncation_mode")
