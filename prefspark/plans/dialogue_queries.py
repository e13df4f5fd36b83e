"""Dialogue queries: S4, S11, F1, F6, W1, W2 over ``v_turns``."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import text as T
from prefspark.plans.registry import register
from prefspark.sources import dialogue
from prefspark.sources.fixtures import view

_ROLE_SQL = """case when lower(role) in ('human', 'user') then 'h'
                   when lower(role) in ('gpt', 'assistant') then 'g' else 'o' end"""
_FLAG3_SQL = "(contains(text, '<s>') or contains(text, '</s>') or contains(text, '<|endoftext|>'))"


def _sharegpt_sql(num_turns: int, fraction: float = 1.0) -> str:
    limit = 2 * num_turns + 1
    frac = ""
    if fraction < 1.0:
        frac = f"""
        convs as (select conv_id, min(ord) as conv_ord from v_turns group by conv_id),
        kept as (select conv_id from (select conv_id, row_number() over (order by conv_ord) as rn,
                        count(*) over () as n from convs) z
                 where rn <= cast(floor(cast(n as double) * {fraction!r}E0) as bigint)),"""
    src = "(select * from v_turns where conv_id in (select conv_id from kept))" if frac else "v_turns"
    return f"""
    with {frac.strip()}
    bad as (select distinct conv_id from {src} t where {_FLAG3_SQL}),
    head as (select conv_id, pos, ord, text, {_ROLE_SQL} as r from {src} t
             where pos < {limit} and conv_id not in (select conv_id from bad)),
    f as (select *,
            first(case when r <> 'o' then r end ignore nulls) over (partition by conv_id order by pos
                  rows between unbounded preceding and unbounded following) as first_r,
            coalesce(string_agg(case when r = 'h' then text || chr(10) || chr(10) || 'Assistant: '
                                     when r = 'g' then text || chr(10) || chr(10) || 'Human: ' else '' end, '')
                     over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), '') as acc
          from head),
    e as (select 'Human: ' || acc as prompt, text as target, ord from f where r = 'g' and first_r = 'h')
    select prompt, max_by(target, ord) as sft_target, min(ord) as first_ord from e group by prompt
    """.replace("with \n", "with ")


@register("sharegpt_sft_1turn", "S4 T3 T4 F1 A2 D3 D4",views=("v_turns",), sql=_sharegpt_sql(1))
def sharegpt_sft_1turn(spark, sf_dir):
    return dialogue.sharegpt_sft(view(spark, sf_dir, "v_turns"), num_turns=1)


@register("sharegpt_sft_2turn", "S4 T4 F1 A2", views=("v_turns",), sql=_sharegpt_sql(2))
def sharegpt_sft_2turn(spark, sf_dir):
    return dialogue.sharegpt_sft(view(spark, sf_dir, "v_turns"), num_turns=2)


@register("prefix_fraction", "W1 S4", views=("v_turns",), sql=_sharegpt_sql(1, 0.29))
def prefix_fraction(spark, sf_dir):
    return dialogue.sharegpt_sft(view(spark, sf_dir, "v_turns"), num_turns=1, data_fraction=0.29)


@register(
    "first_n_split", "W2 S4", views=("v_turns",),
    sql=f"""with r as ({_sharegpt_sql(1)})
    select prompt, sft_target, first_ord from r order by first_ord limit 256""",
)
def first_n_split(spark, sf_dir):
    return dialogue.sharegpt_sft(view(spark, sf_dir, "v_turns"), split="test", num_turns=1)


_ULTRACHAT_SQL = f"""
    with h as (select conv_id, pos, ord, text, {_ROLE_SQL} as r from v_turns where pos < 2),
    c as (select conv_id, max(case when pos = 0 then r end) as r0, max(case when pos = 1 then r end) as r1,
                 max(case when pos = 0 then text end) as t0, max(case when pos = 1 then text end) as t1,
                 max(case when pos = 1 then ord end) as ord
          from h group by conv_id),
    e as (select 'Human: ' || t0 || chr(10) || chr(10) || 'Assistant: ' as prompt, t1 as target, ord
          from c where r0 = 'h' and r1 = 'g')
    select prompt, max_by(target, ord) as sft_target, min(ord) as first_ord from e group by prompt"""


@register(
    "ultrachat_first_turn", "S11 F6 A2", views=("v_turns",),
    sql=_ULTRACHAT_SQL,
)
def ultrachat_first_turn(spark, sf_dir):
    return dialogue.ultrachat_first_turn(view(spark, sf_dir, "v_turns"))


@register(
    "special_token_filter", "F1 F2 F3", views=("v_turns",),
    sql=f"""
    select t.conv_id,
           cast(count(*) as bigint) as n_turns,
           cast(sum(case when {_FLAG3_SQL} then 1 else 0 end) as bigint) as n_flag3,
           cast(sum(case when contains(text, '<s>') or contains(text, '</s>') then 1 else 0 end) as bigint) as n_flag2
    from v_turns t
    where t.conv_id in (select conv_id from v_turns where {_FLAG3_SQL})
    group by t.conv_id""",
)
def special_token_filter(spark, sf_dir):
    """Conversation-level (F1) drop list with the row-level 3-token (F2) and
    2-token (F3) counts of every dropped conversation."""
    turns = view(spark, sf_dir, "v_turns")
    dropped = dialogue.flagged_conversations(turns)
    return (
        turns.join(dropped, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("n_turns"),
            F.count_if(T.has_any(["text"], T.SPECIAL_TOKENS_3)).cast("bigint").alias("n_flag3"),
            F.count_if(T.has_any(["text"], T.SPECIAL_TOKENS_2)).cast("bigint").alias("n_flag2"),
        )
    )
