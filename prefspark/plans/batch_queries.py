"""Ordering, batching and token queries: W3-W9, K1-K10, U3."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from prefspark.functions import tokens as K
from prefspark.operators import batching, ordinals
from prefspark.operators import epochs as EP
from prefspark.plans.dialogue_queries import _ULTRACHAT_SQL, _sharegpt_sql
from prefspark.plans.record_queries import _SHP_KEPT, _aiprefs_sql
from prefspark.plans.registry import register
from prefspark.sources import dialogue, registry
from prefspark.sources.fixtures import table, view

MAX_LEN, MAX_PROMPT = 64, 16
BATCH, WORLD, SEED = 8, 3, 0
EPOCHS = 2
BUDGET = 300

# ----------------------------------------------------------------- SQL pieces
_SHP_ROWS = f"""
      select 'shp' as dataset, 1 as dataset_ix, prompt, min(ord) over (partition by prompt) as first_ord, cast(pair_ix as bigint) as pair_ix,
             case when labels = 1 then ' ' || human_ref_a else ' ' || human_ref_b end as chosen,
             case when labels = 1 then ' ' || human_ref_b else ' ' || human_ref_a end as rejected, 'keep_start' as truncation_mode
      from (with {_SHP_KEPT} select * from k) s"""
_EX = f"""ex as (
      select 'sharegpt' as dataset, 0 as dataset_ix, prompt, first_ord, cast(0 as bigint) as pair_ix, chosen, rejected,
             'keep_end' as truncation_mode
      from ({_aiprefs_sql()}) a
      union all by name {_SHP_ROWS})"""


def _walked_sql(ix: str, n: str, epoch: str, seed: int = SEED) -> str:
    """``epochs.permuted`` in SQL: a Feistel network over a grid a x b, in columns of
    ``grid`` (a, b, n), with cycle walking."""
    f = lambda y: f"(('0x' || substr(md5(concat_ws(chr(1), '{seed}', cast({epoch} as varchar), cast(s.j as varchar), cast({y} as varchar))), 1, 15))::bigint)"
    rounds = ", ".join(f"{{'l': 0::bigint, 'r': 0::bigint, 'j': {j}}}" for j in range(EP.ROUNDS))

    def once(x):
        start = f"{{'l': ({x}) // b, 'r': ({x}) % b, 'j': -1}}"
        left = f"case when s.j % 2 = 0 then (t.l + {f('t.r')}) % a else t.l end"
        right = f"case when s.j % 2 = 0 then t.r else (t.r + {f('t.l')}) % b end"
        step = f"{{'l': {left}, 'r': {right}, 'j': s.j}}"
        done = f"list_reduce([{start}, {rounds}], lambda t, s: {step})"
        return f"({done}['l'] * b + {done}['r'])"

    walk = f"list_transform(range({EP.WALK}), lambda z: 0::bigint)"
    return f"list_reduce(list_concat([{once(ix)}], {walk}), lambda w, z: case when w < {n} then w else {once('w')} end)"


def _epochs_sql(epochs: str, ex: str = "ex") -> str:
    """CTEs up to ``pos`` (epoch, dataset_ix, first_ord, rank, ...): a rank per prompt."""
    return f"""grp as (select dataset_ix, first_ord, cast(row_number() over (order by dataset_ix, first_ord) - 1 as bigint) as ix,
                   cast(count(*) over () as bigint) as n
            from (select distinct dataset_ix, first_ord from {ex})),
    side as (select distinct n, cast(ceil(sqrt(n)) as bigint) as a from grp),
    pos as (select epoch, dataset_ix, first_ord, {_walked_sql('ix', 'n', 'epoch')} as rank
            from (select grp.dataset_ix, grp.first_ord, grp.ix, grp.n, side.a, cast(ceil(grp.n / side.a) as bigint) as b,
                         unnest({epochs}) as epoch
                  from grp, side))"""


def _ordered_sql(epochs: str) -> str:
    return f"""{_EX},
    {_epochs_sql(epochs)},
    o as (select ex.*, pos.epoch, cast(row_number() over (partition by pos.epoch order by pos.rank, pair_ix) as bigint) as rn
          from ex join pos on ex.dataset_ix = pos.dataset_ix and ex.first_ord = pos.first_ord),
    n as (select count(*) as n, cast(floor(count(*) / {BATCH}) * {BATCH} as bigint) as nfull from ex),
    b as (select o.*, cast(floor((rn - 1) / {BATCH}) as bigint) as batch_id,
                 cast((rn - 1) % {BATCH} as bigint) as pos_in_batch
          from o where rn <= (select nfull from n))"""


def _pieces(col: str) -> str:
    return f"regexp_extract_all(replace(coalesce({col}, ''), '{K.EOS_TEXT}', ' {K.EOS_TEXT} '), '(\\S+)', 1)"


def _tok(col: str) -> str:
    return (f"list_transform({_pieces(col)}, lambda t: case when t = '{K.EOS_TEXT}' then cast({K.EOS_ID} as bigint) "
            f"else cast({K.FIRST_ID} + (('0x' || substr(md5(t), 1, 8))::bigint % {K.VOCAB - K.FIRST_ID}) as bigint) end)")


def _tokenized_sql(src: str, chosen: str = "chosen", rejected: str = "rejected",
                   max_len: int = MAX_LEN, max_prompt: int = MAX_PROMPT) -> str:
    return f"""tk as (select *, {_tok('prompt')} as p0,
                  list_append({_tok(chosen)}, cast({K.EOS_ID} as bigint)) as c0,
                  list_append({_tok(rejected)}, cast({K.EOS_ID} as bigint)) as r0 from {src}),
    tr as (select *, case when len(p0) + greatest(len(c0), len(r0)) <= {max_len} then p0
                          when truncation_mode = 'keep_start' then list_slice(p0, 1, {max_prompt})
                          else list_slice(p0, greatest(len(p0) - {max_prompt}, 0) + 1, len(p0)) end as p
           from tk),
    tr2 as (select *, case when len(p) + greatest(len(c0), len(r0)) > {max_len}
                           then list_slice(c0, 1, {max_len - max_prompt}) else c0 end as c,
                      case when len(p) + greatest(len(c0), len(r0)) > {max_len}
                           then list_slice(r0, 1, {max_len - max_prompt}) else r0 end as r
            from tr),
    tx as (select *, list_concat(p, c) as chosen_input_ids, list_concat(p, r) as rejected_input_ids,
                  list_concat(list_transform(p, lambda x: cast(-100 as bigint)), c) as chosen_labels,
                  list_concat(list_transform(p, lambda x: cast(-100 as bigint)), r) as rejected_labels
           from tr2)"""


def _pad(col: str, width: str, value: int, left: bool = False) -> str:
    fill = f"list_transform(range(greatest({width} - len({col}), 0)), lambda i: cast({value} as bigint))"
    return f"list_concat({fill}, {col})" if left else f"list_concat({col}, {fill})"


def _examples(spark, sf_dir):
    """Pair rows of the annotation and two-answer datasets. A schedule reads their
    narrow keys once and joins the texts to the positions that are left."""
    return registry.mixture(spark, sf_dir, ["sharegpt", "shp"])


def _batched(spark, sf_dir, n_epochs):
    ex = _examples(spark, sf_dir)
    plan = batching.schedule(ex, SEED)
    return batching.assign_batches(batching.epoch_order(ex, n_epochs, plan=plan), BATCH, plan.n)


def _ids(c):
    return K.ids_text(c).alias(c)


# ----------------------------------------------------------------- W3
@register("hash_split_1pct", "W3", views=("v_answers",), sql="""
    with q as (select distinct q_ord from v_answers),
    r as (select q_ord, row_number() over (order by substr(md5(concat_ws(chr(1), '42', cast(q_ord as varchar))), 1, 15),
                                                q_ord) as rn,
                 count(*) over () as n from q)
    select q_ord, case when rn <= cast(floor(n * 0.01E0) as bigint) then 'test' else 'train' end as split from r""")
def hash_split_1pct(spark, sf_dir):
    """Seeded shuffle of questions; the first ``int(0.01*n)`` are test, the rest train."""
    q = view(spark, sf_dir, "v_answers").select("q_ord").distinct()
    n = q.count()
    k = int(n * 0.01)
    keyed = q.withColumn("_h", F.substring(F.md5(F.concat_ws("\u0001", F.lit("42"), F.col("q_ord").cast("string"))), 1, 15))
    ranked = ordinals.dense_index(keyed, ["_h", "q_ord"], out="rn")
    return ranked.select("q_ord", F.when(F.col("rn") <= k, "test").otherwise("train").alias("split"))


# ----------------------------------------------------------------- W4/W5
@register("epoch_shuffle", "W4 W5", views=("v_annotations", "v_shp"), sql=f"""
    with {_ordered_sql(f'range(0, {EPOCHS})')}
    select epoch, rn, dataset, prompt, pair_ix from o""")
def epoch_shuffle(spark, sf_dir):
    ordered = batching.epoch_order(_examples(spark, sf_dir), EPOCHS, seed=SEED)
    return ordered.select(F.col("epoch").cast("bigint").alias("epoch"), "rn", "dataset", "prompt", "pair_ix")


@register("batch_assign", "W6", views=("v_annotations", "v_shp"), sql=f"""
    with {_ordered_sql(f'range(0, {EPOCHS})')}
    select epoch, rn, batch_id, pos_in_batch, dataset, prompt, pair_ix from b""")
def batch_assign(spark, sf_dir):
    b = _batched(spark, sf_dir, EPOCHS)
    return b.select(F.col("epoch").cast("bigint").alias("epoch"), "rn", "batch_id", "pos_in_batch",
                    "dataset", "prompt", "pair_ix")


@register("example_budget", "W7", views=("v_annotations", "v_shp"), sql=f"""
    with {_ordered_sql('range(0, 64)')},
    s1 as (select n, nfull, cast(greatest(0, ceil(({BUDGET} - nfull) / n)) as bigint) as e0 from n),
    s2 as (select n, e0, e0 * n + (greatest(0, cast(ceil(({BUDGET} - e0 * n) / {BATCH}) as bigint) - 1) + 1) * {BATCH}
                  as stop from s1)
    select epoch, batch_id, pos_in_batch, dataset, prompt, pair_ix from b
    where epoch <= (select e0 from s2)
      and epoch * (select n from s2) + (batch_id + 1) * {BATCH} <= (select stop from s2)""")
def example_budget(spark, sf_dir):
    out = batching.budget_schedule(_examples(spark, sf_dir), BATCH, BUDGET, seed=SEED)
    return out.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch",
                      "dataset", "prompt", "pair_ix")


@register("shard_slices", "W9", views=("v_annotations", "v_shp"), sql=f"""
    with {_ordered_sql('range(0, 1)')}
    select epoch, batch_id, pos_in_batch, cast(floor(pos_in_batch / {BATCH // WORLD}) as bigint) as shard,
           dataset, prompt, pair_ix
    from b where floor(pos_in_batch / {BATCH // WORLD}) < {WORLD}""")
def shard_slices(spark, sf_dir):
    b = _batched(spark, sf_dir, 1)
    return batching.shard_slices(b, WORLD, BATCH).select(
        F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch", "shard", "dataset", "prompt", "pair_ix")


# ----------------------------------------------------------------- U1, W4 without shuffle
@register("unshuffled_order", "W4 U1", views=("v_annotations", "v_shp"), sql=f"""
    with {_EX}
    select cast(row_number() over (order by case dataset when 'shp' then 0 else 1 end, first_ord, pair_ix) as bigint) as rn,
           dataset, prompt, pair_ix from ex""")
def unshuffled_order(spark, sf_dir):
    """Two datasets, listed out of alphabetical order: the first one's rows come
    first, each dataset in insertion order."""
    ex = registry.mixture(spark, sf_dir, ["shp", "sharegpt"])
    return batching.epoch_order(ex, 1, shuffle=False).select("rn", "dataset", "prompt", "pair_ix")


@register("epochs_or_budget", "W7 W5", views=("v_annotations", "v_shp"), sql=f"""
    with {_ordered_sql(f'range(0, {EPOCHS})')}
    select epoch, batch_id, pos_in_batch, dataset, prompt, pair_ix from b""")
def epochs_or_budget(spark, sf_dir):
    """Both stops are set and the epochs end first."""
    ex = _examples(spark, sf_dir)
    plan = batching.schedule(ex, SEED)
    out = batching.budget_schedule(ex, BATCH, plan.n * 50, n_epochs=EPOCHS, plan=plan)
    return out.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch", "dataset", "prompt", "pair_ix")


# ----------------------------------------------------------------- SFT mode
_SFT_EX = f"""ex as (
      select 'ultrachat' as dataset, 0 as dataset_ix, prompt, sft_target, sft_target as chosen, sft_target as rejected,
             first_ord, 'keep_start' as truncation_mode from ({_ULTRACHAT_SQL}) u
      union all
      select 'sharegpt', 1, prompt, sft_target, sft_target, sft_target, first_ord, 'keep_end' from ({_sharegpt_sql(1)}) s)"""


def _sft_examples(spark, sf_dir):
    return registry.mixture(spark, sf_dir, ["ultrachat", "sharegpt"], mode="sft")


@register("sft_mixture", "U1 S14 W4", views=("v_turns",), sql=f"""
    with {_SFT_EX}
    select cast(row_number() over (order by dataset_ix, first_ord) as bigint) as rn, dataset, prompt, sft_target, truncation_mode
    from ex""")
def sft_mixture(spark, sf_dir):
    """One row per prompt of two datasets, in list order."""
    ordered = batching.epoch_order(_sft_examples(spark, sf_dir), 1, shuffle=False)
    return ordered.select("rn", "dataset", "prompt", "sft_target", "truncation_mode")


@register("sft_collate", "U1 W4 W5 W6 K1 K2 K3 K4 K6", views=("v_turns",), sql=f"""
    with {_SFT_EX},
    {_epochs_sql('range(0, 1)')},
    o as (select ex.*, rank + 1 as rn from ex join pos on ex.dataset_ix = pos.dataset_ix and ex.first_ord = pos.first_ord),
    n as (select cast(floor(count(*) / {BATCH}) * {BATCH} as bigint) as nfull from ex),
    b as (select *, cast(floor((rn - 1) / {BATCH}) as bigint) as batch_id, cast((rn - 1) % {BATCH} as bigint) as pos_in_batch
          from o where rn <= (select nfull from n)),
    {_tokenized_sql('b')},
    mx as (select *, max(len(p)) over (partition by batch_id) as wp, max(len(chosen_input_ids)) over (partition by batch_id) as wc from tx)
    select batch_id, pos_in_batch, dataset,
           array_to_string({_pad('p', 'wp', K.PAD_ID, left=True)}, ' ') as prompt_input_ids,
           array_to_string({_pad('chosen_input_ids', 'wc', K.PAD_ID)}, ' ') as chosen_input_ids,
           array_to_string({_pad('chosen_labels', 'wc', K.IGNORE)}, ' ') as chosen_labels
    from mx""")
def sft_collate(spark, sf_dir):
    """SFT training end to end: prompt, epoch order, batch, tokens, padding."""
    ex = _sft_examples(spark, sf_dir)
    plan = batching.schedule(ex, SEED)
    b = batching.assign_batches(batching.epoch_order(ex, 1, plan=plan), BATCH, plan.n)
    c = batching.collate(batching.tokenize_examples(b, MAX_LEN, MAX_PROMPT, sft_mode=True))
    return c.select("batch_id", "pos_in_batch", "dataset", _ids("prompt_input_ids"), _ids("chosen_input_ids"), _ids("chosen_labels"))


# ----------------------------------------------------------------- K1-K5
@register("tokenize_truncate", "K1 K2 K3 K4 K5 D9",views=("v_annotations", "v_shp"), sql=f"""
    with {_EX},
    {_tokenized_sql('ex')}
    select dataset, prompt, pair_ix, array_to_string(p, ' ') as prompt_input_ids,
           array_to_string(chosen_input_ids, ' ') as chosen_input_ids,
           array_to_string(chosen_labels, ' ') as chosen_labels,
           array_to_string(rejected_input_ids, ' ') as rejected_input_ids,
           array_to_string(rejected_labels, ' ') as rejected_labels,
           cast(len(chosen_input_ids) as bigint) as chosen_len
    from tx""")
def tokenize_truncate(spark, sf_dir):
    t = batching.tokenize_examples(_examples(spark, sf_dir), MAX_LEN, MAX_PROMPT)
    return t.select("dataset", "prompt", "pair_ix", _ids("prompt_input_ids"), _ids("chosen_input_ids"),
                    _ids("chosen_labels"), _ids("rejected_input_ids"), _ids("rejected_labels"),
                    F.size("chosen_input_ids").cast("bigint").alias("chosen_len"))


FULL_LEN, FULL_PROMPT = 512, 256  # the reference's defaults


@register("tokenize_truncate_full", "K1 K2 K3 K4", views=("v_annotations", "v_shp"), sql=f"""
    with {_EX},
    {_tokenized_sql('ex', max_len=FULL_LEN, max_prompt=FULL_PROMPT)}
    select dataset, prompt, pair_ix, array_to_string(chosen_input_ids, ' ') as chosen_input_ids,
           array_to_string(rejected_input_ids, ' ') as rejected_input_ids
    from tx""")
def tokenize_truncate_full(spark, sf_dir):
    t = batching.tokenize_examples(_examples(spark, sf_dir), FULL_LEN, FULL_PROMPT)
    return t.select("dataset", "prompt", "pair_ix", _ids("chosen_input_ids"), _ids("rejected_input_ids"))


def _hooked(text: str) -> list[int]:
    """The default ids by a function over one text, as a tokenizer would be."""
    parts = re.findall(r"[^ \t\n\f\r]+", text.replace(K.EOS_TEXT, f" {K.EOS_TEXT} "))
    return [K.EOS_ID if t == K.EOS_TEXT else K.FIRST_ID + int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % (K.VOCAB - K.FIRST_ID)
            for t in parts]


@register("tokenizer_hook", "G1 K1", sql=f"""
    select conv_id, turn, array_to_string({_tok('text')}, ' ') as ids from conversations""")
def tokenizer_hook(spark, sf_dir):
    """G1: a user's per-text tokenizer over whole conversations."""
    tokenize = K.pandas_tokenizer(_hooked)
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", K.ids_text(tokenize("text")).alias("ids"))


@register("label_mask", "K4 K5", views=("v_turns",), sql=f"""
    with s as (select prompt, sft_target, sft_target as chosen, sft_target as rejected,
                      'keep_end' as truncation_mode from ({_sharegpt_sql(1)}) z),
    {_tokenized_sql('s')}
    select prompt, array_to_string(chosen_input_ids, ' ') as chosen_input_ids,
           array_to_string(chosen_labels, ' ') as chosen_labels,
           cast(len(list_filter(chosen_labels, lambda x: x <> -100)) as bigint) as n_target_tokens
    from tx""")
def label_mask(spark, sf_dir):
    """K4 in SFT mode: target used for both sides, rejected columns dropped."""
    sft = dialogue.sharegpt_sft(view(spark, sf_dir, "v_turns"), num_turns=1).withColumn(
        "truncation_mode", F.lit("keep_end"))
    t = batching.tokenize_examples(sft, MAX_LEN, MAX_PROMPT, sft_mode=True)
    return t.select("prompt", _ids("chosen_input_ids"), _ids("chosen_labels"),
                    F.size(F.filter("chosen_labels", lambda x: x != K.IGNORE)).cast("bigint").alias("n_target_tokens"))


# ----------------------------------------------------------------- K6-K8, U3
_BATCH_TOK = f"""{_ordered_sql('range(0, 1)')},
    {_tokenized_sql('b')},
    mx as (select *, max(len(p)) over (partition by epoch, batch_id) as wp,
                  max(len(chosen_input_ids)) over (partition by epoch, batch_id) as wc,
                  max(len(rejected_input_ids)) over (partition by epoch, batch_id) as wr from tx)"""


@register("collate_pad", "K6 K7 D10",views=("v_annotations", "v_shp"), sql=f"""
    with {_BATCH_TOK}
    select epoch, batch_id, pos_in_batch,
           array_to_string({_pad('p', 'wp', K.PAD_ID, left=True)}, ' ') as prompt_input_ids,
           array_to_string({_pad('list_transform(p, lambda x: cast(1 as bigint))', 'wp', 0, left=True)}, ' ')
             as prompt_attention_mask,
           array_to_string({_pad('chosen_input_ids', 'wc', K.PAD_ID)}, ' ') as chosen_input_ids,
           array_to_string({_pad('chosen_labels', 'wc', K.IGNORE)}, ' ') as chosen_labels,
           array_to_string({_pad('rejected_input_ids', 'wr', K.PAD_ID)}, ' ') as rejected_input_ids
    from mx""")
def collate_pad(spark, sf_dir):
    b = _batched(spark, sf_dir, 1)
    c = batching.collate(batching.tokenize_examples(b, MAX_LEN, MAX_PROMPT))
    return c.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch",
                    _ids("prompt_input_ids"), _ids("prompt_attention_mask"), _ids("chosen_input_ids"),
                    _ids("chosen_labels"), _ids("rejected_input_ids"))


@register("concat_pad", "K8 K7 U3", views=("v_annotations", "v_shp"), sql=f"""
    with {_BATCH_TOK},
    j as (select epoch, batch_id, pos_in_batch, greatest(wc, wr) as wj,
                 {_pad('chosen_input_ids', 'wc', K.PAD_ID)} as ci, {_pad('chosen_labels', 'wc', K.IGNORE)} as cl,
                 {_pad('rejected_input_ids', 'wr', K.PAD_ID)} as ri, {_pad('rejected_labels', 'wr', K.IGNORE)} as rl
          from mx)
    select epoch, batch_id, pos_in_batch, 'chosen' as side,
           array_to_string({_pad('ci', 'wj', 0)}, ' ') as concatenated_input_ids,
           array_to_string({_pad('cl', 'wj', K.IGNORE)}, ' ') as concatenated_labels
    from j
    union all
    select epoch, batch_id, pos_in_batch, 'rejected',
           array_to_string({_pad('ri', 'wj', 0)}, ' '),
           array_to_string({_pad('rl', 'wj', K.IGNORE)}, ' ')
    from j""")
def concat_pad(spark, sf_dir):
    b = _batched(spark, sf_dir, 1)
    c = batching.concat_pad(batching.collate(batching.tokenize_examples(b, MAX_LEN, MAX_PROMPT)))
    return c.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch", "side",
                    _ids("concatenated_input_ids"), _ids("concatenated_labels"))


# ----------------------------------------------------------------- K10
@register("pair_explode", "K10 D1 D2", views=("v_annotations",), sql=f"""
    select prompt, cast(0 as bigint) as pair_ix, chosen, rejected from ({_aiprefs_sql()}) a""")
def pair_explode(spark, sf_dir):
    """K10 over the record form D1 (responses array + index pairs): posexplode the
    pairs and look the texts up (1-based ``element_at``). Annotation records hold
    two responses, so the arrays are bounded."""
    from prefspark.sources import records

    rec = records.aiprefs(view(spark, sf_dir, "v_annotations"))
    # Rebuild the reference's record shape: responses [output_1, output_2] and pairs.
    d1 = rec.select(
        "prompt",
        F.when(F.col("chosen") == F.col("sft_target"), F.array(F.col("chosen"), F.col("rejected")))
        .otherwise(F.array(F.col("rejected"), F.col("chosen"))).alias("responses"),
        F.when(F.col("chosen") == F.col("sft_target"), F.array(F.struct(F.lit(0).alias("c"), F.lit(1).alias("r"))))
        .otherwise(F.array(F.struct(F.lit(1).alias("c"), F.lit(0).alias("r")))).alias("pairs"),
    )
    ex = d1.select("prompt", "responses", F.posexplode("pairs").alias("pair_ix", "p"))
    return ex.select(
        "prompt", F.col("pair_ix").cast("bigint").alias("pair_ix"),
        F.element_at("responses", F.col("p.c") + 1).alias("chosen"),
        F.element_at("responses", F.col("p.r") + 1).alias("rejected"),
    )


# ----------------------------------------------------------------- S1, J7, U1: pairs of scored answers
PAIR_EPOCHS = 3


_PROMPT = "chr(10) || chr(10) || 'Human: ' || question || chr(10) || chr(10) || 'Assistant:'"


def _pair_batches_sql(numbers: str, size: int, others: str = "") -> str:
    """All pairs written and ordered; Spark draws the same batches without them."""
    return f"""t as (select question, max(q_ord) as q_ord from v_threads group by question),
    a as (select v.*, cast(row_number() over (partition by v.q_ord order by pos) - 1 as bigint) as k
          from v_threads v join t on t.question = v.question and t.q_ord = v.q_ord),
    p as (select i.q_ord as first_ord, i.question, i.k as i, j.k as j, i.pm_score > j.pm_score as left_wins,
                 ' ' || i.answer as ti, ' ' || j.answer as tj
          from a i join a j on i.q_ord = j.q_ord and i.k < j.k),
    ex as ({others}select 0 as dataset_ix, 'se' as dataset, first_ord,
                  row_number() over (partition by first_ord order by i, j) - 1 as pair,
                  {_PROMPT} as prompt, case when left_wins then i else j end as chosen_ix,
                  case when left_wins then j else i end as rejected_ix,
                  case when left_wins then ti else tj end as chosen, case when left_wins then tj else ti end as rejected from p),
    {_epochs_sql(f'range(0, {PAIR_EPOCHS})')},
    o as (select ex.*, pos.epoch, cast(row_number() over (partition by pos.epoch order by pos.rank, pair) - 1 as bigint) as place
          from ex join pos on ex.dataset_ix = pos.dataset_ix and ex.first_ord = pos.first_ord),
    n as (select count(*) as n from ex)
    select epoch, cast(place // {size} as bigint) as batch_id, cast(place % {size} as bigint) as pos_in_batch, dataset, prompt,
           chosen_ix, rejected_ix, chosen, rejected
    from o, n where place // {size} in ({numbers}) and place // {size} < n // {size}"""


@register("se_pair_batches", "S1 J7 U1 W4 W5 W6", views=("v_threads",),
          sql="with " + _pair_batches_sql("0, 1, n // 16", 8))
def se_pair_batches(spark, sf_dir):
    """The first two batches and one in the middle of three shuffled epochs over all
    answer pairs of long threads; no other pair is made."""
    train = registry.PairBatches(spark, sf_dir, ["se"], split="all", seed=SEED, answers=view(spark, sf_dir, "v_threads"))
    out = train.batches([0, 1, train.n // 16], 8, PAIR_EPOCHS)
    return out.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch", "dataset", "prompt",
                      "chosen_ix", "rejected_ix", "chosen", "rejected")


@register("preference_mixture", "U1 S1 S2 W4 W6", views=("v_threads", "v_shp"),
          sql="with " + _pair_batches_sql("n // 64, n // 32 - 1", 32, f"""
              select dataset_ix, dataset, first_ord, pair_ix as pair, prompt, cast(null as bigint) as chosen_ix,
                cast(null as bigint) as rejected_ix, chosen, rejected from ({_SHP_ROWS}) s union all by name """))
def preference_mixture(spark, sf_dir):
    """Preference training on scored answers and two-answer rows together: a batch
    from the middle and the last whole batch of three epochs."""
    train = registry.PairBatches(spark, sf_dir, ["se", "shp"], split="all", seed=SEED, answers=view(spark, sf_dir, "v_threads"))
    out = train.batches([train.n // 64, train.n // 32 - 1], 32, PAIR_EPOCHS)
    return out.select(F.col("epoch").cast("bigint").alias("epoch"), "batch_id", "pos_in_batch", "dataset", "prompt",
                      "chosen_ix", "rejected_ix", "chosen", "rejected")
