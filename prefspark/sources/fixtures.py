"""Derived input views over the driver tables.

The driver ships generic tables (conversations, documents, events, ...). The
preference-data operators expect dialogue, scored-answer, transcript,
completion, annotation and log-prob inputs, so each is written here once as a
view. Every view reads its base tables whole and uses whole texts; variant rows
(duplicate prompts, special tokens, cut-off first turns, ties, null labels) are
added as extra full copies so the interesting cases exist without sampling.

Each view is plain SQL that runs unchanged in Spark SQL and in DuckDB. On the
Spark side base tables are bound as DataFrame parameters (``{name}``), on the
DuckDB side as the pre-registered table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

NL = "chr(10)"

VIEWS: dict[str, str] = {
    # Dialogue turns in long form. copy 0 = table as is; copy 1 = every assistant
    # answer changed (duplicate prompts, later rows win); copy 2 = special token
    # appended from turn 2 on (whole conversation must be dropped); copy 3 = first
    # turn removed (user-first dialogues become assistant-first).
    "v_turns": """
        with x as (
          select conv_id, turn, role, text, explode(array(0, 1, 2, 3)) as copy from {conversations})
        select conv_id * 4 + copy as conv_id, turn, role,
               case when copy = 1 and role = 'assistant' then text || ' [v2]'
                    when copy = 2 and turn >= 2 then text || '</s>'
                    else text end as text,
               (conv_id * 4 + copy) * 1000000 + turn as ord,
               turn - case when copy = 3 then 1 else 0 end as pos
        from x
        where copy <> 3 or turn >= 1""",
    # Scored Q&A in long form: four answers per question; every fifth question
    # repeats the one before it.
    "v_answers": """
        select cast(floor(doc_id / 4) as bigint) as q_ord,
               'Q' || cast(cast(floor(doc_id / 4) as bigint)
                 - case when cast(floor(doc_id / 4) as bigint) % 5 = 4 then 1 else 0 end as string) as question,
               doc_id % 4 as pos, text as answer, n_chars % 3 as pm_score
        from {documents}""",
    # Threads of many scored answers: one question per language and source, positions
    # with gaps, equal scores; the first row of a question repeats it (older answers).
    "v_threads": """
        with d as (select doc_id, lang || '/' || source as question, text, n_chars,
                          min(doc_id) over (partition by lang, source) as first_id
                   from {documents})
        select first_id as q_ord, question, doc_id as pos, text as answer, n_chars % 31 as pm_score from d
        union all
        select -1 - first_id, question, doc_id, 'older: ' || text, n_chars % 7 from d where doc_id < first_id + 40""",
    # Two-answer preferences: consecutive documents paired, history repeats.
    "v_shp": """
        select cast(floor(a.doc_id / 2) as bigint) as ord, a.lang || '/' || a.source as history,
               a.text as human_ref_a, b.text as human_ref_b,
               a.n_chars % 97 as score_a, b.n_chars % 97 as score_b,
               case when a.n_chars % 97 >= b.n_chars % 97 then 1 else 0 end as labels
        from {documents} a join {documents} b
          on cast(floor(b.doc_id / 2) as bigint) = cast(floor(a.doc_id / 2) as bigint) and a.doc_id < b.doc_id""",
    # Chosen/rejected transcripts: one for every exchange, with all turns before it;
    # copy 1 repeats every prompt with another answer.
    "v_hh": """
        with s as (
          select conv_id, turn, role, text,
                 chr(10) || chr(10) || case when role = 'user' then 'Human: ' else 'Assistant: ' end || text as said
          from {conversations} where role in ('user', 'assistant')),
        h as (
          select conv_id, turn, role, text,
                 array_join(collect_list(said) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as past,
                 lag(role) over (partition by conv_id order by turn) as before,
                 min(case when role = 'assistant' then turn end) over (partition by conv_id) as t1,
                 min(turn) over (partition by conv_id) as t0
          from s),
        r as (
          select h.conv_id, h.turn, h.past, h.text, f.text as other, f.turn as other_turn
          from h join s f on f.conv_id = h.conv_id and f.turn = h.t1
          where h.role = 'assistant' and h.before = 'user'),
        q as (select conv_id, turn, past, text, other, other_turn, explode(array(0, 1)) as copy from r)
        select (conv_id * 1000000 + turn) * 2 + copy as ord,
          past || chr(10) || chr(10) || 'Assistant: ' || case when copy = 1 then text || ' [alt]' else text end as chosen,
          past || chr(10) || chr(10) || 'Assistant: ' || case when other_turn = turn then other || ' [first]' else other end as rejected
        from q""",
    # Outputs of two models plus overlapping sample shards (worker s starts at 5*s).
    "v_completions": """
        with b as (
          select u.conv_id * 1000000 + u.turn as ord, u.text as instruction, a.text as output
          from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
          where u.role = 'user' and a.role = 'assistant')
        , g as (select ord, instruction, output, explode(array(0, 1, 2, 3, 4)) as k from b)
        select case k when 0 then 'teacher' when 1 then 'student' else 'sampled' end as model,
               case when k >= 2 then k - 2 else 0 end as shard, ord, instruction,
               case k when 0 then output when 1 then 'alt: ' || output
                      else output || ' #' || cast(k - 2 as string) end as output
        from g where k <= 2 or (k = 3 and ord >= 5) or (k = 4 and ord >= 10)
        union all select 'sampled', 0, -1 - doc_id, text, 'long' from {documents} where n_chars >= 7000""",
    # Judge annotations: preference 1, 2, 1.5 (tie) or null; some output_2 carry a special token.
    "v_annotations": """
        select u.conv_id * 1000000 + u.turn as ord, u.text as instruction, a.text as output_1,
               case when u.conv_id % 11 = 0 then '<s>' else '' end || 'alt: ' || a.text as output_2,
               case (u.conv_id + u.turn) % 4 when 0 then 1.0E0 when 1 then 2.0E0 when 2 then 1.5E0 end as preference
        from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
        where u.role = 'user'""",
    # Binarised preferences from two sources: 'wide' (shared evaluation source)
    # and 'narrow' (train source); chosen/rejected carry the full template.
    "v_binarized": """
        with b as (
          select u.conv_id * 1000000 + u.turn as ord, u.text as prompt, a.text as answer
          from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
          where u.role = 'user' and a.role = 'assistant')
        , g as (select ord, prompt, answer, explode(array(0, 1)) as k from b)
        select case k when 0 then 'wide' else 'narrow' end as source, ord, prompt,
               'Human: ' || prompt || chr(10) || chr(10) || 'Assistant: '
                 || case k when 0 then answer else 'narrow: ' || answer end as chosen,
               'Human: ' || prompt || chr(10) || chr(10) || 'Assistant: '
                 || case when k = 0 and ord % 11 = 0 then '</s>' else '' end
                 || case k when 0 then 'alt: ' || answer else answer end as rejected
        from g""",
    # Policy/reference sequence log-probs per example.
    "v_logps": """
        select event_id as example_id, user_id % 4 as step, -value as pc,
               -(value * 1.1E0 + event_id % 7) as pr,
               -(value * 0.9E0) as rc, -(value * 1.05E0 + event_id % 5) as rr
        from {events}""",
    # Judged comparisons: 1 win, 0.5 tie, 0 loss, null = no label.
    "v_battles": """
        select event_id, user_id, 'm' || cast(user_id % 8 as string) as generator,
               'j' || cast(event_id % 2 as string) as evaluator,
               case event_type when 'click' then 1.0E0 when 'purchase' then 1.0E0
                               when 'view' then 0.0E0 when 'signup' then 0.5E0 end as outcome
        from {events}""",
    # Rank pairs, the higher rank wins (equal ranks are ties).
    "v_prefs": """
        select greatest(l_suppkey % 20, l_partkey % 20) as winner,
               least(l_suppkey % 20, l_partkey % 20) as loser
        from {lineitem}""",
    # Token log-probs in long form: one row per (vec_id, i).
    "v_token_logps": """
        select vec_id as example_id, cast(i as bigint) as pos, -abs(cast(e as double)) as logp,
               case when vec_id % 50 = 0 or i < vec_id % 16 then -100 else cast(i as bigint) + 1 end as label
        from (select vec_id, posexplode(embedding) as (i, e) from {embeddings}) t""",
}

# DuckDB spellings of views whose Spark SQL uses Spark-only generator syntax.
DUCK_VIEWS: dict[str, str] = {
    "v_hh": """
        with s as (
          select conv_id, turn, role, text,
                 chr(10) || chr(10) || case when role = 'user' then 'Human: ' else 'Assistant: ' end || text as said
          from {conversations} where role in ('user', 'assistant')),
        h as (
          select conv_id, turn, role, text,
                 string_agg(said, '') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as past,
                 lag(role) over (partition by conv_id order by turn) as before,
                 min(case when role = 'assistant' then turn end) over (partition by conv_id) as t1,
                 min(turn) over (partition by conv_id) as t0
          from s),
        r as (
          select h.conv_id, h.turn, h.past, h.text, f.text as other, f.turn as other_turn
          from h join s f on f.conv_id = h.conv_id and f.turn = h.t1
          where h.role = 'assistant' and h.before = 'user'),
        q as (select conv_id, turn, past, text, other, other_turn, unnest(list_value(0, 1)) as copy from r)
        select (conv_id * 1000000 + turn) * 2 + copy as ord,
          past || chr(10) || chr(10) || 'Assistant: ' || case when copy = 1 then text || ' [alt]' else text end as chosen,
          past || chr(10) || chr(10) || 'Assistant: ' || case when other_turn = turn then other || ' [first]' else other end as rejected
        from q""",
    "v_token_logps": """
        select vec_id as example_id, cast(i - 1 as bigint) as pos, -abs(cast(embedding[i] as double)) as logp,
               case when vec_id % 50 = 0 or i - 1 < vec_id % 16 then -100 else cast(i as bigint) end as label
        from (select vec_id, embedding, generate_subscripts(embedding, 1) as i from {embeddings}) t""",
}

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def tables_of(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a derived view (base tables bound as parameters)."""
    sql = VIEWS[name]
    args = {t: table(spark, sf_dir, t) for t in tables_of(sql)}
    return spark.sql(sql, args=None, **args)


def duck_sql(name: str) -> str:
    """The same view for DuckDB, where base tables are registered by name."""
    sql = _PLACEHOLDER.sub(lambda m: m.group(1), DUCK_VIEWS.get(name, VIEWS[name]))
    # Spark's select-list generator `explode(array(...))` is `unnest(list_value(...))` in DuckDB.
    return sql.replace("explode(array(", "unnest(list_value(")


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with a WITH clause defining the named views for DuckDB."""
    body = body.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} as ({duck_sql(n)})" for n in names)
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
