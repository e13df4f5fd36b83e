"""Bandit/preference-model queries: A16-A18, M12, M13 over ``v_prefs``."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import bt
from prefspark.plans.registry import register
from prefspark.sources.fixtures import view

LR = 0.01
STEPS = 3
BETA = 0.1

_PAIRS_SQL = """p as (select greatest(winner, loser) as w, least(winner, loser) as l, count(*) as n
              from v_prefs group by 1, 2)"""


def _fit_sql(steps: int) -> str:
    parts = [_PAIRS_SQL,
             "tot as (select cast(sum(n) as double) as total from p)",
             "s as (select * from p where w <> l)",
             "items as (select w as item from p union select l from p)",
             "r0 as (select item, cast(0.0 as double) as reward from items)"]
    for k in range(1, steps + 1):
        prev = f"r{k - 1}"
        parts.append(f"""g{k} as (select s.w, s.l, s.n / (1 + exp(rw.reward - rl.reward)) as g
                from s join {prev} rw on rw.item = s.w join {prev} rl on rl.item = s.l)""")
        parts.append(f"""d{k} as (select item, sum(d) as d from (select w as item, -g as d from g{k}
                union all select l as item, g as d from g{k}) z group by item)""")
        parts.append(f"""r{k} as (select r.item, r.reward - {LR} * coalesce(d.d, 0.0) / (select total from tot) as reward
                from {prev} r left join d{k} d on r.item = d.item)""")
    return ",\n    ".join(parts)


def _pairs(spark, sf_dir):
    return bt.aggregate_pairs(view(spark, sf_dir, "v_prefs"))


@register("bt_tally", "A18 M13 D17", views=("v_prefs",), sql=f"""
    with {_PAIRS_SQL}
    select item, cast(sum(wins) as bigint) as wins, cast(sum(losses) as bigint) as losses,
           cast(sum(ties) as bigint) as ties
    from (select w as item, n as wins, 0 as losses, 0 as ties from p where w <> l
          union all select l, 0, n, 0 from p where w <> l
          union all select w, 0, 0, n from p where w = l) z
    group by item""")
def bt_tally(spark, sf_dir):
    t = bt.tally(_pairs(spark, sf_dir))
    return t.select("item", *[F.col(c).cast("bigint").alias(c) for c in ("wins", "losses", "ties")])


@register("bt_fit_3steps", "A17", views=("v_prefs",), sql=f"""
    with {_fit_sql(STEPS)}
    select item, round(reward, 6) as reward from r{STEPS}""")
def bt_fit_3steps(spark, sf_dir):
    r = bt.fit_bradley_terry(_pairs(spark, sf_dir), STEPS, LR)
    return r.select("item", F.round("reward", 6).alias("reward"))


FULL_STEPS = 7500  # those of the reference's notebook


@register("bt_fit_full", "A17 A18", views=("v_prefs",), sql=f"""
    with recursive {_PAIRS_SQL},
    items as (select item, cast(row_number() over (order by item) as integer) as ix
              from (select w as item from p union select l from p)),
    tot as (select cast(sum(n) as double) as total from p),
    around as (select a.ix as i, b.ix as j, 1 as side, n / total as share
               from p join items a on a.item = p.w join items b on b.item = p.l, tot where w <> l
               union all
               select b.ix, a.ix, -1, n / total
               from p join items a on a.item = p.w join items b on b.item = p.l, tot where w <> l),
    adj as (select list(near order by ix) as near from (
              select ix, coalesce(list({{'j': j, 'side': side, 'share': share}}) filter (j is not null), []) as near
              from items left join around on around.i = items.ix group by ix)),
    fit(step, r) as (
      select 0, (select list(cast(0 as double)) from items)
      union all
      select step + 1, list_transform(r, lambda x, i: x + {LR} * coalesce(list_sum(
               list_transform(near[i], lambda a: a.side * a.share / (1 + exp(a.side * (x - r[a.j]))))), 0))
      from fit, adj where step < {FULL_STEPS})
    select item, round(r[ix], 3) as reward from fit, items where step = {FULL_STEPS}""")
def bt_fit_full(spark, sf_dir):
    """A17 to the reference's last step; the SQL takes all 7500 of them."""
    r = bt.fit_to_the_end(_pairs(spark, sf_dir), FULL_STEPS, LR, spans=5)
    return r.select("item", F.round("reward", 3).alias("reward"))


@register("categorical_mle", "A16", views=("v_prefs",), sql="""
    select winner as item, cast(count(*) as bigint) as count,
           round(count(*) / sum(count(*)) over (), 6) as prob
    from v_prefs group by winner""")
def categorical_mle(spark, sf_dir):
    samples = view(spark, sf_dir, "v_prefs").select(F.col("winner").alias("item"))
    m = bt.categorical_mle(samples)
    return m.select("item", "count", F.round("prob", 6).alias("prob"))


@register("kl_tilted_policy", "M12 A16 A17", views=("v_prefs",), sql=f"""
    with {_fit_sql(STEPS)},
    samp as (select winner as item from v_prefs union all select loser from v_prefs),
    pol as (select item, count(*) / sum(count(*)) over () as prob from samp group by item),
    j as (select pol.item, pol.prob, coalesce(r.reward, 0.0) as reward from pol left join r{STEPS} r on pol.item = r.item),
    u as (select *, prob * exp((reward - (select max(reward) from j)) / {BETA}) as u from j)
    select item, round(prob, 6) as prob, round(reward, 6) as reward, round(u / (select sum(u) from u), 6) as tilted
    from u""")
def kl_tilted_policy(spark, sf_dir):
    v = view(spark, sf_dir, "v_prefs")
    samples = v.select(F.col("winner").alias("item")).unionByName(v.select(F.col("loser").alias("item")))
    policy = bt.categorical_mle(samples)
    rewards = bt.fit_bradley_terry(_pairs(spark, sf_dir), STEPS, LR)
    t = bt.kl_tilted(policy, rewards, BETA)
    return t.select("item", *[F.round(c, 6).alias(c) for c in ("prob", "reward", "tilted")])
