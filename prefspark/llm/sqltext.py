"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op8_decontamination"] = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), i as (
  select item_id, w, least(10, len(w)) as size from (
    select item_id, coalesce(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark) where len(w) > 0
), iw as (
  select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as win
  from (select *, unnest(range(1, len(w) - size + 2)) as k from i)
), dw as (
  select doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k
        from d, (select distinct size from i) s where len(w) >= size)
), m as (
  select dw.doc_id, dw.k, dw.size, iw.item_id from dw join iw using (size, win)
), hit as (
  select doc_id, count(*) as n_hit
  from (select distinct doc_id, unnest(range(k, k + size)) as p from (select distinct doc_id, k, size from m))
  group by doc_id
), its as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as sha
  from (select distinct doc_id, cast(item_id as varchar) as item from m where item_id is not null) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on hit.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
"""

ORACLES["op7_sharding"] = r"""
with recursive shards as (
  select i, 'shard-' || lpad(cast(i as varchar), 4, '0') as name from range(32) t(i)
), pref as (
  select list(name order by i) as names,
    list(cast('0x' || substr(md5(name), 1, 8) as bigint) % 4093 order by i) as offs,
    list(cast('0x' || substr(md5(name), 9, 8) as bigint) % 4092 + 1 order by i) as skips
  from shards
), fill(step, owner, tried) as (
  select 0, list_transform(range(4093), lambda x: -1), list_transform(range(32), lambda x: 0)
  union all
  select step + 1,
    list_transform(owner, lambda o, i: case when i - 1 = (offs[step % 32 + 1] + free * skips[step % 32 + 1]) % 4093 then step % 32 else o end),
    list_transform(tried, lambda j, i: case when i - 1 = step % 32 then free + 1 else j end)
  from (select step, owner, tried, offs, skips, list_filter(range(tried[step % 32 + 1], 4093),
      lambda j: owner[(offs[step % 32 + 1] + j * skips[step % 32 + 1]) % 4093 + 1] < 0)[1] as free
    from fill, pref where step < 4093)
), done as (select owner from fill where step = 4093)
select doc_id, slot, names[owner[slot + 1] + 1] as shard
from (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % 4093 as slot from documents), done, pref
"""

_HOST = r"coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '')"
_SEGMENT = r"coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1), '')"


def _int(text: str, first: int, modulus: int) -> str:
    return f"cast('0x' || substr(md5({text}), {first}, 6) as integer) % {modulus}"


ORACLES["op5_url_filters"] = f"""
with c as (
  select page_id, url, date '2023-01-01' + cast(page_id % 730 as integer) as fetched_on, {_HOST} as host, {_SEGMENT} as seg
  from pages
), h as (
  select distinct host as h, seg as s, array_to_string(string_split(host, '.')[-2:], '.') as d from c where host <> ''
), e as (
  select h as key, 1 as rank, date '2023-01-01' + {_int("h", 1, 500)} as day from h
  union select h, 3, date '2023-01-01' + ({_int("h", 1, 500)} + 1 + {_int("h", 7, 300)}) from h
  union select d, 1, date '2023-01-01' + {_int("d", 1, 300)} from h
  union select d, 2, date '2023-01-01' + ({_int("d", 1, 300)} + 1 + {_int("d", 7, 300)}) from h
  union select h || '/' || s, 2, date '2023-01-01' + {_int("h || '/' || s", 1, 1000)} from h where s <> ''
), v as (
  select key, day, max(rank) as rank, lead(day) over (partition by key order by day) as upto from e group by key, day
), k as (
  select distinct host, seg, fetched_on, unnest(list_concat(
    [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)],
    case when seg <> '' then [host || '/' || seg] else [] end)) as key
  from c where host <> ''
), f as (
  select host, seg, fetched_on, max(struct_pack(n := length(k.key), key := k.key, rank := rank, day := day)) as m
  from k join v on k.key = v.key and v.day <= fetched_on and (upto is null or fetched_on < upto) and rank < 3
  group by host, seg, fetched_on
)
select page_id, url, c.fetched_on, c.host, case m.rank when 1 then 'blocked' when 2 then 'allowed' else 'unlisted' end as verdict,
  m.key as matched_key, m.day as valid_from
from c left join f on c.host = f.host and c.seg = f.seg and c.fetched_on = f.fetched_on
"""

ORACLES["op11_hard_negatives"] = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as a, c.vec_id as d, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score
  from r a, r c where a.vec_id % 50 = 0 and a.vec_id <> c.vec_id
), p as (
  select a, d as p, score as ps from s where same
  qualify row_number() over (partition by a order by score desc, d) <= 5
), n as (
  select p.a, p.p, p.ps, s.d, s.score, row_number() over (partition by p.a, p.p order by s.score desc, s.d) as rank
  from p join s on p.a = s.a and not s.same and 50 * ps <= 100 * score and 100 * score <= 95 * ps
)
select a as anchor_id, p as positive_id, cast(rank as integer) as rank, d as negative_id, ps as positive_score, score as negative_score
from n where rank <= 3
"""

_FIELDS = ["cast(doc_id as varchar)", "source", "lang", "cast({n} as varchar)", "text"]


def _leaf(n: str) -> str:
    parts = [f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in (x.format(n=n) for x in _FIELDS)]
    return f"sha256({' || '.join(parts)})"


#: CRC-32 of a decimal number, bit by bit (the reflected polynomial is a fixed value).
_CRC = """xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda k: cast(0 as bigint))),
      lambda x, zero: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

ORACLES["op12_merkle"] = f"""
with recursive d as (
  select doc_id, coalesce('=' || lang, '') as grp, {_leaf("n_chars")} as leaf,
    case when {_CRC} % 7 = 0 then {_leaf("cast(n_chars as hugeint) + 1")} end as tampered
  from documents
), l as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by grp) as n from d
), low(lvl, grp, i, h, n) as (
  select 0, grp, i, leaf, n from l
  union all
  select lvl + 1, grp, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from low where n > 1 group by lvl, grp, i // 2, n
), s as (
  select grp, h as subroot, row_number() over (order by encode(grp)) - 1 as i, count(*) over () as n from low where n = 1
), high(lvl, i, h, n) as (
  select 0, i, subroot, n from s
  union all
  select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from high where n > 1 group by lvl, i // 2, n
), step as (
  select l.grp, l.i as leaf_i, 0 as part, a.lvl, b.h, b.i < a.i as before
  from l join low a on a.grp = l.grp and a.i = l.i >> a.lvl and a.n > 1
  left join low b on b.grp = a.grp and b.lvl = a.lvl and b.i = xor(a.i, 1)
  union all
  select l.grp, l.i, 1, a.lvl, b.h, b.i < a.i
  from l join s on s.grp = l.grp join high a on a.i = s.i >> a.lvl and a.n > 1
  left join high b on b.lvl = a.lvl and b.i = xor(a.i, 1)
), path as (
  select grp, leaf_i, string_agg(h, '' order by part, lvl) as siblings,
    list(case when h is null then '.' when before then 'L' || h else 'R' || h end order by part, lvl) as steps
  from step group by grp, leaf_i
), f as (
  select l.doc_id, l.leaf, s.subroot, (select h from high where n = 1) as root, sha256(coalesce(siblings, '')) as proof_sha256,
    list_reduce(list_concat([coalesce(l.tampered, l.leaf)], coalesce(steps, [])),
      lambda x, y: case when y = '.' then sha256(x) when y[1] = 'L' then sha256(y[2:] || x) else sha256(x || y[2:]) end) as folded_root
  from l join s on s.grp = l.grp left join path on path.grp = l.grp and path.leaf_i = l.i
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from f
"""

ORACLES["op13_jaccard_join"] = r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), g as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[k:k + 3], ' ') for k in range(1, len(w) - 2)] end) as g from d
), n as (
  select doc_id, count(*) as n from g group by doc_id
), o as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
), e as (
  select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 85 * (p.n + q.n - shared)
), r(a, b) as (
  select a, b from e union select r.a, e.b from r join e on r.b = e.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id, coalesce(k.n, 0) as n_links
from d left join n on n.doc_id = d.doc_id
left join (select a, min(b) as least from r group by a) c on c.a = d.doc_id
left join (select a, count(*) as n from e group by a) k on k.a = d.doc_id
"""
