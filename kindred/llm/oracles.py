"""DuckDB SQL for the rows of those queries that SQL can express, written apart from the operators' own plans."""

from __future__ import annotations

from kindred.llm.mixing import BLOCK, RANGE, STEP
from kindred.llm.secrets import ACCESS, ASSIGN, BARE, COPIED_OWNERS, COPIED_REPOSITORIES, HEX, LEAST_ASSIGNED

CHAT = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as content from conversations where conv_id is not null),
  p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
  m as (select conv_id, perspective, turn, speaker, content, speaker = perspective as own,
      case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role_,
      case when speaker = 'system' or speaker = perspective then content else speaker || ': ' || content end as shown from t join p using (conv_id)),
  n as (select *, '<|im_start|>' || role_ || chr(10) || shown || '<|im_end|>' || chr(10) as piece from m),
  o as (select *, coalesce(sum(length(piece)) over (partition by conv_id, perspective order by turn nulls first, speaker, content rows between unbounded preceding and 1 preceding), 0)::bigint as before from n)
select conv_id, perspective, count(*) as n_turns, count(*) filter (own) as n_own,
  string_agg(piece, '' order by turn nulls first, speaker, content) as rendered,
  coalesce(string_agg((before + 13 + length(role_)) || ':' || (before + length(piece) - 1), ',' order by turn nulls first, speaker, content) filter (own), '') as mask_spans
from o group by conv_id, perspective
"""

WARC = """
with p as (select page_id, coalesce(html, '') as body from pages),
  g as (select *, case when strlen(body) >= 1000 then max(page_id) over (partition by body) end as last_id from p)
select page_id, strlen(body) as payload_bytes, sha1(body) as payload_digest,
  case when last_id is not null and page_id is distinct from last_id then 'revisit' else 'response' end as record_type,
  case when last_id is not null and page_id is distinct from last_id then last_id end as refers_to from g
"""

VECTORS = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings where label is not null and embedding is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
  links as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
  reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
  least_ as (select a, min(b) as b from reach group by a),
  n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least_.b, vec_id)) as component_id, vec_id <= coalesce(least_.b, vec_id) as kept
from embeddings left join n on n.a = vec_id left join least_ on least_.a = vec_id
"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: int, name: str, pattern: str, group: int) -> str:
    """Spans of a pattern: the text is marked and split, so that every other part is a match, and lengths add up."""
    return f"""s{kind} as (select doc_id, source, string_split(regexp_replace(text, {_sql(pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) as parts, regexp_extract_all(text, {_sql(pattern)}, {group}) as vals from d),
  l{kind} as (select *, list_transform(parts, lambda p: length(p)) as sizes from s{kind}),
  m{kind} as (select doc_id, source, {kind} as kind, '{name}' as name, list_sum(sizes[:2 * i - 1])::bigint as start_, list_sum(sizes[:2 * i])::bigint as end_, vals[i] as val
    from l{kind}, lateral (select unnest(range(1, len(vals) + 1)) as i))"""


SECRETS = f"""
with d as (select doc_id, source, replace(coalesce(text, ''), chr(1), chr(2)) as text from documents),
  {_spans(0, 'assign', ASSIGN, 2)}, {_spans(1, 'access', ACCESS, 0)}, {_spans(2, 'hex', HEX, 0)}, {_spans(3, 'bare', BARE, 0)},
  base as (from m0 where length(val) >= {LEAST_ASSIGNED} union all from m1 union all from m2),
  bare as (from m3 where regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Za-z]')
    and not exists (select 1 from base where base.doc_id = m3.doc_id and base.start_ < m3.end_ and m3.start_ < base.end_)),
  every as (from base union all from bare),
  own as (select val, count(distinct source) + max((source is null)::int) as owners, count(distinct (doc_id, source)) as repositories, max((kind < 3)::int) as keyed from every group by val),
  told as (select *, case when owners >= {COPIED_OWNERS} or repositories >= {COPIED_REPOSITORIES} then 'example' when keyed = 1 then 'live' else 'unknown' end as verdict from every join own using (val)),
  kept as (from told where kind < 3 or verdict = 'live'),
  line as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    coalesce(string_agg(name || ':' || start_ || ':' || end_, ',' order by start_, kind, end_) filter (kind < 3), '') as base_line,
    string_agg(name || ':' || start_ || ':' || end_, ',' order by start_, kind, end_) as spans,
    count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example,
    max(owners) as most_owners, max(repositories) as most_repositories from kept group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_line, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
  coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories from documents left join line using (doc_id)
"""

#: The schedule is worked out slot by slot: point i * STEP mod RANGE falls to the source whose share of the range holds it.
MIXING = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h from documents),
  s as (select source, sum(size)::bigint as source_size from d group by source),
  w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, source_size * 2.0::double as most from s),
  l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level from w),
  t as (select *, max(case when level <= most / weight then level end) over () as top from l),
  g as (select source, source_size, coalesce(least(most, top * weight), most) as target, least(floor(coalesce(least(most, top * weight), most) + 0.5), most)::bigint as goal from t),
  o as (select row_number() over (order by h, doc_id, source) as id, *, (sum(size) over (partition by source order by h, doc_id nulls first, size rows between unbounded preceding and current row) - size)::bigint as start_ from d),
  need as (select source, goal, ceil(goal / {BLOCK}.0)::bigint as need, floor(sum(target) over (order by source nulls last) / sum(target) over () * {RANGE}.0::double)::bigint as high from g where goal > 0),
  share as (select *, coalesce(lag(high) over (order by source nulls last), 0) as low, (sum(need) over ())::bigint as n from need),
  point as (select i as slot, (i % {RANGE}) * {STEP} % {RANGE} as point from range((select coalesce(max(n), 0)::bigint from share)) r(i)),
  rank_ as (select slot, source, need, row_number() over (partition by source order by slot) - 1 as k from point join share on point >= low and point < high),
  own as (select slot, source, k from rank_ where k < need),
  had as (select share.source, need, n, (select count(*) from own where own.source is not distinct from share.source) as had from share),
  plan as (from own union all select n + k as slot, source, k from had, lateral (select unnest(range(had, need)) as k)),
  copy as (select id, o.source, size, start_ + q * source_size as p, goal from o join g on o.source is not distinct from g.source, range(2) r(q) where size > 0 and start_ + q * source_size < goal),
  block as (select id, source, unnest(range(p // {BLOCK}, (least(p + size, goal) - 1) // {BLOCK} + 1)) as k from copy),
  slots as (select id, min(slot) as first_slot, count(*) as n_slots from block join plan on block.source is not distinct from plan.source and block.k = plan.k group by id)
select doc_id, size, source_size, target, (least(size, greatest(0, goal - start_)) + least(size, greatest(0, goal - source_size - start_)))::bigint as taken, first_slot, coalesce(n_slots, 0) as n_slots
from o join g on o.source is not distinct from g.source left join slots using (id)
"""
