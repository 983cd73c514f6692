"""SQL twins of the training-data queries that SQL can state, for DuckDB on the same tables.

They say what a query returns, by plain counting over all windows and all pairs; how it is found is the operators' part.
"""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The two kinds of words.
_WORDS, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rows(table: str, key: str, text: str, pattern: str) -> str:
    return f"select row_number() over () as rid, {key}, regexp_extract_all(coalesce({text}, ''), '{pattern}') as ws from {table}"


def nearest(k: int = 20, every: int = 20) -> str:
    return f"""
with v as (
  select distinct vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, c.vec_id, max(list_inner_product(q.v, c.v)) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % {every} = 0 group by 1, 2)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify rank <= {k}
"""


def suffix_dedup(length: int = 200) -> str:
    return f"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
piece as (select rid, p, substr(h, 2000 * p + 1, 2000 + 2 * {length} - 2) as s from (select rid, h, unnest(range(0, cast(ceil(len(h) / 2000) as bigint))) as p from d)),
win as (select rid, 1000 * p + i as pos, md5(substr(s, 2 * i + 1, 2 * {length})) as w from (select rid, p, s, unnest(range(0, least(1000, len(s) // 2 - {length} + 1))) as i from piece)),
rep as (select rid, pos from win qualify count(*) over (partition by w) > 1),
island as (select rid, pos, sum(new) over (partition by rid order by pos) as k from (select rid, pos, case when pos - lag(pos) over (partition by rid order by pos) <= {length} then 0 else 1 end as new from rep)),
span as (select rid, min(pos) as a, max(pos) + {length} as z from island group by rid, k),
kept as (
  select rid, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' order by a) as h
  from (
    select s.rid, d.h, coalesce(lag(s.z) over (partition by s.rid order by s.a), 0) as a, s.a as z from span s join d using (rid)
    union all select rid, any_value(d.h), max(z), any_value(len(d.h) // 2) from span join d using (rid) group by rid)
  group by rid),
gone as (select rid, sum(z - a) as n_removed, count(*) as n_spans from span group by rid)
select doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join gone using (rid) left join kept using (rid)
"""


def substring_dedup(width: int = 35) -> str:
    return f"""
with d as ({_rows("documents", "doc_id", "text", _WORDS)}),
win as (select rid, i, array_to_string(ws[i : i + {width} - 1], ' ') as w from (select rid, ws, unnest(range(1, len(ws) - {width} + 2)) as i from d)),
rep as (select rid, i from win qualify count(*) over (partition by w) > 1),
gone as (select distinct rid, unnest(range(i, i + {width})) as j from rep),
word as (select rid, unnest(range(1, len(ws) + 1)) as j, unnest(ws) as w from d),
flag as (select word.rid, word.j, w, gone.j is not null as g from word left join gone on gone.rid = word.rid and gone.j = word.j),
edge as (select rid, j, w, g, g and not coalesce(lag(g) over (partition by rid order by j), false) as first from flag),
told as (select rid, count(*) filter (g) as n_removed, count(*) filter (first) as n_spans, string_agg(w, ' ' order by j) filter (not g) as kept from edge group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept, '')) as kept_sha256 from d left join told using (rid)
"""


def contamination(width: int = 10) -> str:
    return f"""
with d as ({_rows("documents", "doc_id", _LOWER.format("text"), _ALNUM)}),
item as ({_rows("benchmark", "cast(item_id as varchar) as item_id", _LOWER.format("text"), _ALNUM)}),
phrase as (select distinct item_id, n, array_to_string(ws[i : i + n - 1], ' ') as w from (select item_id, ws, least(len(ws), {width}) as n, unnest(range(1, len(ws) - least(len(ws), {width}) + 2)) as i from item where len(ws) > 0)),
win as (select rid, n, i, array_to_string(ws[i : i + n - 1], ' ') as w from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from phrase))),
found as (select rid, i, win.n, item_id from win join phrase on phrase.w = win.w and phrase.n = win.n),
hit as (select rid, count(distinct j) as n_hit from (select rid, unnest(range(i, i + n)) as j from found) group by rid),
items as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct rid, item_id from found where item_id is not null) group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join items using (rid)
"""


def shingle_components(n: int = 4, percent: int = 85) -> str:
    return f"""
with recursive d as ({_rows("documents", "doc_id", _LOWER.format("text"), _WORDS)}),
shingle as (
  select distinct rid, array_to_string(ws[i : i + n - 1], ' ') as w
  from (select rid, ws, least(len(ws), {n}) as n, unnest(range(1, len(ws) - least(len(ws), {n}) + 2)) as i from d where len(ws) > 0)),
size as (select rid, count(*) as n from shingle group by rid),
both_ as (select a.rid as a, b.rid as b, count(*) as n from shingle a join shingle b on a.w = b.w and a.rid < b.rid group by 1, 2),
link as (select a, b from both_ join size x on x.rid = a join size y on y.rid = b where 100 * both_.n >= {percent} * (x.n + y.n - both_.n)),
ways as (select a, b from link union all select b, a from link),
reach(a, b) as (select rid, rid from d union select reach.a, ways.b from reach join ways on ways.a = reach.b),
least_ as (select reach.a as rid, min(doc_id) as component_id from reach join d on d.rid = reach.b group by 1)
select doc_id, coalesce(size.n, 0) as n_shingles, component_id from d join least_ using (rid) left join size using (rid)
"""


def hard_negatives(k: int = 5, every: int = 100, percent: int = 80) -> str:
    return f"""
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (
  select a.rid, a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(case when len(a.v) = 0 then 0 else list_inner_product(a.v, b.v) end as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % {every} = 0),
positive as (select rid, other, score, row_number() over (partition by rid order by score desc, other) as k from pair where same qualify k <= {k})
select anchor_id, p.other as positive_id, cast(row_number() over (partition by p.rid, p.k order by n.score desc, n.other) as integer) as rank, n.other as negative_id, p.score as positive_score, n.score as negative_score
from positive p join pair n on n.rid = p.rid and not n.same and {percent} * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= {k}
"""


def resample(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    return f"""
with poly as (select list_transform(range(256), lambda i: list_reduce([i] || list_transform(range(8), lambda x: cast(x as bigint)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
d as ({_rows("documents", "doc_id", _LOWER.format("text"), _ALNUM)}),
b as ({_rows("benchmark", "item_id", _LOWER.format("text"), _ALNUM)}),
word as (select distinct w, hex(encode(w)) as h from (select unnest(ws) as w from d union select unnest(ws) from b)),
crc as (
  select w, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(h), 2), lambda i: cast('0x' || h[i + 1 : i + 2] as bigint)), lambda c, x: xor(c >> 8, t[cast(xor(c & 255, x) as integer) + 1]))) % {buckets} as bucket
  from word, poly),
s as (select bucket, count(*) as n from (select unnest(ws) as w from d) join crc using (w) group by 1),
t as (select bucket, count(*) as n from (select unnest(ws) as w from b) join crc using (w) group by 1),
gain as (
  select bucket, cast(floor(1000 * ln(cast(coalesce(t.n, 0) + 1 as double) * ((select coalesce(sum(n), 0) from s) + {buckets}) / (cast(s.n + 1 as double) * ((select coalesce(sum(n), 0) from t) + {buckets})))) as bigint) as gain
  from s left join t using (bucket)),
weight as (select rid, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from (select rid, unnest(ws) as w from d) join crc using (w) join gain using (bucket) group by rid),
scored as (
  select rid, doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from d left join weight using (rid)),
drawn as (select rid, row_number() over (order by score desc, doc_id nulls last, weight, n_features) as rank from scored where n_features >= {least_words} qualify rank <= {percent} * count(*) over () // 100)
select doc_id, n_features, weight, score, rank from scored left join drawn using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_posting_lists": nearest(),
        "op3_suffix_dedup": suffix_dedup(),
        "op4_substring_dedup": substring_dedup(),
        "op5_phrase_index": contamination(),
        "op9_jaccard_join": shingle_components(),
        "op11_hard_negatives": hard_negatives(),
        "op13_importance_resampling": resample(),
    }
