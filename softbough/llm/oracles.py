"""DuckDB SQL of the queries that SQL can express, over the same Parquet tables as views."""
from __future__ import annotations

_WHITE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


#: All pairs by their common shingles, then reachability; for tables of thousands of documents.
OP1 = f"""
with recursive words as materialized (
  select doc_id, list_filter(regexp_split_to_array({_low("coalesce(text, '')")}, '{_WHITE}'), lambda x: x <> '') as w from documents where doc_id is not null
), shingles as materialized (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)
), sizes as materialized (select doc_id, count(*) as n from shingles group by 1),
links as materialized (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by 1, 2 having 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), edges as materialized (select a, b from links union select b, a from links),
reach(doc_id, c) as (select doc_id, doc_id from words union select e.b, r.c from reach r join edges e on e.a = r.doc_id)
select r.doc_id, coalesce(any_value(s.n), 0)::BIGINT as n_shingles, min(r.c) as component_id from reach r left join sizes s on s.doc_id = r.doc_id group by 1
"""

#: All windows of 50 words by their text; windows that two documents hold are joined where they touch.
OP2 = f"""
with words as materialized (
  select doc_id, list_filter(regexp_split_to_array({_low("coalesce(text, '')")}, '{_WHITE}'), lambda x: x <> '') as w from documents where doc_id is not null
), windows as materialized (select doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as h from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from words where len(w) >= 50)),
shared as (select h from windows group by 1 having count(distinct doc_id) > 1),
held as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as first from windows where h in (select h from shared)),
numbered as (select doc_id, i, sum(first::INTEGER) over (partition by doc_id order by i) as k from held),
spans as (select doc_id, min(i) as a, max(i) + 50 as b from numbered group by doc_id, k)
select doc_id, count(*)::INTEGER as n_spans, sum(b - a)::BIGINT as n_words, string_agg(a || '-' || b, ',' order by a) as spans from spans group by 1
"""

_SPLIT = f"list_filter(regexp_split_to_array(lower(text), '{_WHITE}'), lambda x: x <> '')"
_DIAGONAL = "partition by doc_id, item_id, shift order by i"

#: Diagonals with enough equal words, and on each the best segment by prefix sums: the sum up to a word less the least sum before it.
OP4 = f"""
with d as materialized (select doc_id, {_SPLIT} as w from documents where doc_id is not null and text is not null),
b as materialized (select distinct item_id, {_SPLIT} as v from benchmark where item_id is not null and text is not null),
items as materialized (select item_id, v, case when len(v) < 10 then len(v) else least(10, (len(v) * 60 + 99) // 100) end as enough from b where len(v) > 0),
dw as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as p from d),
iw as (select item_id, enough, unnest(v) as word, unnest(range(0, len(v))) as q from items),
diagonals as materialized (select doc_id, item_id, p - q as shift, any_value(enough) as enough from dw join iw using (word) group by 1, 2, 3 having count(*) >= any_value(enough)),
places as (select doc_id, item_id, shift, enough, w, v, unnest(range(greatest(0, -shift), least(len(v), len(w) - shift))) as i from diagonals join d using (doc_id) join items using (item_id, enough)),
gains as (select doc_id, item_id, shift, enough, i, case when w[i + shift + 1] = v[i + 1] then 1 else -2 end as g from places),
sums as (select *, sum(g) over ({_DIAGONAL}) as s from gains),
runs as materialized (select *, min(s - g) over ({_DIAGONAL}) as low from sums),
tops as (select doc_id, item_id, shift, enough, max(s - low) as score, arg_min(i, (low - s, i)) as last, arg_min(low, (low - s, i)) as low from runs group by 1, 2, 3, 4),
best as (select t.doc_id, t.item_id, t.shift, t.score, t.last, max(r.i) as first from tops t join runs r on r.doc_id = t.doc_id and r.item_id = t.item_id and r.shift = t.shift and r.i <= t.last and r.s - r.g = t.low where t.score >= t.enough group by all)
select doc_id, item_id, (first + shift)::BIGINT as begin, ((score + 2 * (last - first + 1)) // 3)::BIGINT as matched, (last - first + 1)::BIGINT as length, score::BIGINT as score
from best qualify row_number() over (partition by doc_id, item_id order by score desc, first + shift, (score + 2 * (last - first + 1)) desc) = 1
"""

OP8 = """
with v as materialized (
  select vec_id, embedding::DOUBLE[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::INTEGER as rank, vec_id, score from scored qualify rank <= 20
"""

OP9 = f"""
with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents where doc_id is not null),
lines as materialized (
  select doc_id, i, l[i] as line, {_low(f"regexp_replace(regexp_replace(l[i], '^{_WHITE}', ''), '{_WHITE}$', '')")} as key
  from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from texts)
), shared as (select key, max(doc_id) as top from lines where length(key) >= 40 group by 1 having count(distinct doc_id) >= 5),
marked as (select l.*, s.key is not null and s.top <> l.doc_id as lost from lines l left join shared s on s.key = l.key)
select doc_id, count(*)::BIGINT as n_lines, count(*) filter (lost)::BIGINT as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256 from marked group by 1
"""

_STRENGTH = "(select coalesce(round(1 / least(greatest((round(sum(n * (bad / n - {m}) * (bad / n - {m})), 9) - round(sum({m} * (1 - {m})), 9)) / nullif(round(sum(n * {m} * (1 - {m})), 9) - round(sum({m} * (1 - {m})), 9), 0), 0.01::DOUBLE), 0.1::DOUBLE) - 1, 6), 10) as s from {t} where n > 0)"
_SECOND = "'co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br'"

OP3 = f"""
with rests as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
parsed as materialized (select page_id, {_low("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path from rests),
named as materialized (select *, string_split(host, '.') as names, case when len(names) >= 2 and array_to_string(names[-2:], '.') in ({_SECOND}) then 2 else 1 end as width from parsed),
placed as materialized (select page_id, host, path, array_to_string(names[-width:], '.') as suffix, case when len(names) > width then array_to_string(names[-(width + 1):], '.') else host end as domain from named),
seen as (select page_id, max(1 - quality) as bad from placed join labels on labels.doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint) where quality is not null group by 1),
hosts as materialized (select host, domain, suffix, count(bad) as n, coalesce(sum(bad), 0)::DOUBLE as bad from placed left join seen using (page_id) group by 1, 2, 3),
domains as materialized (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by 1, 2),
suffixes as materialized (select suffix, sum(n) as n, sum(bad) as bad from domains group by 1),
overall as materialized (select round(coalesce(sum(bad) / nullif(sum(n), 0), 0), 9) as m0 from suffixes),
suffixes0 as materialized (select * from suffixes, overall),
suffixes1 as materialized (select suffix, round((bad + s * m0) / (n + s), 9) as m1 from suffixes0, {_STRENGTH.format(m="m0", t="suffixes0")}),
domains1 as materialized (select * from domains join suffixes1 using (suffix)),
domains2 as materialized (select domain, suffix, round((bad + s * m1) / (n + s), 9) as m2 from domains1, {_STRENGTH.format(m="m1", t="domains1")}),
hosts2 as materialized (select * from hosts join domains2 using (domain, suffix)),
rated as (select host, n, s, round((bad + s * m2) / (n + s), 9) as rate from hosts2, {_STRENGTH.format(m="m2", t="hosts2")}),
known as (select host, rate, round(rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)), 9) as low from rated),
ruled as (select *, case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/' when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from placed)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when host <> '' and low > m0 then 'block' else 'allow' end as verdict, rate, low
from ruled left join known using (host), overall
"""

SQL = {"op1_ngram_jaccard_join": OP1, "op2_suffix_array_dedup": OP2, "op3_url_filters": OP3, "op4_benchmark_decontamination": OP4, "op8_block_ann": OP8, "op9_line_dedup": OP9}
