"""DuckDB SQL for the queries that SQL can express."""

HOST_RULES = r"""
with d as (
  select doc_id, source, coalesce("text", '') as t from documents
), w as (
  select doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         row_number() over () as rid
  from d
), g as (
  select rid, unnest(range(0, greatest(len(words) - 2, 0))) as i, words from w
), g2 as (
  select rid, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] as gram from g
), hit as (
  select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g2) where c >= 2
), cov as (
  select rid, count(distinct p) as n_repeat_words
  from (select rid, unnest([i, i + 1, i + 2]) as p from hit) group by rid
), m as (
  select doc_id, source, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w left join cov using (rid)
), b as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m
), r as (
  select *, (base_failed or 100 * n_symbols > 20 * word_chars or 10 * n_dup_lines > n_words) as rule_failed from b
), h as (
  select source, cast(count(*) as double) as n, cast(count(*) filter (rule_failed) as double) as f
  from r where source is not null group by source
), s as (
  select count(*) as k, sum(n) as n, sum(f) as f, sum(n * n) as nn, sum(f * f / n) as ffn from h
), p as (
  select f / n as mean, case
    when k < 2 or f = 0 or f = n or n - nn / n - (k - 1) <= 0 then 1.0
    else 1 / least(greatest(((ffn - (f / n) * (f / n) * n) - (f / n) * (1 - f / n) * (k - 1))
         / ((f / n) * (1 - f / n) * (n - nn / n - (k - 1))), 1e-4), 0.9999) - 1 end as strength
  from s
), v as (
  select source, (f + mean * strength) / (n + strength) as host_rate, n + strength + 1 as weight, mean from h, p
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not rule_failed and not coalesce(host_rate - 2.0 * mean > 1.645 * sqrt(host_rate * (1 - host_rate) / weight), false)) as kept, round(host_rate, 9) as host_rate
from r left join v on r.source = v.source
"""

CHAT = r"""
with turns as (
  select cast(conv_id as bigint) as c, cast(turn as bigint) as n, coalesce(role, '') as r, coalesce("text", '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered as (
  select *, row_number() over (partition by c order by n nulls first, r, t) as place,
         case when r in ('system', 'user', 'assistant') then r end as known
  from turns
), stated as (
  select *, coalesce(last_value(known ignore nulls) over (partition by c order by place rows between unbounded preceding and 1 preceding), 'none') as before,
         replace(replace(replace(t, '\', '\\'), '###', '\h'), '</turn>', '\e') as escaped,
         replace(replace(replace(replace(r, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') as escaped_role
  from numbered
)
select c as conv_id, count(*) as n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' order by place)) as turns_sha256,
       cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
       sha256(string_agg(case when r = 'assistant' then t else '' end, '' order by place)) as loss_sha256,
       cast(sum(length('### : </turn>') + 1 + length(escaped) + case when known is null then 1 + length(escaped_role) else length(r) end) as bigint) as formatted_chars,
       bool_and((r, before) in (('system', 'none'), ('user', 'none'), ('user', 'system'), ('assistant', 'user'), ('user', 'assistant'))) as in_order
from stated group by c
"""

_URL_PARTS = r"""
  translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) as query
"""
_URL_RULE = r"""case
  when regexp_matches(host, '(^|\.)www\.example\.com$') and starts_with(path, '/en/') then 'www.example.com/en/'
  when regexp_matches(host, '(^|\.)example\.com$') and starts_with(path, '/en/') then 'example.com/en/'
  when regexp_matches(host, '(^|\.)net$') and starts_with(path, '/es/') then 'net/es/'
  when regexp_matches(host, '(^|\.)net$') and starts_with(path, '/fr/') then 'net/fr/'
  when regexp_matches(host, '(^|\.)com$') and starts_with(path, '/') then 'com/' end"""
_BLOCKS = "('example.com/en/', 'net/es/', 'net/fr/')"

URL_RULES = rf"""
with recursive own as (
  select page_id, url, {_URL_PARTS.format(u="coalesce(url, '')")} from pages
), judged as (
  select page_id, host, path, {_URL_RULE} as rule, case when contains(url, '://') then host || path || query end as node from own
), tags as (
  select url as u, unnest([
    list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b') and regexp_matches(x, '(?is)\bhref\s*=\s*["'']?[^"''\s>]'))[1],
    list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') and regexp_matches(x, '(?is)\burl\s*=\s*["'']?[^"''\s>;]'))[1]
  ]) as tag from pages where contains(url, '://')
), targets as (
  select u, case when regexp_matches(tag, '(?i)^<link') then regexp_extract(tag, '(?is).*\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                 else regexp_extract(tag, '(?is).*\burl\s*=\s*["'']?([^"''\s>;]+)', 1) end as t
  from tags where tag is not null
), sites as (
  select u, t, regexp_extract(u, '(?s)^(.*?)://', 1) as scheme, {_URL_PARTS.format(u="u")} from targets
), full_urls as (
  select host || path || query as a,
         case when starts_with(t, '//') then scheme || ':' || t
              when starts_with(t, '/') then scheme || '://' || host || t
              when contains(t, '://') then t
              else scheme || '://' || host || regexp_extract(path, '(?s)^(.*/)?', 0) || t end as v
  from sites
), ends as (
  select a, {_URL_PARTS.format(u="v")} from full_urls where contains(v, '://')
), ties as (
  select distinct a, host || path || query as b from ends where a <> host || path || query
), both_ways as (
  select a, b from ties union select b, a from ties
), reach as (
  select a as node, a as other from both_ways union select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a
), parts as (
  select node, other, {_URL_PARTS.format(u="'x://' || other")} from reach
), named as (
  select node, {_URL_RULE} as rule from parts
), bad as (
  select node from named group by node
  having coalesce(bool_or(rule in {_BLOCKS}), false) and not coalesce(bool_or(rule is not null and rule not in {_BLOCKS}), false)
)
select page_id, host, path, rule,
       case when rule in {_BLOCKS} then 'block' when rule is not null then 'allow' when bad.node is not null then 'block' else 'allow' end as verdict,
       bad.node is not null as alias_blocked
from judged left join bad on judged.node = bad.node
"""

#: crc32 of a text of ASCII characters; ``t`` is its table, computed by rule below.
_CRC = "xor(list_reduce(list_transform(range(1, length({s}) + 1), lambda i: cast(ascii({s}[i]) as bigint)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295)"

CLICK_WINDOWS = rf"""
with recursive table_of as (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, cast(n as bigint))) as t
), rows_of as (
  select click_id, cast(floor(epoch_us(arrived_at) / 3600000000) as bigint) as base_hour,
         concat_ws('|', coalesce(cast(client_id as varchar), ''), coalesce(kind, ''), coalesce(cast(cast(floor(100 * "value" + 0.5) as bigint) as varchar), ''),
                   coalesce(cast(epoch_us(ts) as varchar), ''), coalesce(props, '')) as fields
  from clicks where click_id is not null and arrived_at is not null
), numbered as (
  select *, unnest(range(0, greatest(click_id % 3, 0) + 1)) as j from rows_of
), named as (
  select *, concat(click_id, ':', j) as own from numbered
), coded as (
  select click_id, base_hour, j, fields, {_CRC.format(s="own")} as c from named, table_of
), timed as (
  select click_id, base_hour + 6 * j * (c % 10) as hour, base_hour + 6 * j * (c % 10) + (c // 10) % 200 as l, sha256(concat(fields, '|', c % 3)) as hash from coded
), ends as (
  select min(l) as low, max(l) as high from timed
), dealt as (
  select click_id, hour, hash, (l - low) * 12 // (high - low + 1) as batch from timed, ends
), largest as (
  select b, (select max(hour) from dealt where batch < b) - 48 as boundary from range(1, 13) r(b)
), events as (
  select click_id, hour, hash, batch, row_number() over (partition by click_id order by batch, hour, hash) as k
  from dealt left join largest on b = batch where batch = 0 or hour >= boundary
), steps as (
  select click_id, k, batch, hour as start_hour, hash as first_hash, hash, k as opener from events where k = 1
  union all
  select e.click_id, e.k, e.batch,
         case when e.hour <= s.start_hour + 72 and (e.batch = 0 or s.start_hour + 72 >= m.boundary) then s.start_hour else e.hour end,
         case when e.hour <= s.start_hour + 72 and (e.batch = 0 or s.start_hour + 72 >= m.boundary) then s.first_hash else e.hash end,
         e.hash,
         case when e.hour <= s.start_hour + 72 and (e.batch = 0 or s.start_hour + 72 >= m.boundary) then s.opener else e.k end
  from steps s join events e on e.click_id = s.click_id and e.k = s.k + 1 left join largest m on m.b = e.batch
), marked as (
  select *, hash <> first_hash as conflict from steps
), checked as (
  select *, case when conflict then {_CRC.format(s="hash")} else 0 end as crc from marked, table_of
), windows as (
  select click_id, opener, any_value(start_hour) as start_hour, any_value(first_hash) as hash, min(batch) as opened, count(*) - 1 as n_repeats,
         count(*) filter (conflict) as n_conflicts, sum(crc) as conflict_crc
  from checked group by click_id, opener
), followed as (
  select *, lead(opened) over (partition by click_id order by opener) as next_batch from windows
)
select click_id, start_hour, cast(least(coalesce(next_batch, 11), coalesce((select min(b) - 1 from largest where boundary > start_hour + 72 and b < 12), 11)) as bigint) as closed_batch,
       n_repeats, n_conflicts, cast(conflict_crc as bigint) as conflict_crc, hash
from followed
"""

_FINITE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"

NEAR_VECTORS = rf"""
with recursive numbered as (
  select row_number() over () as r, vec_id, embedding from embeddings
), usable as (
  select r, vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from numbered
  where vec_id is not null and {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0
), normed as (
  select r, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from usable
), links as (
  select a.r as a, b.r as b, b.vec_id as other from normed a join normed b on a.r <> b.r and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) >= 0.95 * a.norm * b.norm
), reach as (
  select a as r, b, other from links union select reach.r, links.b, links.other from reach join links on reach.b = links.a
), least as (
  select r, min(other) as other from reach group by r
), counted as (
  select a as r, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, other) as component_id, vec_id is not distinct from least(vec_id, other) as kept
from numbered left join least using (r) left join counted using (r)
"""


def _lloyd(rounds: int = 2) -> str:
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"near{i} as (select r, p, arg_min(e, d * 64 + e) as e, min(d) as d from (select r, p, e, {apart} as d from parts join books{i} using (p)) group by r, p)")
        if i < rounds:
            steps.append(
                f"means{i} as (select p, e, list(m order by i) as c from (select p, e, i, cast(floor(sum(x[i]) / count(*)) as bigint) as m "
                f"from parts join near{i} using (r, p), unnest(range(1, len(x) + 1)) u(i) group by p, e, i) group by p, e)"
            )
            steps.append(f"books{i + 1} as (select p, e, coalesce(m.c, b.c) as c from books{i} b left join means{i} m using (p, e))")
    return f"""
with kept as (
  select row_number() over () as r, row_number() over (order by vec_id nulls last, embedding) - 1 as place, vec_id, label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where {_FINITE}
), parts as (
  select r, place, vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] as x from kept, range(16) q(p)
), books0 as (
  select p, place as e, x as c from parts where place < 64 and vec_id is not null
), {", ".join(steps)}, coded as (
  select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{rounds} group by r
), named as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from books{rounds}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join coded using (r), named
"""


HEAP_LLOYD = _lloyd()
