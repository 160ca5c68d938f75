"""DuckDB SQL for the catalogue: the star schema of both datasets as common table expressions, and one query for each name."""

from __future__ import annotations

from tidemark.sources import ratecard

KINDS = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")
REQUEST_COLUMNS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")


def _card() -> str:
    rows = [r for p in ratecard.DEMO["providers"] for r in ratecard.rates(ratecard.DEMO, p)]
    values = ", ".join(f"('{p}', '{kind}', '{key}', '{t}', {rate}::bigint)" for p, kind, key, t, rate in rows)
    plans = ", ".join(f"('{k}', '{label}', '{kind}', {price}::bigint, {included}::bigint)" for k, label, kind, price, included in ratecard.plan_rows(ratecard.DEMO))
    return f"""
card as (select * from (values {values}) v(provider, kind, key, token_type, rate)),
plans as (select * from (values {plans}) v(plan, label, kind, monthly_units, included_units))"""


RESOLVED = """
names as (select distinct model, regexp_replace(model, '\\[[^\\]]*\\]$', '') as bare from (select model from tokens union all select model from requests) where model <> ''),
rates as (
  select provider, model, token_type, max_by(rate, {'e': (kind = 'models')::integer, 'l': length(key)}) as rate
  from names join card on (kind = 'models' and bare = key) or (kind = 'fallbacks' and starts_with(bare, key))
  group by provider, model, token_type),
per_request as (select provider, token_type, rate from card where kind = 'per_request'),
providers as (select distinct provider from card),
priced as (
  select t.*, p.provider, token_count * coalesce(case when t.token_type = 'server_tool_use' then q.rate else r.rate end, 0) as units
  from tokens t cross join providers p
  left join rates r on r.provider = p.provider and r.model = t.model and r.token_type = t.token_type
  left join per_request q on q.provider = p.provider and q.token_type = t.token_type),
direct as (select * from priced where provider = 'direct'),
prompt_costs as (
  select prompt_id, sum(units)::bigint as units, sum(case when token_type <> 'server_tool_use' then token_count else 0 end)::bigint as tokens
  from direct group by prompt_id),
costed as (
  select p.*, coalesce(c.units, 0) as units, coalesce(c.tokens, 0) as tokens, substr(timestamp, 1, 10) as date
  from prompts p left join prompt_costs c on p.prompt_id = c.prompt_id),
bands as (select * from (values (0, 1, 1, '1'), (1, 2, 2, '2'), (2, 3, 3, '3'), (3, 4, 4, '4'), (4, 5, 5, '5'), (5, 6, 10, '6-10'),
  (6, 11, 20, '11-20'), (7, 21, 50, '21-50'), (8, 51, 1000000000, '51+')) v(band, lo, hi, depth)),
priced_requests as (
  select q.*, cache_write_5m_tokens + cache_write_1h_tokens as writes,
         input_tokens + cache_read_tokens + cache_write_5m_tokens + cache_write_1h_tokens as context,
         input_tokens * coalesce(i.rate, 0) + output_tokens * coalesce(o.rate, 0) + cache_read_tokens * coalesce(c.rate, 0)
           + cache_write_5m_tokens * coalesce(f.rate, 0) + cache_write_1h_tokens * coalesce(h.rate, 0) as units,
         cache_write_5m_tokens * coalesce(f.rate, 0) + cache_write_1h_tokens * coalesce(h.rate, 0) as write_units,
         cache_read_tokens * coalesce(c.rate, 0) as read_units, coalesce(c.rate, 0) as read_rate, coalesce(h.rate, 0) as rebuild_rate
  from requests q
  left join rates i on i.provider = 'direct' and i.model = q.model and i.token_type = 'input'
  left join rates o on o.provider = 'direct' and o.model = q.model and o.token_type = 'output'
  left join rates c on c.provider = 'direct' and c.model = q.model and c.token_type = 'cache_read'
  left join rates f on f.provider = 'direct' and f.model = q.model and f.token_type = 'cache_write_5m'
  left join rates h on h.provider = 'direct' and h.model = q.model and h.token_type = 'cache_write_1h'),
chain as (
  select *, lag(timestamp) over w as before_timestamp, lag(context) over w as before_context, coalesce(lag(post_compact) over w, 0) as before_compact
  from priced_requests where is_sidechain = 0 window w as (partition by session_id order by timestamp, prompt_id, request_index))"""


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%SZ')"


ORDERS = f"""with {_card()},
sold as (
  select 'o' || o_orderkey as prompt_id, 'c' || o_custkey as session_id, o_orderkey, {iso("o_orderdate")} as timestamp, o_orderpriority, c_mktsegment as segment
  from orders join customer on o_custkey = c_custkey),
sessions as (
  select session_id, min(timestamp) as start_date, segment as project, '/work' as cwd, 'main' as git_branch from sold group by session_id, segment),
lines as (
  select l.*, p_name, p_type, p_size, p_brand || case when l_partkey % 20 = 0 then '[1m]' else '' end as model from lineitem l join part on l_partkey = p_partkey),
turns as (select l_orderkey, count(*) as assistant_turns, min(model) as model from lines group by l_orderkey),
prompts as (
  select session_id, prompt_id, row_number() over (partition by session_id order by timestamp, o_orderkey) as prompt_index, timestamp,
         case when o_orderkey % 10 = 3 then '' else segment end as project, 'main' as git_branch, model, o_orderkey * 37 % 3000 as char_count,
         coalesce(assistant_turns, 0) as assistant_turns, o_orderkey % 7 as tool_calls, 'order ' || o_orderkey as prompt_preview
  from sold left join turns on o_orderkey = l_orderkey),
owner as (
  select o_orderkey, 'c' || o_custkey as session_id, case when o_orderkey % 50 = 0 then 'c' || o_custkey || ':_continuation' else 'o' || o_orderkey end as prompt_id from orders),
owned as (select l.*, session_id, prompt_id from lines l join owner on l_orderkey = o_orderkey),
tokens as (
  select session_id, prompt_id, model, token_type, is_sidechain, sum(n)::bigint as token_count from (
    select session_id, prompt_id, model, (['input','output','cache_read','cache_write_5m','cache_write_1h','server_tool_use','cache_read'])[l_linenumber] as token_type,
           case when l_linestatus = 'F' then 1 else 0 end as is_sidechain, (case when l_linenumber = 6 then l_quantity else l_quantity * 1000 end)::bigint as n
    from owned) group by all),
categories as (
  select 'o' || o_orderkey as prompt_id, lower(substr(o_orderpriority, 3)) as category, substr(o_orderpriority, 1, 1) as complexity from orders where o_orderkey % 9 <> 4),
output_files as (
  select prompt_id, p_name || '.x' as path, min(p_type) as language, min(case when p_size % 2 = 0 then 'test' else 'code' end) as kind, count(*) as edits,
         sum(l_quantity::bigint)::bigint as lines_added, sum(p_size::bigint % 5)::bigint as lines_deleted
  from owned where l_linenumber <= 3 group by 1, 2),
outputs as (select prompt_id, sum(token_count)::bigint as n from tokens where token_type = 'output' group by prompt_id),
output_tokens as (select prompt_id, n - floor(n / 3)::bigint as output_prose_tokens, floor(n / 3)::bigint as output_code_tokens from outputs),
reads as (
  select *, case when p_size % 4 = 0 then 'tool_output' else 'file_read' end as source, case when p_size % 4 = 0 then '-' else p_name || '.x' end as path,
         case when p_size % 4 = 0 then '-' else p_type end as language, l_quantity::bigint * 10 as size from owned where l_linenumber in (4, 5)),
context_sources as (select session_id, source, language, path, sum(size)::bigint as tokens, count(*) as items from reads group by 1, 2, 3, 4),
context_cost as (
  select session_id, source, language, path, model, sum(size * p_size)::bigint as rent_read_tokens, sum(size)::bigint as load_write_5m_tokens,
         sum(case when l_linenumber = 5 then size else 0 end)::bigint as load_write_1h_tokens from reads group by 1, 2, 3, 4, 5),
requests as (select session_id, prompt_id, 1 as request_index, '' as timestamp, model, 0 as is_sidechain, 0 as post_compact, 0 as input_tokens, 0 as output_tokens,
  0 as cache_read_tokens, 0 as cache_write_5m_tokens, 0 as cache_write_1h_tokens from tokens where false),
quota as (select {iso("ts")} as snapshot_at, 'window_' || user_id % 4 as field, value as utilization_pct, '' as resets_at from events where event_type = 'view'),
{RESOLVED}
"""

EVENTS = f"""with {_card()},
numbered as (
  select *, {iso("ts")} as timestamp from events),
counted as (
  select *, coalesce(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by timestamp, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as n
  from numbered),
rows as (
  select event_id, user_id, event_type, timestamp, 'u' || user_id as session_id, n, 'u' || user_id || ':' || n as prompt_id,
         'Brand#' || (user_id % 9 + 1) || case when event_id % 11 = 0 then '[1m]' else '' end as model,
         case when event_type = 'signup' then 1 else 0 end as is_sidechain, case when event_type = 'error' then 1 else 0 end as post_compact,
         event_id % 97 as input_tokens, floor(value * 10)::bigint as output_tokens, floor(value * 1000)::bigint as cache_read_tokens,
         event_id % 13 * 100 as cache_write_5m_tokens, case when event_id % 5 = 0 then floor(value * 50)::bigint else 0 end as cache_write_1h_tokens,
         case when event_id % 29 = 0 then 1 else 0 end as server_tool_use_requests from counted),
sessions as (select session_id, min(timestamp) as start_date, 'p' || user_id % 7 as project from rows group by session_id, user_id % 7),
per as (
  select session_id, prompt_id, n, 'p' || user_id % 7 as project, min(timestamp) as timestamp, min(model) as model, sum(1 - is_sidechain)::bigint as assistant_turns,
         count(*) filter (where event_type = 'click') as tool_calls, min(event_id) as first_event from rows group by session_id, prompt_id, n, user_id % 7),
prompts as (
  select session_id, prompt_id, n + 1 as prompt_index, timestamp, project, model, first_event * 37 % 3000 as char_count, assistant_turns, tool_calls,
         'stretch ' || prompt_id as prompt_preview from per),
requests as (
  select session_id, prompt_id, row_number() over (partition by prompt_id order by timestamp, event_id) as request_index, timestamp, model, is_sidechain, post_compact,
         input_tokens, output_tokens, cache_read_tokens, cache_write_5m_tokens, cache_write_1h_tokens, server_tool_use_requests from rows),
tokens as (
  select session_id, prompt_id, model, token_type, is_sidechain, sum(n)::bigint as token_count from (
    {" union all ".join(f"select session_id, prompt_id, model, is_sidechain, '{k}' as token_type, {c} as n from requests" for k, c in zip((*KINDS, "server_tool_use"), (*REQUEST_COLUMNS, "server_tool_use_requests"), strict=True))})
  where n <> 0 group by all),
categories as (select prompt_id, 'kind' || n % 3 as category, (n % 5 + 1)::varchar as complexity from per where n % 4 <> 3),
{RESOLVED}
"""


def half_up(x: str, digits: int) -> str:
    return f"floor({x} + 0.5) / {10.0**digits}"


def usd(units: str, digits: int = 4) -> str:
    return half_up(f"({units})::double / {float(10 ** (8 - digits))}", digits)


def ratio(a: str, b: str, digits: int = 2) -> str:
    return f"case when ({b})::double <> 0 then {half_up(f'({a})::double * {float(10**digits)} / ({b})::double', digits)} end"


def share(a: str, b: str) -> str:
    return f"coalesce({ratio(f'({a}) * 100', b, 1)}, 0.0)"


TOKENS = "coalesce(sum(case when token_type <> 'server_tool_use' then token_count end), 0)::bigint"
