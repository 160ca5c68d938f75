"""DuckDB SQL for totals, trends and request chains."""

from __future__ import annotations

from tidemark.plans.oracle import EVENTS, KINDS, ORDERS, TOKENS, ratio, share, usd

UNKNOWN = "coalesce(nullif({}, ''), '(unknown)')"
PROJECT = """of_project as (
  select t.*, coalesce(nullif(p.project, ''), nullif(s.project, ''), '(unknown)') as project
  from direct t left join prompts p on t.prompt_id = p.prompt_id left join sessions s on t.session_id = s.session_id)"""
BY_PROJECT = f"""{PROJECT},
usage as (select project, sum(units)::bigint as units, {TOKENS} as tokens from of_project group by project),
counts as (select {UNKNOWN.format("project")} as project, count(*) as prompts from prompts group by 1),
by_project as (
  select u.project, coalesce(prompts, 0) as prompts, tokens, {share("tokens", "sum(tokens) over ()")} as token_share_pct, {usd("units")} as cost_usd,
         {share("units", "sum(units) over ()")} as share_pct,
         {share("sum(units) over (order by units desc, u.project rows between unbounded preceding and current row)", "sum(units) over ()")} as cumulative_pct
  from usage u left join counts c on u.project = c.project)"""

SUMMARY_ROWS = [
    ("Sessions", "(select count(*) from sessions)::double"), ("Prompts", "(select count(*) from prompts)::double"),
    ("Projects", "(select count(distinct coalesce(project, '')) from prompts)::double"),
    ("Span days", "(select date_diff('day', min(substr(timestamp, 1, 10))::date, max(substr(timestamp, 1, 10))::date) + 1 from prompts)::double"),
    *((t, f"(select coalesce(sum(token_count), 0) from tokens where token_type = '{t}')::double") for t in (*KINDS, "server_tool_use")),
    ("Total tokens", f"(select {TOKENS} from tokens)::double"),
    ("Cost (direct)", f"(select {usd('sum(units)', 2)} from direct)"),
    ("Subagent cost", f"(select {usd('sum(case when is_sidechain = 1 then units end)', 2)} from direct)"),
    ("Subagent share", f"(select {share('sum(case when is_sidechain = 1 then units end)', 'sum(units)')} from direct)"),
    ("Cost (cloud)", f"(select {usd('sum(units)', 2)} from priced where provider = 'cloud')"),
]
SUMMARY = " union all ".join(f"select {i} as position, '{m}' as metric, {v} as value" for i, (m, v) in enumerate(SUMMARY_ROWS))


def timeline(bucket: str) -> str:
    return ORDERS + f"""
select {bucket} as period, count(*) as prompts, sum(tokens)::bigint as tokens, {usd("sum(units)")} as cost_usd, {share("sum(units)", "sum(sum(units)) over ()")} as share_pct
from costed group by 1"""


def spend(provider: str) -> str:
    return f"""whole as (select sum(units)::bigint as units from priced where provider = '{provider}'),
span as (select coalesce(date_diff('day', min(date)::date, max(date)::date) + 1, 1) as span from costed),
month as (select units, span, units::double * 30 / span as month_units from whole, span)"""


MEDIAN = "quantile_cont({}, 0.5)"
COMPACTED = "compacted as (select * from chain where post_compact = 1 and before_compact = 0)"
FIRST = """firsts as (
  select * from (
    select q.*, p.timestamp as prompt_timestamp, row_number() over (partition by q.session_id order by request_index, q.prompt_id, q.timestamp) as place
    from priced_requests q join prompts p on q.prompt_id = p.prompt_id where is_sidechain = 0 and prompt_index = 1) where place = 1)"""

IMPACT_PARTS = {
    "cost_per_prompt": f"case when prompts > 0 then {usd('units::double / prompts')} end", "output_share": ratio("output_units * 100", "units", 1),
    "context_share": ratio("context_units * 100", "units", 1), "cache_read_per_turn": ratio("reads", "turns", 1), "output_per_prompt": ratio("outputs", "prompts", 1),
    "prompts": "prompts::double", "total_cost": usd("units", 2), "days": "(case when prompts > 0 then span else 0 end)::double",
    "prompts_per_session": ratio("prompts", "sessions", 1), "tasks": "0.0",
}


def impact(pivot: str) -> str:
    metrics = " union all ".join(f"select '{m}' as metric, max(case when side = 'before' then v end) as before, max(case when side = 'after' then v end) as after from (select side, {e} as v from stats)" for m, e in IMPACT_PARTS.items())
    return EVENTS + f""",
sided as (select *, case when date < '{pivot}' then 'before' else 'after' end as side from costed),
usage as (
  select side, sum(d.units)::bigint as units, coalesce(sum(case when token_type = 'output' then d.units end), 0)::bigint as output_units,
         coalesce(sum(case when token_type like 'cache%' then d.units end), 0)::bigint as context_units,
         coalesce(sum(case when token_type = 'cache_read' then token_count end), 0)::bigint as reads, coalesce(sum(case when token_type = 'output' then token_count end), 0)::bigint as outputs
  from sided s join direct d on s.prompt_id = d.prompt_id group by side),
counts as (select side, count(*) as prompts, count(distinct session_id) as sessions, date_diff('day', min(date)::date, max(date)::date) + 1 as span from sided group by side),
turns as (select side, count(*) as turns from sided s join requests q on s.prompt_id = q.prompt_id group by side),
stats as (select * from usage join counts using (side) join turns using (side)),
metrics as ({metrics})
select *, floor((after - before) * 10000 + 0.5) / 10000.0 as change from metrics"""


BAND = "join bands b on prompt_index between lo and hi"
SECONDS = "epoch(strptime({}, '%Y-%m-%dT%H:%M:%SZ'))"

SQL = {
    "summary": ORDERS + SUMMARY,
    "by_project": ORDERS + f", {BY_PROJECT} select * from by_project",
    "by_model": ORDERS + f"""
select {UNKNOWN.format("d.model")} as model, count(distinct p.prompt_id) as prompts,
       {", ".join(f"coalesce(sum(case when token_type = '{k}' then token_count end), 0)::bigint as {k}" for k in KINDS)},
       {usd("coalesce(sum(case when is_sidechain = 1 then units end), 0)")} as subagent_cost_usd, {usd("sum(units)")} as cost_usd, {share("sum(units)", "sum(sum(units)) over ()")} as share_pct
from direct d left join prompts p on d.prompt_id = p.prompt_id group by 1""",
    "by_token_type": ORDERS + f""",
each as (select token_type, sum(token_count)::bigint as tokens, sum(units)::bigint as units from direct group by 1)
select token_type, tokens, case when token_type <> 'server_tool_use' then {share("tokens", "(select sum(tokens) from each where token_type <> 'server_tool_use')")} end as token_share_pct,
       {usd("units")} as cost_usd, {share("units", "(select sum(units) from each)")} as cost_share_pct from each where tokens <> 0
union all select 'TOTAL', sum(case when token_type <> 'server_tool_use' then tokens end)::bigint, 100.0, {usd("sum(units)")}, 100.0 from each""",
    "by_category": ORDERS + f""",
named as (select coalesce(nullif(category, ''), '(uncategorized)') as category, case when regexp_matches(complexity, '^[0-9]+$') then complexity::bigint end as level, units
  from costed p left join categories c on p.prompt_id = c.prompt_id)
select category, count(*) as prompts, {share("count(*)", "sum(count(*)) over ()")} as share_pct, {ratio("sum(level)", "count(level)", 1)} as avg_complexity,
       {usd("quantile_cont(units, 0.5)")} as med_cost_per_prompt_usd, {usd("sum(units)")} as cost_usd, {share("sum(units)", "sum(sum(units)) over ()")} as cost_share_pct
from named group by category""",
    "input_cost": ORDERS + f"select {usd('sum(units)')} as input_cost_usd from direct where token_type = 'input'",
    "top_prompts": ORDERS + f"""
select prompt_id, date, coalesce(project, '') as project, coalesce(model, '') as model, tokens, {usd("units")} as cost_usd, substr(prompt_preview, 1, 80) as preview
from costed order by units desc, prompt_id limit 10""",
    "sessions_table": ORDERS + f""",
usage as (select session_id, sum(units)::bigint as units, {TOKENS} as tokens from direct group by 1),
counts as (select session_id, count(*) as prompts from prompts group by 1)
select u.session_id, coalesce(start_date, '') as start_date, coalesce(project, '') as project, coalesce(prompts, 0) as prompts, tokens, {usd("units")} as cost_usd
from (select * from usage order by units desc, session_id limit 20) u left join counts c on u.session_id = c.session_id left join sessions s on u.session_id = s.session_id""",
    "model_category": ORDERS + f""",
target as (select token_type, rate from rates where provider = 'direct' and model = 'Brand#11' union all select token_type, rate from per_request where provider = 'direct'),
named as (select d.*, coalesce(nullif(category, ''), '(uncategorized)') as category, p.prompt_id as real, token_count * coalesce(g.rate, 0) as again
  from direct d left join categories c on d.prompt_id = c.prompt_id left join prompts p on d.prompt_id = p.prompt_id left join target g on g.token_type = d.token_type)
select {UNKNOWN.format("model")} as model, category, count(distinct real) as prompts, {TOKENS} as tokens, {usd("sum(units)")} as cost_usd,
       {share("sum(units)", "sum(sum(units)) over ()")} as share_pct, {usd("sum(again)")} as repriced_usd, {usd("sum(units)::bigint - sum(again)::bigint")} as saving_usd
from named group by 1, 2""",
    "compare_providers": ORDERS + f"""
select coalesce(m, 'TOTAL') as model, sum(case when provider = 'direct' and token_type <> 'server_tool_use' then token_count else 0 end)::bigint as tokens,
       {usd("sum(case when provider = 'direct' then units else 0 end)")} as cost_direct_usd, {usd("sum(case when provider = 'cloud' then units else 0 end)")} as cost_cloud_usd
from (select *, {UNKNOWN.format("model")} as m from priced) group by rollup (m)
having count(*) filter (where token_type <> 'server_tool_use') > 0""",
    "flat_export": ORDERS + f""",
pivoted as (
  select prompt_id, {", ".join(f"coalesce(sum(case when token_type = '{k}' then token_count end), 0)::bigint as {k}_tokens" for k in KINDS)},
         coalesce(sum(case when token_type = 'server_tool_use' then token_count end), 0)::bigint as server_tool_use_requests, {TOKENS} as total_tokens,
         coalesce(sum(case when is_sidechain = 1 and token_type <> 'server_tool_use' then token_count end), 0)::bigint as subagent_tokens, min(session_id) as sid,
         string_agg(distinct nullif(nullif(model, ''), '<synthetic>'), ', ' order by nullif(nullif(model, ''), '<synthetic>')) as models from tokens group by prompt_id),
spent as (select prompt_id, {usd("sum(case when provider = 'direct' then units else 0 end)", 6)} as cost_direct_usd, {usd("sum(case when provider = 'cloud' then units else 0 end)", 6)} as cost_cloud_usd from priced group by prompt_id),
ids as (select prompt_id from prompts union select prompt_id from pivoted)
select coalesce(p.session_id, v.sid) as session_id, coalesce(s.start_date, '') as session_start_date, coalesce(case when p.prompt_id is null then s.project else p.project end, '') as project,
       coalesce(case when p.prompt_id is null then s.git_branch else p.git_branch end, '') as git_branch, i.prompt_id, coalesce(prompt_index::varchar, '') as prompt_index,
       coalesce(p.timestamp, '') as timestamp, coalesce(case when p.prompt_id is null then v.models else p.model end, '') as model,
       coalesce(case when p.prompt_id is not null then category end, '') as category, coalesce(case when p.prompt_id is not null then complexity end, '') as complexity,
       coalesce(char_count::varchar, '') as char_count, coalesce(assistant_turns::varchar, '') as assistant_turns, coalesce(tool_calls::varchar, '') as tool_calls,
       {", ".join(f"coalesce({c}, 0) as {c}" for c in (*(f"{k}_tokens" for k in KINDS), "server_tool_use_requests", "total_tokens", "subagent_tokens"))},
       coalesce(cost_direct_usd, 0.0) as cost_direct_usd, coalesce(cost_cloud_usd, 0.0) as cost_cloud_usd, coalesce(prompt_preview, '') as prompt_preview
from ids i left join prompts p on i.prompt_id = p.prompt_id left join pivoted v on i.prompt_id = v.prompt_id left join spent e on i.prompt_id = e.prompt_id
left join categories c on i.prompt_id = c.prompt_id left join sessions s on s.session_id = coalesce(p.session_id, v.sid)""",
    "mini_summary": ORDERS + f""", {BY_PROJECT}
select 'provider' as kind, provider as name, {usd("sum(units)", 2)} as cost_usd from priced group by provider
union all select * from (select 'project' as kind, project as name, cost_usd from by_project order by cost_usd desc, project limit 3)""",
    "unpriced_models": ORDERS + """
select model, sum(token_count)::bigint as tokens from tokens where token_type <> 'server_tool_use' and token_count <> 0 and model not in ('', '<synthetic>')
and model not in (select model from rates where provider = 'direct') group by model""",
    "long_context_models": ORDERS + """
select model, sum(token_count)::bigint as tokens from tokens where token_type <> 'server_tool_use' and regexp_matches(model, '\\[[^\\]]*\\]$') group by model""",
    "timeline_day": timeline("date"),
    "timeline_week": timeline("strftime(date_trunc('week', date::date), '%Y-%m-%d')"),
    "timeline_month": timeline("substr(date, 1, 7)"),
    "burn_rate": ORDERS + f""",
weeks as (select strftime(date_trunc('week', date::date), '%Y-%m-%d') as week_of, count(distinct date) as active_days, count(*) as prompts, sum(units)::bigint as units from costed group by 1),
changes as (select *, lag(units) over (order by week_of) as before from weeks)
select week_of, active_days, prompts, {usd("units")} as cost_usd, {usd("units::double / 7")} as per_day_usd, {ratio("(units - before) * 100", "before", 1)} as vs_prev_pct
from changes order by week_of desc limit 8""",
    "break_even": ORDERS + f""", {spend("direct")}
select label as plan, {usd("monthly_units", 2)} as monthly_price_usd, {usd("month_units", 2)} as api_equiv_month_usd, {ratio("month_units", "monthly_units")} as vs_plan,
       {usd("month_units - monthly_units", 2)} as saving_month_usd from plans, month where kind = 'plan'""",
    "bundle_costs": ORDERS + f""", {spend("cloud")}
select label, {usd("monthly_units", 2)} as monthly_usd, {usd("included_units", 2)} as included_usd, {usd("greatest(0.0, month_units - included_units)", 2)} as overage_usd,
       {usd("monthly_units + greatest(0.0, month_units - included_units)", 2)} as total_usd, {usd("month_units", 2)} as usage_month_usd, {usd("units", 2)} as usage_actual_usd, span as span_days
from plans, month where kind = 'bundle'""",
    "impact": impact("2024-01-16"),
    "top_category": ORDERS + """
select category, count(*) as count from prompts join categories using (prompt_id) where category <> '' group by 1 order by 2 desc, 1 limit 1""",
    "peak_quota": ORDERS + "select field, max(utilization_pct) as peak_pct from quota group by field",
    "latest_quota": ORDERS + """
select field, snapshot_at, utilization_pct, resets_at from (select *, row_number() over (partition by field order by snapshot_at desc, utilization_pct desc) as place from quota) where place = 1""",
    "daily_kpis": EVENTS + f""",
days as (select date, count(*) as prompts, sum(tokens)::bigint as tokens, sum(units)::bigint as units from costed group by 1),
calendar as (select strftime(unnest(generate_series((select min(date)::date from days), (select max(date)::date from days), interval 1 day)), '%Y-%m-%d') as date),
filled as (select c.date, coalesce(prompts, 0) as prompts, coalesce(tokens, 0) as tokens, coalesce(units, 0) as units from calendar c left join days d on c.date = d.date),
sums as (select *, sum(units) over (order by date rows between 6 preceding and current row)::bigint as last, sum(units) over (order by date rows between 13 preceding and 7 preceding)::bigint as prior from filled)
select date, prompts, tokens, {usd("units")} as cost_usd, {usd("last")} as last_7_usd, {ratio("(last - prior) * 100", "prior", 1)} as vs_prior_pct from sums""",
    "cost_by_type_month": ORDERS + f"""
select substr(date, 1, 7) as period, {", ".join(usd(f"coalesce(sum(case when token_type = '{k}' then d.units end), 0)") + f" as {k}" for k in KINDS)}
from direct d join costed c on d.prompt_id = c.prompt_id group by 1""",
    "heat_map": EVENTS + f""",
found as (select isodow(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')) - 1 as weekday, hour(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ')) as hour, count(*) as prompts, sum(units)::bigint as units from costed group by 1, 2),
grid as (select (i // 24)::integer as weekday, (i % 24)::integer as hour from range(168) r(i))
select g.weekday, g.hour, coalesce(prompts, 0) as prompts, {usd("coalesce(units, 0)")} as cost_usd from grid g left join found f on g.weekday = f.weekday and g.hour = f.hour""",
    "session_depth": ORDERS + f""",
kinds as (select prompt_id, {", ".join(f"coalesce(sum(case when token_type = '{k}' then token_count end), 0)::bigint as {k}" for k in KINDS if k != "output")} from tokens group by 1),
sums as (
  select band, depth, count(*) as prompts, sum(units)::bigint as units, sum(assistant_turns)::bigint as turns, {", ".join(f"coalesce(sum({k}), 0)::bigint as {k}" for k in KINDS if k != "output")}
  from costed c left join kinds k on c.prompt_id = k.prompt_id {BAND} group by 1, 2),
based as (select *, first_value(units::double / prompts) over (order by band) as base, input + cache_read + cache_write_5m + cache_write_1h as side from sums)
select depth, prompts, {usd("units::double / prompts")} as avg_cost_usd, {ratio("units::double / prompts", "base")} as vs_depth_1,
       case when turns <> 0 then {usd("units::double / turns")} end as cost_per_turn_usd, case when turns <> 0 then floor(cache_read / turns)::bigint end as cache_read_per_turn,
       {share("cache_read", "side")} as cache_read_pct, {share("cache_write_5m", "side")} as cache_write_5m_pct, {share("cache_write_1h", "side")} as cache_write_1h_pct, {share("input", "side")} as fresh_input_pct
from based""",
    "context_growth": EVENTS + f""",
placed as (select q.*, band, depth from priced_requests q join prompts p on q.prompt_id = p.prompt_id {BAND} where is_sidechain = 0),
ranked as (select *, row_number() over (partition by band order by context) as place, count(*) over (partition by band) as n from placed),
p90 as (select band, context as p90_context from ranked where place = round_even((n - 1) * 0.9, 0)::bigint + 1),
sums as (select band, depth, count(*) as requests, floor(quantile_cont(context, 0.5))::bigint as median_context, sum(cache_read_tokens)::bigint as reads, sum(units)::bigint as units from placed group by 1, 2),
based as (select s.*, p90_context, first_value(median_context) over (order by s.band) as base from sums s join p90 using (band))
select depth, requests, median_context, p90_context, (reads // requests)::bigint as cache_read_per_turn, {ratio("median_context", "base")} as vs_depth_1, {usd("units::double / requests")} as cost_per_request_usd from based""",
    "ttl_losses": EVENTS + f""",
gaps as (select *, {SECONDS.format("timestamp")} - {SECONDS.format("before_timestamp")} as seconds from chain where before_timestamp is not null),
bucketed as (select *, case when seconds < 300 then '<= 5m' when seconds < 3600 then '5m-1h' when seconds < 21600 then '1h-6h' else '> 6h' end as gap from gaps where seconds >= 0),
short as (select coalesce(floor(quantile_cont(writes, 0.5)), 0)::bigint as baseline from bucketed where gap = '<= 5m'),
excess as (select b.*, case when baseline = 0 and writes > 0 then write_units when baseline > 0 and writes > baseline then floor(write_units::double * (writes - baseline) / writes)::bigint else 0 end as over from bucketed b, short)
select gap, count(*) as events, (sum(writes)::bigint // count(*))::bigint as avg_write_tokens, {usd("sum(write_units)")} as write_cost_usd, case when gap <> '<= 5m' then {usd("sum(over)")} end as excess_cost_usd
from excess group by gap""",
    "compactions": EVENTS + f""", {COMPACTED}
select timestamp, c.session_id, coalesce(project, '') as project, before_context as context_before, context as context_after, {ratio("(before_context - context) * 100", "before_context", 1)} as reduction_pct,
       writes as rebuild_tokens, {usd("write_units")} as rebuild_cost_usd from compacted c left join sessions s on c.session_id = s.session_id""",
    "session_overhead": EVENTS + f""", {FIRST}
select substr(coalesce(nullif(prompt_timestamp, ''), timestamp), 1, 10) as started, f.session_id, coalesce(project, '') as project, model, context as overhead_tokens, writes as cache_write_tokens, {usd("units")} as first_request_cost_usd
from firsts f left join sessions s on f.session_id = s.session_id""",
    "overhead_notes": EVENTS + f""", {FIRST}
select floor(quantile_cont(context, 0.5))::bigint as median_tokens,
       (array_agg(context order by context))[round_even((count(context) - 1) * 0.1, 0)::bigint + 1]::bigint as p10_tokens,
       (array_agg(context order by context))[round_even((count(context) - 1) * 0.9, 0)::bigint + 1]::bigint as p90_tokens from firsts where context is not null""",
    "recommendations": EVENTS + f""", {COMPACTED}, {FIRST},
base as (select coalesce((select floor(quantile_cont(context, 0.5)) from compacted), (select floor(quantile_cont(context, 0.5)) from firsts), 20000)::bigint as baseline),
long as (select session_id, count(*) as prompts from prompts group by 1 having count(*) > 8),
placed as (select c.*, coalesce(prompt_index, 0) > 4 as late, baseline from chain c join long using (session_id) left join (select prompt_id, prompt_index from prompts) p on c.prompt_id = p.prompt_id cross join base),
sums as (
  select session_id, sum(read_units + write_units)::bigint as rent, sum(case when late then greatest(0, cache_read_tokens - baseline) * read_rate end)::bigint as saved,
         (array_agg(rebuild_rate * baseline order by timestamp, prompt_id, request_index) filter (where late))[1] as rebuild from placed group by 1)
select s.session_id, coalesce(project, '') as project, prompts, {usd("rent")} as rent_usd, {usd("rent - (saved - rebuild)")} as est_compacted_usd, {usd("saved - rebuild")} as saving_usd
from sums s join long using (session_id) left join (select session_id, project from sessions) p on s.session_id = p.session_id where saved is not null""",
    "cost_boxes": ORDERS + f"""
select coalesce(model, '') as model, count(*) as prompts, {", ".join(usd(f"floor(quantile_cont(units, {p}) * 20 + 0.5) / 20.0") + f" as {n}" for n, p in (("p05_usd", 0.05), ("q1_usd", 0.25), ("median_usd", 0.5), ("q3_usd", 0.75), ("p95_usd", 0.95)))}
from costed group by 1""",
    "depth_quantiles": ORDERS + f""",
fine as (select i as lo, i as hi, i::varchar as depth from range(1, 11) r(i) union all select 11, 15, '11-15' union all select 16, 20, '16-20' union all select 21, 1000000000, '21+'),
kinds as (select prompt_id, {", ".join(f"coalesce(sum(case when token_type = '{k}' then token_count end), 0)::bigint as {k}" for k in KINDS)} from tokens group by 1),
long as ({" union all ".join(f"select depth, '{k}' as token_type, coalesce({k}, 0) as n from prompts p left join kinds k on p.prompt_id = k.prompt_id join fine on prompt_index between lo and hi" for k in KINDS)})
select depth, token_type, count(*) as prompts, quantile_cont(n, 0.25) as p25, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.75) as p75 from long group by 1, 2""",
    "main_chain_cache": EVENTS + "select coalesce(sum(read_units + write_units), 0)::bigint as units from priced_requests where is_sidechain = 0",
}
