"""DuckDB SQL for produced files, context, tasks and apportionment."""

from __future__ import annotations

from tidemark.plans.oracle import EVENTS, ORDERS, share, usd

OUTPUT = """
spent as (select prompt_id, sum(units)::bigint as units from direct where token_type = 'output' group by 1),
halves as (
  select o.prompt_id, output_prose_tokens as prose, output_code_tokens as code, coalesce(units, 0) as units from output_tokens o left join spent s on o.prompt_id = s.prompt_id),
proses as (select *, case when prose + code > 0 then floor(units::double * prose / (prose + code) + 0.5)::bigint else units end as prose_units from halves),
output_costs as (select *, units - prose_units as code_units from proses),
churn as (select prompt_id, coalesce(nullif(language, ''), '(unknown)') as language, sum(lines_added + lines_deleted)::bigint as churn from output_files group by 1, 2),
shares as (select *, sum(churn) over (partition by prompt_id) as all_churn from churn),
language_costs as (
  select language, sum(floor(code_units::double * churn / all_churn)::bigint)::bigint as code_units from shares join output_costs using (prompt_id) where all_churn > 0 group by 1),
languages as (
  select coalesce(nullif(f.language, ''), '(unknown)') as language, count(distinct path) as files, sum(lines_added)::bigint as lines_added, sum(lines_deleted)::bigint as lines_deleted,
         coalesce(sum(case when kind = 'test' then lines_added end), 0)::bigint as test from output_files f group by 1),
priced_languages as (select l.*, coalesce(code_units, 0) as code_units from languages l left join language_costs c on l.language = c.language)"""

CONTEXT = """
context_units as (
  select x.*, x.rent_read_tokens * coalesce(r.rate, 0) as rent_units, x.load_write_5m_tokens * coalesce(f.rate, 0) + x.load_write_1h_tokens * coalesce(h.rate, 0) as load_units
  from context_cost x
  left join rates r on r.provider = 'direct' and r.model = x.model and r.token_type = 'cache_read'
  left join rates f on f.provider = 'direct' and f.model = x.model and f.token_type = 'cache_write_5m'
  left join rates h on h.provider = 'direct' and h.model = x.model and h.token_type = 'cache_write_1h')"""

FILES = CONTEXT + """,
sides as (
  select coalesce(p.project, '') as project, path, language, kind, edits, lines_added, lines_deleted, 0 as items, 0 as load_units, 0 as rent_units from output_files o left join prompts p on o.prompt_id = p.prompt_id
  union all select coalesce(s.project, ''), path, language, null, 0, 0, 0, items, 0, 0 from context_sources x left join sessions s on x.session_id = s.session_id where source = 'file_read'
  union all select coalesce(s.project, ''), path, language, null, 0, 0, 0, 0, load_units, rent_units from context_units x left join sessions s on x.session_id = s.session_id where source = 'file_read')"""


def files(keys: str) -> str:
    return f"""
select {keys}, coalesce(min(case when language not in ('', '-') then language end), '-') as language, coalesce(min(kind), 'code') as kind, sum(edits)::bigint as edits,
       sum(lines_added)::bigint as lines_added, sum(lines_deleted)::bigint as lines_deleted, sum(items)::bigint as reads, {usd("sum(load_units)")} as load_usd,
       {usd("sum(rent_units)")} as rent_usd, {usd("sum(load_units) + sum(rent_units)")} as context_usd
from sides where path not in ('', '-') group by {keys}"""


SECONDS = "epoch(strptime({}, '%Y-%m-%dT%H:%M:%SZ'))"
TASKS = f""",
todos as (
  select session_id, timestamp, event_id as ordinal, case when event_id % 6 = 0 then '' else 'todo ' || event_id % 4 end as label
  from rows where event_type = 'click' and user_id % 3 <> 0),
labelled as (select * from todos where label <> ''),
stream as (
  select session_id, {SECONDS.format("timestamp")} as sec, 0 as is_todo, timestamp, prompt_id, null as label, 0 as ordinal from prompts where session_id in (select session_id from labelled)
  union all select session_id, {SECONDS.format("timestamp")}, 1, timestamp, '', label, ordinal from labelled),
turned as (select *, sum(1 - is_todo) over (partition by session_id order by sec, is_todo, timestamp, prompt_id, ordinal rows between unbounded preceding and current row) as turn from stream),
active as (
  select session_id, turn, max(prompt_id) as prompt_id, max(case when is_todo = 0 then timestamp end) as timestamp, max_by(label, ordinal) filter (where is_todo = 1) as active
  from turned group by session_id, turn having sum(1 - is_todo) = 1),
filled as (
  select *, coalesce(last_value(active ignore nulls) over (partition by session_id order by turn rows between unbounded preceding and current row),
                     first_value(active ignore nulls) over (partition by session_id order by turn rows between current row and unbounded following), '') as name from active),
firsts as (select *, min(turn) over (partition by session_id, name) as first_turn from filled),
spine as (select session_id, prompt_id, timestamp, name, dense_rank() over (partition by session_id order by first_turn) as segment, 't' as mark from firsts),
paused as (
  select *, {SECONDS.format("timestamp")} - lag({SECONDS.format("timestamp")}) over (partition by session_id order by timestamp, prompt_id) as pause
  from prompts where session_id not in (select session_id from labelled)),
cut as (select *, 1 + sum(case when pause > 1800 then 1 else 0 end) over (partition by session_id order by timestamp, prompt_id rows between unbounded preceding and current row) as segment from paused),
inferred as (select session_id, prompt_id, timestamp, first_value(prompt_preview) over (partition by session_id, segment order by timestamp, prompt_id) as name, segment, 'i' as mark from cut),
segments as (select * from spine union all select * from inferred),
members as (select *, session_id || ':' || mark || case when segment < 100 then lpad(segment::varchar, 2, '0') else segment::varchar end as task_id from segments),
tasks as (
  select task_id, session_id, name, case when mark = 't' then 'todo' else 'inferred' end as origin, count(*) as prompts, min(timestamp) as first_timestamp, max(timestamp) as last_timestamp
  from members group by task_id, session_id, name, mark)"""

BY_TASK = TASKS + f""",
usage as (select task_id, sum(units)::bigint as units, sum(case when token_type like 'cache%' then units else 0 end)::bigint as context_units from direct join members using (prompt_id) group by 1),
spent as (select prompt_id, sum(units)::bigint as units from direct group by 1),
per_task as (select task_id, category, count(*) as n, coalesce(sum(units), 0)::bigint as units from members join categories using (prompt_id) left join spent using (prompt_id) group by 1, 2),
dominant as (
  select task_id, case when sum(units) > 0 then (array_agg(category order by units desc, category desc))[1] else (array_agg(category order by n desc, category))[1] end as category from per_task group by 1),
ranked as (
  select t.*, coalesce(u.units, 0) as units, coalesce(context_units, 0) as context_units, category, sum(coalesce(u.units, 0)) over () as all_units,
         ({SECONDS.format("last_timestamp")} - {SECONDS.format("first_timestamp")})::bigint as seconds
  from tasks t left join usage u on t.task_id = u.task_id left join dominant d on t.task_id = d.task_id),
by_task as (
  select task_id, substr(coalesce(nullif(name, ''), task_id), 1, 60) as task, origin, prompts,
         case when seconds <= 0 then '<1m' else coalesce(nullif(concat_ws(' ', case when seconds >= 86400 then (seconds // 86400) || 'd' end, case when seconds % 86400 >= 3600 then (seconds % 86400 // 3600) || 'h' end,
                                   case when seconds % 3600 >= 60 then (seconds % 3600 // 60) || 'm' end), ''), '0m') end as duration,
         coalesce(nullif(category, ''), '(uncategorized)') as category, {share("context_units", "units")} as context_pct, {usd("units")} as cost_usd, {share("units", "all_units")} as cost_share_pct
  from ranked order by units desc, task_id limit 20)"""


def split(rows: str, keys: str, order: str, out: str) -> str:
    """CTEs that split ``total`` by ``weight`` within ``keys``: ``out`` has column ``part``."""
    return f"""
{out}_f as (select *, sum(weight) over (partition by {keys}) as w, (total::hugeint * weight) as p from {rows}),
{out}_r as (select *, p // w as f, p % w as r from {out}_f),
{out}_l as (select *, total - sum(f) over (partition by {keys}) as l, row_number() over (partition by {keys} order by r desc, {order}) as rn from {out}_r),
{out} as (select *, (f + case when rn <= l then 1 else 0 end)::bigint as part from {out}_l)"""


APPORTION = f""",
elements as (
  select session_id, prompt_id, event_id as ordinal, case when event_id % 3 = 0 then 'file_read' else 'tool_output' end as source, case when event_id % 3 = 0 then 'Python' else '-' end as language,
         case when event_id % 3 = 0 then 'f' || event_id % 8 else '-' end as path, event_id % 53 as tokens
  from rows where event_type in ('view', 'click') and n % 5 <> 4),
mains as (select *, row_number() over (partition by session_id order by timestamp, event_id) as turn from rows where is_sidechain = 0),
marked as (select *, lag(post_compact) over (partition by session_id order by turn) as previous from mains),
epochs as (select *, sum(case when post_compact = 1 and coalesce(previous, 0) = 0 then 1 else 0 end) over (partition by session_id order by turn rows between unbounded preceding and current row) as epoch from marked),
entry as (select session_id, prompt_id, min(turn) as entered, (array_agg(epoch order by turn))[1] as entry_epoch from epochs group by 1, 2),
pieces as (select e.*, entered, entry_epoch from elements e join entry using (session_id, prompt_id) where tokens > 0),
present as (
  select q.session_id, q.turn, q.model, q.cache_read_tokens as total, source, language, path, sum(tokens)::bigint as weight, min(entered * 1000000000000 + ordinal) as place
  from epochs q join pieces p on q.session_id = p.session_id and q.epoch = p.entry_epoch and p.entered <= q.turn where q.cache_read_tokens > 0 group by all),
{split("(select *, place as first_place from present)", "session_id, turn", "first_place, source, language, path", "rent")},
writes as (
  select session_id, prompt_id, turn, model, '5m' as ttl, cache_write_5m_tokens as total from epochs where cache_write_5m_tokens > 0
  union all select session_id, prompt_id, turn, model, '1h', cache_write_1h_tokens from epochs where cache_write_1h_tokens > 0),
met as (select w.*, ordinal, source, language, path, tokens as weight from writes w join pieces p on w.session_id = p.session_id and w.prompt_id = p.prompt_id),
{split("met", "session_id, turn, ttl", "ordinal, source, language, path", "load")},
attributed as (
  select session_id, source, language, path, model, part as rent_read_tokens, 0 as load_write_5m_tokens, 0 as load_write_1h_tokens from rent
  union all select session_id, source, language, path, model, 0, case when ttl = '5m' then part else 0 end, case when ttl = '1h' then part else 0 end from load
  union all select session_id, '(unattributed)', '-', '-', model, cache_read_tokens, 0, 0 from epochs where cache_read_tokens > 0 and (session_id, turn) not in (select (session_id, turn) from present)
  union all select session_id, '(unattributed)', '-', '-', model, 0, case when ttl = '5m' then total else 0 end, case when ttl = '1h' then total else 0 end
    from writes where (session_id, prompt_id) not in (select (session_id, prompt_id) from pieces)),
context_cost as (
  select session_id, source, language, path, model, sum(rent_read_tokens)::bigint as rent_read_tokens, sum(load_write_5m_tokens)::bigint as load_write_5m_tokens, sum(load_write_1h_tokens)::bigint as load_write_1h_tokens
  from attributed group by 1, 2, 3, 4, 5 having sum(rent_read_tokens) + sum(load_write_5m_tokens) + sum(load_write_1h_tokens) > 0)"""

BY_CONTEXT = f"""
sums as (select source, coalesce(nullif(language, ''), '-') as language, sum(load_units)::bigint as load, sum(rent_units)::bigint as rent, sum(rent_read_tokens)::bigint as rent_tokens,
  sum(load_write_5m_tokens + load_write_1h_tokens)::bigint as load_tokens from context_units group by 1, 2),
listed as (select * from sums where source <> '(unattributed)' or load + rent > 0 union all select 'TOTAL', '-', sum(load), sum(rent), sum(rent_tokens), sum(load_tokens) from sums)
select source, language, load_tokens::bigint as load_tokens, rent_tokens::bigint as rent_tokens, {usd("load")} as load_usd, {usd("rent")} as rent_usd, {usd("load + rent")} as total_usd,
       {share("load + rent", "(select sum(load + rent) from sums)")} as share_pct from listed"""

SQL = {
    "by_output": ORDERS + f""", {OUTPUT},
all_rows as (select *, sum(lines_added) over () as all_added from priced_languages
  union all select 'TOTAL', sum(files), sum(lines_added), sum(lines_deleted), sum(test), sum(code_units), sum(lines_added) from priced_languages)
select language, files::bigint as files, lines_added::bigint as lines_added, lines_deleted::bigint as lines_deleted, {share("test", "lines_added")} as test_pct, {share("lines_added", "all_added")} as share_pct,
       {usd("code_units", 6)} as code_cost_usd from all_rows""",
    "output_split": ORDERS + f""", {OUTPUT}
select sum(prose)::bigint as prose_tokens, sum(code)::bigint as code_tokens, {usd("sum(prose_units)", 6)} as prose_cost_usd, {usd("sum(code_units)", 6)} as code_cost_usd,
       {usd("sum(code_units) - (select sum(code_units) from language_costs)", 6)} as tooling_cost_usd from output_costs""",
    "by_context": ORDERS + f", {CONTEXT}, {BY_CONTEXT}",
    "by_file": ORDERS + f", {FILES} {files('path')}",
    "by_file_project": ORDERS + f", {FILES} {files('project, path')}",
    "file_nodes": ORDERS + f""", {FILES}, listed as ({files("path")}) select * from listed order by context_usd desc, lines_added + lines_deleted desc, path limit 20""",
    "file_graph": ORDERS + f""", {FILES}, listed as ({files("path")}), files as (select * from listed order by context_usd desc, lines_added + lines_deleted desc, path limit 20)
select o.prompt_id, path, coalesce(nullif(category, ''), '(uncategorized)') as category, sum(lines_added + lines_deleted)::bigint as churn
from output_files o left join categories c on o.prompt_id = c.prompt_id where path in (select path from files) group by 1, 2, 3""",
    "context_pareto": ORDERS + f""", {CONTEXT},
sums as (select source, path, sum(rent_read_tokens + load_write_5m_tokens + load_write_1h_tokens)::bigint as tokens, sum(rent_units + load_units)::bigint as units from context_units where source <> '(unattributed)' group by 1, 2)
select source, path, tokens, {usd("units")} as cost_usd, {share("tokens", "sum(tokens) over ()")} as share_pct,
       {share("sum(tokens) over (order by tokens desc, source, path rows between unbounded preceding and current row)", "sum(tokens) over ()")} as cumulative_pct from sums""",
    "tasks": EVENTS + TASKS + " select * from tasks",
    "task_prompts": EVENTS + TASKS + " select task_id, prompt_id from members",
    "by_task": EVENTS + BY_TASK + " select * from by_task",
    "task_graph": EVENTS + BY_TASK + f"""
select task_id, m.prompt_id, coalesce(nullif(c.category, ''), '(uncategorized)') as category, {usd("coalesce(s.units, 0)")} as cost_usd
from members m join by_task using (task_id) left join spent s on m.prompt_id = s.prompt_id left join categories c on m.prompt_id = c.prompt_id""",
    "context_attribution": EVENTS + APPORTION + " select * from context_cost",
    "context_rent": EVENTS + APPORTION + f", {CONTEXT}, {BY_CONTEXT}",
    "context_snapshot": EVENTS + APPORTION + """
select session_id, source, language, path, sum(tokens)::bigint as tokens, count(*) as items from elements group by 1, 2, 3, 4
union all select session_id, 'conversation', '-', '-', sum(input_tokens)::bigint, count(*) from requests where is_sidechain = 0 group by 1""",
}
