"""DuckDB SQL for the ingestion queries: what must come out of the lines of ``loglines``, from the events themselves."""

from __future__ import annotations

from tidemark.plans.oracle import iso

TOKENS = "len(regexp_extract_all({}, '\\w+|[^\\w\\s]'))"

LOG = f"""with recursive
plain as (select event_id as i, user_id as u, event_type as t, value as v, {iso("ts")} as ts from events),
placed as (
  select *, case when t = 'signup' and i % 2 = 0 then '/logs/u' || u || '/subagents/agent-' || u || '.jsonl' else '/logs/u' || u || '.jsonl' end as file, false as copy from plain
  union all select *, '/logs/z' || u || '.jsonl', true from plain where i % 7 = 0),
lines as (
  select *, row_number() over (partition by file order by i) as line, t = 'error' and i % 5 = 0 as invalid, t = 'error' and i % 5 = 2 as is_mode,
         case when copy then 'z' else 'u' end || u as session_id from placed),
linked as (
  select *, not invalid and not is_mode as named,
         last_value(case when not invalid and not is_mode then i end ignore nulls) over w as last, min(case when not invalid and not is_mode then i end) over w as root,
         last_value(case when t = 'view' then i end ignore nulls) over w as call
  from lines window w as (partition by file order by line rows between unbounded preceding and 1 preceding)),
told as (
  select *, case when named then case when i % 10 = 0 then root else last end end as parent, case when named and i % 6 <> 0 then '/w/p' || u % 7 end as own_cwd,
         case when t = 'purchase' and i % 11 <> 0 then 'q' || i end as own,
         case when t = 'purchase' then case i % 9 when 0 then 'meta' when 1 then 'compact_continuation' when 2 then 'local_command' when 3 then 'interrupted' end end as skip,
         t = 'purchase' and i % 9 >= 5 as is_prompt
  from linked where not invalid),
ev as (
  select *, coalesce(own_cwd, first_value(own_cwd ignore nulls) over w, '') as cwd,
         coalesce(last_value(case when is_mode then case when i % 3 = 0 then 'plan' else 'normal' end end ignore nulls) over w, 'normal') as mode
  from told window w as (partition by file order by line rows between unbounded preceding and current row)),
walk(file, line, i, prompt_id, post_compact, after_this) as (
  select file, line, i, coalesce(own, ''), false, coalesce(skip, '') = 'compact_continuation' from ev where parent is null
  union all
  select e.file, e.line, e.i, coalesce(e.own, w.prompt_id), w.after_this, case when e.skip = 'compact_continuation' then true when e.is_prompt then false else w.after_this end
  from ev e join walk w on e.file = w.file and e.parent = w.i),
chained as (select e.*, w.prompt_id, w.post_compact from ev e join walk w using (file, line)),
all_prompts as (
  select * replace (coalesce(own, 'e' || i) as prompt_id), 'order ' || i || ' of u' || u || chr(10) || 'please' as text
  from chained where is_prompt qualify row_number() over (partition by coalesce(own, 'e' || i) order by file, line) = 1),
prompts as (select *, row_number() over (partition by session_id order by ts, file, line) as prompt_index from all_prompts),
calls as (
  select *, 't' || i as id, case i % 8 when 0 then 'Read' when 4 then 'Read' when 1 then 'Edit' when 5 then 'Write' when 2 then 'Bash' when 6 then 'MultiEdit' when 3 then 'TodoWrite'
         else case when i % 3 = 0 then 'TaskUpdate' else 'TaskCreate' end end as name,
         case when i % 9 = 0 then '/other/x.rs' when i % 8 = 5 then '/w/p' || u % 7 || '/tests/f' || i % 4 || '.py' else '/w/p' || u % 7 || '/src/f' || i % 16 || '.py' end as raw
  from chained where t = 'view'),
described as (
  select *, case when i % 9 = 0 then 'Rust' else 'Python' end as language, case when i % 9 <> 0 and i % 8 = 5 then 'test' else 'code' end as kind,
         case when cwd <> '' and starts_with(raw, cwd || '/') then substr(raw, length(cwd) + 2) else regexp_extract(raw, '[^/]*$') end as path
  from calls),
answers as (
  select *, case when i % 9 = 0 then '/other/x.rs' when i % 8 = 5 then '/w/p' || u % 7 || '/tests/f' || i % 4 || '.py' else '/w/p' || u % 7 || '/src/f' || i % 16 || '.py' end as raw,
         case when i % 5 <> 2 and i % 23 <> 0 then 'm' || i // 2 else '' end as mid, case when i % 5 <> 1 and i % 23 <> 0 then 'r' || i // 2 else '' end as rid,
         case when i % 31 = 0 then '<synthetic>' else 'Brand#' || (u % 9 + 1) end as model, case when i % 2 = 1 then 'end' || i % 3 else '' end as stop_reason,
         i % 97 as input, (floor(v * 10) * case when copy and i % 2 = 0 then 2 else 1 end)::bigint as output, floor(v * 1000)::bigint as cache_read,
         case when i % 4 = 0 and i % 13 * 100 + i % 5 * 10 > 0 then i % 13 * 100 else i % 13 * 100 + 1 end as cache_write_5m,
         case when i % 4 = 0 then i % 5 * 10 else 0 end as cache_write_1h, case when i % 29 = 0 then 1 else 0 end as server, (t = 'signup')::integer as is_sidechain,
         i % 5 + 2 as prose
  from chained where t in ('view', 'signup')),
inputs as (
  select *, case i % 8 when 2 then '{{"command":"ls -l"}}'
         when 1 then '{{"file_path":"' || raw || '","old_string":"a\\nb","new_string":"a\\nc\\nd"}}'
         when 5 then '{{"file_path":"' || raw || '","content":"' || repeat('row\\n', (i % 6)::integer) || '"}}'
         when 6 then '{{"file_path":"' || raw || '","edits":[{{"old_string":"a","new_string":"b"}},{{"old_string":"","new_string":"x\\ny"}}]}}'
         when 3 then '{{"todos":[{{"status":"completed","content":"old","activeForm":"x"}},{{"status":"in_progress",' || case when i % 5 <> 0 then '"content":" todo ' || i % 4 || ' ",' else '' end || '"activeForm":"doing it"}}]}}'
         when 7 then case when i % 3 = 0 then '{{"taskId":"1","status":"in_progress"}}' else '{{"subject":"task ' || i || '"}}' end
         else '{{"file_path":"' || raw || '"}}' end as body,
         case when mid <> '' and rid <> '' then mid || ':' || rid when rid <> '' then 'req:' || rid when mid <> '' then 'msg:' || mid else '' end as key,
         input + output + cache_read + cache_write_5m + cache_write_1h + server as size
  from answers),
unique_usage as (
  select *, {TOKENS.format("body")} as code from inputs
  qualify key = '' or row_number() over (partition by key order by size desc, file, line) = 1),
usage as (
  select a.* replace (coalesce(p.session_id, a.session_id) as session_id,
                      case when p.prompt_id is not null or a.prompt_id <> '' then a.prompt_id else coalesce(p.session_id, a.session_id) || ':_continuation' end as prompt_id),
         p.prompt_id is not null as is_real
  from unique_usage a left join all_prompts p on a.prompt_id = p.prompt_id),
requests as (
  select session_id, prompt_id, row_number() over (partition by session_id, prompt_id order by ts, file, line) as request_index, ts as timestamp, model, stop_reason, is_sidechain,
         post_compact::integer as post_compact, input as input_tokens, output as output_tokens, cache_read as cache_read_tokens, cache_write_5m as cache_write_5m_tokens,
         cache_write_1h as cache_write_1h_tokens, server as server_tool_use_requests
  from usage where size > 0),
active as (select session_id from prompts union select session_id from usage where not is_real)
"""

TOKEN_COLUMNS = {
    "input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write_5m": "cache_write_5m_tokens",
    "cache_write_1h": "cache_write_1h_tokens", "server_tool_use": "server_tool_use_requests",
}
KIND = "case when t in ('purchase', 'click') then 'user' when t in ('view', 'signup') then 'assistant' when i % 5 = 1 then 'attachment' when i % 5 = 2 then 'mode' when i % 5 = 3 then 'odd' || i % 3 else 'system' end"

QUALITY = f"""
select 'lines' as kind, case when invalid then 'invalid' else 'valid' end as name, count(*) as n from lines group by 1, 2
union all select 'unknown_type', {KIND}, count(*) from ev where {KIND} like 'odd%' group by 1, 2
union all select 'filtered', skip, count(*) from ev where skip is not null group by 1, 2
union all select 'version', (i % 3)::varchar, count(*) from ev where named group by 1, 2"""

SQL = {
    "log_quality": LOG + QUALITY,
    "log_report": LOG + f""",
models as (select model as name, count(*) as n from requests where model <> '<synthetic>' group by 1),
unpriced as (select * from models where name not in (select p_brand from part where p_brand not like '%7')),
sizes as (
  select 'files' as name, count(distinct file) as n from lines
  union all select 'sessions', count(*) from (select session_id from ev where cwd <> '' and session_id in (select session_id from active) group by session_id)
  union all select 'all_prompts', count(*) from all_prompts union all select 'prompts', count(*) from prompts
  union all select 'usage_records', count(*) from inputs union all select 'duplicates', (select count(*) from inputs) - (select count(*) from unique_usage)
  union all select 'tokens', count(*) from (select session_id, prompt_id, model, token_type, is_sidechain from (
    {" union all ".join(f"select session_id, prompt_id, model, is_sidechain, '{k}' as token_type, {c} as n from requests" for k, c in TOKEN_COLUMNS.items())}) where n <> 0 group by all)
  union all select 'requests', count(*) from requests),
warned as (
  select 'invalid_lines' as name, count(*) as n from lines where invalid union all select 'unknown_types', count(distinct {KIND}) from ev where {KIND} like 'odd%'
  union all select 'unpriced_models', count(*) from unpriced union all select 'no_prompts', case when (select count(*) from all_prompts) = 0 then count(distinct file) else 0 end from lines)
select * from ({QUALITY}) union all select 'model', name, n from models union all select 'unpriced', name, n from unpriced
union all select 'size', name, n from sizes union all select 'warning', name, n from warned where n > 0""",
    "log_events": LOG + f"""
select file, line, {KIND} as type, coalesce(skip, '') as skip, is_prompt::integer as is_prompt, prompt_id, post_compact::integer as post_compact, mode, cwd from chained""",
    "log_prompts": LOG + """,
turns as (
  select prompt_id, count(*) as assistant_turns, arg_min(model, {'a': ts, 'b': file, 'c': line}) filter (where model <> '<synthetic>') as model,
         arg_max(stop_reason, {'a': ts, 'b': file, 'c': line}) filter (where stop_reason <> '') as final_stop_reason
  from usage where is_real and is_sidechain = 0 group by prompt_id),
acts as (select prompt_id, count(*) as tool_calls from (select * from calls qualify row_number() over (partition by id order by file, line) = 1) group by prompt_id)
select session_id, p.prompt_id, prompt_index, ts as timestamp, regexp_extract(cwd, '[^/]*$') as project, cwd, 'b' || u % 3 as git_branch, mode, 'cli' as entrypoint, (i % 3)::varchar as version,
       coalesce(model, '') as model, length(text) as char_count, coalesce(assistant_turns, 0) as assistant_turns, coalesce(tool_calls, 0) as tool_calls,
       coalesce(final_stop_reason, '') as final_stop_reason, replace(text, chr(10), ' ') as prompt_preview
from prompts p left join turns using (prompt_id) left join acts using (prompt_id)""",
    "log_requests": LOG + "select * from requests",
    "log_tokens": LOG + f"""
select session_id, prompt_id, model, token_type, is_sidechain, sum(n)::bigint as token_count from (
  {" union all ".join(f"select session_id, prompt_id, model, is_sidechain, '{k}' as token_type, {c} as n from requests" for k, c in TOKEN_COLUMNS.items())})
where n <> 0 group by all""",
    "log_sessions": LOG + """
select session_id, substr(min(start), 1, 10) as start_date, regexp_extract(min(cwd), '[^/]*$') as project, min(cwd) as cwd, min(branch) as git_branch
from (select session_id, file, min(case when named then ts end) as start, max(nullif(cwd, '')) as cwd, min('b' || u % 3) as branch from ev group by session_id, file)
where session_id in (select session_id from active) group by session_id having min(cwd) is not null""",
    "log_files": LOG + """,
edits as (
  select * from described where name in ('Edit', 'Write', 'MultiEdit') and prompt_id in (select prompt_id from prompts)
  qualify row_number() over (partition by id order by file, line) = 1)
select prompt_id, path, min(language) as language, min(kind) as kind, count(*) as edits,
       sum(case name when 'Edit' then 2 when 'Write' then i % 6 else 3 end)::bigint as lines_added, sum(case name when 'Write' then 0 else 1 end)::bigint as lines_deleted
from edits group by prompt_id, path""",
    "log_output": LOG + """
select prompt_id, sum(p)::bigint as output_prose_tokens, sum(output - p)::bigint as output_code_tokens
from (select prompt_id, output, round_even(output::double * prose / (prose + code), 0)::bigint as p from usage where is_real and output > 0) group by prompt_id""",
    "log_todos": LOG + """,
made as (select file, line, i, row_number() over (partition by file order by line) as task from calls where name = 'TaskCreate'),
labels as (
  select c.*, case when c.name = 'TodoWrite' then case when c.i % 5 <> 0 then 'todo ' || c.i % 4 else 'doing it' end else coalesce('task ' || m.i, '') end as label
  from calls c left join made m on c.name = 'TaskUpdate' and c.file = m.file and m.task = 1 and m.line < c.line
  where c.name in ('TodoWrite', 'TaskUpdate') qualify row_number() over (partition by id order by c.file, c.line) = 1)
select session_id, ts as timestamp, row_number() over (partition by session_id order by file, line) as ordinal, label from labels""",
    "log_context": LOG + f""",
results as (
  select r.session_id, r.file, r.line, r.i, coalesce('t' || case when r.i % 10 = 3 then r.i else r.call end, '') as ref from chained r where t = 'click'),
found as (
  select r.session_id, r.file, r.line, coalesce(nullif(ref, ''), 'e' || r.i) as once, case when d.name = 'Read' then 'file_read' else 'tool_output' end as source,
         case when d.name = 'Read' then d.language else '-' end as language, case when d.name = 'Read' then d.path else '-' end as path, 2 * (r.i % 53) as tokens
  from results r left join described d on r.file = d.file and r.ref = d.id and d.line < r.line
  union all
  select session_id, file, line, 'e' || i, case when i % 2 = 0 then 'file_read' else 'config' end, case when i % 2 = 0 then 'Markdown' else '-' end, case when i % 2 = 0 then 'README.md' else '-' end, 3
  from chained where t = 'error' and i % 5 = 1),
items as (select * from found where tokens > 0 qualify row_number() over (partition by once order by file, line) = 1),
talk as (
  select session_id, {TOKENS.format("text")} as tokens from all_prompts
  union all select session_id, prose + code from usage where is_sidechain = 0)
select session_id, source, language, path, sum(tokens)::bigint as tokens, count(*) as items from items where session_id in (select session_id from active) group by all
union all select session_id, 'conversation', '-', '-', sum(tokens)::bigint, count(*) from talk where session_id in (select session_id from active) group by session_id""",
}
