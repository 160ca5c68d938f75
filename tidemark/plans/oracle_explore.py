"""DuckDB SQL for the views of usage, for filters and for the audits."""

from __future__ import annotations

from tidemark.operators.audit import STOP_WORDS
from tidemark.operators.explore import CHARACTERS
from tidemark.operators.semantic import PRIME_GRID, TAU_GRID
from tidemark.plans.oracle import EVENTS, ORDERS, ratio, share, usd
from tidemark.plans.oracle_content import CONTEXT, OUTPUT

PIVOT = "1995-06-17"
SIDED = f"""
sided as (select prompt_id, session_id, case when date < '{PIVOT}' then 'before' else 'after' end as side from costed),
side_counts as (select side, count(*) as prompts from sided group by 1),
session_sides as (select distinct session_id, side from sided)"""
BINS = ", ".join(f"({i}, {lo}, {hi if hi is not None else 1 << 60}, '{name}')" for i, (lo, hi, name) in enumerate(CHARACTERS))

#: Tables of a filtered dataset: what each keeps, given kept prompts, sessions and tasks.
COUNTED = ("sessions", "prompts", "tokens", "output_files", "output_tokens", "context_sources", "context_cost")


def counts(sessions: str, prompts: str, tokens: str, context: str) -> str:
    """Rows left in each table; the arguments are conditions on its rows."""
    where = {
        "sessions": sessions, "prompts": prompts, "tokens": tokens, "output_files": "prompt_id in (select prompt_id from kept)",
        "output_tokens": "prompt_id in (select prompt_id from kept)", "context_sources": context, "context_cost": context,
    }
    return " union all ".join(f"select '{t}' as name, count(*) as n from {t} where {where[t]}" for t in COUNTED)


FOLLOWED = counts(
    "session_id in (select session_id from kept)", "prompt_id in (select prompt_id from kept)",
    "prompt_id in (select prompt_id from kept) or (prompt_id not in (select prompt_id from prompts) and session_id in (select session_id from kept))",
    "session_id in (select session_id from kept)",
)
AUDIT = """with counted as (select doc_id % 7 as cluster, coalesce(nullif(source, ''), 'other') as category, count(*) as n from documents group by 1, 2),
tabled as (select *, sum(n) over (partition by cluster)::bigint as size, first_value(category) over (partition by cluster order by n desc, category) as dominant from counted),
crosstab as (select *, n::double / size as share from tabled)"""
def _best(p: int) -> str:
    """The best score and label of a case where evidence weighs ``p`` hundredths."""
    values = {n: f"s_{n}" for n in ("debug", "docs", "test")} | {"ops": f"case when e_ops > 0 then e_ops * {p / 100} end", "plan": "s_plan", "feedback": f"case when e_feedback > 0 then e_feedback * {p / 100} end"}
    best = f"greatest({', '.join(values.values())})"
    return f"{best} as best_{p}, case {' '.join(f"when {x} = {best} then '{n}'" for n, x in values.items())} end as label_{p}"


CASES = f"""with protos as (select ['debug', 'docs', 'plan', 'test'][vec_id % 4 + 1] as category, embedding::double[] as vector from embeddings where vec_id < 16),
cosines as (
  select e.vec_id, category, list_sum(list_reverse_sort(list(list_dot_product(e.embedding::double[], vector)))[:2]) / 2 as score
  from embeddings e cross join protos group by e.vec_id, category),
cases as (
  select vec_id, {", ".join(f"max(score) filter (where category = '{c}') as s_{c}" for c in ("debug", "docs", "plan", "test"))},
         1 - pow(0.4, case when vec_id % 3 = 0 then vec_id % 4 else 0 end) as e_ops, 1 - pow(0.4, case when vec_id % 5 = 0 then vec_id % 3 else 0 end) as e_feedback,
         case when vec_id % 19 = 0 then 'notification' when vec_id % 17 = 0 then 'followup' end as short
  from cosines group by vec_id),
labelled as (select *, {", ".join(_best(round(p * 100)) for p in PRIME_GRID)} from cases)"""
WORD = "[\\p{L}\\p{M}]{3,}"
BAND = """case when {0} is null then null when (select min({0}) = max({0}) from effort) then 3 when cume_dist() over (order by {0}) <= 0.2 then 1 when cume_dist() over (order by {0}) <= 0.4 then 2
  when cume_dist() over (order by {0}) <= 0.6 then 3 when cume_dist() over (order by {0}) <= 0.8 then 4 else 5 end"""

SQL = {
    "type_volume": ORDERS + f""",
each as (select token_type, sum(token_count)::bigint as tokens, coalesce(sum(case when is_sidechain = 1 then units end), 0)::bigint as side from direct group by 1)
select token_type, tokens, case when token_type <> 'server_tool_use' then {share("tokens", "(select sum(tokens) from each where token_type <> 'server_tool_use')")} end as share_pct,
       {usd("side")} as subagent_usd, {share("side", "(select sum(side) from each)")} as subagent_share_pct from each""",
    "box_cap": ORDERS + f""",
boxes as (select coalesce(model, '') as model, {usd("floor(quantile_cont(units, 0.75) * 20 + 0.5) / 20.0")} as q3 from costed group by 1),
cap as (select case when max(q3) > 0 then floor(max(q3) * 125 + 0.5) / 100.0 end as axis_usd from boxes)
select axis_usd, (select count(*) from costed where units::double / 1e8 > axis_usd) as above from cap""",
    "project_pareto": ORDERS + f""",
of_prompt as (select case when p.prompt_id is null then '(session overhead)' else coalesce(nullif(project, ''), '(unknown)') end as project, d.units
  from direct d left join prompts p on d.prompt_id = p.prompt_id),
sums as (select project, sum(units)::bigint as units from of_prompt group by 1 having sum(units) > 0)
select project, {usd("units")} as cost_usd, {share("units", "sum(units) over ()")} as share_pct,
       {share("sum(units) over (order by units desc, project rows between unbounded preceding and current row)", "sum(units) over ()")} as cumulative_pct from sums""",
    "project_sessions": ORDERS + f"""
select coalesce(nullif(project, ''), '(unknown)') as project, d.session_id, {usd("d.units")} as cost_usd
from (select session_id, sum(units)::bigint as units from direct group by 1 having sum(units) > 0) d left join sessions s on d.session_id = s.session_id""",
    "session_sizes": ORDERS + "select prompts, count(*) as sessions from (select session_id, count(*) as prompts from prompts group by 1) group by 1",
    "prompt_lengths": ORDERS + f""",
bins as (select * from (values {BINS}) v(position, lo, hi, characters))
select position, characters, (select count(*) from prompts where char_count >= lo and char_count < hi) as prompts from bins""",
    "session_rollup": ORDERS + f""",
modes as (select *, row_number() over (partition by session_id order by n desc, model) as place from (select session_id, model, count(*) as n from prompts where model is not null group by 1, 2)),
per as (select session_id, count(*) as prompts, min(substr(timestamp, 1, 10)) as day from prompts group by 1),
spent as (select session_id, sum(units)::bigint as units from direct group by 1)
select p.session_id, prompts, day, coalesce(model, '') as model, coalesce(project, '') as project, {usd("coalesce(units, 0)")} as cost_usd
from per p left join modes m on m.session_id = p.session_id and place = 1 left join spent e on e.session_id = p.session_id left join sessions s on s.session_id = p.session_id""",
    "session_timeline": ORDERS + f""",
marked as (select session_id, prompt_id, prompt_index, units, sum(units) over (partition by session_id order by prompt_index, prompt_id rows between unbounded preceding and current row)::bigint as so_far,
  row_number() over (partition by session_id order by prompt_index, prompt_id) as a, row_number() over (partition by session_id order by units desc, prompt_index, prompt_id) as b,
  row_number() over (partition by session_id order by prompt_index desc, prompt_id desc) as c from costed)
select session_id, prompt_id, prompt_index, {usd("units")} as cost_usd, {usd("so_far")} as cumulative_usd,
       concat_ws(',', case when a = 1 then 'first' end, case when b = 1 then 'costliest' end, case when c = 1 then 'last' end) as mark from marked""",
    "edited_by": ORDERS + """
select path, f.prompt_id, f.edits, f.lines_added, f.lines_deleted, case when p.timestamp is null or substr(f.prompt_id, 2)::bigint % 5 = 4 then '' when char_count % 3 = 0 then session_id || ':' || substr(p.timestamp, 1, 4) else 'year ' || substr(p.timestamp, 1, 4) end as task, session_id, prompt_index, coalesce(category, '') as category
from output_files f left join prompts p on f.prompt_id = p.prompt_id left join categories c on f.prompt_id = c.prompt_id""",
    "read_in": ORDERS + f""", {CONTEXT},
both_sides as (
  select path, session_id, items as reads, tokens, 0 as units from context_sources where source = 'file_read'
  union all select path, session_id, 0, 0, rent_units + load_units from context_units where source = 'file_read')
select path, b.session_id, sum(reads)::bigint as reads, sum(tokens)::bigint as tokens, {usd("sum(units)")} as context_usd, coalesce(max(project), '') as project
from both_sides b left join sessions s on b.session_id = s.session_id group by 1, 2""",
    "type_costs": ORDERS + f""", {SIDED},
usage as (
  select s.side, token_type, units from direct d join sided s on d.prompt_id = s.prompt_id
  union all select s.side, token_type, units from direct d join session_sides s on d.session_id = s.session_id where d.prompt_id not in (select prompt_id from prompts)),
sums as (select side, token_type, sum(units)::bigint as units from usage group by 1, 2 having sum(units) > 0)
select side, token_type, {usd("units::double / prompts", 6)} as usd_per_prompt from sums join side_counts using (side)""",
    "language_shares": ORDERS + f""", {SIDED},
sums as (select side, coalesce(nullif(language, ''), '(unknown)') as language, sum(lines_added)::bigint as lines from output_files f join sided s on f.prompt_id = s.prompt_id group by 1, 2 having sum(lines_added) > 0)
select side, language, {share("lines", "sum(lines) over (partition by side)")} as share_pct from sums""",
    "efficiency": ORDERS + f""", {OUTPUT}, {CONTEXT},
split as (select {usd("sum(prose_units)", 6)} as prose, {usd("sum(code_units)", 6)} as code_usd, sum(code)::bigint as code_tokens from output_costs),
lines_of as (select sum(lines_added)::bigint as n, sum(case when kind = 'test' then lines_added end)::bigint as test from output_files),
kept_context as (select sum(rent_units)::bigint as rent, sum(rent_units + load_units)::bigint as total from context_units)
select {ratio("code_usd * 100", "prose + code_usd", 1)} as code_share_pct, {ratio("test * 100", "n", 1)} as test_share_pct, {ratio("rent * 100", "total", 1)} as rent_share_pct,
       {ratio("code_usd", "n", 4)} as cost_per_line_usd, {ratio("code_tokens", "n", 2)} as tokens_per_line from split, lines_of, kept_context""",
    "file_population": ORDERS + f""", {CONTEXT},
all_paths as (select path from output_files union select path from context_sources where source = 'file_read' union select path from context_units where source = 'file_read')
select (select count(*) from all_paths where path not in ('', '-')) as files, (select sum(edits)::bigint from output_files) as edits, (select sum(lines_added)::bigint from output_files) as lines_added,
       (select sum(lines_deleted)::bigint from output_files) as lines_deleted, (select sum(items)::bigint from context_sources where source = 'file_read') as reads,
       (select {usd("sum(rent_units + load_units)")} from context_units where source = 'file_read') as context_usd""",
    "project_filter": ORDERS + ", kept as (select * from prompts where session_id in (select session_id from sessions where project = 'BUILDING')) " + counts(
        "project = 'BUILDING'", "prompt_id in (select prompt_id from kept)", "session_id in (select session_id from sessions where project = 'BUILDING')",
        "session_id in (select session_id from sessions where project = 'BUILDING')"),
    "date_filter": ORDERS + ", kept as (select * from prompts where substr(timestamp, 1, 10) between '1994-01-01' and '1995-12-31') " + FOLLOWED,
    "window_filter": ORDERS + f", kept as (select * from prompts where substr(timestamp, 1, 10)::date between date '{PIVOT}' - 30 and date '{PIVOT}' + 29) " + FOLLOWED,
    "id_filter": ORDERS + ", kept as (select * from prompts where char_count < 300) " + counts(
        "true", "prompt_id in (select prompt_id from kept)", "prompt_id in (select prompt_id from kept)", "true"),
    "all_filters": ORDERS + """,
first as (select p.* from prompts p left join categories c on p.prompt_id = c.prompt_id where substr(timestamp, 1, 10) between '1993-01-01' and '1996-12-31' and project in ('BUILDING', 'MACHINERY', '')
  and (category in ('urgent', 'high') or c.prompt_id is null) and char_count >= 100 and char_count < 2500),
kept as (select * from first where session_id in (select session_id from first group by 1 having count(*) between 2 and 4)) """ + FOLLOWED,
    "select_everything": ORDERS + ", kept as (select * from prompts) " + FOLLOWED,
    "select_most": ORDERS + ", kept as (select * from prompts where project in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')) " + FOLLOWED,
    "semantic_labels": CASES + """
select vec_id, case when short is not null then short when best_60 >= 0.325 then label_60 else 'other' end as label, round(best_60, 6) as score from labelled""",
    "calibration": CASES + f""",
golden as (select *, case when vec_id % 7 = 0 then 'other' when vec_id % 23 <> 0 then case when short is not null then short when best_70 >= 0.3 then label_70 else 'other' end end as gold,
                  case when vec_id % 2 = 0 then 'ops' else 'other' end as judge from labelled),
cells as (
  {" union all ".join(f"select {t}::double as tau, {p}::double as prime, gold, judge, case when short is not null then short when best_{round(p * 100)} >= {t} then label_{round(p * 100)} else 'other' end as found from golden where gold is not null" for p in PRIME_GRID for t in TAU_GRID)}),
grid as (select tau, prime, count(*) as cases, count(*) filter (where found = gold) as hits, count(*) filter (where found = judge) as judge_hits from cells group by 1, 2)
select *, (row_number() over (order by hits desc, judge_hits desc, tau desc, prime) = 1)::integer as chosen from grid""",
    "label_divergences": ORDERS + """,
both_ as (
  select c.prompt_id, case when category = 'low' then 'other' else category end as was, case when complexity < '3' then 'urgent' else category end as now, 'size ' || char_count % 40 as text
  from categories c join prompts p on c.prompt_id = p.prompt_id),
kinds as (
  select *, case when was = 'other' then 'reclassified' else 'contradiction' end as kind from both_ where was <> now and now <> 'other'
  qualify row_number() over (partition by case when was = 'other' then 'reclassified' else 'contradiction' end, text order by prompt_id) = 1)
select kind, (row_number() over (partition by kind order by prompt_id) - 1)::integer as place, text, was, now from kinds qualify place < 12""",
    "date_range": ORDERS + "select min(d) as first, max(d) as last from (select substr(timestamp, 1, 10) as d from prompts union all select substr(start_date, 1, 10) from sessions) where d <> ''",
    "reconciliation": ORDERS + """,
ours as (select model, sum(token_count)::bigint as ours from tokens group by 1),
theirs as (select model, sum(token_count)::bigint as theirs from tokens where is_sidechain = 0 and model <> 'Brand#11' group by 1)
select model, coalesce(ours, 0) as ours, coalesce(theirs, 0) as theirs, coalesce(ours, 0) - coalesce(theirs, 0) as difference from ours full join theirs using (model)""",
    "label_agreement": ORDERS + """
select category as first, case when complexity < '3' then 'urgent' else category end as second, count(*) as n from categories group by 1, 2""",
    "complexity": EVENTS + f""",
effort as (select prompt_id, assistant_turns, tool_calls, char_count, units from costed),
banded as (select prompt_id, {BAND.format("assistant_turns")} as a, {BAND.format("tool_calls")} as b, {BAND.format("char_count")} as c, {BAND.format("units")} as d from effort)
select prompt_id, round_even((a + b + c + d) / 4.0, 0)::integer::varchar as complexity from banded""",
    "audit_table": AUDIT + " select cluster, category, n, size, dominant, share from crosstab",
    "audit_merges": AUDIT.replace("coalesce(nullif(source, ''), 'other')", "'topic' || doc_id % 11 % 4") + " select cluster, string_agg(category, ',' order by n desc, category) as categories from crosstab where category <> 'other' and share >= 0.2 group by 1 having count(*) >= 2",
    "audit_splits": AUDIT + """ select category, count(*) as clusters, round(max(n)::double / sum(n), 6) as top_share from crosstab where category not in ('other', 'followup', 'notification')
group by 1 having sum(n) >= 12 and count(*) >= 3 and max(n)::double / sum(n) < 0.5""",
    "audit_themes": AUDIT + """ select cluster, case when dominant = 'other' and share >= 0.5 then 'latent-other' else 'cross-cutting' end as kind, round(share, 6) as purity from crosstab
where category = dominant and ((dominant = 'other' and share >= 0.5) or share < 0.4)""",
    "top_terms": f"""with words as (select lang as label, unnest(regexp_extract_all(lower(text), '{WORD}')) as term from documents),
counted as (select label, term, count(*) as n from words where term not in ({", ".join(f"'{w}'" for w in STOP_WORDS)}) group by 1, 2),
scored as (select label, term, round(n::double / sum(n) over (partition by label) * ln(1 + (select count(distinct coalesce(lang, '?')) from documents)::double / count(*) over (partition by term)), 9) as score from counted)
select label, rank, term from (select *, row_number() over (partition by label order by score desc, term)::integer as rank from scored) where rank <= 8""",
    "representatives": """with parts as (select label, vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as place from embeddings),
means as (select label, place, sum(round(x::double * 1099511627776)::hugeint)::double / count(*) / 1099511627776 as m from parts group by 1, 2),
centroids as (select label, list(m order by place) as c from means group by 1),
scored as (select e.label, vec_id, round(list_reduce(list_prepend(0.0::double, list_transform(range(1, len(c) + 1), lambda i: embedding[i]::double * c[i])), lambda a, b: a + b), 6) as score
  from embeddings e join centroids t on e.label = t.label)
select label, rank, vec_id from (select *, row_number() over (partition by label order by score desc, vec_id)::integer as rank from scored) where rank <= 3""",
}
