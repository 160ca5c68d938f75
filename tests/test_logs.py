import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans.dataset import Dataset
from tidemark.sources import logs, ratecard, tables


def user(uuid, text, **more):
    return {"type": "user", "uuid": uuid, "message": {"role": "user", "content": text}, **more}


def assistant(uuid, parent, usage, message="m", request="r", content=None, model="Brand#3", **more):
    body = {"id": message, "model": model, "stop_reason": "end_turn", "usage": usage, "content": content or []}
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "requestId": request, "message": body, **more}


def at(minute, hour=10):
    return f"2026-01-05T{hour:02d}:{minute:02d}:00.000Z"


EDIT = {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "/w/app/src/a.py", "old_string": "a\nb", "new_string": "a\nc\nd"}}
READ = {"type": "tool_use", "id": "t2", "name": "Read", "input": {"file_path": "/w/app/lib/b.rs"}}
MAIN = [
    user("u1", "fix the bug please", sessionId="S1", timestamp=at(0), cwd="/w/app", gitBranch="main", version="2.1", promptId="p1", entrypoint="cli"),
    assistant("a1", "u1", {"input_tokens": 10, "output_tokens": 5}, timestamp=at(1), content=[{"type": "text", "text": "one two"}]),
    assistant("a1b", "u1", {"input_tokens": 10, "output_tokens": 20, "cache_creation_input_tokens": 7}, timestamp=at(1), content=[EDIT, READ]),
    {"type": "user", "uuid": "x1", "parentUuid": "a1b", "timestamp": at(2), "message": {"content": [{"type": "tool_result", "tool_use_id": "t2", "content": "fn main ( )"}]}},
    assistant("a2", "x1", {"input_tokens": 1, "cache_read_input_tokens": 100, "cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}, "cache_creation_input_tokens": 7, "server_tool_use": {"web_search_requests": 2, "other": 9}}, message="m2", request="r2", timestamp=at(3)),
    {"type": "mode", "mode": "plan"},
    user("c1", "This session is being continued from a previous conversation that ran out", parentUuid="a2", promptId="pc", timestamp=at(4)),
    assistant("a3", "c1", {"input_tokens": 50, "output_tokens": 2}, message="m3", request="r3", timestamp=at(5)),
    user("u2", [{"type": "text", "text": "and now?"}], timestamp=at(50), promptId="p2", parentUuid="a3"),
    assistant("a4", "u2", {"input_tokens": 4, "output_tokens": 6}, message="m4", request="r4", timestamp=at(51), content=[{"type": "tool_use", "id": "t3", "name": "TodoWrite", "input": {"todos": [{"status": "completed", "content": "old"}, {"status": "in_progress", "content": "ship it"}]}}]),
    assistant("a5", "u2", {"input_tokens": 9}, message="m5", request="r5", timestamp=at(52), isSidechain=True),
    user("i1", "[Request interrupted by user]", timestamp=at(53)),
    user("k1", "<command-name>x</command-name>", timestamp=at(53)),
    user("q1", "hidden", isMeta=True, timestamp=at(53)),
    {"type": "strange"},
]
RESUMED = [
    user("u2r", "and now?", sessionId="S2", timestamp=at(50), cwd="/w/app", promptId="p2"),
    assistant("a4r", "u2r", {"input_tokens": 4, "output_tokens": 6}, message="m4", request="r4", timestamp=at(51)),
    user("u3", "new day", timestamp="2026-01-06T09:00:00Z", promptId="p3", cwd="/w/app"),
    assistant("a6", "u3", {"output_tokens": 8}, message="m6", request="r6", timestamp="2026-01-06T09:01:00Z", model="<synthetic>"),
]
AGENT = [assistant("g1", "", {"input_tokens": 30}, message="m7", request="r7", timestamp=at(20), isSidechain=True, promptId="p1", sessionId="other")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("logs")
    (top / "proj" / "S1" / "subagents").mkdir(parents=True)
    dump = lambda rows: "\n".join(json.dumps(r, ensure_ascii=False) for r in rows)
    (top / "proj" / "a_main.jsonl").write_text("﻿" + dump(MAIN) + "\n\nnot json\n[1, 2]\n", encoding="utf-8")
    (top / "proj" / "b_resumed.jsonl").write_text(dump(RESUMED) + "\r\n", encoding="utf-8")
    (top / "proj" / "S1" / "subagents" / "agent-1.jsonl").write_text(dump(AGENT), encoding="utf-8")
    (top / "proj" / "notes.txt").write_text("no log")
    return str(top)


@pytest.fixture(scope="module")
def log(spark, folder, tmp_path_factory):
    return logs.read(spark, folder).landed(str(tmp_path_factory.mktemp("log")))


@pytest.fixture(scope="module")
def star(log, tmp_path_factory):
    return {k: v.cache() for k, v in logs.star(log, str(tmp_path_factory.mktemp("star"))).items()}


def test_prompts_sessions_and_filtering(log, star):
    prompts = {r.prompt_id: r for r in star["prompts"].collect()}
    assert prompts.keys() == {"p1", "p2", "p3"}
    assert prompts["p1"].session_id == prompts["p2"].session_id == "S1" and prompts["p3"].session_id == "S2"
    assert (prompts["p1"].prompt_index, prompts["p2"].prompt_index) == (1, 2)
    assert (prompts["p1"].mode, prompts["p2"].mode) == ("normal", "plan")
    p = prompts["p1"]
    assert (p.project, p.git_branch, p.model, p.assistant_turns, p.tool_calls, p.final_stop_reason, p.char_count) == ("app", "main", "Brand#3", 2, 2, "end_turn", 18)
    assert prompts["p3"].model == "" and prompts["p2"].prompt_preview == "and now?"
    assert {(r.session_id, r.start_date) for r in star["sessions"].collect()} == {("S1", "2026-01-05"), ("S2", "2026-01-05")}
    found = {(r.kind, r.name): r.n for r in logs.quality(log).collect()}
    assert found[("lines", "invalid")] == 2 and found[("unknown_type", "strange")] == 1 and found[("version", "2.1")] == 1
    assert {k[1]: n for k, n in found.items() if k[0] == "filtered"} == {"compact_continuation": 1, "interrupted": 1, "local_command": 1, "meta": 1}


def test_usage_is_deduplicated_and_attributed(star):
    tokens = {(r.prompt_id, r.token_type, r.is_sidechain): r.token_count for r in star["tokens"].collect()}
    assert tokens[("p1", "input", 0)] == 11 and tokens[("p1", "output", 0)] == 20 and tokens[("p1", "input", 1)] == 30
    assert tokens[("p1", "cache_write_5m", 0)] == 7 + 3 and tokens[("p1", "cache_write_1h", 0)] == 4
    assert tokens[("p1", "server_tool_use", 0)] == 2 and tokens[("p1", "cache_read", 0)] == 100
    assert tokens[("p2", "input", 0)] == 4 and tokens[("p2", "input", 1)] == 9 and tokens[("p3", "output", 0)] == 8
    overhead = {k: v for k, v in tokens.items() if k[0] not in ("p1", "p2", "p3")}
    assert sum(overhead.values()) == 52
    requests = star["requests"].collect()
    assert sum(r.post_compact for r in requests) == 1 and [r.prompt_id for r in requests if r.post_compact] == [next(iter(overhead))[0]]
    sums = {}
    for r in requests:
        sums[r.prompt_id] = sums.get(r.prompt_id, 0) + r.input_tokens + r.output_tokens + r.cache_read_tokens + r.cache_write_5m_tokens + r.cache_write_1h_tokens + r.server_tool_use_requests
    for p, n in sums.items():
        assert n == sum(v for k, v in tokens.items() if k[0] == p)


def test_files_context_and_tasks(star):
    assert [tuple(r) for r in star["output_files"].collect()] == [("p1", "src/a.py", "Python", "code", 1, 2, 1)]
    out = {r.prompt_id: (r.output_prose_tokens, r.output_code_tokens) for r in star["output_tokens"].collect()}
    assert sum(out["p1"]) == 20 and out["p1"][1] == 20 and out["p2"][1] == 6
    sources = {(r.session_id, r.source, r.language, r.path): (r.tokens, r.items) for r in star["context_sources"].collect()}
    assert sources[("S1", "file_read", "Rust", "lib/b.rs")] == (4, 1)
    billed = star["requests"].where("is_sidechain = 0").agg(F.sum("cache_read_tokens"), F.sum("cache_write_5m_tokens"), F.sum("cache_write_1h_tokens")).first()
    spent = star["context_cost"].agg(F.sum("rent_read_tokens"), F.sum("load_write_5m_tokens"), F.sum("load_write_1h_tokens")).first()
    assert tuple(billed) == tuple(spent)
    tasks = {r.task_id: (r.name, r.origin, r.prompts) for r in star["tasks"].collect()}
    assert tasks == {"S1:t01": ("ship it", "todo", 2), "S2:i01": ("new day", "inferred", 1)}
    assert {r.prompt_id for r in star["task_prompts"].collect()} == {"p1", "p2", "p3"}


def test_windows_and_privacy(log, tmp_path):
    later = logs.star(log, str(tmp_path), since="2026-01-06", keep_text=False)
    rows = later["prompts"].collect()
    assert [(r.prompt_id, r.prompt_index, r.prompt_preview) for r in rows] == [("p3", 1, "")] and "prompts_text" not in later
    assert {r.session_id for r in later["sessions"].collect()} == {"S2"}


def test_csv_round_trip(spark, star, tmp_path):
    rows = star["prompts"].withColumn("prompt_preview", F.lit('=1+1, "x"\nline'))
    tables.write_csv(rows, str(tmp_path), "prompts")
    tables.write_csv(star["tokens"], str(tmp_path), "tokens")
    back = tables.read_dataset(spark, str(tmp_path), **ratecard.tables(spark, ratecard.DEMO))
    assert isinstance(back, Dataset) and back.requests.count() == 0
    assert {r.prompt_preview for r in back.prompts.collect()} == {'\'=1+1, "x"\nline'}
    assert sorted(map(tuple, back.tokens.collect())) == sorted(map(tuple, star["tokens"].collect()))
    (tmp_path / "tasks.csv").write_text("wrong,header\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        tables.read_csv(spark, str(tmp_path), "tasks")
    (tmp_path / "output_tokens.csv").write_text("prompt_id,output_prose_tokens,output_code_tokens\np,abc,4\n")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path), "output_tokens").collect()] == [("p", 0, 4)]


def test_quota_rows_and_new_files(spark, folder, tmp_path):
    body = json.dumps({"five_hour": {"utilization": 12.345, "resets_at": "z"}, "extra_usage": {"utilization": 1}, "seven_day": {"utilization": None}, "x": 3})
    found = tables.quota_rows(spark.createDataFrame([("t", body), ("u", "no json")], "snapshot_at string, body string"))
    assert [tuple(r) for r in found.collect()] == [("t", "five_hour", 12.35, "z")]
    tables.append_quota(found, str(tmp_path))
    tables.append_quota(found, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "quota_log")).count() == 2
    none = spark.createDataFrame([], "file string, modified timestamp, size long")
    seen = logs.new_files(spark, folder, none).cache()
    assert seen.count() == 3 and logs.new_files(spark, folder, seen).count() == 0


def test_report_and_exit_codes(spark, log, tmp_path):
    found = logs.Star(log)
    rows = logs.report(found, spark.createDataFrame([("Brand#9",)], "model string"))
    got = {(r.kind, r.name): r.n for r in rows.collect()}
    assert got["size", "files"] == 3 and got["size", "all_prompts"] == 3 and got["size", "usage_records"] - got["size", "duplicates"] == 7
    assert got["unpriced", "Brand#3"] == got["model", "Brand#3"] and got["warning", "unpriced_models"] == 1
    assert got["warning", "invalid_lines"] == 2 and got["warning", "unknown_types"] == 1 and ("warning", "no_prompts") not in got
    assert (logs.exit_code(rows), logs.exit_code(rows, strict=True)) == (0, 1)
    (tmp_path / "a.jsonl").write_text('{"type": "system", "sessionId": "s"}\n')
    silent = logs.report(logs.Star(logs.read(spark, str(tmp_path)).checkpointed()))
    assert {(r.name, r.n) for r in silent.where("kind = 'warning'").collect()} == {("no_prompts", 1)} and logs.exit_code(silent) == 1


def test_ranges_and_clipped_texts(spark):
    from tidemark.functions.text import clipped
    from tidemark.operators.trends import granularity

    days = spark.createDataFrame([("2026-01-01", "2026-02-01"), ("2026-01-01", "2026-02-02"), ("2026-01-01", "2026-07-03"), ("2026-01-01", "2026-07-04")], "a string, b string")
    assert [r[0] for r in days.select(granularity(F.col("a"), F.col("b"))).collect()] == ["day", "week", "week", "month"]
    texts = spark.createDataFrame([(None,), (" a\n\tb  c ",), ("x" * 101,), ("y " * 60,)], "t string")
    assert [r[0] for r in texts.select(clipped(F.col("t"), 100)).collect()] == ["", "a b c", "x" * 100 + "…", ("y " * 50) + "…"]
