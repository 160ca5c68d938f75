"""How the log queries' work is dealt out, and what each of them leaves undone."""

from __future__ import annotations

from tidemark.functions.lineage import dealt
from tidemark.plans import loglines
from tidemark.sources import logs

SMALL = "/root/testdata/sf0.001"


def test_lines_are_dealt_out_however_few_bytes_they_have(spark):
    assert loglines.event_lines(spark, SMALL).rdd.getNumPartitions() == dealt(spark)


def test_quality_follows_no_chains(spark, monkeypatch):
    lines = spark.createDataFrame([("a.jsonl", 1, ' {"type":"user","version":"2"}'), ("a.jsonl", 2, "[1]"), ("a.jsonl", 3, "{broken")], "file string, line int, text string")
    monkeypatch.setattr(logs, "with_chain", lambda events: 1 / 0)
    got = {(r["kind"], r["name"]): r["n"] for r in logs.quality(logs.parse(lines)).collect()}
    assert got == {("lines", "valid"): 1, ("lines", "invalid"): 2, ("version", "2"): 1}


def test_blocks_that_are_no_objects_are_kept_as_empty_ones(spark):
    text = '{"type":"user","message":{"content":["x",{"type":"text","text":"hello","id":7},{"type":"text","text":{"no":1}}]}}'
    row = logs.parse(spark.createDataFrame([("a.jsonl", 1, text)], "file string, line int, text string")).said.select("text", "blocks.type", "blocks.id").first()
    assert row == ('hello\n{"no":1}', ["", "text", "text"], ["", "7", ""])


def test_prompts_and_raw_usage_follow_no_chains(spark, monkeypatch):
    log = logs.parse(loglines.event_lines(spark, SMALL))
    prompts, raw = logs.prompts_of(log).count(), logs.usage_rows(log).count()
    log = logs.Log(lines=log.lines, said=log.said)
    monkeypatch.setattr(logs, "with_chain", lambda events: 1 / 0)
    assert prompts and logs.prompts_of(log).count() == prompts
    assert raw and logs.counted(log.said).count() == raw
