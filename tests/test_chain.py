"""Parent chains by pointer jumping against a walk, and line numbers across splits."""

import random

from pyspark.sql import functions as F

from tidemark.sources import logs

SCHEMA = "file string, line int, uuid string, parent string, own_prompt string, is_prompt boolean, skip string"


def walk(rows):
    """{(file, line): (prompt, post_compact)} by reading each file from its first line."""
    out, seen, after = {}, {}, {}
    for file, line, uuid, parent, own, is_prompt, skip in sorted(rows, key=lambda r: (r[0], r[1])):
        prompt, inherited = own or seen.get((file, parent), ""), after.get((file, parent), False)
        if uuid:
            seen[file, uuid] = prompt
            after[file, uuid] = True if skip == "compact_continuation" else False if is_prompt else inherited
        out[file, line] = (prompt, inherited)
    return out


def test_chains_equal_a_walk(spark):
    r = random.Random(1)
    rows = []
    for f in range(6):
        for line in range(1, 200):
            uuid = r.choice(["", f"u{line}", f"u{line}", f"u{line}", f"u{r.randint(1, line)}"])
            parent = r.choice(["", f"u{r.randint(1, 220)}", f"u{max(1, line - 1)}", f"u{max(1, line - 1)}"])
            is_prompt = r.random() < 0.05
            rows.append((f"f{f}", line, uuid, parent, f"p{line}" if is_prompt and r.random() < 0.8 else "", is_prompt, r.choice([None, None, None, None, "meta", "compact_continuation"]) if not is_prompt else None))
    got = logs.with_chain(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(x.file, x.line): (x.prompt_id, x.post_compact) for x in got} == walk(rows) and len(got) == len(rows)
    assert logs.with_chain(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_across_blocks_equal_a_walk_without_rounds_within_a_block(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for line in range(1, 400):
        is_prompt = r.random() < 0.03
        rows.append((r.choice("fg"), line, r.choice(["", f"u{line}", f"u{line}", f"u{r.randint(1, line)}"]), r.choice(["", f"u{r.randint(1, 420)}", f"u{max(1, line - 1)}"]), f"p{line}" if is_prompt else "", is_prompt, None if is_prompt else r.choice([None, None, "compact_continuation"])))
    frame = spark.createDataFrame(rows, SCHEMA)
    for block in (7, 64, 1000):
        monkeypatch.setattr(logs, "BLOCK", block)
        got = logs.with_chain(frame).collect()
        assert {(x.file, x.line): (x.prompt_id, x.post_compact) for x in got} == walk(rows) and len(got) == len(rows)
    monkeypatch.setattr(logs, "parent_lines", None)  # one block needs no joins of parents
    assert logs.with_chain(frame).count() == len(rows)


def test_a_million_events_in_one_file(spark):
    n = 1_000_000
    line = (F.col("id") + 1).cast("int")
    starts = F.col("id") % 250_000 == 0
    rows = spark.range(n).select(
        F.lit("f").alias("file"), line.alias("line"), F.concat(F.lit("u"), line).alias("uuid"), F.concat(F.lit("u"), line - 1).alias("parent"),
        F.when(starts, F.concat(F.lit("p"), line)).otherwise("").alias("own_prompt"), starts.alias("is_prompt"),
        F.when(F.col("id") % 250_000 == 100_000, "compact_continuation").alias("skip"),
    )
    got = logs.with_chain(rows)
    wrong = got.where((F.col("prompt_id") != F.concat(F.lit("p"), F.floor((F.col("line") - 1) / 250_000) * 250_000 + 1)) | (F.col("post_compact") != ((F.col("line") - 1) % 250_000 > 100_000)) & (F.col("line") % 250_000 != 1))
    assert wrong.count() == 0 and got.count() == n


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = [f'{{"n": {i}}}' + "x" * (i % 40) for i in range(5000)]
    (tmp_path / "a.jsonl").write_text("\n".join(text) + "\n\n")
    (tmp_path / "b.jsonl").write_text("one\n \ntwo")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        rows = logs.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 1
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert got == [("a.jsonl", i + 1, t) for i, t in enumerate(text)] + [("b.jsonl", 1, "one"), ("b.jsonl", 2, "two")]
