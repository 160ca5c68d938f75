import random

from pyspark.sql import functions as F

from tidemark.operators import apportion, audit, content, filters, tasks, totals, trends
from tidemark.plans import catalogue
from tidemark.plans.adapter import orders_dataset
from tidemark.plans.dataset import Dataset
from tidemark.sources import ratecard, store, tables
from tidemark.streaming import usage

SF = "/root/testdata/sf0.001"


def test_every_query_has_a_name_and_columns(spark):
    known, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) == set(known) - {"intents", "clusters"}
    assert all(known[n](spark, SF).columns for n in ("by_project", "box_cap", "all_filters", "intents"))


def test_both_sides_of_a_day_sum_to_the_whole(spark):
    ds = orders_dataset(spark, SF)
    before, after = filters.split_on_pivot(ds, "1995-06-17")
    assert before.prompts.count() + after.prompts.count() == ds.prompts.count()
    rows = {r.metric: r for r in trends.impact(ds, "direct", "1995-06-17").collect()}
    assert rows["prompts"].before == before.prompts.count() and rows["prompts"].after == after.prompts.count()
    one = trends.side_stats(before, "direct", "9999-01-01").first()
    assert (one.total_cost, one.output_share) == (rows["total_cost"].before, rows["output_share"].before)
    none = {r.metric: r for r in trends.impact(ds, "direct", "1900-01-01").collect()}
    assert none["prompts"].before == 0 and none["cost_per_prompt"].before is None and none["cost_per_prompt"].change is None


def test_running_totals_do_not_depend_on_ranges(spark):
    rows = spark.createDataFrame([(i, i * 37 % 101, "x") for i in range(300)], "i int, n long, t string")
    want, so_far = {}, 0
    for i in sorted(range(300), key=lambda i: (-(i * 37 % 101), i)):
        so_far += i * 37 % 101
        want[i] = so_far
    for n in (1, 7):
        assert {r.i: r.s for r in content.running_total(rows, "n", [F.desc("n"), F.col("i")], "s", n).collect()} == want
    assert content.running_total(rows.limit(0), "n", [F.col("i")], "s").count() == 0


def test_splits_are_exact(spark):
    r = random.Random(3)
    data = [(g, i, r.choice([0, 7, 10**12 + 1]), r.choice([0, 1, 5, 10**9])) for g in range(40) for i in range(5)]
    data = [(g, i, data[g * 5][2], w) for g, i, _, w in data]
    got = apportion.split(spark.createDataFrame(data, "g int, i int, total long, w long"), ["g"], "total", "w", ["i"], "part").collect()
    for g in range(40):
        rows = sorted((x for x in got if x.g == g), key=lambda x: x.i)
        weights = sum(x.w for x in rows)
        assert sum(x.part for x in rows) == (rows[0].total if weights else 0)
        assert all(abs(x.part - x.total * x.w / weights) < 1 for x in rows if weights)


def test_prices_follow_the_longest_prefix_and_model_dimension(spark):
    t = spark.createDataFrame([("s", "p", m, "input", 0, 1000) for m in ("Brand#11", "Brand#11[1m]", "nobody", "", None)], "session_id string, prompt_id string, model string, token_type string, is_sidechain int, token_count long")
    ds = Dataset.of(spark, tokens=t, **ratecard.tables(spark, ratecard.DEMO))
    units = {r.model: r.units for r in totals.priced(t, ds, "direct").collect()}
    assert units["Brand#11"] == units["Brand#11[1m]"] > 0 and units["nobody"] == units[""] == units[None] == 0


def test_tasks_by_subject(spark):
    prompts = [("s", f"p{i}", f"2026-01-01T10:{i:02d}:00Z", f"text {i}") for i in range(5)] + [("s", "p5", "2026-01-01T12:00:00Z", "late")]
    frame = spark.createDataFrame(prompts, "session_id string, prompt_id string, timestamp string, prompt_preview string")
    vectors = [("p0", [1.0, 0.0], True), ("p1", [0.9, 0.1], True), ("p2", [0.0, 1.0], False), ("p3", [0.0, 1.0], True)]
    todos = spark.createDataFrame([], "session_id string, timestamp string, ordinal long, label string")
    found, edges = tasks.assemble(frame, todos, vectors=spark.createDataFrame(vectors, "prompt_id string, vector array<double>, anchor boolean"), similarity=0.8)
    by = {r.prompt_id: r.task_id for r in edges.collect()}
    assert by == {"p0": "s:i01", "p1": "s:i01", "p2": "s:i01", "p3": "s:i02", "p4": "s:i02", "p5": "s:i03"}
    assert {r.task_id: r.name for r in found.collect()}["s:i02"] == "text 3"


def test_semantic_labels_and_merging(spark):
    prompts = spark.createDataFrame([("a", "qqq", [1.0, 0.0]), ("b", "qqq", [0.0, 1.0]), ("c", "qqq", [-1.0, 0.0]), ("d", "ok", [1.0, 0.0])], "prompt_id string, t string, v array<double>")
    protos = spark.createDataFrame([("debug", [1.0, 0.0]), ("debug", [0.0, -1.0]), ("docs", [0.0, 1.0])], "category string, vector array<double>")
    label = lambda **k: {r.prompt_id: r.label for r in audit.semantic(prompts, protos, "t", "v", **k).collect()}
    assert label() == {"a": "debug", "b": "docs", "c": "other", "d": "followup"}
    assert label(top=2, tau=0.6)["a"] == "other"
    columns = "prompt_id string, category string, complexity string, classifier_model string, classified_at string"
    old = spark.createDataFrame([("a", "debug", "1", "rules-1", "t"), ("b", "docs", "1", "person-1", "t")], columns)
    new = spark.createDataFrame([("a", "test", "2", "vectors-1", "u"), ("b", "test", "2", "vectors-1", "u"), ("c", "test", "2", "vectors-1", "u")], columns)
    got = {r.prompt_id: r.category for r in audit.merge_categories(old, new, {"rules": 0, "vectors": 1, "person": 2}).collect()}
    assert got == {"a": "test", "b": "docs", "c": "test"}


def test_tables_are_loaded_while_fresh(spark, tmp_path):
    log_folder, folder = tmp_path / "logs", str(tmp_path / "out")
    log_folder.mkdir()
    (log_folder / "a.jsonl").write_text('{"type":"user","uuid":"u","sessionId":"S","timestamp":"2026-01-05T10:00:00Z","cwd":"/w","promptId":"p","message":{"content":"hi"}}\n')
    assert store.state(spark, folder, str(log_folder)) == "absent"
    ds = orders_dataset(spark, SF)
    small = {n: getattr(ds, n).limit(3) for n in ("sessions", "prompts", "tokens", "tasks", "task_prompts")} | {"requests": spark.createDataFrame([], tables._strings("requests"))}
    store.write_star(spark, small, folder, since="2026-01-01")
    assert store.window_label(spark, folder) == "window: since 2026-01-01" and store.window_label(spark, str(tmp_path)) == ""
    loaded, source = store.load(spark, folder, str(log_folder), str(tmp_path / "work"))
    assert "window: since" in source and loaded.tokens.count() == 3 and loaded.prompts_text.count() == 0
    bronze = str(tmp_path / "bronze")
    assert store.land_new(spark, str(log_folder), bronze).count() == 1
    (log_folder / "b.jsonl").write_text('{"type":"x"}\n\n{"type":"y"}\n')
    assert store.land_new(spark, str(log_folder), bronze).count() == 3 and store.land_new(spark, str(log_folder), bronze).count() == 3
    import os

    os.utime(log_folder / "a.jsonl", (4e9, 4e9))
    assert store.state(spark, folder, str(log_folder)) == "stale"
    table = audit.crosstab(spark.createDataFrame([(1, "debug"), (1, "debug"), (1, "docs"), (2, None), (-1, "x")], "c int, k string"), "c", "k")
    store.write_audit(table, folder, ["debug", "docs", "other"])
    rows = spark.read.option("header", "true").csv(f"{folder}/taxonomy_audit.csv").orderBy("cluster").collect()
    assert [tuple(r) for r in rows] == [("1", "3", "debug", "0.6667", "2", "1", "0"), ("2", "1", "other", "1.0", "0", "0", "1")]


def test_streams_equal_batches(spark, tmp_path):
    rows = [("s", "p", f"r{i % 6}", f"2026-01-{5 + i // 4:02d}T10:{i * 13 % 60:02d}:00Z", "m", i) for i in range(20)] + [("s", "p", "r", "no time", "m", 1)]
    source = spark.createDataFrame(rows, usage.REQUEST)
    source.write.parquet(str(tmp_path / "in"))
    batch = source.withColumn("at", F.try_to_timestamp("timestamp")).where(F.col("at").isNotNull())
    for i, f in enumerate((usage.per_week, usage.work_sessions)):
        query = f(usage.read_requests(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"q{i}").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(str, spark.table(f"q{i}").collect())) == sorted(map(str, f(batch).collect()))
    quota = spark.readStream.schema("snapshot_at string, field string").parquet(str(tmp_path / "in"))
    usage.append_quota(quota, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log" / "quota_log")).count() == 21


def test_sweep_equals_a_split_of_each_turn(spark):
    r = random.Random(8)
    turns, held, want = [], [], {}
    for s in ("a", "b"):
        for epoch in range(3):
            entries = [(s, epoch, r.randint(1, 30), f"s{r.randint(0, 2)}", "-", r.choice(["p", "q", None]), r.choice([1, 7, 10**13, 1 << 61]) if s == "b" else r.randint(1, 50), i) for i in range(r.choice([0, 3, 12]))]
            held += entries
            for t in range(1, 31, 3):
                model, total = r.choice(["m", "n", None]), r.choice([1, 5, 10**12 + 1])
                turns.append((s, epoch, t, model, total))
                weights, place = {}, {}
                for e in entries:
                    if e[2] <= t:
                        k = e[3:6]
                        weights[k] = weights.get(k, 0) + e[6]
                        place[k] = min(place.get(k, (99, 99)), (e[2], e[7]))
                whole = sum(weights.values())
                parts = {k: total * w // whole for k, w in weights.items()}
                for k in sorted(weights, key=lambda k: (-(total * weights[k] % whole), place[k]))[: total - sum(parts.values())]:
                    parts[k] += 1
                for k, n in parts.items() if parts else [(("(unattributed)", "-", "-"), total)]:
                    want[s, *k, model] = want.get((s, *k, model), 0) + n
    got = {}
    rows = apportion.swept(
        spark.createDataFrame(turns, "session_id string, epoch long, turn int, model string, total long"),
        spark.createDataFrame(held, "session_id string, epoch long, entered int, source string, language string, path string, tokens long, ordinal long"),
    ).collect()
    for x in rows:
        got[tuple(x)[:5]] = got.get(tuple(x)[:5], 0) + x.part
    assert got == {k: n for k, n in want.items() if n}
