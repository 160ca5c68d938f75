"""The stream of largest snapshots: replayed, late and midnight-crossing files against the batch rule, and bounded state."""

import random
from collections import defaultdict

import pytest

from tidemark.streaming import usage

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(day, hour, minute=0):
    return f"2026-01-{day:02d}T{hour:02d}:{minute:02d}:00Z"


def stream(spark, folder, checkpoint, name):
    rows = spark.readStream.schema(usage.REQUEST).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    from pyspark.sql import functions as F

    rows = rows.withColumn("at", F.try_to_timestamp("timestamp")).where(F.col("at").isNotNull()).withWatermark("at", usage.LATE)
    return usage.largest(rows).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, STORE)
    yield
    spark.conf.unset(key)


def land(spark, folder, rows):
    spark.createDataFrame(rows, usage.REQUEST).coalesce(1).write.mode("append").parquet(str(folder))


def test_changes_sum_to_the_batch(spark, rocks, tmp_path):
    r = random.Random(4)
    files = []
    for _ in range(6):
        files.append([(f"s{r.randint(0, 2)}", "p", f"r{r.randint(0, 25)}", at(*r.choice([(5, 12), (5, 23), (6, 0), (6, 11)]), r.randint(0, 59)), r.choice(["m", None]), r.randint(0, 40)) for _ in range(30)])
    files[1] += files[0]  # a replay
    files[2] += [("s", "p", "midnight", at(5, 23, 59), "m", 10), ("s", "p", "", at(5, 13), "m", 7), ("s", "p", "", at(5, 13), "m", 7)]
    files[4] += [("s", "p", "midnight", at(6, 0, 1), "m", 30), ("s", "p", "midnight", at(6, 0, 2), "m", 5), ("s", "p", "bad", "no time", "m", 5)]
    for rows in files:
        land(spark, tmp_path / "in", rows)
    query = stream(spark, tmp_path / "in", tmp_path / "check", "largest_changes")
    query.awaitTermination()
    changes = spark.table("largest_changes").collect()
    net = defaultdict(int)
    for c in changes:
        net[c.request_key, c.session_id, c.model, c.at, c.tokens] += c.change
    from pyspark.sql import functions as F

    batch = spark.createDataFrame([x for rows in files for x in rows], usage.REQUEST).withColumn("at", F.try_to_timestamp("timestamp")).where(F.col("at").isNotNull())
    want = defaultdict(int)
    for x in usage.largest(batch).collect():
        want[x.request_key, x.session_id, x.model, x.at, x.tokens] += x.change
    assert {k: n for k, n in net.items() if n} == dict(want)
    assert sum(n for k, n in net.items() if k[0] == "midnight") == 1 and any(c.change == -1 for c in changes)
    assert sum(c.tokens for c in changes if c.request_key == "midnight" and c.change == 1) - sum(c.tokens for c in changes if c.request_key == "midnight" and c.change == -1) == 30


def test_state_goes_with_the_watermark(spark, rocks, tmp_path):
    land(spark, tmp_path / "in", [("s", "p", f"r{i}", at(1, i % 24), "m", i) for i in range(200)])
    for i in range(3):
        land(spark, tmp_path / "in", [("s", "p", f"later{i}", at(20, 1), "m", 1)])
    land(spark, tmp_path / "in", [("s", "p", "latest", at(20, 2), "m", 1), ("s", "p", "r7", at(1, 7), "m", 10**6)])
    query = stream(spark, tmp_path / "in", tmp_path / "check", "all_state")
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 200 and rows[-1] <= 4 * 4  # four requests: a value and a timer each, in two indexes
    assert {r.tokens for r in spark.table("all_state").where("request_key = 'r7'").collect()} == {7}  # the other came too late
