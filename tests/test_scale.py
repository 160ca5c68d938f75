"""Running sums and ranks over many wide rows, against one ordered window and against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import audit, content, quantiles


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_total_of_many_wide_rows(spark, adaptive):
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        n = 2_000_000
        value = F.pmod(F.xxhash64("id"), F.lit(1000))
        rows = spark.range(n).select("id", value.alias("n"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("wide"), (F.col("id") % 7).alias("g"))
        got = content.running_total(rows, "n", [F.desc("n"), F.col("id")], "s", total="all")
        order = Window.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, 0)
        want = rows.select("id", F.sum("n").over(order).alias("want"))
        both = got.join(want, "id", "full").agg(F.count("*"), F.count_if(F.col("s").eqNullSafe(F.col("want"))), F.max("s"), F.min("all"), F.max("all"), F.min(F.length("wide"))).first()
        assert both[:2] == (n, n) and both[2] == both[3] == both[4] and both[5] == 128
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_ranks_equal_sorted_lists(spark, monkeypatch):
    r = random.Random(5)
    data = [(g, r.choice([0, 1, -5, 10**6, r.randint(-(2**40), 2**40), r.randint(0, 50)])) for g in ("a", "b", None) for _ in range(r.randint(150, 400))]
    data += [("one", 7), ("null", None), ("same", 3), ("same", 3)]
    rows = spark.createDataFrame(data, "g string, v long")
    for bits in (3, 16):
        monkeypatch.setattr(quantiles, "DIGIT_BITS", bits)
        got = {x.g: x for x in quantiles.quantiles(rows, ["g"], "v", {"q1": 0.25, "m": 0.5}, {"p90": 0.9}).collect()}
        assert got.keys() == {"a", "b", None, "one", "same"}
        for g, x in got.items():
            values = sorted(v for k, v in data if k == g and v is not None)
            assert x.m == statistics.median(values) and x.p90 == values[round((len(values) - 1) * 0.9)]
            at = (len(values) - 1) * 0.25
            assert abs(x.q1 - (values[int(at)] * (1 - at % 1) + values[min(int(at) + 1, len(values) - 1)] * (at % 1))) < 1e-3
        assert quantiles.quantiles(rows.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
        assert [tuple(x) for x in quantiles.quantiles(rows.limit(0), [], "v", {"m": 0.5}).collect()] == [(None,)]


def test_a_million_distinct_costs_in_one_category(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % n * 1000 + 5).alias("v"))
    found = quantiles.ranks(rows, ["g"], "v", {"first": F.lit(0), "third": F.floor(F.col("_n") / 3), "last": F.col("_n") - 1})
    assert [tuple(x) for x in found.collect()] == [("all", n, 5, n // 3 * 1000 + 5, (n - 1) * 1000 + 5)]
    assert "Window" not in found._jdf.queryExecution().toString()


def test_bands_equal_their_definition(spark):
    r = random.Random(6)
    names = ["assistant_turns", "tool_calls", "char_count", "units"]
    data = [(f"p{i}", r.choice([None, 1, 2, 3]), 4, r.randint(0, 10**9), i) for i in range(500)]
    got = {x.prompt_id: int(x.complexity) for x in audit.complexity(spark.createDataFrame(data, "prompt_id string, " + ", ".join(f"{n} long" for n in names))).collect()}
    columns = [[x[j + 1] or 0 for x in data] for j in range(4)]

    def band(values, v):
        share = sum(x <= v for x in values) / len(values)
        return 3 if min(values) == max(values) else next((i for i, t in enumerate((0.2, 0.4, 0.6, 0.8), 1) if share <= t), 5)

    assert got == {x[0]: round(sum(band(columns[j], x[j + 1] or 0) for j in range(4)) / 4) for x in data}
    assert audit.complexity(spark.createDataFrame([], "prompt_id string, " + ", ".join(f"{n} long" for n in names))).count() == 0
