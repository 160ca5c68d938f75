"""Filtered usage of prompts and of sessions alone, and prices beside tokens that are dealt by prompt."""

from pyspark.sql import functions as F

from tidemark.operators import filters, pricing
from tidemark.plans.dataset import Dataset
from tidemark.sources import ratecard


def test_usage_of_prompts_and_of_sessions(spark):
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        prompts = spark.range(40).select(i.cast("string").alias("prompt_id"), (i % 7).cast("string").alias("session_id"), F.concat(F.lit("2024-01-0"), i % 5 + 1).alias("timestamp"))
        session = F.when(i % 11 > 0, (i % 9).cast("string")).alias("session_id")
        tokens = spark.range(90).select(i.cast("string").alias("prompt_id"), session).repartition(3, "prompt_id")
        data = Dataset.of(spark, prompts=prompts, tokens=tokens, models=spark.createDataFrame([], "model string"))
        kept = filters.filter_dates(data, "2024-01-04", None).tokens
        rows = {int(x["prompt_id"]) for x in kept.collect()}
        assert rows == {k for k in range(90) if (k < 40 and k % 5 >= 3) or (k >= 40 and k % 11 and k % 9 < 7)}
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)


def test_prices_do_not_shuffle_tokens(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tokens = spark.createDataFrame([("a", "m", "input", 3)], "prompt_id string, model string, token_type string, token_count bigint")
        data = Dataset.of(spark, models=tokens.select("model"), **ratecard.tables(spark, ratecard.DEMO))
        rows = pricing.priced(tokens, data, "direct")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
