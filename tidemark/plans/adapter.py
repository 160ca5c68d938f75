"""The driver's tables as two datasets of the star schema.

``orders_dataset``: customers are sessions, orders prompts and order lines tokens; a slice of the orders belongs to no
prompt. ``events_dataset``: users are sessions, the stretches between purchases prompts and events requests, whose counts
are also the tokens. Everything is derived by expressions that DuckDB has too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import spread
from tidemark.plans.dataset import Dataset
from tidemark.plans.tables import table
from tidemark.sources import ratecard


def iso(column: str) -> Column:
    """A timestamp as ISO text to the second, whatever the session's time zone."""
    text = F.col(column).cast("timestamp_ntz").cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z"))


def constants(**values: str) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in values.items()}


def orders_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("prompt_id"), F.concat(F.lit("c"), "o_custkey").alias("session_id"),
        "o_orderkey", "o_custkey", iso("o_orderdate").alias("timestamp"), "o_orderpriority",
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    sold = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    sessions = sold.groupBy("session_id", F.col("segment").alias("project")).agg(F.min("timestamp").alias("start_date"))
    sessions = sessions.select("session_id", "start_date", "project", F.lit("/work").alias("cwd"), F.lit("main").alias("git_branch"))
    lineitem = table(spark, sf_dir, "lineitem")
    n = lineitem.count()  # from the files' footers
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_linestatus", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    model = F.concat("p_brand", F.when(F.col("l_partkey") % 20 == 0, "[1m]").otherwise(""))
    sold_lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("model", model)
    turns = sold_lines.groupBy("l_orderkey").agg(F.count("*").alias("assistant_turns"), F.min("model").alias("model"))
    order = Window.partitionBy("session_id").orderBy("timestamp", "o_orderkey")
    prompts = sold.join(turns, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "session_id", "prompt_id", F.row_number().over(order).cast("long").alias("prompt_index"), "timestamp",
        F.when(F.col("o_orderkey") % 10 == 3, "").otherwise(F.col("segment")).alias("project"), *(c.alias(k) for k, c in constants(cwd="/work", git_branch="main", mode="normal", entrypoint="cli", version="1").items()),
        "model", (F.col("o_orderkey") * 37 % 3000).alias("char_count"), F.coalesce("assistant_turns", F.lit(0)).alias("assistant_turns"),
        (F.col("o_orderkey") % 7).alias("tool_calls"), F.lit("end").alias("final_stop_reason"), F.concat(F.lit("order "), "o_orderkey").alias("prompt_preview"),
    )
    kind = F.element_at(F.array(*map(F.lit, ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "server_tool_use", "cache_read"))), F.col("l_linenumber"))
    owner = orders.select("o_orderkey", "session_id", F.when(F.col("o_orderkey") % 50 == 0, F.concat("session_id", F.lit(":_continuation"))).otherwise(F.col("prompt_id")).alias("prompt_id"))
    count = F.when(kind == "server_tool_use", F.col("l_quantity")).otherwise(F.col("l_quantity") * 1000).cast("long")
    owned = spread(sold_lines, n, "l_orderkey").join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    tokens = spread(owned, n, "prompt_id").groupBy(
        "session_id", "prompt_id", "model", kind.alias("token_type"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("is_sidechain")
    ).agg(F.sum(count).alias("token_count"))
    categories = orders.where(F.col("o_orderkey") % 9 != 4).select(
        "prompt_id", F.lower(F.substring("o_orderpriority", 3, 20)).alias("category"), F.substring("o_orderpriority", 1, 1).alias("complexity"),
        F.lit("demo").alias("classifier_model"), F.lit("").alias("classified_at"),
    )
    edits = owned.where(F.col("l_linenumber") <= 3)
    output_files = spread(edits, n, "prompt_id").groupBy("prompt_id", F.concat("p_name", F.lit(".x")).alias("path")).agg(
        F.min("p_type").alias("language"), F.min(F.when(F.col("p_size") % 2 == 0, "test").otherwise("code")).alias("kind"),
        F.count("*").alias("edits"), F.sum(F.col("l_quantity").cast("long")).alias("lines_added"), F.sum(F.col("p_size").cast("long") % 5).alias("lines_deleted"),
    )
    outputs = tokens.where(F.col("token_type") == "output").groupBy("prompt_id").agg(F.sum("token_count").alias("n"))
    prose = F.col("n") - F.floor(F.col("n") / 3)
    output_tokens = outputs.select("prompt_id", prose.alias("output_prose_tokens"), (F.col("n") - prose).alias("output_code_tokens"))
    reads = spread(owned.where(F.col("l_linenumber").isin(4, 5)), n, "session_id").withColumns({
        "source": F.when(F.col("p_size") % 4 == 0, "tool_output").otherwise("file_read"),
        "path": F.when(F.col("p_size") % 4 == 0, "-").otherwise(F.concat("p_name", F.lit(".x"))), "language": F.when(F.col("p_size") % 4 == 0, "-").otherwise(F.col("p_type")),
    })
    size = F.col("l_quantity").cast("long") * 10
    context_sources = reads.groupBy("session_id", "source", "language", "path").agg(F.sum(size).alias("tokens"), F.count("*").alias("items"))
    context_cost = reads.groupBy("session_id", "source", "language", "path", "model").agg(
        F.sum(size * F.col("p_size")).alias("rent_read_tokens"), F.sum(size).alias("load_write_5m_tokens"), F.sum(F.when(F.col("l_linenumber") == 5, size).otherwise(0)).alias("load_write_1h_tokens")
    )
    quota = table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        iso("ts").alias("snapshot_at"), F.concat(F.lit("window_"), (F.col("user_id") % 4).cast("string")).alias("field"), F.col("value").alias("utilization_pct"), F.lit("").alias("resets_at")
    )
    models = parts.select("p_brand").distinct().select(F.explode(F.array("p_brand", F.concat("p_brand", F.lit("[1m]")))).alias("model"))
    return Dataset.of(
        spark, sessions=sessions, prompts=prompts, tokens=tokens, categories=categories, output_files=output_files, output_tokens=output_tokens, models=models,
        context_sources=context_sources, context_cost=context_cost, quota_log=quota, **ratecard.tables(spark, ratecard.DEMO),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their session, the number of purchases before them, prompt and the counts of a request."""
    order = Window.partitionBy("user_id").orderBy("timestamp", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", iso("ts").alias("timestamp"))
    bought = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("n", F.coalesce(bought, F.lit(0)))
    session = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return rows.select(
        "event_id", "user_id", "event_type", "timestamp", session.alias("session_id"), "n", F.concat(session, F.lit(":"), F.col("n").cast("string")).alias("prompt_id"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 9 + 1).cast("string"), F.when(F.col("event_id") % 11 == 0, "[1m]").otherwise("")).alias("model"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("is_sidechain"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("post_compact"),
        (F.col("event_id") % 97).alias("input_tokens"), F.floor(F.col("value") * 10).alias("output_tokens"), F.floor(F.col("value") * 1000).alias("cache_read_tokens"),
        (F.col("event_id") % 13 * 100).alias("cache_write_5m_tokens"), F.when(F.col("event_id") % 5 == 0, F.floor(F.col("value") * 50)).otherwise(0).alias("cache_write_1h_tokens"),
        F.when(F.col("event_id") % 29 == 0, 1).otherwise(0).cast("long").alias("server_tool_use_requests"),
    )


REQUEST_COUNTS = {
    "input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write_5m": "cache_write_5m_tokens",
    "cache_write_1h": "cache_write_1h_tokens", "server_tool_use": "server_tool_use_requests",
}


def tokens_of_requests(requests: DataFrame) -> DataFrame:
    """The ``tokens`` table that ``requests`` sums to."""
    kinds = [F.struct(F.lit(k).alias("token_type"), F.col(c).alias("token_count")) for k, c in REQUEST_COUNTS.items()]
    rows = requests.select("session_id", "prompt_id", "model", "is_sidechain", F.inline(F.array(*kinds))).where(F.col("token_count") != 0)
    return rows.groupBy("session_id", "prompt_id", "model", "token_type", "is_sidechain").agg(F.sum("token_count").alias("token_count"))


def events_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    rows = event_rows(spark, sf_dir)
    project = F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"))
    sessions = rows.groupBy("session_id", project.alias("project")).agg(F.min("timestamp").alias("start_date"))
    sessions = sessions.select("session_id", "start_date", "project", F.lit("/work").alias("cwd"), F.lit("main").alias("git_branch"))
    per = rows.groupBy("session_id", "prompt_id", "n", project.alias("project")).agg(
        F.min("timestamp").alias("timestamp"), F.min("model").alias("model"), F.sum(1 - F.col("is_sidechain")).alias("assistant_turns"),
        F.count_if(F.col("event_type") == "click").alias("tool_calls"), F.min("event_id").alias("first_event"),
    )
    prompts = per.select(
        "session_id", "prompt_id", (F.col("n") + 1).cast("long").alias("prompt_index"), "timestamp", "project",
        *(c.alias(k) for k, c in constants(cwd="/work", git_branch="main", mode="normal", entrypoint="cli", version="1").items()),
        "model", (F.col("first_event") * 37 % 3000).alias("char_count"), "assistant_turns", "tool_calls", F.lit("end").alias("final_stop_reason"), F.concat(F.lit("stretch "), "prompt_id").alias("prompt_preview"),
    )
    order = Window.partitionBy("prompt_id").orderBy("timestamp", "event_id")
    requests = rows.select(
        "session_id", "prompt_id", F.row_number().over(order).cast("long").alias("request_index"), "timestamp", "model", F.lit("end").alias("stop_reason"),
        "is_sidechain", "post_compact", *REQUEST_COUNTS.values(),
    )
    categories = per.where(F.col("n") % 4 != 3).select(
        "prompt_id", F.concat(F.lit("kind"), (F.col("n") % 3).cast("string")).alias("category"), (F.col("n") % 5 + 1).cast("string").alias("complexity"), F.lit("demo").alias("classifier_model"), F.lit("").alias("classified_at")
    )
    number = F.concat(F.lit("Brand#"), (F.col("id") % 9 + 1).cast("string"))
    models = spark.range(18).select(F.when(F.col("id") < 9, number).otherwise(F.concat(number, F.lit("[1m]"))).alias("model"))
    return Dataset.of(spark, sessions=sessions, prompts=prompts, requests=requests, tokens=tokens_of_requests(requests), categories=categories, models=models, **ratecard.tables(spark, ratecard.DEMO))


def todo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, timestamp, ordinal, label): clicks as notes of what is being worked on, some of them blank."""
    rows = event_rows(spark, sf_dir).where(F.col("event_type") == "click")
    label = F.when(F.col("event_id") % 6 == 0, "").otherwise(F.concat(F.lit("todo "), (F.col("event_id") % 4).cast("string")))
    return rows.where(F.col("user_id") % 3 != 0).select("session_id", "timestamp", F.col("event_id").alias("ordinal"), label.alias("label"))


def element_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, prompt_id, ordinal, source, language, path, tokens): pieces of context that enter with a prompt."""
    rows = event_rows(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    file = F.col("event_id") % 3 == 0
    return rows.where(F.col("n") % 5 != 4).select(
        "session_id", "prompt_id", F.col("event_id").alias("ordinal"), F.when(file, "file_read").otherwise("tool_output").alias("source"),
        F.when(file, "Python").otherwise("-").alias("language"), F.when(file, F.concat(F.lit("f"), (F.col("event_id") % 8).cast("string"))).otherwise("-").alias("path"),
        (F.col("event_id") % 53).cast("long").alias("tokens"),
    )
