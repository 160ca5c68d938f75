"""Registry of the usage-analytics queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import intent
from tidemark.operators import apportion, audit, chains, content, density, explore, filters, pricing, semantic, tasks, totals, trends
from tidemark.plans import loglines, oracle_content, oracle_explore, oracle_logs, oracle_usage
from tidemark.plans.adapter import element_rows, events_dataset, orders_dataset, todo_rows
from tidemark.plans.dataset import Dataset
from tidemark.plans.tables import table
from tidemark.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
PROVIDERS = ("direct", "cloud")
FIRST = PROVIDERS[0]


def orders(f: Callable[[Dataset], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(orders_dataset(spark, sf_dir))


def events(f: Callable[[Dataset], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(events_dataset(spark, sf_dir))


TOTALS: dict[str, Query] = {
    "summary": orders(lambda d: totals.summary(d, PROVIDERS)),
    "by_project": orders(lambda d: totals.by_project(d, FIRST)),
    "by_model": orders(lambda d: totals.by_model(d, FIRST)),
    "by_token_type": orders(lambda d: totals.by_token_type(d, FIRST)),
    "by_category": orders(lambda d: totals.by_category(d, FIRST)),
    "input_cost": orders(lambda d: totals.input_cost(d, FIRST)),
    "top_prompts": orders(lambda d: totals.top_prompts(d, FIRST)),
    "sessions_table": orders(lambda d: totals.sessions_table(d, FIRST)),
    "model_category": orders(lambda d: totals.model_category(d, FIRST, "Brand#11")),
    "compare_providers": orders(lambda d: totals.compare_providers(d, PROVIDERS)),
    "flat_export": orders(lambda d: totals.flat_export(d, PROVIDERS)),
    "mini_summary": orders(lambda d: totals.mini_summary(d, PROVIDERS)),
    "unpriced_models": orders(lambda d: pricing.unpriced(d, FIRST)),
    "long_context_models": orders(pricing.long_context),
}

TRENDS: dict[str, Query] = {
    **{f"timeline_{by}": orders(lambda d, by=by: trends.timeline(d, FIRST, by)) for by in trends.PERIODS},
    "burn_rate": orders(lambda d: trends.burn_rate(d, FIRST)),
    "break_even": orders(lambda d: trends.break_even(d, FIRST)),
    "bundle_costs": orders(lambda d: trends.bundle_costs(d, "cloud")),
    "impact": events(lambda d: trends.impact(d, FIRST, "2024-01-16")),
    "top_category": orders(trends.top_category),
    "peak_quota": orders(lambda d: trends.peak_quota(d.quota_log)),
    "latest_quota": orders(lambda d: trends.latest_quota(d.quota_log)),
    "daily_kpis": events(lambda d: trends.daily(d, FIRST)),
    "cost_by_type_month": orders(lambda d: trends.cost_by_period(d, FIRST, "month", "token_type", oracle_usage.KINDS)),
    "heat_map": events(lambda d: trends.heat_map(d, FIRST)),
}

CHAINS: dict[str, Query] = {
    "session_depth": orders(lambda d: chains.session_depth(d, FIRST)),
    "context_growth": events(lambda d: chains.context_growth(d, FIRST)),
    "ttl_losses": events(lambda d: chains.ttl_losses(d, FIRST)),
    "compactions": events(lambda d: chains.compactions(d, FIRST)),
    "session_overhead": events(lambda d: chains.session_overhead(d, FIRST)),
    "overhead_notes": events(lambda d: chains.overhead_notes(d, FIRST)),
    "recommendations": events(lambda d: chains.recommendations(d, FIRST, min_prompts=8, compact_at=4)),
    "cost_boxes": orders(lambda d: chains.cost_boxes(d.with_(prompts=d.prompts.withColumn("model", F.coalesce("model", F.lit("")))), FIRST, "model")),
    "depth_quantiles": orders(chains.depth_quantiles),
    "main_chain_cache": events(lambda d: chains.main_chain_cache(d, FIRST)),
}


def with_tasks(spark: SparkSession, sf_dir: str) -> Dataset:
    """The events with their tasks."""
    data = events_dataset(spark, sf_dir)
    found, edges = tasks.assemble(data.prompts, todo_rows(spark, sf_dir))
    return data.with_(tasks=found, task_prompts=edges)


def with_context(spark: SparkSession, sf_dir: str) -> Dataset:
    """The events with their cache tokens attributed."""
    data = events_dataset(spark, sf_dir)
    main = data.requests.where(F.col("is_sidechain") == 0)
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "prompt_id", "request_index"))
    elements = element_rows(spark, sf_dir)
    talk = main.select("session_id", F.col("input_tokens").alias("tokens"))
    return data.with_(context_cost=apportion.attribute(main.withColumn("turn", turn), elements), context_sources=apportion.snapshot(elements, talk))


CONTENT: dict[str, Query] = {
    "by_output": orders(lambda d: content.by_output(d, FIRST)),
    "output_split": orders(lambda d: content.output_split(d, FIRST)),
    "by_context": orders(lambda d: content.by_context(d, FIRST)),
    "by_file": orders(lambda d: content.by_file(d, FIRST)),
    "by_file_project": orders(lambda d: content.by_file(d, FIRST, by_project=True)),
    "file_nodes": orders(lambda d: content.file_graph(d, FIRST)[0]),
    "file_graph": orders(lambda d: content.file_graph(d, FIRST)[1]),
    "context_pareto": orders(lambda d: content.context_pareto(d, FIRST)),
    "tasks": lambda spark, sf_dir: with_tasks(spark, sf_dir).tasks,
    "task_prompts": lambda spark, sf_dir: with_tasks(spark, sf_dir).task_prompts,
    "by_task": lambda spark, sf_dir: content.by_task(with_tasks(spark, sf_dir), FIRST),
    "task_graph": lambda spark, sf_dir: content.task_graph(with_tasks(spark, sf_dir), FIRST)[1],
    "context_attribution": lambda spark, sf_dir: with_context(spark, sf_dir).context_cost,
    "context_rent": lambda spark, sf_dir: content.by_context(with_context(spark, sf_dir), FIRST),
    "context_snapshot": lambda spark, sf_dir: with_context(spark, sf_dir).context_sources,
}


def by_model_name(ds: Dataset) -> Dataset:
    return ds.with_(prompts=ds.prompts.withColumn("model", F.coalesce("model", F.lit(""))))


def with_years(ds: Dataset) -> Dataset:
    """The orders with the years of a session as its tasks, some without a name; every fifth order belongs to none."""
    key = F.concat("session_id", F.lit(":"), F.substring("timestamp", 1, 4))
    rows = ds.prompts.where(F.substring("prompt_id", 2, 20).cast("long") % 5 != 4).select("prompt_id", "session_id", "timestamp", F.concat(key, F.when(F.col("char_count") % 3 == 0, "").otherwise("+")).alias("task_id"))
    made = rows.groupBy("task_id", "session_id").agg(F.count("*").alias("prompts"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    named = F.when(F.endswith("task_id", F.lit("+")), F.concat(F.lit("year "), F.substring("first_timestamp", 1, 4)))
    return ds.with_(tasks=made.select("task_id", "session_id", named.alias("name"), F.lit("inferred").alias("origin"), "prompts", "first_timestamp", "last_timestamp"), task_prompts=rows.select("task_id", "prompt_id"))


EXPLORE: dict[str, Query] = {
    "type_volume": orders(lambda d: explore.type_volume(d, FIRST)),
    "box_cap": orders(lambda d: explore.box_cap(by_model_name(d), FIRST, "model")),
    "project_pareto": orders(lambda d: explore.project_pareto(d, FIRST)),
    "project_sessions": orders(lambda d: explore.project_sessions(d, FIRST)),
    "session_sizes": orders(explore.session_sizes),
    "prompt_lengths": orders(explore.prompt_lengths),
    "session_rollup": orders(lambda d: explore.session_rollup(d, FIRST)),
    "session_timeline": orders(lambda d: explore.session_timeline(d, FIRST)),
    "edited_by": orders(lambda d: explore.edited_by(with_years(d))),
    "read_in": orders(lambda d: explore.read_in(d, FIRST)),
    "type_costs": orders(lambda d: explore.type_costs(d, FIRST, oracle_explore.PIVOT)),
    "language_shares": orders(lambda d: explore.language_shares(d, oracle_explore.PIVOT)),
    "efficiency": orders(lambda d: explore.efficiency(d, FIRST)),
    "file_population": orders(lambda d: explore.file_population(d, FIRST)),
}


def table_sizes(ds: Dataset) -> DataFrame:
    """(name, n): the rows of a dataset's tables."""
    sizes = [getattr(ds, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in oracle_explore.COUNTED]
    out = sizes[0]
    for x in sizes[1:]:
        out = out.unionByName(x)
    return out


FILTERS: dict[str, Query] = {
    "project_filter": orders(lambda d: table_sizes(filters.filter_project(d, "BUILDING"))),
    "date_filter": orders(lambda d: table_sizes(filters.filter_dates(d, "1994-01-01", "1995-12-31"))),
    "window_filter": orders(lambda d: table_sizes(filters.window(d, oracle_explore.PIVOT, 30))),
    "id_filter": orders(lambda d: table_sizes(filters.filter_prompt_ids(d, d.prompts.where("char_count < 300").select("prompt_id")))),
    "all_filters": orders(lambda d: table_sizes(filters.apply_filters(
        d, dates=("1993-01-01", "1996-12-31"), projects=("BUILDING", "MACHINERY", ""), categories=("urgent", "high", "(uncategorized)"), chars=(100, 2500), session_prompts=(2, 4)))),
    "date_range": orders(filters.date_bounds),
    "select_everything": orders(lambda d: table_sizes(filters.apply_filters(
        d, models=[f"Brand#{n}{kind}" for n in range(100) for kind in ("", "[1m]")], projects=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
        categories=("urgent", "high", "medium", "not specified", "low", "(uncategorized)")))),
    "select_most": orders(lambda d: table_sizes(filters.apply_filters(d, projects=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"), categories=()))),
}


def reconciliation(ds: Dataset) -> DataFrame:
    """Tokens of each model against those of a second source, here the same without subagents and one model."""
    sums = lambda rows: rows.groupBy("model").agg(F.sum("token_count").alias("n"))
    return audit.reconcile(sums(ds.tokens), sums(ds.tokens.where((F.col("is_sidechain") == 0) & (F.col("model") != "Brand#11"))), ["model"], "n")


def label_agreement(ds: Dataset) -> DataFrame:
    """How two labellings of the same prompts agree."""
    second = F.when(F.col("complexity") < "3", "urgent").otherwise(F.col("category")).alias("category")
    return audit.agreement(ds.categories, ds.categories.select("prompt_id", second))


def audited(f: Callable[[DataFrame], DataFrame], topics: int = 0) -> Query:
    """``f`` of sources, or of so many topics by number, as categories in arbitrary clusters of documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        category = F.concat(F.lit("topic"), (F.col("doc_id") % 11 % topics).cast("string")) if topics else F.col("source")
        docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("cluster"), category.alias("category"))
        return f(audit.crosstab(docs, "cluster", "category"))

    return run


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based intent of each turn; its patterns need look-around, which DuckDB's SQL has not."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intent(F.col("text")).alias("intent"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density cluster of each vector with its label, as an audit tabulates them; SQL has no such hierarchy."""
    vectors = table(spark, sf_dir, "embeddings")
    found = density.density_clusters(vectors, "vec_id", "embedding")
    return found.join(vectors.select("vec_id", "label"), found["id"] == vectors["vec_id"]).select("vec_id", "label", "cluster")


#: The categories whose prototypes the queries take from the table, four vectors for each.
PROTOTYPED = ("debug", "docs", "plan", "test")


def vector_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict[str, Column], Column]:
    """The vectors with scores against the first ones as prototypes, evidence for two lexical categories and shortcuts by
    number, and ``gold``: the label with the usual knobs, but for every seventh vector another."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    name = F.element_at(F.array(*map(F.lit, PROTOTYPED)), (F.col("vec_id") % 4 + 1).cast("int"))
    prototypes = vectors.where(F.col("vec_id") < 4 * len(PROTOTYPED)).select(name.alias("category"), F.col("embedding").alias("vector"))
    rows, names = semantic.scored(vectors, prototypes, "embedding", top=2)
    i = F.col("vec_id")
    hits = lambda n: 1 - F.pow(F.lit(0.4), n)
    evidence = {"ops": hits(F.when(i % 3 == 0, i % 4).otherwise(0)), "feedback": hits(F.when(i % 5 == 0, i % 3).otherwise(0))}
    shortcut = F.when(i % 19 == 0, "notification").when(i % 17 == 0, "followup")
    return rows.drop("embedding"), names, evidence, shortcut


def semantic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names, evidence, shortcut = vector_cases(spark, sf_dir)
    _, best = semantic.best_of(names, "scores", evidence, semantic.PRIME_WEIGHT)
    return semantic.labelled(rows.withColumn("score", F.round(best, 6)), names, "scores", evidence, shortcut).select("vec_id", "label", "score")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names, evidence, shortcut = vector_cases(spark, sf_dir)
    rows = semantic.labelled(rows, names, "scores", evidence, shortcut, 0.3, 0.7)
    i = F.col("vec_id")
    gold = F.when(i % 7 == 0, "other").when(i % 23 != 0, F.col("label"))
    return semantic.calibrate(rows.withColumns({"gold": gold, "judge": F.when(i % 2 == 0, "ops").otherwise("other")}), names, "scores", evidence, shortcut, "gold", "judge")


def label_divergences(ds: Dataset) -> DataFrame:
    """Where two labellings of the orders' prompts differ: the categories, and others by complexity."""
    was = ds.categories.select("prompt_id", F.when(F.col("category") == "low", "other").otherwise(F.col("category")).alias("category"))
    now = ds.categories.select("prompt_id", F.when(F.col("complexity") < "3", "urgent").otherwise(F.col("category")).alias("category"))
    return semantic.divergences(was, now, ds.prompts.select("prompt_id", F.concat(F.lit("size "), (F.col("char_count") % 40).cast("string")).alias("text")))


AUDIT: dict[str, Query] = {
    "reconciliation": orders(reconciliation),
    "label_agreement": orders(label_agreement),
    "complexity": events(lambda d: audit.complexity(totals.with_costs(d, FIRST))),
    "audit_table": audited(lambda x: x.select("cluster", "category", "n", "size", "dominant", "share")),
    "audit_merges": audited(audit.merges, topics=4),
    "audit_splits": audited(audit.splits),
    "audit_themes": audited(audit.themes),
    "top_terms": lambda spark, sf_dir: audit.top_terms(table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "text"), "label", "text"),
    "representatives": lambda spark, sf_dir: audit.representatives(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding"),
    "intents": intents,
    "clusters": clusters,
    "semantic_labels": semantic_labels,
    "calibration": calibration,
    "label_divergences": orders(label_divergences),
}


def logged(f: Callable[[logs.Star], DataFrame]) -> Query:
    """``f`` of the star schema of the lines that the events make."""
    return lambda spark, sf_dir: f(logs.Star(loglines.parsed(spark, sf_dir)))


def log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).where(~F.endswith("model", F.lit("7"))).distinct()
    return logs.report(logs.Star(loglines.parsed(spark, sf_dir)), priced)


LOGS: dict[str, Query] = {
    "log_report": log_report,
    "log_quality": logged(lambda s: logs.quality(s.log)),
    "log_events": logged(lambda s: loglines.event_table(s.log)),
    "log_prompts": logged(lambda s: s.prompt_rows),
    "log_requests": logged(lambda s: s.requests),
    "log_tokens": logged(lambda s: s.tokens),
    "log_sessions": logged(lambda s: s.sessions),
    "log_files": logged(lambda s: s.output_files),
    "log_output": logged(lambda s: s.output_tokens),
    "log_todos": logged(lambda s: s.todos),
    "log_context": logged(lambda s: s.context_sources),
}


def queries() -> dict[str, Query]:
    return LOGS | TOTALS | TRENDS | CHAINS | CONTENT | EXPLORE | FILTERS | AUDIT


def oracle_sql() -> dict[str, str]:
    return oracle_logs.SQL | oracle_usage.SQL | oracle_content.SQL | oracle_explore.SQL
