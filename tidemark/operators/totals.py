"""Totals and breakdowns of usage and cost. Each function takes a dataset and returns one lazy DataFrame.

Ties are ordered by the group's own key. Usage without a prompt of its own (pseudo-prompts) counts in all totals and in
no per-prompt view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import filled, ratio, share, usd
from tidemark.operators.filters import day
from tidemark.operators.pricing import priced, priced_by
from tidemark.operators.quantiles import quantiles
from tidemark.plans.dataset import REQUESTS_TYPE, SYNTHETIC_MODEL, TOKEN_TYPES, Dataset

UNCATEGORIZED, UNKNOWN = "(uncategorized)", "(unknown)"


def whole() -> Window:
    """All rows; only used over groups."""
    return Window.partitionBy()


def is_token() -> Column:
    return F.col("token_type") != REQUESTS_TYPE


def tokens_of(kind: str | None = None) -> Column:
    """Sum of one kind of tokens, or of all kinds that are tokens."""
    return F.coalesce(F.sum(F.when(is_token() if kind is None else F.col("token_type") == kind, F.col("token_count"))), F.lit(0))


def cost(provider: str | None = None) -> Column:
    return F.coalesce(F.sum("units" if provider is None else f"units_{provider}"), F.lit(0)).cast("long")


def prompt_costs(ds: Dataset, provider: str) -> DataFrame:
    """(prompt_id, units, tokens) over all token rows."""
    return priced(ds.tokens, ds, provider).groupBy("prompt_id").agg(cost().alias("units"), tokens_of().alias("tokens"))


def with_costs(ds: Dataset, provider: str) -> DataFrame:
    """``prompts`` with units and tokens, 0 where they have no usage."""
    return ds.prompts.join(prompt_costs(ds, provider), "prompt_id", "left").fillna(0, subset=["units", "tokens"])


def summary(ds: Dataset, providers: Sequence[str]) -> DataFrame:
    """(position, metric, value): counts, span, tokens by type, costs and the subagents' share of the first provider's."""
    distinct = lambda c: F.count_distinct(F.coalesce(c, F.lit("")))
    first, last = F.min(F.nullif(day(), F.lit(""))), F.max(F.nullif(day(), F.lit("")))
    prompts = ds.prompts.agg(
        F.count("*").cast("double").alias("Prompts"), distinct(F.col("project")).cast("double").alias("Projects"),
        (F.datediff(last.cast("date"), first.cast("date")) + 1).cast("double").alias("Span days"),
    )
    sessions = ds.sessions.agg(F.count("*").cast("double").alias("Sessions"))
    names, totals = ["Sessions", "Prompts", "Projects", "Span days", *TOKEN_TYPES, "Total tokens"], []
    for i, provider in enumerate(providers):
        side = F.coalesce(F.sum(F.when(F.col("is_sidechain") == 1, F.col(f"units_{provider}"))), F.lit(0))
        totals.append(usd(cost(provider), 2).alias(f"Cost ({provider})"))
        names.append(f"Cost ({provider})")
        if not i:
            totals += [usd(side, 2).alias("Subagent cost"), share(side, cost(provider)).alias("Subagent share")]
            names += ["Subagent cost", "Subagent share"]
    counts = [*(tokens_of(t).cast("double").alias(t) for t in TOKEN_TYPES), tokens_of().cast("double").alias("Total tokens")]
    frames = [sessions, prompts, priced_by(ds.tokens, ds, providers).agg(*counts, *totals)]
    one = [f.select(F.inline(F.array(*(F.struct(F.lit(names.index(c)).alias("position"), F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in f.columns)))) for f in frames]
    out = one[0]
    for f in one[1:]:
        out = out.unionByName(f)
    return out.where(F.col("value").isNotNull() & ((F.col("metric") != REQUESTS_TYPE) | (F.col("value") != 0)))


def project_of(rows: DataFrame, ds: Dataset) -> DataFrame:
    """``rows`` with ``project``: the prompt's, else the session's, else (unknown)."""
    prompts = ds.prompts.select("prompt_id", F.nullif("project", F.lit("")).alias("_own"))
    sessions = ds.sessions.select("session_id", F.nullif("project", F.lit("")).alias("_of_session"))
    joined = rows.join(prompts, "prompt_id", "left").join(sessions, "session_id", "left")
    return joined.withColumn("project", F.coalesce("_own", "_of_session", F.lit(UNKNOWN))).drop("_own", "_of_session")


def by_project(ds: Dataset, provider: str) -> DataFrame:
    """Cost, tokens and prompts of each project that has usage, with cumulative share by falling cost."""
    usage = priced(ds.tokens, ds, provider).groupBy("prompt_id", "session_id").agg(cost().alias("units"), tokens_of().alias("tokens"))
    usage = project_of(usage, ds).groupBy("project").agg(F.sum("units").alias("units"), F.sum("tokens").alias("tokens"))
    counts = ds.prompts.groupBy(filled("project", UNKNOWN).alias("project")).agg(F.count("*").alias("prompts"))
    by_cost = Window.orderBy(F.desc("units"), "project").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("units").over(whole())
    return usage.join(counts, "project", "left").select(
        "project", F.coalesce("prompts", F.lit(0)).alias("prompts"), "tokens",
        share("tokens", F.sum("tokens").over(whole())).alias("token_share_pct"), usd("units").alias("cost_usd"),
        share("units", total).alias("share_pct"), share(F.sum("units").over(by_cost), total).alias("cumulative_pct"),
    )


def by_model(ds: Dataset, provider: str) -> DataFrame:
    """Tokens by type, distinct real prompts, subagents' cost and cost of each model."""
    real = ds.prompts.select("prompt_id", F.col("prompt_id").alias("_real"))
    rows = priced(ds.tokens, ds, provider).join(real, "prompt_id", "left")
    kinds = [t for t in TOKEN_TYPES if t != REQUESTS_TYPE]
    side = F.coalesce(F.sum(F.when(F.col("is_sidechain") == 1, F.col("units"))), F.lit(0))
    out = rows.groupBy(filled("model", UNKNOWN).alias("model")).agg(
        F.count_distinct("_real").alias("prompts"), *(tokens_of(t).alias(t) for t in kinds), side.alias("side"), cost().alias("units")
    )
    return out.select("model", "prompts", *kinds, usd("side").alias("subagent_cost_usd"), usd("units").alias("cost_usd"), share("units", F.sum("units").over(whole())).alias("share_pct"))


def by_token_type(ds: Dataset, provider: str) -> DataFrame:
    """Tokens and cost of each type in use, and a TOTAL row whose tokens leave requests out."""
    rows = priced(ds.tokens, ds, provider)
    each = rows.groupBy("token_type").agg(F.sum("token_count").alias("tokens"), cost().alias("units")).where(F.col("tokens") != 0)
    real = F.sum(F.when(is_token(), F.col("tokens"))).over(whole())
    each = each.withColumns({"all_tokens": F.coalesce(real, F.lit(0)), "all_units": F.sum("units").over(whole())})
    shares = each.select(
        "token_type", "tokens", F.when(is_token(), share("tokens", "all_tokens")).alias("token_share_pct"),
        usd("units").alias("cost_usd"), share("units", "all_units").alias("cost_share_pct"),
    )
    sums = rows.agg(tokens_of().alias("tokens"), cost().alias("units"))
    full = lambda c: F.when(F.col(c) != 0, 100.0).otherwise(0.0)
    total = sums.select(F.lit("TOTAL").alias("token_type"), "tokens", full("tokens").alias("token_share_pct"), usd("units").alias("cost_usd"), full("units").alias("cost_share_pct"))
    return shares.unionByName(total)


def by_category(ds: Dataset, provider: str) -> DataFrame:
    """Prompts, average complexity (of digits only), median and total cost of each category."""
    named = ds.categories.select("prompt_id", "category", "complexity")
    rows = with_costs(ds, provider).join(named, "prompt_id", "left")
    digits = F.when(F.col("complexity").rlike("^[0-9]+$"), F.try_to_number("complexity", F.lit("999999")).cast("long"))
    rows = rows.select(filled("category", UNCATEGORIZED).alias("category"), digits.alias("level"), "units")
    out = rows.groupBy("category").agg(F.count("*").alias("prompts"), F.sum("level").alias("levels"), F.count("level").alias("rated"), F.sum("units").alias("units"))
    out = out.join(quantiles(rows, ["category"], "units", {"median": 0.5}), "category")
    return out.select(
        "category", "prompts", share("prompts", F.sum("prompts").over(whole())).alias("share_pct"),
        ratio("levels", "rated", 1).alias("avg_complexity"), usd("median").alias("med_cost_per_prompt_usd"),
        usd("units").alias("cost_usd"), share("units", F.sum("units").over(whole())).alias("cost_share_pct"),
    )


def input_cost(ds: Dataset, provider: str) -> DataFrame:
    """The cost of fresh input alone."""
    return priced(ds.tokens.where(F.col("token_type") == "input"), ds, provider).agg(usd(cost()).alias("input_cost_usd"))


def top_prompts(ds: Dataset, provider: str, top: int = 10) -> DataFrame:
    """The ``top`` costliest prompts; none for 0."""
    rows = with_costs(ds, provider).orderBy(F.desc("units"), "prompt_id").limit(top)
    return rows.select(
        "prompt_id", day().alias("date"), F.coalesce("project", F.lit("")).alias("project"), F.coalesce("model", F.lit("")).alias("model"),
        "tokens", usd("units").alias("cost_usd"), F.substring("prompt_preview", 1, 80).alias("preview"),
    )


def sessions_table(ds: Dataset, provider: str, top: int = 20) -> DataFrame:
    """Sessions that have usage, by cost; all of them for ``top`` 0."""
    usage = priced(ds.tokens, ds, provider).groupBy("session_id").agg(cost().alias("units"), tokens_of().alias("tokens"))
    counts = ds.prompts.groupBy("session_id").agg(F.count("*").alias("prompts"))
    rows = usage.orderBy(F.desc("units"), "session_id").limit(top) if top else usage
    rows = rows.join(counts, "session_id", "left").join(ds.sessions.select("session_id", "start_date", "project"), "session_id", "left")
    return rows.select(
        "session_id", F.coalesce("start_date", F.lit("")).alias("start_date"), F.coalesce("project", F.lit("")).alias("project"),
        F.coalesce("prompts", F.lit(0)).alias("prompts"), "tokens", usd("units").alias("cost_usd"),
    )


def model_category(ds: Dataset, provider: str, target: str | None = None) -> DataFrame:
    """Cost of each model and category; with ``target``, also what it would cost on that model."""
    rows = priced(ds.tokens.withColumn("model", filled("model", UNKNOWN)), ds, provider)
    if target is not None:
        rows = priced(rows.withColumnRenamed("units", "_units"), ds, provider, target).withColumnRenamed("units", "_what_if").withColumnRenamed("_units", "units")
    named = ds.categories.select("prompt_id", "category")
    real = ds.prompts.select("prompt_id", F.col("prompt_id").alias("_real"))
    rows = rows.join(named, "prompt_id", "left").join(real, "prompt_id", "left")
    extra = [] if target is None else [F.coalesce(F.sum("_what_if"), F.lit(0)).cast("long").alias("again")]
    out = rows.groupBy("model", filled("category", UNCATEGORIZED).alias("category")).agg(F.count_distinct("_real").alias("prompts"), tokens_of().alias("tokens"), cost().alias("units"), *extra)
    columns = ["model", "category", "prompts", "tokens", usd("units").alias("cost_usd"), share("units", F.sum("units").over(whole())).alias("share_pct")]
    if target is not None:
        columns += [usd("again").alias("repriced_usd"), usd(F.col("units") - F.col("again")).alias("saving_usd")]
    return out.select(*columns)


def compare_providers(ds: Dataset, providers: Sequence[str]) -> DataFrame:
    """Tokens of each model and its cost with each provider, and a TOTAL row."""
    rows = priced_by(ds.tokens, ds, providers).withColumn("m", filled("model", UNKNOWN)).rollup("m").agg(
        tokens_of().alias("tokens"), F.count_if(is_token()).alias("n"), F.grouping("m").alias("g"), *(usd(cost(p)).alias(f"cost_{p}_usd") for p in providers)
    )
    rows = rows.where((F.col("n") > 0) | (F.col("g") == 1))
    return rows.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("m")).alias("model"), "tokens", *(f"cost_{p}_usd" for p in providers))


def flat_export(ds: Dataset, providers: Sequence[str]) -> DataFrame:
    """One row for each prompt and each pseudo-prompt, with tokens by type, costs and its session's fields."""
    pivot = priced_by(ds.tokens, ds, providers).groupBy("prompt_id").agg(
        *(tokens_of(t).alias(f"{t}_tokens" if t != REQUESTS_TYPE else "server_tool_use_requests") for t in TOKEN_TYPES),
        tokens_of().alias("total_tokens"),
        F.coalesce(F.sum(F.when((F.col("is_sidechain") == 1) & is_token(), F.col("token_count"))), F.lit(0)).alias("subagent_tokens"),
        F.min("session_id").alias("_session"), *(usd(cost(p), 6).alias(f"cost_{p}_usd") for p in providers),
        F.array_join(F.array_sort(F.collect_set(F.when((F.length("model") > 0) & (F.col("model") != SYNTHETIC_MODEL), F.col("model")))), ", ").alias("_models"),
    )
    named = ds.categories.select("prompt_id", "category", "complexity")
    real = ds.prompts.select("prompt_id", "session_id", "project", "git_branch", F.col("prompt_index").cast("string").alias("prompt_index"), "timestamp", "model", *(F.col(c).cast("string").alias(c) for c in ("char_count", "assistant_turns", "tool_calls")), "prompt_preview", F.lit(True).alias("_real"))
    meta = ds.sessions.select(F.col("session_id").alias("_sid"), "start_date", F.col("project").alias("_project"), F.col("git_branch").alias("_branch"))
    rows = real.join(pivot, "prompt_id", "full").join(named, "prompt_id", "left")
    rows = rows.withColumn("session_id", F.coalesce("session_id", "_session")).join(meta, F.col("session_id") == F.col("_sid"), "left")
    own = lambda c, other: F.coalesce(F.when(F.col("_real"), F.col(c)).otherwise(F.col(other)), F.lit(""))
    blank = lambda c: F.coalesce(F.when(F.col("_real"), F.col(c)), F.lit("")).alias(c)
    counts = [*(f"{t}_tokens" for t in TOKEN_TYPES if t != REQUESTS_TYPE), "server_tool_use_requests", "total_tokens", "subagent_tokens"]
    return rows.select(
        "session_id", F.coalesce("start_date", F.lit("")).alias("session_start_date"), own("project", "_project").alias("project"),
        own("git_branch", "_branch").alias("git_branch"), "prompt_id", blank("prompt_index"), blank("timestamp"), own("model", "_models").alias("model"),
        blank("category"), blank("complexity"), blank("char_count"), blank("assistant_turns"), blank("tool_calls"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), *(F.coalesce(f"cost_{p}_usd", F.lit(0.0)).alias(f"cost_{p}_usd") for p in providers), blank("prompt_preview"),
    )


def mini_summary(ds: Dataset, providers: Sequence[str], top: int = 3) -> DataFrame:
    """(kind, name, cost_usd): the total of each provider and the costliest projects with the first."""
    sums = priced_by(ds.tokens, ds, providers).agg(*(usd(cost(p), 2).alias(p) for p in providers))
    out = sums.select(F.inline(F.array(*(F.struct(F.lit("provider").alias("kind"), F.lit(p).alias("name"), F.col(p).alias("cost_usd")) for p in providers))))
    projects = by_project(ds, providers[0]).orderBy(F.desc("cost_usd"), "project").limit(top)
    return out.unionByName(projects.select(F.lit("project").alias("kind"), F.col("project").alias("name"), "cost_usd"))
