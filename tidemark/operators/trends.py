"""Usage over time, plans against per-unit prices, and before/after comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import filled, ratio, share, usd
from tidemark.operators.filters import day
from tidemark.operators.pricing import priced
from tidemark.operators.totals import UNCATEGORIZED, cost, tokens_of, whole, with_costs
from tidemark.plans.dataset import CONTEXT_TYPES, Dataset

PERIODS = ("day", "week", "month")


def period(by: str, date: Column) -> Column:
    """The day, the Monday of its week, or its month, as text."""
    if by not in PERIODS:
        raise ValueError(f"unknown period {by!r}: expected one of {', '.join(PERIODS)}")
    if by == "week":
        return F.date_format(F.date_trunc("week", date.cast("date")), "yyyy-MM-dd")
    return F.substring(date, 1, 10 if by == "day" else 7)


def dated(ds: Dataset, provider: str) -> DataFrame:
    """Prompts that have a day, with ``date``, units and tokens."""
    return with_costs(ds, provider).withColumn("date", day()).where(F.length("date") > 0)


def timeline(ds: Dataset, provider: str, by: str = "day") -> DataFrame:
    """Prompts, tokens and cost of each period."""
    out = dated(ds, provider).groupBy(period(by, F.col("date")).alias("period"))
    out = out.agg(F.count("*").alias("prompts"), F.sum("tokens").alias("tokens"), F.sum("units").alias("units"))
    return out.select("period", "prompts", "tokens", usd("units").alias("cost_usd"), share("units", F.sum("units").over(whole())).alias("share_pct"))


def burn_rate(ds: Dataset, provider: str, weeks: int = 8) -> DataFrame:
    """The last ``weeks`` active weeks (0: all): cost, active days, cost over seven days, change from the active week before."""
    out = dated(ds, provider).groupBy(period("week", F.col("date")).alias("week_of")).agg(
        F.count_distinct("date").alias("active_days"), F.count("*").alias("prompts"), F.sum("units").alias("units")
    )
    previous = F.lag("units").over(Window.orderBy("week_of"))
    out = out.withColumn("before", previous)
    out = out.orderBy(F.desc("week_of")).limit(weeks) if weeks else out
    change = F.when(F.col("before") != 0, ratio((F.col("units") - F.col("before")) * 100, "before", 1))
    return out.select("week_of", "active_days", "prompts", usd("units").alias("cost_usd"), usd(F.col("units") / 7).alias("per_day_usd"), change.alias("vs_prev_pct"))


def span_days(ds: Dataset) -> DataFrame:
    """(span): days from the first to the last prompt, 1 at least."""
    date = F.nullif(day(), F.lit("")).cast("date")
    return ds.prompts.agg(F.coalesce(F.datediff(F.max(date), F.min(date)) + 1, F.lit(1)).cast("long").alias("span"))


def monthly(ds: Dataset, provider: str) -> DataFrame:
    """(units, span, month_units): the whole cost, and 30 days of it at the observed rate."""
    whole = priced(ds.tokens, ds, provider).agg(cost().alias("units"))
    return whole.crossJoin(span_days(ds)).withColumn("month_units", F.col("units").cast("double") * 30 / F.col("span"))  # one row each


def break_even(ds: Dataset, provider: str) -> DataFrame:
    """Each plan's price against the month's cost by units."""
    plans = ds.plans.where(F.col("kind") == "plan")
    rows = plans.crossJoin(monthly(ds, provider))  # a plan table and one row
    return rows.select(
        F.col("label").alias("plan"), usd("monthly_units", 2).alias("monthly_price_usd"), usd("month_units", 2).alias("api_equiv_month_usd"),
        ratio("month_units", "monthly_units").alias("vs_plan"), usd(F.col("month_units") - F.col("monthly_units"), 2).alias("saving_month_usd"),
    )


def bundle_costs(ds: Dataset, provider: str) -> DataFrame:
    """Plans that include some usage and charge what exceeds it."""
    rows = ds.plans.where(F.col("kind") == "bundle").crossJoin(monthly(ds, provider))
    over = F.greatest(F.lit(0.0), F.col("month_units") - F.col("included_units"))
    return rows.select(
        "label", usd("monthly_units", 2).alias("monthly_usd"), usd("included_units", 2).alias("included_usd"), usd(over, 2).alias("overage_usd"),
        usd(F.col("monthly_units") + over, 2).alias("total_usd"), usd("month_units", 2).alias("usage_month_usd"), usd("units", 2).alias("usage_actual_usd"), F.col("span").alias("span_days"),
    )


def peak_quota(quota: DataFrame) -> DataFrame:
    """The highest utilization seen of each field."""
    return quota.where(F.col("utilization_pct").isNotNull() & (F.length("field") > 0)).groupBy("field").agg(F.max("utilization_pct").alias("peak_pct"))


def latest_quota(quota: DataFrame) -> DataFrame:
    """The latest snapshot of each field."""
    best = F.max_by(F.struct("snapshot_at", "utilization_pct", "resets_at"), F.struct("snapshot_at", "utilization_pct"))
    return quota.groupBy("field").agg(best.alias("b")).select("field", "b.*")


METRICS = (
    "cost_per_prompt", "output_share", "context_share", "cache_read_per_turn", "output_per_prompt",
    "prompts", "total_cost", "days", "prompts_per_session", "tasks",
)


def side_stats(ds: Dataset, provider: str, pivot: str) -> DataFrame:
    """One row for each side of a day that has prompts: ratios that don't depend on volume, and the volumes themselves.

    A fact is read once for both sides: prompts with their day say on which side the rest of a dataset falls, as
    ``filter_dates`` would have it (usage without a prompt follows its session's prompts, on both sides if it has both).
    """
    side = F.when(F.col("date") < pivot, "before").otherwise("after").alias("side")
    prompts = ds.prompts.withColumn("date", day()).select("prompt_id", "session_id", "date", side)
    of_prompt = prompts.select("prompt_id", "side")
    of_session = prompts.groupBy("session_id").agg(F.collect_set("side").alias("sides"))
    counts = prompts.groupBy("side").agg(
        F.count("*").alias("prompts"), F.count_distinct("session_id").alias("sessions"),
        (F.datediff(F.max(F.nullif("date", F.lit("")).cast("date")), F.min(F.nullif("date", F.lit("")).cast("date"))) + 1).alias("span"),
    )

    def sided(rows: DataFrame, *sums: Column) -> DataFrame:
        """Sums by side of rows with prompt_id and session_id."""
        found = rows.join(of_prompt, "prompt_id", "left").join(of_session, "session_id", "left")
        sides = F.when(F.col("side").isNotNull(), F.array("side")).otherwise(F.col("sides"))
        return found.withColumn("side", F.explode(sides)).groupBy("side").agg(*sums)

    # per prompt first, so that few rows meet the sides
    kinds = {"output_units": ["output"], "context_units": list(CONTEXT_TYPES)}
    of = lambda value, *kind: F.coalesce(F.sum(F.when(F.col("token_type").isin(*kind), F.col(value))), F.lit(0))
    usage = priced(ds.tokens, ds, provider).groupBy("prompt_id", "session_id").agg(
        cost().alias("units"), *(of("units", *k).alias(n) for n, k in kinds.items()), of("token_count", "cache_read").alias("reads"), of("token_count", "output").alias("outputs")
    )
    names = ("units", *kinds, "reads", "outputs")
    usage = sided(usage, *(F.sum(n).alias(n) for n in names))
    turns = sided(ds.requests.groupBy("prompt_id", "session_id").agg(F.count("*").alias("n")), F.sum("n").alias("turns"))
    members = ds.task_prompts.join(of_prompt, "prompt_id").groupBy("side").agg(F.count_distinct("task_id").alias("tasks"))
    one = counts.join(usage, "side", "left").join(turns, "side", "left").join(members, "side", "left").fillna(0, subset=[*names, "turns", "tasks"])
    return one.select(
        "side", usd(F.try_divide(F.col("units"), F.col("prompts"))).alias("cost_per_prompt"), ratio(F.col("output_units") * 100, "units", 1).alias("output_share"),
        ratio(F.col("context_units") * 100, "units", 1).alias("context_share"), ratio("reads", "turns", 1).alias("cache_read_per_turn"),
        ratio("outputs", "prompts", 1).alias("output_per_prompt"), F.col("prompts").cast("double").alias("prompts"), usd("units", 2).alias("total_cost"),
        F.coalesce("span", F.lit(1)).cast("double").alias("days"), ratio("prompts", "sessions", 1).alias("prompts_per_session"), F.col("tasks").cast("double").alias("tasks"),
    )


EMPTY_SIDE = ("prompts", "total_cost", "days", "tasks")  # 0 where a side has no prompts; ratios are null


def impact(ds: Dataset, provider: str, pivot: str) -> DataFrame:
    """(metric, before, after, change): each metric on both sides of a day; change is null where a side has none."""
    rows = side_stats(ds, provider, pivot)
    rows = rows.select("side", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))
    at = lambda name: F.max(F.when(F.col("side") == name, F.col("value")))
    zero = F.when(F.col("metric").isin(*EMPTY_SIDE), 0.0)
    names = ds.prompts.sparkSession.createDataFrame([(m,) for m in METRICS], "metric string")
    out = names.join(rows.groupBy("metric").agg(at("before").alias("before"), at("after").alias("after")), "metric", "left")
    out = out.select("metric", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
    return out.withColumn("change", F.floor((F.col("after") - F.col("before")) * 10000 + 0.5) / 10000.0)


def top_category(ds: Dataset) -> DataFrame:
    """The most frequent category among the prompts, ties to the first by name."""
    named = ds.prompts.join(ds.categories.select("prompt_id", "category"), "prompt_id").where(F.length("category") > 0)
    return named.groupBy(filled("category", UNCATEGORIZED).alias("category")).count().orderBy(F.desc("count"), "category").limit(1)


def daily(ds: Dataset, provider: str) -> DataFrame:
    """Cost, prompts and tokens of each calendar day from the first to the last, days without any included, and the change
    of the last seven days' cost from the seven before."""
    days = dated(ds, provider).groupBy("date").agg(F.count("*").alias("prompts"), F.sum("tokens").alias("tokens"), F.sum("units").alias("units"))
    range_ = days.agg(F.min(F.col("date").cast("date")).alias("a"), F.max(F.col("date").cast("date")).alias("b")).where("a is not null")
    calendar = range_.select(F.explode(F.sequence("a", "b")).alias("date")).select(F.col("date").cast("string").alias("date"))
    rows = calendar.join(days, "date", "left").fillna(0, subset=["prompts", "tokens", "units"])
    order = Window.orderBy("date")
    last, prior = F.sum("units").over(order.rowsBetween(-6, 0)), F.sum("units").over(order.rowsBetween(-13, -7))
    return rows.select("date", "prompts", "tokens", usd("units").alias("cost_usd"), usd(last).alias("last_7_usd"), F.when(prior != 0, ratio((last - prior) * 100, prior, 1)).alias("vs_prior_pct"))


def cost_by_period(ds: Dataset, provider: str, by: str, of: str, values: Sequence[str]) -> DataFrame:
    """Cost of each period, one column for each of ``values`` of the token column ``of``."""
    rows = priced(ds.tokens, ds, provider).join(ds.prompts.select("prompt_id", day().alias("date")), "prompt_id").where(F.length("date") > 0)
    out = rows.groupBy(period(by, F.col("date")).alias("period")).pivot(of, list(values)).agg(cost())
    return out.select("period", *(usd(F.coalesce(F.col(f"`{v}`"), F.lit(0))).alias(v) for v in values))


def granularity(first: Column, last: Column) -> Column:
    """The period that suits a range: up to 31 days the day, up to 183 the week, else the month."""
    span = F.datediff(last.cast("date"), first.cast("date"))
    return F.when(span <= 31, "day").when(span <= 183, "week").otherwise("month")


def heat_map(ds: Dataset, provider: str, offset_hours: int = 0) -> DataFrame:
    """Prompts and cost of each weekday (0 is Monday) and hour, all 168 of them."""
    at = F.try_to_timestamp("timestamp") + F.make_interval(hours=F.lit(offset_hours))
    rows = with_costs(ds, provider).where(at.isNotNull())
    found = rows.groupBy(F.weekday(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("prompts"), F.sum("units").alias("units"))
    grid = ds.prompts.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(found, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("prompts", F.lit(0)).alias("prompts"), usd(F.coalesce("units", F.lit(0))).alias("cost_usd"))
