"""Analyses of request chains: each session's requests outside subagents, in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import ratio, share, usd
from tidemark.operators.pricing import priced_requests
from tidemark.operators.quantiles import quantiles
from tidemark.operators.totals import tokens_of, with_costs
from tidemark.plans.dataset import Dataset

#: Depth bands (from, to, label); the last is open.
DEPTH_BANDS = (
    (1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 5, "5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, None, "51+"),
)
#: The finer bands of ``depth_quantiles``.
FINE_BANDS = (
    (1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 5, "5"), (6, 6, "6"), (7, 7, "7"), (8, 8, "8"), (9, 9, "9"), (10, 10, "10"),
    (11, 15, "11-15"), (16, 20, "16-20"), (21, None, "21+"),
)
#: Pauses in seconds [from, to), label.
GAPS = ((0, 300, "<= 5m"), (300, 3600, "5m-1h"), (3600, 21600, "1h-6h"), (21600, None, "> 6h"))
BASELINE_GAP = GAPS[0][2]
NO_BASELINE = 20_000


def banded(x: Column, bands: tuple, inclusive: bool) -> tuple[Column, Column]:
    """(position, label) of the band in which ``x`` lies."""
    position, label = F, F
    for i, (_, hi, name) in enumerate(bands):
        inside = F.lit(True) if hi is None else (x <= hi if inclusive else x < hi)
        position, label = position.when(inside, i), label.when(inside, name)
    return position, label


def depth(index: Column) -> tuple[Column, Column]:
    return banded(index, DEPTH_BANDS, True)


def chain_order() -> Window:
    return Window.partitionBy("session_id").orderBy(F.coalesce("timestamp", F.lit("")), "prompt_id", "request_index")


def main_chain(ds: Dataset, provider: str) -> DataFrame:
    """Priced requests outside subagents, each with what the one before it was."""
    order = chain_order()
    rows = priced_requests(ds, provider).where(F.coalesce("is_sidechain", F.lit(0)) == 0)
    return rows.withColumns({
        "before_timestamp": F.lag("timestamp").over(order), "before_context": F.lag("context").over(order),
        "before_compact": F.coalesce(F.lag("post_compact").over(order), F.lit(0)),
    })


def session_depth(ds: Dataset, provider: str) -> DataFrame:
    """Cost of a prompt, cost and reads of a turn, and mix of input-side tokens by the prompt's position in its session."""
    kinds = ds.tokens.groupBy("prompt_id").agg(*(tokens_of(t).alias(t) for t in ("input", "cache_read", "cache_write_5m", "cache_write_1h")))
    rows = with_costs(ds, provider).where(F.col("prompt_index") >= 1).join(kinds, "prompt_id", "left")
    position, label = depth(F.col("prompt_index"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = rows.groupBy(position.alias("band"), label.alias("depth")).agg(
        F.count("*").alias("prompts"), F.sum("units").alias("units"), F.coalesce(F.sum("assistant_turns"), F.lit(0)).alias("turns"),
        *(total(c) for c in ("input", "cache_read", "cache_write_5m", "cache_write_1h")),
    )
    base = F.first(F.col("units").cast("double") / F.col("prompts")).over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"base": base, "side": F.col("input") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h")})
    part = lambda c: share(c, "side")
    return out.select(
        "depth", "prompts", usd(F.col("units") / F.col("prompts")).alias("avg_cost_usd"),
        ratio(F.col("units").cast("double") / F.col("prompts"), "base").alias("vs_depth_1"), usd(F.try_divide("units", "turns")).alias("cost_per_turn_usd"),
        F.when(F.col("turns") != 0, F.floor(F.col("cache_read") / F.col("turns"))).alias("cache_read_per_turn"), part("cache_read").alias("cache_read_pct"),
        part("cache_write_5m").alias("cache_write_5m_pct"), part("cache_write_1h").alias("cache_write_1h_pct"), part("input").alias("fresh_input_pct"),
    )


def context_growth(ds: Dataset, provider: str) -> DataFrame:
    """Median and 90th-percentile context, reads and cost of a request by its prompt's depth."""
    index = ds.prompts.where(F.col("prompt_index") >= 1).select("prompt_id", "prompt_index")
    rows = priced_requests(ds, provider).where(F.coalesce("is_sidechain", F.lit(0)) == 0).join(index, "prompt_id")
    position, label = depth(F.col("prompt_index"))
    rows = rows.withColumns({"band": position, "depth": label})
    out = rows.groupBy("band", "depth").agg(
        F.count("*").alias("requests"), F.sum("cache_read_tokens").alias("reads"), F.sum("units").alias("units")
    )
    out = out.join(quantiles(rows, ["band"], "context", {"median_context": 0.5}, {"p90_context": 0.9}), "band").withColumn("median_context", F.floor("median_context"))
    base = F.first("median_context").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("base", base).select(
        "depth", "requests", "median_context", "p90_context", F.floor(F.col("reads") / F.col("requests")).alias("cache_read_per_turn"),
        ratio("median_context", "base").alias("vs_depth_1"), usd(F.col("units") / F.col("requests")).alias("cost_per_request_usd"),
    )


def ttl_losses(ds: Dataset, provider: str) -> DataFrame:
    """Cache writes after pauses, and their cost in excess of the median write after short ones."""
    seconds = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c))) / 1e6
    rows = main_chain(ds, provider).withColumn("gap_seconds", seconds("timestamp") - seconds("before_timestamp")).where(F.col("gap_seconds") >= 0)
    position, label = banded(F.col("gap_seconds"), GAPS, False)
    rows = rows.select(position.alias("position"), label.alias("gap"), "writes", "write_units")
    short = quantiles(rows.where(F.col("gap") == BASELINE_GAP), [], "writes", {"median": 0.5}).select(F.coalesce(F.floor("median"), F.lit(0)).alias("baseline"))
    rows = rows.crossJoin(short)  # one row
    over = F.when((F.col("baseline") > 0) & (F.col("writes") > F.col("baseline")), F.col("write_units").cast("double") * (F.col("writes") - F.col("baseline")) / F.col("writes"))
    over = F.when((F.col("baseline") == 0) & (F.col("writes") > 0), F.col("write_units").cast("double")).otherwise(over)
    whole = F.coalesce(F.floor(over), F.lit(0)).cast("long")  # to the unit, so that sums don't depend on order
    out = rows.groupBy("position", "gap").agg(
        F.count("*").alias("events"), F.sum("writes").alias("tokens"), F.sum("write_units").alias("units"), F.sum(whole).alias("excess")
    )
    return out.select(
        "gap", "events", F.floor(F.col("tokens") / F.col("events")).alias("avg_write_tokens"), usd("units").alias("write_cost_usd"),
        F.when(F.col("gap") != BASELINE_GAP, usd("excess")).alias("excess_cost_usd"),
    )


def compaction_rows(ds: Dataset, provider: str) -> DataFrame:
    """Requests that follow a compaction: those marked so after one that isn't, or at a chain's start."""
    return main_chain(ds, provider).where((F.col("post_compact") == 1) & (F.col("before_compact") == 0))


def compactions(ds: Dataset, provider: str) -> DataFrame:
    """Context before and after each compaction, and what rebuilding the cache took."""
    rows = compaction_rows(ds, provider).join(ds.sessions.select("session_id", "project"), "session_id", "left")
    less = ratio((F.col("before_context") - F.col("context")) * 100, "before_context", 1)
    return rows.select(
        "timestamp", "session_id", F.coalesce("project", F.lit("")).alias("project"), F.col("before_context").alias("context_before"),
        F.col("context").alias("context_after"), less.alias("reduction_pct"), F.col("writes").alias("rebuild_tokens"), usd("write_units").alias("rebuild_cost_usd"),
    )


def first_requests(ds: Dataset, provider: str) -> DataFrame:
    """The first request outside subagents of each session's first prompt."""
    first = ds.prompts.where(F.col("prompt_index") == 1).select("prompt_id", F.col("timestamp").alias("prompt_timestamp"))
    rows = priced_requests(ds, provider).where(F.coalesce("is_sidechain", F.lit(0)) == 0).join(first, "prompt_id")
    order = Window.partitionBy("session_id").orderBy("request_index", "prompt_id", "timestamp")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def session_overhead(ds: Dataset, provider: str) -> DataFrame:
    """What each session's first request sends before any conversation."""
    rows = first_requests(ds, provider).join(ds.sessions.select("session_id", "project"), "session_id", "left")
    started = F.substring(F.coalesce(F.nullif("prompt_timestamp", F.lit("")), "timestamp", F.lit("")), 1, 10)
    return rows.select(
        started.alias("started"), "session_id", F.coalesce("project", F.lit("")).alias("project"), F.coalesce("model", F.lit("")).alias("model"),
        F.col("context").alias("overhead_tokens"), F.col("writes").alias("cache_write_tokens"), usd("units").alias("first_request_cost_usd"),
    )


def overhead_notes(ds: Dataset, provider: str) -> DataFrame:
    """(median_tokens, p10_tokens, p90_tokens): what sessions' first requests send, in one row; of nulls without any."""
    found = quantiles(first_requests(ds, provider), [], "context", {"median_tokens": 0.5}, {"p10_tokens": 0.1, "p90_tokens": 0.9})
    return found.select(*(F.floor(n).cast("long").alias(n) for n in ("median_tokens", "p10_tokens", "p90_tokens")))


def baseline(ds: Dataset, provider: str) -> DataFrame:
    """(baseline): median context after compactions, else of first requests, else a constant."""
    median = lambda rows, name: quantiles(rows, [], "context", {name: 0.5}).select(F.floor(name).alias(name))
    both = median(compaction_rows(ds, provider), "a").crossJoin(median(first_requests(ds, provider), "b"))  # one row each
    return both.select(F.coalesce("a", "b", F.lit(NO_BASELINE)).cast("long").alias("baseline"))


def recommendations(ds: Dataset, provider: str, min_prompts: int = 50, compact_at: int = 30) -> DataFrame:
    """What compacting sessions of more than ``min_prompts`` prompts at prompt ``compact_at`` would have saved in cache reads."""
    long_ = ds.prompts.groupBy("session_id").agg(F.count("*").alias("prompts")).where(F.col("prompts") > min_prompts)
    index = ds.prompts.select("prompt_id", "prompt_index")
    rows = main_chain(ds, provider).join(long_.select("session_id"), "session_id", "left_semi").join(index, "prompt_id", "left").crossJoin(baseline(ds, provider))
    late = F.coalesce(F.col("prompt_index"), F.lit(0)) > compact_at
    saved = F.greatest(F.lit(0), F.col("cache_read_tokens") - F.col("baseline")) * F.col("read_rate")
    place = F.struct(F.coalesce("timestamp", F.lit("")), "prompt_id", "request_index")
    out = rows.groupBy("session_id").agg(
        F.sum(F.col("read_units") + F.col("write_units")).alias("rent"), F.sum(F.when(late, saved)).alias("saved"),
        F.min_by(F.when(late, F.col("rebuild_rate") * F.col("baseline")), F.when(late, place)).alias("rebuild"),
    )
    out = out.where(F.col("saved").isNotNull()).withColumn("net", F.col("saved") - F.col("rebuild"))
    out = out.join(long_, "session_id").join(ds.sessions.select("session_id", "project"), "session_id", "left")
    return out.select("session_id", F.coalesce("project", F.lit("")).alias("project"), "prompts", usd("rent").alias("rent_usd"), usd(F.col("rent") - F.col("net")).alias("est_compacted_usd"), usd("net").alias("saving_usd"))


def cost_boxes(ds: Dataset, provider: str, of: str) -> DataFrame:
    """Count and the 5th, 25th, 50th, 75th and 95th percentiles of the cost of a prompt by a column of ``prompts``."""
    points = {"p05_usd": 0.05, "q1_usd": 0.25, "median_usd": 0.5, "q3_usd": 0.75, "p95_usd": 0.95}
    rows = with_costs(ds, provider).select(of, "units")
    out = rows.groupBy(of).agg(F.count("*").alias("prompts")).join(quantiles(rows, [of], "units", points), of)
    exact = lambda x: F.floor(x * 20 + 0.5) / 20.0  # noqa: E731  what interpolation between whole numbers gives at these points
    return out.select(of, "prompts", *(usd(exact(F.col(n))).alias(n) for n in points))


def depth_quantiles(ds: Dataset) -> DataFrame:
    """Quartiles of each type's tokens in a prompt by its place in the session, prompts without that type counting 0."""
    kinds = ["input", "output", "cache_read", "cache_write_5m", "cache_write_1h"]
    per = ds.tokens.groupBy("prompt_id").pivot("token_type", kinds).agg(F.sum("token_count"))
    rows = ds.prompts.where(F.col("prompt_index") >= 1).select("prompt_id", "prompt_index").join(per, "prompt_id", "left").fillna(0, subset=kinds)
    _, label = banded(F.col("prompt_index"), FINE_BANDS, True)
    long_ = rows.select(label.alias("depth"), F.inline(F.array(*(F.struct(F.lit(k).alias("token_type"), F.col(k).alias("n")) for k in kinds))))
    out = long_.groupBy("depth", "token_type").agg(F.count("*").alias("prompts"))
    return out.join(quantiles(long_, ["depth", "token_type"], "n", {"p25": 0.25, "median": 0.5, "p75": 0.75}), ["depth", "token_type"])


def main_chain_cache(ds: Dataset, provider: str) -> DataFrame:
    """The billed cache cost of all requests outside subagents, which attributed context reconciles to."""
    return priced_requests(ds, provider).where(F.coalesce("is_sidechain", F.lit(0)) == 0).agg(F.coalesce(F.sum(F.col("read_units") + F.col("write_units")), F.lit(0)).alias("units"))

