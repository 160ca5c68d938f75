"""Views for looking into usage: volumes, distributions, sessions, files, and what changed on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import filled, ratio, share, usd
from tidemark.operators.chains import banded, cost_boxes
from tidemark.operators.content import by_file, output_split, priced_context, running_total, zero
from tidemark.operators.filters import day
from tidemark.operators.pricing import priced
from tidemark.operators.totals import UNKNOWN, cost, is_token, with_costs
from tidemark.plans.dataset import UNATTRIBUTED, Dataset

OVERHEAD = "(session overhead)"
#: Ranges of characters [from, to), label; the last is open.
CHARACTERS = (
    (0, 50, "0-50"), (50, 100, "50-100"), (100, 150, "100-150"), (150, 200, "150-200"), (200, 300, "200-300"), (300, 400, "300-400"), (400, 500, "400-500"),
    (500, 750, "500-750"), (750, 1000, "750-1k"), (1000, 1500, "1k-1.5k"), (1500, 2000, "1.5k-2k"), (2000, 3000, "2k-3k"), (3000, 5000, "3k-5k"),
    (5000, 7500, "5k-7.5k"), (7500, None, "7.5k+"),
)


def type_volume(ds: Dataset, provider: str) -> DataFrame:
    """Tokens of each type with its share of all tokens (none for requests), and what of its cost subagents have."""
    rows = priced(ds.tokens, ds, provider).groupBy("token_type").agg(
        F.sum("token_count").alias("tokens"), zero(F.sum(F.when(F.col("is_sidechain") == 1, F.col("units")))).alias("side")
    )
    sums = rows.agg(F.sum(F.when(is_token(), F.col("tokens"))).alias("all_tokens"), F.sum("side").alias("all_side"))
    rows = rows.crossJoin(sums)  # one row
    return rows.select("token_type", "tokens", F.when(is_token(), share("tokens", "all_tokens")).alias("share_pct"), usd("side").alias("subagent_usd"), share("side", "all_side").alias("subagent_share_pct"))


def box_cap(ds: Dataset, provider: str, of: str) -> DataFrame:
    """(axis_usd, above): a quarter above the highest third quartile of ``cost_boxes``, and the prompts that cost more.

    Null and 0 where no box has a positive third quartile.
    """
    cap = cost_boxes(ds, provider, of).agg(F.max("q3_usd").alias("q3"))
    cap = cap.select(F.when(F.col("q3") > 0, F.floor(F.col("q3") * 125 + 0.5) / 100.0).alias("axis_usd"))
    units = with_costs(ds, provider).select("units").crossJoin(cap)  # one row
    above = units.agg(F.count_if(F.col("units").cast("double") / 1e8 > F.col("axis_usd")).alias("above"))
    return cap.crossJoin(above)  # one row each


def project_pareto(ds: Dataset, provider: str) -> DataFrame:
    """Cost of each project that has any, by the prompt's project; usage without a prompt is overhead. With running share."""
    rows = priced(ds.tokens, ds, provider).groupBy("prompt_id").agg(cost().alias("units"))
    rows = rows.join(ds.prompts.select("prompt_id", filled("project", UNKNOWN).alias("project")), "prompt_id", "left")
    out = rows.groupBy(F.coalesce("project", F.lit(OVERHEAD)).alias("project")).agg(F.sum("units").alias("units")).where(F.col("units") > 0)
    out = running_total(out, "units", [F.desc("units"), F.col("project")], "running", total="total")
    return out.select("project", usd("units").alias("cost_usd"), share("units", "total").alias("share_pct"), share("running", "total").alias("cumulative_pct"))


def project_sessions(ds: Dataset, provider: str) -> DataFrame:
    """Cost of each session that has any, under its project."""
    rows = priced(ds.tokens, ds, provider).groupBy("session_id").agg(cost().alias("units")).where(F.col("units") > 0)
    rows = rows.join(ds.sessions.select("session_id", filled("project", UNKNOWN).alias("project")), "session_id", "left")
    return rows.select(F.coalesce("project", F.lit(UNKNOWN)).alias("project"), "session_id", usd("units").alias("cost_usd"))


def session_sizes(ds: Dataset) -> DataFrame:
    """(prompts, sessions): how many sessions have so many prompts."""
    return ds.prompts.groupBy("session_id").agg(F.count("*").alias("prompts")).groupBy("prompts").agg(F.count("*").alias("sessions"))


def prompt_lengths(ds: Dataset) -> DataFrame:
    """(characters, prompts) for each range of characters, empty ones included."""
    _, label = banded(F.col("char_count"), CHARACTERS, False)
    found = ds.prompts.where(F.col("char_count") >= 0).groupBy(label.alias("characters")).agg(F.count("*").alias("prompts"))
    names = ds.prompts.sparkSession.createDataFrame([(i, name) for i, (*_, name) in enumerate(CHARACTERS)], "position int, characters string")
    return names.join(found, "characters", "left").select("position", "characters", zero("prompts").alias("prompts"))


def session_rollup(ds: Dataset, provider: str) -> DataFrame:
    """Prompts, first day, most frequent model (ties by name), project and cost of each session that has prompts."""
    per = ds.prompts.groupBy("session_id", "model").agg(F.count("*").alias("n"), F.min(F.nullif(day(), F.lit(""))).alias("first"))
    best = F.min_by("model", F.when(F.col("model").isNotNull(), F.struct(-F.col("n"), F.col("model"))))
    out = per.groupBy("session_id").agg(F.sum("n").alias("prompts"), F.min("first").alias("day"), best.alias("model"))
    spent = priced(ds.tokens, ds, provider).groupBy("session_id").agg(cost().alias("units"))
    out = out.join(spent, "session_id", "left").join(ds.sessions.select("session_id", "project"), "session_id", "left")
    return out.select("session_id", "prompts", "day", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("project", F.lit("")).alias("project"), usd(zero("units")).alias("cost_usd"))


def session_timeline(ds: Dataset, provider: str) -> DataFrame:
    """Each prompt's cost and its session's cost so far, in order; ``mark`` names a session's first, costliest and last prompt."""
    rows = with_costs(ds, provider).where(F.col("prompt_index").isNotNull())
    order = Window.partitionBy("session_id").orderBy("prompt_index", "prompt_id")
    back = Window.partitionBy("session_id").orderBy(F.desc("prompt_index"), F.desc("prompt_id"))
    top = Window.partitionBy("session_id").orderBy(F.desc("units"), "prompt_index", "prompt_id")
    marks = F.array_compact(F.array(*(F.when(F.row_number().over(w) == 1, name) for w, name in ((order, "first"), (top, "costliest"), (back, "last")))))
    so_far = F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("session_id", "prompt_id", "prompt_index", usd("units").alias("cost_usd"), usd(so_far).alias("cumulative_usd"), F.array_join(marks, ",").alias("mark"))


def edited_by(ds: Dataset, path: str | None = None) -> DataFrame:
    """The prompts that edited a file (all files without ``path``), with their task, session, place and category."""
    files = ds.output_files if path is None else ds.output_files.where(F.col("path") == path)
    rows = files.groupBy("path", "prompt_id").agg(*(zero(F.sum(c)).alias(c) for c in ("edits", "lines_added", "lines_deleted")))
    named = ds.task_prompts.join(ds.tasks.select("task_id", F.coalesce(F.nullif("name", F.lit("")), "task_id").alias("task")), "task_id").select("prompt_id", "task")
    rows = rows.join(named, "prompt_id", "left").join(ds.prompts.select("prompt_id", "session_id", "prompt_index"), "prompt_id", "left")
    rows = rows.join(ds.categories.select("prompt_id", "category"), "prompt_id", "left")
    return rows.select("path", "prompt_id", "edits", "lines_added", "lines_deleted", F.coalesce("task", F.lit("")).alias("task"), "session_id", "prompt_index", F.coalesce("category", F.lit("")).alias("category"))


def read_in(ds: Dataset, provider: str, path: str | None = None) -> DataFrame:
    """The sessions that kept a file in context (all files without ``path``): reads, tokens and context cost."""
    inside = F.col("source") == "file_read"
    inside = inside if path is None else inside & (F.col("path") == path)
    reads = ds.context_sources.where(inside).groupBy("path", "session_id").agg(F.sum("items").alias("reads"), F.sum("tokens").alias("tokens"), F.lit(0).cast("long").alias("units"))
    kept = priced_context(ds, provider).where(inside).groupBy("path", "session_id").agg(F.lit(0).cast("long").alias("reads"), F.lit(0).cast("long").alias("tokens"), F.sum("units").alias("units"))
    both = reads.unionByName(kept).groupBy("path", "session_id").agg(*(zero(F.sum(c)).alias(c) for c in ("reads", "tokens", "units")))
    both = both.join(ds.sessions.select("session_id", "project"), "session_id", "left")
    return both.select("path", "session_id", "reads", "tokens", usd("units").alias("context_usd"), F.coalesce("project", F.lit("")).alias("project"))


def side_of(pivot: str) -> Column:
    return F.when(day() < pivot, "before").otherwise("after").alias("side")


def type_costs(ds: Dataset, provider: str, pivot: str) -> DataFrame:
    """(side, token_type, usd_per_prompt): the average cost of a prompt by token type before and from a day on; 0 is left out.

    Usage without a prompt follows its session's prompts, on both sides if it has both.
    """
    prompts = ds.prompts.select("prompt_id", "session_id", side_of(pivot))
    counts = prompts.groupBy("side").agg(F.count("*").alias("prompts"))
    of_session = prompts.groupBy("session_id").agg(F.collect_set("side").alias("sides"))
    rows = priced(ds.tokens, ds, provider).groupBy("prompt_id", "session_id", "token_type").agg(cost().alias("units"))
    rows = rows.join(prompts.select("prompt_id", "side"), "prompt_id", "left").join(of_session, "session_id", "left")
    rows = rows.withColumn("side", F.explode(F.when(F.col("side").isNotNull(), F.array("side")).otherwise(F.col("sides"))))
    out = rows.groupBy("side", "token_type").agg(F.sum("units").alias("units")).where(F.col("units") > 0).join(counts, "side")
    return out.select("side", "token_type", usd(F.col("units") / F.col("prompts"), 6).alias("usd_per_prompt"))


def language_shares(ds: Dataset, pivot: str) -> DataFrame:
    """(side, language, share_pct): what share of the lines added each language has before and from a day on."""
    rows = ds.output_files.join(ds.prompts.select("prompt_id", side_of(pivot)), "prompt_id")
    out = rows.groupBy("side", filled("language", UNKNOWN).alias("language")).agg(zero(F.sum("lines_added")).alias("lines")).where(F.col("lines") > 0)
    return out.select("side", "language", share("lines", F.sum("lines").over(Window.partitionBy("side"))).alias("share_pct"))  # over groups


def efficiency(ds: Dataset, provider: str) -> DataFrame:
    """One row: shares of code in the output's cost, of tests in lines added, of rent in the context's cost; cost and tokens
    of a line. Null where there is nothing to divide by."""
    split = output_split(ds, provider).select("prose_cost_usd", "code_cost_usd", "code_tokens")
    lines = ds.output_files.agg(zero(F.sum("lines_added")).alias("lines"), zero(F.sum(F.when(F.col("kind") == "test", F.col("lines_added")))).alias("test"))
    context = priced_context(ds, provider).where(F.col("source") != UNATTRIBUTED).agg(zero(F.sum("rent_units")).alias("rent"), zero(F.sum(F.col("rent_units") + F.col("load_units"))).alias("context"))
    one = split.crossJoin(lines).crossJoin(context)  # one row each
    return one.select(
        ratio(F.col("code_cost_usd") * 100, F.col("prose_cost_usd") + F.col("code_cost_usd"), 1).alias("code_share_pct"), ratio(F.col("test") * 100, "lines", 1).alias("test_share_pct"),
        ratio(F.col("rent") * 100, "context", 1).alias("rent_share_pct"), ratio("code_cost_usd", "lines", 4).alias("cost_per_line_usd"), ratio("code_tokens", "lines", 2).alias("tokens_per_line"),
    )


def file_population(ds: Dataset, provider: str) -> DataFrame:
    """One row: how many files there are in all, their lines, reads and context cost."""
    sums = ("edits", "lines_added", "lines_deleted", "reads")
    spent = priced_context(ds, provider).where((F.col("source") == "file_read") & F.col("path").isNotNull() & ~F.col("path").isin("", "-")).agg(usd(cost()).alias("context_usd"))
    return by_file(ds, provider).agg(F.count("*").alias("files"), *(zero(F.sum(c)).alias(c) for c in sums)).crossJoin(spent)  # one row each
