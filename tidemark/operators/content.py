"""What was produced and what filled the context: files, languages, loading and rent, and graphs around files and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.money import filled, share, usd
from tidemark.functions.paths import kind_of
from tidemark.operators.pricing import priced
from tidemark.operators.totals import UNCATEGORIZED, cost, whole
from tidemark.plans.dataset import CONTEXT_TYPES, NO_VALUE, UNATTRIBUTED, Dataset


def zero(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0))


def output_costs(ds: Dataset, provider: str) -> DataFrame:
    """(prompt_id, prose, code, units, prose_units, code_units): output cost in proportion to prose and code tokens."""
    spent = priced(ds.tokens.where(F.col("token_type") == "output"), ds, provider).groupBy("prompt_id").agg(cost().alias("units"))
    rows = ds.output_tokens.select("prompt_id", zero("output_prose_tokens").alias("prose"), zero("output_code_tokens").alias("code"))
    rows = rows.join(spent, "prompt_id", "left").fillna(0, subset=["units"])
    weight = F.col("prose") + F.col("code")
    prose = F.when(weight > 0, F.floor(F.col("units").cast("double") * F.col("prose") / weight + 0.5)).otherwise(F.col("units")).cast("long")
    return rows.withColumn("prose_units", prose).withColumn("code_units", F.col("units") - F.col("prose_units"))


def language_costs(ds: Dataset, provider: str) -> DataFrame:
    """(language, code_units): code cost by the languages that a prompt edited, in proportion to lines; the rest is tooling,
    under a null language. Shares are cut to whole units and what is cut stays with tooling, so the sum is exact."""
    churn = ds.output_files.groupBy("prompt_id", filled("language", "(unknown)").alias("language")).agg(F.sum(zero("lines_added") + zero("lines_deleted")).alias("churn"))
    churn = churn.withColumn("all_churn", F.sum("churn").over(Window.partitionBy("prompt_id"))).where(F.col("all_churn") > 0)
    code = output_costs(ds, provider).select("prompt_id", "code_units")
    parts = churn.join(code, "prompt_id").select("prompt_id", "language", F.floor(F.col("code_units").cast("double") * F.col("churn") / F.col("all_churn")).cast("long").alias("code_units"))
    taken = parts.agg(F.sum("code_units").alias("taken"))
    rest = code.agg(F.sum("code_units").alias("total")).crossJoin(taken)  # one row each
    rest = rest.select(F.lit(None).cast("string").alias("language"), (zero("total") - zero("taken")).alias("code_units"))
    return parts.groupBy("language").agg(F.sum("code_units").alias("code_units")).unionByName(rest)


def by_output(ds: Dataset, provider: str) -> DataFrame:
    """Files, lines, share of tests and code cost of each language, and a TOTAL row."""
    rows = ds.output_files.select(filled("language", "(unknown)").alias("language"), zero("lines_added").alias("added"), zero("lines_deleted").alias("deleted"), "path", "kind")
    out = rows.groupBy("language").agg(
        F.count_distinct(F.coalesce("path", F.lit(""))).alias("files"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"),
        zero(F.sum(F.when(F.col("kind") == "test", F.col("added")))).alias("test"),
    )
    spent = language_costs(ds, provider).where(F.col("language").isNotNull())
    out = out.join(spent, "language", "left").fillna(0, subset=["code_units"])
    sums = ["files", "lines_added", "lines_deleted", "test", "code_units"]
    total = out.agg(*(zero(F.sum(c)).alias(c) for c in sums), F.count("*").alias("n")).where(F.col("n") > 0).select(F.lit("TOTAL").alias("language"), *sums)
    out = out.withColumn("all_added", F.sum("lines_added").over(whole())).unionByName(total.withColumn("all_added", F.col("lines_added")))
    return out.select("language", "files", "lines_added", "lines_deleted", share("test", "lines_added").alias("test_pct"), share("lines_added", "all_added").alias("share_pct"), usd("code_units", 6).alias("code_cost_usd"))


def output_split(ds: Dataset, provider: str) -> DataFrame:
    """One row: prose and code tokens and costs, and the code cost without any edited file."""
    sums = output_costs(ds, provider).agg(*(zero(F.sum(c)).alias(c) for c in ("prose", "code", "prose_units", "code_units")))
    tooling = language_costs(ds, provider).where(F.col("language").isNull()).select(F.col("code_units").alias("tooling"))
    return sums.crossJoin(tooling).select(  # one row each
        F.col("prose").alias("prose_tokens"), F.col("code").alias("code_tokens"), usd("prose_units", 6).alias("prose_cost_usd"),
        usd("code_units", 6).alias("code_cost_usd"), usd("tooling", 6).alias("tooling_cost_usd"),
    )


def priced_context(ds: Dataset, provider: str) -> DataFrame:
    """``context_cost`` with ``rent_units`` and ``load_units``."""
    columns = {"cache_read": "rent_read_tokens", "cache_write_5m": "load_write_5m_tokens", "cache_write_1h": "load_write_1h_tokens"}
    kinds = F.inline(F.array(*(F.struct(F.lit(k).alias("token_type"), zero(c).alias("token_count")) for k, c in columns.items())))
    rows = priced(ds.context_cost.select("session_id", "source", "language", "path", "model", kinds), ds, provider)
    rent = F.col("token_type") == "cache_read"
    return rows.withColumns({"rent_units": F.when(rent, F.col("units")).otherwise(0), "load_units": F.when(rent, 0).otherwise(F.col("units"))})


def by_context(ds: Dataset, provider: str) -> DataFrame:
    """Loading and rent of each source and language, the unattributed rest if there is any, and a TOTAL row."""
    rows = priced_context(ds, provider)
    rent_tokens = F.sum(F.when(F.col("token_type") == "cache_read", F.col("token_count")).otherwise(0))
    sums = [F.sum("load_units").alias("load"), F.sum("rent_units").alias("rent"), rent_tokens.alias("rent_tokens"), (F.sum("token_count") - rent_tokens).alias("load_tokens")]
    out = rows.groupBy(F.coalesce("source", F.lit("")).alias("source"), filled("language", NO_VALUE).alias("language")).agg(*sums)
    out = out.where((F.col("source") != UNATTRIBUTED) | (F.col("load") + F.col("rent") > 0))
    total = rows.agg(F.count("*").alias("n"), *sums).where(F.col("n") > 0).drop("n").select(F.lit("TOTAL").alias("source"), F.lit(NO_VALUE).alias("language"), "load", "rent", "rent_tokens", "load_tokens")
    both = out.withColumn("all", F.sum(F.col("load") + F.col("rent")).over(whole())).unionByName(total.withColumn("all", F.col("load") + F.col("rent")))
    return both.select("source", "language", "load_tokens", "rent_tokens", usd("load").alias("load_usd"), usd("rent").alias("rent_usd"), usd(F.col("load") + F.col("rent")).alias("total_usd"), share(F.col("load") + F.col("rent"), "all").alias("share_pct"))


def by_file(ds: Dataset, provider: str, by_project: bool = False) -> DataFrame:
    """Edits, lines, reads, loading and rent of each file; with ``by_project``, of each file of each project.

    The three sides are aggregated on their own and united, then aggregated again, instead of joined in full.
    """
    real = F.col("path").isNotNull() & ~F.col("path").isin("", NO_VALUE)
    none = lambda kind: F.lit(None).cast(kind)
    meta = ds.sessions.select("session_id", F.col("project").alias("_project"))
    named = lambda rows, key, table: rows.join(table, key, "left") if by_project else rows.withColumn("_project", F.lit(""))
    edits = named(ds.output_files.where(real), "prompt_id", ds.prompts.select("prompt_id", F.col("project").alias("_project")))
    reads = named(ds.context_sources.where(real & (F.col("source") == "file_read")), "session_id", meta)
    kept = named(priced_context(ds, provider).where(real & (F.col("source") == "file_read")), "session_id", meta)
    numbers = ("edits", "lines_added", "lines_deleted", "items", "load_units", "rent_units")
    side = lambda rows, **have: rows.select(
        F.coalesce("_project", F.lit("")).alias("project"), "path", "language", (F.col("kind") if "kind" in rows.columns else none("string")).alias("kind"),
        *((zero(have[n]) if n in have else F.lit(0)).cast("long").alias(n) for n in numbers),
    )
    rows = side(edits, edits="edits", lines_added="lines_added", lines_deleted="lines_deleted")
    rows = rows.unionByName(side(reads, items="items")).unionByName(side(kept, load_units="load_units", rent_units="rent_units"))
    language = F.min(F.when(~F.col("language").isin("", NO_VALUE), F.col("language")))
    out = rows.groupBy("project", "path").agg(F.coalesce(language, F.lit(NO_VALUE)).alias("language"), F.min(F.nullif("kind", F.lit(""))).alias("kind"), *(F.sum(n).alias(n) for n in numbers))
    return out.select(
        *(["project"] if by_project else []), "path", "language", F.coalesce(F.col("kind"), kind_of(F.col("path"))).alias("kind"), "edits", "lines_added", "lines_deleted",
        F.col("items").alias("reads"), usd("load_units").alias("load_usd"), usd("rent_units").alias("rent_usd"), usd(F.col("load_units") + F.col("rent_units")).alias("context_usd"),
    )


def file_graph(ds: Dataset, provider: str, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(files, edges): the files of most context cost (0: all) and the prompts that edited them."""
    files = by_file(ds, provider)
    files = files.orderBy(F.desc("context_usd"), F.desc(F.col("lines_added") + F.col("lines_deleted")), "path").limit(top) if top else files
    edges = ds.output_files.join(files.select("path"), "path", "left_semi").join(ds.categories.select("prompt_id", "category"), "prompt_id", "left")
    return files, edges.groupBy("prompt_id", "path", filled("category", UNCATEGORIZED).alias("category")).agg(F.sum(zero("lines_added") + zero("lines_deleted")).alias("churn"))


def task_usage(ds: Dataset, provider: str) -> DataFrame:
    """(task_id, units, context_units, category) over the tasks' prompts, from one pass over the usage.

    The category is that of most cost, ties to the last by name; of most prompts where nothing with a category has a price.
    """
    context = F.when(F.col("token_type").isin(*CONTEXT_TYPES), F.col("units")).otherwise(0)
    spent = priced(ds.tokens, ds, provider).groupBy("prompt_id").agg(F.sum("units").alias("units"), F.sum(context).alias("context_units"))
    rows = ds.task_prompts.join(spent, "prompt_id", "left").join(ds.categories.select("prompt_id", F.nullif("category", F.lit("")).alias("category")), "prompt_id", "left")
    per = rows.groupBy("task_id", "category").agg(F.count("*").alias("n"), zero(F.sum("units")).alias("units"), zero(F.sum("context_units")).alias("context_units"))
    named = lambda x: F.when(F.col("category").isNotNull(), x)
    by_cost = F.max_by("category", named(F.struct("units", "category")))
    by_count = F.min_by("category", named(F.struct(-F.col("n"), F.col("category"))))
    best = F.when(F.sum(named(F.col("units"))) > 0, by_cost).otherwise(by_count)
    return per.groupBy("task_id").agg(F.sum("units").alias("units"), F.sum("context_units").alias("context_units"), best.alias("category"))


def duration(seconds: Column) -> Column:
    """2d 3h 4m without units that are 0; 0m for less than a minute, <1m for nothing."""
    s = seconds.cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(minutes, "m"))
    return F.when(s <= 0, "<1m").when(F.length(text) > 0, text).otherwise(F.when(s.isNotNull(), "0m"))


def by_task(ds: Dataset, provider: str, top: int = 20) -> DataFrame:
    """Cost, context share, span and main category of the costliest tasks (0: all)."""
    usage = task_usage(ds, provider)
    rows = ds.tasks.join(usage, "task_id", "left").fillna(0, subset=["units", "context_units"])
    rows = rows.crossJoin(usage.join(ds.tasks, "task_id", "left_semi").agg(zero(F.sum("units")).alias("all_units")))  # one row
    rows = rows.orderBy(F.desc("units"), "task_id").limit(top) if top else rows
    seconds = F.unix_seconds(F.try_to_timestamp("last_timestamp")) - F.unix_seconds(F.try_to_timestamp("first_timestamp"))
    return rows.select(
        "task_id", F.substring(F.coalesce(F.nullif("name", F.lit("")), "task_id"), 1, 60).alias("task"), "origin", "prompts", F.coalesce(duration(seconds), F.lit("")).alias("duration"),
        filled("category", UNCATEGORIZED).alias("category"), share("context_units", "units").alias("context_pct"), usd("units").alias("cost_usd"), share("units", "all_units").alias("cost_share_pct"),
    )


def task_graph(ds: Dataset, provider: str, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges): the costliest tasks and their prompts with what each costs."""
    tasks = by_task(ds, provider, top)
    spent = priced(ds.tokens, ds, provider).groupBy("prompt_id").agg(F.sum("units").alias("units"))
    edges = ds.task_prompts.join(tasks.select("task_id"), "task_id", "left_semi").join(spent, "prompt_id", "left").join(ds.categories.select("prompt_id", "category"), "prompt_id", "left")
    return tasks, edges.select("task_id", "prompt_id", filled("category", UNCATEGORIZED).alias("category"), usd(zero("units")).alias("cost_usd"))


def running_total(rows: DataFrame, value: str, order: list[Column], name: str, partitions: int | None = None, total: str | None = None) -> DataFrame:
    """``rows`` with ``name``, the running sum of ``value`` in ``order``, and ``total``, the sum of all, if named.

    Rows are dealt to ranges of the order once and written to the shared folder with their range's number; each range sums
    within itself and adds what the ranges before it hold. Only one number for each range goes through a single task. The order
    should be total: rows that are equal in it fall into one range, in any order. An empty table stays empty.
    """
    ranged = cut(rows.repartitionByRange(*([partitions] if partitions else []), *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    sums = sums.select("_range", zero(F.sum("_sum").over(before)).alias("_before"), *([F.sum("_sum").over(whole()).alias(total)] if total else []))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(sums), "_range").withColumn(name, F.sum(value).over(within) + F.col("_before")).drop("_range", "_before")  # as many rows as ranges


def context_pareto(ds: Dataset, provider: str) -> DataFrame:
    """Files by context cost with each one's share of all attributed tokens, and the shares' running sum."""
    rows = priced_context(ds, provider).where(F.col("source") != UNATTRIBUTED).groupBy("source", "path").agg(F.sum("token_count").alias("tokens"), F.sum("units").alias("units"))
    running = running_total(rows, "tokens", [F.desc("tokens"), F.col("source"), F.col("path")], "running", total="total")
    return running.select("source", "path", "tokens", usd("units").alias("cost_usd"), share("tokens", "total").alias("share_pct"), share("running", "total").alias("cumulative_pct"))
