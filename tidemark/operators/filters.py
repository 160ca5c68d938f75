"""Filters of a whole dataset: each returns a dataset whose tables agree with one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.dataset import Dataset


def _keep(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return table.join(keys, list(on), "left_semi")


def day(timestamp: str = "timestamp") -> Column:
    return F.substring(F.col(timestamp), 1, 10)


def filter_project(ds: Dataset, project: str) -> Dataset:
    """Sessions of one project, and all that belongs to them."""
    sessions = ds.sessions.where(F.col("project") == project)
    ids = sessions.select("session_id")
    prompts = _keep(ds.prompts, ids, "session_id")
    tasks = _keep(ds.tasks, ids, "session_id")
    return ds.with_(
        sessions=sessions, prompts=prompts, tasks=tasks, tokens=_keep(ds.tokens, ids, "session_id"),
        requests=_keep(ds.requests, ids, "session_id"), context_sources=_keep(ds.context_sources, ids, "session_id"),
        context_cost=_keep(ds.context_cost, ids, "session_id"), task_prompts=_keep(ds.task_prompts, tasks, "task_id"),
        output_files=_keep(ds.output_files, prompts, "prompt_id"), output_tokens=_keep(ds.output_tokens, prompts, "prompt_id"),
    )


def _usage(table: DataFrame, ds: Dataset, prompts: DataFrame) -> DataFrame:
    """Usage of kept prompts, and of kept sessions where it belongs to no prompt at all.

    Both sides ask for rows with an id and no other condition, so that they read one shuffle of the usage: an equality of sessions
    would ask the second for a session too. All prompts' ids are made distinct, so that nothing is joined to them for columns that go.
    """
    named = table.where(F.col("prompt_id").isNotNull())
    real = _keep(named, prompts, "prompt_id")
    rest = named.join(ds.prompts.select("prompt_id").distinct(), "prompt_id", "left_anti").unionByName(table.where(F.col("prompt_id").isNull()))
    kept = prompts.where(F.col("session_id").isNotNull()).select(F.col("session_id").alias("_kept"))
    rest = rest.join(kept, F.col("session_id").eqNullSafe(F.col("_kept")), "left_semi")
    return real.unionByName(rest.select(real.columns))


def _follow(ds: Dataset, prompts: DataFrame) -> Dataset:
    edges = _keep(ds.task_prompts, prompts, "prompt_id")
    return ds.with_(
        prompts=prompts, sessions=_keep(ds.sessions, prompts, "session_id"), tokens=_usage(ds.tokens, ds, prompts),
        requests=_usage(ds.requests, ds, prompts), context_sources=_keep(ds.context_sources, prompts, "session_id"),
        context_cost=_keep(ds.context_cost, prompts, "session_id"), task_prompts=edges, tasks=_keep(ds.tasks, edges, "task_id"),
        output_files=_keep(ds.output_files, prompts, "prompt_id"), output_tokens=_keep(ds.output_tokens, prompts, "prompt_id"),
    )


def filter_dates(ds: Dataset, since: str | None, until: str | None) -> Dataset:
    """Prompts whose day lies in [since, until] as text; sessions left without a prompt go."""
    if since is None and until is None:
        return ds
    inside = F.lit(True)
    inside = inside if since is None else inside & (day() >= since)
    inside = inside if until is None else inside & (day() <= until)
    return _follow(ds, ds.prompts.where(inside))


def filter_prompt_ids(ds: Dataset, ids: DataFrame) -> Dataset:
    """Prompts of ``ids``; sessions, requests and context stay, tasks need one member left."""
    prompts = _keep(ds.prompts, ids, "prompt_id")
    edges = _keep(ds.task_prompts, ids, "prompt_id")
    return ds.with_(
        prompts=prompts, tokens=_keep(ds.tokens, ids, "prompt_id"), task_prompts=edges, tasks=_keep(ds.tasks, edges, "task_id"),
        output_files=_keep(ds.output_files, ids, "prompt_id"), output_tokens=_keep(ds.output_tokens, ids, "prompt_id"),
    )


def split_on_pivot(ds: Dataset, pivot: str) -> tuple[Dataset, Dataset]:
    """Up to the day before ``pivot``, and from it on."""
    from datetime import date, timedelta

    return filter_dates(ds, None, (date.fromisoformat(pivot) - timedelta(days=1)).isoformat()), filter_dates(ds, pivot, None)


def window(ds: Dataset, pivot: str, days: int) -> Dataset:
    """The days [pivot - days, pivot + days - 1]."""
    from datetime import date, timedelta

    at = date.fromisoformat(pivot)
    return filter_dates(ds, (at - timedelta(days=days)).isoformat(), (at + timedelta(days=days - 1)).isoformat())


def in_window(timestamp: Column, since: str | None, until: str | None, zone: str = "UTC") -> Column:
    """Whether an instant lies in [since 00:00, the end of until] in ``zone``; a missing one passes only without bounds."""
    if since is None and until is None:
        return F.lit(True)
    at, inside = F.try_to_timestamp(timestamp), F.lit(True)
    if since is not None:
        inside = inside & (at >= F.to_utc_timestamp(F.lit(f"{since} 00:00:00"), zone))
    if until is not None:
        inside = inside & (at <= F.to_utc_timestamp(F.lit(f"{until} 23:59:59.999999"), zone))
    return F.coalesce(inside, F.lit(False))


def selected(rows: DataFrame, column: str, chosen: Sequence[str] | None, available: DataFrame | None = None) -> DataFrame:
    """``rows`` whose ``column`` is among ``chosen``. Nothing chosen, or every value that isn't blank, means all rows, those with a
    blank value included. ``available`` has the values to choose from, where these aren't those of ``rows``."""
    if not chosen:
        return rows
    inside = F.col(column).isin(*chosen)
    left_out = (F.length(F.trim(column)) > 0) & ~inside
    some = (rows if available is None else available).agg(F.coalesce(F.bool_or(left_out), F.lit(False)).alias("_restricts"))
    return rows.crossJoin(F.broadcast(some)).where(~F.col("_restricts") | F.coalesce(inside, F.lit(False))).drop("_restricts")  # one row


def apply_filters(
    ds: Dataset, dates: tuple[str, str] | None = None, models: Sequence[str] | None = None, projects: Sequence[str] | None = None,
    categories: Sequence[str] | None = None, chars: tuple[int, int | None] | None = None, session_prompts: tuple[int, int] | None = None,
) -> Dataset:
    """The conjunction of the given filters; ``session_prompts`` counts what the others leave and comes last.

    A selection of models, projects or categories filters only if it leaves a value out that the dataset has; prompts without
    a category have ``(uncategorized)``.
    """
    prompts = ds.prompts
    if dates:
        prompts = prompts.where(day().between(*dates))
    prompts = selected(prompts, "model", models, ds.prompts)
    prompts = selected(prompts, "project", projects, ds.prompts)
    if categories:
        named = ds.prompts.select("prompt_id").join(ds.categories.select("prompt_id", "category"), "prompt_id", "left")
        named = named.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("(uncategorized)")))
        prompts = _keep(prompts, selected(named, "category", categories), "prompt_id")
    if chars is not None:
        prompts = prompts.where((F.col("char_count") >= chars[0]) & (F.lit(True) if chars[1] is None else F.col("char_count") < chars[1]))
    if session_prompts is not None:
        sizes = prompts.groupBy("session_id").count().where(F.col("count").between(*session_prompts))
        prompts = _keep(prompts, sizes, "session_id")
    return _follow(ds, prompts)


def date_bounds(ds: Dataset) -> DataFrame:
    """(first, last): the range of days that prompts and sessions cover."""
    days = ds.prompts.select(day().alias("d")).unionByName(ds.sessions.select(F.substring("start_date", 1, 10).alias("d")))
    return days.where(F.length("d") > 0).agg(F.min("d").alias("first"), F.max("d").alias("last"))


def options(table: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that aren't blank, in order."""
    return table.select(column).where(F.length(F.trim(column)) > 0).distinct().orderBy(column)
