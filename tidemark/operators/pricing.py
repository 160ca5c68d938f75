"""Pricing at read time: models resolved against a rate card, tokens and requests joined with their rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.dataset import REQUESTS_TYPE, SYNTHETIC_MODEL, Dataset

SUFFIX = r"\[[^\]]*\]$"
REQUEST_COLUMNS = {
    "input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens",
    "cache_write_5m": "cache_write_5m_tokens", "cache_write_1h": "cache_write_1h_tokens",
}


def resolve(models: DataFrame, card: DataFrame, provider: str | None = None) -> DataFrame:
    """(provider, model, token_type, rate) for each distinct ``model``: exact without its [suffix], else longest prefix.

    Only distinct models meet the card, so the prefix comparison stays small however many rows have them.
    """
    grid = card.where(F.col("kind").isin("models", "fallbacks"))
    grid = grid if provider is None else grid.where(F.col("provider") == provider)
    exact = F.col("kind") == "models"
    names = models.select("model").distinct().where(F.length("model") > 0).withColumn("bare", F.regexp_replace("model", SUFFIX, ""))
    fits = F.when(exact, F.col("bare") == F.col("key")).otherwise(F.col("bare").startswith(F.col("key")))
    found = names.join(F.broadcast(grid), fits)  # the card is configuration, not data
    best = F.max_by("rate", F.struct(exact.alias("exact"), F.length("key").alias("length")))
    return found.groupBy("provider", "model", "token_type").agg(best.alias("rate"))


def rates_of(ds: Dataset, providers: Sequence[str], models: DataFrame | None = None) -> DataFrame:
    """(_m, _t, rate_<provider>...): each provider's rate of a model and token type, in one row; _m is null for requests' price."""
    resolved = resolve(ds.models if models is None else models, ds.card).select("provider", F.col("model").alias("_m"), F.col("token_type").alias("_t"), "rate")
    each = ds.card.where(F.col("kind") == "per_request").select("provider", F.lit(None).cast("string").alias("_m"), F.col("token_type").alias("_t"), "rate")
    rows = resolved.unionByName(each).where(F.col("provider").isin(*providers))
    return rows.groupBy("_m", "_t").agg(*(F.max(F.when(F.col("provider") == p, F.col("rate"))).alias(f"rate_{p}") for p in providers))


def priced_by(tokens: DataFrame, ds: Dataset, providers: Sequence[str], model: str | None = None) -> DataFrame:
    """``tokens`` with ``units_<provider>`` for each provider, the cost in 1e-8 USD; rows without a price cost 0.

    Requests (server_tool_use) have one price for all models. ``model`` prices every row as that model.
    """
    one = None if model is None else ds.models.sparkSession.createDataFrame([(model,)], "model string")
    rates = rates_of(ds, providers, one)
    name = F.coalesce("model", F.lit("")) if model is None else F.lit(model)
    rows = tokens.withColumn("_key", F.when(F.col("token_type") == REQUESTS_TYPE, F.lit(None).cast("string")).otherwise(name))
    # one row for each model and type: a shuffle by these few keys would undo how the tokens are dealt
    joined = rows.join(F.broadcast(rates), F.col("_key").eqNullSafe(F.col("_m")) & (F.col("token_type") == F.col("_t")), "left")
    units = {f"units_{p}": F.col("token_count") * F.coalesce(f"rate_{p}", F.lit(0)) for p in providers}
    return joined.withColumns(units).drop("_key", "_m", "_t", *(f"rate_{p}" for p in providers))


def priced(tokens: DataFrame, ds: Dataset, provider: str, model: str | None = None) -> DataFrame:
    """``tokens`` with ``units``, the cost with one provider; see ``priced_by``."""
    return priced_by(tokens, ds, [provider], model).withColumnRenamed(f"units_{provider}", "units")


def priced_requests(ds: Dataset, provider: str) -> DataFrame:
    """``requests`` with ``context``, ``writes`` and the costs ``units``, ``write_units`` and ``read_rate``.

    Requests' tool calls aren't priced at this grain. ``read_rate`` and ``rebuild_rate`` are the model's rates of cache
    reads and one-hour writes.
    """
    rates = resolve(ds.models, ds.card, provider).groupBy(F.col("model").alias("_m")).pivot("token_type", list(REQUEST_COLUMNS)).agg(F.first("rate"))
    rows = ds.requests.join(rates, F.col("model") == F.col("_m"), "left").fillna(0, subset=list(REQUEST_COLUMNS))
    cost = {t: F.coalesce(F.col(c), F.lit(0)) * F.col(t) for t, c in REQUEST_COLUMNS.items()}
    writes = F.coalesce("cache_write_5m_tokens", F.lit(0)) + F.coalesce("cache_write_1h_tokens", F.lit(0))
    return rows.withColumns({
        "writes": writes, "context": F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0)) + writes,
        "units": sum(cost.values(), F.lit(0)), "write_units": cost["cache_write_5m"] + cost["cache_write_1h"],
        "read_units": cost["cache_read"], "read_rate": F.col("cache_read"), "rebuild_rate": F.col("cache_write_1h"),
    }).drop("_m", *REQUEST_COLUMNS)


def unpriced(ds: Dataset, provider: str) -> DataFrame:
    """(model, tokens): models in use that the provider has no price for, other than blank and synthetic ones."""
    used = ds.tokens.where((F.col("token_type") != REQUESTS_TYPE) & (F.col("token_count") != 0))
    used = used.where((F.length("model") > 0) & (F.col("model") != SYNTHETIC_MODEL))
    known = resolve(ds.models, ds.card, provider).select(F.col("model").alias("_m")).distinct()
    return used.join(known, F.col("model") == F.col("_m"), "left_anti").groupBy("model").agg(F.sum("token_count").alias("tokens"))


def long_context(ds: Dataset) -> DataFrame:
    """(model, tokens): models with a context suffix, which are priced at the base rate."""
    return ds.tokens.where(F.col("model").rlike(SUFFIX) & (F.col("token_type") != REQUESTS_TYPE)).groupBy("model").agg(F.sum("token_count").alias("tokens"))
