"""Rate cards: a nested mapping of providers, models, prefix fallbacks, per-request prices and plans, as two tables.

Prices are USD per million tokens with at most two decimals, per-request prices USD with at most eight; both become whole
numbers of 1e-8 USD for a token or a request.
"""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.money import UNITS_PER_USD
from tidemark.plans.dataset import REQUESTS_TYPE, SCHEMAS, TOKEN_TYPES

PRICED_TYPES = tuple(t for t in TOKEN_TYPES if t != REQUESTS_TYPE)


def load(text: str) -> dict[str, Any]:
    """A card from JSON or, where PyYAML is installed, YAML text; raises ValueError if it isn't one."""
    try:
        card = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the card is no JSON, and PyYAML isn't installed") from e
        try:
            card = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"the card can't be read: {e}") from e
    validate(card)
    return card


def _units(value: Any, scale: int, where: str) -> int:
    try:
        if isinstance(value, bool):
            raise InvalidOperation
        units = Decimal(str(value)) * scale
    except InvalidOperation:
        raise ValueError(f"{where}: {value!r} is no number") from None
    if units < 0 or units != units.to_integral_value():
        raise ValueError(f"{where}: {value!r} is negative or finer than 1e-8 USD a unit")
    return int(units)


def validate(card: Any) -> None:
    """Raises ValueError unless ``card`` has providers with complete, non-negative prices."""
    if not isinstance(card, dict) or not isinstance(card.get("providers"), dict) or not card["providers"]:
        raise ValueError("a card needs a mapping 'providers'")
    for provider, grid in card["providers"].items():
        if not isinstance(grid, dict) or not (grid.get("models") or grid.get("fallbacks")):
            raise ValueError(f"{provider}: needs models or fallbacks")
        rates(card, provider)
    plan_rows(card)


def rates(card: dict[str, Any], provider: str) -> list[tuple[str, str, str, str, int]]:
    grid, rows = card["providers"][provider], []
    for kind in ("models", "fallbacks"):
        for key, prices in (grid.get(kind) or {}).items():
            if not isinstance(prices, dict) or set(PRICED_TYPES) - set(prices):
                raise ValueError(f"{provider}.{kind}.{key}: needs prices of {', '.join(PRICED_TYPES)}")
            rows += [(provider, kind, str(key), t, _units(prices[t], 100, f"{provider}.{kind}.{key}.{t}")) for t in PRICED_TYPES]
    for key, price in (grid.get("per_request") or {}).items():
        rows.append((provider, "per_request", "", str(key), _units(price, UNITS_PER_USD, f"{provider}.per_request.{key}")))
    return rows


def plan_rows(card: dict[str, Any]) -> list[tuple[str, str, str, int, int]]:
    rows = []
    for kind, section in (("plan", "plans"), ("bundle", "bundles")):
        for key, plan in (card.get(section) or {}).items():
            price = _units(plan.get("monthly_usd", 0), UNITS_PER_USD, f"{section}.{key}")
            included = _units(plan.get("included_usd", 0), UNITS_PER_USD, f"{section}.{key}")
            rows.append((str(key), str(plan.get("label") or key), kind, price, included))
    return rows


def tables(spark: SparkSession, card: dict[str, Any]) -> dict[str, DataFrame]:
    """The card as ``card`` and ``plans`` tables of a dataset."""
    found = [row for provider in card["providers"] for row in rates(card, provider)]
    return {"card": spark.createDataFrame(found, SCHEMAS["card"]), "plans": spark.createDataFrame(plan_rows(card), SCHEMAS["plans"])}


def _grid(step: int) -> dict[str, float]:
    cents = {"input": 100 + 20 * step, "output": 500 + 100 * step, "cache_read": 10 + 2 * step, "cache_write_5m": 125 + 25 * step, "cache_write_1h": 200 + 40 * step}
    return {k: v / 100 for k, v in cents.items()}


#: A card for the driver's tables: exact prices, prefixes of several lengths, and a model without a price.
DEMO = {
    "providers": {
        "direct": {
            "models": {f"Brand#{i}": _grid(i) for i in (3, 4, 5, 6, 8, 9, 11)},
            "fallbacks": {"Brand#1": _grid(12), "Brand#2": _grid(20), "Brand#24": _grid(24)},
            "per_request": {"server_tool_use": 0.01},
        },
        "cloud": {"models": {"Brand#5": _grid(2)}, "fallbacks": {"Brand#": _grid(15)}},
    },
    "plans": {"pro": {"label": "Pro", "monthly_usd": 20}, "max": {"label": "Max", "monthly_usd": 200}, "team": {"monthly_usd": 1500}},
    "bundles": {"small": {"label": "Small bundle", "monthly_usd": 10, "included_usd": 15}, "large": {"monthly_usd": 39, "included_usd": 70}},
}
