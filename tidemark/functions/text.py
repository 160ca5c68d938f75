"""Text measures and the rule-based intent classifier, as column expressions.

Java's regular expressions need (?U) for classes, word boundaries and case folding by Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.intent_patterns import INTENTS

TOKEN = r"(?U)\w+|[^\w\s]"
FORMULA_STARTS = r"^[=+\-@\t\r]"
OTHER, QUESTION, FOLLOWUP, NOTIFICATION = "other", "question", "followup", "notification"
ACK_CHARS = 40

# On equal scores the first of these wins.
INTENT_ORDER = (
    "debug", "docs", "test", "review", "refactor", "ops", "plan", "implementation", "question", "followup", "feedback", "other",
)
# The words of which a pure acknowledgement consists.
ACK_WORD = (
    r"(?:oui|non|ok(?:ay)?|yes|no|y|n|si|go|continue[rsz]?|vas[- ]?y|allez|reprends?|reprendre|recommence[rsz]?|stop|attends?|wait|merci|thanks?|"
    r"thank you|parfait|nickel|super|top|g[eé]nial|d'?accord|les deux|both|c'?est (?:bon|ok|parti|fait|good)|[çc]a marche|fais[- ]le|fais|fait|do it|"
    r"done|good|great|perfect|proceed|sounds good|lgtm|approved|je valides?|on continue|next|suite|la suite|[eé]tape suivante|valid[eé]s?|"
    r"option|l'?option|l'?[eé]tapes?|[eé]tapes?|phase|partons|sur|pour|et|[a-z]\d+|[a-z]|\d+[a-z]?)"
)
ACK = rf"(?iU)^\s*{ACK_WORD}(?:[\s,.!?;:…\-]+{ACK_WORD})*[\s,.!?;:…\-]*$"
# Blocks that a tool inserts into what a person typed.
NOTE_BLOCK = r"(?isU)<(system-reminder|task-notification)\b[^>]*>.*?</\1>"
NOTIFICATION_TAG = r"(?iU)<task-notification\b"


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_notes(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOTE_BLOCK, " ")


def _matches(text: Column, patterns: list[str]) -> list[Column]:
    return [text.rlike("(?iU)" + p) for p in patterns]


def intent_scores(text: Column) -> dict[str, Column]:
    """Of text without notes: each intent's weight times the patterns that occur."""
    scores = {name: F.lit(0.0) for name in INTENT_ORDER}
    for name, weight, patterns in INTENTS:
        for hit in _matches(text, patterns):
            scores[name] = scores[name] + F.when(hit, weight).otherwise(0.0)
    return scores


def is_notification(raw: Column) -> Column:
    return F.coalesce(raw, F.lit("")).rlike(NOTIFICATION_TAG) & (F.length(stripped(without_notes(raw))) == 0)


def is_acknowledgement(raw: Column) -> Column:
    text = stripped(without_notes(raw))
    return (F.length(text) <= ACK_CHARS) & text.rlike(ACK)


def intent(raw: Column) -> Column:
    """The intent of what a person typed; a null text is other.

    Notes go first. Nothing but a notification is that; a short text of acknowledging words is a follow-up; else the
    highest score wins, and without any a final question mark decides.
    """
    def of(text: Column) -> Column:
        return bound(F.array(*intent_scores(text).values()), lambda scores: winner(text, scores))

    def winner(text: Column, scores: Column) -> Column:
        best = F.array_max(scores)
        names = F.array(*map(F.lit, INTENT_ORDER))
        return F.when(best > 0, F.element_at(names, F.array_position(scores, best).cast("int"))).when(stripped(text).endswith("?"), QUESTION).otherwise(OTHER)

    return F.when(is_notification(raw), NOTIFICATION).when(is_acknowledgement(raw), FOLLOWUP).otherwise(bound(without_notes(raw), of))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which stands in the expression once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lexical_evidence(text: Column, name: str) -> Column:
    """1 - 0.4 ** (patterns of an intent that occur)."""
    patterns = next(p for n, _, p in INTENTS if n == name)
    hits = F.lit(0)
    for hit in _matches(text, patterns):
        hits = hits + hit.cast("int")
    return 1 - F.pow(F.lit(0.4), hits)


def preview(text: Column, most: int = 100) -> Column:
    """The first characters on one line."""
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, most), r"[\r\n]", " ")


def clipped(text: Column, most: int = 100) -> Column:
    """Runs of white space as one blank, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def escape_formula(text: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(text.rlike(FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)


def abbreviated(n: Column) -> Column:
    """1234 as 1.2k, 5600000 as 5.6M, 1010000000 as 1.01G."""
    scaled = lambda by, digits, unit: F.concat(F.format_string(f"%.{digits}f", n / F.lit(float(by))), F.lit(unit))
    return F.when(n >= 10**9, scaled(10**9, 2, "G")).when(n >= 10**6, scaled(10**6, 1, "M")).when(n >= 1000, scaled(1000, 1, "k")).otherwise(n.cast("string"))


def parse_reply(raw: Column, categories: tuple[str, ...] = (*INTENT_ORDER, NOTIFICATION)) -> Column:
    """(category, complexity) of a classifier's answer ``category|complexity``: other and 3 where it has none that is known."""
    parts = F.split(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"\|")
    category, level = F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return F.struct(
        F.when(category.isin(*categories), category).otherwise(OTHER).alias("category"), F.when(level.rlike("^[1-5]$"), level).otherwise("3").alias("complexity")
    )


def model_label(model: Column, prefix: str, families: tuple[str, ...]) -> Column:
    """A model's name to show: the family with its dotted version, or the cleaned words of any other name.

    ``prefix`` (a vendor's) and date stamps of 6 to 8 digits go; ``families`` are looked for in order.
    """
    bare = F.regexp_replace(model, f"(?i)^{prefix}", "")
    words = F.filter(F.split(bare, "-"), lambda w: (F.length(w) > 0) & ~w.rlike(r"^\d{6,8}$"))
    version = F.array_join(F.filter(words, lambda w: w.rlike(r"^\d+$")), ".")
    label = F.when(F.length(F.trim(F.coalesce(model, F.lit("")))) == 0, "(unknown)").when(F.size(words) == 0, model)
    for family in families:
        label = label.when(F.contains(F.lower(model), F.lit(family)), F.trim(F.concat(F.lit(family.capitalize() + " "), version)))
    return label.otherwise(F.initcap(F.replace(F.array_join(words, " "), F.lit("_"), F.lit(" "))))


def model_rank(model: Column, families: tuple[str, ...]) -> Column:
    """A sort key: the family's place, then the name; models of no family come last."""
    place = F
    for i, family in enumerate(families):
        place = place.when(F.contains(F.lower(model), F.lit(family)), i)
    return F.struct((place.otherwise(len(families)) if families else F.lit(0)).alias("place"), model.alias("model"))


def shown(value: Column, kind: str) -> Column:
    """A number to show: money (4 digits), money_total (2), pct, ratio (1 digit) or int; - where there is none."""
    text = {
        "money": F.concat(F.lit("$"), F.format_number(value, 4)), "money_total": F.concat(F.lit("$"), F.format_number(value, 2)),
        "pct": F.concat(F.format_string("%.1f", value), F.lit("%")), "ratio": F.format_number(value, 1), "int": F.format_number(F.floor(value), 0),
    }[kind]
    return F.coalesce(text, F.lit("-"))


def shown_change(before: Column, after: Column, kind: str) -> Column:
    """A change to show: signed, in points for shares, else with the change in percent; - where a side has none."""
    delta = after - before
    sign = F.when(delta >= 0, "+").otherwise("-")
    if kind == "pct":
        return F.coalesce(F.concat(sign, F.format_string("%.1f pp", F.abs(delta))), F.lit("-"))
    body = F.concat(sign, F.lit("$" if kind.startswith("money") else ""), F.format_number(F.abs(delta), {"money": 4, "money_total": 2, "ratio": 1, "int": 0}[kind]))
    relative = F.when(before != 0, F.format_string(" (%+.0f%%)", delta * 100 / before)).otherwise("")
    return F.coalesce(F.concat(body, relative), F.lit("-"))
