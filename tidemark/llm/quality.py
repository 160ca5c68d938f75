"""Document quality by a sparse rule ensemble (operator 12).

Every text is measured once: shares of kinds of characters, of short, long and distinct words, of distinct lines, and the like
(``MEASURES``). Shallow trees of a random forest are grown on the measures of the labelled documents; every path from a root
to a node is a rule, a conjunction of at most ``DEPTH`` conditions on measures. A logistic regression with an L1 penalty over the rules keeps few of
them, and those are compiled into one Spark column expression, so that scoring is a projection over the measures.

Training is distributed and covers every labelled row that may teach; there is no sample. The driver receives the trees and
the weights only: at most ``TREES * 2**(DEPTH + 1)`` rules.

Defined results: a null text is the empty text, whose measures are 0, and is scored like any other; labels other than 0 and 1
count as none; of several labels of an id the more frequent one counts, and a draw counts as none; a null id has no label;
repeated rows get equal scores and teach each; nothing to learn from makes every score 0.5, labels of one value alone make it
that value; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import map_steps, utf8
from tidemark.llm.common import cut

TREES, DEPTH, SEED = 24, 3, 7
#: The weight of the L1 penalty, and the least weight that keeps a rule.
PENALTY, LEAST_WEIGHT = 0.001, 1e-6
SHORT, LONG = 3, 14
MEASURES = (
    "log_words", "word_length", "short_words", "long_words", "distinct_words", "upper", "digits", "marks", "loud", "pauses", "blanks",
    "log_line_words", "distinct_lines", "common_pairs",
)

_BLANK = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_PAUSE, _LOUD = np.frombuffer(b".,;:", np.uint8), np.frombuffer(b"!?", np.uint8)
_MARK = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)


def measures(data: bytes) -> tuple[float, ...]:
    """The measures of a whole text, in UTF-8."""
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, chars = len(words), len(data) - int(kinds[0x80:0xC0].sum())
    if n == 0:
        return (0.0,) * len(MEASURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    of = lambda which: int(kinds[which].sum())
    return (
        math.log1p(n), float(lengths.mean()), int((lengths <= SHORT).sum()) / n, int((lengths >= LONG).sum()) / n, len(set(words)) / n,
        upper / max(1, upper + lower), int(kinds[48:58].sum()) / chars, of(_MARK) / chars, of(_LOUD) / chars, of(_PAUSE) / n, of(_BLANK) / chars,
        math.log1p(n / len(lines)), len(set(lines)) / len(lines), 1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
    )


def measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text and with its measures."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = np.array([measures(x) for x in utf8(part, text)], np.float64).reshape(-1, len(MEASURES))
        return {n: pa.array(found[:, i]) for i, n in enumerate(MEASURES)}

    return map_steps(docs, text, [T.StructField(n, T.DoubleType()) for n in MEASURES], run, drop=(text,))


Rule = tuple[tuple[int, float, float], ...]  # (measure, above, at most), by measure


def rules_of(tree: str) -> set[Rule]:
    """The rules of a tree in Spark's own description: one for each path from the root to a node below it."""
    found, way = set(), []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            way = [x for x in way if x[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
            bounds: dict[int, tuple[float, float]] = {}
            for _, k, sign, at in way:
                low, high = bounds.get(k, (-math.inf, math.inf))
                bounds[k] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
            found.add(tuple((k, *b) for k, b in sorted(bounds.items())))
    return found


def compiled(rule: Rule) -> Column:
    """Whether a row satisfies ``rule``."""
    out = F.lit(True)
    for k, low, high in rule:
        x = F.col(MEASURES[k])
        out = out & (x > F.lit(low) if low > -math.inf else F.lit(True)) & (x <= F.lit(high) if high < math.inf else F.lit(True))
    return out


@dataclass
class Ensemble:
    """Weighted rules; ``constant`` where there was nothing to tell apart."""

    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    constant: float | None = None

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(float(self.constant))
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, label: str) -> Ensemble:
    """An ensemble for ``rows`` (measures and a label, 0 or 1)."""
    rows = cut(rows.select(*MEASURES, F.col(label).cast("double").alias("label")))
    kinds = sorted(r[0] for r in rows.select("label").distinct().collect())  # two at most
    if len(kinds) < 2:
        return Ensemble(constant=kinds[0] if kinds else 0.5)
    rows = rows.withColumn("features", array_to_vector(F.array(*MEASURES)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, maxBins=64, minInstancesPerNode=3).fit(rows)
    rules = sorted(set().union(*(rules_of(t.toDebugString) for t in forest.trees)))
    if not rules:  # no measure tells the labels apart
        return Ensemble(constant=rows.agg(F.avg("label")).first()[0])
    holds = rows.select("label", array_to_vector(F.array(*(compiled(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=100).fit(holds)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > LEAST_WEIGHT]
    return Ensemble(float(lasso.intercept), weights)


def score(
    docs: DataFrame, labels: DataFrame, held: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    label_id: str = "doc_id",
) -> DataFrame:
    """(id, held_out, score, predicted, n_rules: how many kept rules hold) for each row of ``docs``; learns from those not ``held``."""
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), F.col(text).alias("_text"))
    rows = cut(measured(rows, "_text"))
    known = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_of"))
    known = known.agg(F.avg(F.col(label).cast("double")).alias("_mean")).where(F.col("_mean") != 0.5)
    known = known.select("_of", (F.col("_mean") > 0.5).cast("double").alias("_label"))
    ensemble = fit(rows.where(~F.col("_held")).join(known, F.col("_id") == F.col("_of")), "_label")
    hold = [compiled(rule).cast("int") for rule, _ in ensemble.rules]
    found = rows.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), ensemble.score().alias("score"), sum(hold, F.lit(0)).alias("n_rules"))
    return found.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_rules")
