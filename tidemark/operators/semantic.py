"""Categories by nearness to prototype vectors: anchors from a file, scores, labels, and the calibration of their two knobs.

Prototypes are what a person configures; there are at most ``MOST`` of them. They go to the tasks with the function, and a batch of
vectors meets them all in one matrix product. Labels and the calibration are column expressions over the scores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import INTENT_ORDER, NOTIFICATION, OTHER

# Roles of a category, the classifier's knobs and the grid on which they are calibrated.
ROLES = ("semantic", "lexical", "shortcut", "fallback")
TAU, PRIME_WEIGHT = 0.325, 0.60
TAU_GRID = tuple(round(0.20 + 0.025 * i, 3) for i in range(11))
PRIME_GRID = tuple(round(0.40 + 0.10 * i, 2) for i in range(7))

KNOWN = (*INTENT_ORDER, NOTIFICATION)
MOST = 10_000


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(category, role, definition, example) of a JSON file ``{"categories": {name: {role, definition, examples}}}``, one row for
    each example, one without an example for a category that has none.

    A file that can't be a classifier's is an error: no categories, an unknown category or role, a category without a
    definition, or one of prototypes without any.
    """
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).limit(2).collect())  # a file that a person wrote
    try:
        categories = json.loads(text).get("categories")
    except (ValueError, AttributeError) as e:
        raise ValueError(f"{path}: no JSON object") from e
    if not isinstance(categories, dict) or not categories:
        raise ValueError(f"{path}: no categories")
    rows = []
    for name, spec in categories.items():
        spec = spec if isinstance(spec, dict) else {}
        examples = [str(x) for x in spec.get("examples") or []]
        if name not in KNOWN:
            raise ValueError(f"{path}: category {name} is unknown")
        if spec.get("role") not in ROLES:
            raise ValueError(f"{path}: category {name} has no valid role")
        if not spec.get("definition"):
            raise ValueError(f"{path}: category {name} has no definition")
        if spec["role"] == "semantic" and not examples:
            raise ValueError(f"{path}: category {name} has no examples")
        rows += [(name, spec["role"], str(spec["definition"]), x) for x in examples or [None]]
    return spark.createDataFrame(rows, "category string, role string, definition string, example string")


def prototype_matrix(prototypes: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The categories by name, all prototypes (category, vector) as one matrix, and the category of each of its rows."""
    rows = prototypes.where(F.col("category").isNotNull() & F.col("vector").isNotNull()).select("category", F.col("vector").cast("array<double>")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} prototypes")
    names = sorted({r[0] for r in rows})
    size = {len(r[1]) for r in rows}
    if len(size) > 1:
        raise ValueError("prototypes differ in length")
    rows.sort(key=lambda r: (r[0], r[1]))
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), size.pop() if size else 0)
    return names, matrix, np.array([names.index(r[0]) for r in rows], np.int64)


def scored(rows: DataFrame, prototypes: DataFrame, vector: str, top: int = 1, name: str = "scores") -> tuple[DataFrame, list[str]]:
    """``rows`` with an array of one score for each category, and the categories: the mean of the ``top`` largest cosines of unit ``vector`` to the
    category's prototypes. A vector that is null, holds nulls or has another length has no scores."""
    names, matrix, owner = prototype_matrix(prototypes)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(vector).cast(pa.list_(pa.float64()))
            fits = [x.is_valid and len(x.values) == matrix.shape[1] and x.values.null_count == 0 for x in given]
            some = given.filter(pa.array(fits))
            cosines = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1) @ matrix.T if len(some) and len(names) else np.zeros((len(some), 0))
            found = np.empty((len(some), len(names)))
            for k in range(len(names)):
                own = np.sort(cosines[:, owner == k], axis=1)[:, -max(1, top) :]
                found[:, k] = own.mean(axis=1)
            out, at = [None] * len(fits), 0
            for i, fit in enumerate(fits):
                if fit:
                    out[i], at = found[at], at + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema), names


def best_of(names: list[str], scores: str, evidence: dict[str, Column], prime: float) -> tuple[Column, Column]:
    """(label, score) of the best category: the scored ones and those with lexical ``evidence`` (0 to 1, weighed by ``prime``);
    of equal ones the more specific, as ``INTENT_ORDER`` has them."""
    values = {n: F.get(F.col(scores), F.lit(i)) for i, n in enumerate(names)}
    for n, x in evidence.items():
        values[n] = F.when(x > 0, x * F.lit(prime))
    order = [n for n in INTENT_ORDER if n in values] + sorted(n for n in values if n not in INTENT_ORDER)
    best, label = F.greatest(*values.values(), F.lit(-2.0), F.lit(-2.0)), F
    for n in order:
        label = label.when(values[n] == best, n)
    return (label.otherwise(OTHER) if order else F.lit(OTHER)), best


def labelled(rows: DataFrame, names: list[str], scores: str, evidence: dict[str, Column], shortcut: Column, tau: float = TAU, prime: float = PRIME_WEIGHT) -> DataFrame:
    """``rows`` with ``label``: ``shortcut`` where it isn't null, else the best category, other if its score is below ``tau``."""
    label, best = best_of(names, scores, evidence, prime)
    return rows.withColumn("label", F.coalesce(shortcut, F.when(best >= tau, label).otherwise(OTHER)))


def calibrate(
    cases: DataFrame, names: list[str], scores: str, evidence: dict[str, Column], shortcut: Column, gold: str, judge: str | None = None,
    taus: tuple[float, ...] = TAU_GRID, primes: tuple[float, ...] = PRIME_GRID,
) -> DataFrame:
    """(tau, prime, cases, hits, judge_hits, chosen): of each cell of the grid how many cases it labels as ``gold`` has it, and as
    ``judge`` does where there is one (0 otherwise).

    A case is right in a cell by its best category and score alone, so one pass counts all cells. The chosen cell has most
    hits, then most hits by the judge, then the higher tau, then the lower prime. Cases without ``gold`` don't count.
    """
    rows = cases.where(F.col(gold).isNotNull())
    columns = {}
    for j, prime in enumerate(primes):
        label, best = best_of(names, scores, evidence, prime)
        columns |= {f"_l{j}": label, f"_b{j}": best}
    rows = rows.withColumns(columns | {"_short": shortcut})
    golds = [gold, judge or gold]
    sums = [F.count("*").alias("cases")]
    for j in range(len(primes)):
        for i, tau in enumerate(taus):
            found = F.coalesce("_short", F.when(F.col(f"_b{j}") >= tau, F.col(f"_l{j}")).otherwise(OTHER))
            sums += [F.count_if(found == F.col(g)).alias(f"_{k}_{j}_{i}") for k, g in enumerate(golds)]
    cells = [
        F.struct(F.lit(tau).alias("tau"), F.lit(prime).alias("prime"), F.col(f"_0_{j}_{i}").alias("hits"), (F.col(f"_1_{j}_{i}") if judge else F.lit(0).cast("long")).alias("judge_hits"))
        for j, prime in enumerate(primes) for i, tau in enumerate(taus)
    ]
    one = rows.agg(*sums).withColumn("cell", F.array(*cells))
    best = F.array_max(F.transform("cell", lambda c: F.struct(c["hits"], c["judge_hits"], c["tau"], (-c["prime"]).alias("less"))))
    out = one.withColumn("_best", best).select("cases", "_best", F.inline("cell"))
    chosen = (F.col("tau") == F.col("_best.tau")) & (F.col("prime") == -F.col("_best.less"))
    return out.select("tau", "prime", "cases", "hits", "judge_hits", chosen.cast("int").alias("chosen"))


def divergences(first: DataFrame, second: DataFrame, texts: DataFrame, most: int = 12) -> DataFrame:
    """(kind, place, text, was, now): where two labellings (prompt_id, category) of the same prompts differ. ``reclassified`` was
    other, ``contradiction`` was and is something else; each text once, the first ``most`` of each kind by prompt."""
    both = first.select("prompt_id", F.col("category").alias("was")).join(second.select("prompt_id", F.col("category").alias("now")), "prompt_id").join(texts.select("prompt_id", "text"), "prompt_id")
    kind = F.when(F.col("was") == OTHER, "reclassified").otherwise("contradiction")
    rows = both.where((F.col("was") != F.col("now")) & (F.col("now") != OTHER)).withColumn("kind", kind)
    once = rows.groupBy("kind", "text").agg(F.min_by(F.struct("was", "now"), "prompt_id").alias("x"), F.min("prompt_id").alias("prompt_id"))
    parts = []
    for name in ("reclassified", "contradiction"):
        top = once.where(F.col("kind") == name).orderBy("prompt_id").limit(most)
        rows_of = F.array_sort(F.collect_list(F.struct("prompt_id", "text", "x.was", "x.now"))).alias("rows")  # at most ``most``
        parts.append(top.groupBy("kind").agg(rows_of).select("kind", F.posexplode("rows").alias("place", "r")))
    found = parts[0].unionByName(parts[1])
    return found.select("kind", "place", "r.text", "r.was", "r.now")

