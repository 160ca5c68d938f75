"""Language identification by rank-order profiles (operator 3).

A language's profile is the ranking of its most frequent character n-grams (n = 1 to 3, inside words that are padded
with a blank on both sides). A document gets the same ranking over its whole text, and the language whose profile is
nearest by the out-of-place distance: for each n-gram of the document the difference of the two ranks, or the profile's
length where the profile lacks it.

Training uses a sample of about ``per_language`` distinct rows for each label, chosen by a hash threshold on id and text, so
that neither a null nor a repeated id puts a label in or out as a whole; rows equal in both are read once and count as often as they occur. The
``most_labels`` labels of most training rows are learned (ties by label), so that a column of free text as labels stays bounded. Prediction covers
every row. Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when
there is nothing to learn from; equal distances go to the label that is first by code point. Repeated rows get equal
results. Columns besides those named are passed through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import map_steps, steps

UNDETERMINED = "und"
PAD = 1  # a code point that is no letter; it stands for every run of non-letters
BITS = 21  # of a code point
CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(counts, first)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct n-grams of a whole text as packed code points, and their counts; None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate(([PAD], np.where(letter, codes, PAD), [PAD])).astype(np.int32)
    codes = codes[np.concatenate(([True], (codes[1:] != PAD) | (codes[:-1] != PAD)))]
    parts = []
    for at in range(0, len(codes), CHUNK):  # n-grams that begin in [at, at + CHUNK)
        a = codes[at : at + CHUNK + 2].astype(np.int64)
        one, two = a[:CHUNK], (a[:-1] << BITS | a[1:])[:CHUNK]
        three = (a[:-2] << 2 * BITS | a[1:-1] << BITS | a[2:])[a[1:-1] != PAD]
        parts.append(np.unique(np.concatenate((one[one != PAD], two, three)), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def ranked(found: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, most frequent first, ties by n-gram."""
    grams, counts = found
    return grams[np.lexsort((grams, -counts))[:most]]


def fit(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text", label: str = "lang",
    length: int = 400, per_language: int = 3000, most_labels: int = 200,
) -> dict[str, np.ndarray]:
    """A profile of ``length`` n-grams for each label among the training rows.

    The driver receives one threshold for each learned label and ``length`` n-grams for each, nothing that grows with rows.
    """
    rows = docs.where(training & F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(id_col, text, F.lit(3)).alias("hash"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("different"))
    counts = counts.orderBy(F.desc("n"), "label").limit(most_labels).collect()
    if not counts:
        return {}
    unit = 1 << 30
    below = docs.sparkSession.createDataFrame([(r.label, min(unit, -(-unit * per_language // max(1, r.different)))) for r in counts], "label string, below long")
    sample = rows.join(F.broadcast(below), "label").where(F.pmod("hash", F.lit(unit)) < F.col("below"))  # a row for each learned label
    sample = sample.groupBy("label", "hash").agg(F.first("text").alias("text"), F.count("*").alias("times"))

    def told(label: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        grams, n = _merged(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array([label] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], names=["label", "gram", "n"])

    def count(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                by, held = {}, 0  # what a step has counted goes on once it is CHUNK entries
                for k, t, times in zip(*(part.column(c).to_pylist() for c in ("label", "text", "times")), strict=True):
                    if (found := ngrams(t)) is not None:
                        by.setdefault(k, []).append((found[0], found[1] * times))
                        held += len(found[0])
                    if held >= CHUNK:
                        yield from (told(*x) for x in by.items())
                        by, held = {}, 0
                yield from (told(*x) for x in by.items())

    order = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    top = (
        sample.select("label", "text", "times").mapInArrow(count, "label string, gram long, n long")
        .groupBy("label", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
        .orderBy("label", "rank").select("label", "gram").collect()
    )
    found: dict[str, list[int]] = {}
    for r in top:
        found.setdefault(r[0], []).append(r[1])
    return {k: np.array(v, np.int64) for k, v in found.items()}


class Classifier:
    """The profiles as one table of n-grams by language ranks."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = 400):
        self.labels, self.length = sorted(profiles), length
        self.grams = np.unique(np.concatenate([*profiles.values(), np.array([], np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.labels)), -1, np.int32)
        for j, k in enumerate(self.labels):
            self.ranks[np.searchsorted(self.grams, profiles[k]), j] = np.arange(len(profiles[k]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or (found := ngrams(text)) is None:
            return UNDETERMINED, 0.0
        top = ranked(found, self.length)
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(top), dtype=np.int32)[:, None]))
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return self.labels[best], float(1 - total[best] / (self.length * len(top)))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", length: int = 400, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs``, without the columns ``drop``, with lang_pred and score (0 to 1: one less the distance over the largest possible one)."""
    classify = Classifier(profiles, length)

    def predict(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [classify(t) for t in part.column(text).to_pylist()]
        return {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())}

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_steps(docs, text, new, predict, drop)
