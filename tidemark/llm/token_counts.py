"""Token counts by offset-mapped attribution (operator 10).

A document is encoded once as a whole. Its tokens' byte lengths give their spans, which are joined with the spans of its
sections: for each token the sections that it meets, found by binary search in the sorted section ends. A token inside
one section counts there. A token that crosses a boundary is allocated whole to the section that holds most of its
bytes, ties to the earlier section. So the sections' counts sum to the document's tokens, whereas encoding the sections
one by one may give other tokens.

Sections are either the lines of a text (each with its line feed) or named fields that are joined with a separator; the
separator's bytes belong to the field before it.

Defined results: a null or empty text has no section and no token; a null field is an empty one and gets no token; a
section without a byte gets none; repeated rows count equally; other columns are passed through, but for those that have a
result's name, which the result replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import map_steps
from tidemark.llm.bpe import codec
from tidemark.llm.common import private


def attribute(token_sizes: np.ndarray, section_sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens for each section, and how many tokens cross a boundary; both partition the same bytes."""
    counts = np.zeros(len(section_sizes), np.int64)
    if not len(token_sizes):
        return counts, 0
    ends, bounds = np.cumsum(token_sizes), np.cumsum(section_sizes)
    starts = ends - token_sizes
    first = np.searchsorted(bounds, starts, side="right")  # the section that holds the first byte
    last = np.searchsorted(bounds, ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    chosen = first.copy()
    for t in crossing:
        parts = np.arange(first[t], last[t] + 1)
        shares = np.minimum(bounds[parts], ends[t]) - np.maximum(bounds[parts] - section_sizes[parts], starts[t])
        chosen[t] = parts[int(shares.argmax())]
    np.add.at(counts, chosen, 1)
    return counts, len(crossing)


NEW = [T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("section_tokens", T.ArrayType(T.LongType()))]


def _counted(texts: list[str], sections: list[np.ndarray], path: str, pattern: str) -> dict[str, pa.Array]:
    to = codec(path, pattern)
    sizes = np.array([len(x) for x in to.tokens], np.int64)
    totals, crossing, counts = [], [], []
    for text, section in zip(texts, sections, strict=True):
        ids = to.encode(text)
        per, across = attribute(sizes[np.array(ids, np.int64)], section)
        totals.append(len(ids))
        crossing.append(across)
        counts.append(per)
    return {"n_tokens": pa.array(totals, pa.int64()), "n_crossing": pa.array(crossing, pa.int64()), "section_tokens": pa.array(counts, pa.list_(pa.int64()))}


def line_sizes(text: str) -> np.ndarray:
    """Bytes of each line with its line feed."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    return np.diff(np.unique(np.concatenate(([0], ends, [len(data)]))))


def by_lines(docs: DataFrame, path: str, pattern: str, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with n_tokens, n_crossing and section_tokens, the tokens of each line in order."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [t or "" for t in part.column(text).to_pylist()]
        return _counted(texts, [line_sizes(t) for t in texts], path, pattern)

    return map_steps(docs, text, NEW, run, drop)


def by_fields(docs: DataFrame, fields: list[str], path: str, pattern: str, separator: str = "\n", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with n_tokens, n_crossing and section_tokens, the tokens of each of ``fields`` in order.

    The fields of a row are encoded together, as they would be in a training example.
    """
    inner, names = private(docs)
    values = [F.coalesce(F.col(names[c]).cast("string"), F.lit("")) for c in fields]
    inner = inner.select(*inner.columns, F.array(*values).alias("fields"), F.array_join(F.array(*values), separator).alias("joined"))

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        gap = len(separator.encode())
        sizes = [np.array([len(v.encode()) + gap * (i < len(row) - 1) for i, v in enumerate(row)], np.int64) for row in part.column("fields").to_pylist()]
        return _counted(part.column("joined").to_pylist(), sizes, path, pattern)

    kept = [c for c in docs.columns if c not in drop and c not in {x.name for x in NEW}]
    gone = tuple(names[c] for c in docs.columns if c not in kept)
    return map_steps(inner, "joined", NEW, run, (*gone, "fields", "joined")).toDF(*kept, *(x.name for x in NEW))
