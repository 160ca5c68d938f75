"""Helpers for operators that run numpy or Arrow code inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that one step handles at once; a single longer text is a step of its own.
STEP_BYTES = 8 << 20


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes in ``column``, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = batch.column(column).cast(pa.binary())
    start, held = 0, 0
    for i, value in enumerate(sizes):
        n = len(value.as_buffer()) if value.is_valid else 0
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def added(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns of ``new`` at the end; a column of the same name is replaced."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), *new.values()], names=[*(n for n, _ in kept), *new])


def map_steps(
    df: DataFrame, text: str, new: list[T.StructField], f: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with the columns ``new``, which ``f`` computes from slices of its rows, and without ``drop``.

    Nothing is shuffled, and dropped columns aren't sent back from the Python worker.
    """
    gone = {*drop, *(x.name for x in new)}
    schema = T.StructType([x for x in df.schema.fields if x.name not in gone] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                yield added(part.drop_columns(list(drop)), f(part))

    return df.mapInArrow(run, schema)
