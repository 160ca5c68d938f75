"""Exact apportionment: whole numbers split by weight, and cache tokens attributed to what was in the context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import dealt
from tidemark.plans.dataset import NO_VALUE, UNATTRIBUTED


def split(rows: DataFrame, keys: Sequence[str], total: str, weight: str, order: Sequence[str], out: str) -> DataFrame:
    """``rows`` with ``out``: each group's ``total`` split in proportion to ``weight`` into whole numbers that sum to it.

    What rounding down leaves goes to the largest remainders, ties in ``order``. All 0 where the weights sum to 0.
    Products are DECIMAL(38, 0): a total and a weight may both need 63 bits.
    """
    group = Window.partitionBy(*keys)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    product = (exact(total) * exact(weight)).cast("decimal(38,0)")
    weights = F.sum(F.col(weight)).over(group)
    rows = rows.withColumns({"_w": weights, "_p": product})
    rows = rows.withColumn("_f", F.when(F.col("_w") > 0, F.expr("_p div _w")).otherwise(0))
    rows = rows.withColumn("_r", F.when(F.col("_w") > 0, (F.col("_p") - (F.col("_f").cast("decimal(19,0)") * exact("_w")).cast("decimal(38,0)"))).otherwise(0))
    rows = rows.withColumn("_left", F.col(total) - F.sum("_f").over(group))
    place = F.row_number().over(group.orderBy(F.desc("_r"), *order))
    extra = F.when((F.col("_w") > 0) & (place <= F.col("_left")), 1).otherwise(0)
    return rows.withColumn(out, (F.col("_f") + extra).cast("long")).drop("_w", "_p", "_f", "_r", "_left")


def attribute(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """``context_cost``: cache tokens of main-chain requests by what was in the context.

    ``requests`` has session_id, prompt_id, turn (the order in its session), model, post_compact and the three cache
    counts; ``elements`` session_id, prompt_id, ordinal, source, language, path and tokens.

    A compaction (post_compact after a request without it) empties the context and begins an epoch. A prompt's elements
    enter once, with its first request, and stay to the epoch's end. Reads are split over all that is present, by key;
    writes over the prompt's own elements, whenever they entered. What meets nothing is unattributed. So each column sums
    to the requests' own, to the token.

    Reads are attributed by a sweep: elements and requests are dealt by session and epoch, sorted by turn and streamed once,
    so what is shuffled are the events themselves, and what leaves a task is a row for each key and model of an epoch. A task
    holds one epoch's context keys.
    """
    order = Window.partitionBy("session_id").orderBy("turn")
    begins = (F.col("post_compact") == 1) & (F.coalesce(F.lag("post_compact").over(order), F.lit(0)) == 0)
    requests = requests.withColumn("epoch", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entry = requests.groupBy("session_id", "prompt_id").agg(F.min(F.struct("turn", "epoch")).alias("at"))
    entry = entry.select("session_id", "prompt_id", F.col("at.turn").alias("entered"), F.col("at.epoch").alias("entry_epoch"))
    pieces = elements.where(F.col("tokens") > 0).join(entry, ["session_id", "prompt_id"])
    key = ["source", "language", "path"]

    rent = swept(
        requests.select("session_id", "epoch", "turn", "model", F.col("cache_read_tokens").alias("total")).where(F.col("total") > 0),
        pieces.groupBy("session_id", F.col("entry_epoch").alias("epoch"), "entered", *key).agg(F.sum("tokens").alias("tokens"), F.min("ordinal").alias("ordinal")),
    )
    own = pieces.select("session_id", "prompt_id", "ordinal", *key, F.col("tokens").alias("weight"))
    parts = [_row(rent, rent_read_tokens="part")]
    loads = {"load_write_5m_tokens": "cache_write_5m_tokens", "load_write_1h_tokens": "cache_write_1h_tokens"}
    writes = requests.select("session_id", "prompt_id", "turn", "model", *loads.values()).where(F.greatest(*loads.values()) > 0)
    # dealt anew, else the sorts of the join and those of the splits are in one task's memory at once
    load = writes.join(own, ["session_id", "prompt_id"]).repartition(dealt(writes.sparkSession), "session_id", "turn")
    for name, column in loads.items():  # in the same groups, so that rows are dealt once
        load = split(load, ["session_id", "turn"], column, "weight", ["ordinal", *key], name)
    rest = writes.join(own.select("session_id", "prompt_id").distinct(), ["session_id", "prompt_id"], "left_anti")
    parts += [_row(load, **{n: n for n in loads}), _row(_unattributed(rest), **loads)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("session_id", *key, "model").agg(*(F.sum(n).alias(n) for n in NAMES))
    return out.where(F.greatest(*NAMES) > 0)


class Present:
    """What is in an epoch's context, in the order in which keys first came, and what each has been charged by model."""

    def __init__(self):
        self.place: dict[tuple, int] = {}
        self.weights = np.zeros(16, np.int64)
        self.charged: dict[str | None, np.ndarray] = {}
        self.alone: dict[str | None, int] = {}

    def enter(self, key: tuple, tokens: int) -> None:
        at = self.place.setdefault(key, len(self.place))
        if at == len(self.weights):
            self.weights = np.concatenate((self.weights, np.zeros(at, np.int64)))
        self.weights[at] += tokens

    def charge(self, model: str | None, total: int) -> None:
        n = len(self.place)
        if n == 0:
            self.alone[model] = self.alone.get(model, 0) + total
            return
        weights, held = self.weights[:n], self.charged.get(model, np.zeros(0, np.int64))
        whole = int(weights.sum(dtype=object)) if int(weights.max()) > 1 << 40 else int(weights.sum())
        if whole * total >= 1 << 62:  # beyond 64 bits in Python's whole numbers
            weights = weights.astype(object)
        product = weights * total
        parts = product // whole
        rest = product - parts * whole
        left = total - int(parts.sum())
        parts[np.argsort(-rest, kind="stable")[:left]] += 1
        self.charged[model] = parts.astype(np.int64) + np.pad(held, (0, n - len(held)))

    def rows(self, session: str) -> list[tuple]:
        keys = list(self.place)
        out = [(session, *keys[i], model, int(parts[i])) for model, parts in self.charged.items() for i in np.flatnonzero(parts)]
        return out + [(session, UNATTRIBUTED, NO_VALUE, NO_VALUE, model, total) for model, total in self.alone.items()]


SWEPT = "session_id string, source string, language string, path string, model string, part bigint"


def swept(turns: DataFrame, held: DataFrame) -> DataFrame:
    """(session_id, source, language, path, model, part): each turn's ``total`` split exactly over what ``held`` has brought in by
    then, remainders to the largest, ties in order of entry; summed by epoch."""
    none = lambda kind: F.lit(None).cast(kind)
    key = ["source", "language", "path"]
    entries = held.select("session_id", "epoch", F.col("entered").alias("at"), F.lit(0).alias("is_turn"), F.col("ordinal").cast("long").alias("ordinal"), *(F.col(c).cast("string").alias(c) for c in key), none("string").alias("model"), F.col("tokens").cast("long").alias("amount"))
    asked = turns.select("session_id", "epoch", F.col("turn").alias("at"), F.lit(1).alias("is_turn"), none("long").alias("ordinal"), *(none("string").alias(c) for c in key), "model", F.col("total").cast("long").alias("amount"))
    events = entries.unionByName(asked)
    events = events.repartition("session_id", "epoch").sortWithinPartitions("session_id", "epoch", "at", "is_turn", "ordinal", *key)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, present = None, Present()

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns[:5]] + [pa.array(columns[5], pa.int64())], names=[x.split()[0] for x in SWEPT.split(", ")])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("session_id", "epoch", "is_turn", *key, "model", "amount"))
            out: list[tuple] = []
            for session, epoch, is_turn, source, language, path, model, amount in zip(*columns, strict=True):
                if (session, epoch) != now:
                    out += present.rows(now[0]) if now else []
                    now, present = (session, epoch), Present()
                if is_turn:
                    present.charge(model, amount)
                else:
                    present.enter((source, language, path), amount)
            yield told(out)
        yield told(present.rows(now[0]) if now else [])

    return events.mapInArrow(sweep, SWEPT)


NAMES = ("rent_read_tokens", "load_write_5m_tokens", "load_write_1h_tokens")


def _unattributed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"source": F.lit(UNATTRIBUTED), "language": F.lit(NO_VALUE), "path": F.lit(NO_VALUE)})


def _row(rows: DataFrame, **columns: str) -> DataFrame:
    return rows.select("session_id", "source", "language", "path", "model", *((F.col(columns[n]) if n in columns else F.lit(0)).cast("long").alias(n) for n in NAMES))


def snapshot(elements: DataFrame, conversation: DataFrame) -> DataFrame:
    """``context_sources``: tokens and items of each piece of context, and one row for each session's conversation."""
    pieces = elements.groupBy("session_id", "source", "language", "path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    talk = conversation.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return pieces.unionByName(talk.select("session_id", F.lit("conversation").alias("source"), F.lit(NO_VALUE).alias("language"), F.lit(NO_VALUE).alias("path"), "tokens", "items"))
