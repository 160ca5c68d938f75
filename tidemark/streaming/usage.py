"""Usage as a stream: requests from files that arrive, deduplicated to their largest snapshot, in days, weeks and sessions.

Logs that grow in place aren't seen by a file source; land their lines as files of their own first. A request's snapshots
come in one file or in several; whenever a larger one arrives, the smaller is taken back. Windows close ``LATE`` after their end.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "1 day"
REQUEST = "session_id string, prompt_id string, request_key string, timestamp string, model string, tokens bigint"


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests from Parquet files that arrive in ``folder``, with their instant ``at`` and a watermark on it."""
    rows = spark.readStream.schema(REQUEST).parquet(folder)
    return rows.withColumn("at", F.try_to_timestamp("timestamp")).where(F.col("at").isNotNull()).withWatermark("at", LATE)


CHANGE = "change int, request_key string, session_id string, model string, micros bigint, tokens bigint"


def _better(new: Row, old: tuple | None) -> bool:
    """Whether a snapshot replaces another: more tokens, then the earlier, then the first by session and model."""
    return old is None or (-new.tokens, new.micros, new.session_id or "", new.model or "") < (-old[3], old[2], old[0] or "", old[1] or "")


class LargestSnapshot(StatefulProcessor):
    """One value of state for each request: the largest snapshot so far. A timer clears it when the watermark has passed the
    latest snapshot by the span in which snapshots of one request may lie apart."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "session_id string, model string, micros bigint, tokens bigint, expires bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        before = self.best.get() if self.best.exists() else None
        now, expires = before, before[4] if before else 0
        for row in rows:
            expires = max(expires, row.micros // 1000 + self.span_ms)
            if _better(row, now):
                now = (row.session_id, row.model, row.micros, row.tokens)
        if before is None or expires > before[4]:
            if before is not None:
                self.handle.deleteTimer(before[4])
            self.handle.registerTimer(expires)
        self.best.update((*now[:4], expires))
        if now is not before:
            of = lambda change, x: Row(change=change, request_key=key[0], session_id=x[0], model=x[1], micros=x[2], tokens=x[3])
            if before is not None:
                yield of(-1, before)
            yield of(1, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def largest(requests: DataFrame, span: timedelta = timedelta(days=1)) -> DataFrame:
    """The changes (change, request_key, session_id, model, at, tokens) that keep the largest snapshot of each request.

    Change 1 adds a snapshot, -1 takes back a smaller one that was added before, so that sums of ``change * tokens`` are those
    of the deduplicated requests at any time, whichever files and days a request's snapshots come in. Snapshots of a request lie within
    ``span`` of each other; after that, and the watermark's delay, its state goes. Requests without a key are all added.
    On rows that aren't a stream the same by a window, without anything to take back. Streams need the RocksDB state store.
    """
    keyed = requests.where(F.coalesce("request_key", F.lit("")) != "")
    free = requests.where(F.coalesce("request_key", F.lit("")) == "").select(F.lit(1).alias("change"), "request_key", "session_id", "model", "at", "tokens")
    if not requests.isStreaming:
        order = Window.partitionBy("request_key").orderBy(F.desc("tokens"), "at", F.coalesce("session_id", F.lit("")), F.coalesce("model", F.lit("")))
        best = keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1")
        return best.select(F.lit(1).alias("change"), "request_key", "session_id", "model", "at", "tokens").unionByName(free)
    rows = keyed.select("request_key", "session_id", "model", "at", F.unix_micros("at").alias("micros"), F.coalesce("tokens", F.lit(0)).alias("tokens")).groupBy("request_key")
    changes = rows.transformWithState(LargestSnapshot(int(span.total_seconds() * 1000)), CHANGE, "Update", "EventTime")
    return changes.select("change", "request_key", "session_id", "model", F.timestamp_micros("micros").alias("at"), "tokens").unionByName(free)


def per_week(requests: DataFrame) -> DataFrame:
    """(week, requests, tokens): weeks begin on Monday; the epoch was a Thursday."""
    rows = requests.groupBy(F.window("at", "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "requests", "tokens")


def work_sessions(requests: DataFrame, pause: str = "30 minutes") -> DataFrame:
    """(session_id, start, end, requests, tokens): stretches of a session without a pause of ``pause`` or longer."""
    rows = requests.groupBy("session_id", F.session_window("at", pause).alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return rows.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "tokens")


def append_quota(quota: DataFrame, folder: str, checkpoint: str):
    """Starts the query that appends quota rows of a stream to the log in ``folder``."""
    return quota.writeStream.format("parquet").option("path", f"{folder}/quota_log").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
