"""Tasks: prompts grouped by the note of what is being worked on, or else by pauses (and, with vectors, by subject)."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 1800
SIMILARITY = 0.35


def session_order() -> Window:
    return Window.partitionBy("session_id").orderBy(F.coalesce("timestamp", F.lit("")), "prompt_id")


def _seconds(c: Column) -> Column:
    return F.unix_micros(F.coalesce(F.try_to_timestamp(c), F.lit("0001-01-01").cast("timestamp"))) / 1e6


def by_pause(prompts: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """(session_id, prompt_id, timestamp, name, segment): a new segment after each pause longer than ``gap_seconds``.

    A segment has the name of its first prompt.
    """
    order = session_order()
    pause = _seconds(F.col("timestamp")) - F.lag(_seconds(F.col("timestamp"))).over(order)
    rows = prompts.withColumn("segment", F.sum(F.coalesce((pause > gap_seconds).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    first = F.first("prompt_preview").over(Window.partitionBy("session_id", "segment").orderBy(F.coalesce("timestamp", F.lit("")), "prompt_id"))
    return rows.select("session_id", "prompt_id", "timestamp", clean_name(first).alias("name"), "segment")


def by_todo(prompts: DataFrame, todos: DataFrame) -> DataFrame:
    """(session_id, prompt_id, timestamp, name, segment) for prompts of sessions that have a labelled todo.

    A prompt's label is the last one written from its time to the next prompt's; without any it has the label before, or
    at a session's start the first one after. One segment for each label, in order of appearance. Prompts and todos are
    one stream in time order, so no interval join is needed.
    """
    labelled = todos.where(F.length("label") > 0)
    ours = prompts.join(labelled.select("session_id"), "session_id", "left_semi")
    p = ours.select("session_id", _seconds(F.col("timestamp")).alias("at"), F.lit(0).alias("is_todo"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), "prompt_id", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("ordinal"))
    t = labelled.select("session_id", _seconds(F.col("timestamp")).alias("at"), F.lit(1).alias("is_todo"), "timestamp", F.lit("").alias("prompt_id"), "label", F.col("ordinal").cast("long").alias("ordinal"))
    stream = Window.partitionBy("session_id").orderBy("at", "is_todo", "timestamp", "prompt_id", "ordinal")
    rows = p.unionByName(t).withColumn("turn", F.sum(1 - F.col("is_todo")).over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    in_turn = Window.partitionBy("session_id", "turn").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("active", F.last("label", ignorenulls=True).over(in_turn)).where(F.col("is_todo") == 0)
    order = Window.partitionBy("session_id").orderBy("turn")
    before = F.last("active", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("active", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("name", F.coalesce(before, after, F.lit("")))
    rows = rows.withColumn("_first", F.min("turn").over(Window.partitionBy("session_id", "name")))
    return rows.select("session_id", "prompt_id", "timestamp", "name", F.dense_rank().over(Window.partitionBy("session_id").orderBy("_first")).cast("long").alias("segment"))


def by_subject(prompts: DataFrame, vectors: DataFrame, gap_seconds: int = GAP_SECONDS, similarity: float = SIMILARITY) -> DataFrame:
    """Like ``by_pause``, but a prompt marked ``anchor`` also begins a segment where its unit vector's cosine to the sum of
    the segment's vectors is below ``similarity``. That sum depends on the decisions before, so each session is walked in
    order, in one Arrow group; a session is bounded by what a person types. A prompt without a vector only follows pauses."""
    rows = prompts.join(vectors.select("prompt_id", "vector", "anchor"), "prompt_id", "left").select("session_id", "prompt_id", F.coalesce("timestamp", F.lit("")).alias("timestamp"), _seconds(F.col("timestamp")).alias("at"), "prompt_preview", F.coalesce("anchor", F.lit(False)).alias("anchor"), "vector")

    def walk(session: pa.Table) -> pa.Table:
        session = session.sort_by([("timestamp", "ascending"), ("prompt_id", "ascending")])
        at, anchors, found = session["at"].to_numpy(), session["anchor"].to_pylist(), []
        total, segment, start = None, 1, 0
        for i, x in enumerate(session["vector"].to_pylist()):
            v = None if x is None else np.array(x, np.float64)
            far = anchors[i] and v is not None and total is not None and (norm := np.linalg.norm(total)) > 0 and v @ total / norm < similarity
            if i and (at[i] - at[i - 1] > gap_seconds or far):
                segment, total, start = segment + 1, None, i
            if v is not None:
                total = v if total is None else total + v
            found.append((segment, start))
        names = session["prompt_preview"].to_pylist()
        lead: dict[int, int] = {}
        for i, (s, start) in enumerate(found):
            if s not in lead or (anchors[i] and not anchors[lead[s]]):
                lead[s] = i if anchors[i] else start
        return pa.table({"session_id": session["session_id"], "prompt_id": session["prompt_id"], "timestamp": session["timestamp"], "name": pa.array([names[lead[s]] for s, _ in found], pa.string()), "segment": pa.array([s for s, _ in found], pa.int64())})

    out = rows.groupBy("session_id").applyInArrow(walk, "session_id string, prompt_id string, timestamp string, name string, segment long")
    return out.withColumn("name", clean_name(F.col("name")))


def clean_name(name: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), 1, 80)


def assemble(prompts: DataFrame, todos: DataFrame, gap_seconds: int = GAP_SECONDS, vectors: DataFrame | None = None, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(tasks, task_prompts): by todos in sessions that have a labelled one, in the others by pauses, and where ``vectors``
    (prompt_id, vector, anchor) are given by subject as well."""
    spine = by_todo(prompts, todos).withColumn("origin", F.lit("todo"))
    others = prompts.join(todos.where(F.length("label") > 0).select("session_id"), "session_id", "left_anti")
    inferred = by_pause(others, gap_seconds) if vectors is None else by_subject(others, vectors, gap_seconds, similarity)
    return emit(spine.unionByName(inferred.withColumn("origin", F.lit("inferred"))))


def emit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    mark = F.when(F.col("origin") == "todo", ":t").otherwise(":i")
    number = F.when(F.col("segment") < 100, F.lpad(F.col("segment").cast("string"), 2, "0")).otherwise(F.col("segment").cast("string"))
    rows = rows.withColumn("task_id", F.concat("session_id", mark, number))
    tasks = rows.groupBy("task_id", "session_id", "name", "origin").agg(F.count("*").alias("prompts"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    return tasks, rows.select("task_id", "prompt_id")


