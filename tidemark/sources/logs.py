"""Session logs (one JSON object a line) as the star schema.

Lines are numbered within their file, since attribution follows their order. Lines become VARIANT, and all that follows is
relational: the chain, in which each event takes its prompt from an earlier event of the same file, by pointer jumping.

Defined results: a leading byte-order mark and blank lines are ignored; lines that aren't JSON objects are counted as
invalid; a missing field is an empty string; a session is named after its file where no line names it.
"""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lineage import Written, cut, dealt
from tidemark.functions.paths import kind_of, language_of, project_name, relative
from tidemark.functions.text import count_tokens, preview
from tidemark.operators.filters import in_window
from tidemark.plans.dataset import NO_VALUE, SYNTHETIC_MODEL, TOKEN_TYPES

# Event types, markers of prompts that no person typed, and tools that read or edit files.
KNOWN_TYPES = (
    "user", "assistant", "mode", "system", "summary", "attachment", "ai-title", "last-prompt", "file-history-snapshot",
    "permission-mode", "queue-operation", "bridge-session",
)
COMMAND_TAGS = ("<command-name>", "<command-message>", "<local-command-stdout>")
CONTINUATION = "This session is being continued from a previous conversation"
INTERRUPTION = "[Request interrupted by user"
READ_TOOLS = ("Read", "NotebookRead")
EDIT_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")


def get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def text_of(value: Column, path: str) -> Column:
    """A scalar as text, the empty string if it is missing."""
    return F.coalesce(get(value, path), F.lit(""))


def count(value: Column, path: str) -> Column:
    return F.coalesce(get(value, path, "double").cast("long"), F.lit(0))


#: A line's fields and a block's, each read from its variant in one pass, which a field alone costs as well.
FIELDS = (
    "struct<type:string,uuid:string,parentUuid:string,sessionId:string,timestamp:string,cwd:string,gitBranch:string,version:string,entrypoint:string,promptId:string,requestId:string,"
    "isSidechain:boolean,isMeta:boolean,isCompactSummary:boolean,mode:string,message:variant,attachment:variant>"
)
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,input:variant,content:variant>>"


def blocks(content: Column) -> Column:
    """The blocks of a list-shaped content; null for any other shape."""
    return F.transform(F.try_variant_get(content, "$", BLOCKS), lambda b: F.struct(
        *(F.coalesce(b[c], F.lit("")).alias(c) for c in ("type", "text", "id", "name", "tool_use_id")), b["input"].alias("input"), b["content"].alias("content"),
    ))


def flat_text(content: Column, listed: Column | None = None) -> Column:
    """A string content itself, or the text blocks of a list joined by line feeds; ``listed`` has the blocks where they are known."""
    listed = F.filter(blocks(content) if listed is None else listed, lambda b: b["type"] == "text")
    return F.coalesce(F.array_join(F.transform(listed, lambda b: b["text"]), "\n"), get(content, "$"), F.lit(""))


@dataclass(frozen=True)
class Log:
    """Parsed events, and what they say: lazy tables at the grain of the log, before deduplication across files."""

    lines: DataFrame
    said: DataFrame  # events with what their own lines say
    files: DataFrame | None = None  # the files' sessions, where they are written already

    @functools.cached_property
    def events(self) -> DataFrame:
        """Events with their prompt, followed when something first asks for it."""
        return self.said if "prompt_id" in self.said.columns else with_chain(self.said)

    @functools.cached_property
    def sessions(self) -> DataFrame:
        return cut(session_rows(self.said)) if self.files is None else self.files

    def checkpointed(self) -> Log:
        """The same log with its files' sessions checkpointed now; lines and events are written when they are parsed."""
        return Log(lines=self.lines, said=self.said, files=self.sessions)

    def landed(self, folder: str) -> Log:
        """The same log, parsed once: its lines' validity and events are written below ``folder``, which all executors
        must share, and read from there by the many tables that need them."""
        land = lambda name, rows: landed(rows, folder, name)
        events = land("events", self.events)
        lines = land("lines", self.lines.select("file", "line", "invalid"))
        return Log(lines=lines, said=events, files=land("file_sessions", session_rows(events)))


def landed(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """``rows`` written to ``folder``/``name`` as Parquet, replacing what is there, and read again."""
    rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of all *.jsonl files below ``path``, however long: a file is read in splits, whose lines are
    numbered in order of where the split begins."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return numbered_lines(rows.where(F.length(F.trim("text")) > 0))


def numbered_lines(rows: DataFrame) -> DataFrame:
    """(file, line, text) of ``rows`` (file, start of the split, place, text): lines are numbered from 1 in order of split and
    place. Only the number of lines of each split goes through a window, so a file may be larger than a task."""
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("file").alias("_file"), F.col("start").alias("_start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("file", "start").orderBy("place"))
    found = rows.withColumn("rank", rank).join(sizes, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))
    return found.select("file", (F.col("before") + F.col("rank")).cast("int").alias("line"), "text")


def read(spark: SparkSession, path: str) -> Log:
    return parse(read_lines(spark, path))


def parse(lines: DataFrame) -> Log:
    """``lines`` (file, line, text) as events with their prompt and whether they follow a compaction."""
    # what parses and opens with a brace is an object; a variant's schema would be made for every line
    rows = lines.withColumn("v", F.when(F.startswith(F.ltrim(F.col("text"), F.lit(" \t\r\n")), F.lit("{")), F.try_parse_json("text")))
    rows = rows.select("file", "line", F.col("v").isNull().alias("invalid"), F.try_variant_get("v", "$", FIELDS).alias("o"))
    said = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(""))
    marked = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(False))
    events = rows.select(
        "file", "line", "invalid", said("type").alias("type"), said("uuid").alias("uuid"), said("parentUuid").alias("parent"), said("sessionId").alias("own_session"),
        said("timestamp").alias("timestamp"), said("cwd").alias("cwd"), said("gitBranch").alias("git_branch"), said("version").alias("version"), said("entrypoint").alias("entrypoint"),
        said("promptId").alias("own_prompt"), said("requestId").alias("request_id"), marked("isSidechain").alias("is_sidechain"), marked("isMeta").alias("is_meta"),
        marked("isCompactSummary").alias("is_summary"), said("mode").alias("mode"), "o.message", get(F.col("o.message"), "$.content", "variant").alias("content"), "o.attachment",
    )
    content = F.col("content")
    order = Window.partitionBy("file").orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    events = events.withColumn("blocks", blocks(content)).withColumns({
        "text": flat_text(content, F.col("blocks")),
        "cwd": F.coalesce(named("cwd"), F.first(named("cwd"), ignorenulls=True).over(so_far), F.lit("")),
        "current_mode": F.coalesce(F.last(F.when(F.col("type") == "mode", named("mode")), ignorenulls=True).over(so_far), F.lit("normal")),
    })
    blank = F.length(F.regexp_replace("text", r"(?U)\s", "")) == 0
    human = (F.col("type") == "user") & ~blank
    events = events.withColumn("skip", F.when(human, skip_reason())).withColumn("human", human)
    events = events.withColumn("is_prompt", human & F.col("skip").isNull())
    # parsed once; what follows reads the columns it needs
    read = Written(lines.sparkSession)(events.drop("content"))
    events = read.where(~F.col("invalid")).drop("invalid")
    return Log(lines=read.select("file", "line", "invalid"), said=events)


def skip_reason() -> Column:
    """Why a message with text isn't a prompt that a person typed; null if it is."""
    tagged = F.lit(False)
    for tag in COMMAND_TAGS:
        tagged = tagged | F.contains(F.col("text"), F.lit(tag))
    return (
        F.when(F.col("is_sidechain"), "sidechain").when(F.col("is_meta"), "meta")
        .when(F.col("is_summary") | F.startswith(F.col("text"), F.lit(CONTINUATION)), "compact_continuation")
        .when(tagged, "local_command").when(F.startswith(F.ltrim("text"), F.lit(INTERRUPTION)), "interrupted")
    )


def parent_lines(links: DataFrame) -> DataFrame:
    """(file, line, up) of ``links`` (file, line, uuid, parent): the last earlier line of the file that has the parent's id, null if none.

    Ids and references to them meet in one window by file and id, so that an id on many lines makes no product.
    """
    named = links.where(F.length("uuid") > 0).select("file", F.col("uuid").alias("key"), "line", F.lit(1).alias("defines"))
    asked = links.where(F.length("parent") > 0).select("file", F.col("parent").alias("key"), "line", F.lit(0).alias("defines"))
    order = Window.partitionBy("file", "key").orderBy("line", "defines").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("defines") == 1, F.col("line")), ignorenulls=True).over(order)
    found = named.unionByName(asked).withColumn("up", last).where((F.col("defines") == 0) & F.col("up").isNotNull()).select("file", "line", "up")
    return links.select("file", "line").join(found, ["file", "line"], "left")


def with_chain(events: DataFrame) -> DataFrame:
    """``events`` with ``prompt_id`` and ``post_compact``, each taken from the parent where an event has none of its own.

    A continuation of a compacted session marks what descends from it, until the next real prompt. Both are values of the
    nearest ancestor that has one. A file is followed line by line in blocks of ``BLOCK`` lines, with the ids of one block in memory.
    A line whose parent isn't in its block is a gate: what descends from it takes what comes through the gate (``through``).
    """
    continues = F.coalesce("skip", F.lit("")) == "compact_continuation"
    mark = F.when(F.col("uuid") == "", F.lit(None)).when(continues, F.lit(True)).when(F.col("is_prompt"), F.lit(False))
    links = events.select("file", "line", F.floor(F.col("line") / BLOCK).alias("block"), "uuid", "parent", F.nullif("own_prompt", F.lit("")).alias("prompt"), mark.alias("mark"))
    links = links.repartition(dealt(events.sparkSession), "file", "block").sortWithinPartitions("file", "line")
    found = Written(events.sparkSession)(links.mapInArrow(follow, "file string, line int, uuid string, parent string, prompt string, mark boolean, after boolean, gate int"))
    gates = found.where(F.col("gate") == F.col("line"))
    if gates.isEmpty():
        chain = found.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "prompt", "after")
    else:
        come = through(found, gates).select(F.col("file").alias("_f"), F.col("line").alias("_g"), F.col("prompt").alias("_prompt"), F.col("mark").alias("_mark"))
        chain = found.join(come, (F.col("file") == F.col("_f")) & (F.col("gate") == F.col("_g")), "left")
        chain = chain.select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.coalesce("prompt", "_prompt").alias("prompt"), F.coalesce("after", "_mark").alias("after"))
    joined = events.join(chain, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_line")))
    return joined.withColumns({"prompt_id": F.coalesce("prompt", F.lit("")), "post_compact": F.coalesce("after", F.lit(False))}).drop("_file", "_line", "prompt", "after")


#: Lines of a file whose ids are in memory together.
BLOCK = 65_536


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines in order of file and line: the prompt and mark that hold for each within its block, the parent's mark, and the gate."""
    here, known = None, {}
    for batch in batches:
        prompts, marks, afters, gates = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("file", "line", "block", "uuid", "parent", "prompt", "mark")]
        for file, line, block, uuid, parent, prompt, mark in zip(*columns, strict=True):
            if here != (file, block):
                here, known = (file, block), {}
            above = known.get(parent) if parent else None
            after = gate = None
            if above is not None:
                after, gate = above[1], above[2]
                prompt = above[0] if prompt is None else prompt
                mark = after if mark is None else mark
            elif parent and block:
                gate = line
            if uuid:
                known[uuid] = (prompt, mark, gate)
            for out, x in zip((prompts, marks, afters, gates), (prompt, mark, after, gate), strict=True):
                out.append(x)
        made = [pa.array(prompts, pa.string()), pa.array(marks, pa.bool_()), pa.array(afters, pa.bool_()), pa.array(gates, pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.select(["file", "line", "uuid", "parent"]).columns, *made], names=["file", "line", "uuid", "parent", "prompt", "mark", "after", "gate"])


def through(found: DataFrame, gates: DataFrame) -> DataFrame:
    """(file, line, prompt, mark) of each gate: what holds for its parent in an earlier block.

    A gate points to the gate of its parent; in each round one without a value takes that of the gate it points to and points
    where that one does, so a chain over d blocks takes log2(d) joins.
    """
    asked = F.when(F.col("gate") == F.col("line"), F.col("parent")).otherwise("")
    links = found.join(gates.select("file").distinct(), "file", "left_semi").select("file", "line", "uuid", asked.alias("parent"))
    ups = parent_lines(links).where(F.col("up").isNotNull())
    above = found.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "prompt", "mark", F.col("gate").alias("up"))
    write = Written(found.sparkSession)
    open_ = F.col("prompt").isNull() | F.col("mark").isNull()
    now = ups.select("file", "line", F.col("up").alias("_up")).join(above, (F.col("file") == F.col("_file")) & (F.col("_up") == F.col("_line")))
    now = write(now.select("file", "line", "prompt", "mark", F.when(open_, F.col("up")).alias("up")))
    while not now.where(F.col("up").isNotNull()).isEmpty():
        above = now.select(F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("prompt").alias("_prompt"), F.col("mark").alias("_mark"), F.col("up").alias("_up"))
        moved = now.join(above, (F.col("file") == F.col("_file")) & (F.col("up") == F.col("_line")), "left")
        moved = moved.select("file", "line", F.coalesce("prompt", "_prompt").alias("prompt"), F.coalesce("mark", "_mark").alias("mark"), F.col("_up").alias("up"))
        now = write(moved.withColumn("up", F.when(open_, F.col("up"))))
    return now


def parent_session(file: Column) -> Column:
    """The session that a subagent's file belongs to; null for other files."""
    return F.nullif(F.regexp_extract(F.replace(file, F.lit("\\"), F.lit("/")), "/([^/]+)/subagents/[^/]*$", 1), F.lit(""))


def session_rows(events: DataFrame) -> DataFrame:
    """(file, session_id, subagent, cwd, git_branch, first_timestamp) of each file."""
    first = lambda c: F.min_by(F.when(F.length(c) > 0, F.col(c)), F.when(F.length(c) > 0, F.col("line")))
    rows = events.groupBy("file").agg(
        first("own_session").alias("named"), first("timestamp").alias("first_timestamp"),
        F.min_by(F.struct("cwd", "git_branch"), F.when(F.length("cwd") > 0, F.col("line"))).alias("place"),
    )
    parent = parent_session(F.col("file"))
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return rows.select("file", F.coalesce(parent, F.col("named"), stem).alias("session_id"), parent.isNotNull().alias("subagent"), "place.cwd", "place.git_branch", "first_timestamp")


def arrival(*extra: str) -> list[Column]:
    return [F.col(c) for c in ("file", "line", *extra)]


def first_of(rows: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    """The first row of each key in order of files, lines and ``extra``."""
    order = Window.partitionBy(*keys).orderBy(*arrival(*extra))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def prompts_of(log: Log) -> DataFrame:
    """Each real prompt once, where it first occurs. Its id is its own, so no chain is followed."""
    rows = log.said.where("is_prompt").withColumn("prompt_id", F.coalesce(F.nullif("own_prompt", F.lit("")), F.col("uuid")))
    rows = rows.where(F.length("prompt_id") > 0).join(log.sessions.select("file", "session_id", F.col("git_branch").alias("_branch")), "file")
    rows = rows.withColumn("git_branch", F.coalesce(F.nullif("git_branch", F.lit("")), "_branch", F.lit("")))
    return first_of(rows, ["prompt_id"])


def usage_rows(log: Log) -> DataFrame:
    """Assistant lines with their prompt and session, counts, prose and code tokens, and the key that their snapshots share."""
    return counted(log.events.join(log.sessions.select("file", "session_id", "subagent"), "file"), "session_id", "subagent", "prompt_id", "post_compact")


def counted(events: DataFrame, *more: str) -> DataFrame:
    """The assistant lines of ``events`` that say something of usage, with its counts and the columns ``more``."""
    m, u = F.col("message"), get(F.col("message"), "$.usage", "variant")
    split5, split1, legacy = count(u, "$.cache_creation.ephemeral_5m_input_tokens"), count(u, "$.cache_creation.ephemeral_1h_input_tokens"), count(u, "$.cache_creation_input_tokens")
    server = F.map_filter(F.coalesce(F.try_variant_get(u, "$.server_tool_use", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, _: F.endswith(k, F.lit("_requests")))
    calls = F.aggregate(F.map_values(server), F.lit(0).cast("long"), lambda a, x: a + count(x, "$"))
    message_id, request = text_of(m, "$.id"), F.col("request_id")
    key = F.when((message_id != "") & (request != ""), F.concat_ws(":", message_id, request)).when(request != "", F.concat(F.lit("req:"), request)).when(message_id != "", F.concat(F.lit("msg:"), message_id)).otherwise("")
    uses = F.filter(F.coalesce("blocks", F.array().cast(BLOCKS)), lambda b: b["type"] == "tool_use")
    inputs = F.transform(uses, lambda b: F.coalesce(get(b["input"], "$"), F.to_json(b["input"]), F.lit("")))
    rows = events.where((F.col("type") == "assistant") & m.isNotNull()).select(
        "file", "line", *more, "is_sidechain", "timestamp", key.alias("key"),
        text_of(m, "$.model").alias("model"), text_of(m, "$.stop_reason").alias("stop_reason"), count(u, "$.input_tokens").alias("input"), count(u, "$.output_tokens").alias("output"),
        count(u, "$.cache_read_input_tokens").alias("cache_read"), F.when(split5 + split1 == 0, legacy).otherwise(split5).alias("cache_write_5m"), split1.alias("cache_write_1h"),
        calls.alias("server_tool_use"), count_tokens(F.col("text")).alias("prose"), count_tokens(F.array_join(inputs, "\n")).alias("code"), F.exists(uses, lambda b: b["id"] != "").alias("acts"),
    )
    total = sum((F.col(t) for t in TOKEN_TYPES), F.lit(0))
    return rows.withColumn("size", total).where((F.col("size") > 0) | F.col("acts") | (F.col("key") != ""))


def usage_of(log: Log) -> DataFrame:
    """``usage_rows`` deduplicated: of lines with one key the largest snapshot, the first of equals; lines without any key all stay."""
    rows = usage_rows(log)
    largest = Window.partitionBy("key").orderBy(F.desc("size"), *arrival())
    kept = rows.where(F.col("key") != "").withColumn("_n", F.row_number().over(largest)).where(F.col("_n") == 1).drop("_n")
    return kept.unionByName(rows.where(F.col("key") == ""))


def tool_uses(log: Log) -> DataFrame:
    """Tool calls outside subagents: file, line, place, id, name, input, prompt_id, cwd, timestamp."""
    rows = log.events.where((F.col("type") == "assistant") & ~F.col("is_sidechain")).select("file", "line", "uuid", "prompt_id", "cwd", "timestamp", F.posexplode("blocks").alias("place", "b"))
    return rows.where(F.col("b.type") == "tool_use").select("file", "line", "place", "uuid", "prompt_id", "cwd", "timestamp", "b.id", "b.name", "b.input")


CHANGES = T.StructType([T.StructField("added", T.LongType()), T.StructField("deleted", T.LongType())])


#: Where Python's splitlines ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def lines_of(text: Column) -> Column:
    """The lines of a text, without an empty one after the last line's end."""
    pieces = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


@F.pandas_udf(CHANGES)
def matched_changes(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Lines that a comparison by longest matching blocks adds and deletes; nulls for null lists."""

    def one(a, b) -> tuple[int | None, int | None]:
        if a is None or b is None:
            return None, None
        codes = difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes()
        return sum(c[4] - c[3] for c in codes if c[0] != "equal"), sum(c[2] - c[1] for c in codes if c[0] != "equal")

    return pd.DataFrame([one(a, b) for a, b in zip(old, new, strict=True)], columns=["added", "deleted"]).astype("Int64")


def with_changed_lines(rows: DataFrame, old: Column, new: Column, name: str) -> DataFrame:
    """``rows`` with a struct ``name`` of the lines ``added`` and ``deleted`` between two texts.

    Counted by expressions alone: equal texts, texts of which one is empty or that have no line in common, and texts without
    repeated lines that differ in one stretch (with unique lines the common head and tail are part of every matching, so only what
    lies between is compared). Only the stretch of the others goes to the block matching, or both texts where lines repeat.
    """
    rows = rows.withColumns({"_a": lines_of(old), "_b": lines_of(new)})
    a, b = F.col("_a"), F.col("_b")
    unique = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))

    def run(x: Column, y: Column) -> Column:  # how many lines are equal from the start
        same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, F.lit(False))
        return F.when(first == 0, F.size(same)).otherwise(first.cast("int") - 1)

    rows = rows.withColumn("_head", F.when(unique, run(a, b)).otherwise(0))
    left = lambda x: F.slice(x, F.col("_head") + 1, F.size(x))
    rows = rows.withColumns({"_a": F.when(F.size(a) > 0, left(a)).otherwise(a), "_b": F.when(F.size(b) > 0, left(b)).otherwise(b), "_unique": unique})
    rows = rows.withColumn("_tail", F.when(F.col("_unique"), run(F.reverse(a), F.reverse(b))).otherwise(0))
    cut_ = lambda x: F.when(F.size(x) > 0, F.slice(x, F.lit(1), F.size(x) - F.col("_tail"))).otherwise(x)
    rows = rows.withColumns({"_a": cut_(a), "_b": cut_(b)})
    plain = F.when(a == b, F.struct(F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted")))
    plain = plain.when((F.size(a) == 0) | (F.size(b) == 0) | ~F.arrays_overlap(a, b), F.struct(F.size(b).cast("long").alias("added"), F.size(a).cast("long").alias("deleted")))
    rows = rows.withColumn("_plain", plain)
    hard = lambda x: F.when(F.col("_plain").isNull(), x)
    rows = rows.withColumn("_matched", matched_changes(hard(a), hard(b)))
    return rows.withColumn(name, F.coalesce("_plain", "_matched")).drop("_a", "_b", "_head", "_tail", "_unique", "_plain", "_matched")


def file_edits(calls: DataFrame, prompts: DataFrame) -> DataFrame:
    """``output_files``: edits and changed lines of each prompt and file; a call counts once however often it is replayed."""
    i = F.col("input")
    raw = F.coalesce(F.nullif(text_of(i, "$.file_path"), F.lit("")), F.nullif(text_of(i, "$.notebook_path"), F.lit("")))
    rows = calls.where(F.col("name").isin(*EDIT_TOOLS) & (F.col("id") != "") & raw.isNotNull()).join(prompts.select("prompt_id"), "prompt_id", "left_semi")
    rows = first_of(rows.repartition(dealt(rows.sparkSession), "id"), ["id"], "place")
    pair = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    many = F.transform(F.try_variant_get(i, "$.edits", "array<variant>"), lambda e: pair(text_of(e, "$.old_string"), text_of(e, "$.new_string")))
    pairs = F.when(F.col("name") == "MultiEdit", many).when(F.col("name") == "Edit", F.array(pair(text_of(i, "$.old_string"), text_of(i, "$.new_string"))))
    pairs = pairs.when(F.col("name") == "Write", F.array(pair(F.lit(""), text_of(i, "$.content")))).otherwise(F.array(pair(F.lit(""), text_of(i, "$.new_source"))))
    rows = rows.select("prompt_id", "id", relative(raw, F.col("cwd")).alias("path"), language_of(raw).alias("language"), kind_of(raw).alias("kind"), F.posexplode_outer(pairs).alias("_i", "p"))
    rows = with_changed_lines(rows, F.col("p.old"), F.col("p.new"), "c")
    return rows.groupBy("prompt_id", "path").agg(
        F.min("language").alias("language"), F.min("kind").alias("kind"), F.count_distinct("id").alias("edits"), F.sum("c.added").alias("lines_added"), F.sum("c.deleted").alias("lines_deleted")
    )


def context_items(log: Log, uses: DataFrame) -> DataFrame:
    """What enters the context besides the conversation: tool results, by the call they answer, and attachments.

    (session_id, prompt_id, file, line, place, source, language, path, tokens), each once; subagents' files are left out.
    """
    main = log.events.where(~F.col("is_sidechain")).select("file", "line", "type", "uuid", "prompt_id", "cwd", "blocks", "attachment").join(log.sessions.where(~F.col("subagent")).select("file", "session_id"), "file")
    i = F.col("input")
    raw = F.coalesce(F.nullif(text_of(i, "$.file_path"), F.lit("")), F.nullif(text_of(i, "$.notebook_path"), F.lit("")))
    reads = F.col("name").isin(*READ_TOOLS)
    known = lambda c: F.when(reads & raw.isNotNull(), c).otherwise(F.lit(NO_VALUE))
    calls = uses.where(F.col("id") != "").select(
        F.col("file").alias("f"), F.col("id").alias("call"), F.struct("line", "place").alias("called"), F.col("line").alias("call_line"),
        F.when(reads, "file_read").otherwise("tool_output").alias("source"), known(language_of(raw)).alias("language"), known(relative(raw, F.col("cwd"))).alias("path"),
    )
    results = main.where(F.col("type") == "user").select("session_id", "file", "line", "uuid", "prompt_id", F.posexplode("blocks").alias("place", "b")).where(F.col("b.type") == "tool_result")
    joined = results.join(calls, (F.col("file") == F.col("f")) & (F.col("b.tool_use_id") == F.col("call")) & (F.col("call_line") < F.col("line")), "left")
    best = joined.groupBy("session_id", "file", "line", "place").agg(
        F.first("uuid").alias("uuid"), F.first("prompt_id").alias("prompt_id"), F.first("b.tool_use_id").alias("call"), F.first(flat_text(F.col("b.content"))).alias("text"),
        F.max_by(F.struct("source", "language", "path"), "called").alias("meta"),
    )
    meta = lambda c, default: F.coalesce(F.col(f"meta.{c}"), F.lit(default)).alias(c)
    found = best.select("session_id", "prompt_id", "file", "line", "place", meta("source", "tool_output"), meta("language", NO_VALUE), meta("path", NO_VALUE), count_tokens(F.col("text")).alias("tokens"), F.coalesce(F.nullif("call", F.lit("")), "uuid").alias("once"))
    a = F.col("attachment")
    listed = F.array_join(F.transform(F.try_variant_get(a, "$.addedLines", "array<variant>"), lambda x: F.coalesce(get(x, "$"), F.lit(""))), "\n")
    body = F.coalesce(*(F.nullif(F.coalesce(get(a, f"$.{k}"), F.lit("")), F.lit("")) for k in ("content", "snippet")), F.nullif(listed, F.lit("")))
    named = F.coalesce(F.nullif(text_of(a, "$.filename"), F.lit("")), F.nullif(text_of(a, "$.displayPath"), F.lit("")))
    held = main.where((F.col("type") == "attachment") & body.isNotNull()).select(
        "session_id", "prompt_id", "file", "line", F.lit(0).alias("place"), F.when(named.isNotNull(), "file_read").otherwise("config").alias("source"),
        F.coalesce(F.when(named.isNotNull(), language_of(named)), F.lit(NO_VALUE)).alias("language"), F.coalesce(relative(named, F.col("cwd")), F.lit(NO_VALUE)).alias("path"),
        count_tokens(body).alias("tokens"), F.col("uuid").alias("once"),
    )
    both = found.unionByName(held).where(F.col("tokens") > 0)
    return first_of(both.where(F.col("once") != ""), ["once"], "place").unionByName(both.where(F.col("once") == "")).drop("once")


def todos_of(log: Log, calls: DataFrame) -> DataFrame:
    """(session_id, timestamp, ordinal, label): the task in progress whenever the log says so, by either family of tools."""
    i = F.col("input")
    uses = calls.join(log.sessions.where(~F.col("subagent")).select("file", "session_id"), "file")
    active = F.get(F.filter(F.transform(F.try_variant_get(i, "$.todos", "array<variant>"), lambda t: F.struct(text_of(t, "$.status").alias("status"), F.coalesce(F.nullif(text_of(t, "$.content"), F.lit("")), text_of(t, "$.activeForm")).alias("label"))), lambda t: t["status"] == "in_progress"), 0)
    columns = ["session_id", "prompt_id", "timestamp", "file", "line", "place", F.coalesce(F.nullif("id", F.lit("")), "uuid").alias("once")]
    written = uses.where(F.col("name") == "TodoWrite").select(*columns, F.trim(F.coalesce(active["label"], F.lit(""))).alias("label"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("line", "place")).cast("string")
    made = uses.where(F.col("name") == "TaskCreate").select(F.col("file").alias("f"), number.alias("task"), F.struct("line", "place").alias("made"), F.trim(text_of(i, "$.subject")).alias("label"))
    begun = uses.where((F.col("name") == "TaskUpdate") & (text_of(i, "$.status") == "in_progress"))
    begun = begun.join(made, (F.col("file") == F.col("f")) & (text_of(i, "$.taskId") == F.col("task")) & (F.col("made") < F.struct("line", "place")), "left")
    begun = begun.select(*columns, F.coalesce("label", F.lit("")).alias("label"))
    both = first_of(written.unionByName(begun), ["once"], "place")
    ordinal = F.row_number().over(Window.partitionBy("session_id").orderBy(*arrival("place"))).cast("long")
    return both.select("session_id", "timestamp", ordinal.alias("ordinal"), "label")


def quality(log: Log) -> DataFrame:
    """(kind, name, n): lines, invalid lines, unknown event types, filtered prompts and versions."""
    one = lambda frame, kind: frame.groupBy("name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    lines = one(log.lines.select(F.when(F.col("invalid"), "invalid").otherwise("valid").alias("name")), "lines")
    unknown = one(log.said.where(~F.col("type").isin(*KNOWN_TYPES)).select(F.col("type").alias("name")), "unknown_type")
    skipped = one(log.said.where(F.col("skip").isNotNull()).select(F.col("skip").alias("name")), "filtered")
    versions = one(log.said.where(F.length("version") > 0).select(F.col("version").alias("name")), "version")
    return lines.unionByName(unknown).unionByName(skipped).unionByName(versions)


def report(found: Star, priced: DataFrame | None = None) -> DataFrame:
    """(kind, name, n): what ``quality`` has, the sizes of what came out, requests by model, models without a price (``priced`` has
    the models, as column model, that have one), and warnings: lines that are no JSON objects, unknown types, unpriced models, and files without
    any prompt, which is a sign that the format has changed. A warning is a row only where there is something to warn of."""
    one = lambda rows, kind, name, n=F.count("*"): rows.agg(n.alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # noqa: E731, B008
    raw = counted(found.log.said)  # prompts and sessions of the rows do not matter
    models = found.requests.where((F.col("model") != "") & (F.col("model") != SYNTHETIC_MODEL)).groupBy(F.col("model").alias("name")).agg(F.count("*").alias("n"))
    unpriced = models.limit(0) if priced is None else models.join(priced.select(F.col("model").alias("name")), "name", "left_anti")
    files = one(found.log.lines.select("file").distinct(), "size", "files")
    unknown = found.log.said.where(~F.col("type").isin(*KNOWN_TYPES)).select("type").distinct()
    sizes = [
        files, one(found.sessions, "size", "sessions"), one(found.all_prompts, "size", "all_prompts"), one(found.prompts, "size", "prompts"), one(raw, "size", "usage_records"),
        one(raw, "size", "duplicates", F.count_if(F.col("key") != "") - F.count_distinct(F.nullif("key", F.lit("")))), one(found.tokens, "size", "tokens"), one(found.requests, "size", "requests"),
    ]
    silent = files.crossJoin(found.all_prompts.agg(F.count("*").alias("p")))  # one row each
    warnings = [
        one(found.log.lines.where("invalid"), "warning", "invalid_lines"), one(unknown, "warning", "unknown_types"), one(unpriced, "warning", "unpriced_models"),
        silent.select(F.lit("warning").alias("kind"), F.lit("no_prompts").alias("name"), F.when(F.col("p") == 0, F.col("n")).otherwise(0).cast("long").alias("n")),
    ]
    out = quality(found.log).unionByName(models.select(F.lit("model").alias("kind"), "name", "n")).unionByName(unpriced.select(F.lit("unpriced").alias("kind"), "name", "n"))
    for x in sizes:
        out = out.unionByName(x)
    for x in warnings:
        out = out.unionByName(x.where(F.col("n") > 0))
    return out


def exit_code(rows: DataFrame, strict: bool = False) -> int:
    """1 for a report of files without any prompt, and with ``strict`` for any warning; else 0."""
    bad = (F.col("kind") == "warning") & (F.lit(strict) | (F.col("name") == "no_prompts"))
    return int(not rows.where(bad).isEmpty())


@dataclass(frozen=True)
class Star:
    """The star schema's tables of a log, each made when it is asked for.

    What several tables share is made once and written: below ``folder``, or where there is none as checkpoints, so that no table
    repeats the work of another and a lost executor costs one table's stage. The tables themselves are lazy. A window keeps prompts whose time
    lies in it, and session overhead of which any record does.
    """

    log: Log
    folder: str | None = None
    since: str | None = None
    until: str | None = None
    zone: str = "UTC"
    keep_text: bool = True

    def land(self, name: str, rows: DataFrame) -> DataFrame:
        return cut(rows) if self.folder is None else landed(rows, self.folder, name)

    def inside(self) -> Column:
        return in_window(F.col("timestamp"), self.since, self.until, self.zone)

    @functools.cached_property
    def all_prompts(self) -> DataFrame:
        columns = ["file", "line", "session_id", "prompt_id", "timestamp", "cwd", "git_branch", "current_mode", "entrypoint", "version", "text"]
        return self.land("all_prompts", prompts_of(self.log).select(*columns))

    @functools.cached_property
    def calls(self) -> DataFrame:
        return self.land("calls", tool_uses(self.log))

    @functools.cached_property
    def usage(self) -> DataFrame:
        """Deduplicated usage under the session of its prompt; ``real`` where the log has that prompt."""
        owner = self.all_prompts.select("prompt_id", F.col("session_id").alias("_owner"))
        usage = self.land("usage", usage_of(self.log)).join(owner, "prompt_id", "left").withColumn("real", F.col("_owner").isNotNull())
        return usage.withColumns({
            "session_id": F.coalesce("_owner", "session_id"),
            "prompt_id": F.when(F.col("real") | (F.col("prompt_id") != ""), F.col("prompt_id")).otherwise(F.concat("session_id", F.lit(":_continuation"))),
        })

    @functools.cached_property
    def prompts(self) -> DataFrame:
        """Prompts in the window, numbered over their whole session."""
        in_session = Window.partitionBy("session_id").orderBy("timestamp", *arrival())
        return self.land("prompts", self.all_prompts.withColumn("prompt_index", F.row_number().over(in_session).cast("long")).where(self.inside()))

    @functools.cached_property
    def overhead(self) -> DataFrame:
        return self.usage.where(~F.col("real")).groupBy("session_id", "prompt_id").agg(F.max(self.inside()).alias("inside")).where("inside")

    @functools.cached_property
    def kept(self) -> DataFrame:
        """Usage of the prompts and of the overhead in the window."""
        kept = self.usage.where("real").join(self.prompts.select("prompt_id"), "prompt_id", "left_semi")
        kept = kept.unionByName(self.usage.where(~F.col("real")).join(self.overhead, ["session_id", "prompt_id"], "left_semi").select(kept.columns))
        return self.land("kept_usage", kept)

    @functools.cached_property
    def requests(self) -> DataFrame:
        in_prompt = Window.partitionBy("session_id", "prompt_id").orderBy("timestamp", *arrival())
        requests = self.kept.where(F.col("size") > 0).select(
            "session_id", "prompt_id", F.row_number().over(in_prompt).cast("long").alias("request_index"), "timestamp", "model", "stop_reason", F.col("is_sidechain").cast("int").alias("is_sidechain"),
            F.col("post_compact").cast("int").alias("post_compact"), F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_tokens"),
            F.col("cache_write_5m").alias("cache_write_5m_tokens"), F.col("cache_write_1h").alias("cache_write_1h_tokens"), F.col("server_tool_use").alias("server_tool_use_requests"),
        )
        return self.land("requests", requests)

    @functools.cached_property
    def tokens(self) -> DataFrame:
        from tidemark.plans.adapter import tokens_of_requests

        return tokens_of_requests(self.requests)

    @functools.cached_property
    def prompt_rows(self) -> DataFrame:
        place = F.struct("timestamp", "file", "line")
        main = self.usage.where("real").where(~F.col("is_sidechain"))
        real_model = F.when((F.col("model") != "") & (F.col("model") != SYNTHETIC_MODEL), F.col("model"))
        turns = main.groupBy("prompt_id").agg(
            F.count("*").alias("assistant_turns"), F.min_by(real_model, F.when(real_model.isNotNull(), place)).alias("model"),
            F.max_by(F.nullif("stop_reason", F.lit("")), F.when(F.col("stop_reason") != "", place)).alias("final_stop_reason"),
        )
        calls = first_of(self.calls.where(F.col("id") != ""), ["id"], "place").groupBy("prompt_id").agg(F.count("*").alias("tool_calls"))
        shown = preview(F.col("text")) if self.keep_text else F.lit("")
        rows = self.prompts.join(turns, "prompt_id", "left").join(calls, "prompt_id", "left").select(
            "session_id", "prompt_id", "prompt_index", "timestamp", project_name(F.col("cwd")).alias("project"), "cwd", "git_branch", F.col("current_mode").alias("mode"), "entrypoint", "version",
            F.coalesce("model", F.lit("")).alias("model"), F.length("text").cast("long").alias("char_count"), F.coalesce("assistant_turns", F.lit(0)).alias("assistant_turns"),
            F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce("final_stop_reason", F.lit("")).alias("final_stop_reason"), shown.alias("prompt_preview"),
        )
        return self.land("prompt_rows", rows)

    @functools.cached_property
    def output_files(self) -> DataFrame:
        return file_edits(self.calls, self.prompts)

    @functools.cached_property
    def output_tokens(self) -> DataFrame:
        weight = F.col("prose") + F.col("code")
        prose = F.when(weight > 0, F.bround(F.col("output").cast("double") * F.col("prose") / weight, 0)).otherwise(F.col("output")).cast("long")
        rows = self.kept.where(F.col("real") & (F.col("output") > 0)).withColumn("p", prose)
        return rows.groupBy("prompt_id").agg(F.sum("p").alias("output_prose_tokens"), F.sum(F.col("output") - F.col("p")).alias("output_code_tokens"))

    @functools.cached_property
    def active(self) -> DataFrame:
        return self.land("active", self.prompts.select("session_id").unionByName(self.overhead.select("session_id")).distinct())

    @functools.cached_property
    def sessions(self) -> DataFrame:
        files = self.log.sessions.groupBy("session_id").agg(F.min_by(F.struct("cwd", "git_branch"), F.when(F.length("cwd") > 0, F.col("file"))).alias("place"), F.min("first_timestamp").alias("start"))
        return files.join(self.active, "session_id", "left_semi").where(F.col("place").isNotNull()).select(
            "session_id", F.coalesce(F.substring("start", 1, 10), F.lit("")).alias("start_date"), project_name(F.col("place.cwd")).alias("project"), "place.cwd", "place.git_branch"
        )

    @functools.cached_property
    def items(self) -> DataFrame:
        return self.land("items", context_items(self.log, self.calls)).join(self.active, "session_id", "left_semi")

    @functools.cached_property
    def talk(self) -> DataFrame:
        """(session_id, prompt_id, tokens) of what was said."""
        weight = F.col("prose") + F.col("code")
        said = self.all_prompts.join(self.active, "session_id", "left_semi").select("session_id", "prompt_id", count_tokens(F.col("text")).alias("tokens"))
        answered = self.usage.where(~F.col("is_sidechain") & (weight > 0)).join(self.active, "session_id", "left_semi").select("session_id", "prompt_id", weight.alias("tokens"))
        return said.unionByName(answered)

    @functools.cached_property
    def context_sources(self) -> DataFrame:
        from tidemark.operators import apportion

        return apportion.snapshot(self.items, self.talk)

    @functools.cached_property
    def context_cost(self) -> DataFrame:
        from tidemark.operators import apportion

        elements = self.items.groupBy("session_id", "prompt_id", "source", "language", "path").agg(F.sum("tokens").alias("tokens"))
        elements = elements.unionByName(self.talk.groupBy("session_id", "prompt_id").agg(F.sum("tokens").alias("tokens")).select("session_id", "prompt_id", F.lit("conversation").alias("source"), F.lit(NO_VALUE).alias("language"), F.lit(NO_VALUE).alias("path"), "tokens"))
        elements = self.land("elements", elements.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id", "prompt_id").orderBy("source", "language", "path")).cast("long")))
        turn = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "prompt_id", "request_index"))
        return apportion.attribute(self.requests.where(F.col("is_sidechain") == 0).withColumn("turn", turn), elements)

    @functools.cached_property
    def todos(self) -> DataFrame:
        return self.land("todos", todos_of(self.log, self.calls))

    def tables(self) -> dict[str, DataFrame]:
        from tidemark.operators import tasks

        made, edges = tasks.assemble(self.prompt_rows, self.todos)
        out = {
            "sessions": self.sessions, "prompts": self.prompt_rows, "requests": self.requests, "tokens": self.tokens, "output_files": self.output_files, "output_tokens": self.output_tokens,
            "context_sources": self.context_sources, "context_cost": self.context_cost, "tasks": made, "task_prompts": edges,
        }
        return out | ({"prompts_text": self.prompts.select("prompt_id", F.col("text").alias("prompt_text"))} if self.keep_text else {})


def star(log: Log, folder: str, since: str | None = None, until: str | None = None, zone: str = "UTC", keep_text: bool = True) -> dict[str, DataFrame]:
    """The star schema's tables: sessions, prompts, tokens, requests, output_files, output_tokens, context_sources,
    context_cost, tasks, task_prompts and prompts_text, what they share written below ``folder``."""
    return Star(log, folder, since, until, zone, keep_text).tables()


def new_files(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """(file, modified, size): files that aren't in ``seen`` with the same time and size, for incremental runs."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").format("binaryFile").load(path)
    now = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return now.join(seen.select("file", "modified", "size"), ["file", "modified", "size"], "left_anti")

