"""The driver's events as lines of session logs, so that ingestion runs over whole tables.

Every event is a line of its user's file: purchases are messages that a person typed, views are answers with usage and a tool
call, clicks are tool results, sign-ups are answers of subagents (half of them in files of their own) and errors are all
that a log holds besides: attachments, modes, unknown types and lines that are no JSON. Every seventh event is replayed in a
second file, as a resumed session does, some of them with a larger snapshot of the usage. Whatever a line says follows
from the event's number, its user and its value, so that SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import dealt
from tidemark.plans.adapter import iso
from tidemark.plans.tables import table
from tidemark.sources import logs

ROOT = "/logs"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text) with one JSON object in most lines."""
    i, u = F.col("i"), F.col("u")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.col("value").alias("v"), "ts")
    own = F.when((F.col("t") == "signup") & (i % 2 == 0), F.concat(F.lit(f"{ROOT}/u"), u, F.lit("/subagents/agent-"), u, F.lit(".jsonl"))).otherwise(F.concat(F.lit(f"{ROOT}/u"), u, F.lit(".jsonl")))
    again = F.concat(F.lit(f"{ROOT}/z"), u, F.lit(".jsonl"))
    rows = rows.withColumns({"file": own, "copy": F.lit(False)}).unionByName(rows.where(i % 7 == 0).withColumns({"file": again, "copy": F.lit(True)}))
    rows = rows.repartition(dealt(spark), "file").withColumn("ts", iso("ts"))
    order = Window.partitionBy("file").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = ~((F.col("t") == "error") & (i % 5).isin(0, 2))
    rows = rows.withColumns({
        "line": F.row_number().over(order), "last": F.last(F.when(named, i), ignorenulls=True).over(before),
        "root": F.min(F.when(named, i)).over(before), "call": F.last(F.when(F.col("t") == "view", i), ignorenulls=True).over(before),
    })
    rows = rows.select("*", opened(common()).alias("base"), said().alias("said"), path().alias("path"))
    rows = rows.withColumn("call_json", called())
    return rows.select("file", apart("line").alias("line"), line_text().alias("text"))


def apart(column: str) -> Column:
    """``column`` itself, by a lambda. Spark generates no fused loop for a projection that has one, but many small methods; fused,
    what makes a line is one method so long that the JVM never compiles it, and takes twice the time."""
    return F.get(F.transform(F.array(column), lambda x: x), 0)


def opened(columns: list[Column]) -> Column:
    """A JSON object of ``columns``, null ones left out, without its last brace."""
    return F.regexp_replace(F.to_json(F.struct(*columns)), r"\}$", "")


def added(base: Column, **rest: Column) -> Column:
    """``base``, an open object, with further members, whose values are JSON already or null, and closed."""
    parts = [F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit("")) for name, value in rest.items()]
    return F.concat(base, *parts, F.lit("}"))


def home() -> Column:
    return F.concat(F.lit("/w/p"), (F.col("u") % 7).cast("string"))


def common() -> list[Column]:
    """What every line with an id says."""
    i, u, t = F.col("i"), F.col("u"), F.col("t")
    session = F.concat(F.when(F.col("copy"), "z").otherwise("u"), u)
    parent = F.concat(F.lit("e"), F.when(i % 10 == 0, F.col("root")).otherwise(F.col("last")))
    other = F.when(i % 5 == 1, "attachment").when(i % 5 == 3, F.concat(F.lit("odd"), i % 3)).otherwise("system")
    kind = F.when(t.isin("purchase", "click"), "user").when(t.isin("view", "signup"), "assistant").otherwise(other)
    return [
        kind.alias("type"), F.concat(F.lit("e"), i).alias("uuid"), parent.alias("parentUuid"), session.alias("sessionId"), F.col("ts").alias("timestamp"),
        F.when(i % 6 != 0, home()).alias("cwd"), F.concat(F.lit("b"), u % 3).alias("gitBranch"), (i % 3).cast("string").alias("version"), F.lit("cli").alias("entrypoint"),
    ]


def said() -> Column:
    """The text of a message, some of them not a person's."""
    i = F.col("i")
    return (
        F.when(i % 9 == 1, F.concat(F.lit(logs.CONTINUATION), F.lit(" that ran out"))).when(i % 9 == 2, "run <command-name>x</command-name>")
        .when(i % 9 == 3, F.concat(F.lit("  "), F.lit(logs.INTERRUPTION), F.lit("]"))).when(i % 9 == 4, " \n ")
        .otherwise(F.concat(F.lit("order "), i, F.lit(" of u"), F.col("u"), F.lit("\nplease")))
    )


def path() -> Column:
    i = F.col("i")
    inside = F.when(i % 8 == 5, F.concat(home(), F.lit("/tests/f"), i % 4, F.lit(".py"))).otherwise(F.concat(home(), F.lit("/src/f"), i % 16, F.lit(".py")))
    return F.when(i % 9 == 0, "/other/x.rs").otherwise(inside)


def called() -> Column:
    """The tool call of an answer, as the end of a JSON object."""
    i, where = F.col("i"), F.col("path").alias("file_path")
    pair = lambda old, new: F.struct(F.lit(old).alias("old_string"), F.lit(new).alias("new_string"))
    todo = F.struct(F.lit("in_progress").alias("status"), F.when(i % 5 != 0, F.concat(F.lit(" todo "), i % 4, F.lit(" "))).alias("content"), F.lit("doing it").alias("activeForm"))
    done = F.struct(F.lit("completed").alias("status"), F.lit("old").alias("content"), F.lit("x").alias("activeForm"))
    tools = (
        ("Read", F.struct(where), (0, 4)),
        ("Edit", F.struct(where, F.lit("a\nb").alias("old_string"), F.lit("a\nc\nd").alias("new_string")), (1,)),
        ("Write", F.struct(where, F.repeat(F.lit("row\n"), (i % 6).cast("int")).alias("content")), (5,)),
        ("Bash", F.struct(F.lit("ls -l").alias("command")), (2,)),
        ("MultiEdit", F.struct(where, F.array(pair("a", "b"), pair("", "x\ny")).alias("edits")), (6,)),
        ("TodoWrite", F.struct(F.array(done, todo).alias("todos")), (3,)),
    )
    of = lambda name, body: F.concat(F.lit(f'"name":"{name}","input":'), F.to_json(body))
    begun = of("TaskUpdate", F.struct(F.lit("1").alias("taskId"), F.lit("in_progress").alias("status")))
    out = F.when((i % 8 == 7) & (i % 3 == 0), begun).when(i % 8 == 7, of("TaskCreate", F.struct(F.concat(F.lit("task "), i).alias("subject"))))
    for name, body, places in tools:
        out = out.when((i % 8).isin(*places), of(name, body))
    return out


def line_text() -> Column:
    i, u, t, base = F.col("i"), F.col("u"), F.col("t"), F.col("base")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    plain = quoted(F.replace(F.col("said"), F.lit("\n"), F.lit("\\n")))
    listed = F.concat(F.lit('[{"type":"text","text":'), plain, F.lit('},{"type":"image","text":"no"}]'))
    content = lambda x: F.concat(F.lit('{"role":"user","content":'), x, F.lit("}"))
    prompt = added(base, promptId=F.when(i % 11 != 0, quoted(F.concat(F.lit("q"), i))), isMeta=F.when(i % 9 == 0, "true"), message=content(F.when(i % 2 == 0, plain).otherwise(listed)))
    words = F.concat(F.repeat(F.lit("word "), (i % 5).cast("int")), F.lit("done."))
    used = F.concat(F.lit('[{"type":"text","text":"'), words, F.lit('"},{"type":"tool_use","id":"t'), i, F.lit('",'), F.col("call_json"), F.lit("}]"))
    output = F.floor(F.col("v") * 10) * F.when(F.col("copy") & (i % 2 == 0), 2).otherwise(1)
    ttl = F.when(i % 4 == 0, F.struct((i % 13 * 100).alias("ephemeral_5m_input_tokens"), (i % 5 * 10).alias("ephemeral_1h_input_tokens")))
    usage = F.struct(
        (i % 97).alias("input_tokens"), output.alias("output_tokens"), F.floor(F.col("v") * 1000).alias("cache_read_input_tokens"), (i % 13 * 100 + 1).alias("cache_creation_input_tokens"),
        ttl.alias("cache_creation"), F.struct(F.when(i % 29 == 0, 1).otherwise(0).alias("web_search_requests"), F.lit(5).alias("other")).alias("server_tool_use"),
    )
    half = F.floor(i / 2)
    model = F.when(i % 31 == 0, "<synthetic>").otherwise(F.concat(F.lit("Brand#"), u % 9 + 1))
    message = opened([F.when((i % 5 != 2) & (i % 23 != 0), F.concat(F.lit("m"), half)).alias("id"), model.alias("model"), F.when(i % 2 == 1, F.concat(F.lit("end"), i % 3)).alias("stop_reason"), usage.alias("usage")])
    request = F.when((i % 5 != 1) & (i % 23 != 0), quoted(F.concat(F.lit("r"), half)))
    answer = added(base, requestId=request, isSidechain=F.when(t == "signup", "true"), message=added(message, content=used))
    call = F.concat(F.lit("t"), F.when(i % 10 == 3, i).otherwise(F.col("call")))
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.repeat(F.lit("w, "), (i % 53).cast("int")).alias("content"))))
    held = F.to_json(F.struct(F.when(i % 2 == 0, F.concat(home(), F.lit("/README.md"))).alias("filename"), F.lit("a b c").alias("content")))
    mode = F.to_json(F.struct(F.lit("mode").alias("type"), F.when(i % 3 == 0, "plan").otherwise("normal").alias("mode")))
    other = F.when(i % 5 == 0, F.concat(F.lit("not json "), i)).when(i % 5 == 2, mode).otherwise(added(base, attachment=F.when(i % 5 == 1, held)))
    return F.when(t == "purchase", prompt).when(t.isin("view", "signup"), answer).when(t == "click", added(base, message=content(result))).otherwise(other)


def parsed(spark: SparkSession, sf_dir: str) -> logs.Log:
    return logs.parse(event_lines(spark, sf_dir))


def event_table(log: logs.Log) -> DataFrame:
    """What each event's line says about prompts: (file, line, type, skip, is_prompt, prompt_id, post_compact, mode)."""
    return log.events.select(
        "file", "line", "type", F.coalesce("skip", F.lit("")).alias("skip"), F.col("is_prompt").cast("int").alias("is_prompt"), "prompt_id", F.col("post_compact").cast("int").alias("post_compact"),
        F.col("current_mode").alias("mode"), "cwd",
    )
