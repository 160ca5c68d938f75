"""Writing and loading a whole star schema, incremental landing of log lines, and the audit's matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.lineage import FEW
from tidemark.plans.dataset import SCHEMAS, Dataset
from tidemark.sources import logs
from tidemark.sources.cache import KeyedCache
from tidemark.sources.tables import read_csv, read_dataset, write_csv

NEEDED = ("sessions", "prompts", "tokens", "requests")
#: The order of each table's rows on disk.
ORDERS = {
    "sessions": ("start_date", "session_id"), "prompts": ("session_id", "prompt_index"), "tokens": ("session_id", "prompt_id", "model", "token_type", "is_sidechain"),
    "requests": ("session_id", "prompt_id", "request_index"), "categories": ("prompt_id",), "output_files": ("prompt_id", "path"), "output_tokens": ("prompt_id",),
    "context_sources": ("session_id", "source", "language", "path"), "context_cost": ("session_id", "source", "language", "path", "model"), "tasks": ("session_id", "task_id"),
    "task_prompts": ("task_id", "prompt_id"), "prompts_text": ("prompt_id",),
}
META = "extract_meta"


def write_star(spark: SparkSession, tables: dict[str, DataFrame], folder: str, since: str | None = None, until: str | None = None) -> None:
    """All of ``tables`` as CSV in the order of ``ORDERS``, and the window that they cover. A table of texts that isn't given is emptied."""
    for name, table in tables.items():
        rows = table.select(*(c.split()[0] for c in SCHEMAS[name].split(", ")))
        write_csv(rows.orderBy(*ORDERS[name]), folder, name)
    if "prompts_text" not in tables:
        write_csv(spark.createDataFrame([], SCHEMAS["prompts_text"]), folder, "prompts_text")
    spark.createDataFrame([(since, until)], "since string, until string").coalesce(1).write.mode("overwrite").json(f"{folder}/{META}.json")


def window_label(spark: SparkSession, folder: str) -> str:
    """The window that ``write_star`` has noted, as text; empty without any."""
    try:
        row = spark.read.schema("since string, until string").json(f"{folder}/{META}.json").first()
    except AnalysisException:
        return ""
    parts = [f"{name} {row[name]}" for name in ("since", "until") if row and row[name]]
    return "window: " + ", ".join(parts) if parts else ""


def _times(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.agg(F.min("modificationTime").alias("first"), F.max("modificationTime").alias("last"))


def state(spark: SparkSession, folder: str, log_folder: str) -> str:
    """fresh: all needed tables are there with their headers and no log is newer; stale: a log is newer; absent: otherwise."""
    try:
        written = [_times(spark, f"{folder}/{n}.csv", "*.csv").first()["first"] for n in NEEDED]
        for name in NEEDED:
            read_csv(spark, folder, name)
    except (AnalysisException, ValueError):
        return "absent"
    if None in written:
        return "absent"
    last = _times(spark, log_folder, "*.jsonl").first()["last"]
    return "fresh" if last is None or last <= min(written) else "stale"


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """The categories on disk, without rows that have neither category nor complexity."""
    return read_csv(spark, folder, "categories").where((F.length("prompt_id") > 0) & ((F.length("category") > 0) | (F.length("complexity") > 0)))


def load(spark: SparkSession, folder: str, log_folder: str, work: str, use_tables: bool = True, **given: DataFrame) -> tuple[Dataset, str]:
    """The dataset and where it comes from: the tables in ``folder`` if they are fresh, else the logs themselves.

    ``work`` is a shared folder for what parsing lands. Categories come from ``folder`` either way.
    """
    found = state(spark, folder, log_folder) if use_tables else "absent"
    if found == "fresh":
        label = window_label(spark, folder)
        data = read_dataset(spark, folder, **given)
        return data.with_(categories=categories(spark, folder)), f"tables in {folder}" + (f" ({label})" if label else "")
    parsed = logs.star(logs.read(spark, log_folder).landed(work), work)
    ignored = f"; stale tables in {folder} ignored" if found == "stale" else ""
    return Dataset.of(spark, **parsed, categories=categories(spark, folder), **given), f"logs in {log_folder}{ignored}"


def land_new(spark: SparkSession, log_folder: str, bronze: str) -> DataFrame:
    """The lines (file, line, text) of all logs, kept in the cache ``bronze``: only new and changed files are read.

    A file is known by path, time and size. Of a changed file the lines before go, and so do those of files that are gone;
    what they leave is removed when it is the larger part.
    """
    cache = KeyedCache(spark, bronze, "line int, text string")
    now = logs.new_files(spark, log_folder, spark.createDataFrame([], "file string, modified timestamp, size long"))
    stamp = F.concat_ws(":", F.unix_micros("modified").cast("string"), F.col("size").cast("string"))
    current = now.select(F.col("file").alias("key"), stamp.alias("stamp"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  one reader writes file:/, the other file:///

    def read(missing: DataFrame) -> DataFrame:
        some = missing.limit(FEW + 1).collect()
        # a few files are read by name; with more the folder is, and the others' lines are left out
        lines = logs.read_lines(spark, [r["key"] for r in some] if len(some) <= FEW else log_folder)
        return lines.join(missing, plain("file") == plain("key")).select("key", "stamp", "line", "text")

    return cache.refresh(current, read).select(F.col("key").alias("file"), "line", "text")


def write_audit(table: DataFrame, folder: str, categories: list[str]) -> None:
    """The matrix of clusters by ``categories`` that ``crosstab`` gives, with size, dominant category and purity."""
    cells = table.groupBy("cluster").pivot("category", categories).agg(F.first("n")).fillna(0)
    lead = table.where(F.col("category") == F.col("dominant")).select("cluster", "size", "dominant", F.round("share", 4).alias("purity"))
    write_csv(lead.join(cells, "cluster").orderBy("cluster"), folder, "taxonomy_audit")
