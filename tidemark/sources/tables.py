"""The star schema on disk: Parquet as its own form, CSV for exchange, and the append-only quota log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark.functions.text import escape_formula
from tidemark.plans.dataset import SCHEMAS, Dataset

#: Text that people wrote, which a spreadsheet might take for formulas.
FREE_TEXT = ("prompt_preview", "prompt_text")
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def _strings(name: str) -> T.StructType:
    return T.StructType([T.StructField(c.split()[0], T.StringType()) for c in SCHEMAS[name].split(", ")])


def typed(rows: DataFrame, name: str) -> DataFrame:
    """String columns as the table's types: counts that are no numbers become 0, missing text the empty string."""
    columns = []
    for c in SCHEMAS[name].split(", "):
        column, kind = c.split()
        if kind in ("bigint", "int"):
            columns.append(F.coalesce(F.expr(f"try_cast(`{column}` as {kind})"), F.lit(0).cast(kind)).alias(column))
        elif kind == "double":
            columns.append(F.expr(f"try_cast(`{column}` as double)").alias(column))
        else:
            columns.append(F.coalesce(column, F.lit("")).alias(column))
    return rows.select(*columns)


def read_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table from ``folder``/``name``.csv (a file or a folder of parts); an absent one is empty.

    Raises ValueError if the header isn't the table's.
    """
    wanted = _strings(name)
    try:
        header = spark.read.options(**CSV).csv(f"{folder}/{name}.csv").columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMAS[name])
    if header != wanted.fieldNames():
        raise ValueError(f"{name}.csv: the header is {header}")
    return typed(spark.read.options(**CSV).schema(wanted).csv(f"{folder}/{name}.csv"), name)


def read_dataset(spark: SparkSession, folder: str, **given: DataFrame) -> Dataset:
    """A dataset of the CSV tables in ``folder``, and of ``given`` ones such as a rate card's."""
    names = [n for n in SCHEMAS if n not in given and n not in ("card", "plans")]
    return Dataset.of(spark, **{n: read_csv(spark, folder, n) for n in names}, **given)


def write_csv(table: DataFrame, folder: str, name: str, one_file: bool = False) -> None:
    """``table`` as a folder of CSV parts, free text escaped; ``one_file`` for exports that fit one task."""
    columns = [escape_formula(F.col(c)).alias(c) if c in FREE_TEXT else F.col(c) for c in table.columns]
    rows = table.select(*columns)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(f"{folder}/{name}.csv")


def write_parquet(table: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """``table`` as Parquet; ``by`` partitions it, so that date filters skip files."""
    writer = table.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")


def quota_rows(payload: DataFrame) -> DataFrame:
    """``quota_log`` rows of (snapshot_at, body): one for each field of the JSON body that has a utilization."""
    fields = F.explode(F.try_variant_get(F.try_parse_json("body"), "$", "map<string,variant>"))
    rows = payload.select("snapshot_at", fields.alias("field", "v")).where(F.col("field") != "extra_usage")
    used = F.try_variant_get("v", "$.utilization", "double")
    return rows.where(used.isNotNull()).select("snapshot_at", "field", F.round(used, 2).alias("utilization_pct"), F.coalesce(F.try_variant_get("v", "$.resets_at", "string"), F.lit("")).alias("resets_at"))


def append_quota(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/quota_log")
