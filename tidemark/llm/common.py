"""What the operators of this subpackage share: table scans, lineage cuts and the word rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Used only on a local master whose session names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidemark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a local master may go without one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder is None:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
    return folder


def private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that nothing of ours has, by position, and what each column is called there."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that losing an executor never recomputes what precedes."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def key_text(column: str) -> Column:
    """``column`` as text, null as the empty string: the input of the crc32 folds."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, folds: int, held: int) -> Column:
    """Whether a row is held out: crc32 of the id's text modulo ``folds`` equals ``held``; a null id counts as ''."""
    return (F.crc32(key_text(column).cast("binary")) % folds) == held


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
