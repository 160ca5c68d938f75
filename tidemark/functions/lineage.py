"""Lineage cuts in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidemark"

#: Rows of a side that may be broadcast after they have been counted.
FEW = 10_000

#: Rows of a table for each task where tasks sort or group them.
ROWS_OF_A_TASK = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local master may go without one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder is None:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_CHECKPOINTS
    return folder


def dealt(spark: SparkSession) -> int:
    """Partitions for rows of few bytes that take long to work on: Spark merges partitions by their bytes alone, unless their
    number is asked for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys``. Where ``rows``, of the table that it is made from, are many, so is the number of partitions: tasks
    that sort or group hold ``ROWS_OF_A_TASK`` rows, however well these compress. What joins or groups by ``keys`` next needs no
    other shuffle."""
    parts = -(-rows // ROWS_OF_A_TASK)
    if parts <= df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: what follows reads the rows that were written, whatever is lost or planned anew."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Written:
    """Cuts as Parquet in a folder of its own below the shared one. A checkpoint keeps its plan's size estimate, which multiplies
    join by join; files have their real size, so many rounds of joins stay cheap to plan. ``close`` removes the folder."""

    def __init__(self, spark: SparkSession):
        self.folder, self.count = f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def close(self, spark: SparkSession) -> None:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
