"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where the session names none, a local master gets a temporary folder (driver and tasks
    are one process there); a cluster is an error, for a folder of one machine would not be seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="panelmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for a small table that several steps read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of the files that a task's rows come from.
TASK_BYTES = 16 << 20


def tasks_for(df: DataFrame) -> int:
    """Tasks for rows of ``df`` that stay together by a key: one for each ``TASK_BYTES`` of the files it reads, and not
    fewer than the session's shuffle partitions unless the files are small."""
    spark = df.sparkSession
    size = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-size // TASK_BYTES), min(usual, -(-size // (1 << 20))), 1) if size else usual
