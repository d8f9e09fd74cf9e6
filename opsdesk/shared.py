"""Tables of steps in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, in folders by these columns: its lineage ends there, and what it was made of is not
    worked out again."""
    path = f"{shared_folder(df.sparkSession)}/opsdesk-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in tables:
        path = df.__dict__.pop("_written", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def sized(df: DataFrame, most: int) -> DataFrame:
    """A side of a join, broadcast once it is counted to have no more than most rows; a larger one is merged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
