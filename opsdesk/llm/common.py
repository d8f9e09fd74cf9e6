"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or a temporary one where that is unset and the session is local
    (tests). Elsewhere executors would write to their own disks, so that an unset one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor
    costs no recomputation. Steps drop() what they no longer need; what a result still reads stays until the
    cluster's own policy for spark.checkpoint.dir clears it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/opsdesk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing will read again. Others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_written", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def wide(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt by key and merged at every size, so that the plan
    measured on a small input is the plan of a large one, and AQE can split a hot key."""
    return df.hint("merge")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def hash_below(col: Column, fraction: float, seed: int) -> Column:
    """True for about this share of the values, the same ones in every run."""
    top = 1 << 30
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(top)) < F.lit(int(min(1.0, fraction) * top))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
