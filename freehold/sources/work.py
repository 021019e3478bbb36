"""Tables that a session keeps in the folder its spark.checkpoint.dir names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str = "landing") -> str:
    """A fresh folder that driver and executors share; without spark.checkpoint.dir only a local session has one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Lets the session's cleaner see which shuffles are done with, so that a long job's disk use stays level."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept(df: DataFrame, name: str = "kept", more: Iterable[DataFrame] = ()) -> DataFrame:
    """df written once and read back: what builds on it scans that table and not df's plan. More frames are written after it, one at a time."""
    path = work_dir(df.sparkSession, name)
    for part in (df, *more):
        part.write.mode("append").parquet(path)
        tidy(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.kept_path = path
    return back


def drop_kept(*tables: DataFrame) -> None:
    """Removes tables of kept() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.kept_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
