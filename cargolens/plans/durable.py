"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "cargolens.shared.folder"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own, one a session, only where it is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(OWN_FOLDER, where)
    return where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file of that name in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def freed(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that have ended: Spark deletes them once the driver's collector finds them unused, which else runs when its heap is full."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df after a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint()
    freed(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends, and `discard` can delete it."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    freed(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
