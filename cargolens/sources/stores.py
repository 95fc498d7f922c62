"""Stores and sinks: what one run writes, another reads, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.plans.durable import exists, shared_folder
from cargolens.sources.records import DOMAINS


RECORD_TABLES = ["lineitem", "orders", "customer", "supplier", "part"]


def stamp(spark: SparkSession, sf_dir: str, tables: list[str] = RECORD_TABLES) -> str:
    """The files of these tables with their sizes and times: what is made from them has another key once they change."""
    out = []
    for t in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        out += sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))
    return "\n".join(out)


def place(spark: SparkSession, kind: str, key: str) -> str:
    """The folder of an artefact: its kind, and a digest of what it was made from."""
    return f"{shared_folder(spark)}/stores/{kind}-{hashlib.md5(key.encode()).hexdigest()}"


def once(spark: SparkSession, kind: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under that key, made and written only where it is not there yet; a write that failed leaves no mark of success and is made again."""
    path = place(spark, kind, key)
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matrix(df: DataFrame, domains: list[str] = DOMAINS, id_: str = "rec_id") -> DataFrame:
    """A record matrix: the id and one array of codes, in order of domain."""
    return df.select(id_, F.array(*(F.col(d).cast("int") for d in domains)).alias("codes"))


def columns_of(stored: DataFrame, domains: list[str] = DOMAINS, id_: str = "rec_id") -> DataFrame:
    """A record matrix as columns again."""
    return stored.select(id_, *(F.get("codes", F.lit(i)).alias(d) for i, d in enumerate(domains)))


def through_csv(df: DataFrame, path: str) -> DataFrame:
    """df written as CSV with a header, and read with its own schema."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("mode", "FAILFAST").csv(path)


def through_text(df: DataFrame, column: str, path: str) -> DataFrame:
    """A corpus of one line a row, and its lines."""
    df.select(column).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path).withColumnRenamed("value", column)
