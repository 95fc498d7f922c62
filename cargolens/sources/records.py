"""The record view: one row a shipment with an id and eight categorical domains."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ["carrier", "consignee", "destination", "hscode", "origin", "port_of_lading", "port_of_unlading", "shipper"]
META_PATHS = [["hscode", "shipper"], ["origin", "shipper"], ["consignee", "shipper"], ["carrier", "port_of_lading", "shipper"]]


@dataclass(frozen=True)
class Config:
    """Parameters of the preprocessing stage, passed explicitly."""

    split_date: str = "2000-01-01"
    least_count: int = 10
    deny: dict[str, list[str]] = field(default_factory=lambda: {"carrier": ["0F"]})
    codes: tuple[str, ...] = ("Brand#1", "Brand#23")
    seed: int = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, paths: list[str], schema: str, columns: list[str], month: str | None = None) -> DataFrame:
    """CSV files with a fixed schema, some of their columns, files chosen by a pattern of their names."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(paths)
    return (df.filter(F.col("_metadata.file_name").rlike(month)) if month else df).select(columns)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A headerless list of codes, repeats removed."""
    return spark.read.text(path).select(F.trim("value").alias("code")).filter("code <> ''").distinct()


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Meta-paths, a line each: domains separated by commas."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("path"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, shipped and the domains; every join is by key on its many side, and lines are joined while they are narrow."""
    t = lambda n: table(spark, sf_dir, n)
    ordered = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_nationkey", F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("port_of_unlading"))
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    rec_id = F.md5(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")))
    text = lambda c: F.col(c).cast("string")
    return j.select(
        rec_id.alias("rec_id"), F.to_date("l_shipdate").alias("shipped"), F.concat((F.col("p_size") % 10).cast("string"), F.col("l_linestatus")).alias("carrier"), text("o_custkey").alias("consignee"), text("c_nationkey").alias("destination"), F.col("p_brand").alias("hscode"), text("s_nationkey").alias("origin"), F.concat_ws("|", "p_type", "l_returnflag").alias("port_of_lading"), "port_of_unlading", text("l_suppkey").alias("shipper")
    )


RECORDS_SQL = """rec AS (SELECT md5(concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))) rec_id, l_shipdate::DATE shipped,
 (p_size % 10)::VARCHAR || l_linestatus carrier, o_custkey::VARCHAR consignee, c_nationkey::VARCHAR destination, p_brand hscode, s_nationkey::VARCHAR origin,
 p_type || '|' || l_returnflag port_of_lading, c_mktsegment || '|' || o_orderpriority port_of_unlading, l_suppkey::VARCHAR shipper
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
