"""The graph that the order tables hold: parts are nodes, pairs within an order are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("uid"), F.lower("p_name").alias("name"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a returned part to a later accepted one of the same order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("n"))
    b = lines.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("m"))
    return a.join(b, "l_orderkey").where("n < m and src <> dst").select("src", "dst").distinct()
