"""The registers' logical tables, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Nation and region names; 25 rows, so a broadcast is safe."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return F.broadcast(joined.select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("country")))


def facilities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"), F.lit("Meat Slaughter").alias("type"), F.lit(0).alias("source_rank"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("type"), F.lit(1).alias("source_rank"))
    return s.unionByName(c).join(places(spark, d), "n_nationkey").drop("n_nationkey")


FACILITIES = """fac AS (
    SELECT u.id, u.name, n_name AS state, r_name AS country, u.type, u.source_rank FROM (
        SELECT s_suppkey AS id, s_name AS name, s_nationkey AS k, 'Meat Slaughter' AS type, 0 AS source_rank FROM supplier
        UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment, 1 FROM customer) u
    JOIN nation ON u.k = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def markers(spark: SparkSession, d: str) -> DataFrame:
    """id, lat and lng from customer keys, zeros and limits included."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k % 181 - 90).cast("double").alias("lat"), (k * 7 % 361 - 180).cast("double").alias("lng"))


MARKERS = "mk AS (SELECT c_custkey AS id, CAST(c_custkey % 181 - 90 AS DOUBLE) AS lat, CAST(c_custkey * 7 % 361 - 180 AS DOUBLE) AS lng FROM customer)"
