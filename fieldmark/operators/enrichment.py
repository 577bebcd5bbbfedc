"""Coordinates by address from an outside source, asked once for each address."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import staged

CACHE = "address string, latitude double, longitude double"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The answers so far, one for each address; none where nothing was asked yet."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    # Runs that met at the same time may have asked for the same; the least answer counts.
    at = F.min(F.struct("latitude", "longitude")).alias("at")
    return found.groupBy("address").agg(at).select("address", "at.latitude", "at.longitude")


def with_coordinates(df: DataFrame, address: Column, ask: Callable[[DataFrame], DataFrame], inside: Callable[[Column, Column], Column], cache: str) -> DataFrame:
    """``df`` (latitude, longitude) with coordinates for the rows that have none ``inside``, and ``outcome``.

    ``ask`` gets the addresses (address) that the cache lacks, each once, and
    answers some of them (address, latitude, longitude).  Answers that are not
    inside count as none; all that was asked is added to the cache, misses as
    nulls, so that nothing is asked twice.  Rows whose coordinates are inside
    stay and are ``skipped``, as are rows without an address, whose coordinates
    stay too; others are ``geocoded``, or ``failed`` and keep what they had.
    """
    spark = df.sparkSession
    good = lambda lat, lng: F.coalesce(inside(lat, lng), F.lit(False))
    lat, lng = F.col("latitude"), F.col("longitude")
    rows = df.withColumn("_address", F.when(~good(lat, lng), F.nullif(F.trim(address), F.lit(""))))
    known = read_cache(spark, cache)
    missing = staged(rows.select(F.col("_address").alias("address")).where("address is not null").distinct().join(known, "address", "left_anti"), "addresses")
    if not missing.isEmpty():
        answers = ask(missing).where(good(lat, lng)).groupBy("address").agg(F.min(F.struct("latitude", "longitude")).alias("at"))
        told = missing.join(answers, "address", "left").select("address", F.col("at.latitude").cast("double").alias("latitude"), F.col("at.longitude").cast("double").alias("longitude"))
        told.write.mode("append").parquet(cache)
        known = read_cache(spark, cache)
    found = known.select(F.col("address").alias("_address"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lng"))
    outcome = F.when(F.col("_address").isNull(), "skipped").when(F.col("_lat").isNotNull(), "geocoded").otherwise("failed")
    joined = rows.join(found, "_address", "left").withColumn("outcome", outcome)
    return joined.withColumns({"latitude": F.coalesce("_lat", lat), "longitude": F.coalesce("_lng", lng)}).select(*df.columns, "outcome")
