"""Incremental ingestion of new register files into a table partitioned by country."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_drops(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of files that appear below ``source`` to Parquet at ``target``, once each."""
    stream = spark.readStream.schema(schema).option("header", True).csv(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("country").trigger(availableNow=True).start()
