"""The place of every row in its file, kept from the read on.

Row order means something in the registers: the first match wins, the last row
of a key wins, and searches list hits in the order of the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import staged

#: Columns that a read with source order adds.
FILE, ORDER, SOURCE = "_file", "_ord", "_source"


def with_source_order(scan: DataFrame) -> DataFrame:
    """Adds ``_file`` and ``_ord``, the row's place in its file from 0 without gaps, to a scan of files.

    A task numbers the rows of a split as they come.  Splits know where in the
    file they begin, so a sum over the splits before gives each its start; a
    split's rows never meet another's in one task.  The numbered rows are written
    first: read twice, splits could fall to other tasks in between.
    """
    block, at = F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    rows = staged(scan.select("*", F.col("_metadata.file_path").alias(FILE), block, at), "source-rows")
    splits = rows.groupBy(FILE, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(FILE).orderBy("_block")) - F.col("_n")  # a row per split
    starts = splits.select(FILE, "_block", (before - F.col("_first")).alias("_shift"))
    return rows.join(starts, [FILE, "_block"]).withColumn(ORDER, F.col("_at") + F.col("_shift")).drop("_block", "_at", "_shift")


def read_in_order(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", quoted_lines: bool = False) -> DataFrame:
    """CSV files with differing headers under one another, in the order of ``paths`` and of their rows.

    ``_source`` is the place in ``paths``, ``_file`` and ``_ord`` the file and the
    place in it; columns that a file lacks are null.  A path may name a folder or
    a pattern, whose files share a header and come in the order of their names.
    ``quoted_lines`` allows line feeds within quotes, at the price that a file is
    not split.
    """
    reads = []
    for k, path in enumerate(paths):
        scan = spark.read.option("header", True).option("escape", '"').option("encoding", encoding).option("multiLine", quoted_lines).csv(path)
        reads.append(with_source_order(scan).withColumn(SOURCE, F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reads)


def source_order() -> list[str]:
    """What to order by to get the rows of ``read_in_order`` as they stand in the files."""
    return [SOURCE, FILE, ORDER]


def numbered_files(spark: SparkSession, pattern: str, numbers: range) -> list[str]:
    """The paths ``pattern.format(n)`` of those numbers whose file exists, in order."""
    path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(pattern.format(n))
    return [pattern.format(n) for n in numbers if path(n).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(n))]
