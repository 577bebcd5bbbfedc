"""Operator 10, line dedup with keep bitmaps (DataFrame functions only).

Lines are hashed once into a staged table, range-partitioned by (hash, document)
and sorted by (hash, document, position).  A hot line so spans many partitions.
A window streams over the sorted rows and marks where a document first has a
key; the marked rows are counted by (partition, hash), and only those counts
meet by hash.  The verdict goes back by (partition, hash), again split.  What comes
out is one run-length encoded keep bitmap per document that loses lines; texts
take no part in the shuffles until a caller applies the bitmaps.

Defined results: a null or empty text is one empty line.  Documents are told
apart by doc_id (null is one id); a repeated row counts once and gets the same
bitmap.  Extra columns pass through ``apply_bitmaps`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, staged

STRIP = " \t\n\x0b\x0c\r"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row per line: h1, h2 (128 bits of the key), doc_id, version (hash of the text), pos, chars."""
    text = _text()
    lines = docs.select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(split_lines(text)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(STRIP)))
    return lines.select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc_id", "version", "pos", F.length(key).alias("chars")
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, version, n_lines, n_dropped, runs for each document that loses lines.

    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more
    lose their lines, all of them or, with ``keep_first``, all but the first by
    (doc_id, version, pos).  ``runs`` holds lengths of alternating runs, kept
    first: [kept, dropped, kept, ...].
    """
    # Staged before the ranges are sampled, which would else split and hash all texts twice.
    lines = staged(hashed_lines(docs).where(F.col("chars") >= min_chars).drop("chars"), "line-hashes")
    ranged = lines.repartitionByRange("h1", "h2", "doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("h1", "h2", "doc_id", "version", "pos")
    # The ranges hold all rows of a (hash, document), so the window needs neither a shuffle nor a sort.
    at = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("version", "pos"))
    rows = staged(ranged.withColumn("opens", at == 1), "sorted-lines")
    discard(lines)
    place = F.struct("doc_id", "version", "pos")
    runs = rows.where("opens").groupBy("part", "h1", "h2").agg(F.count("*").alias("docs"), F.min(place).alias("first"))
    common = runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs).drop("docs")
    verdict = runs.select("part", "h1", "h2").join(common, ["h1", "h2"])
    dropped = rows.join(verdict, ["part", "h1", "h2"])
    if keep_first:
        dropped = dropped.where(~place.eqNullSafe(F.col("first")))
    gone = dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    ends = F.filter("gone", lambda x, i: F.coalesce(F.get("gone", i + 1) != x + 1, F.lit(True)))
    run = lambda s, i: F.array(s - F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1), F.get("ends", i) + 1 - s)
    return gone.withColumn("starts", starts).withColumn("ends", ends).select(
        "doc_id", "version", F.size("gone").cast("long").alias("n_dropped"), F.flatten(F.transform("starts", run)).alias("runs")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped (in place of columns so named); untouched documents keep their text as it is."""
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    marks = bitmaps.select(F.struct("doc_id", "version", "n_dropped", "runs").alias("mark"))
    text = F.coalesce("doc.text", F.lit(""))
    joined = packed.join(marks, F.col("doc.doc_id").eqNullSafe(F.col("mark.doc_id")) & (F.xxhash64(text) == F.col("mark.version")), "left").withColumn("lines", split_lines(text)).withColumn("runs", F.col("mark.runs"))
    # Kept runs stand at even places; lines behind the last run have no flag and stay; array_join leaves out nulls.
    flags = F.flatten(F.transform("runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    pieces = F.zip_with("lines", flags, lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line))
    kept = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(pieces, "\n"))
    return joined.select("doc.*", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce("mark.n_dropped", F.lit(0).cast("long")).alias("n_dropped"))
