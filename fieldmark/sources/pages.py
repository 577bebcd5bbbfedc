"""Registers that are published as tables in web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registers import html_rows, table_under

#: Named characters in pages.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


def unescaped(c: Column) -> Column:
    """Without named characters; the ampersand is the last, so that nothing is read twice."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(c)


def tables_of(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``table`` (from 0) and ``rows`` (arrays of cells) for each table of each page."""
    pattern = F.lit(r"(?is)<table[^>]*>(.*?)</table>")
    each = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), pattern, 1)).alias("table", "_t"))
    return each.withColumn("rows", F.transform(html_rows(F.col("_t")), lambda r: F.transform(r, unescaped))).drop("_t")


def marked_rows(pages: DataFrame, key: str, marker: str, names: list[str], html: str = "html") -> DataFrame:
    """``key``, ``_ord`` and the columns ``names`` of the first table of each page that holds ``marker`` in a cell.

    The first such row is the header: columns are found by their trimmed names in
    it, and what stands below are the rows, in order from 0.  A name that the
    header lacks, and cells that a row lacks, are null; pages without the marker
    give nothing.
    """
    header, body = table_under(F.col("rows"), marker)
    marked = tables_of(pages.select(key, html), html).select(key, "table", header, body).where("header is not null")
    first = marked.groupBy(key).agg(F.min_by(F.struct("header", "body"), "table").alias("t"))
    rows = first.select(key, "t.header", F.posexplode("t.body").alias("_ord", "cells"))
    cell = lambda n: F.get("cells", F.nullif(F.array_position("header", n), F.lit(0)).cast("int") - 1).alias(n)
    return rows.select(key, "_ord", *[cell(n) for n in names])


def read_marked_rows(spark: SparkSession, path: str, marker: str, names: list[str]) -> DataFrame:
    """``marked_rows`` of page files, with the path as ``_file``; a page is read whole, by one task."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("html"))
    return marked_rows(pages, "_file", marker, names)


def wide_rows(pages: DataFrame, key: str, names: list[str], skip: int = 2, html: str = "html") -> DataFrame:
    """``key``, ``_ord`` and the cells, named by place, of the rows of a page's first table that have just as many; the first ``skip`` rows go."""
    first = tables_of(pages.select(key, html), html).where(F.col("table") == 0)
    kept = F.filter("rows", lambda r, i: (i >= skip) & (F.size(r) == len(names)))
    rows = first.select(key, F.posexplode(kept).alias("_ord", "cells"))
    return rows.select(key, "_ord", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
