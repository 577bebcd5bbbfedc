"""Exports as text, byte for byte, and tables that are replaced without being lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def script_number(c: Column) -> Column:
    """A number as a script writes it: no point without decimals, powers of ten only below 1e-6 and from 1e21 on."""
    text = c.cast("double").cast("string")
    size = F.abs(c.cast("double"))
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E(?=[0-9])", "E+"), "E", "e")
    return F.when(F.isnan(c.cast("double")), "NaN").when((size == 0), "0").when((size < 1e-6) | (size >= 1e21), power).otherwise(plain)


def field(c: Column, kind: str) -> Column:
    """A value as a field: quoted only if it holds a quote, comma or line feed; null is nothing."""
    text = script_number(c) if kind in ("double", "float") else c.cast("string")
    return F.coalesce(F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def client_lines(tables: list[DataFrame], orders: list[list[str]]) -> DataFrame:
    """place, line: a header and the rows of all tables, in the order of the tables and within each of its ``orders`` columns.

    The header is the union of the tables' columns in order of appearance, but
    for the columns of ``orders`` that start with an underscore; a table without
    rows names no columns.  Without any rows there are no lines at all.
    """
    shown = [[c for c in df.columns if not (c in order and c.startswith("_"))] for df, order in zip(tables, orders, strict=True)]
    held = [(df, order, names) for df, order, names in zip(tables, orders, shown, strict=True) if not df.isEmpty()]
    spark = tables[0].sparkSession
    if not held:
        return spark.createDataFrame([], "place struct<table: int, key: struct<none: int>>, line string")
    header = list(dict.fromkeys(c for _, _, names in held for c in names))
    key = lambda k, order: [F.lit(k).alias("table")] + [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]
    parts = []
    for k, (df, order, names) in enumerate(held):
        kinds = dict(df.dtypes)
        line = F.concat_ws(",", *[field(F.col(f"`{c}`"), kinds[c]) if c in names else F.lit("") for c in header])
        parts.append(df.select(*key(k, order), line.alias("line")))
    first = spark.range(1).select(F.lit(-1).alias("table"), F.concat_ws(",", *[field(F.lit(c), "string") for c in header]).alias("line"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [first, *parts])


def write_client_csv(tables: list[DataFrame], orders: list[list[str]], path: str) -> None:
    """Writes ``client_lines`` as text files which, joined in the order of their names, are the client's text and one line feed."""
    lines = client_lines(tables, orders)
    lines.orderBy(*[c for c in lines.columns if c != "line"]).select("line").write.text(path)


def write_fixed(df: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """A CSV of exactly these columns, in this order, with one header before all rows; missing columns are blank, others go."""
    kept = [F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns]
    hidden = [F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(order)]
    write_client_csv([df.select(*kept, *hidden)], [[f"_by{i}" for i in range(len(order))]], path)


def _paths(spark: SparkSession, path: str) -> tuple:
    make = spark._jvm.org.apache.hadoop.fs.Path
    at = make(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), make, at


def _whole(fs, make, path: str) -> bool:
    """Whether a write of Parquet to ``path`` was finished."""
    return fs.exists(make(f"{path}/_SUCCESS"))


def current_path(spark: SparkSession, path: str) -> str:
    """Where the table is read: ``path``, or its backup while a replacement was cut short."""
    fs, make, _ = _paths(spark, path)
    for p in (path, f"{path}.backup"):
        if _whole(fs, make, p):
            return p
    raise FileNotFoundError(f"no table at {path}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, path))


def replace_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Puts ``df``, which may be made from the table itself, in the place of the table; the old one becomes its backup.

    With ``partitions`` the table has a folder for each value of these columns.

    The rows are written aside and take their place by renaming, so that at every
    moment the table or its backup is whole; ``read_current`` finds which.  Where
    an earlier replacement was cut short, the backup is the table, and it is put
    back first.
    """
    spark = df.sparkSession
    fs, make, at = _paths(spark, path)
    aside, backup = f"{path}.new", f"{path}.backup"
    fs.delete(make(aside), True)
    df.write.partitionBy(*(partitions or [])).parquet(aside)
    if _whole(fs, make, path):
        fs.delete(make(backup), True)
        _rename(fs, at, make(backup))
    else:
        fs.delete(at, True)  # what a write that failed has left
    _rename(fs, make(aside), at)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")
