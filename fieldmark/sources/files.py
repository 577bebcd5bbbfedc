"""Typed scans of registers: CSV with an explicit policy for bad rows, XML and KML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import read_in_order, with_source_order


def read_register(spark: SparkSession, path: str, required: list[str], numbers: list[str], policy: str = "fail", encoding: str = "UTF-8", ordered: bool = False) -> DataFrame:
    """A CSV with a header, blanks as '', ``numbers`` as doubles; with ``ordered`` also ``_file`` and ``_ord``, the row's place in it.

    All columns are read as text and cast here, so that column pruning cannot
    change which rows are bad: 'drop' filters them, 'fail' raises on reading.
    Rows that are dropped leave a gap in the order.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("encoding", encoding).csv(path)
    if ordered:
        placed = with_source_order(raw)
        return _checked(placed, [c for c in placed.columns if c not in ("_file", "_ord")], required, numbers, policy)
    return _checked(raw, raw.columns, required, numbers, policy)


def _checked(raw: DataFrame, names: list[str], required: list[str], numbers: list[str], policy: str) -> DataFrame:
    if missing := set(required) - set(names):
        raise ValueError(f"missing columns: {sorted(missing)}")
    text = raw.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in names else F.col(c) for c in raw.columns])
    parsed = {n: F.col(f"`{n}`").try_cast("double") for n in numbers}
    if policy == "drop":
        for c in parsed.values():
            text = text.where(c.isNotNull())
        return text.withColumns(parsed)
    bad = lambda n: F.raise_error(F.concat(F.lit(f"bad {n}: "), F.col(f"`{n}`"))).cast("double")
    return text.withColumns({n: F.coalesce(c, bad(n)) for n, c in parsed.items()})


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """folder, name, description, lat, lng of every placemark in the folders of a KML file."""
    schema = "name string, Placemark array<struct<name: string, description: string, Point: struct<coordinates: string>>>"
    folders = spark.read.format("xml").option("rowTag", "Folder").schema(schema).load(path)
    marks = folders.select(F.col("name").alias("folder"), F.explode("Placemark").alias("p"))
    part = lambda k: F.get(F.split(F.trim("p.Point.coordinates"), ","), F.lit(k)).try_cast("double")
    return marks.select("folder", "p.name", "p.description", part(1).alias("lat"), part(0).alias("lng"))


def read_orphan_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """name, description, lat, lng of the placemarks of a KML file that lie in no folder."""
    schema = "name string, description string, Point struct<coordinates: string>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    part = lambda k: F.get(F.split(F.trim("Point.coordinates"), ","), F.lit(k)).try_cast("double")
    everything = marks.select("name", "description", part(1).alias("lat"), part(0).alias("lng"))
    return everything.exceptAll(read_placemarks(spark, path).drop("folder"))


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines are, else latin-1, under which any bytes can be read."""
    return "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def read_positional(spark: SparkSession, path: str, names: list[str], separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV without a header, its columns named by place; missing ones are null, further ones are left out."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("header", False).option("sep", separator).option("escape", '"').option("encoding", encoding).schema(schema).csv(path)


def write_export(tables: list[DataFrame], path: str) -> None:
    """Tables with differing columns as one CSV under the union of their headers, in order of appearance; lacking values are blank.

    Every part file has a header; ``exports.write_client_csv`` writes one before all rows.
    """
    first, *rest = tables
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    first.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_xml_rows(spark: SparkSession, path: str, schema: str, row_tag: str = "row") -> DataFrame:
    """Rows of an XML register; columns that a row lacks are null."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_all(spark: SparkSession, paths: list[str], ordered: bool = False) -> DataFrame:
    """Files with differing headers under one another; missing columns are null.  ``ordered`` adds what ``read_in_order`` adds."""
    if ordered:
        return read_in_order(spark, paths)
    first, *rest = [spark.read.option("header", True).option("escape", '"').csv(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
