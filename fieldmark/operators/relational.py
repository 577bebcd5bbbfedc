"""Joins, dedup, set and ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import staged


def suffixed_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key (null meets null); other shared names get _x and _y."""
    both = (set(left.columns) & set(right.columns)) - {key}
    a = left.withColumnsRenamed({c: f"{c}_x" for c in both})
    b = right.withColumnsRenamed({c: f"{c}_y" for c in both} | {key: "_key"})
    return a.join(b, a[key].eqNullSafe(b["_key"]), "left").drop("_key")


def lookup_update(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Replaces a column where the key has an update; repeated keys keep their last update by ``_ord``."""
    last = updates.groupBy(key).agg(F.max_by(column, "_ord").alias("_new"))
    return df.join(last, key, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")


def _grams(text: Column, size: int) -> Column:
    """The distinct parts of so many characters."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: text.substr(i, F.lit(size)))
    return F.array_distinct(F.filter(parts, lambda g: F.length(g) == size))


#: Characters of a part, and names that are sent to every executor at most; more are shuffled.
GRAM, FEW_NAMES = 3, 10_000


def containment_candidates(names: DataFrame, titles: DataFrame) -> DataFrame:
    """name_id, name, title and _ord of the pairs that share the name's rarest part, which all titles that contain the name do.

    Parts have ``GRAM`` characters, or are the whole of a shorter name.  How many
    titles hold a part is counted, and of each name's parts the one that fewest
    titles hold is looked up; a name with a part that no title holds meets none.
    The titles' parts, many times the titles, stay where they are read: their size
    is estimated by that of the file, and a join left alone would send them all
    through the driver.
    """
    low = names.where("name is not null and name <> ''").select("name_id", "name", F.lower("name").alias("_low"))
    sizes = [r[0] for r in low.select(F.least(F.length("_low"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM numbers at most
    title = F.lower("title")
    held = F.flatten(F.array(*[_grams(title, n) for n in sizes])) if sizes else F.array().cast("array<string>")
    indexed = titles.where("title is not null").select("title", "_ord", F.explode(held).alias("_gram"))
    counts = indexed.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = F.when(F.length("_low") >= GRAM, _grams(F.col("_low"), GRAM)).otherwise(F.array("_low"))
    parts = low.withColumn("_gram", F.explode(own)).join(counts.hint("merge"), "_gram", "left")
    rarest = F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")
    probes = staged(parts.groupBy("name_id", "name").agg(rarest), "probes")
    few = probes.count() <= FEW_NAMES
    return indexed.join(probes.hint("broadcast" if few else "merge"), "_gram").select("name_id", "name", "title", "_ord")


def first_containing(names: DataFrame, titles: DataFrame) -> DataFrame:
    """For each (name_id, name) the first title by ``_ord`` that contains it, in any case; null without one."""
    contains = F.lower("title").contains(F.lower("name"))
    hits = containment_candidates(names, titles).where(contains).groupBy("name_id").agg(F.min_by("title", "_ord").alias("title"))
    # Every title contains the empty name: the first one, a single row.
    first = titles.agg(F.min_by("title", "_ord").alias("_first")).withColumn("_name", F.lit(""))
    found = names.join(hits, "name_id", "left").join(F.broadcast(first), F.col("name") == F.col("_name"), "left")
    return found.withColumn("title", F.coalesce("title", "_first")).drop("_first", "_name")


DENSE = 10_000


def near_pairs(points: DataFrame, targets: DataFrame, eps: float, dense: int = DENSE) -> DataFrame:
    """Targets (target_id, t_lat, t_lng) beside the points of their cells and the cells around, on a grid of cells of ``eps``.

    A cell with more than ``dense`` points is dealt into as many parts as hold
    about so many each, and its targets meet every part.
    """
    cell = lambda c: F.floor(F.col(c) / eps)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    gridded = points.withColumn("_x", cell("lat")).withColumn("_y", cell("lng"))
    cells = gridded.groupBy("_x", "_y").agg(F.ceil(F.count("*") / dense).alias("_parts"))
    dealt = gridded.join(cells, ["_x", "_y"]).withColumn("_part", F.pmod(F.xxhash64("point_id", "_ord"), F.col("_parts"))).drop("_parts")
    spread = targets.withColumn("_d", F.explode(around)).select("target_id", "t_lat", "t_lng", (cell("t_lat") + F.col("_d.i")).alias("_x"), (cell("t_lng") + F.col("_d.j")).alias("_y"))
    asked = spread.join(cells, ["_x", "_y"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return asked.join(dealt, ["_x", "_y", "_part"])


def near(points: DataFrame, targets: DataFrame, eps: float = 0.001, dense: int = DENSE) -> DataFrame:
    """First point (by layer, then ``_ord``) within ``eps`` of each target; targets without one are left out."""
    close = (F.abs(F.col("lat") - F.col("t_lat")) < eps) & (F.abs(F.col("lng") - F.col("t_lng")) < eps)
    return near_pairs(points, targets, eps, dense).where(close).groupBy("target_id").agg(F.min_by("point_id", F.struct("layer", "_ord")).alias("point_id"))


def keyed_dedup(base: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The last base row of a key, or else the first of the others by (source, _ord)."""
    rows = base.withColumn("_rank", F.struct(F.lit(0).alias("s"), (-F.col("_ord")).alias("o"))).unionByName(others.withColumn("_rank", F.struct((F.col("_source") + 1).cast("int").alias("s"), F.col("_ord").alias("o"))).drop("_source"))
    kept = F.row_number().over(Window.partitionBy(key).orderBy("_rank"))
    return rows.withColumn("_n", kept).where("_n = 1").drop("_n", "_rank")


def numbered(df: DataFrame, order: list[Column | str], start: int = 0) -> DataFrame:
    """Dense ids in order without one global window: rows are range-partitioned, counted, and numbered within.

    The ranges are written first: a second evaluation would sample other bounds,
    and rows would be counted under one range and numbered under another.  Rows
    that tie in ``order`` get their ids in any order.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").count().withColumn("_start", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    joined = ranged.withColumn("_n", within).join(F.broadcast(counts), "_part", "left")  # a row per partition
    return joined.withColumn("id", F.coalesce("_start", F.raise_error(F.lit("a range without a count")).cast("long")) + F.col("_n") - 1 + start).drop("_part", "_n", "_start")


def ranked_search(df: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Name hits before trade-name hits, source order within; the top ``limit``."""
    bucket = F.when(F.lower("name").contains(term), 0).when(F.lower("dba").contains(term), 1)
    return df.withColumn("bucket", bucket).where("bucket is not null").orderBy("bucket", "source_rank", "_ord").limit(limit)


def chunked(df: DataFrame, order: list[str], size: int = 2000) -> DataFrame:
    """Chunk numbers (from 1) of ``size`` rows in order."""
    return numbered(df, order).withColumn("chunk", F.expr(f"cast(id div {size} as int) + 1"))


def locale_sorted(df: DataFrame, column: str) -> DataFrame:
    """Rows in the root locale's order of a text column: accents and case count last."""
    return df.orderBy(F.collate(F.col(column), "UNICODE"), column)


def write_chunks(df: DataFrame, order: list[str], path: str, size: int = 2000) -> None:
    """CSV files of ``size`` rows in order, each in a folder chunk=1, chunk=2 and so on."""
    chunked(df, order, size).drop("id").repartition("chunk").sortWithinPartitions("chunk", *order).write.partitionBy("chunk").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def samples_per_type(df: DataFrame, kind: str, order: str, first: int = 20, each: int = 2) -> DataFrame:
    """Of the first rows in order, the first few of each type."""
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    return df.orderBy(order).limit(first).withColumn("_n", nth).where(F.col("_n") <= each).drop("_n")


def with_cached_coordinates(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates by (street, city, zip) from a cache of texts; the last usable row of a key wins (by ``_ord``).

    Rows whose coordinates are no finite numbers are passed over; a place that the cache lacks gets 0.0, 0.0.
    """
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    usable = cache.where(F.col("latitude").rlike(number) & F.col("longitude").rlike(number))
    at = F.struct(F.trim("latitude").cast("double").alias("latitude"), F.trim("longitude").cast("double").alias("longitude"))
    last = usable.groupBy("street", "city", "zip").agg(F.max_by(at, "_ord").alias("_at"))
    found = df.drop("latitude", "longitude").join(last, ["street", "city", "zip"], "left")
    return found.withColumns({c: F.coalesce(f"_at.{c}", F.lit(0.0)) for c in ("latitude", "longitude")}).drop("_at")
