"""Counts, coverage, bounds, clusters, translations and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Total, and number and percentage of rows for each test."""
    percent = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 1)
    return df.agg(F.count("*").alias("total"), *[x for n, c in tests.items() for x in (F.count_if(c).alias(f"n_{n}"), percent(c).alias(f"pct_{n}"))])


def layer_counts(counts: DataFrame, shown: set[str]) -> DataFrame:
    """layer, label, n and total of the layers (layer, n) that are switched on and not empty, in the order shown to readers.

    Inspections count as other locations while breeders, dealers or exhibitors are on.
    """
    labels = [("slaughter", "Slaughterhouses"), ("processing", "Processing Plants"), ("breeder", "Production Facilities"), ("exhibitor", "Exhibition Facilities"), ("labs", "Animal Labs"), ("inspections", "Other Locations")]
    on = shown | ({"inspections"} if shown & {"breeder", "dealer", "exhibitor"} else set())
    kept = [(k, layer, label) for k, (layer, label) in enumerate(labels) if layer in on]
    if not kept:
        return counts.where(F.lit(False)).select("layer", F.lit("").alias("label"), "n", F.lit(0).cast("long").alias("total"), F.lit(0).alias("place"))
    place, label = (F.create_map(*[F.lit(x) for row in kept for x in (row[1], row[i])]) for i in (0, 2))
    seen = counts.where(F.col("layer").isin([x for _, x, _ in kept]) & (F.col("n") > 0))
    return seen.select("layer", F.try_element_at(label, F.col("layer")).alias("label"), "n", F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"), F.try_element_at(place, F.col("layer")).alias("place"))  # six rows at most


def padded_bounds(df: DataFrame, share: float = 0.1) -> DataFrame:
    lat, lng = F.max("lat") - F.min("lat"), F.max("lng") - F.min("lng")
    return df.agg((F.min("lat") - share * lat).alias("south"), (F.max("lat") + share * lat).alias("north"), (F.min("lng") - share * lng).alias("west"), (F.max("lng") + share * lng).alias("east"))


def grid_clusters(df: DataFrame, zoom: int, radius: int = 50) -> DataFrame:
    """Markers per cell of a Web-Mercator pixel grid at a zoom (an approximation of greedy clustering)."""
    world = 256 * 2**zoom
    x = (F.col("lng") + 180) / 360 * world
    rad = F.radians("lat")
    y = (1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / F.pi()) / 2 * world
    return df.groupBy(F.floor(x / radius).alias("cx"), F.floor(y / radius).alias("cy")).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"))


def translated(df: DataFrame, key: str, dictionary: DataFrame, locale: str) -> DataFrame:
    """Adds the text of a dotted key in a locale, the key itself where there is none."""
    words = dictionary.where(F.col("locale") == locale).select(F.col("key").alias("_key"), "value")
    return df.join(words, F.col(key) == F.col("_key"), "left").withColumn("text", F.coalesce("value", F.col(key))).drop("_key", "value")


def csv_line(*cols: Column) -> Column:
    """One CSV line, quoting only values with a quote, comma or line feed."""
    quoted = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in [F.coalesce(c.cast("string"), F.lit("")) for c in cols]]
    return F.concat_ws(",", *quoted)


def shown_coordinate(c: Column) -> Column:
    return F.when(c != 0, c.cast("string")).otherwise("")


def most_common(df: DataFrame, column: str, order: str, limit: int = 10) -> DataFrame:
    """The values of a column that most rows have; of equal ones, that which comes first in order."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(limit).drop("_first")


def clustered(counts: DataFrame, shown: set[str], threshold: int = 2800) -> DataFrame:
    """Total of the layers (layer, n) that are shown, inspections always, and whether so many markers are clustered."""
    total = F.coalesce(F.sum(F.when(F.col("layer").isin(*shown, "inspections"), F.col("n"))), F.lit(0))
    return counts.agg(total.alias("total"), (total >= threshold).alias("clustered"))


def geocode_outcomes(df: DataFrame, valid: Column, found: Column) -> DataFrame:
    """Rows whose coordinates were valid before, were found, or were not, and the share found of those looked up."""
    looked_up = F.count_if(~valid)
    share = F.round(100.0 * F.count_if(~valid & found) / F.nullif(looked_up, F.lit(0)), 1)
    return df.agg(F.count_if(~valid & found).alias("geocoded"), F.count_if(~valid & ~found).alias("failed"), F.count_if(valid).alias("skipped"), share.alias("pct_found"))


def popup_sections(slaughter: Column, slaughtered: Column, slaughter_volume: Column, processed: Column, processing_volume: Column, country: Column) -> list[Column]:
    """Which parts of a facility's popup are shown; animals and processing stay hidden for Mexico, coordinates outside the US are approximate."""
    has = lambda c: F.coalesce((F.trim(c) != "") & ~F.lower(c).isin("n/a", "unknown"), F.lit(False))
    volume = lambda c: F.coalesce(c.isin("1.0", "2.0", "3.0", "4.0", "5.0"), F.lit(False))
    foreign = F.coalesce(country != "mx", F.lit(True))
    return [
        (slaughter & has(slaughtered) & foreign).alias("shows_slaughtered"), (slaughter & volume(slaughter_volume)).alias("shows_slaughter_volume"),
        (has(processed) & foreign).alias("shows_processed"), (volume(processing_volume) & foreign).alias("shows_processing_volume"),
        F.coalesce((country != "") & (country != "us"), F.lit(False)).alias("approximate"),
    ]


def export_name(project: str, day: str, complete: bool) -> str:
    """Name of an export file of a day (YYYY-MM-DD)."""
    return f"{project}-visible-{day}-{'complete' if complete else 'filtered'}.csv"
