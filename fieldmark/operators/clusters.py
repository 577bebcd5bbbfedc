"""Marker clusters over zoom levels, from near to far.

At each level the clusters of the level below are taken in order: one joins the
nearest cluster before it within the radius, or else opens a cluster, which stays
where its first marker stands.  That is what taking them one after the other
gives, found in rounds instead: of the markers not yet placed, the first of each
small cell is a candidate; one that no earlier marker within the radius precedes
opens a cluster, and what lies within its radius behind it is placed.  Cells are
so small that all of a cell is within the radius of each other, so a marker meets
at most a candidate for each of the 25 cells around it, however dense a place is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import staged

#: Side of a cell as a share of the radius, less than the root of one half; cells to look at on each side.
SIDE, AROUND = 0.7, 2


def pixel(lat: Column, lng: Column, zoom: int) -> list[Column]:
    """Place on the Web-Mercator map of a zoom, as x and y; latitudes end at its edge."""
    world = 256 * 2**zoom
    sine = F.sin(F.radians(F.greatest(F.lit(-85.0511287798), F.least(F.lit(85.0511287798), lat))))
    return [((lng + 180) / 360 * world).alias("x"), ((0.5 - F.ln((1 + sine) / (1 - sine)) / (4 * F.pi())) * world).alias("y")]


def _placed(points: DataFrame, zoom: int, radius: float) -> DataFrame:
    x, y = pixel(F.col("lat"), F.col("lng"), zoom)
    cell = lambda c: F.floor(F.col(c) / (radius * SIDE))
    return points.select("id", "_ord", x, y).withColumns({"cx": cell("x"), "cy": cell("y")})


def _around(points: DataFrame) -> DataFrame:
    """``points`` under each cell that may hold something within their radius."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-AROUND, AROUND + 1) for j in range(-AROUND, AROUND + 1)]))
    return points.withColumn("_d", steps).select(F.col("id").alias("lead"), F.col("_ord").alias("lead_ord"), F.col("x").alias("lx"), F.col("y").alias("ly"), (F.col("cx") + F.col("_d.i")).alias("cx"), (F.col("cy") + F.col("_d.j")).alias("cy"))


def _within(points: DataFrame, leads: DataFrame, radius: float) -> DataFrame:
    """id, _ord, lead, lead_ord and the squared way of points within the radius of a lead."""
    way = (F.col("x") - F.col("lx")) ** 2 + (F.col("y") - F.col("ly")) ** 2
    return points.join(_around(leads), ["cx", "cy"]).withColumn("way", way).where(F.col("way") <= radius * radius).select("id", "_ord", "lead", "lead_ord", "way")


def leaders(points: DataFrame, zoom: int, radius: float = 50) -> DataFrame:
    """id, lead for each of the points (id, _ord, lat, lng): the cluster's first point, which leads itself."""
    every = staged(_placed(points, zoom, radius), "markers")
    left, found = every, None
    while not left.isEmpty():
        first = left.groupBy("cx", "cy").agg(F.min_by(F.struct("id", "_ord", "x", "y"), F.struct("_ord", "id")).alias("p")).select("cx", "cy", "p.*")
        pairs = staged(_within(left, first, radius), "marker-pairs")
        before = F.struct("_ord", "id") < F.struct(F.col("lead_ord").alias("_ord"), F.col("lead").alias("id"))
        opened = staged(pairs.groupBy("lead").agg(F.bool_or(before).alias("late")).where("not late").select("lead"), "new-clusters")
        found = opened if found is None else found.union(opened)
        near = pairs.join(opened, "lead").select("id").distinct()
        left = staged(left.join(near, "id", "left_anti"), "markers-left")
    if found is None:
        return every.select("id", F.col("id").alias("lead"))
    heads = every.join(found.withColumnRenamed("lead", "id"), "id")
    behind = F.struct(F.col("lead_ord").alias("_ord"), F.col("lead").alias("id")) <= F.struct("_ord", "id")
    nearest = _within(every, heads, radius).where(behind).groupBy("id").agg(F.min(F.struct("way", "lead_ord", "lead")).alias("n"))
    return nearest.select("id", F.col("n.lead").alias("lead"))


def marker_clusters(markers: DataFrame, zooms: list[int], radius: float = 50, off: int = 10) -> DataFrame:
    """zoom, lead, n, lat and lng of the clusters of markers (id, _ord, lat, lng) at each of the ``zooms``.

    A cluster stands at the mean of its markers, ``n`` in number, one or more.
    From zoom ``off`` on each marker stands for itself.  Clusters of a zoom are
    made of those of the next one, down from ``off`` - 1.  Markers without a
    place are left out; ids are distinct.
    """
    points = markers.where("lat is not null and lng is not null").select("id", "_ord", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    level = points.select("*", F.lit(1).cast("long").alias("n"), F.col("lat").alias("sum_lat"), F.col("lng").alias("sum_lng"))
    shown = lambda df, z: df.select(F.lit(z).alias("zoom"), F.col("id").alias("lead"), "n", (F.col("sum_lat") / F.col("n")).alias("lat"), (F.col("sum_lng") / F.col("n")).alias("lng"))
    out = [shown(level, z) for z in zooms if z >= off]
    for zoom in range(off - 1, min([*zooms, off]) - 1, -1):
        joined = level.join(leaders(level, zoom, radius), "id")
        sums = joined.groupBy("lead").agg(*[F.sum(c).alias(c) for c in ("n", "sum_lat", "sum_lng")])
        level = staged(sums.withColumnRenamed("lead", "id").join(level.select("id", "_ord", "lat", "lng"), "id"), "clusters")
        if zoom in zooms:
            out.append(shown(level, zoom))
    found = out[0]
    for df in out[1:]:
        found = found.union(df)
    return found
