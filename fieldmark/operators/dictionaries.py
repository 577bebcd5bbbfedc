"""Dictionaries of texts: nested documents as rows of dotted keys, and lookups in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dotted_keys(documents: DataFrame) -> DataFrame:
    """locale, key, value and leaf for everything within the nested JSON documents (locale, json).

    Keys join the names (of arrays the places) on the way with dots; ``value`` is
    the text of a leaf and the JSON of what holds more, ``leaf`` tells them apart.
    Every level is one step over all documents, as many as the deepest has.  A
    text that is no JSON, or holds no object, gives no rows; of a repeated
    document each is told.
    """
    level = documents.select("locale", F.lit(None).cast("string").alias("key"), F.try_parse_json("json").alias("v")).where("v is not null")
    found = []
    while True:
        kind = F.schema_of_variant("v")
        path = lambda k: F.concat_ws(".", F.col("key"), k)
        objects = level.where(kind.startswith("OBJECT")).select("locale", "key", F.explode(F.expr("cast(v as map<string, variant>)")).alias("k", "v"))
        arrays = level.where(kind.startswith("ARRAY")).select("locale", "key", F.posexplode(F.expr("cast(v as array<variant>)")).alias("k", "v"))
        level = objects.union(arrays.withColumn("k", F.col("k").cast("string"))).select("locale", path(F.col("k")).alias("key"), "v")
        if level.isEmpty():
            break
        leaf = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        found.append(level.select("locale", "key", F.when(leaf, F.expr("cast(if(schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%', null, v) as string)")).otherwise(F.to_json("v")).alias("value"), leaf.alias("leaf")))
    none = documents.sparkSession.createDataFrame([], "locale string, key string, value string, leaf boolean")
    return reduce(lambda a, b: a.union(b), found, none)


def translated(df: DataFrame, key: str, dictionary: DataFrame, locale: str, fallback: str | None = None) -> DataFrame:
    """Adds ``text``, the value of a dotted key in a locale (or else in ``fallback``), the key itself where there is none, and ``known``."""
    wanted = [x for x in (locale, fallback) if x]
    rank = F.when(F.col("locale") == locale, 0).otherwise(1)
    words = dictionary.where(F.col("locale").isin(wanted)).groupBy(F.col("key").alias("_key")).agg(F.min_by("value", rank).alias("_value"))
    return df.join(words, F.col(key) == F.col("_key"), "left").withColumns({"text": F.coalesce("_value", F.col(key)), "known": F.col("_key").isNotNull()}).drop("_key", "_value")
