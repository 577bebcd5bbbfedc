"""Operator 2, sharding over fixed virtual slots (DataFrame functions only).

Records hash into ``n_slots`` virtual slots; bytes are summed per slot; a
versioned table maps slots to shards.  Balancing looks at the slots only, of
which there is a fixed number, so its cost does not depend on the data.

Defined results: a null text counts as empty (size 1), a null id hashes as
null, repeated rows are placed each for itself but share a slot, extra columns
are ignored, and an empty table gives an empty result.  Identical rows (same id
and text) are one key: should they hold more than a shard's share of all bytes,
that shard is as much larger as the key is.  Equal texts under several ids may
part: rows are keyed by id and text.  A map names every slot, also those that
held no row when it was made, so that later documents find a shard under it; a
row whose slot the map lacks fails the query.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, staged

N_SLOTS = 4096


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """One thin row per document: row, doc_id, size, text_crc32, virtual_slot."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_sizes(thin: DataFrame) -> DataFrame:
    return thin.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """A map of all slots: the largest slot first, each to the lightest shard; empty slots in turn.

    ``sizes`` has a row per slot, so the folded array is bounded by ``n_slots``.
    """
    lightest = "array_position(a.loads, array_min(a.loads)) - 1"
    fold = f"""aggregate(slots,
        named_struct('loads', array_repeat(0L, {n_shards}), 'out', cast(array() as array<struct<virtual_slot: int, shard: int>>)),
        (a, x) -> named_struct(
            'loads', transform(a.loads, (v, i) -> if(i = {lightest}, v + x.bytes, v)),
            'out', concat(a.out, array(named_struct('virtual_slot', x.virtual_slot, 'shard', cast({lightest} as int))))),
        a -> a.out)"""
    slots = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("slots"))
    held = slots.select(F.inline(F.expr(fold)))
    every = sizes.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    shard = F.coalesce("shard", F.pmod("virtual_slot", F.lit(n_shards)))
    return every.join(F.broadcast(held), "virtual_slot", "left").select(F.lit(1).alias("version"), "virtual_slot", shard.alias("shard"))  # n_slots rows at most


def grown_map(current: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The next version, with one shard more: slots move only into the new one.

    Each old shard hands over its smallest slots while what it has handed over
    stays within what it holds above the new mean.
    """
    now = current.join(sizes, "virtual_slot", "left").fillna(0, ["bytes", "rows"])
    held = Window.partitionBy("shard")
    order = held.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    target = now.agg((F.sum("bytes") / (n_shards + 1)).alias("target"))
    moved = F.sum("bytes").over(order) <= F.sum("bytes").over(held) - F.col("target")
    return now.crossJoin(F.broadcast(target)).select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.when(moved, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard")
    )


def latest_version(spark: SparkSession, path: str) -> int:
    """The latest version stored at ``path``, 0 if there is none."""
    try:
        found = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return found.agg(F.max("version")).first()[0] or 0


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map to its table as the version after the latest; older versions stay."""
    version = latest_version(slot_map.sparkSession, path) + 1
    slot_map.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default; only its own partition is read."""
    found = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = latest_version(spark, path)
    return found.where(F.col("version") == F.lit(version)).select("version", "virtual_slot", "shard")


def rebalance(docs: DataFrame, path: str, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds a shard to the stored map for the bytes that ``docs`` now hold, and returns the new version."""
    now = load_map(docs.sparkSession, path)
    n_shards = now.agg(F.coalesce(F.max("shard") + 1, F.lit(0))).first()[0]
    store_map(grown_map(now, slot_sizes(slotted(docs, n_slots)), n_shards), path)
    return load_map(docs.sparkSession, path)


def assign_shards(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None, first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, map): every document with its shard and its place in the shard, and the version of the map used.

    The map is made from the documents and stored at ``map_path`` (or in the
    scratch folder) as a new version; with ``first`` false the latest one stored
    there is used.

    A place is the row's number in its shard, from 0 without gaps.  Rows are
    numbered within their input partition and shard; a sum over the partitions
    before gives the start, so that no shard is ever gathered in one task.
    """
    thin = staged(slotted(docs, n_slots), "shard-rows")
    path = map_path or scratch_dir(docs.sparkSession, "slot-map")
    if first:
        store_map(first_map(slot_sizes(thin), n_shards, n_slots), path)
    slot_map = load_map(docs.sparkSession, path)
    placed = thin.join(F.broadcast(slot_map.drop("version")), "virtual_slot", "left").withColumn("part", F.shiftright("row", 33))  # n_slots rows
    placed = placed.withColumn("shard", F.coalesce("shard", F.raise_error(F.concat(F.lit("the map has no slot "), F.col("virtual_slot").cast("string"))).cast("int")))
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start")
    )
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    rows = placed.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
    return rows, slot_map
