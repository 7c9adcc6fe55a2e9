"""Sharding over fixed virtual slots and a versioned slot-to-shard map (operator 4)."""

from __future__ import annotations

import bisect
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.session import checkpoint_dir, cut

#: Virtual slots; a slot's number never depends on the number of shards.
SLOTS = 4096
#: Rows of a slot are numbered in so many parts, so that no task has to hold a whole slot.
PARTS = 16

MAP = "version int, slot int, shard int, bytes bigint"


def first_map(bytes_per_slot: list[int], shards: int) -> pd.DataFrame:
    """Version 0: slots dealt in turn."""
    n = len(bytes_per_slot)
    return pd.DataFrame({"version": 0, "slot": range(n), "shard": [s % shards for s in range(n)], "bytes": bytes_per_slot})


def rebalanced(current: pd.DataFrame, bytes_per_slot: list[int], shards: int) -> pd.DataFrame:
    """The next version: slots move one by one from the fullest to the emptiest shard while that evens them out.

    Slots that stay keep their shard. A move takes the slot whose bytes come nearest to half of the difference;
    when no slot of the fullest shard is smaller than the difference, the map is done. The map has as many rows as there are slots, whatever the data.
    """
    shard_of = list(current["shard"])
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            held[shard].append((bytes_per_slot[slot], slot))
    load = [sum(b for b, _ in h) for h in held]
    for h in held:
        h.sort()
    for slot, shard in enumerate(shard_of):  # shards that are gone
        if shard >= shards:
            _move(held, load, shard_of, (bytes_per_slot[slot], slot), None, load.index(min(load)))
    while True:
        full, empty = load.index(max(load)), load.index(min(load))
        gap = load[full] - load[empty]
        at = bisect.bisect_left(held[full], (gap / 2, -1))
        near = [x for x in held[full][max(0, at - 1) : at + 1] if 0 < x[0] < gap]
        if not near:
            break
        _move(held, load, shard_of, min(near, key=lambda x: abs(x[0] - gap / 2)), full, empty)
    return pd.DataFrame({"version": int(current["version"].iloc[0]) + 1, "slot": range(len(shard_of)), "shard": shard_of, "bytes": bytes_per_slot})


def _move(held, load, shard_of, item, source, target) -> None:
    if source is not None:
        del held[source][bisect.bisect_left(held[source], item)]
        load[source] -= item[0]
    bisect.insort(held[target], item)
    load[target] += item[0]
    shard_of[item[1]] = target


def save_map(spark: SparkSession, slot_map: pd.DataFrame, place: str) -> DataFrame:
    """Appends a version to the map kept at ``place``."""
    rows = spark.createDataFrame(slot_map, MAP)
    rows.coalesce(1).write.mode("append").partitionBy("version").parquet(place)
    return rows


def load_map(spark: SparkSession, place: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    every = spark.read.parquet(place)
    newest = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == newest)


def text_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 8


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS, place: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version)`` of every row of ``docs(doc_id, text)``.

    Law ``bytes``: a row's virtual slot is a hash of its text, so equal texts share a shard; bytes add up per slot, and
    the map of slots to shards starts from the newest version at ``place`` (or a first one, dealt in turn) and is edited
    until shards are even. Groups of equal texts above half of a shard's share, of which there are at most twice as many as shards, are
    spread over the slots by ``doc_id`` instead. ``slot`` numbers the rows of a shard from 0 without gaps: by virtual slot,
    text and ``doc_id``. ``grown_shard`` is null under this law.

    Null text counts as empty (8 bytes, checksum 0); rows with equal or null ``doc_id`` are rows of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"))
    records = cut(records)
    total = records.agg(F.sum("size")).first()[0] or 0
    heavy = records.groupBy("_group").agg(F.sum("size").alias("_bytes")).where(F.col("_bytes") > total / (2 * shards)).select(F.col("_group").alias("_heavy"))
    # at most 2 * shards groups can each hold more than 1 / (2 * shards) of all bytes
    dealt = records.join(F.broadcast(heavy), F.col("_group") == F.col("_heavy"), "left")
    own = F.xxhash64("doc_id", "_group")
    key = F.when(F.col("_heavy").isNull(), F.xxhash64("_group", F.lit("slot"))).otherwise(own)
    dealt = dealt.select("doc_id", "size", "text_crc32", "_group", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(own, F.lit(PARTS)).cast("int").alias("_part"))
    parts = cut(dealt.groupBy("virtual_slot", "_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("_n")))
    per_slot = [0] * slots
    for slot, held in parts.groupBy("virtual_slot").agg(F.sum("bytes")).collect():  # one row a slot
        per_slot[slot] = held
    place = place or f"{checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    before = _newest(spark, place)
    if before is None:
        before = first_map(per_slot, shards)
        save_map(spark, before, place)
    after = rebalanced(before, per_slot, shards)
    slot_map = save_map(spark, after, place).select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(F.broadcast(slot_map), "virtual_slot").withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    starts = starts.select("virtual_slot", "_part", "shard", "map_version", "_start")
    inside = Window.partitionBy("virtual_slot", "_part").orderBy("_group", "doc_id")
    numbered = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["virtual_slot", "_part"])  # slots * parts rows
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_r")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def _newest(spark: SparkSession, place: str) -> pd.DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return load_map(spark, place).orderBy("slot").toPandas()
