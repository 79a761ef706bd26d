"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots (thousands, far more than shards). Bytes are added
up per slot, and a versioned map says which shard holds each slot. Rebalancing edits the map and
moves whole slots; no record is hashed anew. The map has one row per slot, so its size is fixed by
the ``slots`` parameter and it can be planned on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

SLOTS = 4096
MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("slot_id", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
    ]
)


def record_hash(key: Column, text: Column) -> Column:
    """Hash of a record: of its key and its text, so that neither a key nor a text that many
    records share makes a slot large. NULL counts like an empty string."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def slot_of(record: Column, copy: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record by its hash. ``copy`` tells equal records apart; 0 where there is one."""
    return F.pmod(F.xxhash64(record, copy), F.lit(slots)).cast("int")


def publish_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version of the map to ``folder``, which keeps all versions."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The map of a version, or the latest one."""
    known = spark.read.parquet(folder.rstrip("/"))
    if version is None:
        version = known.agg(F.max("version")).first()[0]
    return known.where(F.col("version") == version).select([F.col(f.name).cast(f.dataType) for f in MAP_SCHEMA])


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot from ``sized(slot_id, size)``; one number per slot reaches the driver."""
    found = sized.groupBy("slot_id").agg(F.sum("size").alias("bytes")).collect()
    total = [0] * slots
    for row in found:
        total[row["slot_id"]] = row["bytes"]
    return total


def first_map(spark: SparkSession, size_of: list[int], shards: int) -> DataFrame:
    """Version 1: the largest slots first, each to the shard with the fewest bytes so far; ties go
    to the smaller shard number and the smaller slot number, so the map is a function of its input."""
    loads = [(0, s) for s in range(shards)]
    rows = []
    for slot in sorted(range(len(size_of)), key=lambda k: (-size_of[k], k)):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + size_of[slot], shard))
        rows.append((1, slot, shard, size_of[slot]))
    return spark.createDataFrame(sorted(rows), MAP_SCHEMA)


def rebalance(slot_map: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version for ``shards`` shards: slots move only out of shards above the mean share
    (or no longer present), into the shard with the fewest bytes, until every shard is within
    ``tolerance`` of the mean or no move helps. All other slots stay where they are."""
    rows = sorted((r["slot_id"], r["shard"], r["bytes"]) for r in slot_map.collect())
    version = slot_map.agg(F.max("version")).first()[0] + 1
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    load = dict.fromkeys(range(shards), 0)
    homeless = []
    for slot, shard, size in rows:
        if shard < shards:
            held[shard].append((size, slot))
            load[shard] += size
        else:
            homeless.append((size, slot))
    mean = sum(r[2] for r in rows) / shards
    for size, slot in sorted(homeless, reverse=True):
        target = min(load, key=lambda s: (load[s], s))
        held[target].append((size, slot))
        load[target] += size
    for parts in held.values():
        parts.sort()
    while True:
        full, free = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[full] - load[free]
        if load[full] <= mean * (1 + tolerance):
            break
        fitting = [p for p in held[full] if 0 < p[0] < gap]  # any of these narrows the gap
        if not fitting:
            break
        part = min(fitting, key=lambda p: (abs(2 * p[0] - gap), p[1]))
        held[full].remove(part)
        held[free].append(part)
        load[full] -= part[0]
        load[free] += part[0]
    made = [(version, slot, shard, size) for shard, parts in held.items() for size, slot in parts]
    return slot_map.sparkSession.createDataFrame(sorted(made), MAP_SCHEMA)


def shard_records(records: DataFrame, key: str, text: str, shards: int, slots: int = SLOTS, salts: int = 16):
    """Place records in shards of nearly equal bytes.

    Returns ``(placed, slot_map)``. ``placed`` keeps one narrow row per record: the key,
    ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``slot_id`` (virtual slot),
    ``shard`` and ``place`` (gapless from 0 within the shard). Key and text of a record decide its
    slot, so records that share one of them spread; records equal in both are numbered, and spread too.

    NULL text has size 1 and the checksum of the empty text; NULL keys count as empty strings;
    repeated rows are all placed; an empty table gives no rows and an empty-slot map.
    Columns other than key and text are ignored, whatever their names.

    The numbering never sorts a shard in one task: rows are numbered within (slot, salt), the salt
    being drawn once and staged, and the starts of these groups come from their counts.
    """
    spark = records.sparkSession
    body = F.coalesce(records[text], F.lit(""))
    sized = records.select(
        records[key].alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        record_hash(records[key], records[text]).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    sized = stage(sized)
    # only records that have equals need to know which one of them they are
    repeated = stage(sized.groupBy("_hash").count().where("count > 1").select("_hash", F.lit(True).alias("_many")))
    copy = F.when(F.col("_many"), F.col("_row")).otherwise(F.lit(0).cast("long"))
    sized = sized.join(repeated, "_hash", "left").select(
        "_key", "size", "text_crc32", slot_of(F.col("_hash"), copy, slots).alias("slot_id"),
        F.pmod("_row", F.lit(salts)).cast("int").alias("salt"),
    )
    sized = stage(sized)
    slot_map = stage(first_map(spark, slot_bytes(sized, slots), shards))
    homes = F.broadcast(slot_map.select("slot_id", "shard"))  # one row per slot: a fixed size
    counts = sized.groupBy("slot_id", "salt").agg(F.count("*").alias("n")).join(homes, "slot_id")
    before = Window.partitionBy("shard").orderBy("slot_id", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        counts.select("slot_id", "salt", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("slot_id", "salt").orderBy("_key", "text_crc32", "size")
    numbered = sized.withColumn("rank", F.row_number().over(within))
    placed = numbered.join(starts, ["slot_id", "salt"]).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        "slot_id",
        "shard",
        (F.col("start") + F.col("rank") - 1).alias("place"),
    )
    return placed, slot_map
