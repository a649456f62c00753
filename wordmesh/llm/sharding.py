"""Operator 10: sharding by fixed virtual slots.

A record's key is hashed into one of a fixed number of slots (4,096 by default); bytes are summed per slot in one
partial aggregation, whose result has at most as many rows as there are slots whatever the input. A versioned
slot-to-shard map, kept as a small Parquet table, says where slots live. Rebalancing edits the map: only slots that
overflow their shard move, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wordmesh.llm.common import col, id_types, new_path, with_rows

N_SLOTS = 4096
N_SHARDS = 64
TOLERANCE = 0.02
MAP_SCHEMA = "version int, slot int, shard int"


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text, modulo ``n_slots``; a null key hashes as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n_slots)).cast("int")


def initial_map(spark: SparkSession, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1: slots dealt to shards in turn."""
    return spark.range(n_slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("slot"), (F.col("id") % n_shards).cast("int").alias("shard")
    )


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """Records and UTF-8 bytes per slot; a null text counts a record of 0 bytes, an empty slot has no row."""
    size = F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint")
    return (
        docs.select(slot_of(col(key), n_slots).alias("slot"), size.alias("size"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"))
    )


def rebalance(slot_map: DataFrame, sizes: DataFrame, tolerance: float = TOLERANCE, n_shards: int = N_SHARDS) -> DataFrame:
    """The next version of a map (one version of it) for shards 0 to n_shards - 1, edited so that overfull shards give slots away.

    In each shard slots are taken in the order of bytes, then number; those with which the running sum passes
    ``(1 + tolerance) * mean`` leave, as do all slots of a shard that is no more. The free room of the shards up to the mean, that of new and
    empty ones among them, laid end to end in the order of shards, receives the leaving slots, laid end to end in the order of slot numbers
    and scaled to fit, so a shard passes its cap by one slot at most. Ties go by slot number. Slots of no bytes only leave shards that are
    no more, and where there is no room to be scaled to, slots are dealt in turn. With no bytes at all nothing else moves; an empty map gives
    an empty map. The map's size is fixed by the number of slots, so its windows run over a few thousand rows.
    """
    base = slot_map.join(sizes, "slot", "left").select("version", "slot", "shard", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"))
    total = base.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    base = base.crossJoin(F.broadcast(total))
    cap = F.floor(F.col("total") * (1 + tolerance) / n_shards)
    mean = F.floor(F.col("total") / n_shards)
    run = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", "slot").rowsBetween(W.unboundedPreceding, 0))
    cut = base.withColumn("leaves", ((run > cap) & (F.col("bytes") > 0)) | (F.col("shard") >= n_shards))
    stays = cut.filter(~F.col("leaves")).groupBy("shard").agg(F.sum("bytes").alias("kept"))
    shards = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(stays, "shard", "left").crossJoin(F.broadcast(total))
    rooms = shards.select("shard", F.greatest(mean - F.coalesce("kept", F.lit(0)), F.lit(0)).cast("bigint").alias("room"))
    upto = F.sum("room").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    rooms = rooms.filter("room > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("room"))
    free = rooms.agg(F.max("hi").alias("free"))
    before = F.sum("bytes").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")
    moving = cut.filter("leaves").select("slot", "bytes", before.alias("at"))
    out = moving.agg(F.sum("bytes").alias("out"))
    placed = (
        moving.crossJoin(F.broadcast(out))
        .crossJoin(F.broadcast(free))
        .withColumn("mark", F.floor(F.try_divide(F.col("at").cast("double"), F.col("out")) * F.col("free")).cast("bigint"))
        .join(F.broadcast(rooms), (F.col("mark") >= F.col("lo")) & (F.col("mark") < F.col("hi")))
        .select("slot", F.col("shard").alias("target"))
    )
    dealt = F.when(F.col("shard") >= n_shards, F.pmod("slot", F.lit(n_shards))).otherwise(F.col("shard"))
    return slot_map.join(placed, "slot", "left").select(
        (F.col("version") + 1).cast("int").alias("version"), "slot", F.coalesce("target", dealt).cast("int").alias("shard")
    )


def save_version(slot_map: DataFrame, path: str) -> int:
    """Stores one version of a map as a folder of its own and returns its number; earlier versions stay readable.

    Of two writers of one version the second fails: a version is claimed by a file that can be created once. A map of no rows,
    or of several versions, is refused.
    """
    spark = slot_map.sparkSession
    versions = [r.version for r in slot_map.select("version").distinct().collect()]
    if len(versions) != 1:
        raise ValueError(f"a stored map is of one version, not of {len(versions)}")
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{versions[0]}")
    if not claim.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(claim):
        raise ValueError(f"version {versions[0]} of this map was stored before")
    slot_map.select("slot", "shard").coalesce(1).write.parquet(f"{path}/version={versions[0]}")
    return versions[0]


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest by default. A version that isn't stored has no rows; a path without any raises."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version).select("version", "slot", "shard")


def assign(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """(row, slot, shard, version) of each row, ``row`` being the caller's own. The map has a fixed number of rows, so it is broadcast."""
    return with_rows(docs, slot=slot_of(col(key), n_slots)).join(F.broadcast(slot_map), "slot", "left").select("row", "slot", "shard", "version")


def place(docs: DataFrame, n_slots: int = N_SLOTS, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE, key: str = "doc_id", text: str = "text", maps: str | None = None) -> DataFrame:
    """Each record with its slot, its shard in the stored map before and in the rebalanced one, which is stored as the next version.

    ``maps`` is the folder of the stored map; where it is not given, a new one is begun below the shared folder with slots dealt in turn.
    Nulls: a null key goes to the slot of '', a null text weighs 0 bytes. Equal keys share a slot, repeated rows each count; very long
    texts are only more bytes. An empty table gives no rows and a next version like the one before. Only the two named columns are read, so others'
    names don't matter.
    """
    spark = docs.sparkSession
    if maps is None:
        maps = new_path(spark, "slotmap")
        save_version(initial_map(spark, n_slots, n_shards), maps)
    before = load_version(spark, maps)
    save_version(rebalance(before, slot_bytes(docs, key, text, n_slots), tolerance, n_shards), maps)
    after = load_version(spark, maps)
    both = after.join(before.select("slot", F.col("shard").alias("old")), "slot")
    own = docs.select(col(key).cast(id_types(docs, key)[0]).alias("doc_id"), slot_of(col(key), n_slots).alias("slot"), F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("bigint").alias("bytes"))
    return own.join(F.broadcast(both), "slot", "left").select("doc_id", "slot", F.col("old").alias("shard_v1"), F.col("shard").alias("shard_v2"), "bytes")


PLACE_SQL = f"""
WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {N_SLOTS} AS slot,
                  coalesce(octet_length(encode(text)), 0) AS bytes FROM documents),
s AS (SELECT slot, sum(bytes)::BIGINT AS bytes FROM d GROUP BY slot),
m AS (SELECT r.range AS slot, r.range % {N_SHARDS} AS shard, coalesce(s.bytes, 0) AS bytes
      FROM range({N_SLOTS}) r LEFT JOIN s ON s.slot = r.range),
t AS (SELECT sum(bytes)::BIGINT AS total FROM m),
c AS (SELECT m.*, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes, slot ROWS UNBOUNDED PRECEDING) > floor(total * {1 + TOLERANCE}::DOUBLE / {N_SHARDS})
             AND bytes > 0 AS leaves FROM m, t),
k AS (SELECT shard, sum(CASE WHEN leaves THEN 0 ELSE bytes END)::BIGINT AS kept FROM c GROUP BY shard),
f AS (SELECT shard, greatest(CAST(floor(total / {N_SHARDS}) AS BIGINT) - kept, 0) AS room FROM k, t),
g AS (SELECT shard, sum(room) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING)::BIGINT AS hi, room FROM f WHERE room > 0),
o AS (SELECT slot, bytes, sum(bytes) OVER (ORDER BY slot ROWS UNBOUNDED PRECEDING)::BIGINT - bytes AS "at" FROM c WHERE leaves),
p AS (SELECT slot, CAST(floor(CAST("at" AS DOUBLE) / (SELECT sum(bytes) FROM o)::DOUBLE * (SELECT max(hi) FROM g)) AS BIGINT) AS mark FROM o),
v AS (SELECT p.slot, g.shard FROM p JOIN g ON p.mark >= g.hi - g.room AND p.mark < g.hi)
SELECT d.doc_id, CAST(d.slot AS INTEGER) AS slot, CAST(d.slot % {N_SHARDS} AS INTEGER) AS shard_v1,
       CAST(coalesce(v.shard, d.slot % {N_SHARDS}) AS INTEGER) AS shard_v2, CAST(d.bytes AS BIGINT) AS bytes
FROM d LEFT JOIN v ON v.slot = d.slot
"""
