"""Operator 6, sharding by fixed virtual slots (DataFrame functions only).

A row's doc_id is hashed into one of ``SLOTS`` virtual slots, which never change. Bytes are summed per slot; a
versioned table maps slots to shards. Version 1 deals the slots out in turn; each later version is an edit of the one
before that moves or swaps single slots until the shards' bytes are as near equal as whole slots allow, so rebalancing
moves few rows. The map has SLOTS rows for each version at any input size: only it and its byte sums reach the driver.

Law: ``bytes`` (shard sizes near equal). ``slot`` is the row's gapless position in its shard, ``virtual_slot`` the
hash slot. Positions are numbered within a virtual slot and shifted by the slots before it in the shard, so no task
sees a whole shard; hot sources and groups of copies have different doc_ids and spread over all slots.

Edge cases: null text has size 1 and checksum 0; rows without a doc_id go by a hash of their text; repeated rows stay, each with its own
position; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SLOTS = 4096


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a key."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n) of rows with virtual_slot and size; partial sums come before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def rebalance(current: dict[int, int], weight: dict[int, int], shards: int) -> dict[int, int]:
    """Edit a slot-to-shard map until no move or swap between the heaviest and lightest shard narrows their gap."""
    owner = dict(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in owner.items():
        held[shard].append((weight.get(slot, 0), slot))
    for h in held:
        h.sort()
    total = [sum(w for w, _ in h) for h in held]
    while True:
        heavy, light = max(range(shards), key=lambda s: (total[s], s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[heavy] - total[light]
        best = (gap, None, None)
        for give in held[heavy]:
            want = give[0] - gap / 2  # what the light shard should return for it
            at = bisect.bisect_left(held[light], (want, -1))
            for back in (None, *held[light][max(0, at - 1) : at + 1]):
                left = abs(gap - 2 * (give[0] - (back[0] if back else 0)))
                if left < best[0]:
                    best = (left, give, back)
        if best[1] is None:
            return owner
        for item, a, b in ((best[1], heavy, light), (best[2], light, heavy)):
            if item:
                held[a].remove(item)
                bisect.insort(held[b], item)
                owner[item[1]] = b
                total[a] -= item[0]
                total[b] += item[0]


def slot_map(spark: SparkSession, sums: DataFrame, shards: int, slots: int = SLOTS, kept: dict[int, int] | None = None, version: int = 1) -> DataFrame:
    """(version, virtual_slot, shard): ``kept`` (by default the slots dealt in turn) as ``version``, and the next one, edited to the byte sums. At most 2 * slots rows."""
    weight = {r["virtual_slot"]: r["bytes"] for r in sums.collect()}
    first = kept or {s: s % shards for s in range(slots)}
    second = rebalance(first, weight, shards)
    rows = [(v, s, m[s]) for v, m in ((version, first), (version + 1, second)) for s in range(slots)]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def edit_stored_map(spark: SparkSession, path: str, sums: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Read the newest version of the map stored at ``path``, edit it to the byte sums, store the next one beside it; gives that.

    Every version is a folder of its own and never written again, so what a version dealt out can be looked up later.
    The first call stores version 1, slots dealt in turn, and its edit. ``shards`` may be larger than before.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    version = max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)
    kept = {r["virtual_slot"]: r["shard"] for r in spark.read.parquet(f"{path}/version={version}").collect()} if version else None
    if kept is not None and len(kept) != slots:
        raise ValueError(f"the stored map has {len(kept)} slots, not {slots}")
    maps = slot_map(spark, sums, shards, slots, kept, max(version, 1))
    for v in range(version + 1, max(version, 1) + 2):
        maps.filter(F.col("version") == v).drop("version").coalesce(1).write.parquet(f"{path}/version={v}")
    return maps.filter(F.col("version") == max(version, 1) + 1)


def shard_documents(docs: DataFrame, shards: int = 8, stored: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with size, text_crc32, virtual_slot, shard and slot; the slot map).

    ``stored``: the folder of a map that earlier runs left and this one edits; else the map starts anew.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # rows without an id go by their text
    key = F.when(F.col("doc_id").isNull(), virtual_slot(F.col("h"))).otherwise(virtual_slot(F.col("doc_id")))
    rows = staged(slim.select("doc_id", "size", "text_crc32", key.alias("virtual_slot")), "shard-rows")
    sums = staged(slot_bytes(rows), "slot-bytes")
    maps = edit_stored_map(spark, stored, sums, shards) if stored else slot_map(spark, sums, shards)
    maps = staged(maps, "slot-map")
    latest = maps.filter(F.col("version") == maps.agg(F.max("version")).first()[0])
    # SLOTS rows at most: the base of each slot's positions within its shard
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = latest.join(sums, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("within", within).join(F.broadcast(bases), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("within") - 1).alias("slot")), maps


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents over shards 0 to 7 by bytes."""
    rows, _ = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
