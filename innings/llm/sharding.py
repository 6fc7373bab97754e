"""Sharding over fixed virtual slots, with DataFrame operations only.

A record belongs to one of thousands of slots by a hash of its id, for good.
Bytes are summed per slot, and a slot-to-shard map, stored with a version,
says which shard holds a slot. Rebalancing edits the map: it moves the fewest
bytes from full shards to those below the mean, or to new shards.

Each shard's positions are dealt without ordering a shard in one task: rows
are counted per slot, running sums over the slots of a shard give each slot
its first position, and a window inside a slot adds the rest.

Defined results: a null text has no bytes of its own; a null id hashes like
any other value; rows with equal ids lie in one slot, ordered by size and
checksum; an empty table gives no rows. A single record larger than a shard's
share stays whole.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innings.llm.tables import stored
from innings.session import new_folder
from innings.sources.tables import read_current, write_version

#: Virtual slots; the map and the sums per slot have this many rows whatever the data.
SLOTS = 8192


def slotted(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(n_slots)).cast("int").alias("vslot"))


def slot_bytes(rows: DataFrame) -> list[int]:
    """Bytes per slot: at most one number per slot comes to the driver."""
    got = {r["vslot"]: r["bytes"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}
    return [got.get(s, 0) for s in range(max(got, default=-1) + 1)]


def even_map(sizes: list[int], n_shards: int, n_slots: int = SLOTS) -> list[int]:
    """A first map: the largest slot left goes to the shard with the fewest bytes (then fewest slots)."""
    sizes = sizes + [0] * (n_slots - len(sizes))
    heap = [(0, 0, shard) for shard in range(n_shards)]
    held = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-sizes[s], s)):
        total, count, shard = heapq.heappop(heap)
        held[slot] = shard
        heapq.heappush(heap, (total + sizes[slot], count + 1, shard))
    return held


def rebalanced(held: list[int], sizes: list[int], n_shards: int) -> list[int]:
    """The map edited for new sizes or another number of shards: slots leave the fullest shard only while that lowers
    the spread; those of shards that are no more go to the emptiest ones, the largest first."""
    sizes = sizes + [0] * (len(held) - len(sizes))
    held, totals, mine = list(held), [0] * n_shards, [[] for _ in range(n_shards)]
    for slot in sorted(range(len(held)), key=lambda s: (held[s] >= n_shards, -sizes[s], s)):
        if held[slot] >= n_shards:
            held[slot] = min(range(n_shards), key=lambda k: (totals[k], len(mine[k])))
        totals[held[slot]] += sizes[slot]
        mine[held[slot]].append((sizes[slot], slot))
    for own in mine:
        own.sort()
    for _ in range(len(held)):
        full, empty = max(range(n_shards), key=totals.__getitem__), min(range(n_shards), key=totals.__getitem__)
        gap = totals[full] - totals[empty]
        movable = [x for x in mine[full] if 0 < x[0] < gap]
        if not movable:
            break
        best = min(movable, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        mine[full].remove(best)
        mine[empty].append(best)
        totals[full] -= best[0]
        totals[empty] += best[0]
        held[best[1]] = empty
    return held


def store_map(spark: SparkSession, held: list[int], root: str) -> DataFrame:
    """Writes the next version of the map (``vslot, shard``) below ``root`` and returns it as stored.

    Its number is claimed by one writer, and no version is ever overwritten.
    """
    frame = spark.range(len(held)).select(
        F.col("id").cast("int").alias("vslot"), F.element_at(F.lit(held), F.col("id").cast("int") + 1).alias("shard"))
    return spark.read.schema("vslot int, shard int").parquet(write_version(frame.coalesce(1), root))


def load_map(spark: SparkSession, root: str) -> list[int] | None:
    """The last version of the map below ``root``, a number per slot; None if there is none."""
    stored_map = read_current(spark, root)
    return None if stored_map is None else [r["shard"] for r in sorted(stored_map.collect(), key=lambda r: r["vslot"])]


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the position in the shard, gapless from 0."""
    per = rows.groupBy("vslot").agg(F.count("*").alias("n")).join(F.broadcast(slot_map), "vslot")
    upto = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("vslot", "shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    # Both sides have at most one row per slot or are keyed by it; the map's side is bounded by the slots.
    return rows.withColumn("n", F.row_number().over(inside)).join(F.broadcast(first), "vslot").select(
        *rows.columns, "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, n_shards: int = 24, n_slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot`` of every document.

    The law is ``bytes``: the map is dealt by bytes per slot, so shards have
    nearly equal sizes; ``grown_shard`` is null under it. With ``maps``, a folder
    that lasts, the last map there is edited for the new sizes and stored as the
    next version, so most records stay where they are; a map of another number
    of slots is an error. Without, every run deals its own.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, n_slots), "shard-rows")
    sizes, held = slot_bytes(rows), load_map(spark, maps) if maps else None
    if held is not None and len(held) != n_slots:
        raise ValueError(f"the stored map has {len(held)} slots, not {n_slots}")
    edited = even_map(sizes, n_shards, n_slots) if held is None else rebalanced(held, sizes, n_shards)
    slot_map = store_map(spark, edited, maps or new_folder(spark, "slot-map"))
    return placed(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")
