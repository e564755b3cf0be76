"""Whole paths made of the operators: flushing the log, reading back, and the life of volumes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.functions import codecs
from blockprism.functions import scalars as S
from blockprism.operators import blockmap as B
from blockprism.operators import dedup, gc, readpath, space, writelog
from blockprism.schemas import BLOCK

PHYSICAL = dedup.PHYSICAL


@dataclass(frozen=True)
class Store:
    """All tables of a store; each step gives a new one."""

    volumes: DataFrame
    blockmap: DataFrame
    refcount: DataFrame
    index: DataFrame
    reverse: DataFrame
    #: What units consist of on disk: ``READ_UNIT`` and ``data``.
    units: DataFrame


def flush(store: Store, log: DataFrame, first_pba: int, code: int = 2, zone_size: int | None = None) -> tuple[Store, DataFrame]:
    """Log entries with payload brought into the store; with it the extents that became free.

    Stale entries are dropped, the last write of a block wins, blocks that are
    stored already are referred to, equal new ones are stored once (for the first
    of them), the others are coalesced, compressed and packed into slots, one lane a
    volume.  New blocks are taken from ``first_pba`` on.
    """
    fresh = writelog.mark_stale(log, store.volumes, zero_is_wildcard=True).filter("not stale")
    blocks = writelog.exploded(fresh).withColumn("block", S.block_slice("payload", "index")).select("vol_id", "lba", "seq", "block")
    current = writelog.latest(blocks).withColumn("hash", F.unhex(S.content_hash("block")))
    live = dedup.live_entries(store.index, store.refcount, store.reverse)
    missed = dedup.misses(current, live)
    owners = missed.groupBy("hash").agg(F.min(F.struct("seq", "vol_id", "lba", "block")).alias("o")).select("hash", "o.*")

    units = _packed(writelog.coalesce(owners.select("vol_id", "lba", "seq"), zone_size=zone_size), owners, first_pba, code)
    inside = units.select("vol_id", F.explode(F.expr("sequence(start_lba, start_lba + lba_count - 1)")).alias("lba"), "start_lba", *(c for c in PHYSICAL if c != "offset_in_unit"))
    stored = owners.select("vol_id", "lba", "hash", "seq").join(inside.withColumn("offset_in_unit", (F.col("lba") - F.col("start_lba")).cast("int")), ["vol_id", "lba"]).select("hash", "seq", *PHYSICAL)
    where = live.select("hash", *PHYSICAL).unionByName(stored.select("hash", *PHYSICAL))
    batch = current.select("vol_id", "lba", "hash").join(where, "hash").withColumn("flags", F.lit(0).cast("tinyint"))

    columns = store.blockmap.columns
    blockmap, counts, freed = B.write_batch(store.blockmap, store.refcount, _typed(batch, store.blockmap).select(*columns))
    index, reverse = dedup.put_entries(store.index, store.reverse, _typed(stored, store.index))
    data = store.units.unionByName(units.select("pba", "slot_offset", "unit_compressed_size", "data"))
    after = replace(store, blockmap=blockmap, refcount=counts, index=index, reverse=reverse, units=data)
    return cleaned(after, freed), freed


def _typed(rows: DataFrame, like: DataFrame) -> DataFrame:
    kinds = dict(like.dtypes)
    return rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns))


def _packed(units: DataFrame, owners: DataFrame, first_pba: int, code: int) -> DataFrame:
    """Units compressed, and where they lie."""
    members = units.select("vol_id", "start_lba", "lba_count", F.explode(F.expr("sequence(start_lba, start_lba + lba_count - 1)")).alias("lba"))
    joined = members.join(owners.select("vol_id", "lba", "block"), ["vol_id", "lba"]).groupBy("vol_id", "start_lba", "lba_count").agg(F.array_sort(F.collect_list(F.struct("lba", F.hex("block").alias("block")))).alias("b"))
    raw = joined.withColumn("payload", F.unhex(F.array_join(F.transform("b", lambda x: x["block"]), ""))).drop("b")
    done = raw.withColumn("c", codecs.compressed(F.col("payload"), F.lit(code))).select("vol_id", "start_lba", "lba_count", F.octet_length("payload").alias("unit_original_size"), F.col("c.code").alias("compression"), F.col("c.data").alias("data"), F.octet_length("c.data").alias("unit_compressed_size"))
    slots = space.pack(done.select(F.col("vol_id").alias("lane"), F.col("start_lba").alias("order_key"), F.col("unit_compressed_size").cast("bigint").alias("size")))
    own = Window.partitionBy("lane").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("slot") < 0, S.blocks("size")).when(F.col("slot_offset") == 0, 1).otherwise(0).cast("bigint")
    numbered = slots.withColumn("n", opens).withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    # A fragment that shares a slot lies where the slot was opened.
    opened = F.max(F.when((F.col("slot") >= 0) & (F.col("slot_offset") == 0), F.col("before"))).over(Window.partitionBy("lane", "slot"))
    placed = numbered.withColumn("at", F.when(F.col("slot") < 0, F.col("before")).otherwise(opened))
    totals = numbered.groupBy("lane").agg(F.sum("n").alias("blocks"))
    lanes = totals.withColumn("base", F.coalesce(F.sum("blocks").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first_pba).select("lane", "base")  # a row per volume
    found = placed.join(lanes, "lane").select(F.col("lane").alias("vol_id"), F.col("order_key").alias("start_lba"), (F.col("base") + F.col("at")).alias("pba"), F.col("slot_offset").cast("int").alias("slot_offset"))
    return done.join(found, ["vol_id", "start_lba"]).withColumn("crc32", F.crc32("data")).withColumn("unit_lba_count", F.col("lba_count").cast("int"))


def cleaned(store: Store, freed: DataFrame) -> Store:
    """Index rows of freed blocks taken out."""
    index, reverse = dedup.cleanup(store.index, store.reverse, freed.select(F.col("start_pba").alias("pba")))
    return replace(store, index=index.select(*store.index.columns), reverse=reverse)


def read(store: Store, requests: DataFrame, buffered: DataFrame) -> DataFrame:
    """Blocks for requests ``(pos, vol_id, lba)``: from the buffer ``(vol_id, lba, seq, block)``, else decoded, else zeros.

    A unit is decoded once, whatever the number of its blocks that are asked for.
    """
    physical = store.blockmap.select("vol_id", "lba", *PHYSICAL)
    tier = readpath.tiers(requests, buffered, store.blockmap).select("pos", "vol_id", "lba", "tier")
    mapped = tier.filter("tier = 'mapped'").join(physical, ["vol_id", "lba"])
    wanted = mapped.select(*(c for c in PHYSICAL if c != "offset_in_unit")).distinct()
    raw = wanted.join(store.units, ["pba", "slot_offset", "unit_compressed_size"])
    decoded = raw.withColumn("u", codecs.decoded_unit(F.col("data"), F.lit(0), F.col("unit_compressed_size"), F.col("unit_original_size"), F.col("compression"), F.col("crc32")))
    payloads = decoded.select("pba", "slot_offset", "unit_compressed_size", "u.status", "u.payload")
    blocks = readpath.decoded_blocks(payloads, mapped.select("pos", "pba", "slot_offset", "unit_compressed_size", "offset_in_unit"))
    from_buffer = tier.filter("tier = 'buffer'").join(buffered.select("vol_id", "lba", "block"), ["vol_id", "lba"]).select("pos", F.lit("ok").alias("status"), "block")
    zeros = tier.filter("tier = 'zero'").select("pos", F.lit("ok").alias("status"), F.unhex(F.repeat(F.lit("00"), BLOCK)).alias("block"))
    return blocks.select("pos", "status", "block").unionByName(from_buffer).unionByName(zeros)


def create_volumes(store: Store, new: DataFrame, last: int, now: int) -> Store:
    """New volumes ``(vol_id, size_bytes)`` with their generations; a name that is there is an error."""
    if new.join(store.volumes.select("vol_id"), "vol_id", "left_semi").count():
        raise ValueError("a volume of this name exists")
    made = writelog.next_generations(new, last, now)
    return replace(store, volumes=store.volumes.unionByName(made, allowMissingColumns=True))


def delete_volume(store: Store, log: DataFrame, vol_id: str) -> tuple[Store, DataFrame, DataFrame]:
    """Without a volume: the store, the log, and the extents that became free."""
    blockmap, counts, freed = B.without_range(store.blockmap, store.refcount, vol_id)
    after = replace(store, volumes=store.volumes.filter(F.col("vol_id") != vol_id), blockmap=blockmap, refcount=counts)
    return cleaned(after, freed), writelog.purge(log, vol_id), freed


def sweep_orphans(store: Store) -> tuple[Store, DataFrame]:
    """Without counts of blocks that nothing refers to; with it those blocks."""
    gone = B.orphans(store.refcount, store.blockmap)
    counts = store.refcount.join(gone.select("pba"), "pba", "left_anti").select("pba", "refcount")
    return replace(store, refcount=counts), gone


def rewrite_plan(store: Store, pending: DataFrame, totals: DataFrame, limit: int = 64) -> DataFrame:
    """What one cycle of garbage collection appends to the log again: references of the worst fragments that still hold."""
    return gc.revalidated(gc.banded(store.blockmap, totals, limit=limit), store.blockmap, pending)
