"""The write log: which write is current, how blocks coalesce, what is superseded, reclaimable or left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.functions import scalars as S
from blockprism.schemas import BLOCK, MAX_ENTRY_BYTES, MAX_UNIT_BYTES, MAX_UNIT_LBAS

KEY = ["vol_id", "lba"]


def exploded(log: DataFrame) -> DataFrame:
    """A row per block of each entry: column ``lba``, and ``index`` of the block in its entry."""
    at = F.explode(F.sequence(F.lit(0), F.col("lba_count").cast("int") - 1))
    return log.filter("lba_count > 0").withColumn("index", at).withColumn("lba", F.col("start_lba") + F.col("index"))


def valid_entries(log: DataFrame) -> DataFrame:
    """Entries that may be appended: a volume id of 1 to 255 bytes, and a payload of its blocks' size."""
    size = F.octet_length("payload")
    name = F.octet_length("vol_id")
    return log.filter(name.between(1, 255) & (F.col("lba_count") > 0) & (size == F.col("lba_count") * BLOCK) & (size <= MAX_ENTRY_BYTES))


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    return log.unionByName(valid_entries(entries), allowMissingColumns=True)


def latest(writes: DataFrame, with_seqs: bool = False) -> DataFrame:
    """The current write of each block: that of the highest ``seq``; with ``with_seqs`` also all seqs, ascending.

    The maximum is combined before the shuffle, so a block that is written over and
    over costs no more than any other.
    """
    rest = [c for c in writes.columns if c not in (*KEY, "seq")]
    out = writes.groupBy(*KEY).agg(F.max(F.struct("seq", *rest)).alias("w"), *([F.array_sort(F.collect_set("seq")).alias("seqs")] if with_seqs else []))
    return out.select(*KEY, "w.*", *(["seqs"] if with_seqs else []))


def islands(rows: DataFrame, by: list[str], at: str, name: str = "island") -> DataFrame:
    """Numbers the runs of consecutive values of ``at`` within ``by``; ``at`` does not repeat there."""
    own = Window.partitionBy(*by).orderBy(at)
    return rows.withColumn(name, F.col(at) - F.row_number().over(own))


def coalesce(current: DataFrame, max_lbas: int = MAX_UNIT_LBAS, max_bytes: int = MAX_UNIT_BYTES, zone_size: int | None = None) -> DataFrame:
    """Units ``(vol_id, start_lba, lba_count, max_seq)`` of consecutive current blocks, cut at the caps.

    A run is cut only by a gap or a cap, so cutting it at multiples of the cap is
    what a greedy walk does.  ``zone_size`` splits runs at zone ends also, which
    lets volumes of any length be worked on zone by zone.
    """
    cap = max(1, min(max_lbas, max_bytes // BLOCK))
    by = ["vol_id"]
    if zone_size:
        current, by = current.withColumn("zone", S.idiv("lba", zone_size)), ["vol_id", "zone"]
    runs = islands(current, by, "lba")
    place = F.row_number().over(Window.partitionBy(*by, "island").orderBy("lba")) - 1
    return runs.withColumn("part", S.idiv(place, cap)).groupBy(*by, "island", "part").agg(F.min("lba").alias("start_lba"), F.count("*").alias("lba_count"), F.max("seq").alias("max_seq")).select("vol_id", "start_lba", "lba_count", "max_seq")


def seq_ranges(blocks: DataFrame) -> DataFrame:
    """Consecutive blocks of each write: ``(vol_id, seq, start_lba, lba_count)``."""
    return islands(blocks, ["vol_id", "seq"], "lba").groupBy("vol_id", "seq", "island").agg(F.min("lba").alias("start_lba"), F.count("*").alias("lba_count")).drop("island")


def covering_seq(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """For requested ``(vol_id, lba)`` the latest seq whose ranges cover it; null without one."""
    covered = exploded(ranges).select("vol_id", "lba", "seq").groupBy(*KEY).agg(F.max("seq").alias("seq"))
    return requests.join(covered, KEY, "left")


def superseded(blocks: DataFrame) -> DataFrame:
    """Blocks' writes that a later one replaced, with its seq ``by_seq``."""
    own = Window.partitionBy(*KEY).orderBy("seq")
    return blocks.withColumn("by_seq", F.lead("seq").over(own)).filter("by_seq is not null")


def superseded_ranges(blocks: DataFrame) -> DataFrame:
    """The ranges of each later write ``by_seq`` that took blocks from an earlier one."""
    return seq_ranges(superseded(blocks).select("vol_id", F.col("by_seq").alias("seq"), "lba"))


def stale_ranges(blocks: DataFrame) -> DataFrame:
    """After recovery: per write the ranges that are not current any more."""
    return seq_ranges(superseded(blocks).select("vol_id", "seq", "lba"))


def fully_superseded(blocks: DataFrame) -> DataFrame:
    """Seqs all of whose blocks a later write of the same generation (``vol_created_at``, if there) replaced."""
    key = [*KEY, *(["vol_created_at"] if "vol_created_at" in blocks.columns else [])]
    marked = blocks.withColumn("newer", F.col("seq") < F.max("seq").over(Window.partitionBy(*key)))
    return marked.groupBy("vol_id", "seq").agg(F.bool_and("newer").alias("dead"), F.count("*").alias("lba_count")).filter("dead").drop("dead")


def is_latest(blocks: DataFrame, current: DataFrame) -> DataFrame:
    """``blocks`` with ``is_latest``: it is the current write of its generation, or nothing is known of its block."""
    known = current.select(*KEY, F.col("seq").alias("now"), *([F.col("vol_created_at").alias("gen_now")] if "vol_created_at" in current.columns else []))
    joined = blocks.join(known, KEY, "left")
    same = F.col("now") == F.col("seq")
    if "gen_now" in known.columns and "vol_created_at" in blocks.columns:
        same &= F.col("gen_now") == F.col("vol_created_at")
    return joined.withColumn("is_latest", F.col("now").isNull() | same).drop("now", "gen_now")


def current_entry(log: DataFrame) -> DataFrame:
    """Of all shards' entries per block, the best by seq, then by generation."""
    rest = [c for c in log.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), F.struct("seq", "vol_created_at")).alias("best")
    return log.groupBy(*KEY).agg(best).select(*KEY, "best.*")


def mark_stale(log: DataFrame, volumes: DataFrame, zero_is_wildcard: bool = False) -> DataFrame:
    """``log`` with ``stale``: its volume is gone or has another generation."""
    now = volumes.select("vol_id", F.col("created_at").alias("current"))
    return log.join(now, "vol_id", "left").withColumn("stale", S.is_stale("vol_created_at", "current", zero_is_wildcard)).drop("current")


def purge(log: DataFrame, volume: str | None = None, seqs: DataFrame | None = None) -> DataFrame:
    """Without a volume's entries, or without those of some seqs."""
    if volume is not None:
        log = log.filter(F.col("vol_id") != volume)
    return log if seqs is None else log.join(seqs.select("seq"), "seq", "left_anti")


def evict(index: DataFrame, corrupt: DataFrame) -> DataFrame:
    """Index rows without those of corrupt entries, where the index still has that very seq."""
    return index.join(corrupt.select(*KEY, "seq"), [*KEY, "seq"], "left_anti")


def apply_discards(blocks: DataFrame, discards: DataFrame) -> DataFrame:
    """Current blocks that no later discard (``vol_id, seq, start, count``) covers; a discard is an event with a seq.

    The last discard of a block decides, so discards are reduced per block first.
    """
    dead = discards.filter("count > 0").select("vol_id", F.col("seq").alias("discarded"), F.explode(F.expr("sequence(start, start + count - 1)")).alias("lba")).groupBy(*KEY).agg(F.max("discarded").alias("discarded"))
    return blocks.join(dead, KEY, "left").filter("discarded is null or discarded < seq").drop("discarded")


def flush_progress(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Per entry ``flushed`` distinct blocks, ``remaining`` and ``done``, from marks ``(seq, start_lba, lba_count)``, which may repeat."""
    done = exploded(marks).groupBy("seq").agg(F.countDistinct("lba").alias("flushed"))
    joined = log.join(done, "seq", "left").withColumn("flushed", F.coalesce("flushed", F.lit(0)))
    return joined.withColumn("remaining", F.greatest(F.col("lba_count") - F.col("flushed"), F.lit(0)).cast("bigint")).withColumn("done", F.col("flushed") >= F.col("lba_count"))


def unfinished_units(units: DataFrame) -> DataFrame:
    """In-flight references per seq, from units' ``seq_lba_ranges``."""
    return units.select(F.explode("seq_lba_ranges").alias("r")).groupBy(F.col("r.seq").alias("seq")).agg(F.count("*").alias("in_flight"))


def completed(parts: DataFrame) -> DataFrame:
    """Seqs all of whose parts are done."""
    return parts.groupBy("seq").agg(F.bool_and("done").alias("complete")).filter("complete").select("seq")


def has_work(log: DataFrame) -> DataFrame:
    """``(vol_id, vol_created_at)`` that still have entries to flush."""
    return log.filter("not flushed").select("vol_id", "vol_created_at").distinct()


def reclaimable(log: DataFrame, durable_seq: Column | int) -> DataFrame:
    """The prefix of each shard's log that may be reclaimed: up to the first entry that is not flushed and durable."""
    ok = F.col("flushed") & (F.col("seq") <= durable_seq)
    first = log.groupBy("shard").agg(F.min(F.when(~ok, F.col("seq"))).alias("first_bad"))
    return log.join(first, "shard").filter(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")


def log_heads(log: DataFrame, progress: DataFrame, durable_seq: Column | int) -> DataFrame:
    """Per shard the first entry that cannot be reclaimed yet, and the blocks it still has to flush."""
    rest = log.filter(~(F.col("flushed") & (F.col("seq") <= durable_seq)))
    heads = rest.groupBy("shard").agg(F.min("seq").alias("head_seq"))
    return heads.join(progress.select(F.col("seq").alias("head_seq"), F.col("remaining").alias("head_remaining_lbas")), "head_seq", "left").select("shard", "head_seq", "head_remaining_lbas")


def recovered(log: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Entries inside the checkpoint's occupied ranges (which may wrap), and those after its head while seqs ascend without a gap.

    ``log`` has ``disk_offset`` and ``disk_len``; the walk stops at the first entry
    that is not where the one before ended, or whose seq does not ascend.
    """
    joined = log.join(checkpoint.select("shard", "head_offset", "tail_offset", "max_seq", "used_bytes"), "shard")
    at, head, tail = F.col("disk_offset"), F.col("head_offset"), F.col("tail_offset")
    wraps = (head <= tail) & (F.col("used_bytes") > 0)
    inside = F.when(wraps, (at >= tail) | (at < head)).otherwise((at >= tail) & (at < head)) & (F.col("seq") <= F.col("max_seq"))
    marked = joined.withColumn("inside", inside)
    walk = marked.filter(~F.col("inside") & (at >= head))
    own = Window.partitionBy("shard").orderBy("disk_offset")
    expected = F.coalesce(F.lag(at + F.col("disk_len")).over(own), head)
    broken = (at != expected) | (F.col("seq") <= F.coalesce(F.lag("seq").over(own), F.col("max_seq")))
    good = walk.withColumn("broken", broken).withColumn("stopped", F.bool_or("broken").over(own)).filter("not stopped").drop("broken", "stopped")
    return marked.filter("inside").unionByName(good).drop("head_offset", "tail_offset", "max_seq", "used_bytes", "inside")


def ring_offsets(log: DataFrame, capacity: int) -> DataFrame:
    """Where each shard's entries lie in a ring of ``capacity`` bytes: one that does not fit before the end begins at 0.

    The next place depends on all before, so each shard is a fold in order of seq.
    """

    def place(rows):
        at, out = 0, []
        for n in rows.sort_values("seq")["disk_len"]:
            at = 0 if at + n > capacity else at
            out.append(at)
            at += n
        return rows.sort_values("seq").assign(disk_offset=out)[["shard", "seq", "disk_len", "disk_offset"]]

    return log.select("shard", "seq", "disk_len").groupBy("shard").applyInPandas(place, "shard int, seq bigint, disk_len int, disk_offset bigint")


def shard_layout(total: int, shards: int) -> list[tuple[int, int, int]]:
    """``(shard, offset, length)`` of equal, block-aligned shares; the last takes the rest."""
    each = total // shards // BLOCK * BLOCK
    return [(k, k * each, each if k < shards - 1 else total - each * (shards - 1)) for k in range(shards)]


def batches(log: DataFrame, window_bytes: int = 16 << 20) -> DataFrame:
    """``log`` with ``ready``: what a flush takes, entries in order until ``window_bytes`` are reached, the first always."""
    own = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("lba_count") * BLOCK
    total = F.sum(size).over(own)
    return log.withColumn("ready", (total <= window_bytes) | (total == size))


def numbered_batches(rows: DataFrame, by: list[str], order: str, size: int = 32) -> DataFrame:
    return rows.withColumn("batch", S.idiv(F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, size))


def next_generations(volumes: DataFrame, last: int, now: int) -> DataFrame:
    """``created_at`` for new volumes, in order of their names: never less than the clock, always more than the last."""
    return volumes.withColumn("created_at", F.lit(max(now, last + 1)) + F.row_number().over(Window.orderBy("vol_id")) - 1)
