"""Content dedup: fingerprints of blocks, the index of stored ones, and its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.functions import scalars as S
from blockprism.operators import space
from blockprism.operators.writelog import islands
from blockprism.schemas import BLOCK

PHYSICAL = ["pba", "slot_offset", "compression", "unit_compressed_size", "unit_original_size", "unit_lba_count", "offset_in_unit", "crc32"]


def fingerprints(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per block of each payload: ``index``, ``hash``; the last block may be short.  Payloads of no bytes have none."""
    data = F.col(payload).cast("binary")
    n = S.blocks(F.octet_length(data)).cast("int")
    out = payloads.withColumn("_data", data).filter(F.octet_length("_data") > 0).withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.substring(F.col("_data"), F.col("index") * BLOCK + 1, F.lit(BLOCK))
    return out.withColumn("hash", S.content_hash(part)).drop("_data", payload)


def canonical(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Of all blocks of one content the first by ``order``: the owner that others refer to."""
    rest = [c for c in blocks.columns if c not in ("hash", *order)]
    first = blocks.groupBy("hash").agg(F.min(F.struct(*order, *rest)).alias("one"), F.count("*").alias("copies"))
    return first.select("hash", "one.*", "copies")


def hits(blocks: DataFrame, index: DataFrame) -> DataFrame:
    return blocks.join(index.select("hash"), "hash", "left_semi")


def misses(blocks: DataFrame, index: DataFrame) -> DataFrame:
    return blocks.join(index.select("hash"), "hash", "left_anti")


def miss_runs(missed: DataFrame, unit: list[str], at: str) -> DataFrame:
    """The blocks of each unit that must be written, as runs between hits."""
    return islands(missed, unit, at).groupBy(*unit, "island").agg(F.min(at).alias("start"), F.count("*").alias("length")).drop("island")


def live_entries(index: DataFrame, stored: DataFrame, reverse: DataFrame) -> DataFrame:
    """Index entries whose block is referred to and has its reverse row."""
    return index.join(stored.filter("refcount > 0").select("pba"), "pba", "left_semi").join(reverse, ["pba", "hash"], "left_semi")


def stale_entries(index: DataFrame, stored: DataFrame, reverse: DataFrame) -> DataFrame:
    return index.join(live_entries(index, stored, reverse).select("hash"), "hash", "left_anti")


def put_entries(index: DataFrame, reverse: DataFrame, entries: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """New entries: of several for one hash the last by ``order`` stays; a reverse row for each that stays.

    An all-zero hash means that there is none.
    """
    rest = [c for c in index.columns if c != "hash"]
    good = entries.filter(~F.col("hash").cast("string").rlike("^\x00*$") if dict(entries.dtypes)["hash"] == "binary" else ~F.col("hash").rlike("^0*$"))
    last = good.groupBy("hash").agg(F.max_by(F.struct(*rest), order).alias("e")).select("hash", "e.*")
    kept = index.join(last.select("hash"), "hash", "left_anti").select(*index.columns).unionByName(last.select(*index.columns))
    old = reverse.join(last.select("hash"), "hash", "left_anti").select(*reverse.columns)
    return kept, old.unionByName(last.select(*reverse.columns)).distinct()


def drop_entry(index: DataFrame, reverse: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without these hashes, and without the reverse rows that belong to them."""
    own = index.join(gone.select("hash"), "hash", "left_semi").select("pba", "hash")
    return index.join(gone.select("hash"), "hash", "left_anti"), reverse.join(own, ["pba", "hash"], "left_anti")


def cleanup(index: DataFrame, reverse: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After blocks ``(pba)`` died: their reverse rows go, and entries that still point to them."""
    rows = reverse.join(dead.select("pba").distinct(), "pba", "left_semi")
    return index.join(rows.select("pba", "hash"), ["pba", "hash"], "left_anti"), reverse.join(dead.select("pba"), "pba", "left_anti")


def cleanup_gate(dead: DataFrame, stored: DataFrame, free: DataFrame) -> DataFrame:
    """Blocks that may be cleaned up: nothing refers to them and they are not free already."""
    live = stored.filter("refcount > 0").select("pba")
    idle = dead.join(live, "pba", "left_anti")
    single = idle.select(F.col("pba").alias("start_pba"), F.lit(1).cast("bigint").alias("block_count")).distinct()
    return idle.join(space.overlapping(single, free).select(F.col("start_pba").alias("pba")), "pba", "left_anti")


def skipped(blockmap: DataFrame, limit: int) -> DataFrame:
    """Mappings whose block was written without a dedup lookup, in order, at most ``limit``."""
    return blockmap.filter(S.is_dedup_skipped("flags")).orderBy("vol_id", "lba").limit(limit)


def hit_rate(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: blocks, hits, misses and the hits' share."""
    marked = blocks.join(index.select("hash", F.lit(1).alias("known")), "hash", "left")
    out = marked.agg(F.count("*").alias("blocks"), F.count("known").alias("hits"))
    return out.withColumn("misses", F.col("blocks") - F.col("hits")).withColumn("rate", F.when(F.col("blocks") > 0, F.col("hits").cast("double") / F.col("blocks")).otherwise(0.0))


def symmetric_gaps(index: DataFrame, reverse: DataFrame) -> DataFrame:
    """Entries without a reverse row, and reverse rows without their entry."""
    a = index.select("hash", "pba").join(reverse, ["hash", "pba"], "left_anti").withColumn("gap", F.lit("no_reverse"))
    b = reverse.select("hash", "pba").join(index, ["hash", "pba"], "left_anti").withColumn("gap", F.lit("no_forward"))
    return a.unionByName(b)


def accept_hits(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Which hits of a batch may be taken, in order of ``seq``.

    ``batch`` has ``seq, vol_id, lba, pba, old_pba``.  A hit needs its target to be
    referred to when its turn comes: the count before, plus hits accepted, less
    references that accepted hits gave up.  The outcome of each depends on those
    before, so a volume's batch is folded in order; a hit on the block that is
    mapped already only refreshes.  Outcomes: accepted, refreshed, rejected.
    """
    counts = stored.select("pba", "refcount")
    rows = batch.join(counts, "pba", "left").join(counts.select(F.col("pba").alias("old_pba"), F.col("refcount").alias("old_count")), "old_pba", "left")

    def fold(own):
        own = own.sort_values("seq")
        now = dict(zip(own["pba"], own["refcount"].fillna(0), strict=True)) | {p: n for p, n in zip(own["old_pba"], own["old_count"].fillna(0), strict=True) if p == p}
        out = []
        for pba, old in zip(own["pba"], own["old_pba"], strict=True):
            if now[pba] <= 0:
                out.append("rejected")
            elif old == pba:
                out.append("refreshed")
            else:
                now[pba] += 1
                if old == old and old is not None:
                    now[old] = max(now[old] - 1, 0)
                out.append("accepted")
        return own.assign(outcome=out)[["seq", "vol_id", "lba", "pba", "outcome"]]

    return rows.groupBy("vol_id").applyInPandas(fold, "seq bigint, vol_id string, lba bigint, pba bigint, outcome string")


def rescan_plan(blockmap: DataFrame, index: DataFrame, hashes: DataFrame, limit: int, fill: float, most_fill: float = 90) -> DataFrame:
    """A rescan's decisions for skipped blocks: hit (refer to the entry's block) or miss (enter it); nothing above ``most_fill``.

    ``hashes`` has ``vol_id, lba, hash``.
    """
    todo = skipped(blockmap, 0 if fill > most_fill else limit)
    found = todo.join(hashes, ["vol_id", "lba"]).join(index.select("hash", F.col("pba").alias("to_pba")), "hash", "left")
    return found.withColumn("outcome", F.when(F.col("to_pba").isNull(), "miss").when(F.col("to_pba") == F.col("pba"), "same").otherwise("hit"))


def rescan_stats(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("rescanned"), F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"))


def first_of_each(blocks: DataFrame, order: str) -> DataFrame:
    """Blocks with ``is_first``: no block of the same content comes before."""
    return blocks.withColumn("is_first", F.row_number().over(Window.partitionBy("hash").orderBy(order)) == 1)
