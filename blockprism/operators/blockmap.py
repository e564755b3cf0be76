"""The block map and the reference counts that follow from it.  Changes return new tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.functions import scalars as S
from blockprism.operators.writelog import KEY


def requests(spark: SparkSession, keys: Sequence, name: str, kind: str = "bigint") -> DataFrame:
    """Wanted keys with their place ``pos``; order and repeats stay."""
    return spark.createDataFrame([(k, x) for k, x in enumerate(keys)], f"pos int, {name} {kind}")


def multi_get(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A row per wanted key, in their order; nulls where nothing is found."""
    return wanted.join(table, key, "left").orderBy("pos")


def mappings(blockmap: DataFrame, vol_id: str, wanted: DataFrame) -> DataFrame:
    return multi_get(blockmap.filter(F.col("vol_id") == vol_id), wanted, "lba")


def mapping_range(blockmap: DataFrame, vol_id: str, start: int, end: int) -> DataFrame:
    """Mappings of ``[start, end)`` in order; the bounds reach the scan."""
    return blockmap.filter((F.col("vol_id") == vol_id) & (F.col("lba") >= start) & (F.col("lba") < end)).orderBy("lba")


def has_reference(blockmap: DataFrame, pba: int) -> bool:
    return not blockmap.filter(F.col("pba") == pba).isEmpty()


def count_references(blockmap: DataFrame, pba: int) -> int:
    return blockmap.filter(F.col("pba") == pba).count()


def refcounts(blockmap: DataFrame) -> DataFrame:
    """References per physical block: the mappings that point to it."""
    return blockmap.groupBy("pba").agg(F.count("*").alias("refcount"))


def multi_refcounts(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    return multi_get(stored, wanted, "pba").withColumn("refcount", F.coalesce("refcount", F.lit(0).cast("bigint")))


def live_refcounts(stored: DataFrame) -> DataFrame:
    return stored.filter("refcount > 0")


def adjusted(stored: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts after adding ``(pba, delta)``, never below zero; a count of zero has no row."""
    both = stored.select("pba", F.col("refcount").alias("n")).unionByName(deltas.select("pba", F.col("delta").alias("n")))
    return both.groupBy("pba").agg(F.greatest(F.sum("n"), F.lit(0)).alias("refcount")).filter("refcount > 0")


def allocated_blocks(blockmap: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Distinct physical blocks that units or counted references take."""
    units = blockmap.select("pba", S.blocks("unit_compressed_size").alias("n")).distinct()
    taken = units.select(F.explode(F.expr("sequence(pba, pba + n - 1)")).alias("pba"))
    if stored is not None:
        taken = taken.unionByName(live_refcounts(stored).select("pba"))
    return taken.distinct()


def upserted(blockmap: DataFrame, batch: DataFrame) -> DataFrame:
    """The map after a batch of mappings, of which a block has one at most."""
    return blockmap.join(batch.select(*KEY), KEY, "left_anti").unionByName(batch.select(*blockmap.columns))


def deleted(blockmap: DataFrame, keys: DataFrame) -> DataFrame:
    return blockmap.join(keys.select(*KEY), KEY, "left_anti")


def old_mappings(blockmap: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with ``old_pba`` and ``old_size`` of what each block had, null if it had nothing."""
    old = blockmap.select(*KEY, F.col("pba").alias("old_pba"), F.col("unit_compressed_size").alias("old_size"))
    return batch.join(old, KEY, "left")


def decrements(mapped: DataFrame, pba: str = "pba", size: str = "unit_compressed_size") -> DataFrame:
    """Per physical block how many references go, and the most blocks that it takes."""
    return mapped.filter(F.col(pba).isNotNull()).groupBy(F.col(pba).alias("pba")).agg(F.count("*").alias("decrements"), F.max(S.blocks(size)).alias("blocks"))


def freed(gone: DataFrame, stored: DataFrame) -> DataFrame:
    """Of decremented blocks those whose count falls to zero: extents ``(start_pba, block_count)``."""
    left = F.coalesce(F.col("refcount"), F.lit(0)) - F.col("decrements")
    return gone.join(stored, "pba", "left").filter(left <= 0).select(F.col("pba").alias("start_pba"), F.col("blocks").alias("block_count"))


def netted(stored: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Counts after a batch's references ``(pba)`` are added and removed, increments first: ``final``, ``newly_zeroed``."""
    rows = (
        stored.select("pba", F.col("refcount").alias("cur"), F.lit(0).alias("inc"), F.lit(0).alias("dec"))
        .unionByName(added.select("pba", F.lit(0).cast("bigint").alias("cur"), F.lit(1).alias("inc"), F.lit(0).alias("dec")))
        .unionByName(removed.select("pba", F.lit(0).cast("bigint").alias("cur"), F.lit(0).alias("inc"), F.lit(1).alias("dec")))
    )
    sums = rows.groupBy("pba").agg(F.max("cur").alias("cur"), F.sum("inc").alias("inc"), F.sum("dec").alias("dec"))
    final = F.greatest(F.col("cur") + F.col("inc") - F.col("dec"), F.lit(0).cast("bigint"))
    return sums.withColumn("final", final).withColumn("newly_zeroed", (F.col("cur") > 0) & (F.col("final") == 0))


def write_batch(blockmap: DataFrame, stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of units' mappings: the new map, the new counts, and extents that nothing refers to any more.

    A mapping that is replaced by one to the same physical block is neither added
    nor removed.
    """
    moved = old_mappings(blockmap, batch).filter("old_pba is null or old_pba <> pba")
    gone = decrements(moved, "old_pba", "old_size")
    net = netted(stored, moved.select("pba"), moved.filter("old_pba is not null").select(F.col("old_pba").alias("pba")))
    counts = net.filter("final > 0").select("pba", F.col("final").alias("refcount"))
    zero = net.filter("newly_zeroed").join(gone, "pba").select(F.col("pba").alias("start_pba"), F.col("blocks").alias("block_count"))
    return upserted(blockmap, batch), counts, zero


def without_range(blockmap: DataFrame, stored: DataFrame, vol_id: str, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A volume's mappings, or those of ``[start, end)``, taken out: the new map, the new counts, freed extents."""
    hit = F.col("vol_id") == vol_id
    if start is not None:
        hit &= (F.col("lba") >= start) & (F.col("lba") < end)
    gone = decrements(blockmap.filter(hit))
    counts = adjusted(stored, gone.select("pba", (-F.col("decrements")).alias("delta")))
    return blockmap.filter(~hit), counts, freed(gone, stored)


def orphans(stored: DataFrame, blockmap: DataFrame) -> DataFrame:
    """Counted blocks that no mapping refers to."""
    return live_refcounts(stored).join(blockmap.select("pba"), "pba", "left_anti")


def drift(stored: DataFrame, blockmap: DataFrame) -> DataFrame:
    """``(pba, stored, computed, state)``: orphan, missing, fixed (counts differ) or ok."""
    a, b = live_refcounts(stored).select("pba", F.col("refcount").alias("stored")), refcounts(blockmap).select("pba", F.col("refcount").alias("computed"))
    state = F.when(F.col("computed").isNull(), "orphan").when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("computed"), "fixed").otherwise("ok")
    return a.join(b, "pba", "full_outer").withColumn("state", state)


def rebuilt(stored: DataFrame, blockmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts as they should be, and one row of how many were referenced, fixed, orphaned."""
    count = lambda s: F.count_if(F.col("state") == s)
    summary = drift(stored, blockmap).agg(F.count("computed").alias("referenced"), (count("fixed") + count("missing")).alias("fixed"), count("orphan").alias("orphans"))
    return refcounts(blockmap), summary


def fragment_groups(blockmap: DataFrame, pba: int | None = None) -> DataFrame:
    """Per fragment its references as ``vol:lba``, in order, comma-joined."""
    from blockprism.schemas import FRAGMENT

    rows = blockmap if pba is None else blockmap.filter(F.col("pba") == pba)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("vol_id", "lba"))), lambda r: F.concat_ws(":", r["vol_id"], r["lba"]))
    return rows.groupBy(*FRAGMENT).agg(F.count("*").alias("n_refs"), F.array_join(refs, ",").alias("refs"))


def resolved(volumes: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named volumes in the order given, all if none is named; an unknown name is an error."""
    if not names:
        return volumes.orderBy("vol_id")
    found = multi_get(volumes, requests(volumes.sparkSession, names, "vol_id", "string"), "vol_id")
    missing = [r["vol_id"] for r in found.filter("created_at is null").select("vol_id").collect()]
    if missing:
        raise KeyError(f"no such volumes: {missing}")
    return found


def set_refcounts(stored: DataFrame, values: DataFrame) -> DataFrame:
    """Counts ``(pba, refcount)`` put in place of what was there; zero takes the row away."""
    rest = stored.join(values.select("pba"), "pba", "left_anti").select("pba", "refcount")
    return rest.unionByName(values.select("pba", "refcount")).filter("refcount > 0")


def write_mapping(blockmap: DataFrame, stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings of new physical blocks, whose counts are set to one; what they replace is left as it is."""
    ones = batch.select("pba", F.lit(1).cast("bigint").alias("refcount")).distinct()
    return upserted(blockmap, batch), set_refcounts(stored, ones)


def remap(blockmap: DataFrame, stored: DataFrame, batch: DataFrame, old_pba: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mappings moved to new blocks, whose counts are set to one; the old blocks lose a reference each.

    The old block is the one that is mapped; where none is, ``batch``'s column ``old_pba``.
    """
    known = old_mappings(blockmap, batch.drop("old_pba") if old_pba else batch)
    if old_pba:
        known = known.join(batch.select(*KEY, F.col(old_pba).alias("told")), KEY).withColumn("old_pba", F.coalesce("old_pba", "told"))
    gone = known.filter("old_pba is not null").groupBy(F.col("old_pba").alias("pba")).agg((-F.count("*")).alias("delta"))
    ones = batch.select("pba", F.lit(1).cast("bigint").alias("refcount")).distinct()
    return upserted(blockmap, batch.select(*blockmap.columns)), set_refcounts(adjusted(stored, gone), ones)


def update_flags(blockmap: DataFrame, keys: DataFrame, skipped: bool) -> DataFrame:
    """The dedup-skipped flag set or cleared for some blocks."""
    marked = blockmap.join(keys.select(*KEY, F.lit(True).alias("_hit")).distinct(), KEY, "left")
    kind = dict(blockmap.dtypes)["flags"]
    return marked.withColumn("flags", F.when(F.col("_hit"), S.set_dedup_skipped("flags", skipped).cast(kind)).otherwise(F.col("flags"))).select(*blockmap.columns)


def dedup_hit(blockmap: DataFrame, stored: DataFrame, hit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One block's mapping, now to a block that is there already; an error if nothing refers to that block any more."""
    live = live_refcounts(stored).select("pba")
    if hit.join(live, "pba", "left_anti").count():
        raise ValueError("the target is not referred to any more")
    return write_batch(blockmap, stored, hit)
