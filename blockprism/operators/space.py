"""Space: free extents, their merging and allocation, and packing of fragments into slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.functions import scalars as S
from blockprism.schemas import BLOCK, MAX_EXTENT, RESERVED


def free_extents(allocated: DataFrame, total: int, bucket: int = 1 << 20, most: int = MAX_EXTENT) -> DataFrame:
    """Gaps ``(start_pba, block_count)`` between allocated blocks from ``RESERVED`` to ``total``.

    Blocks are ordered within buckets of ``bucket`` addresses; only each bucket's
    ends are ordered across buckets, so no task sees all blocks.  A gap of more
    than ``most`` blocks is split.
    """
    inside = allocated.select("pba").filter((F.col("pba") >= RESERVED) & (F.col("pba") < total)).distinct().withColumn("b", S.idiv("pba", bucket))
    own = Window.partitionBy("b").orderBy("pba")
    gaps = inside.withColumn("before", F.lag("pba").over(own)).filter("before is not null").select((F.col("before") + 1).alias("start_pba"), F.col("pba").alias("end"))
    ends = inside.groupBy("b").agg(F.min("pba").alias("lo"), F.max("pba").alias("hi"))
    across = ends.withColumn("before", F.lag("hi").over(Window.orderBy("b")))
    between = across.select((F.coalesce("before", F.lit(RESERVED - 1)) + 1).alias("start_pba"), F.col("lo").alias("end"))
    last = ends.agg(F.coalesce(F.max("hi"), F.lit(RESERVED - 1)).alias("hi")).select((F.col("hi") + 1).alias("start_pba"), F.lit(total).cast("bigint").alias("end"))
    all_gaps = gaps.unionByName(between).unionByName(last).filter("end > start_pba")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), S.idiv(F.col("end") - F.col("start_pba") - 1, most)))
    parts = all_gaps.select("start_pba", "end", cut.alias("k")).select((F.col("start_pba") + F.col("k") * most).alias("start_pba"), "end")
    return parts.select("start_pba", F.least(F.col("end") - F.col("start_pba"), F.lit(most).cast("bigint")).alias("block_count"))


def merged(extents: DataFrame, region: int = 1 << 20) -> DataFrame:
    """Extents with adjacent and overlapping ones merged.

    They are cut at multiples of ``region`` and merged within; only parts that touch
    a region's ends, two a region at most, are then merged across regions.
    """
    spans = F.explode(F.sequence(S.idiv("start_pba", region), S.idiv(F.col("start_pba") + F.col("block_count") - 1, region)))
    cut = extents.filter("block_count > 0").select("start_pba", (F.col("start_pba") + F.col("block_count")).alias("end"), spans.alias("r"))
    cut = cut.select("r", F.greatest("start_pba", F.col("r") * region).alias("start"), F.least("end", (F.col("r") + 1) * region).alias("end"))
    inside = _merged(cut, ["r"])
    edge = (F.col("start") == F.col("r") * region) | (F.col("end") == (F.col("r") + 1) * region)
    across = _merged(inside.filter(edge).select("start", "end"), [])
    out = inside.filter(~edge).select("start", "end").unionByName(across)
    return out.select(F.col("start").alias("start_pba"), (F.col("end") - F.col("start")).alias("block_count"))


def _merged(spans: DataFrame, by: list[str]) -> DataFrame:
    own = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("k", F.sum("new").over(own))
    return rows.groupBy(*by, "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def overlapping(extents: DataFrame, with_: DataFrame, bucket: int = 4096) -> DataFrame:
    """Extents that share a block with one of the others; both are dealt out by address buckets, so it is an equi-join."""

    def dealt(df: DataFrame, tag: str) -> DataFrame:
        spans = F.explode(F.sequence(S.idiv("start_pba", bucket), S.idiv(F.col("start_pba") + F.col("block_count") - 1, bucket)))
        return df.filter("block_count > 0").select(F.col("start_pba").alias(f"{tag}_start"), F.col("block_count").alias(f"{tag}_count"), spans.alias("b"))

    a, b = dealt(extents, "a"), dealt(with_, "b")
    meets = (F.col("a_start") < F.col("b_start") + F.col("b_count")) & (F.col("b_start") < F.col("a_start") + F.col("a_count"))
    return a.join(b, "b").filter(meets).select(F.col("a_start").alias("start_pba"), F.col("a_count").alias("block_count"), F.col("b_start").alias("other_start"), F.col("b_count").alias("other_count")).distinct()


def pack(fragments: DataFrame, slot: int = BLOCK, max_age: float | None = None) -> DataFrame:
    """Next fit per lane: ``(lane, order_key, size, slot, slot_offset)``.

    A fragment goes into the lane's open slot if it fits, else opens a new one; one
    of a slot's size or more passes by (slot -1) and leaves the open slot as it is.
    With ``max_age`` a slot is also closed when a fragment's ``ts`` is so much later
    than its first.  Each place depends on all before, so a lane is folded in order,
    in vectors of pandas; lanes run in parallel.
    """
    has_ts = max_age is not None

    def fold(own):
        own = own.sort_values("order_key")
        at, used, opened, slots, offsets = 0, 0, None, [], []
        ages = own["ts"] if has_ts else own["size"]
        for size, ts in zip(own["size"], ages, strict=True):
            if size >= slot:
                slots.append(-1)
                offsets.append(0)
                continue
            if used + size > slot or (has_ts and opened is not None and ts - opened >= max_age):
                at, used, opened = at + 1, 0, None
            opened = ts if opened is None else opened
            slots.append(at)
            offsets.append(used)
            used += size
        return own.assign(slot=slots, slot_offset=offsets)[["lane", "order_key", "size", "slot", "slot_offset"]]

    columns = ["lane", "order_key", "size", *(["ts"] if has_ts else [])]
    return fragments.select(*columns).groupBy("lane").applyInPandas(fold, "lane string, order_key bigint, size bigint, slot bigint, slot_offset bigint")


def slot_overlaps(fragments: DataFrame) -> DataFrame:
    """Pairs of fragments of one block whose bytes overlap: ``(pba, a_id, b_id)`` with ``a_id < b_id``.

    Joined on the block, and a block's slot bounds how many fragments it has.
    """
    a, b = fragments.alias("a"), fragments.alias("b")
    meets = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, F.col("a.pba") == F.col("b.pba")).filter(meets).select(F.col("a.pba").alias("pba"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


def first_fit(free: DataFrame, wanted: int) -> DataFrame:
    """One request: the lowest extent that has room, else the largest."""
    fits = F.col("block_count") >= wanted
    return free.orderBy(fits.desc(), F.when(fits, F.col("start_pba")).otherwise(-F.col("block_count")), "start_pba").limit(1)


def allocate(free: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(lane, order_key, blocks)`` served in order from the lane's extents ``(lane, start_pba, block_count)``.

    First fit, else the largest extent (then fewer blocks are given); ``start_pba``
    is null when nothing is left.  What is left depends on every request before, so
    lanes are folded in order.
    """

    def fold(extents, wants):
        left = sorted([s, n] for s, n in zip(extents["start_pba"], extents["block_count"], strict=True))
        out = []
        for key, n in wants.sort_values("order_key")[["order_key", "blocks"]].itertuples(index=False):
            pick = next((x for x in left if x[1] >= n), None) or max(left, key=lambda x: (x[1], -x[0]), default=None)
            if pick is None:
                out.append((key, None, 0))
                continue
            given = min(n, pick[1])
            out.append((key, pick[0], given))
            pick[0], pick[1] = pick[0] + given, pick[1] - given
            left = [x for x in left if x[1]]
        lane = wants["lane"].iloc[0] if len(wants) else ""
        import pandas as pd

        return pd.DataFrame(out, columns=["order_key", "start_pba", "given"]).astype({"start_pba": "Int64"}).assign(lane=lane)[["lane", "order_key", "start_pba", "given"]]

    return free.groupBy("lane").cogroup(requests.groupBy("lane")).applyInPandas(fold, "lane string, order_key bigint, start_pba bigint, given bigint")


def totals(allocated: DataFrame, total: int) -> DataFrame:
    """One row: usable, allocated and free blocks."""
    n = F.count_if((F.col("pba") >= RESERVED) & (F.col("pba") < total))
    return allocated.select("pba").distinct().agg(n.alias("allocated")).select(F.lit(total - RESERVED).cast("bigint").alias("usable"), "allocated", (F.lit(total - RESERVED) - F.col("allocated")).alias("free"))


def space_report(blockmap: DataFrame) -> DataFrame:
    """Mappings, blocks and bytes per volume and compression, per volume, and in all (nulls)."""
    sizes = blockmap.select("vol_id", "compression", "pba", "unit_compressed_size")
    return sizes.rollup("vol_id", "compression").agg(F.count("*").alias("mappings"), F.countDistinct("pba").alias("pbas"), F.sum(F.col("unit_compressed_size").cast("bigint")).alias("bytes"))
