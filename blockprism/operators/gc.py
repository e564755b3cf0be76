"""Garbage collection: which fragments to rewrite, when, and whether they still may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.functions import scalars as S
from blockprism.schemas import FRAGMENT


def candidates(blockmap: DataFrame, threshold: float | Column = 0.25, limit: int | None = 64, distinct: bool = False) -> DataFrame:
    """Fragments of several blocks of which at least ``threshold`` is dead, worst first.

    Live are mapping rows, or with ``distinct`` the distinct blocks of the fragment
    that they refer to; ``refs`` keeps volume, address and offset of each.  Ties go
    by the fragment's key, so the order is total.
    """
    groups = blockmap.filter("unit_lba_count > 1").groupBy(*FRAGMENT).agg(
        F.count("*").alias("live_rows"),
        F.countDistinct("offset_in_unit").alias("live_blocks"),
        F.array_sort(F.collect_list(F.struct("vol_id", "lba", "offset_in_unit"))).alias("refs"),
    )
    live = F.col("live_blocks") if distinct else F.col("live_rows")
    out = groups.withColumn("dead_ratio", S.dead_ratio(live, F.col("unit_lba_count"))).filter(F.col("dead_ratio") >= threshold)
    return out.orderBy(F.desc("dead_ratio"), *FRAGMENT).limit(limit) if limit else out


def banded(blockmap: DataFrame, totals: DataFrame, configured: float = 0.25, limit: int | None = None) -> DataFrame:
    """Candidates at the threshold that the share of free space asks for; ``totals`` is one row of ``usable`` and ``free``."""
    found = candidates(blockmap, -1e9, None)
    limits = totals.select(S.gc_threshold(S.free_percent("free", "usable"), configured).alias("threshold"))
    out = found.join(F.broadcast(limits), F.col("dead_ratio") >= F.col("threshold"))  # one row
    return out.orderBy(F.desc("dead_ratio"), *FRAGMENT).limit(limit) if limit else out


def hysteresis(fills: DataFrame, by: list[str], order: str, fill: str = "fill", pause: int = 80, resume: int = 50) -> DataFrame:
    """``fills`` with ``paused``: set above ``pause``, cleared at ``resume`` or below, else as before; at first not."""
    mark = F.when(F.col(fill) > pause, True).when(F.col(fill) <= resume, False)
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fills.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(own), F.lit(False)))


def revalidated(found: DataFrame, blockmap: DataFrame, pending: DataFrame) -> DataFrame:
    """References of candidates that are still mapped as they were and have no write pending: ``(vol_id, lba)`` with the fragment."""
    refs = found.select(*FRAGMENT, F.explode("refs").alias("r")).select(*FRAGMENT, "r.vol_id", "r.lba", "r.offset_in_unit")
    same = [*FRAGMENT, "vol_id", "lba", "offset_in_unit"]
    return refs.join(blockmap.select(*same), same, "left_semi").join(pending.select("vol_id", "lba"), ["vol_id", "lba"], "left_anti")
