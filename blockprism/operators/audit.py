"""Invariants as queries: each returns the rows that break one, none on healthy tables.

Every query returns ``(rule, vol_id, at, detail)``, so all can be put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprism.operators import dedup, space
from blockprism.schemas import BLOCK, PHYSICAL_BLOCK, RESERVED

COLUMNS = ["rule", "vol_id", "at", "detail"]


def _found(rows: DataFrame, rule: str, vol_id, at, detail="") -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(rule).alias("rule"), as_column(vol_id).cast("string").alias("vol_id"), as_column(at).cast("bigint").alias("at"), as_column(detail).cast("string").alias("detail"))


def _mapping(rule: str, broken: Callable[[], Column], detail: str) -> Callable[..., DataFrame]:
    def query(blockmap: DataFrame, **_) -> DataFrame:
        return _found(blockmap.filter(broken()), rule, F.col("vol_id"), F.col("lba"), F.col(detail))

    return query


def seq_unique(log, **_):
    return _found(log.groupBy("seq").count().filter("count > 1"), "seq_unique", "", F.col("seq"), F.col("count"))


def pending_volume(log, volumes, **_):
    v = volumes.select("vol_id", "size_bytes")
    end = (F.col("start_lba") + F.col("lba_count")) * BLOCK
    return _found(log.join(v, "vol_id", "left").filter(F.col("size_bytes").isNull() | (end > F.col("size_bytes"))), "pending_volume", F.col("vol_id"), F.col("seq"), end)


def payload_length(log, **_):
    return _found(log.filter(F.col("payload_bytes") != F.col("lba_count") * BLOCK), "payload_length", F.col("vol_id"), F.col("seq"), F.col("payload_bytes"))


def mapping_volume(blockmap, volumes, **_):
    return _found(blockmap.join(volumes.select("vol_id"), "vol_id", "left_anti"), "mapping_volume", F.col("vol_id"), F.col("lba"))


def mapping_bounds(blockmap, volumes, **_):
    inside = blockmap.join(volumes.select("vol_id", "size_bytes"), "vol_id")
    return _found(inside.filter((F.col("lba") + 1) * BLOCK > F.col("size_bytes")), "mapping_bounds", F.col("vol_id"), F.col("lba"), F.col("size_bytes"))


def distinct_offsets(blockmap, **_):
    unit = [c for c in [*PHYSICAL_BLOCK, "flags"] if c != "offset_in_unit"]
    over = blockmap.groupBy(*unit).agg(F.countDistinct("offset_in_unit").alias("n")).filter(F.col("n") > F.col("unit_lba_count"))
    return _found(over, "distinct_offsets", "", F.col("pba"), F.col("n"))


def allocated_count(allocated, free, total, **_):
    """Blocks that are neither allocated nor free, or both; ``free`` are extents."""
    taken = allocated.select("pba").distinct().agg(F.count("*").alias("a"))
    sums = free.agg(F.coalesce(F.sum("block_count"), F.lit(0)).alias("f"))
    both = taken.join(F.broadcast(sums), F.lit(True))  # one row each
    return _found(both.filter(F.col("a") + F.col("f") != total - RESERVED), "allocated_count", "", F.col("a"), F.col("f"))


def free_overlap(allocated, free, **_):
    ones = allocated.select(F.col("pba").alias("start_pba"), F.lit(1).cast("bigint").alias("block_count"))
    return _found(space.overlapping(ones, free), "free_overlap", "", F.col("start_pba"), F.col("other_start"))


def forward_reverse(index, reverse, **_):
    return _found(dedup.symmetric_gaps(index, reverse).filter("gap = 'no_reverse'"), "forward_reverse", "", F.col("pba"), F.col("hash"))


def forward_live(index, stored, **_):
    return _found(index.join(stored.filter("refcount > 0").select("pba"), "pba", "left_anti"), "forward_live", "", F.col("pba"), F.col("hash"))


def hash_content(index, blocks, **_):
    there = index.join(blocks.select("pba", F.col("hash").alias("actual")), "pba")
    return _found(there.filter("hash <> actual"), "hash_content", "", F.col("pba"), F.col("hash"))


def reverse_forward(index, reverse, **_):
    return _found(reverse.join(index.select("hash"), "hash", "left_anti"), "reverse_forward", "", F.col("pba"), F.col("hash"))


def reverse_pba(index, reverse, **_):
    both = reverse.join(index.select("hash", F.col("pba").alias("forward_pba")), "hash")
    return _found(both.filter("pba <> forward_pba"), "reverse_pba", "", F.col("pba"), F.col("hash"))


AUDITS: dict[str, Callable[..., DataFrame]] = {
    "seq_unique": seq_unique,
    "pending_volume": pending_volume,
    "payload_length": payload_length,
    "mapping_volume": mapping_volume,
    "mapping_bounds": mapping_bounds,
    "unit_lba_count": _mapping("unit_lba_count", lambda: F.col("unit_lba_count") <= 0, "unit_lba_count"),
    "offset_in_unit": _mapping("offset_in_unit", lambda: F.col("offset_in_unit") >= F.col("unit_lba_count"), "offset_in_unit"),
    "compressed_size": _mapping("compressed_size", lambda: F.col("unit_compressed_size") <= 0, "unit_compressed_size"),
    "original_size": _mapping("original_size", lambda: F.col("unit_original_size") % BLOCK != 0, "unit_original_size"),
    "original_blocks": _mapping("original_blocks", lambda: F.col("unit_original_size") != F.col("unit_lba_count") * BLOCK, "unit_original_size"),
    "packed_fits": _mapping("packed_fits", lambda: (F.col("unit_compressed_size") < BLOCK) & (F.col("slot_offset") + F.col("unit_compressed_size") > BLOCK), "slot_offset"),
    "unpacked_at_zero": _mapping("unpacked_at_zero", lambda: (F.col("unit_compressed_size") >= BLOCK) & (F.col("slot_offset") != 0), "slot_offset"),
    "distinct_offsets": distinct_offsets,
    "allocated_count": allocated_count,
    "free_overlap": free_overlap,
    "forward_reverse": forward_reverse,
    "forward_live": forward_live,
    "hash_content": hash_content,
    "reverse_forward": reverse_forward,
    "reverse_pba": reverse_pba,
}


def audit(**tables) -> DataFrame:
    """All rules whose tables are given."""
    import inspect
    from functools import reduce

    asked = [q for q in AUDITS.values() if all(p.name in tables for p in inspect.signature(q).parameters.values() if p.kind is not p.VAR_KEYWORD)]
    return reduce(DataFrame.unionByName, (q(**tables) for q in asked))
