"""Reads and writes of byte ranges: what they touch, which tier answers, and how payloads are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprism.functions import scalars as S
from blockprism.operators.writelog import KEY
from blockprism.schemas import BLOCK, READ_UNIT


def split_ranges(ranges: DataFrame, start: str, length: str, step: int, name: str = "part") -> DataFrame:
    """A row per ``step``-sized cell that ``[start, start + length)`` touches: ``name``, ``part_start``, ``part_length``."""
    s, n = F.col(start), F.col(length)
    cells = F.explode(F.sequence(S.idiv(s, step), S.idiv(s + n - 1, step)))
    out = ranges.filter(n > 0).withColumn(name, cells)
    first = F.greatest(s, F.col(name) * step)
    return out.withColumn("part_start", first.cast("bigint")).withColumn("part_length", (F.least(s + n, (F.col(name) + 1) * step) - first).cast("bigint"))


def split_by_zone(ranges: DataFrame, zone_size: int, zones: int) -> DataFrame:
    """Ranges of blocks cut at zone ends, each part with its ``zone``."""
    return split_ranges(ranges, "start", "count", zone_size, "cell").withColumn("zone", F.pmod("cell", F.lit(zones))).drop("cell")


def split_by_block(ranges: DataFrame) -> DataFrame:
    """Byte ranges cut at block ends; ``kind`` tells whole blocks from those to be read, changed and written."""
    out = split_ranges(ranges, "offset", "length", BLOCK, "lba")
    return out.withColumn("kind", F.when(F.col("part_length") == BLOCK, "full").otherwise("rmw")).withColumn("in_block", F.col("part_start") - F.col("lba") * BLOCK)


def tiers(requests: DataFrame, buffered: DataFrame, blockmap: DataFrame) -> DataFrame:
    """Requested ``(vol_id, lba)``, each with the tier that answers: the buffer, else the map, else zeros."""
    b = buffered.select(*KEY, F.col("seq").alias("buffer_seq"))
    m = blockmap.select(*KEY, *READ_UNIT, "offset_in_unit")
    tier = F.when(F.col("buffer_seq").isNotNull(), "buffer").when(F.col("pba").isNotNull(), "mapped").otherwise("zero")
    return requests.join(b, KEY, "left").join(m, KEY, "left").withColumn("tier", tier)


def read_groups(requested: DataFrame) -> DataFrame:
    """Mapped requests by unit, so each unit is decoded once: members as ``pos:offset``, comma-joined."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "offset_in_unit"))), lambda m: F.concat_ws(":", m["pos"], m["offset_in_unit"]))
    return requested.filter("tier = 'mapped'").groupBy(*READ_UNIT).agg(F.count("*").alias("n_members"), F.array_join(members, ",").alias("members"))


def decoded_blocks(units: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks of decoded units: ``units`` has ``READ_UNIT`` and ``payload``, ``members`` those and ``pos, offset_in_unit``."""
    return members.join(units, READ_UNIT).withColumn("block", S.block_slice("payload", "offset_in_unit")).drop("payload")


def assembled(parts: DataFrame, by: list[str]) -> DataFrame:
    """Blocks' slices put together in order: ``parts`` has ``part_start, in_block, part_length, block``; a null block is zeros."""
    zeros = F.unhex(F.repeat(F.lit("00"), BLOCK))
    piece = F.substring(F.coalesce("block", zeros), F.col("in_block").cast("int") + 1, F.col("part_length").cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("part_start").alias("at"), F.hex(piece).alias("piece")))), lambda p: p["piece"])
    return parts.groupBy(*by).agg(F.unhex(F.array_join(ordered, "")).alias("payload"))


def read_modify_write(parts: DataFrame) -> DataFrame:
    """Blocks after a write: ``parts`` has ``in_block, data, block``; a null block is zeros."""
    zeros = F.unhex(F.repeat(F.lit("00"), BLOCK))
    return parts.withColumn("block", S.overlaid(F.coalesce("block", zeros), "data", "in_block"))


def mismatches(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks: ``expected``, ``actual``."""
    a, b = expected.select(*keys, F.col(value).alias("expected")), actual.select(*keys, F.col(value).alias("actual"))
    return a.join(b, keys, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def readback(written: DataFrame, device: DataFrame) -> DataFrame:
    """Written entries ``(disk_offset, seq, payload_crc32)`` that the device does not have so."""
    there = device.select("disk_offset", F.col("seq").alias("seq_there"), F.col("payload_crc32").alias("crc_there"))
    bad = ~(F.col("seq").eqNullSafe(F.col("seq_there")) & F.col("payload_crc32").eqNullSafe(F.col("crc_there")))
    return written.join(there, "disk_offset", "left").filter(bad)
