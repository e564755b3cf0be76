"""Scalar functions as column expressions, all of them built-in and so inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprism.schemas import BLOCK, FLAG_DEDUP_SKIPPED, RESERVED, SECTOR


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def idiv(a, b) -> Column:
    """Whole quotient of non-negative numbers, as bigint."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return F.call_function("div", a, b)


def blocks(size) -> Column:
    """Blocks that so many bytes take."""
    return F.shiftright(_c(size).cast("bigint") + (BLOCK - 1), 12)


def round_up(value, align: int) -> Column:
    value = _c(value).cast("bigint")
    return value + F.pmod(-value, F.lit(align).cast("bigint"))


def read_size(slot_offset, size) -> Column:
    """Bytes to read for a fragment: one block if it lies inside a slot, else its size in whole blocks."""
    return F.when(_c(slot_offset) > 0, F.lit(BLOCK).cast("bigint")).otherwise(round_up(size, BLOCK))


def slice_range(slot_offset, size) -> Column:
    start = _c(slot_offset).cast("bigint")
    return F.struct(start.alias("start"), (start + _c(size)).alias("end"))


def is_uncompressed(compression) -> Column:
    return _c(compression) == 0


def is_packed(size) -> Column:
    return _c(size) < BLOCK


def is_dedup_skipped(flags) -> Column:
    return _c(flags).bitwiseAND(FLAG_DEDUP_SKIPPED) != 0


def set_dedup_skipped(flags, skipped: bool) -> Column:
    return F.when(F.lit(skipped), _c(flags).bitwiseOR(FLAG_DEDUP_SKIPPED)).otherwise(_c(flags).bitwiseAND(~FLAG_DEDUP_SKIPPED)).cast("tinyint")


def zone_of(lba, zone_size: int, zones: int) -> Column:
    """Zone, or with shards in place of zones shard, of a block address; 0 if there is one."""
    return F.pmod(idiv(lba, zone_size), F.lit(zones).cast("bigint"))


def worker_of(pba, workers: int) -> Column:
    return F.pmod(_c(pba).cast("bigint"), F.lit(workers).cast("bigint"))


def stripe_of(key, stripes: int = 1024) -> Column:
    return F.pmod(F.xxhash64(_c(key)), F.lit(stripes).cast("bigint"))


def out_of_bounds(offset, length, size) -> Column:
    return _c(offset) + _c(length) > _c(size)


def is_aligned(offset, length) -> Column:
    return (_c(offset) % BLOCK == 0) & (_c(length) % BLOCK == 0)


def discard_range(offset, length, mode: str = "volume") -> Column:
    """Blocks ``[start, start + count)`` that a discard of bytes covers.

    A volume's discard takes whole blocks inside the range; a front end's takes the
    block of its offset and as many as its length has.
    """
    offset, length = _c(offset).cast("bigint"), _c(length).cast("bigint")
    if mode == "frontend":
        return F.struct(F.shiftright(offset, 12).alias("start"), F.shiftright(length, 12).alias("count"))
    start = blocks(offset)
    return F.struct(start.alias("start"), F.greatest(F.shiftright(offset + length, 12) - start, F.lit(0).cast("bigint")).alias("count"))


def sector_bytes(sector) -> Column:
    return _c(sector).cast("bigint") * SECTOR


def device_offset(pba, slot_offset=0) -> Column:
    return (_c(pba).cast("bigint") + RESERVED) * BLOCK + _c(slot_offset)


def dead_ratio(live, total) -> Column:
    return F.lit(1.0) - _c(live).cast("double") / _c(total).cast("double")


def free_percent(free, total) -> Column:
    return F.when(_c(total) > 0, idiv(_c(free) * 100, _c(total))).otherwise(F.lit(0).cast("bigint"))


#: Above so many percent free, garbage is collected from this dead ratio.
GC_BANDS = ((50, 0.70), (30, 0.50), (10, 0.30))


def gc_threshold(percent, configured: float = 0.25) -> Column:
    out = F.lit(configured)
    for above, ratio in reversed(GC_BANDS):
        out = F.when(_c(percent) > above, F.lit(ratio)).otherwise(out)
    return out


def fill_percent(used, capacity) -> Column:
    return F.when(_c(capacity) == 0, F.lit(100).cast("bigint")).otherwise(idiv(_c(used) * 100, F.greatest(_c(capacity), F.lit(1))))


def skips_dedup(fill, threshold: int) -> Column:
    return _c(fill) > threshold


def hydrates(memory, limit, seq, head_seq) -> Column:
    """Over the memory limit only the head of the queue is loaded."""
    return (_c(memory) < _c(limit)) | (_c(seq) == _c(head_seq))


def is_stale(created_at, current, zero_is_wildcard: bool = False) -> Column:
    """Whether a write belongs to a volume that is gone (``current`` null) or was made anew."""
    stale = _c(current).isNull() | (_c(created_at) != _c(current))
    return (_c(created_at) != 0) & stale if zero_is_wildcard else stale


def mode(has_data, has_meta) -> Column:
    """What is configured: nothing of both, metadata alone, all."""
    return F.when(~_c(has_meta), "bare").when(~_c(has_data), "standby").otherwise("active")


def lease_expired(now, renewed, ttl) -> Column:
    return _c(now) > _c(renewed) + _c(ttl)


def lease_left(now, renewed, ttl) -> Column:
    return F.greatest(_c(renewed) + _c(ttl) - _c(now), F.lit(0).cast("bigint"))


def content_hash(payload) -> Column:
    """32 bytes as hex; equal blocks have equal hashes."""
    return F.sha2(_c(payload), 256)


def block_slice(payload, index) -> Column:
    return F.substring(_c(payload), _c(index).cast("int") * BLOCK + 1, F.lit(BLOCK))


def padded(payload) -> Column:
    """Zero-filled to a block."""
    return F.rpad(_c(payload), BLOCK, F.unhex(F.lit("00")))


def overlaid(block, data, at) -> Column:
    """The block with ``data`` from byte ``at`` on (0 is its first)."""
    return F.overlay(_c(block), _c(data), _c(at).cast("int") + 1)


#: Fixed values.
COMPRESSIONS = ("none", "lz4", "zstd")
#: Codes of the C interface by the kind of error; any other kind is internal.
ERROR_CODES = {"ok": 0, "null": -1, "invalid": -2, "out_of_bounds": -2, "invalid_lba": -2, "io": -3, "meta": -3, "not_found": -4, "deleted": -4, "no_space": -5, "config": -6}
INTERNAL = -7


def compression_name(code) -> Column:
    at = F.coalesce(_c(code).cast("int"), F.lit(-1))
    return F.when(at.between(0, 2), F.element_at(F.array(*map(F.lit, COMPRESSIONS)), F.least(F.greatest(at, F.lit(0)), F.lit(2)) + 1))


def compression_code(name) -> Column:
    at = F.array_position(F.array(*map(F.lit, COMPRESSIONS)), F.lower(_c(name)))
    return F.when(at > 0, at - 1).cast("tinyint")


def error_code(kind) -> Column:
    """0 for ok, else the negative code of the kind of error."""
    codes = F.create_map(*(F.lit(x) for pair in ERROR_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, _c(kind)), F.lit(INTERNAL))


def big_endian(value, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(_c(value).cast("bigint")), 2 * width, "0"))


def from_big_endian(data, at: int, width: int) -> Column:
    """The unsigned number in ``width`` bytes from byte ``at``; null if the data ends before."""
    part = F.substring(_c(data), at + 1, width)
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("bigint"))


#: Suffixes and their powers of two, or seconds.
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
_SHORT_UNITS = {"k": 10, "m": 20, "g": 30, "t": 40}
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def _scaled(text: Column, scales: dict[str, int], fractions: bool) -> Column:
    """A whole number and a suffix; with ``fractions`` any number before a suffix, cut to a whole result."""
    text = F.lower(F.trim(text))
    whole = r"^(\d+)([a-z]*)$"
    number, unit = (F.regexp_extract(text, whole, k) for k in (1, 2))
    scale = F.create_map(*(F.lit(x) for name, n in scales.items() for x in (name, n)))
    out = F.when(number != "", F.try_multiply(number.try_cast("bigint"), F.try_element_at(scale, unit).cast("bigint")))
    if not fractions:
        return out
    part = r"^([+-]?(?:\d+\.?\d*|\.\d+)) *([a-z])$"
    scaled = F.regexp_extract(text, part, 1).try_cast("double") * F.try_element_at(scale, F.regexp_extract(text, part, 2))
    return F.when(number != "", out).otherwise(scaled.try_cast("bigint"))


def parse_size(text, fractions: bool = False) -> Column:
    """Bytes of ``4k``, ``2MB``...; null for what is no size or overflows.

    There are two grammars: whole numbers with or without a ``b`` behind the letter,
    or ``fractions`` such as ``1.5g`` with one letter.
    """
    return _scaled(_c(text), {u: 1 << s for u, s in ({"": 0} | _SHORT_UNITS if fractions else _UNITS).items()}, fractions)


def parse_duration(text) -> Column:
    """Seconds of ``90``, ``15m``, ``1.5h``, ``1d``; null otherwise."""
    return _scaled(_c(text), {"": 1} | _SECONDS, True)


def human_bytes(n) -> Column:
    n = _c(n).cast("double")
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for name, shift in (("KiB", 10), ("MiB", 20), ("GiB", 30), ("TiB", 40)):
        value = n.cast("decimal(20,0)") / F.lit(1 << shift).cast("decimal(20,0)")
        out = F.when(n >= 1 << shift, F.concat(F.bround(value, F.lit(2)).cast("decimal(38,2)").cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out


def human_seconds(s) -> Column:
    """Whole seconds as ``1d2h3m4s``, without parts that are zero."""
    left, parts = _c(s).cast("bigint"), []
    for name, unit in reversed(_SECONDS.items()):
        n = idiv(left, unit)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(""))
        left = left % unit
    return F.when(_c(s).cast("bigint") < 1, "0s").otherwise(F.concat(*parts))


def human_nanoseconds(ns) -> Column:
    """Nanoseconds in the largest unit of which there is one, with three decimals above ``ns``; a half of the last goes up."""
    ns = _c(ns).cast("bigint")
    out = F.concat(ns.cast("string"), F.lit("ns"))
    for name, scale in (("us", 1e3), ("ms", 1e6), ("s", 1e9)):
        out = F.when(ns >= int(scale), F.concat(F.format_string("%.3f", ns / F.lit(scale)), F.lit(name))).otherwise(out)
    return out


#: What terminal colours, block addresses, hexadecimal and decimal numbers look like.
COLOUR, ADDRESS, HEXADECIMAL, DECIMAL = "\x1b\\[[0-9;]*[A-Za-z]", r"Pba\(\d+\)", r"\b0x[0-9a-fA-F]+\b", r"\b\d+\b"


def plain(message) -> Column:
    """Without terminal colours."""
    return F.regexp_replace(_c(message), COLOUR, "")


def normalised(message) -> Column:
    """Addresses, hexadecimal and decimal numbers replaced, in this order."""
    out = F.regexp_replace(plain(message), ADDRESS, "Pba(#)")
    return F.regexp_replace(F.regexp_replace(out, HEXADECIMAL, "0x#"), DECIMAL, "#")
