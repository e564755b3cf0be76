"""Codecs that Spark has no functions for: compression, checked units and fixed-layout records.

They are Arrow and pandas functions over batches; what built-ins can decode is
in ``scalars`` and in ``mapping_key`` and its like below.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprism.functions.scalars import big_endian, from_big_endian
from blockprism.schemas import BLOCK

_RAW, _LZ4, _ZSTD = 0, 1, 2
#: Results go back in pieces of about so many bytes, so a worker holds no second batch of them.
_PIECE_BYTES = 4 << 20


def compress_block(data: bytes, code: int, level: int = 3) -> tuple[int, bytes]:
    """The code used and the bytes: code 0 and the data itself where compression gains nothing."""
    if code == _LZ4:
        out = pa.Codec("lz4_raw").compress(data, asbytes=True)
    elif code == _ZSTD:
        out = zstandard.ZstdCompressor(level=level).compress(data)
    else:
        return _RAW, data
    return (code, out) if len(out) < len(data) else (_RAW, data)


def lz4_size(data: bytes) -> int | None:
    """Bytes that a raw LZ4 block stands for, from its sequences' lengths (the library does not tell); None if cut short."""
    at = total = 0

    def more(n: int) -> int:
        nonlocal at
        while n >= 15:
            n += data[at]
            at += 1
            if data[at - 1] < 255:
                break
        return n

    try:
        while True:
            token = data[at]
            at += 1
            literals = more(token >> 4)
            at, total = at + literals, total + literals
            if at == len(data):  # the last sequence is literals alone
                return total
            if at + 2 > len(data):
                return None
            at += 2
            total += more(token & 15) + 4
    except IndexError:
        return None


def decompress_block(data: bytes, code: int, size: int) -> bytes | None:
    """None if the data is damaged or does not have this size."""
    try:
        if code == _RAW:
            out = data
        elif code == _LZ4:
            out = pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True) if lz4_size(data) == size else b""
        elif code == _ZSTD:
            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
        else:
            return None
    except (OSError, zstandard.ZstdError, pa.ArrowException):
        return None
    return out if len(out) == size else None


def _give_back() -> None:
    """Memory that is free, which the allocators would keep, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def in_pieces(batches: Iterator[tuple[pa.Array, ...]], one: Callable[..., tuple], kind: pa.StructType) -> Iterator[pa.Array]:
    """What ``one`` makes of each row, a value and bytes, in arrays that end where the bytes reach the size of a piece or the batch ends."""

    def piece() -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*found, strict=True), kind, strict=True)], fields=list(kind))

    for batch in batches:
        _give_back()
        found, size = [], 0
        for row in zip(*batch, strict=True):
            found.append(one(*(x.as_py() for x in row)))
            size += len(found[-1][1] or b"")
            if size >= _PIECE_BYTES:
                yield piece()
                found, size = [], 0
        if found:
            yield piece()
        found = batch = row = None
    _give_back()


def compressed(payload: Column, code: Column, level: int = 3) -> Column:
    """``struct<code, data>`` of each payload."""

    def one(data, algorithm):
        return (None, None) if data is None else compress_block(data, int(algorithm), level)

    @F.arrow_udf("code tinyint, data binary")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return in_pieces(batches, one, pa.struct([("code", pa.int8()), ("data", pa.binary())]))

    return run(payload.cast("binary"), code)


def decoded_unit(data: Column, slot_offset: Column, compressed_size: Column, original_size: Column, code: Column, crc32: Column) -> Column:
    """``struct<status, payload>`` of what was read for a unit: bounds, then checksum, then decompression.

    Status is ok, out_of_bounds, bad_crc or bad_data.
    """

    def one(raw, at, size, original, algorithm, crc):
        if raw is None or at + size > len(raw):
            return "out_of_bounds", None
        part = raw[at : at + size]
        if zlib.crc32(part) != crc:
            return "bad_crc", None
        out = decompress_block(part, int(algorithm), int(original))
        return ("bad_data", None) if out is None else ("ok", out)

    @F.arrow_udf("status string, payload binary")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return in_pieces(batches, one, pa.struct([("status", pa.string()), ("payload", pa.binary())]))

    return run(data, slot_offset, compressed_size, original_size, code, crc32)


# Keys and values of the metadata store: big-endian, by built-in functions.

#: Fixed layout: field, byte and width within a mapping's 28 bytes.
_MAPPING = (("pba", 0, 8), ("compression", 8, 1), ("unit_compressed_size", 9, 4), ("unit_original_size", 13, 4), ("unit_lba_count", 17, 2), ("offset_in_unit", 19, 2), ("crc32", 21, 4), ("slot_offset", 25, 2), ("flags", 27, 1))
#: The same of a dedup entry's 27 bytes: the slot offset stands behind the block address, flags are missing.
_ENTRY = (("pba", 0, 8), ("slot_offset", 8, 2), ("compression", 10, 1), ("unit_compressed_size", 11, 4), ("unit_original_size", 15, 4), ("unit_lba_count", 19, 2), ("offset_in_unit", 21, 2), ("crc32", 23, 4))


def _encoded(layout, row) -> Column:
    return F.concat(*(big_endian(row(name), width) for name, _, width in layout))


def _decoded(layout, data: Column) -> Column:
    size = layout[-1][1] + layout[-1][2]
    return F.when(F.octet_length(data) == size, F.struct(*(from_big_endian(data, at, width).alias(name) for name, at, width in layout)))


def mapping_value(row=F.col) -> Column:
    return _encoded(_MAPPING, row)


def decoded_mapping(data: Column) -> Column:
    """A struct; null for data of another length."""
    return _decoded(_MAPPING, data)


def entry_value(row=F.col) -> Column:
    return _encoded(_ENTRY, row)


def decoded_entry(data: Column) -> Column:
    return _decoded(_ENTRY, data)


def mapping_key(lba) -> Column:
    return big_endian(lba, 8)


def legacy_key(vol_id: Column, lba: Column) -> Column:
    """Length and bytes of the volume's name, then the address."""
    return F.concat(big_endian(F.octet_length(vol_id), 1), vol_id.cast("binary"), big_endian(lba, 8))


def decoded_legacy_key(data: Column) -> Column:
    n = from_big_endian(data, 0, 1).cast("int")
    good = F.octet_length(data) == n + 9
    return F.when(good, F.struct(F.decode(F.substring(data, F.lit(2), n), "utf-8").alias("vol_id"), F.conv(F.hex(F.substring(data, n + 2, F.lit(8))), 16, 10).cast("bigint").alias("lba")))


def reverse_key(pba: Column, content: Column) -> Column:
    return F.concat(big_endian(pba, 8), content)


def decoded_reverse_key(data: Column) -> Column:
    return F.when(F.octet_length(data) == 40, F.struct(from_big_endian(data, 0, 8).alias("pba"), F.substring(data, 9, 32).alias("hash")))


def volume_key(vol_id: Column) -> Column:
    return F.concat(F.lit("vol-"), vol_id)


# Records of one block, little-endian, with a checksum over the record whose own field is zero.


class Record:
    """``fields`` are names and struct codes in order; one of them is ``crc32``."""

    def __init__(self, magic: int, version: int, fields: tuple[tuple[str, str], ...]):
        self.magic, self.version, self.names = magic, version, [n for n, _ in fields]
        self.layout = "<II" + "".join(code for _, code in fields)
        self.crc_at = struct.calcsize("<II" + "".join(code for _, code in fields[: self.names.index("crc32")]))

    def encode(self, **values) -> bytes:
        raw = struct.pack(self.layout, self.magic, self.version, *(0 if n == "crc32" else values[n] for n in self.names))
        crc = zlib.crc32(raw)
        return (raw[: self.crc_at] + struct.pack("<I", crc) + raw[self.crc_at + 4 :]).ljust(BLOCK, b"\0")

    def decode(self, data: bytes | None) -> dict | None:
        """None for a wrong magic number, version, checksum or length."""
        if data is None or len(data) < struct.calcsize(self.layout):
            return None
        raw = bytes(data[: struct.calcsize(self.layout)])
        magic, version, *values = struct.unpack(self.layout, raw)
        out = dict(zip(self.names, values, strict=True))
        zeroed = raw[: self.crc_at] + bytes(4) + raw[self.crc_at + 4 :]
        return out if (magic, version) == (self.magic, self.version) and zlib.crc32(zeroed) == out["crc32"] else None


#: Fixed layouts.
SUPERBLOCK = Record(0x4F4C5633, 1, (("device_uuid", "16s"), ("device_size_bytes", "Q"), ("creation_timestamp", "Q"), ("reserved_blocks", "I"), ("crc32", "I"), ("format_timestamp", "Q"), ("flags", "Q")))
HEARTBEAT = Record(0x4F484254, 1, (("timestamp_nanos", "Q"), ("node_id", "Q"), ("sequence", "Q"), ("crc32", "I")))
HA_LOCK = Record(0x4F48414C, 1, (("owner_node_id", "Q"), ("fence_token", "Q"), ("lease_start_nanos", "Q"), ("lease_duration_nanos", "Q"), ("crc32", "I")))
CHECKPOINT = Record(0x5348434B, 1, (("head_offset", "Q"), ("tail_offset", "Q"), ("max_seq", "Q"), ("used_bytes", "Q"), ("crc32", "I")))


def decode_checkpoint(data: bytes | None) -> dict | None:
    """A shard's checkpoint, whose checksum covers only what stands before it."""
    if data is None or len(data) < struct.calcsize(CHECKPOINT.layout):
        return None
    magic, version, *values = struct.unpack(CHECKPOINT.layout, bytes(data[: struct.calcsize(CHECKPOINT.layout)]))
    good = (magic, version) == (CHECKPOINT.magic, CHECKPOINT.version) and zlib.crc32(bytes(data[: CHECKPOINT.crc_at])) == values[-1]
    return dict(zip(CHECKPOINT.names, values, strict=True)) if good else None


def uuid_string(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


# Test data: blocks that follow from a seed, a state and their place.

_M64 = (1 << 64) - 1


def build_block(seed: int, state: int, index: int) -> bytes:
    """State 0 is zeros; else its low two bits choose how eight words are made of seed, stamp and index.

    The words of each kind are fixed values, as blocks written elsewhere have to compare equal.
    """
    kind, stamp = state & 3, state >> 2
    a, b, c = seed & _M64, stamp & _M64, index & _M64
    d = (a ^ b ^ (index * 0x9E3779B185EBCA87)) & _M64

    def turn(x: int, n: int) -> int:
        return (x << n | x >> (64 - n)) & _M64

    words = {
        1: [a, b, c, d] * 2,
        2: [d, c ^ 0xAAAAAAAAAAAAAAAA, b ^ 0x5555555555555555, a ^ 0x3333333333333333, a + c, b + d, a - b, c - d],
        3: [turn(a, 7), turn(b, 13), turn(c, 29), turn(d, 31), a ^ c, b ^ d, a + b + c, d + 0xD6E8FEB86659FD93],
    }
    if state == 0 or kind == 0:
        return bytes(BLOCK)
    return struct.pack("<8Q", *(x & _M64 for x in words[kind])) * (BLOCK // 64)


def first_mismatch(expected: Column, actual: Column) -> Column:
    """The first byte at which two payloads differ; a shorter one differs where it ends; null if they are equal."""

    @F.pandas_udf("bigint")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            n = min(len(x), len(y))
            differ = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
            out.append(int(differ[0]) if len(differ) else n if len(x) != len(y) else None)
        return pd.Series(out, dtype="Int64")

    return run(expected, actual)
