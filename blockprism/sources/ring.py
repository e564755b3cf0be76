"""The write log's ring as binary files: records of whole blocks, one file per shard."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.functions.codecs import HA_LOCK, HEARTBEAT, SUPERBLOCK, decode_checkpoint
from blockprism.schemas import BLOCK, MAX_ENTRY_BYTES

#: Fixed layout: length, magic, seq, start, blocks, name's length, flushed, version, payload and entry checksums, generation.
_HEAD = struct.Struct("<IIQQIHBBIIQ")
_MAGIC = 0x42454E54
_CRC_AT = 36
#: The checksum covers all, or the header; in the third the payload follows in the next block.
_FULL, _COMPACT, _DIRECT = 1, 2, 3
ENTRY = "disk_offset bigint, disk_len int, seq bigint, vol_id string, start_lba bigint, lba_count int, payload_crc32 bigint, flushed boolean, vol_created_at bigint, payload binary"


def _round(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def encode_entry(seq: int, vol_id: str, start_lba: int, payload: bytes, flushed: bool = False, created_at: int = 0, version: int = _FULL) -> bytes:
    name = vol_id.encode()
    if not 1 <= len(name) <= 255 or not payload or len(payload) % BLOCK:
        raise ValueError("a name of 1 to 255 bytes and whole blocks of payload are needed")
    raw = _HEAD.size + len(name) + len(payload)
    total = BLOCK + len(payload) if version == _DIRECT else _round(raw)
    payload_crc = zlib.crc32(payload) if version == _FULL else 0
    head = _HEAD.pack(total, _MAGIC, seq, start_lba, len(payload) // BLOCK, len(name), flushed, version, payload_crc, 0, created_at) + name
    covered = head + payload if version == _FULL else head
    crc = zlib.crc32(covered[_CRC_AT + 4 :], zlib.crc32(covered[:_CRC_AT]))
    head = head[:_CRC_AT] + struct.pack("<I", crc) + head[_CRC_AT + 4 :]
    return head.ljust(BLOCK, b"\0") + payload if version == _DIRECT else (head + payload).ljust(total, b"\0")


def decode_entry(data: bytes, at: int, with_payload: bool = True) -> tuple | None:
    """The entry at byte ``at``, in the order of ``ENTRY``; None if there is no valid one."""
    if at + BLOCK > len(data):
        return None
    total, magic, seq, start, count, n_name, flushed, version, payload_crc, crc, created = _HEAD.unpack_from(data, at)
    if magic != _MAGIC or not BLOCK <= total <= MAX_ENTRY_BYTES or at + _round(total) > len(data) or version not in (_FULL, _COMPACT, _DIRECT):
        return None
    if not 1 <= n_name <= 255 or not count:
        return None
    name_end = at + _HEAD.size + n_name
    begin = at + BLOCK if version == _DIRECT else name_end
    end = begin + count * BLOCK
    if end > at + total:
        return None
    covered = end if version == _FULL else name_end
    if zlib.crc32(data[at + _CRC_AT + 4 : covered], zlib.crc32(data[at : at + _CRC_AT])) != crc:
        return None
    payload = data[begin:end]
    if version == _FULL and zlib.crc32(payload) != payload_crc:
        return None
    try:
        name = data[at + _HEAD.size : name_end].decode()
    except UnicodeDecodeError:
        return None
    return at, _round(total), seq, name, start, count, zlib.crc32(payload), bool(flushed), created, payload if with_payload else None


def entries(data: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """All valid entries of a shard's bytes; a block that begins none is skipped."""
    at = 0
    while at < len(data):
        found = decode_entry(data, at, with_payload)
        if found:
            yield found
        at += found[1] if found else BLOCK


def read_ring(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Entries of all shards' files, ``shard`` being the number in a file's name."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        for frame in frames:
            for shard, content in zip(frame["shard"], frame["content"], strict=True):
                rows = pd.DataFrame(entries(content, with_payload), columns=names)
                yield rows.assign(shard=shard)

    files = spark.read.format("binaryFile").load(path)
    numbered = files.select(F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).try_cast("int").alias("shard"), "content")
    return numbered.mapInPandas(parse, f"{ENTRY}, shard int")


def records(blocks: DataFrame, column: str = "data") -> DataFrame:
    """``blocks`` with what its data is: ``kind``, and the record's fields as JSON; null if it is no valid record."""
    import json

    @F.pandas_udf("kind string, fields string")
    def run(found: pd.Series) -> pd.DataFrame:
        out = []
        for data in found:
            pairs = (("superblock", SUPERBLOCK.decode(data)), ("heartbeat", HEARTBEAT.decode(data)), ("ha_lock", HA_LOCK.decode(data)), ("checkpoint", decode_checkpoint(data)))
            kind, fields = next(((k, v) for k, v in pairs if v), (None, None))
            out.append((kind, json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in fields.items()}) if fields else None))
        return pd.DataFrame(out, columns=["kind", "fields"])

    return blocks.withColumn("_r", run(column)).select(*blocks.columns, "_r.kind", "_r.fields")
