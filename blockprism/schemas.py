"""Tables, keys and constants of block metadata; schemas are in DDL, which needs no session."""

from __future__ import annotations

BLOCK = 4096
SECTOR = 512
#: Physical blocks below this belong to the store itself.
RESERVED = 8
MAX_ENTRY_BYTES = 2 << 20
#: A unit holds at most so many blocks or raw bytes.
MAX_UNIT_LBAS, MAX_UNIT_BYTES = 32, 128 << 10
MAX_EXTENT = (1 << 32) - 1
FLAG_DEDUP_SKIPPED = 1

#: Together they tell one stored fragment from another.
FRAGMENT = ["pba", "slot_offset", "compression", "unit_compressed_size", "unit_original_size", "unit_lba_count", "crc32"]
#: One block inside a fragment; and what a read decodes once.
PHYSICAL_BLOCK = [*FRAGMENT, "offset_in_unit"]
READ_UNIT = ["pba", "slot_offset", "unit_compressed_size"]


def fields(ddl: str) -> list[tuple[str, str]]:
    """Names and types of a schema below."""
    return [tuple(part.split(" ", 1)) for part in ddl.split(", ")]


_PHYSICAL = "pba bigint, compression tinyint, unit_compressed_size int, unit_original_size int, unit_lba_count int, offset_in_unit int, crc32 bigint, slot_offset int"
VOLUMES = "vol_id string, size_bytes bigint, block_size int, compression tinyint, compression_level int, created_at bigint, zone_count int"
BLOCKMAP = f"vol_id string, lba bigint, {_PHYSICAL}, flags tinyint"
REFCOUNT = "pba bigint, refcount bigint"
DEDUP_INDEX = f"hash binary, {_PHYSICAL}"
DEDUP_REVERSE = "pba bigint, hash binary"
WRITE_LOG = "seq bigint, vol_id string, start_lba bigint, lba_count int, payload_crc32 bigint, flushed boolean, vol_created_at bigint, payload binary, disk_offset bigint, disk_len int, shard int"
SHARD_CHECKPOINT = "shard int, head_offset bigint, tail_offset bigint, max_seq bigint, used_bytes bigint"
EXTENTS = "start_pba bigint, block_count bigint"
METRICS = "snapshot_ts timestamp, metric string, value bigint"
SHARD_SNAPSHOT = "shard_idx int, used_bytes bigint, capacity_bytes bigint, fill_pct int, pending_entries bigint, head_offset bigint, tail_offset bigint, log_order_len bigint, flushed_seqs_len bigint, head_seq bigint, head_remaining_lbas int, head_age_ms bigint, head_residency_ms bigint"
SOAK_EVENT = "event string, message string, ts double, worker int, kind string, offset bigint, length bigint, stamp bigint, mode string, detail string, first_bad_block_lba bigint, first_bad_block_index bigint, first_mismatch_byte bigint"
ENGINE_LOG = "line_no bigint, ts string, level string, target string, msg string"
