"""Scalars, codecs, sources and streams."""

from __future__ import annotations

import contextlib
import json
import random
import re
import uuid
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from blockprism.functions import codecs
from blockprism.functions import scalars as S
from blockprism.sources import logs, ring, tables
from blockprism.streaming import jobs


def value(spark, *columns):
    out = tuple(spark.range(1).select(*columns).first())
    return out[0] if len(out) == 1 else out


@pytest.mark.parametrize(("text", "size"), [("4096", 4096), ("4k", 4096), (" 2MB ", 2 << 20), ("2 MB", None), ("1.5g", None), ("1g", 1 << 30), ("3T", 3 << 40), ("5x", None), ("", None), ("99999999999t", None), ("7b", 7)])
def test_sizes(spark, text, size):
    assert value(spark, S.parse_size(F.lit(text))) == size


def test_durations_and_formats(spark):
    assert value(spark, *(S.parse_duration(F.lit(x)) for x in ("90", "15m", "2h", "1d", "1y", "1.5h"))) == (90, 900, 7200, 86400, None, 5400)
    assert value(spark, *(S.parse_size(F.lit(x), fractions=True) for x in ("1.5g", "7", "2k", "2kb", "x"))) == (3 << 29, 7, 2048, None, None)
    assert value(spark, *(S.human_bytes(F.lit(n)) for n in (0, 1023, 1536, 5 << 30))) == ("0 B", "1023 B", "1.50 KiB", "5.00 GiB")
    assert value(spark, *(S.human_seconds(F.lit(n)) for n in (3723, 90_061, 60, 0))) == ("1h2m3s", "1d1h1m1s", "1m", "0s")
    assert value(spark, *(S.human_nanoseconds(F.lit(n)) for n in (999, 1500, 2_000_000, 3_250_000_000))) == ("999ns", "1.500us", "2.000ms", "3.250s")


def test_sizes_of_reads(spark):
    assert value(spark, *(S.blocks(F.lit(n)) for n in (0, 1, 4096, 4097))) == (0, 1, 1, 2)
    assert value(spark, S.read_size(F.lit(0), F.lit(5000)), S.read_size(F.lit(64), F.lit(100)), S.round_up(F.lit(8192), 4096)) == (8192, 4096, 8192)
    assert value(spark, S.device_offset(F.lit(2), F.lit(16))) == 10 * 4096 + 16


def test_discards(spark):
    a, b = S.discard_range(F.lit(100), F.lit(10_000)), S.discard_range(F.lit(100), F.lit(10_000), "frontend")
    assert value(spark, a["start"], a["count"], b["start"], b["count"]) == (1, 1, 0, 2)
    assert value(spark, S.discard_range(F.lit(100), F.lit(200))["count"]) == 0


def test_bands_and_codes(spark):
    assert value(spark, *(S.gc_threshold(F.lit(p)) for p in (51, 50, 30, 10))) == (0.7, 0.5, 0.3, 0.25)
    assert value(spark, *(S.compression_code(F.lit(n)) for n in ("LZ4", "none", "snappy"))) == (1, 0, None)
    assert value(spark, *(S.compression_name(F.lit(n)) for n in (2, 9))) == ("zstd", None)
    assert value(spark, *(S.error_code(F.lit(n)) for n in ("ok", "io", "meta", "invalid", "no_space", "config", "what"))) == (0, -3, -3, -2, -5, -6, -7)
    assert value(spark, S.mode(F.lit(False), F.lit(True)), S.mode(F.lit(True), F.lit(False))) == ("standby", "bare")
    assert value(spark, S.lease_left(F.lit(50), F.lit(10), F.lit(30)), S.lease_expired(F.lit(41), F.lit(10), F.lit(30))) == (0, True)
    assert value(spark, S.hydrates(F.lit(9), F.lit(5), F.lit(1), F.lit(1)), S.hydrates(F.lit(9), F.lit(5), F.lit(2), F.lit(1))) == (True, False)


def test_normalised_messages(spark):
    assert value(spark, S.normalised(F.lit("\x1b[31mPba(12)\x1b[0m at 0xdeadBEEF in v12 took 33"))) == "Pba(#) at 0x# in v12 took #"


def test_store_codecs(spark):
    row = {"pba": 1 << 40, "compression": 2, "unit_compressed_size": 70000, "unit_original_size": 131072, "unit_lba_count": 32, "offset_in_unit": 31, "crc32": 4294967295, "slot_offset": 4000, "flags": 1}
    coded, entry = codecs.mapping_value(lambda n: F.lit(row[n])), codecs.entry_value(lambda n: F.lit(row[n]))
    assert value(spark, F.octet_length(coded), F.octet_length(entry)) == (28, 27)
    assert value(spark, codecs.decoded_mapping(coded)).asDict() == row
    assert value(spark, codecs.decoded_entry(entry)).asDict() == {k: v for k, v in row.items() if k != "flags"}
    assert value(spark, codecs.decoded_mapping(F.substring(coded, 1, 27))) is None
    key = codecs.legacy_key(F.lit("völ"), F.lit(77))
    assert value(spark, codecs.decoded_legacy_key(key)).asDict() == {"vol_id": "völ", "lba": 77}
    back = codecs.decoded_reverse_key(codecs.reverse_key(F.lit(5), F.unhex(F.lit("ab" * 32))))
    assert value(spark, back["pba"], F.hex(back["hash"])) == (5, "AB" * 32)


@pytest.mark.parametrize("code", [0, 1, 2])
def test_compression(code):
    data = b"abcd" * 2048
    used, out = codecs.compress_block(data, code)
    assert used == code and codecs.decompress_block(out, used, len(data)) == data
    noise = random.Random(1).randbytes(4096)
    assert codecs.compress_block(noise, code) == (0, noise)
    assert codecs.decompress_block(out, used, len(data) + 1) is None
    assert code == 0 or codecs.decompress_block(b"\xff" * 9, code, 4096) is None


def test_decoded_unit_reports_what_is_wrong(spark):
    used, out = codecs.compress_block(b"x" * 8192, 2)
    rows = [(bytearray(b"zz" + out), 2, len(out), 8192, used, zlib.crc32(out)), (bytearray(out), 0, len(out) + 1, 8192, used, 0), (bytearray(out), 0, len(out), 8192, used, 1), (bytearray(out), 0, len(out), 4096, used, zlib.crc32(out))]
    df = spark.createDataFrame(rows, "d binary, a int, n int, o int, c tinyint, crc bigint")
    got = [r["s"] for r in df.select(codecs.decoded_unit(*(F.col(c) for c in df.columns))["status"].alias("s")).collect()]
    assert got == ["ok", "out_of_bounds", "bad_crc", "bad_data"]


def test_units_of_any_size_keep_their_place(spark):
    """Nulls, empty payloads and some beyond a piece, both ways in one projection."""
    texts = [None, b"", b"ab" * 3_000_000, random.Random(2).randbytes(5 << 20), b"z", None, *(bytes([i]) * 300_000 for i in range(40)), b""]
    rows = [(i, t and bytearray(t), i % 3) for i, t in enumerate(texts)]
    rows[1], rows[-1] = (1, bytearray(), 1), (len(texts) - 1, bytearray(), 2)
    df = spark.createDataFrame(rows, "i int, p binary, c int").coalesce(1)
    units = df.select("i", "p", codecs.compressed(F.col("p"), F.col("c")).alias("u"), codecs.compressed(F.col("p"), F.lit(2)).alias("v"))
    back = [codecs.decoded_unit(F.col(f"{x}.data"), F.lit(0), F.octet_length(f"{x}.data"), F.octet_length("p"), F.col(f"{x}.code"), F.crc32(f"{x}.data")) for x in "uv"]
    found = units.select("i", "p", F.col("u.code").alias("code"), back[0].alias("a"), back[1].alias("b")).orderBy("i").collect()
    assert [r["i"] for r in found] == list(range(len(texts)))
    for r, t in zip(found, texts, strict=True):
        assert (r["a"]["status"], r["b"]["status"]) == (("out_of_bounds",) * 2 if t is None else ("ok", "ok"))
        assert r["a"]["payload"] == r["b"]["payload"] == r["p"] == t
    assert [r["code"] for r in found[:6]] == [None, 0, 2, 0, 0, None]


@pytest.mark.skipif(not Path("/proc/self/environ").exists(), reason="reads the workers' peaks from /proc")
def test_workers_hold_few_copies_of_a_batch(spark, monkeypatch):
    """96 MB there and back: no worker takes the room of three times as much (223 MB; 358 when a batch of results was made at once)."""
    mark = uuid.uuid4().hex
    monkeypatch.setitem(spark.sparkContext.environment, "WORKERS_OF", mark)  # so that these are new workers
    df = spark.range(0, 96, 1, 1).select(F.repeat(F.char(F.col("id") % 26 + 65), 1 << 20).cast("binary").alias("p"))
    units = df.withColumn("u", codecs.compressed(F.col("p"), F.lit(0))).select("p", "u.code", "u.data")
    back = codecs.decoded_unit(F.col("data"), F.lit(0), F.octet_length("data"), F.octet_length("p"), F.col("code"), F.crc32("data"))
    assert units.withColumn("b", back).filter("b.status = 'ok' and b.payload = p").count() == 96
    peaks = []
    for at in Path("/proc").glob("[0-9]*"):
        with contextlib.suppress(OSError):
            if mark.encode() in (at / "environ").read_bytes():
                peaks.append(int(re.search(r"VmHWM:\s+(\d+)", (at / "status").read_text())[1]) >> 10)
    assert len(peaks) >= 2 and max(peaks) < 3 * 96, peaks


def test_records():
    found = codecs.HEARTBEAT.encode(timestamp_nanos=5, node_id=6, sequence=7)
    assert len(found) == 4096 and codecs.HEARTBEAT.decode(found)["sequence"] == 7
    assert codecs.HA_LOCK.decode(found) is None and codecs.HEARTBEAT.decode(found[:9] + b"\1" + found[10:]) is None
    block = codecs.SUPERBLOCK.encode(device_uuid=bytes(range(16)), device_size_bytes=1, creation_timestamp=2, reserved_blocks=8, format_timestamp=3, flags=1)
    assert codecs.SUPERBLOCK.decode(block)["reserved_blocks"] == 8 and codecs.SUPERBLOCK.crc_at == 44


def test_record_scan_and_uuid(spark):
    beat = codecs.HEARTBEAT.encode(timestamp_nanos=5, node_id=6, sequence=7)
    df = spark.createDataFrame([(1, bytearray(beat)), (2, bytearray(4096)), (3, None)], "id int, data binary")
    assert [(r["kind"], r["fields"] and json.loads(r["fields"])["node_id"]) for r in ring.records(df).orderBy("id").collect()] == [("heartbeat", 6), (None, None), (None, None)]
    assert value(spark, codecs.uuid_string(F.unhex(F.lit("00112233445566778899aabbccddeeff")))) == "00112233-4455-6677-8899-aabbccddeeff"


def test_generated_blocks(spark):
    a, b = codecs.build_block(7, 4 * 9 + 1, 3), codecs.build_block(7, 4 * 9 + 2, 3)
    assert len(a) == 4096 and a != b and codecs.build_block(7, 0, 3) == bytes(4096) == codecs.build_block(7, 4, 3)
    df = spark.createDataFrame([(bytearray(b"abc"), bytearray(b"abd")), (bytearray(b"ab"), bytearray(b"abc")), (bytearray(b"a"), bytearray(b"a"))], "x binary, y binary")
    assert [r[0] for r in df.select(codecs.first_mismatch(F.col("x"), F.col("y"))).collect()] == [2, 2, None]


@pytest.mark.parametrize("version", [1, 2, 3])
def test_ring_entries(version):
    data = ring.encode_entry(5, "vol", 9, b"\7" * 8192, True, 44, version)
    assert len(data) % 4096 == 0
    at, size, seq, name, start, count, crc, flushed, created, payload = ring.decode_entry(bytes(4096) + data, 4096)
    assert (at, size, seq, name, start, count, flushed, created, payload) == (4096, len(data), 5, "vol", 9, 2, True, 44, b"\7" * 8192)
    assert crc == zlib.crc32(payload)
    assert ring.decode_entry(data[:8] + b"\xee" + data[9:], 0) is None
    with pytest.raises(ValueError):
        ring.encode_entry(1, "x" * 256, 0, bytes(4096))


def test_ring_files(spark, tmp_path):
    body = ring.encode_entry(1, "a", 0, bytes(4096)) + b"\1" * 4096 + ring.encode_entry(2, "b", 4, bytes(4096), version=3)
    (tmp_path / "shard-2.bin").write_bytes(body)
    (tmp_path / "shard-0.bin").write_bytes(bytes(8192))
    found = ring.read_ring(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["shard"], r["seq"], r["vol_id"], r["disk_offset"], r["lba_count"]) for r in found] == [(2, 1, "a", 0, 1), (2, 2, "b", 12288, 1)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"event":"failure","message":"m","ts":1.5}\n\nnot json\n{"kind":"read","offset":5}\n')
    assert [(r["event"], r["kind"], r["offset"]) for r in logs.soak_events(spark, str(tmp_path)).collect()] == [("failure", None, None), (None, "read", 5)]
    logs.write_events(logs.soak_events(spark, str(tmp_path / "e.jsonl")), str(tmp_path / "out"))
    logs.write_events(logs.soak_events(spark, str(tmp_path / "e.jsonl")), str(tmp_path / "out"))
    assert logs.soak_events(spark, str(tmp_path / "out")).count() == 4
    logs.write_summary(spark.createDataFrame([(1, True)], "seed int, final boolean"), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first()["final"] is True
    lines = spark.createDataFrame([("2024-01-01T00 \x1b[33mWARN\x1b[0m a::b: hello there",), ("junk",)], "value string")
    assert [tuple(r) for r in logs.log_lines(lines).collect()] == [("2024-01-01T00", "WARN", "a::b", "hello there")]
    hinted = spark.createDataFrame([("thread panicked",), ("junk",)], "value string")
    assert [tuple(r) for r in logs.log_lines(hinted, hints="panic").collect()] == [("", "TEXT", "", "thread panicked")]
    files = spark.createDataFrame([("/r/1/summary.json",), ("/r/3/x",), ("/r/2/summary.json",)], "path string")
    assert logs.latest_run(files).first()["run"] == "/r/2"
    settings = {(r["section"], r["name"]): r["value"] for r in logs.config(spark, '[gc]\nbuffer_usage_max_pct = 70\n[meta]\npath = "/x"\n').collect()}
    assert settings["gc", "buffer_usage_max_pct"] == "70" and settings["dedup", "workers"] == "2" and settings["buffer", "shards"] == "4" and settings["meta", "path"] == "/x" and settings["ha", "enabled"] == "false"


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("b", 5), ("a", 6)], "vol_id string, size_bytes bigint")
    assert [r["vol_id"] for r in tables.list_volumes(rows).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="bad volume"):
        tables.list_volumes(rows.unionByName(spark.createDataFrame([(None, 1)], rows.schema))).collect()
    counts = spark.createDataFrame([(1, 2)], "pba bigint, refcount bigint")
    tables.write(counts, str(tmp_path), "refcount")
    assert tables.read(spark, str(tmp_path), "refcount").collect() == counts.collect()
    blocks = spark.createDataFrame([(1, bytearray(b"a" * 4096)), (2, bytearray(b"b" * 4096))], "pba bigint, data binary")
    got = tables.device_blocks(blocks, spark.createDataFrame([(7, 1, 4100)], "id int, pba bigint, size bigint")).first()["data"]
    assert bytes(got) == b"a" * 4096 + b"bbbb"
    assert json.loads(tables.volumes_json(rows).first()["json"])[0] == {"vol_id": "a", "size_bytes": 6}
    assert json.loads(tables.status_json(v=counts).first()["json"]) == {"v": {"pba": 1, "refcount": 2}}


# Streams


def test_late_writes_change_nothing(spark, tmp_path):
    schema = "vol_id string, lba bigint, seq bigint"
    (tmp_path / "in").mkdir()
    stream = jobs.log_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    for k, batch in enumerate([[("a", 1, 5), ("a", 2, 1)], [("a", 1, 3), ("a", 2, 8)], [("a", 1, 5)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.maintain(jobs.current_map(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert k < 2 or sorted(map(tuple, jobs.maintained(spark, str(tmp_path / "out")).collect())) == [("a", 1, 5), ("a", 2, 8)]


def test_stream_windows_and_generations(spark, tmp_path):
    from datetime import datetime

    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, s), "read", 10, 1) for s in (1, 2, 40)], "ts timestamp_ntz, kind string, length bigint, node_id int")
    assert sorted((r["n"], r["bytes"]) for r in jobs.reports(rows, every="30 seconds").collect()) == [(1, 10), (2, 20)]
    assert sorted(r["beats"] for r in jobs.heartbeat_sessions(rows).collect()) == [1, 2]
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "vol_id string, vol_created_at bigint")
    assert [tuple(r) for r in jobs.fresh(log, spark.createDataFrame([("a", 2)], "vol_id string, created_at bigint")).collect()] == [("a", 2)]
