"""Queries of single operators: lookups, upkeep, policies and formats, each beside DuckDB SQL of what it means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprism.functions import scalars as S
from blockprism.operators import blockmap, dedup, ops, readpath, writelog
from blockprism.plans.catalogue import query
from blockprism.plans.derive import Derived
from blockprism.sources import logs, tables

KEY = ["vol_id", "lba"]


# Tables and lookups


@query("SELECT vol_id, size_bytes, created_at FROM vols", "vols")
def volumes_listed(d):
    return tables.list_volumes(d.volumes).select("vol_id", "size_bytes", "created_at")


@query("SELECT vol_id, size_bytes, created_at FROM vols WHERE vol_id = 'vol-1'", "vols")
def volume_lookup(d):
    return tables.volume(d.volumes, "vol-1").select("vol_id", "size_bytes", "created_at")


@query("SELECT vol_id, size_bytes, created_at FROM vols WHERE vol_id IN ('vol-2', 'vol-0')", "vols")
def volumes_resolved(d):
    return blockmap.resolved(d.volumes, ["vol-2", "vol-0"]).select("vol_id", "size_bytes", "created_at")


@query("SELECT p AS pos, w AS lba, pba FROM (SELECT unnest([5, 9, 5, 4000, 17]) AS w, unnest(range(0, 5)) AS p) LEFT JOIN bm ON bm.vol_id = 'vol-1' AND bm.lba = w", "bm")
def mapping_lookup(d):
    wanted = blockmap.requests(d.spark, [5, 9, 5, 4000, 17], "lba", "bigint")
    return blockmap.mappings(d.blockmap, "vol-1", wanted).select(F.col("pos").cast("bigint").alias("pos"), "lba", "pba")


@query("SELECT p AS pba, (SELECT count(*) FROM bm WHERE bm.pba = p) AS n, (SELECT count(*) > 0 FROM bm WHERE bm.pba = p) AS there FROM (SELECT unnest([8, 109, 500, 990]) AS p)", "bm")
def reference_counts(d):
    found = [(p, blockmap.count_references(d.blockmap, p), blockmap.has_reference(d.blockmap, p)) for p in (8, 109, 500, 990)]
    return d.spark.createDataFrame(found, "pba bigint, n bigint, there boolean")


@query("SELECT pba, refcount FROM idxc WHERE refcount > 0", "idxc")
def counts_above_zero(d):
    return blockmap.live_refcounts(d.index_counts)


@query("SELECT hash, pba FROM idx WHERE pba % 5 <> 0", "idx")
def whole_hashes(d):
    """Entries of which one in five has lost a byte of its key."""
    keys = F.unhex(F.when(F.col("pba") % 5 == 0, F.substring("hash", 1, 62)).otherwise(F.col("hash")))
    return tables.dedup_entries(d.index.withColumn("hash", keys)).select(F.lower(F.hex("hash")).alias("hash"), "pba")


@query("SELECT k AS shard, k * 8192 AS start, CASE WHEN k = 3 THEN 36000 - 3 * 8192 ELSE 8192 END AS length FROM (SELECT unnest(range(0, 4)) AS k)")
def shard_ranges(d):
    return d.spark.createDataFrame(writelog.shard_layout(36_000, 4), "shard bigint, start bigint, length bigint")


_TWICE = "g2 AS (SELECT * FROM gens UNION ALL SELECT seq, vol_id, lba, vol_created_at + 1 FROM gens WHERE seq % 3 = 0)"


@query(f"+{_TWICE} SELECT vol_id, lba, seq, vol_created_at FROM (SELECT *, row_number() OVER (PARTITION BY vol_id, lba ORDER BY seq DESC, vol_created_at DESC) AS k FROM g2) WHERE k = 1", "gens")
def current_entries(d):
    again = d.generations.filter("seq % 3 = 0").withColumn("vol_created_at", F.col("vol_created_at") + 1)
    return writelog.current_entry(d.generations.unionByName(again)).select("vol_id", "lba", "seq", "vol_created_at")


# Upkeep of the block map and its counts


_BATCH = "b AS (SELECT * FROM bm WHERE seq >= (SELECT max(event_id) // 2 FROM events))"


def _half(d: Derived) -> DataFrame:
    """Of the map, the mappings that the second half of the events made."""
    half = F.broadcast(d.events.agg(F.floor(F.max("event_id") / 2).alias("half")))
    return d.blockmap.join(half, F.col("seq") >= F.col("half")).drop("half")


@query(f"+{_BATCH} SELECT vol_id, lba, pba FROM bm0 ANTI JOIN b USING (vol_id, lba) UNION ALL SELECT vol_id, lba, pba FROM b", "bm", "bm0")
def mappings_upserted(d):
    return blockmap.upserted(d.blockmap_before, _half(d)).select("vol_id", "lba", "pba")


@query("SELECT vol_id, lba, pba FROM bm ANTI JOIN reqs USING (vol_id, lba)", "bm", "reqs")
def mappings_deleted(d):
    return blockmap.deleted(d.blockmap, d.requests).select("vol_id", "lba", "pba")


@query(f"+{_BATCH} SELECT pba, refcount FROM stored WHERE pba NOT IN (SELECT pba FROM b) UNION ALL SELECT DISTINCT pba, 1 FROM b", "bm", "stored")
def counts_of_new_blocks(d):
    return blockmap.write_mapping(d.blockmap_before, d.stored, _half(d))[1]


@query(
    f"+{_BATCH}, old AS (SELECT m.pba, count(*) AS n FROM b JOIN bm0 m ON m.vol_id = b.vol_id AND m.lba = b.lba GROUP BY 1), left_ AS (SELECT s.pba, refcount - coalesce(n, 0) AS refcount FROM stored s LEFT JOIN old ON old.pba = s.pba) "
    "SELECT pba, refcount FROM left_ WHERE refcount > 0 AND pba NOT IN (SELECT pba FROM b) UNION ALL SELECT DISTINCT pba, 1 FROM b",
    "bm", "bm0", "stored",
)
def counts_after_remap(d):
    return blockmap.remap(d.blockmap_before, d.stored, _half(d))[1]


@query("SELECT vol_id, lba, CASE WHEN EXISTS (SELECT 1 FROM reqs r WHERE r.vol_id = bm.vol_id AND r.lba = bm.lba) THEN flags & ~1::BIGINT ELSE flags END AS flags FROM bm", "bm", "reqs")
def flags_cleared(d):
    return blockmap.update_flags(d.blockmap, d.requests, False).select("vol_id", "lba", F.col("flags").cast("bigint").alias("flags"))


@query("+v AS (SELECT event_id + 8 AS pba, event_id % 3 AS refcount FROM events WHERE event_id % 4 = 0) SELECT pba, refcount FROM stored WHERE pba NOT IN (SELECT pba FROM v) UNION ALL SELECT pba, refcount FROM v WHERE refcount > 0", "stored")
def counts_set(d):
    values = d.events.filter("event_id % 4 = 0").select((F.col("event_id") + 8).alias("pba"), (F.col("event_id") % 3).alias("refcount"))
    return blockmap.set_refcounts(d.stored, values)


@query("+x AS (SELECT pba, refcount AS n FROM stored UNION ALL SELECT event_id % 1000 + 8, event_id % 7 - 4 FROM events) SELECT pba, sum(n)::BIGINT AS refcount FROM x GROUP BY 1 HAVING sum(n) > 0", "stored")
def counts_adjusted(d):
    deltas = d.events.select((F.col("event_id") % 1000 + 8).alias("pba"), (F.col("event_id") % 7 - 4).alias("delta"))
    return blockmap.adjusted(d.stored, deltas)


# Upkeep of the fingerprint index


_NEW = "e AS (SELECT hash, max(doc_id * 64 + lba) AS seq FROM docb WHERE doc_id % 3 = 1 GROUP BY 1)"


def _entries(d: Derived) -> DataFrame:
    seq = F.col("doc_id") * 64 + F.col("lba")
    return d.doc_blocks.filter("doc_id % 3 = 1").select("hash", (seq + 8).alias("pba"), seq.alias("seq"))


@query(f"+{_NEW} SELECT hash, pba FROM idx ANTI JOIN e USING (hash) UNION ALL SELECT hash, seq + 8 FROM e", "idx", "docb")
def entries_put(d):
    return dedup.put_entries(d.index, d.reverse, _entries(d))[0].select("hash", "pba")


@query(f"+{_NEW} SELECT pba, hash FROM rev ANTI JOIN e USING (hash) UNION SELECT seq + 8, hash FROM e", "rev", "docb")
def reverse_put(d):
    return dedup.put_entries(d.index, d.reverse, _entries(d))[1].select("pba", "hash")


@query("SELECT pba, hash FROM rev ANTI JOIN (SELECT pba, hash FROM idx WHERE pba % 3 = 0) USING (pba, hash)", "idx", "rev")
def reverse_after_drop(d):
    return dedup.drop_entry(d.index, d.reverse, d.index.filter("pba % 3 = 0"))[1].select("pba", "hash")


@query("+f AS (SELECT start * 7 AS s, count % 20 + 1 AS n FROM rngs WHERE event_id % 40 = 1) SELECT pba FROM stored c WHERE pba % 2 = 0 AND pba % 6 <> 0 AND NOT EXISTS (SELECT 1 FROM f WHERE c.pba >= s AND c.pba < s + n)", "stored", "rngs")
def cleanup_allowed(d):
    free = d.ranges.filter("event_id % 40 = 1").select((F.col("start") * 7).alias("start_pba"), (F.col("count") % 20 + 1).alias("block_count"))
    return dedup.cleanup_gate(d.stored.filter("pba % 2 = 0").select("pba"), d.stored.filter("pba % 6 = 0"), free)


# The write log


@query("SELECT doc_id FROM documents WHERE doc_id % 4 > 0 AND doc_id % 5 = doc_id % 4 AND source IS NOT NULL AND strlen(source) BETWEEN 1 AND 255")
def entries_accepted(d):
    rows = d.table("documents").select("doc_id", F.col("source").alias("vol_id"), (F.col("doc_id") % 4).alias("lba_count"), F.repeat(F.lit("x" * 4096), (F.col("doc_id") % 5).cast("int")).cast("binary").alias("payload"))
    return writelog.valid_entries(rows).select("doc_id")


@query("SELECT seq, vol_id FROM wlog WHERE vol_id <> 'vol-2' AND seq % 10 <> 3", "wlog")
def log_purged(d):
    return writelog.purge(d.log, "vol-2", d.log.filter("seq % 10 = 3")).select("seq", "vol_id")


@query("+c AS (SELECT vol_id, lba, max(seq) AS seq FROM writes GROUP BY 1, 2) SELECT vol_id, lba, seq FROM c WHERE seq % 4 <> 1", "writes")
def index_after_eviction(d):
    return writelog.evict(writelog.latest(d.writes).select("vol_id", "lba", "seq"), d.writes.filter("seq % 4 = 1"))


@query("+c AS (SELECT vol_id, lba, max(seq) AS now FROM writes WHERE seq % 3 <> 0 GROUP BY 1, 2) SELECT w.vol_id, w.lba, seq, now IS NULL OR now = seq AS is_latest FROM writes w LEFT JOIN c ON c.vol_id = w.vol_id AND c.lba = w.lba", "writes")
def latest_marked(d):
    return writelog.is_latest(d.writes, writelog.latest(d.writes.filter("seq % 3 <> 0"))).select("vol_id", "lba", "seq", "is_latest")


@query("SELECT DISTINCT g.vol_id, vol_created_at FROM gens g JOIN wlog w ON w.seq = g.seq WHERE NOT flushed", "gens", "wlog")
def volumes_with_work(d):
    log = d.log.select("seq", "flushed").join(d.generations, "seq")
    return writelog.has_work(log)


@query("SELECT seq, count(*) AS in_flight FROM (SELECT seq FROM wlog UNION ALL SELECT seq FROM wlog WHERE lba_count > 4) GROUP BY 1", "wlog")
def units_in_flight(d):
    ranges = F.collect_list(F.struct("seq", "start_lba", "lba_count")).alias("seq_lba_ranges")
    units = d.log.groupBy("vol_id", "shard").agg(ranges).unionByName(d.log.filter("lba_count > 4").groupBy("vol_id", "shard").agg(ranges))
    return writelog.unfinished_units(units)


@query("SELECT user_id AS seq FROM events GROUP BY 1 HAVING min(event_id % 50) > 0")
def seqs_completed(d):
    return writelog.completed(d.events.select(F.col("user_id").alias("seq"), (F.col("event_id") % 50 > 0).alias("done")))


@query("SELECT vol_id, 1000 + row_number() OVER (ORDER BY vol_id) AS created_at FROM vols", "vols")
def generations_given(d):
    return writelog.next_generations(d.volumes.select("vol_id"), last=1000, now=500).select("vol_id", F.col("created_at").cast("bigint").alias("created_at"))


@query("SELECT seq, shard, (row_number() OVER (PARTITION BY shard ORDER BY seq) - 1) // 32 AS batch FROM wlog", "wlog")
def batches_numbered(d):
    return writelog.numbered_batches(d.log, ["shard"], "seq").select("seq", "shard", "batch")


# Images


@query("SELECT coalesce(a.vol_id, b.vol_id) AS vol_id, coalesce(a.lba, b.lba) AS lba, a.pba AS expected, b.pba AS actual FROM bm0 a FULL JOIN bm b ON a.vol_id = b.vol_id AND a.lba = b.lba WHERE a.pba IS DISTINCT FROM b.pba", "bm0", "bm")
def image_mismatches(d):
    return readpath.mismatches(d.blockmap_before, d.blockmap, KEY, "pba")


@query("SELECT seq * 4096 AS disk_offset, seq, seq * 31 AS payload_crc32 FROM wlog WHERE seq % 6 IN (0, 2, 3, 4)", "wlog")
def readback_failures(d):
    written = d.log.select((F.col("seq") * 4096).alias("disk_offset"), "seq", (F.col("seq") * 31).alias("payload_crc32"))
    device = written.filter("seq % 2 = 1 or seq % 6 = 0").withColumn("payload_crc32", F.col("payload_crc32") + F.when(F.col("seq") % 3 == 0, 1).otherwise(0))
    return readpath.readback(written, device).select("disk_offset", "seq", "payload_crc32")


@query("SELECT doc_id, sha256(encode(left(t, 10) || 'overlaid' || substr(t, 19))) AS digest FROM (SELECT doc_id, rpad(left(regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g'), 4096), 4096, ' ') AS t FROM documents)")
def blocks_overlaid(d):
    text = F.rpad(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?"), 1, 4096), 4096, " ")
    parts = d.table("documents").select("doc_id", F.lit(10).alias("in_block"), F.lit(b"overlaid").alias("data"), text.cast("binary").alias("block"))
    return readpath.read_modify_write(parts).select("doc_id", F.sha2("block", 256).alias("digest"))


# Sizes, checks and policies


@query(
    "SELECT vol_id, lba, CASE WHEN slot_offset > 0 THEN 4096 ELSE (unit_compressed_size + 4095) // 4096 * 4096 END AS read_size, slot_offset AS from_, slot_offset + unit_compressed_size AS to_, compression = 0 AS raw, unit_compressed_size < 4096 AS packed, flags % 2 = 1 AS skipped, (pba + 8) * 4096 + slot_offset AS device_at, (unit_compressed_size + 511) // 512 * 512 AS sectors FROM bm",
    "bm",
)
def fragment_reads(d):
    part = S.slice_range("slot_offset", "unit_compressed_size")
    return d.blockmap.select("vol_id", "lba", S.read_size("slot_offset", "unit_compressed_size").alias("read_size"), part["start"].alias("from_"), part["end"].alias("to_"), S.is_uncompressed("compression").alias("raw"), S.is_packed("unit_compressed_size").alias("packed"), S.is_dedup_skipped("flags").alias("skipped"), S.device_offset("pba", F.col("slot_offset")).alias("device_at"), S.round_up("unit_compressed_size", 512).alias("sectors"))


@query("SELECT event_id, event_id % 6 AS worker, off + len > 900000 AS outside, off % 4096 = 0 AND len % 4096 = 0 AS aligned, off * 512 AS byte_ FROM bytes_", "bytes_")
def request_checks(d):
    r = d.byte_ranges
    return r.select("event_id", S.worker_of("event_id", 6).alias("worker"), S.out_of_bounds("offset", "length", F.lit(900_000)).alias("outside"), S.is_aligned("offset", "length").alias("aligned"), S.sector_bytes("offset").alias("byte_"))


@query(
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bare' WHEN event_id % 3 = 0 THEN 'standby' ELSE 'active' END AS mode, user_id % 100 > event_id % 90 + 30 AS expired, greatest(event_id % 90 + 30 - user_id % 100, 0) AS left_, event_id % 101 > 90 AS skips, event_id % 70 < 50 OR event_id % 5 = 0 AS hydrates FROM events"
)
def policies(d):
    e, user = F.col("event_id"), F.col("user_id") % 100
    renewed = e % 90
    return d.events.select("event_id", S.mode(e % 3 != 0, e % 2 != 0).alias("mode"), S.lease_expired(user, renewed, F.lit(30)).alias("expired"), S.lease_left(user, renewed, F.lit(30)).alias("left_"), S.skips_dedup(e % 101, 90).alias("skips"), S.hydrates(e % 70, F.lit(50), e % 5, F.lit(0)).alias("hydrates"))


@query("SELECT event_id, ['none', 'lz4', 'zstd', NULL][event_id % 4 + 1] AS name, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_id % 4 END AS code FROM events")
def compressions(d):
    name = S.compression_name(F.col("event_id") % 4)
    return d.events.select("event_id", name.alias("name"), S.compression_code(F.upper(name)).cast("bigint").alias("code"))


@query(
    "SELECT event_id, CASE k WHEN 'ok' THEN 0 WHEN 'null' THEN -1 WHEN 'invalid' THEN -2 WHEN 'out_of_bounds' THEN -2 WHEN 'io' THEN -3 WHEN 'meta' THEN -3 WHEN 'not_found' THEN -4 WHEN 'no_space' THEN -5 WHEN 'config' THEN -6 ELSE -7 END AS code "
    "FROM (SELECT event_id, ['ok', 'null', 'invalid', 'out_of_bounds', 'io', 'meta', 'not_found', 'no_space', 'config', 'compress'][event_id % 10 + 1] AS k FROM events)"
)
def error_codes(d):
    kinds = F.array(*map(F.lit, ("ok", "null", "invalid", "out_of_bounds", "io", "meta", "not_found", "no_space", "config", "compress")))
    return d.events.select("event_id", S.error_code(F.element_at(kinds, (F.col("event_id") % 10 + 1).cast("int"))).alias("code"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1024 WHEN 2 THEN event_id * 1048576 WHEN 3 THEN event_id * 1073741824 ELSE NULL END AS bytes, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN NULL WHEN 2 THEN event_id * 1048576 WHEN 3 THEN NULL WHEN 4 THEN event_id * 1024 + 512 ELSE NULL END AS fractions FROM events")
def sizes_parsed(d):
    e = F.col("event_id")
    text = F.concat(e.cast("string"), F.element_at(F.array(*map(F.lit, ("", "KB", "m", "gb ", ".5k", " k x"))), (e % 6 + 1).cast("int")))
    return d.events.select("event_id", S.parse_size(text).alias("bytes"), S.parse_size(text, fractions=True).alias("fractions"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id * 60 WHEN 2 THEN event_id * 3600 WHEN 3 THEN event_id * 86400 ELSE event_id * 60 + 30 END AS seconds FROM events")
def durations_parsed(d):
    e = F.col("event_id")
    text = F.concat(e.cast("string"), F.element_at(F.array(*map(F.lit, ("s", "m", "H", "d", ".5m"))), (e % 5 + 1).cast("int")))
    return d.events.select("event_id", S.parse_duration(text).alias("seconds"))


@query(
    "SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0) ELSE printf('%.2f MiB', n / 1048576.0) END AS bytes, "
    "CASE WHEN n = 0 THEN '0s' ELSE CASE WHEN n >= 86400 THEN (n // 86400) || 'd' ELSE '' END || CASE WHEN n % 86400 >= 3600 THEN (n % 86400 // 3600) || 'h' ELSE '' END || CASE WHEN n % 3600 >= 60 THEN (n % 3600 // 60) || 'm' ELSE '' END || CASE WHEN n % 60 > 0 THEN (n % 60) || 's' ELSE '' END END AS time, "
    "CASE WHEN n < 1000 THEN n || 'ns' WHEN n < 1000000 THEN printf('%.3fus', n / 1000.0) ELSE printf('%.3fms', n / 1000000.0) END AS nanos "
    "FROM (SELECT event_id, n + CASE WHEN n % 1000 = 500 THEN 1 ELSE 0 END AS n FROM (SELECT event_id, event_id * event_id % 3000000 AS n FROM events))"
)
def amounts_written(d):
    n = F.col("event_id") * F.col("event_id") % 3_000_000
    n = n + F.when(n % 1000 == 500, 1).otherwise(0)  # no halves of the last digit
    return d.events.select("event_id", S.human_bytes(n).alias("bytes"), S.human_seconds(n).alias("time"), S.human_nanoseconds(n).alias("nanos"))


# Operations


@query("SELECT sum(event_id % 100)::BIGINT AS ops, sum(event_id * 10)::BIGINT AS bytes, sum(event_id * 10) / 1048576.0 / 8.0 AS mib_s, sum(event_id % 100) / 8.0 AS iops, 8.0 * 1000000.0 / sum(event_id % 100) AS avg_us, sum(event_id * 10) / 1048576.0 / 10.0 AS sustained_mib_s, sum(event_id % 100) / 10.0 AS sustained_iops FROM events")
def throughput(d):
    return ops.throughput(d.events.select((F.col("event_id") % 100).alias("ops"), (F.col("event_id") * 10).alias("bytes"), F.lit(8.0).alias("wall_secs"), F.lit(2.0).alias("drain_secs")))


@query("SELECT event_type AS property, sum(event_id)::BIGINT AS bytes FROM events GROUP BY ROLLUP (event_type)")
def memory_totals(d):
    return ops.memory_total(d.events.select(F.col("user_id").alias("family"), F.col("event_type").alias("property"), F.col("event_id").alias("bytes")))


@query("SELECT count(*) AS volumes, count(CASE WHEN vol_id <> 'vol-0' THEN 1 END) AS live FROM vols", "vols")
def volumes_open(d):
    return ops.volume_counts(d.volumes, d.events.select("vol_id", ((F.col("event_id") % 9 == 0) & (F.col("vol_id") != "vol-0")).alias("live")))


@query(
    "+s AS (SELECT vol_id, lba, pba FROM bm WHERE flags % 2 = 1 ORDER BY vol_id, lba LIMIT 100) SELECT count(*) AS rescanned, count(CASE WHEN pba % 3 > 0 AND pba % 3 * 5 <> pba THEN 1 END) AS hits, count(CASE WHEN pba % 3 = 0 THEN 1 END) AS misses FROM s", "bm"
)
def rescan_totals(d):
    index = d.spark.createDataFrame([("h1", 5), ("h2", 10)], "hash string, pba bigint")
    hashes = d.blockmap.select(*KEY, F.concat(F.lit("h"), (F.col("pba") % 3).cast("string")).alias("hash"))
    return dedup.rescan_stats(dedup.rescan_plan(d.blockmap, index, hashes, limit=100, fill=50))


@query("SELECT event_id AS line_no, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 1")
def failure_last(d):
    events = d.events.select(F.col("event_id").alias("line_no"), "user_id", F.when(F.col("event_type") == "error", "failure").otherwise("start").alias("event"))
    return ops.last_failure(events).select("line_no", "user_id")


@query("SELECT conv_id * 1000 + turn AS line_no, min(level) AS level FROM issues GROUP BY 1 ORDER BY 1 DESC LIMIT 12", "issues")
def issues_last(d):
    lines = d.log_lines.groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no")).agg(F.min("level").alias("level"), F.min("msg").alias("msg"))
    return ops.last_issues(lines, 12).select(F.col("line_no").cast("bigint").alias("line_no"), "level")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'TEXT' ELSE level END AS level, CASE WHEN turn % 4 = 1 THEN 'thread failed' ELSE 'a::b' END AS what FROM lines WHERE turn % 4 < 2", "lines")
def lines_parsed(d):
    """Log lines in colours, lines that only hint at an issue, and lines that are neither."""
    full = F.concat(F.lit("2024-01-01T00:00:00Z \x1b[33m"), F.col("level"), F.lit("\x1b[0m a::b: "), F.col("msg"))
    value = F.when(F.col("turn") % 4 == 0, full).when(F.col("turn") % 4 == 1, "thread failed").otherwise("all is well")
    found = logs.log_lines(d.log_lines.select("conv_id", "turn", value.alias("value")), hints=ops.HINTS)
    return found.select("conv_id", "turn", "level", F.when(F.col("level") == "TEXT", F.col("msg")).otherwise(F.col("target")).alias("what"))


@query("SELECT * FROM (VALUES ('gc', 'enabled', 'true'), ('gc', 'scan_interval_ms', '250'), ('gc', 'dead_ratio_threshold', '0.25'), ('gc', 'buffer_usage_max_pct', '80'), ('gc', 'buffer_usage_resume_pct', '50'), ('gc', 'max_rewrite_per_cycle', '64'), ('dedup', 'enabled', 'false'), ('dedup', 'workers', '2'), ('dedup', 'buffer_skip_threshold_pct', '90'), ('dedup', 'rescan_interval_ms', '30000'), ('dedup', 'max_rescan_per_cycle', '256'), ('service', 'socket_path', '/run/x')) AS t(section, name, value)")
def settings(d):
    text = '[gc]\nscan_interval_ms = 250\n[dedup]\nenabled = false\n[service]\nsocket_path = "/run/x"\n'
    return logs.config(d.spark, text).filter("section in ('gc', 'dedup', 'service')")
