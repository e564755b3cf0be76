"""The queries over derived tables: what Spark runs and what DuckDB should agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.functions import codecs
from blockprism.functions import scalars as S
from blockprism.operators import audit, blockmap, dedup, gc, ops, readpath, space, writelog
from blockprism.plans.derive import TOTAL, Derived, sql
from blockprism.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str, recursive: bool = False):
    """Registers a function of ``Derived`` under its name, with its SQL over the named views if there is any."""

    def register(f: Callable[[Derived], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Derived(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *views, recursive=recursive)
        return f

    return register


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# The write log


@query("SELECT vol_id, lba, max(seq) AS seq, count(DISTINCT seq)::BIGINT AS n_seqs FROM writes GROUP BY 1, 2", "writes")
def latest_mapping(d):
    return writelog.latest(d.writes, with_seqs=True).select("vol_id", "lba", "seq", F.size("seqs").cast("bigint").alias("n_seqs"))


@query("SELECT vol_id, lba, seq, by_seq FROM (SELECT *, lead(seq) OVER (PARTITION BY vol_id, lba ORDER BY seq) AS by_seq FROM writes) WHERE by_seq IS NOT NULL", "writes")
def superseded_entries(d):
    return writelog.superseded(d.writes).select("vol_id", "lba", "seq", "by_seq")


_UNITS = "l AS (SELECT vol_id, lba, max(seq) AS seq FROM writes GROUP BY 1, 2), a AS (SELECT *, lba - row_number() OVER (PARTITION BY vol_id ORDER BY lba) AS g FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY vol_id, g ORDER BY lba) - 1 AS p FROM a)"


@query(f"+{_UNITS} SELECT vol_id, min(lba) AS start_lba, count(*) AS lba_count, max(seq) AS max_seq FROM b GROUP BY vol_id, g, p // 32", "writes")
def coalesce_units(d):
    return writelog.coalesce(writelog.latest(d.writes))


_BLOCKS = "x AS (SELECT seq, vol_id, flushed, start_lba + unnest(range(0, lba_count)) AS lba FROM wlog)"


@query(f"+{_BLOCKS}, s AS (SELECT vol_id, lba, seq, lead(seq) OVER (PARTITION BY vol_id, lba ORDER BY seq) AS n FROM x), r AS (SELECT *, lba - row_number() OVER (PARTITION BY vol_id, seq ORDER BY lba) AS g FROM s WHERE n IS NULL) SELECT vol_id, seq, min(lba) AS start_lba, count(*) AS lba_count FROM r GROUP BY vol_id, seq, g", "wlog")
def seq_ranges(d):
    """The blocks of each entry that are still current."""
    return writelog.seq_ranges(writelog.latest(longs(writelog.exploded(d.log), "lba")).select("vol_id", "seq", "lba"))


@query(f"+{_BLOCKS}, s AS (SELECT vol_id, lba, seq, lead(seq) OVER (PARTITION BY vol_id, lba ORDER BY seq) AS n FROM x), r AS (SELECT *, lba - row_number() OVER (PARTITION BY vol_id, n ORDER BY lba) AS g FROM s WHERE n IS NOT NULL) SELECT vol_id, n AS seq, min(lba) AS start_lba, count(*) AS lba_count FROM r GROUP BY vol_id, n, g", "wlog")
def superseded_ranges(d):
    return writelog.superseded_ranges(writelog.exploded(d.log).select("vol_id", "seq", "lba"))


@query(f"+{_BLOCKS}, s AS (SELECT vol_id, seq, seq < max(seq) OVER (PARTITION BY vol_id, lba) AS newer FROM x) SELECT vol_id, seq, count(*) AS lba_count FROM s GROUP BY 1, 2 HAVING bool_and(newer)", "wlog")
def fully_superseded(d):
    return writelog.fully_superseded(writelog.exploded(d.log).select("vol_id", "seq", "lba"))


@query(f"+{_BLOCKS}, c AS (SELECT vol_id, lba, max(seq) AS seq FROM x GROUP BY 1, 2) SELECT pos, q.vol_id, q.lba, seq FROM reqs q LEFT JOIN c ON c.vol_id = q.vol_id AND c.lba = q.lba", "wlog", "reqs")
def covering_seq(d):
    ranges = d.log.select("vol_id", "seq", "start_lba", "lba_count")
    return writelog.covering_seq(ranges, d.requests).select("pos", "vol_id", "lba", "seq")


@query("SELECT vol_id, lba // 256 % 4 AS zone, lba // 256 % 3 AS shard, count(*) AS n FROM writes GROUP BY 1, 2, 3", "writes")
def zone_shard_load(d):
    return d.writes.groupBy("vol_id", S.zone_of("lba", 256, 4).alias("zone"), S.zone_of("lba", 256, 3).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT event_id, c % 4 AS zone, greatest(start, c * 256) AS part_start, least(start + count, (c + 1) * 256) - greatest(start, c * 256) AS part_length FROM (SELECT *, unnest(range(start // 256, (start + count - 1) // 256 + 1)) AS c FROM rngs)", "rngs")
def zone_split(d):
    return readpath.split_by_zone(d.ranges, 256, 4).select("event_id", "zone", "part_start", "part_length")


@query("SELECT seq, g.vol_id, lba, vol_created_at <> created_at AS strict_stale, vol_created_at <> 0 AND vol_created_at <> created_at AS stale FROM gens g JOIN vols v ON g.vol_id = v.vol_id", "gens", "vols")
def stale_generation(d):
    strict = writelog.mark_stale(d.generations, d.volumes).withColumnRenamed("stale", "strict_stale")
    return writelog.mark_stale(strict, d.volumes, zero_is_wildcard=True).select("seq", "vol_id", "lba", "strict_stale", "stale")


@query("SELECT event_id, (off + 4095) // 4096 AS start, greatest((off + len) // 4096 - (off + 4095) // 4096, 0) AS count, off // 4096 AS f_start, len // 4096 AS f_count FROM bytes_", "bytes_")
def discard_rounding(d):
    a, b = S.discard_range("offset", "length"), S.discard_range("offset", "length", "frontend")
    return d.byte_ranges.select("event_id", a["start"].alias("start"), a["count"].alias("count"), b["start"].alias("f_start"), b["count"].alias("f_count"))


@query("+dd AS (SELECT vol_id, event_id AS seq, event_id % 1000 AS start, event_id % 30 AS n FROM ev WHERE event_type = 'error'), dx AS (SELECT vol_id, start + unnest(range(0, n)) AS lba, seq FROM dd), dm AS (SELECT vol_id, lba, max(seq) AS dseq FROM dx GROUP BY 1, 2), l AS (SELECT vol_id, lba, max(seq) AS seq FROM writes GROUP BY 1, 2) SELECT l.vol_id, l.lba, l.seq FROM l LEFT JOIN dm ON dm.vol_id = l.vol_id AND dm.lba = l.lba WHERE dseq IS NULL OR dseq < seq", "writes")
def discarded_blocks(d):
    gone = d.events.filter("event_type = 'error'").select("vol_id", F.col("event_id").alias("seq"), (F.col("event_id") % 1000).alias("start"), (F.col("event_id") % 30).alias("count"))
    return writelog.apply_discards(writelog.latest(d.writes), gone).select("vol_id", "lba", "seq")


_PROGRESS = "fl AS (SELECT seq, count(DISTINCT lba) AS flushed FROM (SELECT seq, start_lba + unnest(range(0, lba_count)) AS lba FROM marks) GROUP BY 1), pr AS (SELECT w.seq, w.shard, coalesce(fl.flushed, 0) AS flushed, greatest(w.lba_count - coalesce(fl.flushed, 0), 0) AS remaining, coalesce(fl.flushed, 0) >= w.lba_count AS done FROM wlog w LEFT JOIN fl ON w.seq = fl.seq)"


@query(f"+{_PROGRESS} SELECT seq, shard, flushed, remaining, done FROM pr", "wlog", "marks")
def pending_progress(d):
    return writelog.flush_progress(d.log.drop("flushed"), d.marks).select("seq", "shard", "flushed", "remaining", "done")


@query("+f AS (SELECT shard, min(CASE WHEN NOT (flushed AND seq <= 4000) THEN seq END) AS b FROM wlog GROUP BY 1) SELECT w.shard, w.seq FROM wlog w JOIN f ON w.shard = f.shard WHERE b IS NULL OR seq < b", "wlog")
def reclaimable_prefix(d):
    return writelog.reclaimable(d.log, 4000).select("shard", "seq")


@query(f"+{_PROGRESS}, h AS (SELECT shard, min(seq) AS head_seq FROM wlog WHERE NOT (flushed AND seq <= 4000) GROUP BY 1) SELECT h.shard, head_seq, remaining AS head_remaining_lbas FROM h LEFT JOIN pr ON pr.seq = h.head_seq", "wlog", "marks")
def log_heads(d):
    return writelog.log_heads(d.log, writelog.flush_progress(d.log.drop("flushed"), d.marks), 4000)


@query("SELECT shard, seq, (sum(lba_count * 4096) OVER w <= 16777216 OR sum(lba_count * 4096) OVER w = lba_count * 4096) AS ready FROM wlog WINDOW w AS (PARTITION BY shard ORDER BY seq)", "wlog")
def ready_batches(d):
    return writelog.batches(d.log).select("shard", "seq", "ready")


@query()
def ring_offsets(d):
    return writelog.ring_offsets(d.log.select(F.col("shard").cast("int").alias("shard"), "seq", ((F.col("lba_count") + 1) * 4096).cast("int").alias("disk_len")), 1 << 20)


# The block map


@query("SELECT pba, count(*) AS refcount FROM bm GROUP BY 1", "bm")
def refcounts(d):
    return blockmap.refcounts(d.blockmap)


@query("+c AS (SELECT pba, count(*) AS n FROM bm GROUP BY 1) SELECT coalesce(s.pba, c.pba) AS pba, s.refcount AS stored, c.n AS computed, CASE WHEN c.n IS NULL THEN 'orphan' WHEN s.refcount IS NULL THEN 'missing' WHEN s.refcount <> c.n THEN 'fixed' ELSE 'ok' END AS state FROM stored s FULL JOIN c ON s.pba = c.pba", "bm", "stored")
def refcount_drift(d):
    return blockmap.drift(d.stored, d.blockmap)


@query("SELECT count(CASE WHEN n IS NOT NULL THEN 1 END) AS referenced, count(CASE WHEN n <> coalesce(refcount, 0) THEN 1 END) AS fixed, count(CASE WHEN n IS NULL THEN 1 END) AS orphans FROM stored s FULL JOIN (SELECT pba, count(*) AS n FROM bm GROUP BY 1) c ON s.pba = c.pba", "bm", "stored")
def refcount_rebuild(d):
    return blockmap.rebuilt(d.stored, d.blockmap)[1]


@query("SELECT pba, refcount FROM stored WHERE refcount > 0 AND pba NOT IN (SELECT pba FROM bm)", "bm", "stored")
def orphan_refcounts(d):
    return blockmap.orphans(d.stored, d.blockmap)


@query("+m AS (SELECT a.pba AS np, b.pba AS op FROM bm a LEFT JOIN bm0 b ON a.vol_id = b.vol_id AND a.lba = b.lba WHERE b.pba IS NULL OR a.pba <> b.pba), r AS (SELECT pba, refcount AS cur, 0 AS inc, 0 AS d FROM stored UNION ALL SELECT np, 0, 1, 0 FROM m UNION ALL SELECT op, 0, 0, 1 FROM m WHERE op IS NOT NULL), t AS (SELECT pba, max(cur)::BIGINT AS cur, sum(inc)::BIGINT AS inc, sum(d)::BIGINT AS d FROM r GROUP BY 1) SELECT pba, cur, inc, d AS dec, greatest(cur + inc - d, 0) AS final, cur > 0 AND greatest(cur + inc - d, 0) = 0 AS newly_zeroed FROM t", "bm", "bm0", "stored")
def refcount_netting(d):
    moved = blockmap.old_mappings(d.blockmap_before, d.blockmap).filter("old_pba is null or old_pba <> pba")
    return blockmap.netted(d.stored, moved.select("pba"), moved.filter("old_pba is not null").select(F.col("old_pba").alias("pba")))


_RC = "rc AS (SELECT pba, count(*) AS n FROM bm0 GROUP BY 1)"


@query(f"+{_RC}, m AS (SELECT a.pba AS np, b.pba AS op, b.unit_compressed_size AS os FROM bm a LEFT JOIN bm0 b ON a.vol_id = b.vol_id AND a.lba = b.lba WHERE b.pba IS NULL OR a.pba <> b.pba), g AS (SELECT op, count(*) AS n, max((os + 4095) // 4096) AS blocks FROM m WHERE op IS NOT NULL GROUP BY 1), i AS (SELECT np, count(*) AS n FROM m GROUP BY 1) SELECT g.op AS start_pba, blocks AS block_count FROM g JOIN rc ON rc.pba = g.op LEFT JOIN i ON i.np = g.op WHERE rc.n + coalesce(i.n, 0) - g.n <= 0", "bm", "bm0")
def write_batch_freed(d):
    before = d.blockmap_before
    return blockmap.write_batch(before, blockmap.refcounts(before), d.blockmap)[2]


_GONE = "g AS (SELECT pba, count(*) AS n, max((unit_compressed_size + 4095) // 4096) AS blocks FROM bm WHERE vol_id = 'vol-1' {} GROUP BY 1), rc AS (SELECT pba, count(*) AS n FROM bm GROUP BY 1) SELECT g.pba AS start_pba, blocks AS block_count FROM g JOIN rc ON rc.pba = g.pba WHERE rc.n - g.n <= 0"


@query(f"+{_GONE.format('')}", "bm")
def delete_volume_freed(d):
    return blockmap.without_range(d.blockmap, blockmap.refcounts(d.blockmap), "vol-1")[2]


@query(f"+{_GONE.format('AND lba >= 100 AND lba < 600')}", "bm")
def discard_range_freed(d):
    return blockmap.without_range(d.blockmap, blockmap.refcounts(d.blockmap), "vol-1", 100, 600)[2]


@query("SELECT DISTINCT pba FROM (SELECT pba + unnest(range(0, (unit_compressed_size + 4095) // 4096)) AS pba FROM bm UNION ALL SELECT pba FROM stored WHERE refcount > 0)", "bm", "stored")
def allocated_blocks(d):
    return blockmap.allocated_blocks(d.blockmap, d.stored)


@query("SELECT pba, slot_offset, compression, unit_compressed_size, unit_original_size, unit_lba_count, crc32, count(*) AS n_refs, string_agg(vol_id || ':' || lba, ',' ORDER BY vol_id, lba) AS refs FROM bm GROUP BY 1, 2, 3, 4, 5, 6, 7", "bm")
def fragment_groups(d):
    return blockmap.fragment_groups(d.blockmap)


@query("SELECT vol_id, lba, pba FROM bm WHERE vol_id = 'vol-0' AND lba >= 64 AND lba < 512", "bm")
def mapping_range(d):
    return blockmap.mapping_range(d.blockmap, "vol-0", 64, 512).select("vol_id", "lba", "pba")


@query("SELECT pos::INTEGER AS pos, k.lba, pba FROM (SELECT unnest(range(0, 50)) AS pos, unnest(range(0, 50)) * 31 % 300 AS lba) k LEFT JOIN (SELECT lba, pba FROM bm WHERE vol_id = 'vol-0') b ON b.lba = k.lba", "bm")
def multi_get_mappings(d):
    wanted = blockmap.requests(d.spark, [k * 31 % 300 for k in range(50)], "lba")
    return blockmap.mappings(d.blockmap, "vol-0", wanted).select("pos", "lba", "pba")


@query("SELECT pos::INTEGER AS pos, k.pba, coalesce(refcount, 0) AS refcount FROM (SELECT unnest(range(0, 50)) AS pos, unnest(range(0, 50)) * 397 % 12000 AS pba) k LEFT JOIN stored s ON s.pba = k.pba", "stored")
def multi_get_refcounts(d):
    wanted = blockmap.requests(d.spark, [k * 397 % 12000 for k in range(50)], "pba")
    return blockmap.multi_refcounts(d.stored, wanted).select("pos", "pba", "refcount")


# Space


_GAPS = "g AS (SELECT pba, coalesce(lag(pba) OVER (ORDER BY pba), 7) AS p FROM alloc)"
_FREE = f"{_GAPS}, fr AS (SELECT p + 1 AS start_pba, pba - p - 1 AS block_count FROM g WHERE pba - p > 1 UNION ALL SELECT max(pba) + 1, {TOTAL} - max(pba) - 1 FROM alloc HAVING {TOTAL} - max(pba) - 1 > 0)"


@query(f"+{_FREE} SELECT start_pba, block_count FROM fr", "alloc")
def free_extents(d):
    return space.free_extents(d.allocated, TOTAL, bucket=256)


@query("+x AS (SELECT event_id * 97 AS s, event_id * 97 + count AS e FROM rngs), y AS (SELECT s, e, CASE WHEN s <= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM x), z AS (SELECT s, e, sum(n) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y) SELECT min(s) AS start_pba, max(e) - min(s) AS block_count FROM z GROUP BY k", "rngs")
def merged_extents(d):
    """Extents of up to 300 blocks, one each 97: some reach the next one, some leave gaps."""
    return space.merged(d.ranges.select((F.col("event_id") * 97).alias("start_pba"), F.col("count").alias("block_count")), region=4096)


@query(f"+{_FREE}, q AS (SELECT DISTINCT start + 8 AS s, count % 5 + 1 AS n FROM rngs) SELECT s AS start_pba, n AS block_count, start_pba AS other_start, block_count AS other_count FROM q JOIN fr ON s < start_pba + block_count AND start_pba < s + n", "alloc", "rngs")
def free_overlaps(d):
    freed = d.ranges.select((F.col("start") + 8).alias("start_pba"), (F.col("count") % 5 + 1).alias("block_count"))
    return space.overlapping(freed, space.free_extents(d.allocated, TOTAL, bucket=256), bucket=64)


@query(f"+{_FREE} SELECT start_pba, block_count FROM fr ORDER BY (block_count >= 3) DESC, CASE WHEN block_count >= 3 THEN start_pba ELSE -block_count END, start_pba LIMIT 1", "alloc")
def first_fit(d):
    return space.first_fit(space.free_extents(d.allocated, TOTAL, bucket=256), 3)


@query(f"SELECT {TOTAL - 8}::BIGINT AS usable, count(*) AS allocated, {TOTAL - 8} - count(*) AS free FROM alloc", "alloc")
def space_totals(d):
    return space.totals(d.allocated, TOTAL)


@query("SELECT vol_id, compression, count(*) AS mappings, count(DISTINCT pba) AS pbas, sum(unit_compressed_size)::BIGINT AS bytes FROM bm GROUP BY ROLLUP (vol_id, compression)", "bm")
def space_report(d):
    return space.space_report(d.blockmap)


_PACK = "o AS (SELECT lane, order_key, size, row_number() OVER (PARTITION BY lane ORDER BY order_key) AS r FROM frags), f AS (SELECT lane, order_key, size, r, CASE WHEN size >= 4096 THEN -1 ELSE 0 END AS slot, 0 AS slot_offset, 0 AS cur, CASE WHEN size >= 4096 THEN 0 ELSE size END AS used FROM o WHERE r = 1 UNION ALL SELECT o.lane, o.order_key, o.size, o.r, CASE WHEN o.size >= 4096 THEN -1 WHEN f.used + o.size > 4096 THEN f.cur + 1 ELSE f.cur END, CASE WHEN o.size >= 4096 OR f.used + o.size > 4096 THEN 0 ELSE f.used END, CASE WHEN o.size < 4096 AND f.used + o.size > 4096 THEN f.cur + 1 ELSE f.cur END, CASE WHEN o.size >= 4096 THEN f.used WHEN f.used + o.size > 4096 THEN o.size ELSE f.used + o.size END FROM f JOIN o ON o.lane = f.lane AND o.r = f.r + 1)"


@query(f"+{_PACK} SELECT lane, order_key, size, slot::BIGINT AS slot, slot_offset::BIGINT AS slot_offset FROM f", "frags", recursive=True)
def pack_fragments(d):
    return space.pack(d.fragments)


@query("+s AS (SELECT order_key AS id, order_key // 8 AS pba, order_key * 1313 % 6000 AS start, order_key * 1313 % 6000 + size AS e FROM frags) SELECT a.pba, a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.pba = b.pba AND a.start < b.e AND b.start < a.e AND a.id < b.id", "frags")
def slot_overlaps(d):
    """Eight fragments a block."""
    start = F.col("order_key") * 1313 % 6000
    return space.slot_overlaps(d.fragments.select(F.col("order_key").alias("id"), S.idiv("order_key", 8).alias("pba"), start.alias("start"), (start + F.col("size")).alias("end")))


_LANES = "q AS (SELECT event_id // 64 AS lane, event_id AS order_key, event_id * 7 % 300 + 1 AS blocks, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) AS r FROM rngs), x AS (SELECT event_id // 64 AS lane, list({'s': event_id * 300, 'n': count} ORDER BY event_id) AS l FROM rngs GROUP BY 1)"
_SERVED = "SELECT f.lane, q.r, q.order_key, q.blocks, f.l, coalesce(list_filter(f.l, lambda x: x.n >= q.blocks)[1], list_filter(f.l, lambda x: x.n = list_max(list_transform(f.l, lambda y: y.n)))[1]) AS p FROM f JOIN q ON q.lane = f.lane AND q.r = f.r + 1"
_ALLOCATED = f"{_LANES}, f AS (SELECT lane, 0::BIGINT AS r, 0::BIGINT AS order_key, 0::BIGINT AS start_pba, 0::BIGINT AS given, l FROM x UNION ALL SELECT lane, r, order_key, p.s, CASE WHEN p IS NULL THEN 0 ELSE least(p.n, blocks) END, list_filter(list_transform(l, lambda x: CASE WHEN x.s = p.s THEN {{'s': x.s + least(x.n, blocks), 'n': x.n - least(x.n, blocks)}} ELSE x END), lambda x: x.n > 0) FROM ({_SERVED}))"


@query(f"+{_ALLOCATED} SELECT lane::VARCHAR AS lane, order_key, start_pba, given FROM f WHERE r > 0", "rngs", recursive=True)
def allocation(d):
    """Lanes of 64 extents and as many requests, of which the last get less than they ask for."""
    rows = d.ranges.withColumn("lane", S.idiv("event_id", 64).cast("string"))
    free = rows.select("lane", (F.col("event_id") * 300).alias("start_pba"), F.col("count").alias("block_count"))
    return space.allocate(free, rows.select("lane", F.col("event_id").alias("order_key"), (F.col("event_id") * 7 % 300 + 1).alias("blocks")))


# Garbage collection


_KEY7 = "pba, slot_offset, compression, unit_compressed_size, unit_original_size, unit_lba_count, crc32"
_GC = f"c AS (SELECT {_KEY7}, count(*) AS live_rows, count(DISTINCT offset_in_unit) AS live_blocks, string_agg(vol_id || ':' || lba || ':' || offset_in_unit, ',' ORDER BY vol_id, lba) AS refs, 1::DOUBLE - count(*)::DOUBLE / unit_lba_count::DOUBLE AS dead_ratio FROM bm WHERE unit_lba_count > 1 GROUP BY {_KEY7})"


def _refs(found: DataFrame) -> DataFrame:
    return found.withColumn("refs", F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["vol_id"], r["lba"], r["offset_in_unit"])), ","))


@query(f"+{_GC} SELECT * FROM c WHERE dead_ratio >= 0.25 ORDER BY dead_ratio DESC, {_KEY7} LIMIT 64", "bm")
def gc_candidates(d):
    return _refs(gc.candidates(d.blockmap))


@query(f"+{_GC}, t AS (SELECT (CASE WHEN p > 50 THEN 0.7 WHEN p > 30 THEN 0.5 WHEN p > 10 THEN 0.3 ELSE 0.25 END)::DOUBLE AS threshold FROM (SELECT ({TOTAL - 8} - count(*)) * 100 // {TOTAL - 8} AS p FROM alloc)) SELECT c.*, threshold FROM c, t WHERE dead_ratio >= threshold", "bm", "alloc")
def gc_banded_threshold(d):
    return _refs(gc.banded(d.blockmap, space.totals(d.allocated, TOTAL)))


@query("+f AS (SELECT event_id, user_id % 4 AS shard, cast(floor(value) AS BIGINT) % 101 AS fill FROM events), m AS (SELECT *, CASE WHEN fill > 80 THEN 1 WHEN fill <= 50 THEN 0 END AS mk FROM f) SELECT event_id, shard, fill, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY shard ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS paused FROM m", "ev")
def gc_hysteresis(d):
    fills = d.events.select("event_id", (F.col("user_id") % 4).alias("shard"), (F.floor("value").cast("bigint") % 101).alias("fill"))
    return gc.hysteresis(fills, ["shard"], "event_id")


@query(f"+c AS (SELECT {_KEY7} FROM bm0 WHERE unit_lba_count > 1 GROUP BY {_KEY7} HAVING 1::DOUBLE - count(*)::DOUBLE / unit_lba_count::DOUBLE >= 0.25) SELECT b.pba, b.vol_id, b.lba, b.offset_in_unit FROM bm0 b JOIN c ON c.pba = b.pba AND c.slot_offset = b.slot_offset AND c.crc32 = b.crc32 JOIN bm n ON n.vol_id = b.vol_id AND n.lba = b.lba AND n.pba = b.pba AND n.offset_in_unit = b.offset_in_unit WHERE NOT EXISTS (SELECT 1 FROM writes w WHERE w.seq >= 9000 AND w.vol_id = b.vol_id AND w.lba = b.lba)", "bm", "bm0", "writes")
def gc_revalidate(d):
    found = gc.candidates(d.blockmap_before, limit=None)
    return gc.revalidated(found, d.blockmap, d.writes.filter("seq >= 9000")).select("pba", "vol_id", "lba", "offset_in_unit")


# Dedup


@query("SELECT doc_id, vol_id, lba, hash FROM docb", "docb")
def block_fingerprints(d):
    return d.doc_blocks


@query("SELECT d.doc_id, d.lba, d.hash FROM docb d SEMI JOIN idx i ON i.hash = d.hash", "docb", "idx")
def dedup_hits(d):
    return dedup.hits(d.doc_blocks, d.index).select("doc_id", "lba", "hash")


@query("SELECT d.doc_id, d.lba, d.hash FROM docb d ANTI JOIN idx i ON i.hash = d.hash", "docb", "idx")
def dedup_misses(d):
    return dedup.misses(d.doc_blocks, d.index).select("doc_id", "lba", "hash")


@query("+m AS (SELECT doc_id, lba, lba - row_number() OVER (PARTITION BY doc_id ORDER BY lba) AS g FROM docb WHERE hash NOT IN (SELECT hash FROM idx)) SELECT doc_id, min(lba) AS start, count(*) AS length FROM m GROUP BY doc_id, g", "docb", "idx")
def miss_runs(d):
    return dedup.miss_runs(dedup.misses(d.doc_blocks, d.index), ["doc_id"], "lba")


@query("SELECT hash, pba FROM idx WHERE pba IN (SELECT pba FROM idxc WHERE refcount > 0) AND EXISTS (SELECT 1 FROM rev r WHERE r.pba = idx.pba AND r.hash = idx.hash)", "idx", "idxc", "rev")
def dedup_liveness(d):
    return dedup.live_entries(d.index, d.index_counts, d.reverse).select("hash", "pba")


@query("SELECT count(*) AS blocks, count(i.hash) AS hits, count(*) - count(i.hash) AS misses, count(i.hash)::DOUBLE / count(*) AS rate FROM docb d LEFT JOIN idx i ON i.hash = d.hash", "docb", "idx")
def dedup_hit_rate(d):
    return dedup.hit_rate(d.doc_blocks, d.index)


@query("SELECT vol_id, lba, pba FROM bm WHERE flags = 1 ORDER BY vol_id, lba LIMIT 256", "bm")
def dedup_skipped(d):
    return dedup.skipped(d.blockmap, 256).select("vol_id", "lba", "pba")


@query("SELECT hash, min(doc_id * 1000000 + lba) // 1000000 AS doc_id, min(doc_id * 1000000 + lba) % 1000000 AS lba, count(*) AS copies FROM docb GROUP BY 1", "docb")
def dedup_canonical(d):
    return dedup.canonical(d.doc_blocks, ["doc_id", "lba"]).select("hash", "doc_id", "lba", "copies")


@query("+dead AS (SELECT DISTINCT pba FROM idxc WHERE refcount = 0), r AS (SELECT rev.pba, rev.hash FROM rev JOIN dead ON rev.pba = dead.pba) SELECT 'forward' AS side, hash, pba FROM idx WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.hash = idx.hash AND r.pba = idx.pba) UNION ALL SELECT 'reverse', hash, pba FROM rev WHERE pba NOT IN (SELECT pba FROM dead)", "idx", "idxc", "rev")
def dedup_cleanup(d):
    index, reverse = dedup.cleanup(d.index, d.reverse, d.index_counts.filter("refcount = 0"))
    return index.select(F.lit("forward").alias("side"), "hash", "pba").unionByName(reverse.select(F.lit("reverse").alias("side"), "hash", "pba"))


@query("SELECT i.hash, i.pba, 'no_reverse' AS gap FROM idx i ANTI JOIN rev r ON r.hash = i.hash AND r.pba = i.pba UNION ALL SELECT r.hash, r.pba, 'no_forward' FROM rev r ANTI JOIN idx i ON r.hash = i.hash AND r.pba = i.pba", "idx", "rev")
def dedup_gaps(d):
    return dedup.symmetric_gaps(d.index, d.reverse).select("hash", "pba", "gap")


@query()
def dedup_acceptance(d):
    """Hits of all documents on blocks of the index, folded in order."""
    found = d.doc_blocks.join(d.index.select("hash", "pba"), "hash")
    batch = found.select((F.col("doc_id") * 1000 + F.col("lba")).alias("seq"), "vol_id", "lba", "pba", F.lit(None).cast("bigint").alias("old_pba")).filter("vol_id is not null")
    return dedup.accept_hits(batch, d.index_counts)


# Reads


@query("SELECT pos, q.vol_id, q.lba, b.seq AS buffer_seq, m.pba, CASE WHEN b.seq IS NOT NULL THEN 'buffer' WHEN m.pba IS NOT NULL THEN 'mapped' ELSE 'zero' END AS tier FROM reqs q LEFT JOIN (SELECT vol_id, lba, max(seq) AS seq FROM writes WHERE seq >= 8000 GROUP BY 1, 2) b ON b.vol_id = q.vol_id AND b.lba = q.lba LEFT JOIN bm0 m ON m.vol_id = q.vol_id AND m.lba = q.lba", "reqs", "writes", "bm0")
def read_range(d):
    buffered = writelog.latest(d.writes.filter("seq >= 8000"))
    return readpath.tiers(d.requests, buffered, d.blockmap_before).select("pos", "vol_id", "lba", "buffer_seq", "pba", "tier")


@query("SELECT pba, slot_offset, unit_compressed_size, count(*) AS n_members, string_agg(pos || ':' || offset_in_unit, ',' ORDER BY pos) AS members FROM reqs q JOIN bm0 m ON m.vol_id = q.vol_id AND m.lba = q.lba WHERE NOT EXISTS (SELECT 1 FROM writes w WHERE w.seq >= 8000 AND w.vol_id = q.vol_id AND w.lba = q.lba) GROUP BY 1, 2, 3", "reqs", "writes", "bm0")
def read_groups(d):
    return readpath.read_groups(readpath.tiers(d.requests, writelog.latest(d.writes.filter("seq >= 8000")), d.blockmap_before))


@query("SELECT event_id, lba, greatest(off, lba * 4096) AS part_start, least(off + len, (lba + 1) * 4096) - greatest(off, lba * 4096) AS part_length, greatest(off, lba * 4096) - lba * 4096 AS in_block, CASE WHEN least(off + len, (lba + 1) * 4096) - greatest(off, lba * 4096) = 4096 THEN 'full' ELSE 'rmw' END AS kind FROM (SELECT *, unnest(range(off // 4096, (off + len - 1) // 4096 + 1)) AS lba FROM bytes_ WHERE len > 0)", "bytes_")
def unaligned_split(d):
    return readpath.split_by_block(d.byte_ranges).select("event_id", "lba", "part_start", "part_length", "in_block", "kind")


@query("SELECT doc_id, strlen(text)::BIGINT AS size, sha256(text) AS hash FROM documents WHERE strlen(text) > 0")
def unaligned_read(d):
    """Documents cut into blocks and put together again."""
    docs = d.table("documents").select("doc_id", F.col("text").cast("binary").alias("data"), F.lit(0).cast("bigint").alias("offset"), F.octet_length("text").cast("bigint").alias("length"))
    parts = readpath.split_by_block(docs).withColumn("block", S.padded(S.block_slice("data", "lba")))
    whole = readpath.assembled(parts.select("doc_id", "part_start", "in_block", "part_length", "block"), ["doc_id"])
    return whole.select("doc_id", F.octet_length("payload").cast("bigint").alias("size"), S.content_hash("payload").alias("hash"))


# Audits


def _audited(name: str, body: str, views: tuple[str, ...], tables: Callable[[Derived], dict]):
    def run(d: Derived) -> DataFrame:
        return audit.AUDITS[name](**tables(d))

    run.__name__ = f"audit_{name}"
    query(f"SELECT '{name}' AS rule, {body}", *views)(run)


def _row(vol: str, at: str, detail: str, rest: str) -> str:
    return f"{vol}::VARCHAR AS vol_id, ({at})::BIGINT AS at, ({detail})::VARCHAR AS detail {rest}"


def _rows(d: Derived) -> dict:
    """A log and a map in which every rule is broken somewhere."""
    size = F.col("unit_compressed_size")
    broken = d.blockmap.withColumn("lba", F.col("lba") * F.when(F.col("seq") % 31 == 0, 4).otherwise(1)).withColumn("vol_id", F.when(F.col("seq") % 41 == 0, "vol-9").otherwise(F.col("vol_id")))
    broken = broken.withColumn("unit_lba_count", F.when(F.col("seq") % 13 == 0, 0).when(F.col("seq") % 17 == 0, 3).otherwise(F.col("unit_lba_count")).cast("bigint"))
    broken = broken.withColumn("unit_compressed_size", F.when(F.col("seq") % 19 == 0, 0).otherwise(size).cast("bigint")).withColumn("unit_original_size", F.when(F.col("seq") % 23 == 0, 32769).otherwise(F.col("unit_original_size")).cast("bigint"))
    broken = broken.withColumn("slot_offset", F.when(F.col("seq") % 29 == 0, 4000).otherwise(F.col("slot_offset")).cast("bigint"))
    log = d.log.withColumn("seq", F.col("seq") - F.when(F.col("seq") % 37 == 0, F.col("seq") % 2).otherwise(0)).withColumn("payload_bytes", F.col("lba_count") * 4096 - F.when(F.col("seq") % 43 == 0, 1).otherwise(0))
    log = log.withColumn("vol_id", F.when(F.col("seq") % 47 == 0, "vol-9").otherwise(F.col("vol_id"))).withColumn("start_lba", F.col("start_lba") + F.when(F.col("seq") % 53 == 0, 1024).otherwise(0))
    return {"blockmap": broken, "log": log, "volumes": d.volumes}


_BAD = "(SELECT CASE WHEN seq % 41 = 0 THEN 'vol-9' ELSE vol_id END AS vol_id, lba * (CASE WHEN seq % 31 = 0 THEN 4 ELSE 1 END) AS lba, pba, compression, CASE WHEN seq % 19 = 0 THEN 0 ELSE unit_compressed_size END AS unit_compressed_size, CASE WHEN seq % 23 = 0 THEN 32769 ELSE unit_original_size END AS unit_original_size, CASE WHEN seq % 13 = 0 THEN 0 WHEN seq % 17 = 0 THEN 3 ELSE unit_lba_count END AS unit_lba_count, offset_in_unit, crc32, CASE WHEN seq % 29 = 0 THEN 4000 ELSE slot_offset END AS slot_offset, flags FROM bm)"
_LOG1 = "(SELECT seq - (CASE WHEN seq % 37 = 0 THEN seq % 2 ELSE 0 END) AS seq, vol_id, start_lba, lba_count FROM wlog)"
_LOG = f"(SELECT seq, CASE WHEN seq % 47 = 0 THEN 'vol-9' ELSE vol_id END AS vol_id, start_lba + (CASE WHEN seq % 53 = 0 THEN 1024 ELSE 0 END) AS start_lba, lba_count, lba_count * 4096 - (CASE WHEN seq % 43 = 0 THEN 1 ELSE 0 END) AS payload_bytes FROM {_LOG1})"
_UNIT8 = f"{_KEY7}, flags"

for _name, _body, _views in (
    ("seq_unique", _row("''", "seq", "count(*)", f"FROM {_LOG} GROUP BY seq HAVING count(*) > 1"), ("wlog",)),
    ("pending_volume", _row("l.vol_id", "seq", "(start_lba + lba_count) * 4096", f"FROM {_LOG} l LEFT JOIN vols v ON v.vol_id = l.vol_id WHERE size_bytes IS NULL OR (start_lba + lba_count) * 4096 > size_bytes"), ("wlog", "vols")),
    ("payload_length", _row("vol_id", "seq", "payload_bytes", f"FROM {_LOG} WHERE payload_bytes <> lba_count * 4096"), ("wlog",)),
    ("mapping_volume", _row("vol_id", "lba", "''", f"FROM {_BAD} WHERE vol_id NOT IN (SELECT vol_id FROM vols)"), ("bm", "vols")),
    ("mapping_bounds", _row("b.vol_id", "lba", "size_bytes", f"FROM {_BAD} b JOIN vols v ON v.vol_id = b.vol_id WHERE (lba + 1) * 4096 > size_bytes"), ("bm", "vols")),
    ("unit_lba_count", _row("vol_id", "lba", "unit_lba_count", f"FROM {_BAD} WHERE unit_lba_count <= 0"), ("bm",)),
    ("offset_in_unit", _row("vol_id", "lba", "offset_in_unit", f"FROM {_BAD} WHERE offset_in_unit >= unit_lba_count"), ("bm",)),
    ("compressed_size", _row("vol_id", "lba", "unit_compressed_size", f"FROM {_BAD} WHERE unit_compressed_size <= 0"), ("bm",)),
    ("original_size", _row("vol_id", "lba", "unit_original_size", f"FROM {_BAD} WHERE unit_original_size % 4096 <> 0"), ("bm",)),
    ("original_blocks", _row("vol_id", "lba", "unit_original_size", f"FROM {_BAD} WHERE unit_original_size <> unit_lba_count * 4096"), ("bm",)),
    ("packed_fits", _row("vol_id", "lba", "slot_offset", f"FROM {_BAD} WHERE unit_compressed_size < 4096 AND slot_offset + unit_compressed_size > 4096"), ("bm",)),
    ("unpacked_at_zero", _row("vol_id", "lba", "slot_offset", f"FROM {_BAD} WHERE unit_compressed_size >= 4096 AND slot_offset <> 0"), ("bm",)),
    ("distinct_offsets", _row("''", "pba", "count(DISTINCT offset_in_unit)", f"FROM {_BAD} GROUP BY {_UNIT8} HAVING count(DISTINCT offset_in_unit) > unit_lba_count"), ("bm",)),
):
    _audited(_name, _body, _views, _rows)


def _spaces(d: Derived) -> dict:
    """Blocks of which some are free and allocated at once, and some neither."""
    free = space.free_extents(d.allocated.filter("pba % 97 <> 0"), TOTAL, bucket=256).filter("start_pba % 5 <> 0")
    return {"allocated": d.allocated, "free": free, "total": TOTAL}


_FREE97 = f"(WITH a AS (SELECT pba FROM alloc WHERE pba % 97 <> 0), g AS (SELECT pba, coalesce(lag(pba) OVER (ORDER BY pba), 7) AS p FROM a) SELECT * FROM (SELECT p + 1 AS start_pba, pba - p - 1 AS block_count FROM g WHERE pba - p > 1 UNION ALL SELECT max(pba) + 1, {TOTAL} - max(pba) - 1 FROM a HAVING {TOTAL} - max(pba) - 1 > 0) WHERE start_pba % 5 <> 0)"
_audited("allocated_count", _row("''", "a", "f", f"FROM (SELECT count(*) AS a FROM alloc), (SELECT coalesce(sum(block_count), 0)::BIGINT AS f FROM {_FREE97}) WHERE a + f <> {TOTAL - 8}"), ("alloc",), _spaces)
_audited("free_overlap", _row("''", "pba", "start_pba", f"FROM alloc JOIN {_FREE97} x ON pba >= start_pba AND pba < start_pba + block_count"), ("alloc",), _spaces)


def _indexes(d: Derived) -> dict:
    return {"index": d.index, "reverse": d.reverse, "stored": d.index_counts, "blocks": d.doc_blocks.select((F.col("doc_id") * 64 + F.col("lba") + 8).alias("pba"), F.when(F.col("doc_id") % 50 == 2, F.lit("other")).otherwise(F.col("hash")).alias("hash"))}


for _name, _body, _views in (
    ("forward_reverse", _row("''", "pba", "hash", "FROM idx i ANTI JOIN rev r ON r.hash = i.hash AND r.pba = i.pba"), ("idx", "rev")),
    ("forward_live", _row("''", "pba", "hash", "FROM idx WHERE pba NOT IN (SELECT pba FROM idxc WHERE refcount > 0)"), ("idx", "idxc")),
    ("hash_content", _row("''", "i.pba", "i.hash", "FROM idx i JOIN (SELECT doc_id * 64 + lba + 8 AS pba, CASE WHEN doc_id % 50 = 2 THEN 'other' ELSE hash END AS h FROM docb) b ON b.pba = i.pba WHERE i.hash <> b.h"), ("idx", "docb")),
    ("reverse_forward", _row("''", "pba", "hash", "FROM rev WHERE hash NOT IN (SELECT hash FROM idx)"), ("idx", "rev")),
    ("reverse_pba", _row("''", "r.pba", "r.hash", "FROM rev r JOIN idx i ON i.hash = r.hash WHERE r.pba <> i.pba"), ("idx", "rev")),
):
    _audited(_name, _body, _views, _indexes)


# Operations


@query("SELECT user_id, event_id, greatest(v - p, 0) AS delta FROM (SELECT user_id, event_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, cast(floor(value) AS BIGINT) AS v FROM events)) WHERE p IS NOT NULL")
def metric_deltas(d):
    snapshots = d.events.select("user_id", "event_id", F.floor("value").cast("bigint").alias("value"))
    return ops.metric_deltas(snapshots, ["user_id"], "event_id").select("user_id", "event_id", "delta")


@query("SELECT shard, sum(used)::BIGINT AS used_bytes, sum(cap)::BIGINT AS capacity_bytes, CASE WHEN sum(cap) = 0 THEN 100 ELSE (sum(used) * 100 // greatest(sum(cap), 1))::BIGINT END AS fill_pct FROM (SELECT user_id % 4 AS shard, event_id % 1000 AS used, CASE WHEN user_id % 4 = 3 THEN 0 ELSE 1500 END AS cap FROM events) GROUP BY ROLLUP (shard)")
def fill_pct(d):
    cap = F.when(F.col("user_id") % 4 == 3, 0).otherwise(1500).cast("bigint")
    return ops.fill(d.events.select((F.col("user_id") % 4).alias("shard"), (F.col("event_id") % 1000).alias("used_bytes"), cap.alias("capacity_bytes")))


@query("+r AS (SELECT user_id, event_id::DOUBLE AS t, sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), q AS (SELECT *, greatest(t - coalesce(lag(t) OVER w, 0), 1) AS dt, n - coalesce(lag(n) OVER w, 0) AS dn FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t AS elapsed_secs, n::BIGINT AS writes, dn::DOUBLE / dt AS recent_writes, n::DOUBLE / greatest(t, 1) AS avg_writes FROM q", "ev")
def soak_summary(d):
    from pyspark.sql.window import Window

    total = F.sum(F.col("event_id") % 10).over(Window.partitionBy("user_id").orderBy("event_id"))
    reports = d.events.select("user_id", F.col("event_id").cast("double").alias("elapsed_secs"), total.alias("writes"))
    return ops.soak_summary(reports, ["user_id"], "elapsed_secs", ["writes"])


@query("SELECT conv_id, turn, level, msg, is_match FROM (SELECT *, max(is_match) OVER (PARTITION BY conv_id ORDER BY turn, level, msg ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT *, (CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END)::INTEGER AS is_match FROM lines)) WHERE near = 1", "lines")
def log_context(d):
    ordered = d.log_lines.withColumn("at", F.struct("turn", "level", "msg"))
    return ops.log_context(ordered, ["conv_id"], "at", F.col("level") == "ERROR", 1, 2).select("conv_id", "turn", "level", "msg", "is_match")


@query(r"SELECT regexp_replace(regexp_replace(regexp_replace(msg, 'Pba\(\d+\)', 'Pba(#)', 'g'), '\b0x[0-9a-fA-F]+\b', '0x#', 'g'), '\b\d+\b', '#', 'g') AS issue, count(*) AS n FROM issues GROUP BY 1", "issues")
def issue_histogram(d):
    return ops.issue_histogram(d.log_lines)


@query("SELECT count(CASE WHEN contains(lower(msg), 'user') THEN 1 END) AS \"user\", count(CASE WHEN contains(lower(msg), 'retry 1') THEN 1 END) AS retry_1 FROM issues", "issues")
def signal_counts(d):
    return ops.signal_counts(d.log_lines, ["User", "retry 1"])


@query("+u AS (SELECT vol_id, min(lba) AS s, count(*) AS n FROM b GROUP BY vol_id, g, p // 32) SELECT vol_id, count(*) AS units, sum(n)::BIGINT AS lbas, (sum(n) * 4096)::BIGINT AS bytes FROM u GROUP BY 1".replace("+u", f"+{_UNITS}, u"), "writes")
def flush_counters(d):
    return ops.flush_counters(writelog.coalesce(writelog.latest(d.writes)))


@query("SELECT w.vol_id, size_bytes, created_at, coalesce(n, 0) AS write_ops FROM vols w LEFT JOIN (SELECT vol_id, count(*) AS n FROM writes WHERE vol_id <> 'vol-2' GROUP BY 1) m ON m.vol_id = w.vol_id", "vols", "writes")
def volume_metrics(d):
    metrics = d.writes.filter("vol_id <> 'vol-2'").groupBy("vol_id").agg(F.count("*").alias("write_ops"))
    return ops.volumes_with_metrics(d.volumes, metrics)


def _units(d: Derived, code: Column) -> DataFrame:
    docs = d.table("documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    return docs.withColumn("unit", codecs.compressed(F.col("data"), code)).select("doc_id", "data", "unit.code", F.col("unit.data").alias("packed"))


@query()
def compress_ratio(d):
    return ops.compression_totals(_units(d, F.lit(2)).select(F.octet_length("data").alias("original_size"), F.octet_length("packed").alias("compressed_size")))


@query("SELECT doc_id, doc_id % 3 AS wanted, 'ok' AS status, true AS same FROM documents WHERE text IS NOT NULL")
def decode_roundtrip(d):
    units = _units(d, (F.col("doc_id") % 3).cast("int"))
    out = codecs.decoded_unit(F.col("packed"), F.lit(0), F.octet_length("packed"), F.octet_length("data"), F.col("code"), F.crc32("packed"))
    return units.withColumn("u", out).select("doc_id", (F.col("doc_id") % 3).alias("wanted"), "u.status", F.col("u.payload").eqNullSafe(F.col("data")).alias("same"))


@query("SELECT vol_id, lba, pba, crc32, slot_offset, true AS same FROM bm", "bm")
def codec_roundtrip(d):
    """Mappings through their stored form and back."""
    coded = d.blockmap.withColumn("key", codecs.legacy_key(F.col("vol_id"), F.col("lba"))).withColumn("value", codecs.mapping_value())
    back = coded.withColumn("k", codecs.decoded_legacy_key(F.col("key"))).withColumn("v", codecs.decoded_mapping(F.col("value")))
    same = (F.octet_length("value") == 28) & (F.col("v.unit_original_size") == F.col("unit_original_size")) & (F.col("v.flags") == F.col("flags")) & (F.col("v.offset_in_unit") == F.col("offset_in_unit"))
    return back.select("k.vol_id", "k.lba", "v.pba", "v.crc32", "v.slot_offset", same.alias("same"))


# Streams, drained


def _own_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="blockprism-stream-")


def _drained(spark: SparkSession, rows: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a job has made of rows that arrive as files, when all have been read."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_folder(spark)
    at = f"{root}/stream-{uuid.uuid4().hex}"
    rows.repartition(3).write.mode("overwrite").parquet(f"{at}/in")
    stream = jobs.log_stream(spark, f"{at}/in", rows.schema, max_files=1)
    if mode == "update":
        jobs.maintain(job(stream), f"{at}/out", f"{at}/state").awaitTermination()
        return jobs.maintained(spark, f"{at}/out")
    job(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT vol_id, lba, max(seq) AS seq FROM writes GROUP BY 1, 2", "writes")
def stream_blockmap(d):
    return _drained(d.spark, d.writes, jobs.current_map, "update")


@query("SELECT DISTINCT hash FROM docb", "docb")
def stream_dedup(d):
    return _drained(d.spark, d.doc_blocks.select("hash"), jobs.first_copies, "append").select("hash")


from blockprism.plans import lookups  # noqa: E402, F401  registers its queries with the above
