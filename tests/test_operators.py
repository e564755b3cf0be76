"""Operators on hand-made tables, and against plain Python models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from blockprism.operators import audit, blockmap, dedup, gc, ops, readpath, space, writelog
from blockprism.plans.derive import _mapped


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


def writes(spark, *found):
    return spark.createDataFrame(found or [], "vol_id string, lba bigint, seq bigint")


# The write log


@pytest.mark.parametrize(
    ("found", "units"),
    [
        ([("a", 1, 1), ("a", 2, 2), ("a", 4, 3)], [("a", 1, 2, 2), ("a", 4, 1, 3)]),  # a gap
        ([("a", 1, 1), ("b", 2, 2)], [("a", 1, 1, 1), ("b", 2, 1, 2)]),  # volumes
        ([("a", k, k) for k in range(33)], [("a", 0, 32, 31), ("a", 32, 1, 32)]),  # the cap
        ([("a", 1, 1), ("a", 1, 5), ("a", 2, 2)], [("a", 1, 2, 5)]),  # an overwrite
        ([], []),
    ],
)
def test_coalesce(spark, found, units):
    assert rows(writelog.coalesce(writelog.latest(writes(spark, *found)))) == sorted(units)


def test_coalesce_caps_by_bytes_and_zones(spark):
    current = writelog.latest(writes(spark, *[("a", k, k) for k in range(10)]))
    assert [r[2] for r in rows(writelog.coalesce(current, max_bytes=3 * 4096))] == [3, 3, 3, 1]
    assert [r[1:3] for r in rows(writelog.coalesce(current, zone_size=4))] == [(0, 4), (4, 4), (8, 2)]


def log(spark, *found):
    return spark.createDataFrame(found, "seq bigint, shard int, flushed boolean, lba_count bigint, vol_id string, start_lba bigint")


def test_reclaimable_stops_at_the_first_failure(spark):
    df = log(spark, (1, 0, True, 1, "a", 0), (2, 0, True, 1, "a", 0), (3, 0, False, 1, "a", 0), (4, 0, True, 1, "a", 0), (5, 1, True, 1, "a", 0), (9, 1, True, 1, "a", 0))
    assert rows(writelog.reclaimable(df, 6), "seq") == [(1,), (2,), (5,)]


def test_progress_counts_a_block_once(spark):
    df = log(spark, (1, 0, False, 4, "a", 10), (2, 0, False, 1, "a", 0))
    marks = spark.createDataFrame([(1, 10, 2), (1, 11, 2), (1, 10, 2)], "seq bigint, start_lba bigint, lba_count bigint")
    assert rows(writelog.flush_progress(df.drop("flushed"), marks), "seq", "flushed", "remaining", "done") == [(1, 3, 1, False), (2, 0, 1, False)]


def test_discards_are_events(spark):
    gone = spark.createDataFrame([("a", 5, 0, 3), ("a", 1, 4, 1), ("a", 9, 7, 0)], "vol_id string, seq bigint, start bigint, count bigint")
    assert rows(writelog.apply_discards(writes(spark, ("a", 1, 4), ("a", 2, 6), ("a", 4, 3), ("a", 7, 1)), gone), "lba") == [(2,), (4,), (7,)]


def test_recovery_walks_until_a_gap(spark):
    entry = "shard int, disk_offset bigint, disk_len bigint, seq bigint"
    found = [(0, 0, 4096, 8), (0, 4096, 4096, 3), (0, 8192, 4096, 5), (0, 12288, 4096, 9), (0, 16384, 4096, 10), (0, 24576, 4096, 11)]
    point = spark.createDataFrame([(0, 12288, 4096, 5, 8192)], "shard int, head_offset bigint, tail_offset bigint, max_seq bigint, used_bytes bigint")
    assert rows(writelog.recovered(spark.createDataFrame(found, entry), point), "seq") == [(10,), (3,), (5,), (9,)]


def test_ring_wraps(spark):
    df = spark.createDataFrame([(0, k, 4096 * 3) for k in range(4)], "shard int, seq bigint, disk_len int")
    assert [r[1:] for r in rows(writelog.ring_offsets(df, 4096 * 8), "shard", "seq", "disk_offset")] == [(0, 0), (1, 12288), (2, 0), (3, 12288)]


def test_generations(spark):
    volumes = spark.createDataFrame([("a", 7)], "vol_id string, created_at bigint")
    df = spark.createDataFrame([("a", 7), ("a", 6), ("a", 0), ("b", 7), ("b", 0)], "vol_id string, vol_created_at bigint")
    strict = [("a", 0, True), ("a", 6, True), ("a", 7, False), ("b", 0, True), ("b", 7, True)]
    assert rows(writelog.mark_stale(df, volumes)) == strict
    assert [r[2] for r in rows(writelog.mark_stale(df, volumes, zero_is_wildcard=True))] == [False, True, False, False, True]
    assert rows(writelog.next_generations(spark.createDataFrame([("b",), ("a",)], "vol_id string"), last=9, now=3)) == [("a", 10), ("b", 11)]


def test_small_log_operators(spark):
    df = log(spark, (1, 0, True, 1, "a", 0), (2, 0, False, 1, "a", 3))
    assert writelog.shard_layout(10 * 4096 + 100, 3) == [(0, 0, 12288), (1, 12288, 12288), (2, 24576, 10 * 4096 + 100 - 24576)]
    assert rows(writelog.purge(df, seqs=spark.createDataFrame([(1,)], "seq bigint")), "seq") == [(2,)]
    assert writelog.purge(df, "a").isEmpty()
    good = spark.createDataFrame([("x" * n, 1, bytearray(4096)) for n in (1, 255, 256)] + [("", 1, bytearray(4096)), ("v", 2, bytearray(4096)), ("v", 0, bytearray(0))], "vol_id string, lba_count int, payload binary")
    assert [len(r[0]) for r in rows(writelog.valid_entries(good), "vol_id")] == [1, 255]
    units = spark.createDataFrame([([(1, 0, 1), (2, 1, 1)],), ([(2, 2, 1)],)], "seq_lba_ranges array<struct<seq:bigint,lba:bigint,count:int>>")
    assert rows(writelog.unfinished_units(units)) == [(1, 1), (2, 2)]
    parts = spark.createDataFrame([(1, True), (1, False), (2, True)], "seq bigint, done boolean")
    assert rows(writelog.completed(parts)) == [(2,)]
    index = writes(spark, ("a", 1, 5), ("a", 2, 6))
    assert rows(writelog.evict(index, writes(spark, ("a", 1, 5), ("a", 2, 4)))) == [("a", 2, 6)]
    numbered = writelog.numbered_batches(spark.range(70).withColumn("k", F.lit(1)), ["k"], "id")
    assert rows(numbered.groupBy("batch").count()) == [(0, 32), (1, 32), (2, 6)]


def test_current_entry_prefers_seq_then_generation(spark):
    df = spark.createDataFrame([("a", 1, 5, 1, "x"), ("a", 1, 5, 2, "y"), ("a", 1, 4, 9, "z")], "vol_id string, lba bigint, seq bigint, vol_created_at bigint, tag string")
    assert rows(writelog.current_entry(df), "tag") == [("y",)]


# The block map against a model


def mapping(spark, found):
    return _mapped(writes(spark, *found))


@pytest.mark.parametrize("seed", [7, 19, 43])
def test_random_steps_match_a_shadow_model(spark, seed):
    r = random.Random(seed)
    shadow: dict[tuple, int] = {}
    table = mapping(spark, [])
    counts = blockmap.refcounts(table)
    for step in range(6):
        kind = r.random()
        if kind < 0.7:
            batch = {(f"v{r.randrange(2)}", r.randrange(12)): step * 50 + r.randrange(6) for _ in range(8)}
            table, counts, zero = blockmap.write_batch(table, counts, mapping(spark, [(*k, s) for k, s in batch.items()]))
            before = set(shadow.values())
            shadow |= batch
            assert {x[0] - 8 for x in rows(zero, "start_pba")} == before - set(shadow.values())
        else:
            lo = r.randrange(12)
            before = set(shadow.values())
            table, counts, zero = blockmap.without_range(table, counts, "v0", lo, lo + 5)
            shadow = {k: s for k, s in shadow.items() if not (k[0] == "v0" and lo <= k[1] < lo + 5)}
            assert {x[0] - 8 for x in rows(zero, "start_pba")} == before - set(shadow.values())
        table, counts = (spark.createDataFrame(df.collect(), df.schema) for df in (table, counts))  # or the plan grows
        assert {(v, a): p - 8 for v, a, p in rows(table, "vol_id", "lba", "pba")} == shadow
        assert blockmap.drift(counts, table).filter("state <> 'ok'").isEmpty()


def test_counts_never_fall_below_zero(spark):
    stored = spark.createDataFrame([(1, 2), (2, 1)], "pba bigint, refcount bigint")
    deltas = spark.createDataFrame([(1, -5), (2, -1), (2, 3), (3, 1)], "pba bigint, delta bigint")
    assert rows(blockmap.adjusted(stored, deltas)) == [(2, 3), (3, 1)]


def test_rebuilt_counts(spark):
    table = mapping(spark, [("a", 1, 1), ("a", 2, 1), ("b", 1, 2)])
    stored = spark.createDataFrame([(9, 1), (77, 4), (10, 1)], "pba bigint, refcount bigint")
    counts, summary = blockmap.rebuilt(stored, table)
    assert rows(counts) == [(10, 1), (9, 2)] and rows(summary) == [(2, 1, 1)]


def test_references_to_one_block(spark):
    table = mapping(spark, [("a", 1, 1), ("a", 2, 1), ("b", 1, 2)])
    assert blockmap.count_references(table, 9) == 2 and blockmap.has_reference(table, 10) and not blockmap.has_reference(table, 11)


def test_resolved_volumes(spark):
    volumes = spark.createDataFrame([("b", 1), ("a", 2)], "vol_id string, created_at bigint")
    assert [r["vol_id"] for r in blockmap.resolved(volumes, ["b", "a", "b"]).collect()] == ["b", "a", "b"]
    assert [r["vol_id"] for r in blockmap.resolved(volumes, []).collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        blockmap.resolved(volumes, ["c"])


# Space


@pytest.mark.parametrize("bucket", [4, 16, 1 << 20])
@pytest.mark.parametrize("most", [3, 1 << 32])
def test_free_extents_are_the_gaps(spark, bucket, most):
    r = random.Random(bucket)
    taken = sorted(r.sample(range(100), 40))
    free = rows(space.free_extents(spark.createDataFrame([(p,) for p in taken], "pba bigint"), 90, bucket, most))
    covered = [p for s, n in free for p in range(s, s + n)]
    assert sorted(covered) == [p for p in range(8, 90) if p not in taken] and max(n for _, n in free) <= most


def test_free_extents_of_nothing(spark):
    assert rows(space.free_extents(spark.createDataFrame([], "pba bigint"), 20)) == [(8, 12)]


@pytest.mark.parametrize("region", [4, 64])
def test_merged_extents(spark, region):
    r = random.Random(region)
    found = [(r.randrange(200), r.randrange(0, 9)) for _ in range(60)]
    got = rows(space.merged(spark.createDataFrame(found, "start_pba bigint, block_count bigint"), region))
    covered = sorted({p for s, n in found for p in range(s, s + n)})
    assert sorted(p for s, n in got for p in range(s, s + n)) == covered
    assert len(got) == sum(p - 1 not in covered for p in covered)


def test_pack_next_fit(spark):
    sizes = [1000, 3000, 96, 1, 5000, 4095, 4096, 2]
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate(sizes)], "lane string, order_key bigint, size bigint")
    assert [r[3:] for r in rows(space.pack(df))] == [(0, 0), (0, 1000), (0, 4000), (1, 0), (-1, 0), (1, 1), (-1, 0), (2, 0)]


def test_aged_slots_are_sealed(spark):
    df = spark.createDataFrame([("a", k, 10, ts) for k, ts in enumerate([0.0, 0.02, 0.06, 0.2])], "lane string, order_key bigint, size bigint, ts double")
    assert [r[3] for r in rows(space.pack(df, max_age=0.05))] == [0, 0, 1, 2]


def test_allocation_is_first_fit_else_the_largest(spark):
    free = spark.createDataFrame([("a", 10, 2), ("a", 20, 6), ("a", 30, 3)], "lane string, start_pba bigint, block_count bigint")
    wants = spark.createDataFrame([("a", k, n) for k, n in enumerate([3, 2, 9, 1, 2, 2])], "lane string, order_key bigint, blocks bigint")
    assert [r[2:] for r in rows(space.allocate(free, wants))] == [(20, 3), (10, 2), (23, 3), (30, 1), (31, 2), (None, 0)]
    assert rows(space.first_fit(free.drop("lane"), 7)) == [(20, 6)]


def test_overlaps(spark):
    e = "start_pba bigint, block_count bigint"
    a, b = spark.createDataFrame([(0, 5), (10, 1), (50, 100)], e), spark.createDataFrame([(4, 2), (11, 3), (140, 20)], e)
    assert rows(space.overlapping(a, b, bucket=8)) == [(0, 5, 4, 2), (50, 100, 140, 20)]


# Garbage collection


def test_candidates_tell_rows_from_blocks(spark):
    shared = [("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 8, 1)]  # four mappings, two blocks of a unit of eight
    found = gc.candidates(mapping(spark, shared), limit=None).first()
    assert (found["live_rows"], found["live_blocks"], found["dead_ratio"]) == (4, 2, 0.5)
    assert gc.candidates(mapping(spark, shared), 0.6, distinct=True).count() == 1 and gc.candidates(mapping(spark, shared), 0.6).count() == 0
    assert [r["vol_id"] for r in found["refs"]] == ["a", "a", "b", "b"]


def test_candidates_keep_fragments_apart(spark):
    one = mapping(spark, [("a", 0, 1)])
    other = one.withColumn("lba", F.lit(1).cast("bigint")).withColumn("crc32", F.lit(5).cast("bigint"))
    assert gc.candidates(one.unionByName(other)).count() == 2
    assert gc.candidates(one.withColumn("unit_lba_count", F.lit(1).cast("bigint")), -1).isEmpty()


def test_hysteresis(spark):
    fills = spark.createDataFrame([(0, k, v) for k, v in enumerate([60, 81, 70, 51, 50, 70, 80, 90])], "g int, t int, fill int")
    assert [r[0] for r in gc.hysteresis(fills, ["g"], "t").orderBy("t").select("paused").collect()] == [False, True, True, True, False, False, False, True]


# Dedup


def test_hits_are_accepted_in_order(spark):
    stored = spark.createDataFrame([(1, 1), (2, 1)], "pba bigint, refcount bigint")
    batch = [(1, "a", 0, 1, 2), (2, "a", 1, 2, None), (3, "a", 2, 1, 1), (4, "a", 3, 9, None), (5, "a", 4, 1, None)]
    found = dedup.accept_hits(spark.createDataFrame(batch, "seq bigint, vol_id string, lba bigint, pba bigint, old_pba bigint"), stored)
    assert [r[4] for r in rows(found)] == ["accepted", "rejected", "refreshed", "rejected", "accepted"]


def test_cleanup_spares_what_points_elsewhere(spark):
    index = spark.createDataFrame([("h1", 1), ("h2", 5)], "hash string, pba bigint")
    reverse = spark.createDataFrame([(1, "h1"), (1, "h2"), (5, "h2")], "pba bigint, hash string")
    after, left = dedup.cleanup(index, reverse, spark.createDataFrame([(1,)], "pba bigint"))
    assert rows(after, "hash") == [("h2",)] and rows(left) == [(5, "h2")]


def test_put_keeps_the_last_and_skips_empty_hashes(spark):
    index = spark.createDataFrame([("a1", 1)], "hash string, pba bigint")
    reverse = spark.createDataFrame([(1, "a1")], "pba bigint, hash string")
    new = spark.createDataFrame([("a1", 2, 1), ("a1", 3, 2), ("0" * 64, 4, 3)], "hash string, pba bigint, seq bigint")
    after, left = dedup.put_entries(index, reverse, new)
    assert rows(after) == [("a1", 3)] and rows(left) == [(3, "a1")]
    assert [rows(x) for x in dedup.drop_entry(after, left, after)] == [[], []]


def test_rescan(spark):
    table = mapping(spark, [("a", 0, 7), ("a", 1, 14), ("a", 2, 21), ("a", 3, 1)])
    hashes = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z")], "vol_id string, lba bigint, hash string")
    index = spark.createDataFrame([("x", 100), ("y", 22)], "hash string, pba bigint")
    plan = dedup.rescan_plan(table, index, hashes, 10, fill=50)
    assert rows(plan, "lba", "outcome") == [(0, "hit"), (1, "same"), (2, "miss")] and rows(dedup.rescan_stats(plan)) == [(3, 1, 1)]
    assert dedup.rescan_plan(table, index, hashes, 10, fill=91).isEmpty()


def test_cleanup_gate(spark):
    dead = spark.createDataFrame([(1,), (2,), (3,)], "pba bigint")
    stored = spark.createDataFrame([(1, 1)], "pba bigint, refcount bigint")
    free = spark.createDataFrame([(2, 1)], "start_pba bigint, block_count bigint")
    assert rows(dedup.cleanup_gate(dead, stored, free)) == [(3,)]


# Reads


def test_reads_put_blocks_together(spark):
    data = bytes(range(256)) * 40
    blocks = [(k, bytearray(data[k * 4096 : (k + 1) * 4096].ljust(4096, b"\0"))) for k in (0, 1)]
    ranges = spark.createDataFrame([(1, 100, 5000), (2, 8000, 500), (3, 4096, 4096), (4, 5, 0)], "id int, offset bigint, length bigint")
    parts = readpath.split_by_block(ranges).join(spark.createDataFrame(blocks, "lba bigint, block binary"), "lba", "left")
    got = {r["id"]: bytes(r["payload"]) for r in readpath.assembled(parts, ["id"]).collect()}
    assert got == {1: data[100:5100], 2: data[8000:8192] + bytes(308), 3: data[4096:8192]}


def test_read_modify_write(spark):
    parts = spark.createDataFrame([(10, bytearray(b"xyz"), None), (0, bytearray(b"q"), bytearray(b"a" * 4096))], "in_block bigint, data binary, block binary")
    found = [bytes(r["block"]) for r in readpath.read_modify_write(parts).collect()]
    assert found == [bytes(10) + b"xyz" + bytes(4083), b"q" + b"a" * 4095]


def test_decoded_once_and_mismatches(spark):
    units = spark.createDataFrame([(1, 0, 9, bytearray(b"a" * 4096 + b"b" * 4096))], "pba bigint, slot_offset int, unit_compressed_size int, payload binary")
    members = spark.createDataFrame([(1, 0, 9, 0, 1), (1, 0, 9, 1, 0)], "pba bigint, slot_offset int, unit_compressed_size int, pos int, offset_in_unit int")
    assert [bytes(r["block"][:1]) for r in readpath.decoded_blocks(units, members).orderBy("pos").collect()] == [b"b", b"a"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (4, "w")], "k int, v string")
    assert rows(readpath.mismatches(a, b, ["k"], "v")) == [(2, "y", "z"), (4, None, "w")]
    wrote = spark.createDataFrame([(0, 1, 5), (4096, 2, 6)], "disk_offset bigint, seq bigint, payload_crc32 bigint")
    assert rows(readpath.readback(wrote, wrote.filter("seq = 1")), "seq") == [(2,)]


# Operations


def test_rates_and_fill(spark):
    workers = spark.createDataFrame([(10, 1 << 20, 2.0, 0.0), (30, 3 << 20, 2.0, 2.0)], "ops bigint, bytes bigint, wall_secs double, drain_secs double")
    assert rows(ops.throughput(workers)) == [(40, 4 << 20, 2.0, 20.0, 50000.0, 1.0, 10.0)]
    shards = spark.createDataFrame([(0, 10, 0), (1, 1, 3)], "shard int, used_bytes bigint, capacity_bytes bigint")
    assert rows(ops.fill(shards), "shard", "fill_pct") == [(0, 100), (1, 33), (None, 366)]
    family = spark.createDataFrame([("a", "cache", 1), ("b", "cache", 2), ("a", "mem", 4)], "family string, property string, bytes bigint")
    assert rows(ops.memory_total(family)) == [("cache", 3), ("mem", 4), (None, 7)]


def test_logs(spark):
    lines = spark.createDataFrame([(k, "INFO" if k % 4 else "WARN", f"x {k}", "failure" if k in (2, 5) else "op") for k in range(9)], "line_no bigint, level string, msg string, event string").withColumn("g", F.lit(1))
    shown = ops.log_context(lines, ["g"], "line_no", F.col("line_no") == 4, 1, 2)
    assert [r[0] for r in rows(shown, "line_no")] == [3, 4, 5, 6]
    assert rows(ops.last_failure(lines), "line_no") == [(5,)] and rows(ops.last_issues(lines, 2), "line_no") == [(4,), (8,)]
    assert rows(ops.issue_histogram(lines, top=1)) == [("x #", 3)]  # of nine lines three are issues


def test_healthy_tables_pass_the_audit(spark):
    table = mapping(spark, [("a", 0, 1), ("a", 1, 1)]).withColumn("slot_offset", F.lit(0).cast("bigint"))
    volumes = spark.createDataFrame([("a", 4096 * 8)], "vol_id string, size_bytes bigint")
    index = spark.createDataFrame([("h", 9)], "hash string, pba bigint")
    taken = spark.createDataFrame([(9,)], "pba bigint")
    found = audit.audit(blockmap=table, volumes=volumes, index=index, reverse=index.select("pba", "hash"), stored=blockmap.refcounts(table), allocated=taken, free=space.free_extents(taken, 20), total=20)
    assert found.columns == audit.COLUMNS and found.isEmpty()


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    r = random.Random(3)
    found = writes(spark, *[("a", r.randrange(80), k) for k in range(300)])
    once = rows(writelog.coalesce(writelog.latest(found)))
    assert rows(writelog.coalesce(writelog.latest(found.orderBy(F.rand(1)).repartition(partitions)))) == once
