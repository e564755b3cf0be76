"""Whole paths against plain images of the volumes."""

from __future__ import annotations

import random

import pytest

from blockprism import schemas
from blockprism.operators import audit, blockmap
from blockprism.plans import engine

BLOCK = 4096


def block(r):
    kind = r.randrange(4)
    return bytes(BLOCK) if kind == 0 else bytes([r.randrange(3)]) * BLOCK if kind == 1 else (b"abc%d" % r.randrange(5) * BLOCK)[:BLOCK] if kind == 2 else r.randbytes(BLOCK)


def empty(spark, ddl):
    return spark.createDataFrame([], ddl)


def store(spark):
    volumes = spark.createDataFrame([("a", 64 * BLOCK, 5), ("b", 64 * BLOCK, 6)], "vol_id string, size_bytes bigint, created_at bigint")
    return engine.Store(volumes, empty(spark, schemas.BLOCKMAP), empty(spark, schemas.REFCOUNT), empty(spark, schemas.DEDUP_INDEX), empty(spark, schemas.DEDUP_REVERSE), empty(spark, "pba bigint, slot_offset int, unit_compressed_size int, data binary"))


def kept(spark, s):
    """The same store with its tables computed, or the plans grow."""
    return engine.Store(*(spark.createDataFrame(df.collect(), df.schema) for df in vars(s).values()))


@pytest.mark.parametrize("code", [1, 2])
def test_what_was_written_is_read(spark, code):
    r = random.Random(code)
    s, image, seq, first = store(spark), {}, 0, 8
    for _ in range(2):
        entries = []
        for _ in range(8):
            seq += 1
            vol, start, n = r.choice("ab"), r.randrange(30), r.randrange(1, 6)
            data = [block(r) for _ in range(n)]
            stale = r.random() < 0.2
            entries.append((seq, vol, start, n, 99 if stale else {"a": 5, "b": 6}[vol], bytearray(b"".join(data))))
            if not stale:
                image |= {(vol, start + k): x for k, x in enumerate(data)}
        log = spark.createDataFrame(entries, "seq bigint, vol_id string, start_lba bigint, lba_count int, vol_created_at bigint, payload binary")
        s, freed = engine.flush(s, log, first, code)
        s = kept(spark, s)
        first += 1000
    assert blockmap.drift(s.refcount, s.blockmap).filter("state <> 'ok'").isEmpty()
    assert len(set(image.values())) == len({tuple(x) for x in s.blockmap.select(*schemas.PHYSICAL_BLOCK).collect()})
    assert s.index.count() >= len(set(image.values()))  # blocks that nothing refers to stay known while their unit lives
    healthy = audit.audit(blockmap=s.blockmap, volumes=s.volumes, index=s.index, reverse=s.reverse, stored=s.refcount)
    assert [tuple(x) for x in healthy.collect()] == []
    wanted = [(k, *r.choice([("a", r.randrange(40)), ("b", r.randrange(40))])) for k in range(60)]
    buffered = spark.createDataFrame([("a", 3, 99, bytearray(b"z" * BLOCK))], "vol_id string, lba bigint, seq bigint, block binary")
    image["a", 3] = b"z" * BLOCK
    got = engine.read(s, spark.createDataFrame(wanted, "pos int, vol_id string, lba bigint"), buffered).collect()
    assert {x["status"] for x in got} == {"ok"}
    assert {x["pos"]: bytes(x["block"]) for x in got} == {k: image.get((v, lba), bytes(BLOCK)) for k, v, lba in wanted}

    after, rest, freed = engine.delete_volume(s, log, "a")
    assert rest.filter("vol_id = 'a'").isEmpty() and after.volumes.count() == 1
    assert blockmap.drift(after.refcount, after.blockmap).filter("state <> 'ok'").isEmpty()
    live = {x["pba"] for x in after.blockmap.select("pba").collect()}
    assert {x["start_pba"] for x in freed.collect()} == {x["pba"] for x in s.blockmap.select("pba").collect()} - live


def test_volumes_and_small_changes(spark):
    s = store(spark)
    made = engine.create_volumes(s, spark.createDataFrame([("c", 4096)], "vol_id string, size_bytes bigint"), 9, 3)
    assert [(x["vol_id"], x["created_at"]) for x in made.volumes.orderBy("vol_id").collect()] == [("a", 5), ("b", 6), ("c", 10)]
    with pytest.raises(ValueError):
        engine.create_volumes(s, spark.createDataFrame([("a", 1)], "vol_id string, size_bytes bigint"), 9, 3)
    row = ("a", 1, 70, 0, 4096, 4096, 1, 0, 1, 0, 0)
    one = spark.createDataFrame([row], schemas.BLOCKMAP)
    table, counts = blockmap.write_mapping(s.blockmap, s.refcount, one)
    assert counts.collect() == [(70, 1)]
    moved = spark.createDataFrame([("a", 1, 80, *row[3:])], schemas.BLOCKMAP)
    table, counts = blockmap.remap(table, counts, moved)
    assert counts.collect() == [(80, 1)] and table.first()["pba"] == 80
    assert blockmap.update_flags(table, table, True).first()["flags"] == 1
    with pytest.raises(ValueError):
        blockmap.dedup_hit(table, counts, one)
    swept, gone = engine.sweep_orphans(engine.Store(s.volumes, table, counts.union(counts.selectExpr("pba + 1", "refcount")), s.index, s.reverse, s.units))
    assert [x["pba"] for x in gone.collect()] == [81] and swept.refcount.collect() == [(80, 1)]
