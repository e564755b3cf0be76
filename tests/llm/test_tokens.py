from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from blockprism.llm import id_files, packing
from blockprism.llm.common import Scratch
from blockprism.llm.queries import tokenizer_path
from blockprism.llm.token_ids import Encoder

from .helpers import docs, random_texts

ODD = ["", " ", "a  b", " x y", "x ", "a\n b", "a \nb", "\nab", "a\n\nb", "\n", "q\n\tz", "<|endoftext|> x", "it's we 're I'll", "— b — ", "x\x85 y", "a　b", "é ü ñandú", "1 23 4,5", "日本 語", "\U0001f600 ok", "a" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_ids_are_those_of_the_whole_text(encoder):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["ab", "Cd", " ", "\n", ",", "é", "7", "'s", "'", "!", "\t", "re", "|"]) for _ in range(40)) for _ in range(300)]
    for _ in range(2):  # the second time from what was learned
        assert split(*encoder.encode(texts)) == [plain(encoder, t) for t in texts]


def test_forgetting_changes_nothing(encoder, monkeypatch):
    import blockprism.llm.token_ids as module

    monkeypatch.setattr(module, "_WORDS", 5)
    for text in random_texts(4, 10, 50, 40):
        assert split(*encoder.encode([text])) == [plain(encoder, text)]


def traced(run):
    """Bytes that a call held at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_learning_costs_what_is_new_not_what_is_known():
    own = Encoder(tokenizer_path())
    own.encode([" ".join(f"w{k:x}" for k in range(100_000))])
    own.encode(["makes room for more"])
    assert traced(lambda: own.encode(["not one of these"])) < 1 << 20


def watched(monkeypatch, own, name):
    """The arguments of all calls of a method from now on."""
    calls, run = [], getattr(own, name)
    monkeypatch.setattr(own, name, lambda *x: calls.append(x) or run(*x))
    return calls


def test_words_of_letters_go_past_the_expression(monkeypatch):
    own = Encoder(tokenizer_path())
    calls = watched(monkeypatch, own, "_plain")
    texts = ["Erst\nzweitens dritt\xe8rement \u010desky \u01c5ep \u023fa", "\nAnfang ohneende", "viertens"]
    assert split(*own.encode(texts)) == [plain(own, t) for t in texts]
    assert not [x for (given,) in calls for x in given]


def test_signs_among_letters_are_parts_of_their_own():
    own = Encoder(tokenizer_path())
    texts = [f"a {x}b c{x} {x} d{x}{x}e\n{x}f\n{x} g{x}h" for x in "\xd7\xf7\xaa\xb5\xba\xc0\xff\u01c0\u023f\u0240\u024f\u02b0'7"] + ["it's ws'd 're\n's", "\n", "\nb"]
    for _ in range(2):
        assert split(*own.encode(texts)) == [plain(own, t) for t in texts]


def test_words_met_again_outlast_forgetting(monkeypatch):
    import blockprism.llm.token_ids as module

    monkeypatch.setattr(module, "_WORDS", 50)
    own = Encoder(tokenizer_path())
    often = " ".join(f"often{k:x}" for k in range(16))
    for _ in range(2):
        own.encode([often])
    own.encode([" ".join(f"once{k:x}" for k in range(60))])
    calls = watched(monkeypatch, own, "_learn_words")
    assert split(*own.encode([often, "another"])) == [plain(own, often), plain(own, "another")]
    assert own.words.used < 50 and [len(x[1]) for x in calls] == [1]
    own.encode([" ".join(f"new{k:x}" for k in range(60))])
    own.encode([""])
    assert own.words.used == 16  # what was met again since then


def test_forgetting_holds_little():
    own = Encoder(tokenizer_path())
    text = " ".join(f"w{k:x}" for k in range(100_000))
    for _ in range(2):
        own.encode([text])
    assert traced(own._forget_words) < 14 << 20
    assert own.words.used == 100_000


def test_characters_at_the_edges_of_what_is_regular(encoder):
    texts = [f"a {x}b c{x} {x} d{x}{x}e\t{x}f" for x in "!~\x7f\x80\xa0\xa1\xbf\xc0\u0100\u0240\u024f\u0250\u027f\u0800\t\0"]
    assert split(*encoder.encode(texts)) == [plain(encoder, t) for t in texts]


# Packing


def test_cutting_holds_little_of_a_batch():
    texts = [" ".join(f"w{(k * 31 + j * 7) % 5000}" for j in range(2000)) for k in range(200)]  # of 11 KB each
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    cut = packing._cut(tokenizer_path(), 2, 1024)
    before = list(cut(iter([batch])))
    assert traced(lambda: list(cut(iter([batch])))) < 16 << 20
    assert sum(b.num_rows for b in before) >= len(texts)


def test_packing_is_whole_valid_and_tight(spark, encoder):
    texts = [" ".join(f"word{k * j % 50}" for j in range(k * 37 % 900 + 1)) for k in range(120)] + [None, "", "x " * 3000]
    rows = [r.asDict() for r in packing.pack(docs(spark, texts), tokenizer_path(), capacity=256, small=(16, 64, 256)).collect()]
    for k, text in enumerate(texts):
        ids = [*plain(encoder, text), 2]
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert all(r["length"] == 256 for r in own[1:]) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.03 * math.ceil(sum(r["length"] for r in rows) / 256) + 1


@pytest.mark.parametrize("groups", [3, 16, 64])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_serve_every_rank_once(seed, groups):
    r = random.Random(seed)
    lengths = [r.choice([r.randrange(1, 65), 40, 64, 3]) for _ in range(400)]
    counts = Counter(lengths)
    large, base = packing.plan_large({x: n for x, n in counts.items() if x > 6}, 64, groups)
    used = Counter()

    def places(slots, length, n):
        start, kind, first = slots.frozen()[length]
        at = np.searchsorted(start, np.arange(n), "right") - 1
        return list(zip(kind[at].tolist(), (first[at] + np.arange(n) - start[at]).tolist(), strict=True))

    for x in counts:
        if x > 6:
            for _, s in places(large, x, counts[x]):
                used[s] += x
    assert len(used) == base and max(used.values()) <= 64
    rooms, ranked = Counter(), {}
    for s, n in sorted(used.items()):
        if n < 64:
            ranked[64 - n, rooms[64 - n]] = s
            rooms[64 - n] += 1
    small = packing.plan_small({x: n for x, n in counts.items() if x <= 6}, rooms, 64, base)
    for x in counts:
        if x <= 6:
            for kind, to in places(small, x, counts[x]):
                used[ranked[kind, to] if kind else to] += x
    assert sum(used.values()) == sum(lengths) and max(used.values()) <= 64


def test_threshold_needs_no_more_than_best_fit():
    r = random.Random(4)
    for _ in range(10):
        counts = Counter(r.randrange(1, 65) for _ in range(80))

        def needed(small):
            choice = packing.threshold(counts, 64, 64, (small,))
            large, base = packing.plan_large({x: n for x, n in counts.items() if x > choice}, 64, 64)
            return choice, base

        assert needed(64) == (64, 0)  # nothing is large: best fit alone
        best = packing.threshold(counts, 64, 64, (4, 16, 32, 64))
        assert best in (4, 16, 32, 64)


def test_fullest_finds_an_exact_fill():
    sizes = [60, 33, 31, 20, 7]
    assert sum(sizes[k] * n for k, n in packing._fullest(sizes, [1, 2, 2, 3, 9], 1, 67)) == 100


# Files of ids


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("most", [2, 50257])
def test_segments_give_back_all_ids(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    sizes = np.array([n - n // 2, n // 2])
    data = id_files.pack_segment([None, 7], sizes, ids, 256)
    found, lengths, blocks = id_files.unpack_segment(data)
    assert found == [None, 7] and lengths.tolist() == sizes.tolist() and np.array_equal(np.concatenate(blocks), ids)
    last = len(blocks) - 1
    assert np.array_equal(id_files.unpack_segment(data, [last])[2][0], blocks[last])


def test_coder_predicts(encoder):
    ids, _ = encoder.encode(["the same words come again and again " * 200])
    assert len(id_files.pack_segment([1], np.array([len(ids)]), ids, 4096)) < 0.3 * len(ids)


def test_a_segment_is_written_as_ever():
    ids = (np.arange(40_000) ** 2 * 31 % 977 * 204).astype(np.uint32)  # up to 199,104
    assert zlib.crc32(id_files.pack_segment([1], np.array([len(ids)]), ids, 300)) == 4207340148


def test_what_blocks_have_learned_is_small():
    mixer = id_files._Mixer(64)
    held = [x for v in vars(mixer).values() for x in (v if isinstance(v, list) else [v])]
    assert sum(x.nbytes for x in held) <= 64 * 4 * (2 * (1 << id_files._SLOTS) + 16 + 4)  # tables, shares, ids and rows
    mixer.predict(64)
    assert {x.itemsize for x in (mixer.two, mixer.one, *mixer.seen, *mixer.trust)} == {4}


@pytest.mark.parametrize("kind", [bool, np.uint16, np.int32])
def test_steps_do_not_share_places_of_the_cache(kind):
    rows = id_files._steps(8, 4096, kind)
    assert rows.shape == (8, 4096) and rows[0].flags.c_contiguous and not rows.any()
    assert rows.strides[0] % 4096 == 64


def test_damage_is_noticed():
    ids = np.arange(1000, dtype=np.uint32) % 300
    data = bytearray(id_files.pack_segment([1], np.array([1000]), ids, 256))
    for at in (12, len(data) - 9):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises((ValueError, IndexError)):
            id_files.unpack_segment(bytes(bad))


def test_round_trip_in_ascending_order(spark, encoder):
    texts = [*random_texts(9, 40, 400, 90), None, "", "!"]
    table = docs(spark, texts, first=-5).repartition(7)
    scratch = Scratch(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    id_files.write_ids(table, f"{scratch.root}/ids", tokenizer_path(), segment=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(f"{scratch.root}/ids")
    assert written.count() > 1
    found = sorted(tuple(r) for r in id_files.read_ids(written).collect())
    at, expected = 0, []
    for k, text in enumerate(texts, -5):
        ids = np.array([*plain(encoder, text), 0], "<u4")
        expected.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert found == expected


def test_groups_hold_several_lengths_of_about_equal_cardinality():
    counts = {x: 20 + x % 7 for x in range(65, 1024)} | {1024: 12_000}
    found = packing.grouped(counts, 48)
    assert [x for own in found for x in own] == sorted(counts, reverse=True)
    assert len(found) <= 48 and found[0] == [1024]
    sizes = [sum(counts[x] for x in own) for own in found[1:]]
    assert min(map(len, found[1:])) > 10 and max(sizes) < 1.3 * min(sizes)


def test_rooms_follow_the_slots():
    counts = {900: 5, 700: 4, 500: 9, 300: 3}
    slots, base = packing.plan_large(counts, 1024, 2)
    used = {}
    for length, rows in slots.rows.items():
        rows = sorted(rows)
        for (rank, _, first), to in zip(rows, [*(r[0] for r in rows[1:]), counts[length]], strict=True):
            for k in range(to - rank):
                used[first + k] = used.get(first + k, 0) + length
    rooms = packing.rooms_of(slots, counts, base, 1024)
    assert len(used) == base and max(used.values()) <= 1024
    expected = {}
    for x in used.values():
        expected[1024 - x] = expected.get(1024 - x, 0) + 1
    expected.pop(0, None)
    assert dict(rooms) == expected
