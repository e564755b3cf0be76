from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from blockprism.llm import simhash, substring
from blockprism.llm.common import Scratch
from blockprism.llm.components import components

from .helpers import docs, random_texts, rows


def roots_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark))
    expected = {x: y for x, y in roots_of(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert dict(map(tuple, found.collect())) == expected


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(3, 3)], "a bigint, b bigint"), Scratch(spark)).isEmpty()


@pytest.mark.parametrize("family", [0, 1])
@pytest.mark.parametrize("radius", [1, 3, 6])
def test_masks_cover_every_pair_within_the_radius(radius, family):
    r = random.Random(radius)
    masks = simhash.covering_masks(radius, family)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), radius):
            y ^= 1 << bit
        assert any(x & m == y & m for m in masks)


def plain_fingerprint(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [8192, 2])
def test_near_duplicates_match_all_pairs(spark, bucket):
    r = random.Random(5)
    texts = random_texts(3, 60, 2000, 80) + [None, "", " ", "One Two", "one two"]
    for base in texts[:20]:
        words = (base or "").split()
        for _ in range(3):
            changed = list(words)
            if changed:
                changed[r.randrange(len(changed))] = "x"
            texts.append(" ".join(changed))
    prints = [plain_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = roots_of([*pairs, *((k, k) for k in range(len(prints)))])
    found = simhash.near_duplicates(docs(spark, texts), bucket=bucket)
    assert rows(found) == sorted([(k, f"{p:016x}", roots[k]) for k, p in enumerate(prints)], key=repr)
    assert any(k != c for k, c in roots.items())


def plain_sets(texts, shingle=5):
    out, number = [], {}
    for t in texts:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        out.append({number.setdefault(tuple(words[k : k + shingle]), len(number)) for k in range(max(len(words) and 1, len(words) - shingle + 1))})
    return out


def all_pairs(texts):
    """Each text's component by all pairs that share 0.8 of their five-word shingles, and those pairs."""
    sets = plain_sets(texts)
    pairs = []
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                pairs.append((a, b))
    return roots_of([*((k, k) for k in range(len(texts))), *pairs]), pairs


def compared(spark, texts, **options):
    """The groups found, each of which lies in one of all pairs; and the share of pairs that they hold."""
    found = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs(spark, texts), id_col="doc_id", **options).collect()}
    expected, pairs = all_pairs(texts)
    assert sorted(found) == list(range(len(texts))) and all(expected[k] == expected[c] for k, c in found.items())
    return found, sum(found[a] == found[b] for a, b in pairs) / len(pairs)


def edited(r):
    """Copies at all similarities from 0.7 to 1, and equal ones."""
    texts = random_texts(21, 15, 3000, 300) + [None, "", "one two", "one  two", "ONE two"]
    for base in random_texts(22, 120, 3000, 400):
        words = base.split()
        for _ in range(2):
            n = r.randrange(1 + len(words) // 40)
            copy = list(words)
            for at in (r.randrange(len(words)) for _ in range(n * bool(words))):
                copy[at] = f"x{r.randrange(100)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(words[: r.randrange(len(words) * 8 // 10, len(words))]) if len(words) > 5 else base)
        texts.append(base)
    return texts


def shared_line(r):
    """Texts of a line that fills their fingerprints and of passages of their own, each with two near copies."""
    texts = []
    for k in range(60):
        words = [f"t{k}w{j}" for j in range(60)]
        for c in range(3):
            copy = list(words)
            if c:
                copy[r.randrange(60)] = f"c{c}"
            texts.append("all rights reserved by the owners of this site " * 60 + " ".join(copy))
    return texts


def variants(r):
    """Hundreds of one text, near it but many not near one another."""
    words = [f"w{j}" for j in range(400)]
    return [" ".join(f"v{k}" if r.random() < 0.012 else w for w in words) for k in range(600)]


@pytest.mark.parametrize("make", [edited, shared_line, variants])
def test_similar_groups_against_all_pairs(spark, make):
    r = random.Random(4)
    texts = make(r)
    r.shuffle(texts)
    found, recall = compared(spark, texts)
    assert recall > 0.95
    if make is variants:
        assert compared(spark, texts, chunk=70)[0] == found
    if make is shared_line:
        assert compared(spark, texts, bucket=40)[1] > 0.95


def test_texts_behind_a_failed_link_are_asked(spark):
    line, tails = "p q r " * 1000, [[f"{c}{k}" for k in range(100)] for c in "st"]
    texts = [line + " ".join(x) for x in (tails[0], tails[1], [*tails[1][:50], "other", *tails[1][51:]])]
    found, recall = compared(spark, texts)
    assert found == {0: 0, 1: 1, 2: 1} and recall == 1


def test_candidates_by_forest_connect_as_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (6, 2), np.uint64)
    check = base[r.integers(0, 6, 300)] ^ (np.uint64(1) << r.integers(0, 64, (300, 2)).astype(np.uint64))
    half = (check[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for radius in (0, 1, 2):
        x, y = np.nonzero((np.bitwise_count(half[:, None] ^ half[None]) <= radius) & (np.bitwise_count(check[:, None] ^ check[None]).sum(axis=2) <= 5))
        wanted = roots_of(zip(x.tolist(), y.tolist(), strict=True))
        for find in (simhash.matched, simhash._forest):
            a, b = find(half, check, radius, 5)
            assert {**{k: k for k in range(300)}, **roots_of(zip(a.tolist(), b.tolist(), strict=True))} == wanted


def removed(texts, window=35):
    seen = Counter()
    split = [(t or "").encode().split() for t in texts]
    for words in split:
        seen.update(tuple(words[p : p + window]) for p in range(len(words) - window + 1))
    out = []
    for k, words in enumerate(split):
        mask = [False] * len(words)
        for p in range(len(words) - window + 1):
            if seen[tuple(words[p : p + window])] > 1:
                mask[p : p + window] = [True] * window
        kept = b" ".join(w for w, m in zip(words, mask, strict=True) if not m)
        out.append((k, len(words), sum(mask), kept.decode()))
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_repeats_match_all_windows(spark, shuffled, monkeypatch):
    if shuffled:  # what tables join by where they are too large to broadcast
        monkeypatch.setattr(substring, "_LISTED", -1)
        monkeypatch.setattr(substring, "_ANCHORS", -1)
    r = random.Random(11)
    base = random_texts(7, 12, 5000, 300)
    texts = [*base, None, "", "a " * 100, "a b " * 60, base[0], base[0]]
    for _ in range(25):  # passages of any length put into other texts
        words, into = r.choice(base).split(), r.choice(base).split()
        at, n = r.randrange(len(words) or 1), r.randrange(20, 60)
        texts.append(" ".join(into[:5] + words[at : at + n] + into[5:90]))
    found = substring.without_repeats(docs(spark, texts))
    assert rows(found) == sorted(removed(texts), key=repr)


def test_repeats_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    table = spark.createDataFrame([(1, text), (1, text), (None, "x " + text), (None, "short"), (2, "other " * 3)], "doc_id bigint, text string")
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.without_repeats(table).collect()), key=repr)
    assert found == [(1, 50, 50), (1, 50, 50), (2, 3, 0), (None, 1, 0), (None, 51, 50)]


def test_long_words_that_sums_take_for_one_another(spark):
    signs = ["ab"[k.bit_count() % 2] for k in range(2048)]
    one, other = "".join(signs), "".join("ba"[x == "b"] for x in signs)
    words = [f"w{k}" for k in range(41)]
    texts = [" ".join([*words[:20], x, *words[21:]]) for x in (one, other)]
    assert [r["n_removed"] for r in substring.without_repeats(docs(spark, texts)).collect()] == [0, 0]
    assert [r["n_removed"] for r in substring.without_repeats(docs(spark, [texts[0], texts[0]])).collect()] == [41, 41]


def test_a_passage_in_many_contexts(spark):
    passage = " ".join(f"p{k}" for k in range(36))
    texts = [" ".join([*(f"a{k}_{j}" for j in range(30)), passage, *(f"b{k}_{j}" for j in range(30))]) for k in range(3000)]
    assert {r["n_removed"] for r in substring.without_repeats(docs(spark, texts)).collect()} == {36}


def test_kept_digest_of_words_in_utf8(spark):
    found = substring.without_repeats(docs(spark, ["é\x0bü a"])).first()["kept"]
    assert hashlib.sha256(found.encode()).hexdigest() == hashlib.sha256("é ü a".encode()).hexdigest()


def test_anchor_is_the_rightmost_least():
    r = np.random.default_rng(1)
    grams = r.integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 5, 28):
        got = substring.anchors(grams, width)
        want = [max(range(p, p + width), key=lambda k: (-int(grams[k]), k)) for p in range(200 - width + 1)]
        assert got.tolist() == want
