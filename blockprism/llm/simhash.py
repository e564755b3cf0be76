"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64
values of its word shingles.  Texts link at ``radius`` or fewer differing bits.

Linking is exact.  Give every bit position i a vector m(i) of radius + 1 bits.
Each nonzero vector v makes a table whose mask keeps the positions with
<m(i), v> = 1.  The vectors of up to ``radius`` differing positions cannot span
all radius + 1 dimensions, so some v is orthogonal to all of them and that table's
mask hides every difference: the pair falls into one bucket of that table.

Only distinct fingerprints are linked, so a text copied by a third of all
documents is one row.  Within a bucket a search in breadth compares fingerprints
in numpy and emits a tree per group, never all pairs.  A bucket of more than
``bucket`` fingerprints is dealt again by a second covering family, which is as
exact, and goes to many tasks.

``similar_groups`` is for a similarity of the texts themselves, that of their sets
of word shingles.  A set's SimHash differs from another's in a share of bits that
follows from how alike the sets are, 0.15 at a similarity of 0.8, so fingerprints of
32 bits are within 3 bits of one another a quarter of the time; eight of them, each
covered by its 15 masks, miss less than a tenth of the pairs just at 0.8 and few
above.  Pairs that meet in a bucket are candidates if 128 bits of fingerprint bear
it out; components of candidates are then searched in breadth by the sets: every
pair of a component is asked, unless the two are already tied, and a text that
fails with one is still asked with the others.  A large component is cut into
chunks, and each pair of chunks is a search of its own.

A null text or one without words has fingerprint zero, and links like any other.
Repeated rows give repeated results.  A null id takes part in linking, but is
never a component's id unless the component has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, as_bytes, flat, lookup, pieces
from blockprism.llm.components import components
from blockprism.llm.rolling import Rolling
from blockprism.llm.substring import word_hashes

#: Tables of the first covering family, over all families of fingerprints, have numbers below this.
_TABLES = 1 << 16
#: Shingle hashes of a chunk of a component, about.
_CHUNK_BYTES = 8 << 20
#: Sets of the similarity asked for differ in at most so many standard deviations more bits than the mean.
_SURE = 3.2
#: Buckets of up to so many rows are compared side by side, larger ones each for itself.
_SMALL = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWERED = np.frombuffer(_LOWER, np.uint8)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    words = text.translate(_LOWER).split()  # of bytes: at \\x20 and \\x09-\\x0D only
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = np.array([fingerprint(t, shingle, seed) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Hashes of each text's distinct word shingles, ascending; a text of fewer words is one shingle, of none none."""
    data, offsets = flat(texts)
    hashes, before = word_hashes(_LOWERED[data], offsets)
    rolling, before = Rolling(hashes, 1), before.tolist()
    out = []
    for a, b in zip(before, before[1:], strict=False):
        starts = np.arange(a, max(a + (b > a), b - shingle + 1))
        out.append(np.unique(rolling.of(starts, np.minimum(starts + shingle, b))))
    return out


def set_prints(hashes: np.ndarray, words: int) -> list[int]:
    """SimHash of a set of hashes, ``words`` times 64 bits, each from the hashes mixed anew."""
    out = []
    for _ in range(words):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes ^ (hashes >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little"))
    return out


def _hashed(shingle: int, words: int):
    """Each text's fingerprints, and 128 bits of a hash of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1), shingle)
            prints = np.array([set_prints(x, words) for x in sets], np.uint64).reshape(-1, words).view(np.int64)
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(prints.reshape(-1)), words).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *(pa.array(np.ascontiguousarray(whole[:, k])) for k in range(2))], names=["doc_id", "fps", "th", "tl"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), shingle)], pa.binary())], names=["node", "shingles"])

    return run


def differing_bits(similarity: float, bits: int) -> int:
    """How many of so many bits differ at most, but for one pair in a thousand, between sets of at least this similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + _SURE * math.sqrt(bits * share * (1 - share)))


def matched(half: np.ndarray, check: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between places of a bucket: all pairs that match where these are fewer than places, or else a forest of them.

    ``half`` has the covered fingerprints, ``check`` a row of longer ones each.
    """
    n, firsts, seconds = len(half), [], []
    step = max(1, (1 << 20) // n)
    for at in range(0, n, step):
        x, y = np.nonzero(np.bitwise_count(half[at : at + step, None] ^ half[None, :]) <= radius)
        x += at
        x, y = x[x < y], y[x < y]
        good = np.bitwise_count(check[x] ^ check[y]).sum(axis=1) <= most
        firsts.append(x[good])
        seconds.append(y[good])
        if sum(map(len, firsts)) >= n:
            return _forest(half, check, radius, most)
    return np.concatenate(firsts), np.concatenate(seconds)


def _forest(half: np.ndarray, check: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    firsts, seconds, left = [], [], np.arange(len(half))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(half[left] ^ half[one]) <= radius
            near[near] = np.bitwise_count(check[left[near]] ^ check[one]).sum(axis=1) <= most
            if near.any():
                found, left = left[near], left[~near]
                firsts.append(np.full(len(found), one))
                seconds.append(found)
                frontier += list(found)
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _tables(words: int, radius: int):
    """A row for each node, half of a word and mask."""
    masks = np.array(covering_masks(radius, bits=32), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                fps = np.array(batch.column(1).to_pylist(), np.int64).view(np.uint64)
                half = np.stack([fps & np.uint64((1 << 32) - 1), fps >> np.uint64(32)], axis=2).reshape(len(fps), -1)  # by family
                shape = (*half.shape, len(masks))
                table = np.arange(2 * words)[:, None] << radius + 1 | np.arange(len(masks))
                word = np.arange(2 * words) // 2

                def of(x: np.ndarray, t: pa.DataType, shape=shape) -> pa.Array:
                    return pa.array(np.broadcast_to(x, shape).reshape(-1).astype(np.uint64).view(np.int64), pa.int64()).cast(t)

                columns = [(table[None], pa.int32()), (half[:, :, None] & masks, pa.int64()), (0, pa.int64()), (np.asarray(batch.column(0))[:, None, None], pa.int64()), (half[:, :, None], pa.int64()), (fps[:, word, None], pa.int64()), (fps[:, (word + 1) % words, None], pa.int64())]
                yield pa.RecordBatch.from_arrays([of(*x) for x in columns], names=["table", "key", "sub", "node", "fp", "x", "y"])

    return run


def _candidates(radius: int, most: int):
    """Over rows sorted by (table, key, sub): edges of each bucket, which may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = [np.asarray(batch.column(k)) for k in range(6)]
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            changes = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1
            open_from = int(changes[-1]) if len(changes) else 0
            if open_from:
                yield closed([x[:open_from] for x in rows], changes[:-1])
            kept = [x[open_from:] for x in rows]
        if kept:
            yield closed(kept, np.empty(0, np.int64))

    def closed(rows: list[np.ndarray], changes: np.ndarray) -> pa.RecordBatch:
        table, _, _, node, *checks = rows
        check = np.stack(checks, axis=1).view(np.uint64)
        half = (check[:, 0] >> (np.uint64(32) * (table % _TABLES >> radius + 1 & 1).astype(np.uint64))).astype(np.uint32)
        starts, sizes = np.r_[0, changes], np.diff(np.r_[0, changes, len(node)])
        of = np.repeat(np.where(sizes <= _SMALL, np.arange(len(sizes)), len(sizes)), sizes)  # the last number: a large one
        pairs = []
        for d in range(1, min(_SMALL, len(node))):
            x = np.flatnonzero((of[d:] == of[:-d]) & (of[d:] < len(sizes)) & (np.bitwise_count(half[d:] ^ half[:-d]) <= radius))
            x = x[np.bitwise_count(check[x] ^ check[x + d]).sum(axis=1) <= most]
            pairs.append((x, x + d))
        for k in np.flatnonzero(sizes > _SMALL).tolist():
            s, e = int(starts[k]), int(starts[k] + sizes[k])
            x, y = matched(half[s:e], check[s:e], radius, most)
            pairs.append((x + s, y + s))
        a, b = (np.concatenate([x[k] for x in pairs]) if pairs else np.empty(0, np.int64) for k in range(2))
        many = np.flatnonzero((sizes <= _SMALL) & (np.bincount(of[a], minlength=len(sizes) + 1)[: len(sizes)] >= sizes)) if len(a) and len(sizes) else []
        if len(many):  # a group of copies: its forest is enough
            trees = [tuple(x + starts[k] for x in _forest(half[starts[k] :][: sizes[k]], check[starts[k] :][: sizes[k]], radius, most)) for k in many]
            others = ~np.isin(of[a], many)
            a, b = (np.concatenate([x[others], *(t[j] for t in trees)]) for j, x in enumerate((a, b)))
        a, b = np.unique(np.stack([a, b], axis=1), axis=0).T if len(a) else (a, b)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return run


def verified(prints: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """A forest over texts, of edges whose ends are alike; ``prints`` has a row of fingerprints each, ``most`` of whose bits may differ."""
    edges, sizes = [], np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    left = np.arange(len(sets))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            size, own = sizes[left], sizes[one]
            may = np.flatnonzero(np.minimum(size, own) >= similarity * np.maximum(size, own))
            may = may[np.bitwise_count(prints[left[may]] ^ prints[one]).sum(axis=1) <= most]
            good = may[_alike(sets[one], every, starts[left[may]], size[may], similarity)]
            if len(good):
                found, left = left[good], np.delete(left, good)
                edges += [(one, x) for x in found]
                frontier += list(found)
    return edges


def _alike(own: np.ndarray, every: np.ndarray, starts: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the ascending set is as similar as asked to each of those that lie in ``every``; a piece of them at a time."""
    both = np.zeros(len(sizes), np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes) and len(own):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + (1 << 18), "right")))
        n = sizes[at:to]
        first = np.cumsum(n) - n
        values = every[np.repeat(starts[at:to] - first, n) + np.arange(n.sum())]
        hits = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        counted = np.concatenate([[0], np.cumsum(hits)])
        both[at:to] = counted[first + n] - counted[first]
        at = to
    return both >= similarity * (len(own) + sizes - both)


def _search(most: int, similarity: float):
    """Over rows sorted by (root, i, j): the verified edges of each such group, which may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, nodes, prints, sets = None, [], [], []

        def closed():
            edges = verified(np.array(prints, np.int64).view(np.uint64), sets, most, similarity) if len(nodes) > 1 else []
            if edges:
                a, b = (np.array(nodes, np.int64)[list(x)] for x in zip(*edges, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for *key, node, fps, shingles in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != open_key:
                    yield from closed()
                    open_key, nodes, prints, sets = key, [], [], []
                nodes.append(node)
                prints.append(fps)
                sets.append(np.frombuffer(shingles, np.uint64))
        yield from closed()

    return run


def covering_masks(radius: int, family: int = 0, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks of so many bits; family 1 gives the positions' vectors in another order."""
    most = (1 << (radius + 1)) - 1
    vector = [(i if family == 0 else i // 4 + 5 * i) % most + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, most + 1)]


def link(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over the distinct fingerprints, of edges within the radius: one for each but the first of a group."""
    edges, left = [], prints
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = np.bitwise_count(left ^ one) <= radius
            if near.any():
                found, left = left[near], left[~near]
                edges += [(one, x) for x in found]
                frontier += list(found)
    return edges


def _link(radius: int):
    """Over rows sorted by (table, key, sub): edges of each bucket, which may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_prints = None, []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table, key, sub, fp = (np.asarray(batch.column(k)) for k in range(4))
            cut = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(sub) != 0)) + 1
            starts, ends = [0, *cut], [*cut, len(fp)]
            edges = []
            for s, e in zip(starts, ends, strict=True):
                if (own := (table[s], key[s], sub[s])) != open_key:
                    edges += _closed(open_prints, radius, open_key)
                    open_key, open_prints = own, []
                open_prints.append(fp[s:e])
            if edges:
                yield _edges(edges)
        if edges := _closed(open_prints, radius, open_key):
            yield _edges(edges)

    return run


def _closed(parts: list[np.ndarray], radius: int, key: tuple | None) -> list[tuple[int, int, int]]:
    prints = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)
    if len(prints) < 2:
        return []
    family = int(key[0]) % _TABLES >> radius + 1
    return [(family, a, b) for a, b in link(prints.view(np.uint64), radius)]


def _edges(edges: list[tuple[int, int, int]]) -> pa.RecordBatch:
    family, *ends = (np.array(x, np.uint64).view(np.int64) for x in zip(*edges, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(family.astype(np.int32)), *map(pa.array, ends)], names=["family", "a", "b"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _large_buckets(rows: DataFrame, scratch: Scratch, n: int, bucket: int) -> DataFrame | None:
    """``(table, key, large)`` of buckets of more rows than ``bucket``, None if there are none.

    Keys are counted in bins first, which combine before the shuffle; only keys of
    bins that have too many are counted themselves.
    """
    bins = 1 << max(6, (8 * n // bucket).bit_length())
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    full = scratch.write(binned.groupBy("table", "bin").count().filter(F.col("count") > bucket).select("table", "bin", F.lit(True).alias("full")), "full_bins")
    if full.isEmpty():
        return None
    counts = lookup(binned, full, ["table", "bin"]).filter("full").groupBy("table", "key").count()
    large = scratch.write(counts.filter(F.col("count") > bucket).select("table", "key", F.lit(True).alias("large")), "large_buckets")
    return None if large.isEmpty() else large


def _buckets(rows: DataFrame, scratch: Scratch, n: int, radius: int, bucket: int, bits: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(table, key, sub, fp, ...)`` together by bucket; those of large buckets are dealt again by a second covering family."""
    large = _large_buckets(rows, scratch, n, bucket)
    if large is not None:
        second = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in covering_masks(radius, 1, bits)))
        rows = lookup(rows, large, ["table", "key"])
        others = [c for c in rows.columns if c not in ("table", "key", "sub", "large")]
        again = rows.filter("large").select("table", "key", *others, F.posexplode(second).alias("k", "sub")).select((F.col("table") + _TABLES * (F.col("k") + 1)).alias("table"), "key", "sub", *others)
        rows = rows.filter("large is null").drop("large").unionByName(again)
    return rows.repartition("table", "key", "sub").sortWithinPartitions("table", "key", "sub", *by)


def links(prints: DataFrame, scratch: Scratch, radius: int = 3, bucket: int = 8192) -> DataFrame:
    """Edges ``(family, a, b)`` that connect each family's distinct ``(family, fp)`` as all pairs within the radius do."""
    first = [F.struct((F.col("family") * (1 << (radius + 1)) + k).cast("int").alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius))]
    rows = prints.select("fp", F.explode(F.array(*first)).alias("x")).select("x.table", "x.key", F.lit(0).cast("bigint").alias("sub"), "fp")
    return _buckets(rows, scratch, prints.count(), radius, bucket, 64).mapInArrow(_link(radius), "family int, a bigint, b bigint")


def candidates(nodes: DataFrame, scratch: Scratch, words: int, radius: int, similarity: float, bucket: int) -> DataFrame:
    """Edges ``(a, b)`` that connect nodes ``(node, fps)`` as all pairs do that are within the radius in one half of a word, and near in that word and the next."""
    rows = nodes.select("node", "fps").mapInArrow(_tables(words, radius), "table int, key bigint, sub bigint, node bigint, fp bigint, x bigint, y bigint")
    dealt = _buckets(rows, scratch, nodes.count(), radius, bucket, 32, ["node"])  # the least node is its bucket's hub, so tables agree on edges
    return dealt.select("table", "key", "sub", "node", "x", "y").mapInArrow(_candidates(radius, differing_bits(similarity, 128)), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3, bucket: int = 8192) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row; the component's id is its smallest doc_id."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.write(rows.mapInArrow(_fingerprints(shingle, seed), "doc_id bigint, fp bigint"), "fingerprints")
    prints = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = scratch.write(components(links(prints.select(F.lit(0).alias("family"), "fp"), scratch, radius, bucket), scratch).select(F.col("node").alias("fp"), "root"), "roots")
    many = scratch.write(lookup(prints, roots, ["fp"]).filter("n > 1 or root is not null").select("fp", "least", F.coalesce("root", "fp").alias("root")), "grouped")
    ids = scratch.write(many.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    of = scratch.write(lookup(many, ids, ["root"]).select("fp", "component_id"), "of")
    out = lookup(rows, of, ["fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def similar_groups(docs: DataFrame, *, id_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 4, radius: int = 3, bucket: int = 8192, chunk: int = 4096) -> DataFrame:
    """``(doc_id, component_id)`` for each row; ids have to be unique and not null.

    Texts link if their sets of ``shingle``-word shingles have at least this Jaccard
    similarity and one of their ``2 * words`` fingerprints of 32 bits are within
    ``radius``, or if candidates tie them together anyhow.  Texts of equal sets, those
    without a word among them, are one node.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text"))
    rows = scratch.write(texts.mapInArrow(_hashed(shingle, words), "doc_id bigint, fps array<bigint>, th bigint, tl bigint"), "fingerprints")
    nodes = scratch.write(rows.groupBy("th", "tl").agg(F.min(F.struct("doc_id", "fps")).alias("o")).select("th", "tl", F.col("o.doc_id").alias("node"), "o.fps"), "nodes")
    near = scratch.write(candidates(nodes.select("node", "fps"), scratch, words, radius, similarity, bucket), "near")
    may = scratch.write(components(near, scratch, "may"), "may_link")
    sets = scratch.write(lookup(texts, may, ["node"]).filter("root is not null").select("node", "text").mapInArrow(_sets(shingle), "node bigint, shingles binary"), "sets")
    held = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(F.octet_length("shingles")) / _CHUNK_BYTES)).cast("bigint")
    groups = scratch.write(lookup(sets, may, ["node"]).groupBy("root").agg(held.alias("chunks")), "groups")
    rows_of = lookup(lookup(may, groups, ["root"]), nodes.select("node", "fps"), ["node"]).join(sets, "node")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    dealt = rows_of.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("o", other)
    dealt = dealt.select("root", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "node", "fps", "shingles")
    alike = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_search(differing_bits(similarity, 64 * words), similarity), "a bigint, b bigint")
    roots = scratch.write(components(alike, scratch), "roots")
    scratch.drop("near", "may_link", "sets", "groups")
    named = scratch.write(lookup(nodes.select("th", "tl", "node"), roots, ["node"]).select("th", "tl", F.coalesce("root", "node").alias("component_id")), "named")
    return lookup(rows.select("doc_id", "th", "tl"), named, ["th", "tl"]).select("doc_id", "component_id")
