"""Best-fit packing of tokenized documents by linear grouping.

A document's ids, its end id included, make one piece; a longer one than
``capacity`` is cut into pieces of that length, the first of which may be shorter.
Pieces are packed whole.  Lengths are at most ``capacity``, so how many pieces
have which length is a table of bounded size, and all planning works on it:

1. Linear grouping.  Lengths above a threshold are put, longest first, into
   ``groups`` groups of about equal cardinality and rounded up to their group's
   longest.  Of the thresholds in ``small`` the one whose plan needs the fewest
   sequences is taken; the small pieces fill what rounding leaves.
2. Configurations.  For the longest rounded size left, a subset-sum table over
   the sizes finds the fullest sequence, longer sizes first; it is used as often
   as its sizes last.
3. Substitution.  A group's slots are given to its actual pieces by rank.
4. Best fit.  What actual sequences have left is counted, and the small pieces,
   longest first, go where they leave least; the rest opens new sequences.

Only the tables of counts reach the driver.  Pieces get their ranks within a
length in buckets of bounded size, so a length that a third of all pieces have is
dealt over many tasks, and a sequence has at most ``capacity`` pieces.

A null or empty text is one piece of the end id alone.  Ids may be null or
repeated: each row is packed for itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.llm.common import Scratch, lookup, pieces
from blockprism.llm.token_ids import encoder

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Bytes of text that a worker cuts at once: working arrays take some 32 times as much.
_PIECE = 1 << 18
#: Rows of a length that are ranked in one task, about.
_RANKED = 100_000


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in pieces(batches, 1, _PIECE, tokenizer):
            ids, sizes = tokens.encode(batch.column(1))
            out: list[tuple] = []
            at = 0
            for doc, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                own = np.append(ids[at : at + size], end_id).astype("<u4")
                at += size
                first = (size + 1) % capacity or capacity
                for k, to in enumerate(range(first, size + 2, capacity)):
                    start = max(0, to - capacity)
                    out.append((doc, k, start, to - start, zlib.crc32(own[start:to])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def grouped(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths, longest first, in at most ``groups`` groups of about equally many pieces each.

    A length of more pieces than a share is a group of its own; the others share the rest.
    """
    left, out, held = sum(counts.values()), [[]], 0
    for length in sorted(counts, reverse=True):
        share = left / (groups - len(out) + 1)
        if held and held + counts[length] / 2 > share and len(out) < groups:
            left, held = left - held, 0
            out.append([])
        out[-1].append(length)
        held += counts[length]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(times, [(index of size, how often)])`` that serve the demand; sizes are descending."""
    left, out = list(demand), []
    for first in range(len(sizes)):
        while left[first]:
            room = capacity - sizes[first]
            use = [(first, 1)]
            if room >= sizes[-1]:
                use = _fullest(sizes, left, first, room)
            times = min(left[k] // n for k, n in use)
            for k, n in use:
                left[k] -= n * times
            out.append((times, use))
    return out


def _fullest(sizes: list[int], left: list[int], first: int, room: int) -> list[tuple[int, int]]:
    """The size ``first`` once, and what fills ``room`` best, longer sizes preferred."""
    usable = [k for k in range(first, len(sizes)) if sizes[k] <= room and left[k] > (k == first)]
    reach = np.zeros((len(usable) + 1, room + 1), bool)  # sums that the sizes from there on can make
    reach[-1, 0] = True
    for j in range(len(usable) - 1, -1, -1):
        k, now = usable[j], reach[j + 1].copy()
        for n in range(1, min(room // sizes[k], left[k] - (k == first)) + 1):
            now[n * sizes[k] :] |= reach[j + 1][: room + 1 - n * sizes[k]]
        reach[j] = now
    rest = int(np.flatnonzero(reach[0])[-1])
    use = [(first, 1)]
    for j, k in enumerate(usable):
        for n in range(min(rest // sizes[k], left[k] - (k == first)), -1, -1):
            if reach[j + 1][rest - n * sizes[k]]:
                break
        if n:
            rest -= n * sizes[k]
            use = [(first, n + 1)] if k == first else [*use, (k, n)]
    return use


class Slots:
    """Where the ranks of each length go: sorted intervals ``(from rank, kind, first)``; rank r goes to first + r - from."""

    def __init__(self):
        self.rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.opened: list[tuple[int, int]] = []  # new sequences: the first of them, and how many

    def add(self, length: int, rank: int, kind: int, first: int) -> None:
        self.rows[length].append((rank, kind, first))

    def frozen(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {length: tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) for length, rows in self.rows.items()}


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[Slots, int]:
    """Sequences (kind 0) for the ranks of each length, and how many there are."""
    slots, base = Slots(), 0
    if not counts:
        return slots, 0
    members = grouped(counts, groups)
    demand = [sum(counts[x] for x in own) for own in members]
    intervals: list[list[tuple[int, int, int]]] = [[] for _ in members]  # from, to, first sequence
    used = [0] * len(members)
    for times, use in configurations([own[0] for own in members], demand, capacity):
        for k, n in use:
            for _ in range(n):
                intervals[k].append((used[k], used[k] + times, base))
                used[k] += times
        base += times
    for own, spans in zip(members, intervals, strict=True):
        before, at = 0, 0
        for length in own:  # the group's ranks, length by length
            to = before + counts[length]
            while at < len(spans) and spans[at][0] < to:
                a, b, first = spans[at]
                slots.add(length, max(a, before) - before, 0, first + max(a, before) - a)
                if b > to:
                    break
                at += 1
            before = to
    return slots, base


def plan_small(counts: dict[int, int], rooms: dict[int, int], capacity: int, base: int) -> Slots:
    """By best fit: for the ranks of each length a bin's rank (kind: its room, at least 1) or a new sequence (kind 0).

    ``rooms`` has how many sequences have so much room left; ranks count the
    sequences of one room.  New sequences are numbered from ``base``.
    """
    slots = Slots()
    classes: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now: (kind, first, how many)
    for room, n in rooms.items():
        classes[room].append((room, 0, n))
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r, found in classes.items() if r >= length and found), default=0)
            if not room:
                new = -(-left // (capacity // length))
                classes[capacity].append((0, base, new))
                slots.opened.append((base, new))
                base += new
                continue
            kind, first, n = classes[room].pop()
            times = min(n, left)
            slots.add(length, rank, kind, first)
            if n > times:
                classes[room].append((kind, first + times, n - times))
            classes[room - length].append((kind, first, times))
            rank, left = rank + times, left - times
    return slots


def rooms_of(slots: Slots, counts: dict[int, int], base: int, capacity: int) -> dict[int, int]:
    """How many of the ``base`` sequences have so much room left, from the intervals of ranks that went to them."""
    steps: dict[int, int] = defaultdict(int)  # what the room changes by from a sequence on
    for length, rows in slots.rows.items():
        rows = sorted(rows)
        for (rank, _, first), to in zip(rows, [*(r[0] for r in rows[1:]), counts[length]], strict=True):
            steps[first] -= length
            steps[first + to - rank] += length
    rooms, room, ends = defaultdict(int), capacity, sorted({*steps, 0, base})
    for at, to in zip(ends, ends[1:], strict=False):
        room += steps[at]
        rooms[room] += to - at
    rooms.pop(0, None)
    return rooms


def threshold(counts: dict[int, int], capacity: int, groups: int, choices: tuple[int, ...]) -> int:
    """The choice whose plan has the fewest sequences."""

    def sequences(small: int) -> int:
        large = {x: n for x, n in counts.items() if x > small}
        slots, base = plan_large(large, capacity, groups)
        rest = plan_small({x: n for x, n in counts.items() if x <= small}, rooms_of(slots, large, base, capacity), capacity, base)
        return base + sum(n for _, n in rest.opened)

    return min(choices, key=lambda small: (sequences(small), small))


def _assign(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            kind, to = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                start, kinds, first = slots[int(length[own[0]])]
                at = np.searchsorted(start, rank[own], "right") - 1
                kind[own], to[own] = kinds[at], first[at] + rank[own] - start[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(kind), pa.array(to)], names=["doc_id", "piece", "start", "length", "ids_crc32", "kind", "to"])

    return run


def _ranked(rows: DataFrame, key: str, by: list[str], scratch: Scratch, tag: str) -> DataFrame:
    """With ``rank``, from 0 within each value of ``key``, of which there are few; a value's rows are dealt over buckets."""
    buckets = max(1, rows.count() // _RANKED)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(counts.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), f"{tag}_offsets")
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*by)) - 1)
    return scratch.write(lookup(numbered, offsets, [key, "bucket"]).withColumn("rank", F.col("rank") + F.col("offset")).drop("bucket", "offset"), f"{tag}_ranked")


def _histogram(rows: DataFrame, key: str) -> dict[int, int]:
    """Rows per value, of which there are at most as many as a sequence has places."""
    return {r[key]: r["n"] for r in rows.groupBy(key).agg(F.count("*").alias("n")).collect()}


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, groups: int = 48, small: tuple[int, ...] = (64, 128, 192, 256, 384, 512)) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    cut = scratch.write(texts.mapInArrow(_cut(tokenizer, end_id, capacity), _PIECES), "pieces")
    ranked = _ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], scratch, "lengths")
    counts = _histogram(ranked, "length")
    assigned = _PIECES + ", kind bigint, to bigint"

    small = threshold(counts, capacity, groups, small)
    slots, base = plan_large({x: n for x, n in counts.items() if x > small}, capacity, groups)
    large = scratch.write(ranked.filter(F.col("length") > small).mapInArrow(_assign(spark.sparkContext.broadcast(slots.frozen())), assigned).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("to").alias("sequence_id")), "large")
    rooms = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("kind")).filter("kind > 0")
    bins = _ranked(rooms, "kind", ["sequence_id"], scratch, "rooms").select("kind", F.col("rank").alias("to"), "sequence_id")
    slots = plan_small({x: n for x, n in counts.items() if x <= small}, _histogram(bins, "kind"), capacity, base)
    rest = ranked.filter(F.col("length") <= small).mapInArrow(_assign(spark.sparkContext.broadcast(slots.frozen())), assigned)
    rest = lookup(rest, bins, ["kind", "to"]).select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "to").alias("sequence_id"))
    own = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return large.unionByName(rest).withColumn("offset", F.coalesce(F.sum("length").over(own), F.lit(0)))
