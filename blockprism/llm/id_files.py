"""Token ids in compressed files, by an adaptive context-mixing range coder.

A file is a Parquet table of segments; a segment holds whole documents, in
ascending order of their ids, and is a run of bytes of its own format:

    magic, sizes | index: ids and lengths of documents | order-0 counts | blocks' words and checksums | words

Its ids are cut into blocks of equal length, each of which starts anew and has a
checksum of its ids, so any block can be read alone.  Within a block three
predictions are mixed for each id: of order 2 and of order 1, the id that followed
the last two or the last one before, each with a confidence of 0 to 3, and of
order 0, the segment's counts.  How much of the range each prediction gets is
learned per pair of confidences while coding.  A carry-less range coder of 48 bits
puts out words of 16.

All blocks of a segment advance together, one id of each a step, so that a step is
some numpy operations over thousands of blocks.

A null or empty text has the end id alone.  Null ids come first, equal ids in
order of their texts' hashes; each row is written for itself.  An empty table has
no segments and gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.llm.common import Scratch, pieces
from blockprism.llm.token_ids import encoder

_MAGIC = b"IDSEG1\0\0"
_HEAD = struct.Struct("<8sIIIQII")  # magic, documents, blocks, block length, ids, bytes of index, bytes of counts
_SLOTS = 9   # bits of a block's table of predictions
_MIX, _ZERO = 15, 18  # bits of the mixing shares and of the order-0 counts
#: What the shares of orders 2 and 1 tend to at least and at most, of 2^15; so order 0 always has room for 2^18 parts.
_LEAST_SHARE, _MOST = 128, (32640, 28672)
#: Lows and sizes of intervals are of 48 bits, in signed arrays of 64.
_LOW, _LEAST = (1 << 48) - 1, 1 << 32


class _Mixer:
    """The predictions and shares of many blocks at the same place of each.

    All of it is of 32 bits: half as much to move, and what a hash loses above is not used.
    """

    def __init__(self, blocks: int):
        row = np.arange(blocks, dtype=np.int32)
        self.table_row, self.share_row = row << _SLOTS, row << 4
        self.tables = [np.zeros(blocks << _SLOTS, np.int32) for _ in range(2)]  # id and confidence
        start = 1 << (_MIX - 3)
        self.shares = np.full(blocks << 4, start << _MIX | start, np.int32)  # of order 2 and, of the rest, of order 1
        self.last, self.before = np.zeros(blocks, np.int32), np.zeros(blocks, np.int32)

    def predict(self, n: int) -> np.ndarray:
        """For the first ``n`` blocks: predicted ids of order 2 and 1, a row each; ``two`` and ``rest`` are their shares."""
        last = self.last[:n]
        places = np.empty((2, n), np.int32)
        np.right_shift(last * 0x9E35 + self.before[:n], 7, out=places[0])
        np.bitwise_xor(last, last >> _SLOTS, out=places[1])
        places &= (1 << _SLOTS) - 1
        places += self.table_row[:n]
        self.at, self.seen = places.astype(np.intp), places
        for table, at, seen in zip(self.tables, self.at, self.seen, strict=True):
            table.take(at, out=seen, mode="clip")  # no place is beyond: without a copy
        self.trust = self.seen & 3
        self.sure = ((self.trust[0] << 2) + self.trust[1] + self.share_row[:n]).astype(np.intp)
        share = self.shares.take(self.sure, mode="clip")
        self.two, self.one = share >> _MIX, share & ((1 << _MIX) - 1)
        self.rest = ((1 << _MIX) - self.two) * self.one >> _MIX
        return self.seen >> 2

    def update(self, ids: np.ndarray, right: np.ndarray) -> None:
        """``right``: all bits where order 2 was right, and where order 1 was; order 1's share is among what order 2 misses."""
        n, wrong = len(ids), ~right
        two = self.two + (_LEAST_SHARE + (right[0] & (_MOST[0] - _LEAST_SHARE)) - self.two >> 5)
        moved = _LEAST_SHARE + (right[1] & (_MOST[1] - _LEAST_SHARE)) - self.one >> 5
        self.shares[self.sure] = (two << _MIX) + self.one + (moved & wrong[0])
        unsure = (self.trust | right) == 0
        fresh = np.minimum(self.seen - right, self.seen | 3)  # confidence up to 3
        fresh += wrong
        np.copyto(fresh, ids << 2, where=unsure)
        for table, at, new in zip(self.tables, self.at, fresh, strict=True):
            table[at] = new
        np.multiply(self.last[:n], 0x2F0B5, out=self.before[:n])  # as the hash of two needs it
        self.last[:n] = ids


def _mask(true: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """All bits where true: cheaper to choose by than ``np.where``."""
    return -true.astype(kind)


def _part(low: np.ndarray, unit: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of order 0 that an id has; where another order was right, ``part`` is 0 and all is taken."""
    part = part ^ (1 << _ZERO)
    return low + unit * (part >> 20 & 0xFFFFF), unit * (part & 0xFFFFF)


def _shifted(low: np.ndarray, size: np.ndarray, due: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After a word of 16 bits is put out where one is due: a size below ``_LEAST`` that straddles a boundary is cut there."""
    at = (due & ((low ^ (low + size)) >= _LEAST)).nonzero()[0]
    size[at] = -low[at] & (_LEAST - 1)
    return low << by & _LOW, size << by


def _shift_more(low: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same at a few places, where one is due at all; gives those where another is."""
    lo, sz = low[at], size[at]
    sz = np.where((lo ^ (lo + sz)) >= _LEAST, -lo & (_LEAST - 1), sz) << 16
    low[at], size[at] = lo << 16 & _LOW, sz
    return at[sz < _LEAST]


def _order_zero(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of 2^18, none zero, of ids with these counts, and where each begins."""
    spare = (1 << _ZERO) - len(counts)
    share = 1 + counts * spare // counts.sum()
    share[counts.argmax()] += (1 << _ZERO) - share.sum()
    return share, np.cumsum(share) - share


def _lengths(total: int, block: int) -> np.ndarray:
    """Ids of each block; only the last may be shorter, so that blocks end in descending order of length."""
    full, rest = divmod(total, block)
    return np.array([block] * full + [rest] * (rest > 0), np.int64)


def _steps(steps: int, blocks: int, kind: type) -> np.ndarray:
    """Zeros, a row for each step; a cache line lies between rows, or else a block's column would be a power of two apart."""
    return np.zeros((steps, blocks + 64 // np.dtype(kind).itemsize), kind)[:, :blocks]


def encode(ids: np.ndarray, block: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each block, blocks' checksums, and the order-0 ids and counts."""
    lengths = _lengths(len(ids), block)
    k = len(lengths)
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    zero = np.zeros(len(counts), np.int64)  # of each id, where its part of order 0 begins, and its share
    counts = counts[known]
    share, begins = _order_zero(counts)
    zero[known] = (begins << 20 | share) ^ 1 << _ZERO
    rows, grid = np.zeros(k * block, np.int32), _steps(block, k, np.int32)
    rows[: len(ids)] = ids
    grid[:] = rows.reshape(k, block).T
    low, size = np.zeros(k, np.int64), np.full(k, _LOW, np.int64)
    words, put = _steps(block + 3, k, np.uint16), _steps(block + 3, k, bool)  # at most one word a step
    more: list[tuple[np.ndarray, int, np.ndarray]] = []  # blocks that put out another in a step, and what
    mixer = _Mixer(k)
    for t in range(block):
        n = k if t < lengths[-1] else k - 1
        if n == 0:
            break
        x = grid[t, :n]
        right = _mask(mixer.predict(n) == x, np.int32)
        r2, r1 = right
        rest, ends, none = mixer.rest & r1, mixer.two + mixer.rest, ~(r2 | r1)
        span = np.empty((2, n), np.int64)  # where the interval begins, and its size, in units
        np.bitwise_and(ends - rest, ~r2, out=span[0])
        np.add((mixer.two & r2) + rest, ((1 << _MIX) - ends) & none, out=span[1])
        span *= size[:n] >> _MIX
        lo, sz = _part(low[:n] + span[0], span[1] >> _ZERO, zero.take(x, mode="clip") & none)
        due = np.less(sz, _LEAST, out=put[t, :n])
        words[t, :n] = lo >> 32  # counts only if it was due
        lo, sz = _shifted(lo, sz, due, due.astype(np.int64) << 4)
        at = (sz < _LEAST).nonzero()[0]
        while len(at):  # a few blocks have another word due
            more.append((at, t, (lo[at] >> 32).astype(np.uint16)))
            at = _shift_more(lo, sz, at)
        low[:n], size[:n] = lo, sz
        mixer.update(x, right)
    words[block:], put[block:] = [low >> shift & 0xFFFF for shift in (32, 16, 0)], True  # what tells the last interval
    out, used = _by_block(words, put, more)
    sums = np.array([zlib.crc32(part.astype("<u4").tobytes()) for part in np.split(ids, np.cumsum(lengths)[:-1])], np.uint32)
    return np.split(out, np.cumsum(used)[:-1]), sums, known, counts


def _by_block(words: np.ndarray, put: np.ndarray, more: list[tuple[np.ndarray, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The words that blocks put out, block by block, and how many each has; ``more`` is in the order of steps."""
    steps, k = words.shape
    put = np.ascontiguousarray(put.T)
    out, used = np.ascontiguousarray(words.T)[put], put.sum(axis=1)
    if more:
        at, values = np.concatenate([j for j, _, _ in more]), np.concatenate([v for _, _, v in more])
        place = at * steps + np.concatenate([np.full(len(j), t) for j, t, _ in more])
        out = np.insert(out, np.cumsum(put.reshape(-1), dtype=np.int32)[place], values)  # equal places keep their order
        used = used + np.bincount(at, minlength=k)
    return out, used


def decode(words: list[np.ndarray], lengths: np.ndarray, block: int, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids of blocks, of which only the last may be shorter than ``block``: a row per block."""
    k = len(words)
    share, begins = _order_zero(counts)
    of_slot = np.repeat((known << 40 | begins << 20 | share) ^ 1 << _ZERO, share)  # id, where its part begins, and its share
    width = max(map(len, words)) + 4
    source = np.zeros((k, width), np.uint16)
    for j, w in enumerate(words):
        source[j, : len(w)] = w
    source, read = source.reshape(-1), np.arange(k) * width + 3
    code = source[read - 3].astype(np.int64) << 32 | source[read - 2].astype(np.int64) << 16 | source[read - 1]
    low, size = np.zeros(k, np.int64), np.full(k, _LOW, np.int64)
    out = _steps(block, k, np.int32)
    mixer = _Mixer(k)
    for t in range(block):
        n = k if t < lengths[-1] else k - 1
        if n == 0:
            break
        p = mixer.predict(n)
        p2, p1 = p
        ends = np.empty((2, n), np.int64)  # where the shares of order 2 and 1 end; of equal predictions order 2 has both
        np.add(mixer.two, mixer.rest & _mask(p2 == p1, np.int32), out=ends[0])
        np.add(mixer.two, mixer.rest, out=ends[1])
        unit, off = size[:n] >> _MIX, code[:n] - low[:n]
        ends *= unit
        to_two, to_one = ends
        chosen = _mask(off < ends, np.int32)  # order 1's end is not before order 2's
        m2, m1 = chosen.astype(np.int64)
        gap, whole = to_one - to_two, unit << _MIX
        begin = (to_two & ~m2) + (gap & ~m1)
        sz = whole - ((whole - to_one) & m1) - (gap & m2) - begin
        unit, m0 = sz >> _ZERO, ~m1
        part = of_slot.take(((off - begin) / unit).astype(np.int64), mode="clip") & m0  # of at most 48 and 32 bits: the quotient's whole part is exact
        chosen[1] ^= chosen[0]
        chosen &= p
        x = (part >> 40).astype(np.int32) | chosen[0] | chosen[1]
        lo, sz = _part(low[:n] + begin, unit, part)
        due = sz < _LEAST
        by = due.astype(np.int64)
        word = source.take(read[:n], mode="clip") & -by
        read[:n] += by
        by <<= 4
        code[:n] = (code[:n] << by & _LOW) | word
        lo, sz = _shifted(lo, sz, due, by)
        at = (sz < _LEAST).nonzero()[0]
        while len(at):
            code[at] = (code[at] << 16 & _LOW) | source[read[at]]
            read[at] += 1
            at = _shift_more(lo, sz, at)
        low[:n], size[:n] = lo, sz
        out[t, :n] = x
        mixer.update(x, _mask(p == x, np.int32))
    return np.ascontiguousarray(out.T)


def pack_segment(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int) -> bytes:
    words, sums, known, counts = encode(ids, block)
    index = zlib.compress(np.array([d is None for d in docs], np.uint8).tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + sizes.astype("<u4").tobytes(), 1)
    zero = zlib.compress(known.astype("<u4").tobytes() + counts.astype("<u4").tobytes(), 1)
    head = _HEAD.pack(_MAGIC, len(docs), len(words), block, len(ids), len(index), len(zero))
    used = np.array([len(w) for w in words], "<u4").tobytes()
    front = head + index + zero + used + sums.astype("<u4").tobytes()
    return front + struct.pack("<I", zlib.crc32(front)) + np.concatenate(words).astype("<u2").tobytes()


def unpack_segment(data: bytes, blocks: list[int] | None = None) -> tuple[list[int | None], np.ndarray, list[np.ndarray]]:
    """Documents' ids and lengths, and the ids of all blocks or those asked for; a wrong checksum is an error."""
    magic, n_docs, k, block, total, n_index, n_zero = _HEAD.unpack_from(data)
    at = _HEAD.size
    index, zero = zlib.decompress(data[at : at + n_index]), zlib.decompress(data[at + n_index : at + n_index + n_zero])
    at += n_index + n_zero
    used, sums = np.frombuffer(data, "<u4", k, at), np.frombuffer(data, "<u4", k, at + 4 * k)
    at += 8 * k
    if magic != _MAGIC or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("not a segment of ids, or damaged")
    ends = np.cumsum(used)
    all_words = np.frombuffer(data, "<u2", int(ends[-1]), at + 4)
    wanted = range(k) if blocks is None else sorted(blocks)
    lengths = _lengths(total, block)[list(wanted)]
    known, counts = np.frombuffer(zero, "<u4", len(zero) // 8).astype(np.int64), np.frombuffer(zero, "<u4", len(zero) // 8, len(zero) // 2).astype(np.int64)
    rows = decode([all_words[ends[j] - used[j] : ends[j]] for j in wanted], lengths, block, known, counts)
    found = [row[:n].astype("<u4") for row, n in zip(rows, lengths, strict=True)]
    if any(zlib.crc32(x.tobytes()) != sums[j] for x, j in zip(found, wanted, strict=True)):
        raise ValueError("a block's checksum is wrong")
    null, doc = np.frombuffer(index, np.uint8, n_docs), np.frombuffer(index, "<i8", n_docs, n_docs)
    return [None if z else int(d) for z, d in zip(null, doc, strict=True)], np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64), found


def _write(tokenizer: str, end_id: int, segment: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            data = pack_segment(docs, sizes, ids, min(4096, max(256, -(-len(ids) // blocks))))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_ids", "data"])

        size = 0
        for batch in pieces(batches, 1, 1 << 20, tokenizer):
            ids, sizes = tokens.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            docs += batch.column(0).to_pylist()
            held.append((ids, sizes + 1))
            size += len(ids)
            if size >= segment:
                yield flush()
                docs, held, size, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "data")), strict=True):
            docs, sizes, blocks = unpack_segment(data.as_py())
            ids, ends = np.concatenate(blocks), np.cumsum(sizes)
            sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(docs), pa.int32()), pa.array([seq.as_py()] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment: int = 6_000_000, blocks: int = 4096) -> None:
    """Writes segments of about ``segment`` ids, of about ``blocks`` blocks each, in ascending order of documents' ids."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(_write(tokenizer, end_id, segment, blocks), "part int, seq int, n_ids bigint, data binary").write.option("compression", "none").parquet(path)


def read_ids(docs_at: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from written segments; ``start`` counts the ids of all documents before."""
    sizes = docs_at.select("part", "seq", "n_ids")
    totals = sorted((r["part"], r["n"]) for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per writing task
    before = np.cumsum([0, *(n for _, n in totals)])
    spark = docs_at.sparkSession
    parts = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before, strict=False)], "part int, before bigint")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("offset"))
    found = docs_at.select("part", "seq", "data").mapInArrow(_read, "part int, seq int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the ids to the shared folder and reads them back."""
    scratch = Scratch(docs.sparkSession)
    write_ids(docs, f"{scratch.root}/ids", tokenizer, **options)
    return read_ids(docs.sparkSession.read.schema("part int, seq int, n_ids bigint, data binary").parquet(f"{scratch.root}/ids"))
