"""Language-model scoring by cross-entropy difference.

Two word bigram models, of the target corpus and of the background corpus, share
one vocabulary, so the difference of their losses on a token tells how much rather
the target would have written it.  A document's score is the mean difference over
its tokens, the end of text included: low is like the target.  With c the counts of
a model and V the number of distinct words of both corpora:

    p(w | h) = (c(h, w) + ``prior`` / V) / (c(h) + ``prior``)

Counts are of all words and of all pairs (history, word), each told apart by a hash
of 63 bits; they grow with the corpora and no task ever holds all of them.  Texts
are dealt into chunks of some MB.  A chunk gives the distinct keys of its texts,
sorted, with their counts, cut into buckets of hashes; a bucket adds the counts of
all chunks and answers each chunk in the order of its keys; and a chunk's texts,
hashed again, meet the answers.  Keys and counts travel as planes of bytes of their
differences, which the shuffle compresses, so a key costs a few bytes.  A word or a
pair is in a chunk once at most, so none is a hot key.

V is read from the 4096 least hashes of words: exact up to so many words, within a
few percent beyond.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and begin-of-text is a history
like any word.  A null or empty text has one token, the end.  Ids may be null or
repeated; each row is scored for itself.  With an empty corpus its model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, flat, pieces
from blockprism.llm.substring import word_hashes

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_EDGE = np.uint64(0x5DEECE66D0B4A1C2)  # the hash that stands for a text's beginning and end
#: Bytes of text in a chunk, about.
_CHUNK = 8 << 20
#: Hashes from which the size of the vocabulary is read.
_LEAST = 4096
_PIECE = 1 << 20
_TARGET, _BACKGROUND, _WANTED = 1, 2, 4  # flags of a text


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text behind a begin and before an end, and where each text's begin is."""
    data, offsets = flat(texts)
    hashes, before = word_hashes(_LOWER[data], offsets)
    docs = len(offsets) - 1
    begins = before + 2 * np.arange(docs + 1)
    out = np.full(begins[-1], _EDGE, np.uint64)
    words = np.ones(begins[-1], bool)
    words[begins[:-1]] = words[begins[1:] - 1] = False
    out[words] = hashes
    return out, begins


def keys(found: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token that is predicted (all but begins): the key of its pair, which is even, and of its history, which is odd."""
    wanted = np.ones(len(found), bool)
    wanted[begins[:-1]] = False
    now = np.flatnonzero(wanted)
    word, history = found[now], found[now - 1]
    pair = (history * np.uint64(0x9E3779B97F4A7C15)) ^ (word >> np.uint64(32)) ^ (word << np.uint64(32))
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(32)
    return pair & ~np.uint64(1), history | np.uint64(1)


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first, and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _all_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """As ``tokens``, of a chunk, a piece at a time."""
    found, begins = [], [np.zeros(1, np.int64)]
    for piece in pieces(iter(table.to_batches()), table.schema.get_field_index("text"), _PIECE):
        hashes, starts = tokens(piece.column("text"))
        found.append(hashes)
        begins.append(starts[1:] + begins[-1][-1])
    return np.concatenate(found), np.concatenate(begins)


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a chunk's texts, ascending, and how often each is in the target and in the background."""
    found, begins = _all_tokens(table)
    pair, history = keys(found, begins)
    flags = np.repeat(np.asarray(table.column("flags")), np.diff(begins) - 1)
    every = np.concatenate([pair, history])
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    order %= len(pair)
    return every[starts], *(np.add.reduceat(((flags & c) > 0).astype(np.uint32)[order], starts, dtype=np.uint32) for c in (_TARGET, _BACKGROUND))


def _ask(buckets: int):
    """Over rows sorted by chunk: for each chunk and bucket, the keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in _chunks(batches):
            key, t, b = _counted(table)
            bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(key)]
            rows = [(int(bucket[s]), chunk, planes(np.diff(key[s:e], prepend=np.uint64(0))), planes(t[s:e]), planes(b[s:e])) for s, e in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "keys", "t", "b"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each chunk, which come one behind another."""
    open_chunk, held = None, []
    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        cuts = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                if held and chunk[s] != open_chunk:
                    yield open_chunk, pa.Table.from_batches(held)
                    held = []
                open_chunk = int(chunk[s])
                held.append(batch.slice(s, e - s))
    if held:
        yield open_chunk, pa.Table.from_batches(held)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: to each chunk the counts of its keys over all chunks, in their order."""
    open_bucket, held = None, []

    def closed() -> Iterator[pa.RecordBatch]:
        parts = [np.cumsum(unplaned(x, np.uint64), dtype=np.uint64) for _, x, _, _ in held]
        every, place = np.unique(np.concatenate(parts), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([unplaned(x[k], np.uint32) for x in held]), len(every)).astype(np.uint64) for k in (2, 3)]
        ends = np.cumsum([len(x) for x in parts])
        for (chunk, *_), part, end in zip(held, parts, ends.tolist(), strict=True):
            own = place[end - len(part) : end]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([open_bucket]), *(pa.array([planes(x[own])], pa.binary()) for x in sums)], names=["chunk", "bucket", "t", "b"])

    for batch in batches:
        for bucket, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if bucket != open_bucket:
                if held:
                    yield from closed()
                open_bucket, held = bucket, []
            held.append(row)
    if held:
        yield from closed()


def _score(vocabulary: int, prior: float):
    """Of a chunk: each text's tokens and bits, from the chunk's answers."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "target_bits": pa.array([], pa.float64()), "background_bits": pa.array([], pa.float64())})
        found, begins = _all_tokens(texts)
        pair, history = keys(found, begins)
        every, place = np.unique(np.concatenate([pair, history]), return_inverse=True)
        order = np.argsort(np.asarray(answers.column("bucket")))
        out, size = [], np.diff(begins) - 1
        for c in ("t", "b"):
            blobs = answers.column(c).to_pylist()
            count = np.concatenate([unplaned(blobs[k], np.uint64) for k in order]).astype(np.float64)
            is_word = (every & np.uint64(1)).astype(bool)
            bits = np.where(is_word, np.log2(count + prior), -np.log2(count + prior / vocabulary))
            each = bits[place[: len(pair)]] + bits[place[len(pair) :]]
            out.append(np.add.reduceat(each, begins[:-1] - np.arange(len(size))) / size)
        keep = (np.asarray(texts.column("flags")) & _WANTED) > 0
        return pa.table({"doc_id": texts.column("doc_id").filter(pa.array(keep)), "n_tokens": size[keep], "target_bits": out[0][keep], "background_bits": out[1][keep]})

    return run


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hashes of words."""
    least = np.empty(0, np.uint64)
    for batch in pieces(batches, 0, _PIECE):
        found, _ = tokens(batch.column(0))
        least = np.unique(np.concatenate([least, found]))[:_LEAST]
    yield pa.RecordBatch.from_arrays([pa.array((least ^ np.uint64(1 << 63)).view(np.int64))], names=["least"])


def vocabulary_size(texts: DataFrame) -> int:
    """About how many distinct words the texts have, an end of text included."""
    found = texts.mapInArrow(_least, "least bigint").distinct().orderBy("least").limit(_LEAST).collect()
    if len(found) < _LEAST:
        return max(1, len(found))
    return round((_LEAST - 1) / ((found[-1]["least"] + (1 << 63)) / 2**64))


def scored(rows: DataFrame, target: Column, background: Column, wanted: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", prior: float = 500.0, chunk_bytes: int = _CHUNK) -> DataFrame:
    """``(doc_id, n_tokens, target_bits, background_bits, difference)`` of the wanted rows (all); which rows are in which corpus the columns tell."""
    wanted = F.lit(True) if wanted is None else wanted
    flags = sum((F.when(x, c).otherwise(0) for x, c in ((target, _TARGET), (background, _BACKGROUND), (wanted, _WANTED))), F.lit(0))
    rows = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), flags.alias("flags"))
    corpus = rows.filter(F.col("flags").bitwiseAND(_TARGET | _BACKGROUND) > 0).select("text")
    vocabulary = vocabulary_size(corpus)
    size, odd = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    if odd:  # else all null ids of one text would be dealt to one chunk
        rows = Scratch(rows.sparkSession).write(rows.withColumn("n", F.monotonically_increasing_id()), "numbered")
    n = max(1, -(-size // chunk_bytes))
    spread = F.xxhash64("doc_id", "text", *(["n"] if odd else []))
    dealt = rows.withColumn("chunk", F.pmod(spread, F.lit(n))).select("chunk", "doc_id", "text", "flags").repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chunk")  # one shuffle serves both below
    asked = dealt.sortWithinPartitions("chunk").mapInArrow(_ask(n), "bucket bigint, chunk bigint, keys binary, t binary, b binary")
    answers = asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "chunk bigint, bucket bigint, t binary, b binary")
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(vocabulary, prior), "doc_id bigint, n_tokens bigint, target_bits double, background_bits double")
    return found.withColumn("difference", F.col("target_bits") - F.col("background_bits"))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """As ``scored``, of documents that need not be in either corpus."""

    def part(df: DataFrame, *flags: bool) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *(F.lit(x).alias(c) for x, c in zip(flags, ("target", "background", "wanted"), strict=True)))

    rows = part(docs, False, False, True).unionByName(part(target, True, False, False)).unionByName(part(background, False, True, False))
    return scored(rows, F.col("target"), F.col("background"), F.col("wanted"), **options)
