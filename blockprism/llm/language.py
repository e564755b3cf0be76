"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (0 to 3).  A symbol seen
in a context has probability count / (total + distinct), the escape to the next
shorter context distinct / (total + distinct), shared among the symbols not seen
in the longer one in proportion to the shorter's prediction; below order 0 all 256
bytes are alike.  After training the statistics are frozen: the code length of
every symbol in every context is one table entry per language, and a text's code
length in each language is a sum of table entries.  The shortest code wins.

Training reads whole texts of a bounded sample: at most ``sample`` labelled
documents per language, those with the smallest hashes of their ids.  The tables
have at most ``symbols`` byte symbols (the rest share one) and the ``contexts``
most frequent contexts of order 3, so what is broadcast is bounded.

A null text, or one without a letter, is ``und`` with score 0, and so is every
document if nothing could be learned.  Ties go to the alphabetically first
language.  Repeated rows give repeated results.  A null id is never held out and
never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.llm.common import as_bytes, flat, pieces, schema_of, with_kept

ORDER = 3
#: Positions scored at a time, which bounds memory for texts of any length.
_STEP = 1 << 19
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Contexts:
    """Frozen code lengths, in bits, of every symbol in every context, for each language."""

    def __init__(self, langs: list[str], symbol: np.ndarray, row: np.ndarray, bits: np.ndarray):
        self.langs, self.symbol, self.row, self.bits = langs, symbol, row, bits
        self.size = bits.shape[1]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; ``offsets`` has a text's beginning and the last one's end."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        entries = self.bits.reshape(-1, len(self.langs))
        for at in range(0, len(data), _STEP):
            to = min(at + _STEP, len(data))
            before = max(0, at - ORDER)
            sym = self.symbol[data[before:to]]
            sym = np.concatenate([np.zeros(ORDER - (at - before), np.int32), sym])
            first = np.searchsorted(offsets, at, "right") - 1
            last = np.searchsorted(offsets, to, "left")
            starts = offsets[first:last]
            past = [sym[ORDER - k : len(sym) - k].copy() for k in range(1, ORDER + 1)]
            for k in range(ORDER):  # what lies before a text's beginning is symbol 0
                for j in range(k + 1):
                    edge = starts + j - at
                    past[k][edge[(edge >= 0) & (edge < to - at)]] = 0
            found = entries[self.row[(past[2] * self.size + past[1]) * self.size + past[0]] * self.size + sym[ORDER:]]
            own = np.flatnonzero(np.diff(offsets[first : last + 1]) > 0) + first  # texts that have bytes
            cuts = np.maximum(offsets[own] - at, 0)
            total[own] += np.add.reduceat(found, cuts, axis=0, dtype=np.float64)
        return total


def _backoff(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of symbols given contexts (rows), from counts and the shorter contexts' probabilities."""
    seen = counts > 0
    total, distinct = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = 1 - np.where(seen, shorter, 0).sum(1, keepdims=True)
    escaped = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1) * shorter / np.maximum(rest, 1e-12)
    return np.where(seen, counts / np.maximum(total + distinct, 1), np.where(total > 0, escaped, shorter))


def train(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, symbols: int = 127, contexts: int = 8192) -> Contexts:
    """From counts of grams: the byte in the low 8 bits, the three before it above; 0 stands before a text."""
    byte = gram & 255
    seen = np.bincount(byte, count, 256)
    kept = np.sort(np.argsort(-seen, kind="stable")[: min(symbols, int((seen > 0).sum()))])
    symbol = np.full(256, len(kept) + 1, np.int32)  # all other bytes
    symbol[kept] = np.arange(1, len(kept) + 1)
    size = len(kept) + 2  # 0: before the text
    x = symbol[byte]
    a, b, c = (np.where((gram >> s) & 255 > 0, symbol[(gram >> s) & 255], 0) for s in (24, 16, 8))
    three = (a * size + b) * size + c
    ids, inverse = np.unique(three, return_inverse=True)
    often = np.argsort(-np.bincount(inverse, count), kind="stable")[:contexts]
    place = np.full(len(ids), -1)
    place[often] = np.arange(len(often))
    row = np.tile(np.arange(size * size, dtype=np.int32), size)  # of order 2, whatever the first symbol
    row[ids[often]] = size * size + np.arange(len(often), dtype=np.int32)
    bits = np.empty((size * size + len(often), size, len(langs)), np.float32)
    for k in range(len(langs)):
        n = np.where(lang == k, count, 0).astype(np.float64)

        def counted(ctx, rows, n=n):
            return np.bincount(ctx * size + x, n, rows * size).reshape(rows, size)

        # one byte of those that share a symbol: its probability, not that of all of them
        shared = np.ones(size)
        shared[-1] = max(1, 256 - len(kept))
        p0 = _backoff(counted(np.zeros_like(x), 1) / shared, np.full((1, size), 1 / 256))
        p1 = _backoff(counted(c, size) / shared, np.repeat(p0, size, 0))
        p2 = _backoff(counted(b * size + c, size * size) / shared, np.tile(p1, (size, 1)))
        mine = place[inverse] >= 0
        three_n = np.bincount(place[inverse][mine] * size + x[mine], n[mine], len(often) * size).reshape(len(often), size)
        p3 = _backoff(three_n / shared, p2[ids[often] % (size * size)])
        bits[:, :, k] = -np.log2(np.maximum(np.concatenate([p2, p3]), 1e-12))
    return Contexts(langs, symbol[_FOLD], row, bits)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: grams of four bytes and how often they occur."""
    for batch in pieces(batches, 1, 1 << 20):
        langs, found = batch.column(0).to_pylist(), {}
        for lang, text in zip(langs, as_bytes(batch.column(1)), strict=True):
            data = _FOLD[np.frombuffer(text, np.uint8)].astype(np.int64)
            past = [np.concatenate([np.zeros(k, np.int64), data])[: len(data)] for k in range(ORDER + 1)]
            found.setdefault(lang, []).append(past[3] << 24 | past[2] << 16 | past[1] << 8 | past[0])
        for lang, parts in found.items():
            gram, count = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(count)], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, sample: int = 300, symbols: int = 127, contexts: int = 8192) -> Contexts | None:
    """From ``(doc_id, text, lang)``; None if there is no text to learn from."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("doc_id").distinct()
    texts = labelled.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most `sample` ids a language
    rows = texts.select("lang", "text").mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "gram"])
    langs = sorted(rows["lang"].unique())
    index = {x: k for k, x in enumerate(langs)}
    return train(langs, rows["lang"].map(index).to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy(), symbols, contexts)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: Contexts | None = model.value
        for batch in pieces(batches, 1, 1 << 20):
            letters = np.asarray(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
            langs, scores, bits = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            if contexts and letters.any():
                data, offsets = flat(batch.column(1))
                lengths = contexts.lengths(data, offsets)
                best = lengths.argmin(1)
                least = lengths[np.arange(len(best)), best]
                scores = np.where(letters, 1 / np.exp2(-np.minimum(lengths - least[:, None], 1000)).sum(1), 0.0)
                langs = [contexts.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                bits = np.where(letters, least / np.maximum(np.diff(offsets), 1), np.nan)
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64(), mask=np.isnan(bits)), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "bits_per_byte", *batch.schema.names[3:]])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 300, symbols: int = 127, contexts: int = 8192, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)``, and with ``keep`` a struct ``kept`` of those columns.

    The score is the best language's share if all are as likely before.
    """
    rows = labelled.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(learn(rows.filter("doc_id is not null and text is not null and lang is not null"), sample, symbols, contexts))
    texts = with_kept(docs, keep, F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return texts.mapInArrow(_predict(model), schema_of("doc_id bigint, lang_pred string, score double, bits_per_byte double", texts))
