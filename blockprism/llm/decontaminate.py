"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of each benchmark
item; an item of fewer words is one shorter window.  For each pattern length a
searcher holds a shift table over blocks of two words: a block that no pattern
contains lets the search skip as far as a pattern is long.  Where the shift is
zero, the block selects the patterns that end with it, their first block narrows
them down, and direct comparison confirms an occurrence.

Documents are scanned where they lie, nothing is shuffled.  The benchmark goes to
the executors in blocks of about ``block_bytes``, whose searchers take some 150
bytes for each of its bytes and serve all tasks of a worker; a larger one takes
several passes, between which the spans found so far travel with the documents.

Nulls and empty texts have no words and are never hit.  A repeated document row
gives a repeated result row.  An empty benchmark hits nothing.  A null item_id
counts as an item that is written ``null``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, as_bytes, held, pieces, schema_of, with_kept

#: Separators become spaces and A-Z lower case: the words are then what split() finds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PASS = "doc_id bigint, text string, spans array<int>, items array<string>"
_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Occurrences of word sequences that all have ``length`` words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.longest), length - end)
            firsts = self.ending.setdefault(pattern[-self.block :], defaultdict(list))
            firsts[pattern[: self.block]].append((pattern, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and items of each occurrence."""
        shift, longest, length, size, n = self.shift.get, self.longest, self.length, self.block, len(words)
        at = length - 1  # of the last word of the window looked at
        while at < n:
            block = (words[at - 1], words[at]) if size == 2 else (words[at],)
            if skip := shift(block, longest):
                at += skip
                continue
            start = at - length + 1
            if same := self.ending[block].get(tuple(words[start : start + size])):
                window = tuple(words[start : at + 1])
                for pattern, items in same:
                    if pattern == window:
                        yield start, items
            at += 1


def searchers(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    patterns: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if words else 0):
            patterns[length][tuple(words[start : start + length])].append(item)
    return [WuManber(n, dict(found)) for n, found in sorted(patterns.items())]


def _scan(items: list[tuple[str, bytes]], window: int, last: bool):
    name = f"searchers-{window}-{hashlib.sha256(repr(sorted(items)).encode()).hexdigest()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = held(name, lambda: searchers(items, window))
        for batch in pieces(batches, 1, holding=name):
            n_words, n_hit, n_items, digests, all_spans, all_items = [], [], [], [], [], []
            names = batch.schema.names
            earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True) if "spans" in names else (([], []) for _ in range(batch.num_rows))
            kept = [batch.column("kept")] if "kept" in names else []
            for text, (spans, ids) in zip(as_bytes(batch.column(1)), earlier, strict=True):
                words, spans, ids = words_of(text), list(spans), set(ids)
                for search in found_by:
                    for start, which in search.find(words):
                        spans += (start, start + search.length)
                        ids.update(which)
                if last:
                    mask = bytearray(len(words)) if spans else b""
                    for k in range(0, len(spans), 2):
                        mask[spans[k] : spans[k + 1]] = b"\1" * (spans[k + 1] - spans[k])
                    n_words.append(len(words))
                    n_hit.append(sum(mask))
                    n_items.append(len(ids))
                    digests.append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
                else:
                    all_spans.append(spans)
                    all_items.append(sorted(ids))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), *kept], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *["kept"][: len(kept)]])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_items, pa.list_(pa.string())), *kept], names=["doc_id", "text", "spans", "items", *["kept"][: len(kept)]])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: words, words inside an occurrence of a benchmark window, items that occur.

    ``items_sha256`` is over the ids of the occurring items, sorted as strings.
    With ``keep`` there is a struct ``kept`` of those columns.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("binary").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    scratch = Scratch(docs.sparkSession) if blocks > 1 else None
    rows = with_kept(docs, keep, F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        run = _scan([(r["item"], bytes(r["text"])) for r in own.toLocalIterator()], window, k == blocks - 1)
        rows = rows.mapInArrow(run, schema_of(_RESULT if k == blocks - 1 else _PASS, rows))
        if k < blocks - 1:
            rows = scratch.write(rows, f"pass{k}")
    return rows
