"""Substring deduplication by seed and extend.

A window of ``window`` consecutive words is a repeat if its word sequence also
starts anywhere else.  Every word that a repeat covers is removed.

Seeds.  Winnowing picks an anchor for each window: the rightmost least hash among
its ``seed``-word grams, which depends on the window's words alone, so equal
windows have equal anchors.  Consecutive windows of one anchor make a run; runs
are about a fifteenth of the words.

Extension.  Documents meet on anchors; anchors that occur once are dropped.  The
others are extended both ways as far as the run goes, and the run's whole word
span is hashed: runs with equal spans repeat each other altogether (classes).  A
run whose span occurs once may still repeat in part.  For anchors with such runs,
one run of each class gives its windows, which are counted by anchor and hash, and
those that occur again are joined back.  Adjacent repeats are merged to maximal ones.

Nothing is a pair, and nothing is held together: a passage in a third of all
documents is a class or a few counted windows, combined before the shuffle, and
what is joined back has a key once, so adaptive execution can split the other side.
Windows are compared by an anchor's and a window's 64-bit hashes, 128 bits together.

A null or empty text has no words.  Repeated rows repeat each other.  Ids may be
null or repeated (see ``unique_keyed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.llm.common import Scratch, as_bytes, flat, lookup, pieces, unique_keyed
from blockprism.llm.rolling import BYTE, Rolling

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lists of runs or spans of up to so many elements in all are broadcast, larger ones join by a shuffle.
_LISTED = 2_000_000
#: Tables of anchors grow with the corpus: beyond so many rows they join by a shuffle.
_ANCHORS = 20_000
_PIECE = 1 << 20
#: Bytes of a word up to which its hash is a rolling sum.
_LONG = 128


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, and how many words come before each text (and in all).

    Sums modulo 2^64 are blind to some pairs of very long strings, whatever the
    base, so words of over ``_LONG`` bytes are hashed by XXH3.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = True, True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    hashes = Rolling(BYTE[data], 0).of(starts, ends)
    for k in np.flatnonzero(ends - starts > _LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return hashes, np.searchsorted(starts, offsets, "left")


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each position the rightmost place of the least of ``width`` grams from there on."""
    least, place, have = grams, np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        n = len(least) - step
        right = least[step:] <= least[:n]
        least, place = np.where(right, least[step:], least[:n]), np.where(right, place[step:], place[:n])
        have += step
    return place


def _runs(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _PIECE):
            hashes, before = word_hashes(*flat(batch.column(1)))
            if len(hashes) < window:
                continue
            at = np.arange(len(hashes) - seed + 1)
            grams = Rolling(hashes, 1).of(at, at + seed)
            place = anchors(grams, window - seed + 1)
            starts = np.arange(len(place))
            doc = np.searchsorted(before, starts, "right") - 1
            starts = starts[starts + window <= before[doc + 1]]
            if not len(starts):
                continue
            place, doc = place[starts], doc[starts]
            cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0)) + 1
            first, last = starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]]
            doc, place = doc[np.r_[0, cut]], place[np.r_[0, cut]]
            spans = Rolling(hashes, 2).of(first, last + window)
            keys = batch.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([keys, pa.array((first - before[doc]).astype(np.int32)), pa.array((last - before[doc]).astype(np.int32)), pa.array(grams[place].view(np.int64)), pa.array(spans.view(np.int64))], names=["row_key", "first", "last", "anchor", "span"])

    return run


def _windows(window: int):
    """Of the runs listed beside each text: a row for each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, _PIECE):
            out: list[tuple[np.ndarray, ...]] = []
            for key, text, runs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                hashes, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                rolling = Rolling(hashes, 2)
                starts = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs])
                sizes = [r["last"] + 1 - r["first"] for r in runs]
                anchor, alone = (np.repeat(np.array([r[k] for r in runs], t), sizes) for k, t in (("anchor", np.int64), ("alone", bool)))
                out.append((anchor, rolling.of(starts, starts + window).view(np.int64), np.full(len(starts), key, np.int64), starts.astype(np.int32), alone))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "win", "row_key", "start", "alone"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            out = []
            for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D only
                kept, at = [], 0
                for span in sorted((s["first"], s["last"] + window) for s in spans or ()):
                    kept += words[at : span[0]]
                    at = max(at, span[1])
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            counts = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64()), pa.array(counts[2], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _listed(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return rows.groupBy("row_key").agg(F.collect_list(F.struct(*columns)).alias(name))


def _merged(spans: DataFrame, window: int) -> DataFrame:
    """Spans of window starts, joined where the windows leave no word between them."""
    own = Window.partitionBy("row_key").orderBy("first", "last")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.when(F.col("first") <= reach + window, 0).otherwise(1)).withColumn("k", F.sum("new").over(own))
    return begun.groupBy("row_key", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed: int = 8) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: the words that no repeat covers, joined by spaces."""
    scratch = Scratch(docs.sparkSession)
    rows = unique_keyed(docs, scratch, id_col, text_col)
    runs = scratch.write(rows.select("row_key", "text").mapInArrow(_runs(window, seed), "row_key bigint, first int, last int, anchor bigint, span bigint"), "runs")
    shared = scratch.write(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.lit(True).alias("shared")), "shared")
    seeds = scratch.write(lookup(runs, shared, ["anchor"], most=_ANCHORS).filter("shared").drop("shared"), "seeds")
    scratch.drop("runs")
    classes = scratch.write(seeds.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "first", "last")).alias("one")), "classes")
    whole = scratch.write(classes.filter("n > 1").select("anchor", "span", F.lit(True).alias("whole")), "whole")
    spans = scratch.write(lookup(seeds, whole, ["anchor", "span"], most=_ANCHORS).filter("whole").select("row_key", "first", "last"), "whole_spans")
    scratch.drop("seeds")

    partly = scratch.write(classes.groupBy("anchor").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("alone")).filter("k > 1 and alone > 0").select("anchor", F.lit(True).alias("partly")), "partly")
    chosen = lookup(classes, partly, ["anchor"], most=_ANCHORS).filter("partly").select("one.*", "anchor", (F.col("n") == 1).alias("alone"))
    lists = scratch.write(_listed(chosen, ["first", "last", "anchor", "alone"], "runs"), "lists")
    n = lists.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    some = lookup(rows.select("row_key", "text"), lists, ["row_key"], size=n, most=_LISTED).filter("runs is not null")
    windows = scratch.write(some.mapInArrow(_windows(window), "anchor bigint, win bigint, row_key bigint, start int, alone boolean"), "windows")
    again = scratch.write(windows.groupBy("anchor", "win").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "win", F.lit(True).alias("again")), "again")
    partly_spans = lookup(windows.filter("alone"), again, ["anchor", "win"], most=_ANCHORS).filter("again").select("row_key", F.col("start").alias("first"), F.col("start").alias("last"))

    spans = scratch.write(_listed(_merged(spans.unionByName(partly_spans), window), ["first", "last"], "spans"), "spans")
    n = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    scratch.drop("shared", "classes", "whole", "whole_spans", "partly", "lists", "windows", "again")
    return lookup(rows, spans, ["row_key"], size=n, most=_LISTED).select("doc_id", "text", "spans").mapInArrow(_cut(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
