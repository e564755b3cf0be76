"""Quality rules whose cutoffs follow the data: quantile sketches per language and source.

Per document the operator counts words, characters, symbols, repeated lines and
repeated 3-word windows.  Each ratio goes into a sketch of logarithmic bins (a
value's bin is the whole part of its logarithm to the base ``growth``, so a
quantile is right to a few percent of itself).  A sketch is a table of counts:
two are merged by adding them, which Spark does before the shuffle, so a source
with a third of all documents costs no more than any other.  A group's cutoff is

    upper quartile + ``fence`` * max(upper quartile - median, ``spread`` of the rule)

and correspondingly below for rules with a lower cutoff.  A group of fewer than
``least`` documents takes the sketch of its language, then that of all documents.
The cutoffs are then joined to the documents.

Null texts are empty; a null language or source is a group like any other.  An
empty document fails the base rules.  Repeated rows are judged each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.llm.common import Scratch, as_bytes, lookup, pieces

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Ratio of counts, least spread, and which sides have a cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.01, "upper"),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.10, "upper"),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.08, "upper"),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.05, "upper"),
    "word_length": ("word_chars / greatest(n_words, 1)", 0.30, "both"),
}


def measure(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``."""
    words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D only
    lines = [line for line in text.split(b"\n") if line.strip(_SPACES)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(windows) < len(words) - 2:
        end = 0  # of the words counted so far
        for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if windows[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return (
        len(words),
        len(text.translate(None, _SPACES + _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        rows = [measure(text) for text in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=["doc_id", "lang", "source", *_COUNTS])


def quantiles(rows: DataFrame, groups: list[str], values: list[str], at: list[float], growth: float, tag: str) -> DataFrame:
    """Per group the quantiles of each value (0 or more), from mergeable sketches of logarithmic bins.

    ``at`` has the quantiles; columns are ``{value}_{k}`` for the k-th of them, and ``{tag}`` the group's size.
    """
    step = F.log(F.lit(growth))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("rule"), F.when(F.col(v) > 1e-6, F.floor(F.log(F.col(v)) / step)).alias("bin")) for v in values)))
    sketch = rows.select(*groups, each.alias("x")).groupBy(*groups, "x.rule", "x.bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*groups, "rule")
    summed = sketch.withColumn("below", F.sum("n").over(own.orderBy(F.col("bin").asc_nulls_first()))).withColumn("total", F.sum("n").over(own))
    value = F.when(F.col("bin").isNull(), F.lit(0.0)).otherwise(F.exp((F.col("bin") + 0.5) * step))
    found = [F.min(F.when((F.col("rule") == v) & (F.col("below") >= F.ceil(F.col("total") * F.lit(q))), value)).alias(f"{v}_{k}") for v in values for k, q in enumerate(at)]
    return summed.groupBy(*groups).agg(F.max("total").alias(tag), *found)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50, most_repeated: int = 50, fence: float = 4.0, least: int = 200, growth: float = 1.04) -> DataFrame:
    """Counts, base verdict and adaptive verdict per document, with the cutoffs in columns of their own."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counts = scratch.write(counts.mapInArrow(_measure, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS)), "counts")
    rows = counts.withColumns({name: F.expr(how) for name, (how, _, _) in RULES.items()})
    filled = rows.filter("n_words > 0")
    names, at = list(RULES), [0.25, 0.5, 0.75]
    cuts = scratch.write(_cutoffs(filled, names, at, growth, least, fence), "cutoffs")
    out = lookup(rows, cuts, ["lang", "source"])
    passes = F.lit(True)
    for name, (_, _, sides) in RULES.items():
        passes &= F.coalesce(F.col(name) <= F.col(f"{name}_most"), F.lit(True))
        if sides == "both":
            passes &= F.coalesce(F.col(name) >= F.col(f"{name}_least"), F.lit(True))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)
    return out.select("doc_id", *_COUNTS[:5], "base_failed", "kept", *(c for c in cuts.columns if c not in ("lang", "source")))


def _cutoffs(filled: DataFrame, names: list[str], at: list[float], growth: float, least: int, fence: float) -> DataFrame:
    """Per language and source: ``{rule}_most`` and ``{rule}_least``."""
    fine = quantiles(filled, ["lang", "source"], names, at, growth, "n_group")
    by_lang = quantiles(filled, ["lang"], names, at, growth, "n_lang").select("lang", "n_lang", *(F.col(f"{n}_{k}").alias(f"{n}_{k}_lang") for n in names for k in range(3)))
    overall = quantiles(filled, [], names, at, growth, "n_all").first()  # one row
    joined = fine.alias("f").join(by_lang.alias("g"), F.col("f.lang").eqNullSafe(F.col("g.lang")), "left").select("f.*", *(F.col(f"g.{c}") for c in by_lang.columns if c != "lang"))
    out = [F.col("lang"), F.col("source")]
    for name, (_, spread, sides) in RULES.items():
        low, mid, high = (F.when(F.col("n_group") >= least, F.col(f"{name}_{k}")).when(F.col("n_lang") >= least, F.col(f"{name}_{k}_lang")).otherwise(F.lit(overall[f"{name}_{k}"])) for k in range(3))
        out.append((high + fence * F.greatest(high - mid, F.lit(spread))).alias(f"{name}_most"))
        if sides == "both":
            out.append((low - fence * F.greatest(mid - low, F.lit(spread))).alias(f"{name}_least"))
    return joined.select(*out)
