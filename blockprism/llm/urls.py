"""URL filters: rules first, then naive Bayes over the words of host and path.

Hosts run words together.  A unigram model of the words of all pages' texts, of
all paths and of hyphenated host names, counted over the whole table, splits each
run of letters by Viterbi search into the likeliest sequence of words; an unknown
piece costs by its length.  Multinomial naive Bayes then scores the words of host
and path, host words being told apart from path words.

The classifier is fitted on a bounded sample: of the distinct URLs that a rule
decides, at most ``sample`` per verdict, those with the smallest hashes.  How many
a verdict has in all gives the share of ``block`` before any word is seen.  The last
label and the words that rules name are left to the rules, as they would only
repeat them.

No lexicon goes to one place.  Each distinct run of letters meets the words that lie
in it, at most ``longest`` letters each, by a join on its parts; so every counted
word that could be of use is used.  Only the sample and its words' weights reach the
driver.

A null URL, or one without ``://``, has an empty host and path and no rule; without
a word to go by, or without URLs of both verdicts to learn from, the verdict is
``allow``.  Repeated rows are judged each; ids may be null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, lookup, pieces

#: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_WORD = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"<[^>]*>")
_LETTERS = r"\p{L}+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a later, longer one replaces
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        name, verdict = F.when(fits, f"{at}{prefix}").otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def segment(label: str, counts: dict[str, int], total: int, longest: int) -> list[str]:
    """The likeliest split into words, of which an unknown one has a tenth of a count a letter less each. Ties: the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            piece = label[start:end]
            options.append((best[start][0] + cost(piece, counts.get(piece, 0), total), start))
        best.append(min(options))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def cost(word: str, count: int, total: int) -> float:
    """Nats of a word of the unigram model."""
    return math.log(total / count) if count else math.log(max(total, 1)) + (len(word) - 1) * math.log(10)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        counts: Counter[str] = Counter()
        for host, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for label in host.split("."):
                if "-" in label:
                    counts.update(_WORD.findall(label))
            counts.update(_WORD.findall(path.lower()))
            counts.update(_WORD.findall(_MARKUP.sub(" ", text or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _segment(total: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segment(label, {x["word"]: x["n"] for x in known or ()}, total, longest) for label, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "words"])

    return run


def segmented(labels: DataFrame, counted: DataFrame, scratch: Scratch, longest: int) -> DataFrame:
    """``(label, words)`` for distinct ``label``s, by the words ``(word, n)``."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = F.sequence(F.lit(1), F.char_length("label"))
    parts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("label") - i + 1)), lambda n: F.col("label").substr(i, n))))
    parts = labels.select("label", F.explode(F.array_distinct(parts)).alias("word"))
    known = lookup(parts, counted, ["word"]).filter("n is not null").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    each = lookup(labels, scratch.write(known, "known"), ["label"])
    return scratch.write(each.mapInArrow(_segment(total, longest), "label string, words array<string>"), "segments")


def weights(seen: dict[str, Counter]) -> dict[str, float]:
    """Log odds of ``block`` over ``allow`` per word, with add-one smoothing."""
    vocabulary = sorted(set(seen["block"]) | set(seen["allow"]))
    of = {v: c.total() + len(vocabulary) for v, c in seen.items()}
    return {w: math.log((seen["block"][w] + 1) / of["block"]) - math.log((seen["allow"][w] + 1) / of["allow"]) for w in vocabulary}


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES, sample: int = 2000, longest: int = 24) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``; ``score`` is the log odds of ``block``."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    host, path = host_and_path(F.col(url_col))
    pages = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    counts = pages.select("host", "path", "text").mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.write(counts.filter(F.char_length("word") <= longest), "counted")

    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = scratch.write(pages.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), F.monotonically_increasing_id().alias("row_key")), "urls")
    stem = F.when(F.instr("host", ".") > 0, F.regexp_extract("host", r"^(.*)\.", 1)).otherwise("")  # all but the last label

    def runs(text: Column, in_host: bool) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_LETTERS), F.lit(0)), lambda x: F.struct(F.lit(in_host).alias("in_host"), x.alias("label")))

    each = urls.select("row_key", "by_rule", F.explode(F.concat(runs(stem, True), runs(F.lower("path"), False))).alias("x")).select("row_key", "by_rule", "x.*")
    segments = segmented(scratch.write(each.select("label").distinct(), "labels"), counted, scratch, longest)
    named = {w for at, prefix, _ in rules for w in _WORD.findall(f"{at} {prefix}")}
    word = F.col("word")
    words = lookup(each, segments, ["label"]).select("row_key", "by_rule", "in_host", F.explode("words").alias("word")).filter(~word.isin(*named) if named else F.lit(True))
    words = scratch.write(words.select("row_key", "by_rule", F.when(F.col("in_host"), F.concat(F.lit("@"), word)).otherwise(word).alias("word")), "words")

    seen, of = {}, {}
    for what in ("block", "allow"):
        own = urls.filter(F.col("by_rule") == what).groupBy("host", "path").agg(F.min("row_key").alias("row_key"))
        chosen = own.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).select("row_key")
        learned = words.filter(F.col("by_rule") == what).join(F.broadcast(chosen), "row_key", "left_semi")  # at most `sample` keys
        seen[what] = Counter({r["word"]: r["n"] for r in learned.groupBy("word").agg(F.count("*").alias("n")).collect()})  # words of `sample` URLs
        of[what] = own.count()
    learned = weights(seen) if all(of.values()) else {}
    prior = math.log(of["block"] / of["allow"]) if all(of.values()) else 0.0
    table = scratch.write(spark.createDataFrame(list(learned.items()), "word string, weight double"), "weights")
    sums = scratch.write(lookup(words.select("row_key", "word"), table, ["word"]).groupBy("row_key").agg(F.sum("weight").alias("weight")), "sums")
    out = lookup(urls, sums, ["row_key"])
    score = F.when(F.col("weight").isNotNull(), F.col("weight") + prior).otherwise(0.0)  # no word that was learned: for neither
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
