"""Secret scans by a trigram inverted index, with DataFrame functions only.

The plan is made on the driver from the rules' expressions: from each, the
Boolean query over trigrams that any match must satisfy, as a choice between sets
of mandatory trigrams.  Executors then

1. index: per document the queries' trigrams that occur in the lower-cased text
   become postings ``(trigram, document)``;
2. intersect: a document is a candidate for a rule if one of its sets has all its
   postings there;
3. verify: the rule's expression is applied to its candidates alone.

A rule without a mandatory trigram scans every text.  Postings are of a fixed,
small number of trigrams; a document has each at most once, and they are counted
per document with a partial aggregate, so no trigram and no document makes a hot
key.  Candidates are joined by ``lookup``.

No rule repeats a group, so an expression needs no recursion on long texts.
Matches are leftmost and do not overlap within a rule; positions are code points,
the end exclusive.  A null or empty text has no spans.  Documents are told apart
by id and text hash, so repeated ids and null ids are each scanned for themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, lookup, with_kept


@dataclass(frozen=True)
class Rule:
    """``least`` is the number of characters that group ``group`` of a match must have.

    With ``tail`` the span is that group alone, which has to end the match.
    """

    kind: str
    pattern: str
    group: int
    least: int
    tail: bool = False


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough, begun where they begin
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 0, 40),
    Rule("web_token", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30, tail=True),  # begun at no other place, a run is read once
)
#: A string set of more members than this is not followed further.
_MOST = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed expression can match, if they are few; else None."""
    found = {""}
    for op, arg in node:
        if op is _constants.LITERAL:
            each = {chr(arg).lower()}
        elif op is _constants.SUBPATTERN:
            each = _strings(arg[-1])
        elif op is _constants.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            each = None if None in parts else set().union(*parts)
        elif op is _constants.MAX_REPEAT and arg[1] <= 4 and (one := _strings(arg[2])) is not None:
            each = {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
        elif op is _constants.IN and all(x is _constants.LITERAL for x, _ in arg):
            each = {chr(c).lower() for _, c in arg}
        else:
            each = None
        if each is None or len(found) * len(each) > _MOST:
            return None
        found = {a + b for a in found for b in each}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams of which every match of the pattern, lower-cased, has one set completely; none: no such sets.

    Of the runs of elements that have few strings, the one whose shortest string
    is longest makes the query.
    """
    best: set[str] = set()
    tree = list(_parser.parse(pattern))
    for start in range(len(tree)):
        for end in range(start + 1, len(tree) + 1):
            if (found := _strings(tree[start:end])) is None:
                break
            if min(map(len, found)) > min(map(len, best), default=2):
                best = found
        if tree[start][0] is _constants.SUBPATTERN and not best:
            best = next((x for k in [list(tree[start][1][-1])] if (x := _strings(k)) and min(map(len, x)) > 2), set())
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in best}
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, order, end>>`` of the rule's matches of sufficient length."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    lengths = F.transform(matches, F.char_length)
    sizes = lengths if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length)
    found = F.transform(F.arrays_zip(between.alias("gap"), lengths.alias("size"), sizes.alias("own")), lambda x: F.struct(F.coalesce(x["gap"], F.lit(0)).alias("gap"), x["size"].alias("size"), x["own"].alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        first = end - F.coalesce(x["own"], F.lit(0)) if rule.tail else begin
        one = F.array(F.struct(first.alias("start"), F.lit(order).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.when(F.size(F.filter(sizes, lambda n: n >= rule.least)) > 0, F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, text, spans)`` with ``spans`` an array of ``(start, rank, end)``, ``rank`` the rule's place in ``rules``.

    With ``keep`` there is a struct ``kept`` of those columns.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_kept(docs, keep, F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    plan = {k: trigram_query(rule.pattern) for k, rule in enumerate(rules)}
    grams = sorted(set().union(*(s for sets in plan.values() for s in sets)))
    out = rows
    if grams:
        lowered = rows.select("doc_id", "text_hash", F.lower("text").alias("low"))  # once for all trigrams
        marked = lowered.select("doc_id", "text_hash", F.array(*(F.when(F.col("low").contains(g), F.lit(k)) for k, g in enumerate(grams))).alias("there"))
        postings = scratch.write(marked.select("doc_id", "text_hash", F.explode("there").alias("gram")).filter("gram is not null"), "postings")
        sets = [(k, s) for k, found in plan.items() for s in found]
        words = [F.expr(f"bit_or(case when gram div 62 = {w} then shiftleft(1L, cast(gram % 62 as int)) else 0L end)").alias(f"w{w}") for w in range(-(-len(grams) // 62))]
        lists = postings.groupBy("doc_id", "text_hash").agg(*words)

        def complete(s: frozenset[str]) -> Column:
            masks = [0] * len(words)
            for g in s:
                masks[grams.index(g) // 62] |= 1 << grams.index(g) % 62
            ok = F.lit(True)
            for w, mask in enumerate(masks):
                if mask:
                    ok &= F.col(f"w{w}").bitwiseAND(F.lit(mask)) == mask
            return ok

        wanted = F.lit(0)
        for k, found in plan.items():
            if found:
                any_set = F.lit(False)
                for s in found:
                    any_set |= complete(s)
                wanted = wanted + F.when(any_set, 1 << k).otherwise(0)
        candidates = scratch.write(lists.select("doc_id", "text_hash", wanted.alias("candidate")).filter("candidate > 0"), "candidates")
        out = lookup(rows, candidates, ["doc_id", "text_hash"])
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    each = [_spans(F.col("text"), rule, k) if not plan[k] else F.when(F.coalesce(F.col("candidate"), F.lit(0)).bitwiseAND(1 << k) > 0, _spans(F.col("text"), rule, k)).otherwise(none) for k, rule in enumerate(rules)]
    return out.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("spans"), *(["kept"] if keep else []))


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span's characters replaced by ``*``; spans may overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        kept = F.substring(text, acc["at"] + 1, begin - acc["at"])
        return F.struct(end.alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit("*"), end - begin)).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
