from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockprism.llm import decontaminate, language, lm_score, quality, secrets, urls
from blockprism.llm.common import Scratch

from .helpers import docs, random_texts, rows

# Decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_hits(texts, items, window=10):
    out = []
    for k, text in enumerate(texts):
        words, hit, ids = plain_words(text), set(), set()
        for item, content in items:
            own = plain_words(content)
            n = min(window, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        out.append((k, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination_matches_every_position(spark, block_bytes):
    items = list(enumerate(["a b c d e f g h i j k l m", "W1 w2! w3", "é", None, "", "w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5 w5", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"]))
    texts = [*random_texts(1, 40, 4, 50), "x a, b; c d e f g h i j k z", None, "", "É é", "w5 " * 30, "w2-w3-w4 w5 w6 w7 w8 w9 w10 w11 w12", "c d e f g h i j k l"]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(docs(spark, texts), table, block_bytes=block_bytes)
    assert rows(found) == sorted(plain_hits(texts, items), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.lists(st.sampled_from("abc"), min_size=3, max_size=3), min_size=1, max_size=6))
def test_wu_manber_finds_all(words, patterns):
    text = [w.encode() for w in words]
    wanted = {tuple(w.encode() for w in p): [str(k)] for k, p in enumerate(patterns)}
    found = sorted(decontaminate.WuManber(3, wanted).find(text))
    assert found == sorted((p, wanted[tuple(text[p : p + 3])]) for p in range(len(text) - 2) if tuple(text[p : p + 3]) in wanted)


# Secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


SECRETS = [
    'token = "abcdefghijkl"',
    "ToKeN: short; PASSWD='0123456789ab'",
    "token=secret: abcdefghijklmnop",  # the first match fails and takes the word secret with it
    "é\U0001f600 api_key=AKIAABCDEFGHIJKLMN apikey : deadbeefdeadbeef0",
    "AKIAABCDEFGHIJKLM AKIAABCDEFGHIJKLMN",
    "0123456789abcdef0123456789abcde 0123456789abcde",
    None,
    "",
    "nothing here, a passport and a tokenizer",
    "secret=secret=secretsecret token==abcdefghijkl",
]


def test_secret_spans_match_plain_scan(spark):
    found = secrets.scan(docs(spark, SECRETS), secrets.BASE)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert got == {k: plain_spans(t or "") for k, t in enumerate(SECRETS)}


def test_secrets_in_long_texts(spark):
    """A megabyte of what each rule begins with."""
    n = 1 << 20
    texts = ["-----BEGIN " + "A " * (n // 2) + x for x in ("PRIVATE KEY-----", "")] + [x * (n // len(x)) for x in ("eyJ", "-eyJ", "eyJa.", "AKIA", "token ", "token= ", "0123456789abcdef", "ghp_", "-----BEGIN ")]
    texts.append("x eyJabcdefghijk.eyJabcdefghijklmno.abc-eyJ y")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs(spark, texts)).collect()}
    assert found[0] == [(0, 3, len(texts[0]))] and found[1] == []
    assert found[len(texts) - 1] == [(2, 5, len(texts[-1]) - 2)]
    assert [len(found[k]) for k in (2, 3, 5, 6, 7, 8, 9, 10)] == [0, 0, 1, 0, 0, 1, 0, 0]


def test_trigram_queries_hold_for_every_match():
    for rule, text in ((secrets.BASE[0], "PassWord=x"), (secrets.BASE[0], "ApI_kEy:1"), (secrets.BASE[1], "AKIAZ"), (secrets.EXTRA[0], "-----BEGIN RSA PRIVATE KEY-----"), (secrets.EXTRA[1], "ghp_abc")):
        assert re.search(rule.pattern, text)
        grams = {text.lower()[k : k + 3] for k in range(len(text) - 2)}
        assert any(s <= grams for s in secrets.trigram_query(rule.pattern)), rule.kind
    assert secrets.trigram_query(secrets.BASE[2].pattern) == []


def test_extra_rules_and_masking(spark):
    text = "k -----BEGIN EC PRIVATE KEY----- é token=abcdefghijklm!"
    found = secrets.scan(docs(spark, [text, "clean"])).withColumn("m", secrets.masked(F.col("text"), F.col("spans"))).orderBy("doc_id")
    masked, clean = (r["m"] for r in found.collect())
    assert clean == "clean" and len(masked) == len(text) and masked == f"k {'*' * 30} é {'*' * 19}!"


def test_no_python_runs_for_secrets(spark):
    plan = secrets.scan(docs(spark, SECRETS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# Quality


def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[p : p + 3]) for p in range(len(words) - 2))
    covered = {p + k for p in range(len(words) - 2) if windows[tuple(words[p : p + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#é|", max_size=80))
def test_measures(text):
    assert quality.measure(text.encode())[:5] == plain_measure(text)


def test_quality_keeps_the_usual_and_drops_the_odd(spark):
    usual = [" ".join(f"{'abcdefgh'[: 3 + (k + j) % 4]}{j}" for j in range(80)) for k in range(300)]
    odd = ["### " * 30 + usual[0], "SHOUTING " + " ".join(f"LOUD{j}" for j in range(80)), "same line of words here\n" * 40, "short"]
    found = {r["doc_id"]: r for r in quality.quality(docs(spark, usual + odd)).collect()}
    assert all(found[k]["kept"] for k in range(300))
    assert not any(found[k]["kept"] for k in range(300, 304))
    assert not found[300]["base_failed"] and found[302]["base_failed"] and found[303]["base_failed"]


def test_sketch_quantiles_are_near_and_merge(spark):
    values = [(float(v), "a") for v in np.random.default_rng(0).lognormal(1, 1, 4000)] + [(0.0, "a")] * 100
    df = spark.createDataFrame(values, "x double, g string")
    row = quality.quantiles(df.repartition(7), ["g"], ["x"], [0.25, 0.5, 0.75], 1.04, "n").first()
    assert row == quality.quantiles(df.coalesce(1), ["g"], ["x"], [0.25, 0.5, 0.75], 1.04, "n").first()
    exact = np.quantile([v for v, _ in values], [0.25, 0.5, 0.75], method="inverted_cdf")
    assert np.allclose([row["x_0"], row["x_1"], row["x_2"]], exact, rtol=0.05)


# Language

SAMPLES = {"xx": "the quick brown fox and the dog of that house is there ", "yy": "der schnelle braune fuchs und das haus ist über dem hund "}


def test_language_of_held_out_texts(spark):
    table = [(k, " ".join((SAMPLES[x] * 3).split()[k % 7 : 12 + k % 9]), x) for k in range(200) for x in [("xx", "yy")[k % 2]]]
    df = spark.createDataFrame([*table, (900, None, "xx"), (901, "123 !", "xx"), (902, "no label", None)], "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r for r in language.languages(df.select("doc_id", "text"), df.filter(~language.held_out(F.col("doc_id")))).collect()}
    assert all(found[k]["lang_pred"] == x for k, _, x in table)
    assert [found[k]["lang_pred"] for k in (900, 901)] == ["und", "und"] and found[900]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_code_lengths_are_those_of_the_tree_and_frozen():
    text = b"abracadabra, abracadabra! " * 4
    gram, count = [], []
    seen = Counter()
    padded = bytes(3) + text
    for k in range(len(text)):
        seen[tuple(padded[k : k + 4])] += 1
    for (a, b, c, x), n in sorted(seen.items()):
        gram.append(a << 24 | b << 16 | c << 8 | x)
        count.append(n)
    model = language.train(["l"], np.zeros(len(gram), int), np.array(gram), np.array(count))
    assert np.allclose(np.exp2(-model.bits[:, 1:, 0]).sum(1) + np.exp2(-model.bits[:, -1, 0]) * (255 - (model.size - 2)), 1, atol=1e-3)
    data = np.frombuffer(b"abra" + text + b"" + b"ca", np.uint8)
    offsets = np.array([0, 4, 4 + len(text), 4 + len(text), len(data)])
    whole = model.lengths(data, offsets)
    alone = [model.lengths(data[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets, offsets[1:])]
    assert np.allclose(whole, alone) and whole[2] == 0
    language._STEP, kept = 7, language._STEP
    try:
        assert np.allclose(model.lengths(data, offsets), whole)
    finally:
        language._STEP = kept


# Language-model scores


def test_scores_match_a_plain_bigram_model(spark):
    target, background = random_texts(1, 20, 8, 30), [*random_texts(2, 40, 12, 30), None, ""]
    scored = [*target[:5], *background[-6:]]

    def model(texts):
        words, pairs, histories = Counter(), Counter(), Counter()
        for t in texts:
            tokens = ["^", *(t or "").split(), "^"]
            for h, w in zip(tokens, tokens[1:]):
                words[w] += 1
                histories[h] += 1
                pairs[h, w] += 1
        return words, histories, pairs

    vocabulary, prior = len({w for t in (*target, *background) for w in (t or "").split()}) + 1, 500.0

    def bits(m, text):
        words, histories, pairs = m
        tokens = ["^", *(text or "").split(), "^"]
        each = [np.log2((histories[h] + prior) / (pairs[h, w] + prior / vocabulary)) for h, w in zip(tokens, tokens[1:])]
        return float(np.mean(each))

    found = lm_score.cross_entropy_difference(docs(spark, scored), docs(spark, target), docs(spark, background)).orderBy("doc_id").collect()
    a, b = model(target), model(background)
    assert [r["n_tokens"] for r in found] == [len((t or "").split()) + 1 for t in scored]
    assert np.allclose([r["target_bits"] for r in found], [bits(a, t) for t in scored], atol=1e-4)
    assert np.allclose([r["difference"] for r in found], [bits(a, t) - bits(b, t) for t in scored], atol=1e-4)


def test_counts_tell_all_words_and_pairs_apart(spark):
    texts = random_texts(5, 60, 3000, 300)
    known = {w for t in texts for w in t.split()}
    assert 2000 < len(known) < 4096
    tokens = [["^", *t.split(), "^"] for t in texts]
    words = Counter(w for x in tokens for w in x[1:])
    pairs = Counter(p for x in tokens for p in zip(x, x[1:]))
    expected = [np.mean([np.log2((words[h] + 500) / (pairs[h, w] + 500 / (len(known) + 1))) for h, w in zip(x, x[1:])]) for x in tokens]
    table = docs(spark, texts)
    found = [lm_score.scored(table, F.col("doc_id") < 0, F.lit(True), chunk_bytes=size).orderBy("doc_id").collect() for size in (8 << 20, 1000)]
    assert np.allclose([r["background_bits"] for r in found[0]], expected, atol=1e-9)
    assert found[0] == found[1]


def test_vocabulary_size_beyond_the_sketch(spark):
    texts = [" ".join(f"w{k}" for k in range(at, at + 500)) for at in range(0, 40_000, 500)] * 2
    assert abs(lm_score.vocabulary_size(docs(spark, texts).select("text")) - 40_001) < 2500


# URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?x=/y", "a.com", "", None, "allow"),
        ("no scheme/com/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://cheappills.org/casino/win", "cheappills.org", "/casino/win", None, "allow"),
        ("x://y://z/w", "y:", "//z/w", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    if not hasattr(test_url_rules, "found"):
        cases = [m.args[1] for m in test_url_rules.pytestmark if m.name == "parametrize"][0]
        table = spark.createDataFrame([(k, c[0], "<p>cheap pills are many words</p>") for k, c in enumerate(cases)], "page_id bigint, url string, html string")
        test_url_rules.found = {cases[r["page_id"]][0]: r for r in urls.url_verdicts(table).collect()}
    r = test_url_rules.found[url]
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    assert rule is None or r["verdict"] == verdict


def splits(label):
    if not label:
        yield []
    for k in range(1, len(label) + 1):
        for rest in splits(label[k:]):
            yield [label[:k], *rest]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=9), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=12))
def test_segmentation_is_the_cheapest_of_all_splits(label, counts):
    total = sum(counts.values())

    def nats(words):
        return sum(urls.cost(w, counts.get(w, 0), total) for w in words)

    found = urls.segment(label, counts, total, 24)
    assert "".join(found) == label
    assert nats(found) <= min(map(nats, splits(label))) + 1e-9


PAGES = [
    *((f"http://{a}{b}.example.com/en/{k}", "<p>cheap pills casino win good news school</p>") for k, (a, b) in enumerate([("cheap", "pills"), ("casino", "win"), ("pills", "casino")] * 4)),
    *((f"http://{a}{b}.example.com/fr/{k}", "good school news day") for k, (a, b) in enumerate([("good", "news"), ("school", "day"), ("news", "school")] * 4)),
    ("http://wincheap.example.org/x/1", "cheap win"),
    ("http://dayschool.example.org/y/1", "school day"),
    ("http://4711.org/", None),
    ("http://daywin.org/schoolpills", "x"),
]


def test_run_together_words_are_split_and_judged(spark):
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(PAGES)], "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in urls.url_verdicts(table).collect()}
    n = len(PAGES)
    assert [found[k]["verdict"] for k in range(n - 4, n)] == ["block", "allow", "allow", "allow"]
    split = {label: words for label, words in map(tuple, urls.segmented(spark.createDataFrame([("wincheap",), ("dayschool",), ("zz",)], "label string"), spark.createDataFrame([("win", 5), ("cheap", 5), ("day", 3), ("school", 9), ("wi", 1)], "word string, n bigint"), Scratch(spark), 24).collect())}
    assert split == {"wincheap": ["win", "cheap"], "dayschool": ["day", "school"], "zz": ["zz"]}


def test_scores_match_plain_naive_bayes(spark):
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(PAGES)], "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in urls.url_verdicts(table).collect()}
    words = {"cheappills": "cheap pills", "casinowin": "casino win", "pillscasino": "pills casino", "goodnews": "good news", "schoolday": "school day", "newsschool": "news school", "wincheap": "win cheap", "dayschool": "day school", "daywin": "day win"}
    features = []
    for url, _ in PAGES:
        host, _, path = url.removeprefix("http://").partition("/")
        own = [f"@{w}" for label in host.split(".")[:-1] for w in words.get(label, label).split() if w.isalpha() and w != "example"]
        features.append(own + {"x/1": ["x"], "y/1": ["y"], "schoolpills": ["school", "pills"]}.get(path, []))
    seen = {v: Counter(w for f, r in zip(features, (found[k] for k in range(len(PAGES))), strict=True) if r["rule"] and r["verdict"] == v for w in f) for v in ("block", "allow")}
    vocabulary = {*seen["block"], *seen["allow"]}
    for k, own in enumerate(features):
        odds = [np.log((seen["block"][w] + 1) / (seen["block"].total() + len(vocabulary)) / ((seen["allow"][w] + 1) / (seen["allow"].total() + len(vocabulary)))) for w in own if w in vocabulary]
        expected = sum(odds) + np.log(12 / 12) if odds else 0
        assert abs(found[k]["score"] - expected) < 1e-9, PAGES[k]


# Language identification by a plain tree


def plain_bits(trained, text, order=3):
    """Code length of a text by prediction by partial matching with exclusion, from counts in dictionaries."""
    counts = {}
    for t in trained:
        for k, byte in enumerate(t):
            for n in range(order + 1):
                context = tuple((t[k - j] if k >= j else None) for j in range(n, 0, -1))
                counts.setdefault(context, Counter())[byte] += 1

    def probability(context, byte):
        shorter = probability(context[1:], byte) if context else 1 / 256
        seen = counts.get(context)
        if not seen:
            return shorter
        total, distinct = seen.total(), len(seen)
        if seen[byte]:
            return seen[byte] / (total + distinct)
        rest = 1 - sum(probability(context[1:], b) if context else 1 / 256 for b in seen)
        return distinct / (total + distinct) * shorter / rest

    return sum(-np.log2(probability(tuple((text[k - j] if k >= j else None) for j in range(order, 0, -1)), byte)) for k, byte in enumerate(text))


def test_code_lengths_match_a_plain_tree():
    trained = {"a": [b"abra cadabra", b"bar"], "b": [b"dada cab", b"card"]}
    rows = []
    for k, texts in enumerate(trained.values()):
        for t in texts:
            data = np.frombuffer(t, np.uint8).astype(np.int64)
            past = [np.concatenate([np.zeros(n, np.int64), data])[: len(data)] for n in range(4)]
            rows += [(k, g) for g in (past[3] << 24 | past[2] << 16 | past[1] << 8 | past[0]).tolist()]
    lang, gram = (np.array(x) for x in zip(*rows, strict=True))
    model = language.train(["a", "b"], lang, gram, np.ones(len(gram)))
    for text in (b"abra", b"dabcard", b"a", b"cab bar"):
        found = model.lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert np.allclose(found, [plain_bits(x, text) for x in trained.values()], rtol=1e-4), text
