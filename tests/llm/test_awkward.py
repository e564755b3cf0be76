"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

from __future__ import annotations

import pytest

from blockprism.llm import decontaminate, id_files, language, lm_score, packing, quality, secrets, simhash, substring, urls
from blockprism.llm.queries import tokenizer_path

from .helpers import awkward, empty, rows, with_clashes


def items(df):
    return df.select(df["doc_id"].alias("item_id"), "text").filter("item_id in (5, 6)")


OPERATORS = {
    "simhash": lambda df: simhash.near_duplicates(df),
    "packing": lambda df: packing.pack(df, tokenizer_path()).drop("sequence_id", "offset"),
    "quality": lambda df: quality.quality(df),
    "id_files": lambda df: id_files.round_trip(df, tokenizer_path()),
    "lm_score": lambda df: lm_score.cross_entropy_difference(df, df.filter("lang = 'de'"), df),
    "secrets": lambda df: secrets.scan(df),
    "language": lambda df: language.languages(df, df),
    "substring": lambda df: substring.without_repeats(df),
    "decontaminate": lambda df: decontaminate.contamination(df, items(df)),
    "urls": lambda df: urls.url_verdicts(df.withColumnsRenamed({"doc_id": "page_id", "text": "url", "lang": "html"})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, name):
    df = awkward(spark)
    found = OPERATORS[name](df)
    key = found.columns[0]
    expected = sorted((r["doc_id"] for r in df.collect()), key=repr)
    got = [r[key] for r in found.collect()]
    if name == "packing":  # the long text has several pieces
        assert {*got} == {*expected} and got.count(5) == 2
    else:
        assert sorted(got, key=repr) == expected


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](empty(spark)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    df = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert rows(OPERATORS[name](with_clashes(df))) == rows(OPERATORS[name](df))


def test_empty_texts(spark):
    df = awkward(spark)
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(df.filter("doc_id < 4")).collect()}
    assert {r["fingerprint"] for r in prints.values()} == {"0" * 16} and {r["component_id"] for r in prints.values()} == {1}
    assert all(r["base_failed"] for r in quality.quality(df).filter("doc_id < 4").collect())
    assert [r["lang_pred"] for r in language.languages(df, df).filter("doc_id < 4").collect()] == ["und"] * 3
    assert [r["length"] for r in packing.pack(df, tokenizer_path()).filter("doc_id < 3").collect()] == [1, 1]
