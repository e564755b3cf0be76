from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from blockprism.llm import decontaminate, secrets

from .helpers import SCHEMA, awkward, empty, with_clashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_return_documents(spark, documents, tmp_path):
    docs = documents
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(pipeline.STAGES) - 1:
            assert out.dtypes == documents.dtypes, name
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
    assert ids(out.select("doc_id").distinct()) == ids(docs)
    assert ids(pipeline.run(spark, SF)) == ids(out)


def test_language_stage_keeps_texts_and_drops_what_has_none(spark, documents):
    odd = spark.createDataFrame([(10**6, "123 --- 456", "en", "s", 11), (10**6 + 1, None, "en", "s", 0)], SCHEMA)
    found = pipeline.language_id(spark, documents.unionByName(odd), SF)
    assert ids(found) == ids(documents)
    assert found.join(documents.select("doc_id", documents["lang"].alias("was")), "doc_id").filter("lang <> was").isEmpty()


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{k * k % 997}" for k in range(400))
    near = base.replace("w4 ", "changed ", 1)
    other = " ".join(f"v{k * k % 991}" for k in range(400))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in [(3, base), (1, base), (2, near), (9, other), (9, other), (None, other)]], SCHEMA)
    found = pipeline.near_dedup(spark, df, SF).collect()
    assert len(found) == 2 and {r["text"] for r in found} <= {base, near, other}


def test_contaminated_documents_go_and_others_stay(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontaminate.searchers([(str(i), (t or "").encode()) for i, t in items], 10)
    clean = [r["doc_id"] for r in documents.collect() if not any(True for s in found for _ in s.find(decontaminate.words_of((r["text"] or "").encode())))]
    assert ids(pipeline.decontaminate(spark, documents, SF)) == sorted(clean)
    assert 0 < len(clean) < documents.count()


def test_secrets_are_masked_everywhere(spark, documents):
    found = pipeline.mask_secrets(spark, documents, SF)
    assert ids(found) == ids(documents)
    assert secrets.scan(found).filter("size(spans) > 0").isEmpty()
    assert found.join(documents.withColumnRenamed("text", "was"), "doc_id").filter("char_length(text) <> char_length(was)").isEmpty()


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_stages_bear_awkward_tables(spark, stage):
    assert stage(spark, with_clashes(awkward(spark)), SF).count() > 0
    assert stage(spark, empty(spark), SF).collect() == []
