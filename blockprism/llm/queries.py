"""The ``opN_*`` queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.llm.common import lookup
from blockprism.llm.decontaminate import contamination
from blockprism.llm.id_files import round_trip
from blockprism.llm.language import held_out, languages
from blockprism.llm.lm_score import scored
from blockprism.llm.packing import pack
from blockprism.llm.quality import quality
from blockprism.llm.secrets import BASE, EXTRA, scan, written
from blockprism.llm.simhash import near_duplicates
from blockprism.llm.substring import without_repeats
from blockprism.llm.urls import url_verdicts


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus are the documents that are labelled good, the background are all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    return scored(lookup(docs, good, ["doc_id"]), F.col("good"), F.lit(True))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE + EXTRA
    found = scan(table(spark, sf_dir, "documents"), rules)
    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")

    counts = [count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(written(base, rules).cast("binary"), 256).alias("base_sha256"), written(F.col("spans"), rules).alias("spans"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs.select("doc_id", "text"), docs.filter(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_quality, op4_token_ids, op5_lm_score, op6_secrets, op7_language, op8_substring, op9_decontaminate, op10_urls)}
