"""A corpus pipeline of five stages, each of which applies one operator of ``blockprism.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before it kept; all but the last return the columns of ``documents``, and
drop others.  An empty table gives an empty table in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.llm.common import Scratch, lookup
from blockprism.llm.decontaminate import contamination
from blockprism.llm.language import held_out, languages
from blockprism.llm.packing import pack
from blockprism.llm.queries import table, tokenizer_path
from blockprism.llm.secrets import masked, scan
from blockprism.llm.simhash import similar_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with a ``row_key`` of type long that no two rows share."""
    docs = docs.select(*COLUMNS)
    odd = docs.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.isEmpty():
        return docs.withColumn("row_key", F.col("doc_id"))
    return scratch.write(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed_docs")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, labelled with it; ``und`` goes.

    So texts that are null, empty or without a letter go; repeated rows stay.
    """
    training = docs.filter(~held_out(F.col("doc_id")))
    found = languages(docs, training, keep=COLUMNS).filter("lang_pred <> 'und'")
    return found.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"kept.{c}") for c in COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest key, of each group of texts that share 0.8 of their five-word shingles.

    Repeated rows are copies, so one stays.  Texts without a word, nulls among them,
    are one group.  Ids may be null or repeated: rows then get keys of their own.
    """
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    found = similar_groups(keyed, id_col="row_key")
    copies = scratch.write(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("row_key"), F.lit(True).alias("copy")), "copies")
    return lookup(keyed, copies, ["row_key"]).filter("copy is null").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item.

    Null and empty texts have no words and stay, repeated rows stay or go together;
    with an empty benchmark all stay.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.filter("not contaminated").select("kept.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the characters of secrets replaced by ``*``.

    A null text stays null, an empty one empty; each repeated row is masked for itself.
    """
    found = scan(docs, keep=COLUMNS)
    return found.select(*(masked(F.col("text"), F.col("spans")).alias(c) if c == "text" else F.col(f"kept.{c}") for c in COLUMNS))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in training sequences.

    A null or empty text is a piece of the end id alone; each repeated row has pieces of its own.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("best_fit", best_fit),
]

#: Language models, fingerprints and tokenizers have no DuckDB form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
