"""Small fixtures and the awkward tables that every operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use inside.
CLASHING = "row_key bigint, fp bigint, kept string, spans string, rank int, score double, length bigint, part int, word string, candidate int"


def docs(spark, texts, first=0):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Null columns, empty and long texts, ties, repeated rows and null ids."""
    long = " ".join(f"w{k % 997}" for k in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", None, 4),
        (4, long, None, "s", len(long)),
        (5, "one", "en", "s", 3),
        (5, "one", "en", "s", 3),
        (6, "one two", "de", "s", 7),
        (None, "no id here", "en", "s", 10),
        (None, None, "en", "s", 0),
        (7, "ünï cödé — \U0001f600 token = \"abcdef0123456789abcdef\"", "de", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in CLASHING.split(", ")))


def random_texts(seed, n, vocabulary=30, length=60):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(length))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
