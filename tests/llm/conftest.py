from __future__ import annotations

import pytest

#: Nulls, empty and blank texts, repeated rows and ids, ties, and columns whose names clash with the operators' own.
EDGES = [
    (0, "one two three four five six seven eight nine ten eleven twelve"), (0, "one two three four five six seven eight nine ten eleven twelve"), (1, None), (2, ""), (3, " \t\n\x0b "),
    (None, "one two three four five six seven eight nine ten eleven twelve"), (None, None), (4, "ONE two three four five six seven eight nine ten eleven twelve"), (4, "another text of this id"), (5, "Ünïcödé 東京 🙂 ﬁ ① \x00 ▁a"),
    (6, "word " * 5000), (7, "a"), (8, "x" * 30000), (9, "one two"),
]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    extra = {c: F.lit(1) for c in ("id", "n", "node", "label", "key", "sig", "size", "shard", "slot", "spans", "base", "words", "anchor", "seg", "k1", "k2", "copies", "member", "media", "score", "ids", "part", "marks", "row", "lang", "source", "n_chars")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
