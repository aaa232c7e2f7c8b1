"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's `docs`. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.llm.decontaminate import decontaminated
from lightframe.llm.minhash_dedup import near_duplicates
from lightframe.llm.piece_viterbi import transcoded
from lightframe.llm.quality_qda import fit, keep, statistics
from lightframe.llm.queries import piece_model
from lightframe.llm.secret_scan import redacted, scan
from lightframe.llm.shared import checked, documents, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """`docs` with another text, and n_chars where the text has changed."""
    changed = ~text.eqNullSafe(F.col("text"))
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, learned from this input's labelled rows, doesn't reject."""
    stats = stash(statistics(docs), "statistics")
    return keep(docs, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 on five-word shingles): that of the smallest id, and of several
    texts of that id one; rows without an id come last. Of rows that repeat an id (null, too) and its text one stays."""
    i, text = F.col("doc_id"), F.md5(F.col("text").cast("binary"))
    # a row's own key without nulls, ordered by id
    own = F.struct(i.isNull().alias("none"), F.coalesce(i, F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.coalesce(F.unhex(text), F.lit(b"")).alias("text"))
    found = near_duplicates(docs.select(own.alias("own"), "text"), id_col="own", percent=80).where("kept")
    kept = stash(found.groupBy(F.col("doc_id").alias("own")).agg(F.count("*").alias("n")), "kept")
    out = docs.withColumn("own", own)
    once = out.join(checked(kept.where("n = 1").select("own")), "own", "left_semi").select(*COLUMNS)
    more = kept.where("n > 1").select("own")
    if not more.limit(1).count():  # no row repeats another: its branch would be empty
        return once
    return once.unionByName(out.join(checked(more), "own", "left_semi").dropDuplicates(["own"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten or more words of benchmark items are cut out; documents that are half such passages go."""
    out = decontaminated(docs.withColumn("was", F.col("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    changed = ~F.col("text").eqNullSafe(F.col("was"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    found = scan(docs.select(F.struct(*COLUMNS).alias("row"), "text"), id_col="row", keep_text=True)
    rows = found.select("doc_id.*", "spans")
    return _with_text(rows, redacted(F.col("text"), F.col("spans")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, score, sums of the ids and of the text that they decode to, and the ids."""
    return transcoded(docs, piece_model(), keep_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("sentencepiece encoding", encoding),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
