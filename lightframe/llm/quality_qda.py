"""A quality classifier: regularised quadratic discriminant analysis over document statistics.

`statistics` reads every whole text once and keeps a few doubles a document. `fit` aggregates counts, sums and cross
products per class in Spark (one row a class reaches the driver), shrinks each class covariance towards the pooled
one and a diagonal, and caches the inverse Cholesky factors. `score` is a column expression: the difference of two
Mahalanobis forms, log determinants and priors, through the logistic function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightframe.llm.words import pieces

STATISTICS = ("words", "upper", "marks", "bars", "bangs", "digits", "points", "distinct", "repeated", "length", "lines", "odd_ends")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = b"*#%$&@^~<>{}[]\\=+_"
_POINTS = b".,;:?'\"()-"
_DIGITS = b"0123456789"
_GOOD_END = frozenset(_LETTERS + _DIGITS + b".,;:?" + bytes(range(128, 256)))


def document_statistics(text: bytes | None) -> list[float]:
    """Transformed shares and sizes of one text; all zero for null, empty and blank ones."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(text), len(words)
    count = lambda chars: size - len(text.translate(None, chars))
    letters = count(_LETTERS)
    root = lambda part, whole: math.sqrt(part / max(1, whole))
    return [
        math.log1p(n),
        root(count(_UPPER), letters),
        root(count(_MARKS), size),
        root(text.count(b"|"), n),
        root(text.count(b"!"), size),
        root(count(_DIGITS), size),
        root(count(_POINTS), size),
        math.log(len(set(words)) / n),
        root(sum(map(bytes.__eq__, words, words[1:])), n),
        math.log(size / n),
        root(text.count(b"\n"), n),
        root(sum(w[-1] not in _GOOD_END for w in words), n),
    ]


def _kernel(batches):
    for b in (piece for whole in batches for piece in pieces(whole, 1)):
        made = np.array([document_statistics(t) for t in b.column(1).to_pylist()], dtype=float).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(made[:, i]) for i in range(made.shape[1]))], ["doc_id", *STATISTICS])


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of every row; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_kernel, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """For each class 0 and 1: mean, inverse of the Cholesky factor of its covariance, and log prior - log det / 2."""

    means: tuple
    inverses: tuple
    offsets: tuple

    def log_odds(self) -> Column:
        total = F.lit(self.offsets[1] - self.offsets[0])
        for sign, mean, inverse in ((-0.5, self.means[1], self.inverses[1]), (0.5, self.means[0], self.inverses[0])):
            for i, row in enumerate(inverse):
                z = sum(((F.col(STATISTICS[j]) - float(mean[j])) * float(row[j]) for j in range(i + 1)), F.lit(0.0))
                total = total + F.lit(sign) * z * z
        return total


def fit(stats: DataFrame, labels: DataFrame, *, shrink: float = 0.15, ridge: float = 1e-3) -> Discriminant | None:
    """Learns from all labelled rows that aren't held out. Null labels are skipped; a document that is labelled
    several times counts once if the labels agree and not at all if they don't. None where a class has no rows."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    known = known.where(~held_out(F.col("doc_id"))).select("doc_id", "y")
    n = len(STATISTICS)
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i in range(n) for j in range(i + 1)]
    sums = stats.join(known, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)), *products)
    rows = {r["y"]: r for r in sums.collect()}  # two rows
    if set(rows) != {0, 1}:
        return None
    counts = [rows[y]["n"] for y in (0, 1)]
    means = [np.array([rows[y][f"s{i}"] for i in range(n)]) / counts[y] for y in (0, 1)]
    covs = []
    for y in (0, 1):
        c = np.array([[rows[y][f"p{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]) / counts[y]
        covs.append(c - np.outer(means[y], means[y]))
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    inverses, offsets = [], []
    for y in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * covs[y] + shrink * pooled + ridge * np.diag(np.diag(pooled) + 1e-6))
        inverses.append(np.linalg.inv(factor))
        offsets.append(math.log(counts[y] / sum(counts)) - float(np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(map(tuple, means)), tuple(tuple(map(tuple, x)) for x in inverses), tuple(offsets))


def score(stats: DataFrame, model: Discriminant | None, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (probability of label 1; 0.5 where nothing could be learned), predicted; one row for
    each row of `stats`, whatever its id."""
    odds = F.lit(0.0) if model is None else F.greatest(F.lit(-700.0), F.least(F.lit(700.0), model.log_odds()))
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Discriminant | None, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score reaches the threshold; all rows without a model. The
    row travels with its text's statistics, so nothing is joined or shuffled."""
    if model is None:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("__row__"), F.col(text_col).alias("__text__"))
    good = statistics(rows, id_col="__row__", text_col="__text__").where(model.log_odds() >= math.log(threshold / (1 - threshold)))
    return good.select(*(F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns))
