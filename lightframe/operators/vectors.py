"""Vector search, labelling and clustering steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.functions.vectors import dot, normalised
from lightframe.operators.graph import checkpointed
from lightframe.operators.similarity import best_mates, similar_pairs
from lightframe.operators.skew import meet


def top_per_key(df: DataFrame, *by: str, k: int, order: list[Column]) -> DataFrame:
    """The first `k` rows of each key with their rank; plain row_number limits are pushed below the exchange by Spark."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def search(df: DataFrame, query: list[float], *, k: int = 400, least: float = -1.0, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """The `k` rows most like one vector: a projection and a bounded sort, no exchange of vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = df.select(key, dot(F.col(emb), q).alias("score")).where(F.col("score") >= least)
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def similar(df: DataFrame, queries: DataFrame, *, k: int = 60, least: float = 0.7, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """For each of a stated set of query rows the most similar other rows; the queries meet all rows in strips."""
    return search_all(df, queries, k=k, least=least, key=key, emb=emb, other=True)


#: Queries that are held at once while rows stream by, and rows that stream by them in one task, about.
QUERY_ROWS, STREAM_ROWS = 512, 131_072
#: Rows that meet the held queries at once, and products that are held before the best are kept.
PIECE_ROWS, HELD_SCORES = 1024, 1 << 20
#: Products by matrix may be off by so much for rounding, relative to the norms.
SLACK = 1e-9


def search_all(df: DataFrame, queries: DataFrame, *, k: int = 400, least: float = -1.0, key: str = "vec_id", emb: str = "embedding", other: bool = False) -> DataFrame:
    """`search` for each row of a stated set of query rows (with `other`, without the query's own row).

    Queries are dealt into strips; a task holds a strip, rows stream by, and each query keeps its best. Products by matrix rule
    out what can't be among them; what is left is summed in order, as `dot` does."""
    known = lambda x: x.where(F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull()))
    q = known(queries.select(F.col(key).alias("key"), F.col(emb).cast("array<double>").alias("v")))
    rows = known(df.select(F.col(key).alias("key"), F.col(emb).cast("array<double>").alias("v")))
    strips = max(1, -(-queries.count() // QUERY_ROWS))
    streams = max(1, -(-df.count() // STREAM_ROWS))
    deal = lambda i, n: F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = ["size", "strip", "stream"]
    home = q.select(F.size("v").alias("size"), deal(0, strips).alias("strip"), every(streams).alias("stream"), F.lit(0).alias("side"), "key", "v")
    come = rows.select(F.size("v").alias("size"), every(strips).alias("strip"), deal(1, streams).alias("stream"), F.lit(1).alias("side"), "key", "v")
    dealt = home.unionByName(come).repartition(*unit).sortWithinPartitions(*unit, "side", "key")
    kinds = queries.schema[key].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def run(batches):
        at, strip = None, None
        for b in batches:
            where = np.stack([np.asarray(b.column(i)) for i in range(4)], axis=1) if b.num_rows else np.empty((0, 4), np.int64)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for start, stop in zip(edges, edges[1:], strict=False):
                *this, side = where[start].tolist()
                part = b.slice(start, stop - start)
                if this != at:
                    if strip is not None:
                        yield from strip.best()
                    at, strip = this, _Strip(k, least, other)
                if side == 0:
                    strip.hold(part.column(4), part.column(5))
                else:
                    strip.meet(part.column(4), part.column(5))
        if strip is not None:
            yield from strip.best()

    found = dealt.mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    return top_per_key(found, "query_id", k=k, order=[F.col("score").desc(), F.col(key)]).select("query_id", key, "score")


class _Strip:
    """Some queries, and the best rows of those that came by, in order of key."""

    def __init__(self, k: int, least: float, other: bool):
        self.k, self.least, self.other = k, least, other
        self.ids, self.vectors, self.q, self.keys, self.seen = [], [], None, [], 0
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # query, row, score
        self.more, self.waiting = [], 0

    def hold(self, ids: pa.Array, vectors: pa.Array) -> None:
        self.ids.append(ids)
        self.vectors.append(_rows(vectors))

    def meet(self, keys: pa.Array, vectors: pa.Array) -> None:
        if not self.ids:
            return
        if self.q is None:
            self.q, self.id, self.vectors = np.vstack(self.vectors), pa.concat_arrays(self.ids), []
            self.norms, self.bar = np.sqrt((self.q**2).sum(axis=1)), np.full(len(self.q), float(self.least))
        rows = _rows(vectors)
        for x in range(0, len(rows), PIECE_ROWS):
            piece = rows[x : x + PIECE_ROWS]
            with np.errstate(invalid="ignore", over="ignore"):
                slack = SLACK * np.sqrt((piece**2).sum(axis=1))[:, None] * self.norms
                i, j = np.nonzero(~(piece @ self.q.T + slack < self.bar))
                score = np.zeros(len(i))
                for d in range(piece.shape[1]):
                    score += piece[i, d] * self.q[j, d]
            good = np.isnan(score) | (score >= self.least)  # NaN is over every number, as in SQL
            if self.other:
                differ = pc.not_equal(keys.slice(x, PIECE_ROWS).take(pa.array(i)), self.id.take(pa.array(j)))
                good &= np.asarray(pc.fill_null(differ, False))
            i, j, score = i[good], j[good], score[good]
            # keys of found rows alone are kept
            used, place = np.unique(i, return_inverse=True)
            self.keys.append(keys.slice(x, PIECE_ROWS).take(pa.array(used)))
            self.more.append((j, self.seen + place, score))
            self.seen += len(used)
            self.waiting += len(score)
            if self.waiting > max(HELD_SCORES, len(self.found[0])):
                self._keep()

    def _keep(self) -> None:
        query, row, score = (np.concatenate(c) for c in zip(self.found, *self.more, strict=True))
        order = np.lexsort((row, -score, ~np.isnan(score), query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.bar[query[last]] = np.where(np.isnan(score[last]), np.inf, np.maximum(score[last], self.least))
        kept = rank < self.k
        used, row = np.unique(row[kept], return_inverse=True)
        self.keys = [pa.concat_arrays(self.keys).take(pa.array(used))]
        self.found, self.more, self.waiting, self.seen = [query[kept], row, score[kept]], [], 0, len(used)

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.more:
            self._keep()
        query, row, score = self.found
        for x in range(0, len(query), 10_000):
            part = slice(x, x + 10_000)
            yield pa.RecordBatch.from_arrays([self.id.take(pa.array(query[part])), self.keys[0].take(pa.array(row[part])), pa.array(score[part])], ["query_id", "key", "score"])


def _rows(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(vectors), -1) if len(values) else np.zeros((len(vectors), 0))


def centroids(df: DataFrame, by: str, *, emb: str = "embedding") -> DataFrame:
    """Sum of the members per dimension, to length one; n."""
    each = df.where(F.col(emb).isNotNull()).select(by, F.posexplode(emb).alias("i", "x"))
    sums = each.groupBy(by, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"), F.max("n").alias("n"))
    return whole.select(by, normalised(F.transform("v", lambda e: e["s"])).alias("centroid"), "n")


def running_mean(df: DataFrame, by: str, *, memory: int = 50, key: str = "vec_id", emb: str = "embedding", start: DataFrame | None = None) -> DataFrame:
    """Per group, members taken in order of key: the mean moves by (c * min(n, memory) + v), to length one; centroid, n. `start`
    (by, centroid, n) says where groups begin; others begin with their first member.

    Groups are streamed in order; what a task holds is one centroid and one batch."""
    kind = df.schema[by].dataType.simpleString()
    rows = df.where(F.col(by).isNotNull() & F.col(emb).isNotNull()).select(F.col(by).alias("g"), F.lit(1).alias("later"), F.col(key).alias("k"), F.col(emb).cast("array<double>").alias("v"), F.lit(1).cast("long").alias("n"))
    if start is not None:
        rows = rows.unionByName(start.select(F.col(by).alias("g"), F.lit(0).alias("later"), F.lit(None).cast(df.schema[key].dataType).alias("k"), F.col("centroid").cast("array<double>").alias("v"), F.col("n").cast("long").alias("n")))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = mean = None
        n = 0
        for pdf in frames:
            out = []
            for g, later, _, v, weight in pdf.itertuples(index=False, name=None):
                v = np.asarray(v, float)
                if g != at:
                    if at is not None:
                        out.append((at, mean, n))
                    at, mean, n = g, v, int(weight)
                else:
                    mean = mean * min(n, memory) + v
                    mean = mean / (np.linalg.norm(mean) or 1.0)
                    n += 1
            yield pd.DataFrame(out, columns=[by, "centroid", "n"])
        if at is not None:
            yield pd.DataFrame([(at, mean, n)], columns=[by, "centroid", "n"])

    dealt = rows.repartition("g").sortWithinPartitions("g", "later", "k")
    return dealt.mapInPandas(fold, f"{by} {kind}, centroid array<double>, n long")


def assign(df: DataFrame, centres: DataFrame, *, least: float = 0.55, key: str = "vec_id", emb: str = "embedding", centre: str = "label") -> DataFrame:
    """The best centre of each row if its cosine is over `least`; others are loose (null). Centres meet rows in blocks."""
    c = centres.select(F.col(centre).alias("__c"), F.col("centroid").alias("__v"))
    scored = meet(df.select(key, emb), c, "__c").select(key, "__c", dot(F.col(emb), F.col("__v")).alias("score"))
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("__c")).alias("m"))).alias("b"))
    return best.select(key, F.when(F.col("b.score") > least, -F.col("b.m")).alias("cluster"), F.col("b.score").alias("score"))


def loose_mates(loose: DataFrame, *, found: float = 0.62, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """Pairs (a, b, score), a < b, of unassigned rows that are each other's best mate, over `found`. Ties go to the lowest
    key. Rows meet only in cells that can hold a mate (see `similarity`)."""
    best = checkpointed(best_mates(loose, found=found, key=key, emb=emb))
    back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["a", "b"]).where("a < b").select("a", "b", "score")


def merge_suggestions(centres: DataFrame, refused: DataFrame, *, least: float = 0.40, k: int = 40) -> DataFrame:
    """Pairs of clusters that may be one: (id, named, n, centroid), named or bigger first. Pairs answered no, and pairs
    of two named ones, are left out; the best `k` by score."""
    kept = checkpointed(centres.select("id", "named", "n", "centroid"))
    a, b = (kept.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "named", "n"))) for x in "ab")
    near = similar_pairs(kept, least=least, key="id", emb="centroid").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "score")
    pairs = near.join(a, "id_a").join(b, "id_b").where(~(F.col("named_a") & F.col("named_b")))
    pairs = pairs.join(refused.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")), ["id_a", "id_b"], "left_anti")
    swap = (F.col("named_b") & ~F.col("named_a")) | ((F.col("named_a") == F.col("named_b")) & (F.col("n_b") > F.col("n_a")))
    out = pairs.select(F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("into"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("other"), F.round("score", 3).alias("score"))
    return out.orderBy(F.col("score").desc(), "into", "other").limit(k)


def zero_shot(df: DataFrame, prompts: DataFrame, *, scale: float = 100.0, least: float = 0.3, k: int = 3, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """Labels by prompts (category, emb): best cosine per category, softmax over categories, the top `k` over `least`."""
    p = prompts.select("category", F.col("emb").alias("__p"))
    best = meet(df.select(key, emb), p, "category").groupBy(key, "category").agg(F.max(dot(F.col(emb), F.col("__p"))).alias("s"))
    row = Window.partitionBy(key)
    e = F.exp((F.col("s") - F.max("s").over(row)) * scale)
    soft = best.withColumn("e", e).withColumn("score", F.col("e") / F.sum("e").over(row)).where(F.col("score") >= least)
    return top_per_key(soft, key, k=k, order=[F.col("score").desc(), F.col("category")]).select(key, "category", "score")


def bad_share(df: DataFrame, prompts: DataFrame, *, scale: float = 100.0, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """Softmax mass that falls on the prompts marked bad."""
    p = prompts.select("is_bad", F.col("emb").alias("__p"))
    s = meet(df.select(key, emb), p, "__p").select(key, "is_bad", dot(F.col(emb), F.col("__p")).alias("s"))
    top = F.max("s").over(Window.partitionBy(key))
    e = s.withColumn("e", F.exp((F.col("s") - top) * scale))
    return e.groupBy(key).agg((F.sum(F.when(F.col("is_bad"), F.col("e")).otherwise(0.0)) / F.sum("e")).alias("bad"))
