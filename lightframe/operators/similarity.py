"""Exact similarity search and joins that skip cells of vectors by bounds.

Vectors lie in cells around centroids that are fitted on a bounded sample; every row is assigned. For a vector q and any x in a
cell with centroid c, q.x = q.c + q.(x - c) is at most q.c + |q| r, r being the cell's radius: a cell whose bound is below what
is asked for holds no answer, whatever the data. Nothing is lost; data without structure are only not pruned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.functions.vectors import dot
from lightframe.operators.graph import checkpointed, discarded
from lightframe.operators.skew import BLOCK_ROWS, with_facts

#: Rows from which centroids are fitted, at most.
SAMPLE_ROWS = 50_000
MOST_CELLS = 1024
#: Rows of a strip of cells, at most, that are held at once while others stream by.
CHUNK_ROWS = 16_384
#: Rows that stream by one strip in one task, about.
STREAM_ROWS = 32_768
#: Of these so many meet a strip at once.
PIECE_ROWS = 256
#: Bounds may be off by so much for rounding, relative to the norms.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


@dataclass(frozen=True)
class Cells:
    """Centroids; radii and numbers of rows once rows are assigned."""

    centroids: np.ndarray
    radius: np.ndarray | None = None
    rows: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, rounds: int = 6) -> Cells:
        c = np.unique(sample, axis=0)
        c = c[np.random.default_rng(7).permutation(len(c))[:k]]
        for _ in range(rounds):
            of = cls(c).nearest(sample)[0]
            n = np.bincount(of, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, of, sample)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return cls(c)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = ((self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T).argmin(axis=1)
        return of, np.sqrt(((x - self.centroids[of]) ** 2).sum(axis=1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each vector and cell the most that their product can be."""
        norms = np.sqrt((q**2).sum(axis=1))[:, None]
        return q @ self.centroids.T + norms * self.radius + SLACK * norms * (1 + self.radius + np.abs(self.centroids).max())


def _kept(df: DataFrame, key: str, emb: str) -> tuple[DataFrame, int, list]:
    """Rows with a vector of the usual length and no null or NaN, that length, and the sample."""
    rows = df.where(F.col(emb).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(emb).cast("array<double>").alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).collect()]
    dims = Counter(map(len, sample)).most_common(1)[0][0] if sample else 0
    return rows.where(F.size("v") == dims), dims, [v for v in sample if len(v) == dims]


def _assigned(rows: DataFrame, cells: Cells) -> DataFrame:
    """cell, dist, key, v."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            of, dist = cells.nearest(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(dist, pa.float64()), b.column(0), b.column(1)], ["cell", "dist", "key", "v"])

    return rows.mapInArrow(run, f"cell int, dist double, key {kind}, v array<double>")


def _measured(placed: DataFrame, cells: Cells) -> Cells:
    radius, rows = np.full(len(cells.centroids), -np.inf), np.zeros(len(cells.centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["cell"]], rows[r["cell"]] = r["r"], r["n"]
    return Cells(cells.centroids, np.where(rows > 0, radius, 0.0), rows)


def _in_cells(df: DataFrame, key: str, emb: str) -> tuple[DataFrame, Cells | None]:
    """A written table of rows with their cells, and the cells; None where no row has a vector."""
    rows, dims, sample = _kept(df, key, emb)
    if not dims:
        return rows.select(F.lit(0).alias("cell"), F.lit(0.0).alias("dist"), "key", "v").limit(0), None
    n = rows.count()
    cells = Cells.fit(np.array(sample), min(MOST_CELLS, max(1, round(n**0.5))))
    placed = checkpointed(_assigned(rows, cells))
    return placed, _measured(placed, cells)


def probes(placed: DataFrame, cells: Cells, least: float) -> DataFrame:
    """(cell, key, v): each row beside each cell that may hold a vector whose product with it is `least` or more."""
    kind = placed.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            bounds = np.where(cells.rows > 0, cells.bounds(_matrix(b.column(1))), -np.inf)
            at, cell = np.nonzero(bounds >= least)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(at), b.column(1).take(at)], ["cell", "key", "v"])

    return placed.select("key", "v").mapInArrow(run, f"cell int, key {kind}, v array<double>")


def _strips(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Cells with rows in the order of strips, and for each strip the place in this order where its cells begin. A strip is some cells
    that lie near one another, of CHUNK_ROWS rows or less, or a part of one large cell, which then has several strips."""
    middle = cells.centroids - cells.centroids.mean(axis=0)
    axis = np.linalg.eigh(middle.T @ middle)[1][:, -1]
    order = np.argsort(middle @ axis, kind="stable")
    order = order[cells.rows[order] > 0]
    begins, held = [], CHUNK_ROWS + 1
    for place, n in enumerate(cells.rows[order].tolist()):
        parts = -(-n // CHUNK_ROWS)
        if parts > 1 or held + n > CHUNK_ROWS:
            begins.extend([place] * parts)
            held = 0
        held += n
    return order, np.array(begins)


def _asked(placed: DataFrame, cells: Cells, least: float, order: np.ndarray, begins: np.ndarray) -> DataFrame:
    """(strip, key, v): each row beside each strip with a cell that may hold a vector whose product with it is `least` or more. Rows
    go out strip by strip, so that a batch never holds more rows than came in."""
    kind = placed.schema["key"].dataType.simpleString()
    starts, of = np.unique(begins, return_inverse=True)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            may = np.logical_or.reduceat(cells.bounds(_matrix(b.column(1)))[:, order] >= least, starts, axis=1)
            for strip, group in enumerate(of.tolist()):
                at = np.flatnonzero(may[:, group])
                if len(at):
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), strip, np.int32)), b.column(0).take(at), b.column(1).take(at)], ["strip", "key", "v"])

    return placed.select("key", "v").mapInArrow(run, f"strip int, key {kind}, v array<double>")


def _met(placed: DataFrame, cells: Cells, least: float, best: bool) -> DataFrame:
    """(a, b, score) of rows a and the rows b of a strip (see `_strips`): with `best`, each a's best b over `least`; else all pairs
    a < b of at least `least`. A strip is held, the rows that may meet it stream by, so a row is copied once a strip and not
    once a cell."""
    kind = placed.schema["key"].dataType.simpleString()
    streams = max(1, -(-int(cells.rows.sum()) // STREAM_ROWS))
    spark = placed.sparkSession
    order, begins = _strips(cells)
    first = np.searchsorted(begins, np.arange(len(order)), side="right") - 1
    parts = np.maximum(1, -(-cells.rows[order] // CHUNK_ROWS))
    where = [(int(c), int(f - n + 1), int(n)) for c, f, n in zip(order, first, parts, strict=True)]
    where = F.broadcast(spark.createDataFrame(where, "cell int, __first int, __parts int"))  # a row a cell
    own = (F.col("__first") + F.pmod(F.xxhash64("key"), "__parts")).cast("int").alias("strip")
    home = placed.join(where, "cell").select(own, F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"), F.lit(0).alias("side"), "key", "v")
    ask = _asked(placed, cells, least, order, begins).select("strip", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(streams)).cast("int").alias("stream"), F.lit(1).alias("side"), "key", "v")
    dealt = home.unionByName(ask).repartition("strip", "stream").sortWithinPartitions("strip", "stream", "side", "key")

    def run(batches):
        unit, keys, mats, held, names = None, [], [], None, None
        for b in batches:
            where = np.stack([np.asarray(b.column(i)) for i in range(3)], axis=1) if b.num_rows else np.empty((0, 3), np.int64)
            edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for start, stop in zip(edges, edges[1:], strict=False):
                *this, side = where[start].tolist()
                part = b.slice(start, stop - start)
                if this != unit:
                    unit, keys, mats, held = this, [], [], None
                x, k = _matrix(part.column(4)), part.column(3).to_numpy(zero_copy_only=False)
                if side == 0:
                    keys.append(k)
                    mats.append(x)
                    continue
                if held is None:
                    held, names = np.vstack(mats), np.concatenate(keys)  # in order of key
                    mats, keys = [], []
                for piece in range(0, len(x), PIECE_ROWS):
                    made = _of_piece(x[piece : piece + PIECE_ROWS], k[piece : piece + PIECE_ROWS], held, names, least, best)
                    if len(made[0]):
                        kind = b.schema.field(3).type
                        yield pa.RecordBatch.from_arrays([pa.array(made[0], kind), pa.array(made[1], kind), pa.array(made[2], pa.float64())], ["a", "b", "score"])

    return dealt.mapInArrow(run, f"a {kind}, b {kind}, score double")


def _of_piece(x: np.ndarray, k: np.ndarray, held: np.ndarray, names: np.ndarray, least: float, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys a, keys b and products of rows (k, x) with held rows (names, in order)."""
    scores = x @ held.T
    if best:
        own = np.minimum(np.searchsorted(names, k), len(names) - 1)
        mine = np.flatnonzero(names[own] == k)
        scores[mine, own[mine]] = -np.inf
        at = scores.argmax(axis=1)  # of equals the lowest key
        top = scores[np.arange(len(x)), at]
        good = np.flatnonzero(top > least)
        return k[good], names[at[good]], top[good]
    i, j = np.nonzero(scores >= least)
    good = np.asarray(k[i] < names[j], bool)
    i, j = i[good], j[good]
    return k[i], names[j], scores[i, j]


def similar_pairs(df: DataFrame, *, least: float, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """All pairs (a, b, score), a < b, whose product is `least` or more. Keys are unique; rows without a key, or with a vector
    that has nulls or not the usual length, have no pairs."""
    placed, cells = _in_cells(df, key, emb)
    if cells is None:
        return placed.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("score"))
    return _met(placed, cells, least, best=False)


def best_mates(df: DataFrame, *, found: float, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """(a, b, score): each row's best mate over `found`, ties to the lowest key; rows without one are left out.

    Equal vectors take part once, under their lowest key, so a vector that very many rows repeat costs one row. What equal rows
    are to each other is their own square."""
    rows = df.where(F.col(key).isNotNull() & F.col(emb).isNotNull()).select(F.col(key).alias("key"), F.col(emb).cast("array<double>").alias("v"))
    rows = rows.withColumn("d", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",", "null").cast("binary"), 256))
    nodes = checkpointed(rows.groupBy("d").agg(F.min("key").alias("low"), F.count("*").alias("n"), F.first("v").alias("v")))
    placed, cells = _in_cells(nodes, "low", "v")
    if cells is None:
        return placed.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("score"))
    others = _met(placed, cells, found, best=True).groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("m"))).alias("x")).select(F.col("a").alias("low"), F.col("x.score").alias("s"), (-F.col("x.m")).alias("mate"))
    about = nodes.join(others, "low", "left").select("d", "n", "low", "s", "mate", dot(F.col("v"), F.col("v")).alias("own"))
    each = checkpointed(with_facts(rows.select("key", "d"), about.withColumn("more", F.col("n") > 1), "d", deal="key"))
    second = each.where("more and key != low").groupBy("d").agg(F.count("*").alias("n"), F.min("key").alias("second"))
    near = each.where("more").select("key", "d", "low", "s", "mate", "own")
    near = with_facts(near, second, "d", deal="key").withColumn("twin", F.when(F.col("key") == F.col("low"), F.col("second")).otherwise(F.col("low"))).drop("second")
    every = each.where("not more").select("key", "d", "low", "s", "mate", "own", F.lit(None).cast(rows.schema["key"].dataType).alias("twin")).unionByName(near)
    twin = F.when(F.col("twin").isNotNull() & (F.col("own") > found), F.struct(F.col("own").alias("score"), (-F.col("twin")).alias("m")))
    mate = F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("score"), (-F.col("mate")).alias("m")))
    return every.select(F.col("key").alias("a"), F.greatest(twin, mate).alias("x")).where("x is not null").select("a", (-F.col("x.m")).alias("b"), F.col("x.score").alias("score"))


@dataclass(frozen=True)
class VectorIndex:
    """A stored inverted file: rows (cell, key, code, scale, err, dist) sorted by cell, vectors beside them, and the cells."""

    path: str
    cells: Cells
    key_kind: str

    @classmethod
    def write(cls, df: DataFrame, path: str, *, key: str = "vec_id", emb: str = "embedding") -> VectorIndex:
        """Every row with a vector of the usual length is stored, as small integers with the norm of what rounding takes, and whole.
        A large cell spans files; a cell's rows lie together, so a search reads the row groups of its cells."""
        placed, cells = _in_cells(df, key, emb)
        if cells is None:
            raise ValueError("no vectors")
        kind = placed.schema["key"].dataType.simpleString()

        def run(batches):
            for b in batches:
                x = _matrix(b.column(3))
                scale = np.abs(x).max(axis=1) / 127
                scale[scale == 0] = 1.0
                code = np.floor(x / scale[:, None] + 0.5).astype(np.int8)
                err = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(err)], ["cell", "dist", "key", "v", "code", "scale", "err"])

        coded = placed.mapInArrow(run, f"cell int, dist double, key {kind}, v array<double>, code binary, scale double, err double")
        coded.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key").write.mode("overwrite").parquet(f"{path}/rows")
        spark = df.sparkSession
        meta = [(i, c.tolist(), float(r), int(n)) for i, (c, r, n) in enumerate(zip(cells.centroids, cells.radius, cells.rows, strict=True))]
        spark.createDataFrame(meta, "cell int, centroid array<double>, radius double, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        discarded(placed)
        return cls(path, cells, kind)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        meta = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # a row a cell
        kind = spark.read.parquet(f"{path}/rows").schema["key"].dataType.simpleString()
        return cls(path, Cells(np.array([r["centroid"] for r in meta]), np.array([r["radius"] for r in meta]), np.array([r["rows"] for r in meta])), kind)

    def _scan(self, spark: SparkSession, ids: list, q: np.ndarray, wanted: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
        """(query_id, key, cell, low, high): bounds of the products of queries with the rows of their `wanted` cells, read from codes
        alone; per batch and query the rows that may be among the `k` best."""
        cells = np.flatnonzero(wanted.any(axis=0))
        norms = np.sqrt((q**2).sum(axis=1))
        rows = spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(cells.tolist())).select("cell", "key", "code", "scale", "err")

        def run(batches):
            for b in batches:
                of = np.asarray(b.column(0))
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(b.num_rows, -1).astype(np.float64)
                scale, err = np.asarray(b.column(3)), np.asarray(b.column(4))
                for cell in np.unique(of):
                    asks, at = np.flatnonzero(wanted[:, cell]), np.flatnonzero(of == cell)
                    about = (q[asks] @ code[at].T) * scale[at]
                    slack = norms[asks][:, None] * (err[at] + SLACK)
                    low, high = about - slack, about + slack
                    bar = floor[asks]
                    if len(at) > k:  # the k-th best lower bound
                        bar = np.maximum(bar, np.partition(low, len(at) - k, axis=1)[:, len(at) - k])
                    i, j = np.nonzero(high >= bar[:, None])
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a in asks[i]], b.schema.field(1).type), b.column(1).take(pa.array(at[j])), pa.array(np.full(len(i), cell), pa.int32()), pa.array(low[i, j]), pa.array(high[i, j])], ["query_id", "key", "cell", "low", "high"])

        return rows.mapInArrow(run, f"query_id {self.key_kind}, key {self.key_kind}, cell int, low double, high double")

    def plan(self, q: np.ndarray, k: int, least: float) -> np.ndarray:
        """Cells that each query reads first: the nearest, until they hold `k` rows."""
        near = q @ self.cells.centroids.T
        order = np.argsort(-near, axis=1)
        held = np.cumsum(self.cells.rows[order], axis=1)
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, order, np.hstack((np.zeros((len(q), 1)), held[:, :-1])) < k, axis=1)
        return first & (self.cells.bounds(q) >= least) & (self.cells.rows > 0)

    def search(self, queries: DataFrame, *, k: int = 400, least: float = -1.0, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
        """(query_id, key, score): what `operators.vectors.search_all` finds. Queries go in blocks: the nearest cells give each a bar,
        then only cells whose bound reaches the bar are read; what codes can't rule out is scored by the whole vectors."""
        spark = queries.sparkSession
        parts = max(1, -(-2 * queries.count() // BLOCK_ROWS)) if queries.limit(BLOCK_ROWS + 1).count() > BLOCK_ROWS else 1
        out = None
        for p in range(parts):
            block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)
            asked = [r for r in block.select(F.col(key).alias("k"), F.col(emb).cast("array<double>").alias("v")).collect() if r["v"] is not None and len(r["v"]) == self.cells.centroids.shape[1] and None not in r["v"]]
            if not asked:
                continue
            ids, q = [r["k"] for r in asked], np.array([r["v"] for r in asked])
            floor, first = np.full(len(q), float(least)), self.plan(q, k, least)
            bounds = self.cells.bounds(q)
            found = checkpointed(self._scan(spark, ids, q, first, floor, k))
            # the k-th best lower bound of what was read, where it has as many
            ranked = F.row_number().over(_per_query().orderBy(F.col("low").desc()))
            place = {i: n for n, i in enumerate(ids)}
            for r in found.withColumn("r", ranked).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", "low").collect():  # a row a query
                floor[place[r["query_id"]]] = max(floor[place[r["query_id"]]], r["low"])
            more = (bounds >= floor[:, None]) & ~first & (self.cells.rows > 0)
            if more.any():
                found = found.unionByName(self._scan(spark, ids, q, more, floor, k))
            bars = F.broadcast(spark.createDataFrame(list(zip(ids, floor.tolist(), q.tolist(), strict=True)), f"query_id {self.key_kind}, bar double, q array<double>"))  # a block's queries
            left = found.join(bars, "query_id").where("high >= bar").select("query_id", "key", "cell", "q")
            whole = spark.read.parquet(f"{self.path}/rows").select("cell", "key", "v")
            scored = left.join(whole, ["cell", "key"]).select("query_id", "key", dot(F.col("v"), F.col("q")).alias("score")).where(F.col("score") >= least)
            best = F.row_number().over(_per_query().orderBy(F.col("score").desc(), "key"))
            mine = scored.withColumn("r", best).where(F.col("r") <= k).select("query_id", F.col("key").alias(key), "score")
            out = mine if out is None else out.unionByName(mine)
        return out if out is not None else spark.createDataFrame([], f"query_id {self.key_kind}, {key} {self.key_kind}, score double")


def _per_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id")
