"""Incremental operators as Structured Streaming: moments, catalogue changes, likes, duplicates, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lightframe.functions.filters import hash_bits
from lightframe.functions.vectors import normalised
from lightframe.operators import vectors as X
from lightframe.operators.graph import checkpointed, components
from lightframe.operators.reconcile import reconcile, vanished_under
from lightframe.operators.similarity import similar_pairs


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, lo, lb, lp = (np.radians(x) for x in (*a, *b))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return float(2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(h))))


def live_segments(stream: DataFrame, by: str = "source_id", *, key: str = "asset_id", gap_hours: float = 4.0, near_minutes: float = 40.0, far_km: float = 3.0, day_gap_hours: float = 2.0) -> DataFrame:
    """The segmentation of `operators.sessions.segment` over a stream: by, key, seg, is_late.

    State per key: the last time, place, city, day and segment number. Rows older than the last one come out with
    is_late and the current segment; a batch run over the table puts them right. In order, both forms agree. Needs taken_at,
    lat, lon, city, day; rows without a time are dropped."""
    kind = stream.schema[by].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, lat, lon, city, day, seg = state.get if state.exists else (None, None, None, None, None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ms", key])  # of one key in one micro-batch, which the source's rate bounds
        for r in rows.itertuples(index=False):
            ms, here = int(r.ms), (None if pd.isna(r.lat) or pd.isna(r.lon) else (float(r.lat), float(r.lon)))
            if last is not None and ms < last:
                out.append((group[0], getattr(r, key), seg, True))
                continue
            town = r.city if isinstance(r.city, str) else None
            gap = None if last is None else ms - last
            far = here is not None and lat is not None and _km((lat, lon), here) > far_km
            other = town is not None and city is not None and town != city
            if gap is None or gap > gap_hours * 3_600_000 or (gap > near_minutes * 60_000 and (far or other)) or (r.day != day and gap > day_gap_hours * 3_600_000):
                seg += 1
            last, city, day = ms, town, r.day
            if here is not None:
                lat, lon = here
            out.append((group[0], getattr(r, key), seg, False))
        state.update((last, lat, lon, city, day, seg))
        yield pd.DataFrame(out, columns=[by, key, "seg", "is_late"])

    rows = stream.where("taken_at is not null").select(by, key, F.unix_millis("taken_at").alias("ms"), "lat", "lon", "city", "day")
    return rows.groupBy(by).applyInPandasWithState(
        run, f"{by} {kind}, {key} long, seg long, is_late boolean", "last long, lat double, lon double, city string, day string, seg long", "append", GroupStateTimeout.NoTimeout
    )


def change_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for change feeds (path, size, mtime, gone, seq): the last event of a path wins, a vanished
    folder takes every path below it, and the resulting actions go to `write`. `read` gives the catalogue (path, size,
    mtime, is_missing). A batch that runs again gives the same actions."""

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "gone"), "seq").alias("e")).select("path", "e.*").persist()
        catalogue = read()
        below = vanished_under(catalogue, last.where("gone").select(F.col("path").alias("folder")))
        touched = last.select("path").union(below).distinct()
        there = last.where("not gone").select("path", "size", "mtime")
        known = catalogue.join(touched, "path", "left_semi")
        write(reconcile(known, there).where("action != 'unchanged'"))
        last.unpersist()

    return apply


def staged(rows: DataFrame, stage: str, work: Callable[[DataFrame], DataFrame], *, need: str | None = None, version: int = 1, key: str = "asset_id") -> DataFrame:
    """One incremental stage: rows that are to do (state 0, or done or failed by an older version) whose prerequisite is
    done go through `work`, which returns key and ok; state becomes 1 or 2, and rows that `work` loses stay to do."""
    due = (F.col(stage) == 0) | (F.coalesce(F.col(f"{stage}_version"), F.lit(0)) < version)
    if need:
        due = due & (F.col(need) == 1)
    done = work(rows.where(due)).select(F.col(key).alias("__k"), F.col("ok").alias("__ok"))
    j = rows.join(done, rows[key] == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    return j.withColumns({stage: F.when(hit, F.when(F.col("__ok"), 1).otherwise(2)).otherwise(F.col(stage)), f"{stage}_version": F.when(hit, version).otherwise(F.col(f"{stage}_version"))}).drop("__k", "__ok")


def live_likes(toggles: DataFrame, *by: str) -> DataFrame:
    """Parity of toggles per member, as a running aggregate (update or complete mode)."""
    member = F.coalesce(F.col("member_id").cast("string"), F.concat(F.lit("name:"), F.lower("author")))
    return toggles.groupBy(*by, member.alias("member")).agg((F.count("*") % 2 == 1).alias("liked"))


def live_exact(stream: DataFrame, *, digest: str = "qhash", at: str = "taken_at", delay: str = "1 day") -> DataFrame:
    """First arrivals of each digest within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([digest])


def live_near(stream: DataFrame, known: DataFrame, *, bits: int = 3, key: str = "asset_id") -> DataFrame:
    """Arrivals that a known row resembles, each pair once: a stream-static join on parts of the hash.

    Of five parts of a hash two are equal where at most three bits differ, so rows meet by pairs of parts (about 26 bits), not by
    one band of 16. With more `bits`, pairs are those that share one of the four bands."""
    near = bits <= 3
    edges = [0, 13, 26, 39, 52, 64] if near else [0, 16, 32, 48, 64]
    part = lambda c, i: F.shiftrightunsigned(c, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long"))
    n = len(edges) - 1
    ways = [(i, j) for i in range(n) for j in range(i + 1, n)] if near else [(i,) for i in range(n)]

    def way(c: Column, w: int) -> Column:
        out = F.lit(w).cast("long")
        for i in ways[w]:
            out = F.shiftleft(out, 16).bitwiseOR(part(c, i))
        return out

    met = lambda c: F.explode(F.array(*(way(F.col(c), w) for w in range(len(ways)))))
    k = known.select(F.col(key).alias("known_id"), hash_bits(F.col("phash")).alias("__h")).where("__h is not null").select("known_id", "__h", met("__h").alias("__b"))
    new = stream.select(key, hash_bits(F.col("phash")).alias("__n")).where("__n is not null").select(key, "__n", met("__n").alias("__b"))
    close = F.bit_count(F.col("__n").bitwiseXOR(F.col("__h"))) <= bits
    first = F.coalesce(*(F.when(way(F.col("__n"), w) == way(F.col("__h"), w), way(F.col("__n"), w)) for w in range(len(ways)))) == F.col("__b")
    return new.join(k, "__b").where(close & first).select(key, "known_id")


#: At most so many unassigned vectors are held.
LOOSE_POOL = 40_000


def cluster_batch(batch: DataFrame, clusters: DataFrame, loose: DataFrame, *, join: float = 0.55, found: float = 0.62, merge: float = 0.72, least_quality: float = 0.3, memory: int = 50, pool: int = LOOSE_POOL) -> tuple[DataFrame, DataFrame]:
    """One micro-batch of clustering: (clusters, loose) after it. Clusters have id, centroid, n and, where they have one, name.

    Vectors (id, emb of length one, quality) over `join` to the best centroid of the snapshot join it; its centroid moves
    by a running mean that remembers `memory` members at most, in order of id. Of all that is left, in the batch and the
    pool, pairs that are each other's best mate over `found` make clusters, named by their lower id. Then clusters over `merge`
    of each other become one, unless both have names. Only what is still loose is trimmed to the newest `pool`, as the
    feature has it. Vectors under `least_quality` never join and are not held. Unlike one-by-one clustering, all of a batch
    meets the snapshot."""
    name = F.col("name") if "name" in clusters.columns else F.lit(None).cast("string")
    known = checkpointed(clusters.select("id", F.col("centroid").cast("array<double>").alias("centroid"), F.col("n").cast("long").alias("n"), name.alias("name")))
    given = batch.where(F.col("quality") >= least_quality).select("id", F.col("emb").cast("array<double>").alias("emb"), F.col("quality").cast("double").alias("quality"))
    if known.limit(1).count():
        best = X.assign(given, known, least=join, key="id", emb="emb", centre="id").select("id", "cluster")
        given = checkpointed(given.join(best, "id"))
    else:
        given = checkpointed(given.withColumn("cluster", F.lit(None).cast("long")))
    hit = given.where("cluster is not null")
    touched = known.join(hit.select(F.col("cluster").alias("id")).distinct(), "id", "left_semi")
    moved = X.running_mean(hit.select(F.col("cluster").alias("id"), F.col("id").alias("key"), "emb"), "id", memory=memory, key="key", emb="emb", start=touched).join(known.select("id", "name"), "id")
    kept = known.join(touched.select("id"), "id", "left_anti").unionByName(moved.select("id", "centroid", "n", "name"))

    free = checkpointed(given.where("cluster is null").select("id", "emb", "quality").unionByName(loose.where(F.col("quality") >= least_quality).select("id", F.col("emb").cast("array<double>").alias("emb"), F.col("quality").cast("double").alias("quality"))))
    pairs = checkpointed(X.loose_mates(free, found=found, key="id", emb="emb"))
    a, b = (free.select(F.col("id").alias(x), F.col("emb").alias(f"emb_{x}")) for x in "ab")
    made = pairs.join(a, "a").join(b, "b").select(F.col("a").alias("id"), normalised(F.zip_with("emb_a", "emb_b", lambda x, y: x + y)).alias("centroid"), F.lit(2).cast("long").alias("n"), F.lit(None).cast("string").alias("name"))
    rest = free.join(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_anti").orderBy(F.col("id").desc()).limit(pool)
    return merged_clusters(kept.unionByName(made), least=merge), rest


def merged_clusters(clusters: DataFrame, *, least: float = 0.72) -> DataFrame:
    """Clusters (id, centroid, n, name) over `least` of each other become one: components over pairs with an unnamed end. It gets the
    lowest id, the mean by members and, of the names, the one of most members."""
    c = checkpointed(clusters)
    x, y = (c.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}")) for s in "ab")
    near = similar_pairs(c, least=least, key="id", emb="centroid").join(x, "a").join(y, "b")
    edges = near.where(F.col("name_a").isNull() | F.col("name_b").isNull()).select("a", "b")
    of = c.join(components(edges), F.col("id") == F.col("node"), "left").withColumn("into", F.coalesce("component", "id"))
    sums = of.select("into", "n", F.posexplode("centroid").alias("i", "x")).groupBy("into", "i").agg(F.sum(F.col("x") * F.col("n")).alias("s"))
    mean = sums.groupBy("into").agg(normalised(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"])).alias("centroid"))  # one row a dimension
    return of.groupBy("into").agg(F.sum("n").alias("n"), F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("n", (-F.col("id")).alias("k")))).alias("name")).join(mean, "into").select(F.col("into").alias("id"), "centroid", "n", "name")
