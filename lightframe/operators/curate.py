"""Curation: candidates, shortlists and diverse choices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.functions.filters import visible
from lightframe.operators.graph import checkpointed
from lightframe.operators.ordered import PART, laid_out, rank_within, running_sum, with_previous


def candidates(df: DataFrame, labels: DataFrame, faces: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """Visible photos that are no screenshots or documents and have a camera or an identified face."""
    barred = labels.where(F.col("label").isin("document", "screenshot")).select(key).distinct()
    people = faces.where("person_id is not null").groupBy(key).agg(F.count("*").alias("faces"))
    rows = df.where(visible() & (F.col("kind") == "photo") & ~F.col("is_screenshot")).join(barred, key, "left_anti").join(people, key, "left")
    return rows.where(F.col("model").isNotNull() | (F.col("faces") >= 1)).withColumns({"faces": F.coalesce("faces", F.lit(0)), "quality": F.coalesce("quality", F.lit(0.4))})


def slideshow_items(df: DataFrame, *, least_seconds: float = 2.0) -> DataFrame:
    rows = df.where(visible() & ~F.col("is_screenshot") & ((F.col("kind") == "photo") | (F.col("duration") >= least_seconds)))
    return rows.withColumn("score", F.when(F.col("kind") == "video", F.col("quality") - 0.05).otherwise(F.col("quality")))


def shortlist(df: DataFrame, *by: str, pick: int | str, score: str = "quality", at: str = "taken_at", key: str = "asset_id") -> DataFrame:
    """Bounds each group to about cap = max(200, 12 pick) rows: the pool is cut by time into 4 pick slices of equal count
    and the best of each stay. Smaller pools stay whole. Ranks come without gathering a group. Groups aren't null. `pick` may be a column, the same throughout a group."""
    wanted = F.lit(pick) if isinstance(pick, int) else F.col(pick)
    cap, slices = F.greatest(F.lit(200), 12 * wanted), 4 * wanted
    each = F.ceil(cap / slices)
    most = -(-max(200, 12 * pick) // (4 * pick)) if isinstance(pick, int) else 50  # 50 for one pick, less for more
    by = list(by)
    ranked = rank_within(df, by, [at, key], "__r")
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = ranked.join(sizes, by).withColumn("__s", F.ceil(F.col("__r") * slices / F.col("__n")) - 1)
    best = F.row_number().over(Window.partitionBy(*by, "__s").orderBy(F.col(score).desc(), F.col(key)))
    # the rank's limit stands alone, so that Spark takes each task's best rows before it exchanges them
    large = rows.where(F.col("__n") > cap).withColumn("__b", best).where(F.col("__b") <= most).where(F.col("__b") <= each).drop("__b")
    return rows.where(F.col("__n") <= cap).unionByName(large).drop("__n", "__r", "__s")


def diverse(df: DataFrame, by: str, *, pick: int | str, spread_minutes: float = 20.0, weight: float = 0.7, key: str = "asset_id") -> DataFrame:
    """Greedy choice of `pick` rows a group that balances worth and likeness; groups must be bounded (see `shortlist`).

    Needs key, taken_at, quality, favorite, faces, emb (array or null), phash (hex or null). Rows too like a chosen one
    (cosine over 0.93, or at most 8 different hash bits) are dropped; ties go to the lowest key; output by time. `pick` may
    be a column, the same throughout a group."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {key} long, taken_at timestamp, pick_order int"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key], kind="stable").reset_index(drop=True)
        n = len(pdf)
        wanted = pick if isinstance(pick, int) else int(pdf[pick].iloc[0])
        at = pdf["taken_at"].astype("datetime64[ns]").astype("int64").to_numpy() / 6e10
        has = pdf["emb"].notna().to_numpy()
        base = 0.7 * pdf["quality"].to_numpy(float) + 0.35 * pdf["favorite"].to_numpy(float) + np.minimum(0.25, 0.1 * pdf["faces"].to_numpy(float)) - 0.05 * ~has
        emb = np.zeros((n, max((len(e) for e in pdf["emb"][has]), default=1)))
        for i in np.flatnonzero(has):
            emb[i] = pdf["emb"].iloc[i]
        seen = np.array([isinstance(h, str) for h in pdf["phash"]])
        bits = np.array([int(h, 16) if isinstance(h, str) else 0 for h in pdf["phash"]], np.uint64)
        like, near = np.zeros(n), np.zeros(n)
        alive, chosen = np.ones(n, bool), []
        while alive.any() and len(chosen) < wanted:
            value = np.where(alive, weight * base - (1 - weight) * (like + 0.6 * near), -np.inf)
            i = int(value.argmax())
            chosen.append(i)
            alive[i] = False
            vectors = has & has[i]
            hashes = ~vectors & seen & seen[i]
            c, h = emb @ emb[i], np.bitwise_count(bits ^ bits[i])
            alive &= ~((vectors & (c > 0.93)) | (hashes & (h <= 8)))
            like = np.maximum(like, np.where(vectors, np.maximum(0.0, (c - 0.5) / 0.5), np.where(hashes, np.maximum(0.0, 1 - h / 24), 0.0)))
            near = np.maximum(near, np.maximum(0.0, 1 - np.abs(at - at[i]) / spread_minutes))
        out = pdf.iloc[chosen][[by, key, "taken_at"]].copy()
        out["pick_order"] = np.arange(len(chosen), dtype="int32")
        return out.sort_values(["taken_at", key])

    def each(frames):
        """One group after another; a group may span batches."""
        held: list[pd.DataFrame] = []
        for pdf in frames:
            if not len(pdf):
                continue
            name, before = pdf[by], pdf[by].shift()
            edges = [*np.flatnonzero((name.ne(before) & ~(name.isna() & before.isna())).to_numpy()).tolist(), len(pdf)]
            edges[0] = 0
            first = held[0][by].iloc[0] if held else None
            if held and name.iloc[0] != first and not (pd.isna(name.iloc[0]) and pd.isna(first)):
                yield choose(pd.concat(held))
                held = []
            for start, stop in zip(edges, edges[1:], strict=False):
                held.append(pdf.iloc[start:stop])
                if stop < len(pdf):
                    yield choose(pd.concat(held))
                    held = []
        if held:
            yield choose(pd.concat(held))

    rows = df.select(by, key, "taken_at", "quality", "favorite", "faces", "emb", "phash", *([] if isinstance(pick, int) else [pick]))
    return rows.repartition(by).sortWithinPartitions(by, key).mapInPandas(each, schema)


def year_quota(df: DataFrame, target: int, *by: str, day: str = "day") -> DataFrame:
    """Rows wanted of each year: its share of the target, one at least."""
    n = df.groupBy(*by, F.substring(day, 1, 4).alias("year")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(whole) * target
    return n.withColumn("quota", F.greatest(F.lit(1), F.floor(share + 0.5)).cast("long"))


def sampled_by_year(df: DataFrame, by: str, target: int, *, key: str = "asset_id", spread_minutes: float = 45.0, top_up_minutes: float = 5.0) -> DataFrame:
    """About `target` diverse rows of each group: of each year its quota, then, where these are too few, the most diverse of
    the rest. Years of few rows get one at least, so there may be a few more. Needs what `diverse` needs, and day."""
    keyed = df.withColumns({"__year": F.substring("day", 1, 4)}).withColumn("__key", F.concat_ws(":", F.col(by).cast("string"), "__year"))
    quota = year_quota(df, target, by).select(F.concat_ws(":", F.col(by).cast("string"), "year").alias("__key"), F.col("quota").cast("int").alias("__pick"))
    keyed = keyed.join(quota, "__key")
    first = checkpointed(diverse(shortlist(keyed, "__key", pick="__pick", key=key), "__key", pick="__pick", spread_minutes=spread_minutes, key=key).select(key))
    of = df.join(first, key, "left_semi")
    need = df.groupBy(by).agg(F.lit(0).alias("__z")).join(of.groupBy(by).agg(F.count("*").alias("__n")), by, "left").select(by, (target - F.coalesce("__n", F.lit(0))).cast("int").alias("__pick")).where("__pick > 0")
    rest = df.join(first, key, "left_anti").join(need, by)
    more = diverse(shortlist(rest, by, pick="__pick", key=key), by, pick="__pick", spread_minutes=top_up_minutes, key=key).select(key)
    return df.join(first.unionByName(more), key, "left_semi")


def capped_running(df: DataFrame, *by: str, item: Column, cap: Column, at: str = "taken_at", key: str = "asset_id") -> DataFrame:
    """At most `cap` of the rows that `item` marks, in time order, and a flag where the year changes."""
    by = list(by)
    parts, split = laid_out(df.withColumns({"__item": F.coalesce(item, F.lit(False)), "__cap": cap}), by, at, key)
    rows = running_sum(parts, by, [at, key], F.col("__item").cast("long"), "__i", split=split).where(~F.col("__item") | (F.col("__i") <= F.col("__cap"))).drop("__i", "__item", "__cap")
    year = F.substring("day", 1, 4)
    seen = with_previous(rows, by, [at, key], split, __prev=(F.struct(year.alias("year")), False))
    return seen.withColumn("new_year", F.coalesce(year != F.col("__prev.year"), F.lit(True))).drop("__prev", PART)


def cover(df: DataFrame, *by: str, score: Column, key: str = "asset_id") -> DataFrame:
    """The row of the best score per group; ties go to the lowest key."""
    return df.groupBy(*by).agg(F.max_by(key, F.struct(score.alias("s"), (-F.col(key)).alias("k"))).alias("cover_id"))
