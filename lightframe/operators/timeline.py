"""Filtered, ordered timelines: pages, ranks, facets and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.functions.filters import presets, visible, year_range
from lightframe.operators.graph import checkpointed
from lightframe.operators.ordered import PART, rank_within, ranged, running_sum


def with_membership(df: DataFrame, members: DataFrame, on: str, flag: str) -> DataFrame:
    """Adds a boolean: whether the row's key is in `members`."""
    keys = members.select(F.col(on).alias("__k")).where("__k is not null").distinct().withColumn("__m", F.lit(True))
    return df.join(keys, df[on] == F.col("__k"), "left").withColumn(flag, F.coalesce("__m", F.lit(False))).drop("__k", "__m")


def timeline(df: DataFrame, *, preset: str = "all", kind: str | None = None, year: int | None = None, place: str | None = None, album: DataFrame | None = None, person: DataFrame | None = None, category: DataFrame | None = None, key: str = "asset_id") -> DataFrame:
    """A conjunction of filters; album, person and category are frames of member keys. `place` is a city or country."""
    out = df.where(presets()[preset])
    if kind in ("photo", "video"):
        out = out.where(F.col("kind") == kind)
    if year is not None:
        out = out.where(year_range(year))
    if place is not None:
        out = out.where((F.col("city") == place) | (F.col("country") == place))
    for members in (album, person, category):
        if members is not None:
            out = out.join(members.select(key).distinct(), key, "left_semi")
    return out


def newest(day: str = "day", at: str = "taken_at", key: str = "asset_id") -> list[Column]:
    return [F.col(day).desc(), F.col(at).desc(), F.col(key).desc()]


def page(df: DataFrame, offset: int, limit: int, *, day: str = "day", at: str = "taken_at", key: str = "asset_id") -> DataFrame:
    """Rows offset..offset+limit of the timeline. Days before and after the page are ruled out first by prefix sums over
    the small day buckets, so that only the days the page touches are sorted."""
    limit = max(1, min(1000, limit))
    b = bucket_offsets(day_buckets(df, day=day), day=day).where((F.col("offset") < offset + limit) & (F.col("offset") + F.col("n") > offset))
    lead = b.agg(F.min("offset").alias("lead"))
    rows = df.join(b.select(day), day, "left_semi")
    first = lead.first()["lead"]
    if first is None:
        return rows.limit(0)
    return rows.orderBy(*newest(day, at, key)).offset(max(0, offset - first)).limit(limit)


def moment_page(rows: DataFrame, moments: DataFrame, offset: int, limit: int, *by: str, at: str = "taken_at", key: str = "asset_id") -> DataFrame:
    """Rows offset..offset+limit in the order of moments (the latest start first, by milliseconds), in order of time within
    each. Prefix sums over the moments rule out all but those that the page touches."""
    limit = max(1, min(1000, limit))
    latest = [F.unix_millis("start_at").desc(), *(F.col(c).desc() for c in (*by, "seg"))]
    counted = running_sum(ranged(moments.select(*by, "seg", "start_at", "n"), *latest), [], latest, F.col("n"), "__end").drop(PART)
    touched = checkpointed(counted.where((F.col("__end") > offset) & (F.col("__end") - F.col("n") < offset + limit)))
    lead = touched.agg(F.min(F.col("__end") - F.col("n")).alias("lead")).first()["lead"]
    if lead is None:
        return rows.limit(0)
    page = rows.join(F.broadcast(touched.select(*by, "seg", "start_at")), [*by, "seg"])  # at most `limit` moments
    return page.orderBy(*latest, at, key).offset(max(0, offset - lead)).limit(limit).drop("start_at")


def day_buckets(df: DataFrame, *, day: str = "day") -> DataFrame:
    return df.groupBy(day).agg(F.count("*").alias("n"))


def bucket_offsets(buckets: DataFrame, *, day: str = "day") -> DataFrame:
    """Adds the number of rows in newer buckets. Buckets are days: a window over them is small."""
    w = Window.orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def month_buckets(buckets: DataFrame, *, day: str = "day", length: int = 7) -> DataFrame:
    """Days joined to months (length 7) or years (4), each with its first offset."""
    return bucket_offsets(buckets, day=day).groupBy(F.substring(day, 1, length).alias("bucket")).agg(F.sum("n").alias("n"), F.min("offset").alias("offset"))


def index_of(df: DataFrame, target: DataFrame, *, day: str = "day", at: str = "taken_at", key: str = "asset_id") -> DataFrame:
    """The rank of one row (`target`: its day, time and key): how many come before it."""
    t = target.select(F.col(day).alias("__d"), F.col(at).alias("__t"), F.col(key).alias("__k"))
    before = (F.col(day) > F.col("__d")) | ((F.col(day) == F.col("__d")) & ((F.col(at) > F.col("__t")) | ((F.col(at) == F.col("__t")) & (F.col(key) > F.col("__k")))))
    return df.join(F.broadcast(t.limit(1)), before, "inner").agg(F.count("*").alias("rank"))


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Numbers all rows from 1 in the given order without gathering them: a range exchange, a rank within each range and
    the counts of the ranges before."""
    return rank_within(df, [], order, name)


def counters(df: DataFrame) -> DataFrame:
    """All counters of the library in one pass; videos are all that aren't photos."""
    v = visible()
    c = lambda cond, name: F.count_if(cond).alias(name)
    return df.agg(
        c(v, "n_all"), c(v & (F.col("kind") == "photo"), "photos"), c(v & (F.col("kind") != "photo"), "videos"), c(v & F.col("is_live"), "live"), c(v & F.col("is_screenshot"), "screenshots"),
        c(v & F.col("favorite"), "favorites"), c(v & F.col("is_raw"), "raw"), c(v & F.col("is_hdr"), "hdr"), c(presets()["trash"], "trash"),
    )


def selection_summary(df: DataFrame, ids: DataFrame, *, key: str = "asset_id") -> DataFrame:
    chosen = df.join(ids.select(key).distinct(), key, "left_semi")
    return chosen.agg(F.count_if(F.col("kind") == "photo").alias("photos"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if("is_live").alias("live"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def album_stats(members: DataFrame, df: DataFrame, *, album: str = "album_id", key: str = "asset_id", at: str = "taken_at") -> DataFrame:
    """Per album: visible members and the newest of them as cover; one membership join for all albums."""
    rows = members.select(album, key).distinct().join(df.where(visible()).select(key, "day", at), key)
    return rows.groupBy(album).agg(F.count("*").alias("n"), F.max_by(key, F.struct("day", at, key)).alias("cover_id"))


def place_facet(df: DataFrame) -> DataFrame:
    rows = df.where(visible() & F.col("city").isNotNull())
    return rows.groupBy("city").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("asset_id").alias("cover_id"), F.min("country").alias("country"))


def people_facet(faces: DataFrame, df: DataFrame, *, least: int = 2, key: str = "asset_id") -> DataFrame:
    """Distinct photos per person over faces that aren't hidden and assets that aren't trashed or missing."""
    rows = faces.where(~F.col("face_hidden")).join(df.where("not trashed and not missing").select(key), key)
    return rows.groupBy("person_id").agg(F.countDistinct(key).alias("n")).where(F.col("n") >= least)


def home_city(df: DataFrame, *by: str) -> DataFrame:
    """The city with most rows (hidden and missing ones left out, trashed ones counted); ties go to the greater name."""
    n = df.where("not hidden and not missing and city is not null").groupBy(*by, "city").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by("city", F.struct("n", "city")).alias("home"))


def tiles(df: DataFrame, versions: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """Display rows with defaults; `versions` has a row (version_of) for each child."""
    counts = versions.groupBy(F.col("version_of").alias(key)).agg(F.count("*").alias("versions"))
    return df.join(counts, key, "left").select(
        key, F.coalesce("ratio", F.lit(1.0)).alias("ratio"), F.coalesce("focal_x", F.lit(0.5)).alias("fx"), F.coalesce("focal_y", F.lit(0.5)).alias("fy"), F.col("edit").isNotNull().alias("edited"),
        F.coalesce("versions", F.lit(0)).cast("long").alias("versions"), F.concat(F.coalesce(F.substring("qhash", 1, 10), F.lit("x")), F.col("thumb_v").cast("string")).alias("tile_key"),
    )


def by_ranked_ids(df: DataFrame, ranked: DataFrame, *, pos: str = "pos", key: str = "asset_id") -> DataFrame:
    """Rows for an explicit list of ids, given as rows (pos, key), with their position; ids that aren't there leave gaps."""
    return ranked.select(pos, key).join(df, key)


def map_cells(df: DataFrame, *, zoom: int, tile: int = 256, radius: int = 56) -> DataFrame:
    """Located visible rows by Web-Mercator cell at a zoom: count and the cover of the highest rank."""
    side = 2.0**zoom * tile / radius
    lat = F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), F.col("lat"))))
    x = F.floor((F.col("lon") + 180) / 360 * side)
    y = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * side)
    rank = (F.round(1000 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("quality", F.lit(0.0))))).cast("long") + 1000 * F.col("favorite").cast("long") + (F.col("kind") == "photo").cast("long")) * 10_000_000_000 + F.col("asset_id")
    rows = df.where(visible() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.select(x.alias("cell_x"), y.alias("cell_y"), rank.alias("rank"), "asset_id").groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.max_by("asset_id", "rank").alias("cover_id"))
