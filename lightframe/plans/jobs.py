"""Jobs that chain operators, as functions over any catalogue, and as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.functions import dates as D
from lightframe.functions import names as N
from lightframe.functions.filters import cleanup_classes, low_entropy, visible
from lightframe.functions.media import fingerprint
from lightframe.operators import curate as C
from lightframe.operators import dedup as U
from lightframe.operators import incremental as I
from lightframe.operators import reconcile as R
from lightframe.operators import sessions as S
from lightframe.operators import timeline as T
from lightframe.operators.geo import geocode
from lightframe.operators.graph import checkpointed, discarded
from lightframe.plans.q_timeline import measured
from lightframe.plans.registry import query
from lightframe.sources import export as X
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table

V = "NOT hidden AND NOT missing AND NOT trashed"


def cleanup(rows: DataFrame, ignored: DataFrame, made: DataFrame, catalogue: DataFrame, *, now: Column, gap_ms: int = 2500, sure_ms: int = 600, seconds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Duplicate groups (tab, group_id, n, signature, keep_id, reclaimable) of the tabs exact, brackets, visual and bursts, and
    rows of the suggestion classes (tab, asset_id, size).

    Frames of a bracket series are in no burst. Photos of one burst and format are no visual copies. Groups whose signature
    is in `ignored` (signature) are left out, and so are series that `made` (result, source) has a living result of. Favourites,
    album members and rows ignored as `item:<id>` are never suggested. `rows` are the visible rows of `catalogue`."""
    # what is read below, and no more, is written once: each row's score, classes and whether its hash tells something as well
    told = (F.col("kind") == "photo") & F.col("phash").isNotNull() & ~low_entropy(F.col("phash"))
    suggestible = F.when(~F.col("favorite") & ~F.col("in_album"), cleanup_classes(now))
    needed = ("asset_id", "taken_at", "qhash", "phash", "ext", "width", "height", "model", "exposure", "fnumber", "iso", "size")
    scores = [F.when(c, U.keep_score(kind)).alias(f"{kind}_score") for kind, c in (("exact", F.col("qhash").isNotNull()), ("visual", told), ("burst", told))]
    rows = checkpointed(rows.select(*needed, F.col("date_source").isin("mtime", "folder").alias("by_file"), F.coalesce(told, F.lit(False)).alias("told"), suggestible.alias("classes"), *scores))
    exact = U.groups(rows.where("qhash is not null"), "qhash", score=F.col("exact_score")).where("n > 1")
    photos = rows.where("told")
    timed = photos.where("not by_file")
    shots = timed.select("asset_id", "taken_at", "phash", "model", "exposure", "fnumber", "iso", "width")
    frames = checkpointed(S.bracket_series(S.bracket_islands(shots, gap_ms=gap_ms, same=("model", "fnumber", "iso", "width"), alone=False), sure_ms=sure_ms))
    series = frames.groupBy("series").agg(F.min("asset_id").alias("group_id"), F.count("*").alias("n"), U.signature("asset_id").alias("signature"), F.max(F.when(F.col("is_keeper"), F.col("asset_id"))).alias("keep_id"), F.lit(0).cast("long").alias("reclaimable"))
    single = timed.join(frames.select("asset_id"), "asset_id", "left_anti")
    bursts = checkpointed(U.burst_groups(single, seconds=seconds))
    burst = photos.join(bursts.select(F.col("node").alias("asset_id"), F.col("component").alias("burst")), "asset_id", "left")
    visual = photos.select("asset_id", "size", "visual_score").join(U.near_groups(burst, burst="burst"), "asset_id")
    tab = lambda df, name: df.select(F.lit(name).alias("tab"), "group_id", "n", "signature", "keep_id", "reclaimable")
    groups = tab(exact, "exact").unionByName(tab(U.without_fused(series, made, catalogue), "brackets")).unionByName(tab(U.groups(visual, "component", score=F.col("visual_score")), "visual"))
    groups = groups.unionByName(tab(U.groups(burst.where("burst is not null"), "burst", score=F.col("burst_score")), "bursts"))
    eligible = U.without_ignored_items(rows.where("size(classes) > 0").select("asset_id", "size", "classes"), ignored)
    return U.without_ignored(groups, ignored), eligible.select("asset_id", "size", F.explode("classes").alias("tab"))


def _cleanup_rows(spark, d) -> DataFrame:
    """The catalogue with all that the report looks at: copies and near copies by type and value, pairs of frames by time."""
    k, i = F.col("k"), F.col("asset_id")
    shown = F.concat_ws(":", "event_type", F.col("tenths").cast("string"))
    made = measured(spark, d).withColumn("tenths", F.floor(F.col("size") / 4_000_000)).withColumns({
        "phash": F.concat(F.substring(F.md5(shown.cast("binary")), 1, 15), (k % 2).cast("string")), "qhash": F.md5(F.concat_ws(":", shown, (k % 3).cast("string")).cast("binary")),
        "ext": F.when(i % 4 == 0, "heic").otherwise("jpg"), "width": F.lit(4000), "height": F.lit(3000), "fnumber": F.lit(2.8), "iso": F.when(i % 50 != 0, 100), "date_source": F.when(i % 5 == 0, "mtime").otherwise("exif"),
        "rel_dir": F.lit("photos"), "name": F.concat(i.cast("string"), F.lit(".jpg")), "added_at": F.col("taken_at"), "in_album": i % 37 == 0,
    })
    return made


@query()
def cleanup_report(spark, d, seconds: int = 900) -> DataFrame:
    """Groups, rows and bytes of each tab. At this stream's pace minutes stand for the seconds of brackets and bursts; every group
    whose lowest id is a multiple of 11 is ignored, and so is every row whose id is one of 41."""
    catalogue = _cleanup_rows(spark, d)
    rows = catalogue.where(visible())
    now = F.lit("2024-04-15").cast("timestamp")
    nothing = spark.createDataFrame([], "result long, source long")
    options = {"now": now, "gap_ms": 600_000, "sure_ms": 600_000, "seconds": seconds}
    items = rows.where("asset_id % 41 = 0").select(F.concat(F.lit("item:"), F.col("asset_id").cast("string")).alias("signature"))
    groups, suggested = cleanup(rows, items, nothing, catalogue, **options)
    groups = checkpointed(groups)
    left = U.without_ignored(groups, groups.where("group_id % 11 = 0"))
    tabs = left.groupBy("tab").agg(F.count("*").alias("groups"), F.sum("n").alias("items"), F.sum("reclaimable").alias("bytes"))
    return tabs.unionByName(suggested.groupBy("tab").agg(F.lit(0).cast("long").alias("groups"), F.count("*").alias("items"), F.sum("size").alias("bytes")))


def plan_moments(catalogue: DataFrame, *by: str, home_country: str = "France") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moments (by, seg, sig, title, subtitle, ..., cover_id, fp, trip), trips (by, sig, title, ...) and the rows with their `seg`.

    A moment's signature is its first row's day and id; its cover a photo before a video, then the best, then the first."""
    by = list(by)
    narrow = catalogue.where(visible()).select(*by, "asset_id", "taken_at", "day", "city", "country", "lat", "lon", "kind", "quality")
    found = checkpointed(S.segment(narrow, *by))  # read for the fold and for its result
    rows = checkpointed(S.merge_tiny(found, *by))
    discarded(found)
    home = T.home_city(catalogue, *by)
    order = F.struct((F.col("kind") != "video").alias("p"), F.coalesce("quality", F.lit(0.0)).alias("q"), (-F.unix_millis("taken_at")).alias("t"), (-F.col("asset_id")).alias("i"))
    of_rows = rows.groupBy(*by, "seg").agg(F.max_by("asset_id", order).alias("cover_id"), fingerprint(F.col("asset_id")).alias("ids"))
    m = checkpointed(S.summarise(rows, *by).join(of_rows, [*by, "seg"]))
    trips = checkpointed(S.trips(m.drop("lat", "lon", "cover_id", "ids"), home, *by))
    trips = trips.withColumns({"sig": F.concat_ws(":", "day_start", F.col("first_id").cast("string")), "title": D.trip_title(F.col("cities"), F.col("day_start"), F.col("day_end"))})
    m = S.of_trips(m, trips, *by).join(home, by, "left") if by else S.of_trips(m, trips).crossJoin(F.broadcast(home.limit(1)))
    about = (F.col("day_start"), F.col("day_end"), F.col("city"), F.col("country"), F.col("home"))
    m = m.withColumns({"sig": F.concat_ws(":", "day_start", F.col("first_id").cast("string")), "title": D.segment_title(*about, home_country=home_country), "subtitle": D.segment_subtitle(*about, home_country=home_country)})
    fields = ("title", "subtitle", "start_at", "end_at", "city", "country", "cover_id", "n", "ids")
    return m.withColumn("fp", F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields))), trips, rows


@query()
def moments_plan(spark, d) -> DataFrame:
    """What to do with each moment of every user, given the plan of a catalogue that lacked every 97th row."""
    a = assets(spark, d)
    new, _, _ = plan_moments(a, "source_id", home_country="N0")
    old, _, _ = plan_moments(a.where("asset_id % 97 != 0"), "source_id", home_country="N0")
    out = I.plan_diff(old, new, "source_id", "n", "title", "subtitle", "cover_id", "trip", "start_at", "end_at")
    return out.select("sig", "action", "source_id", "n", "title", "subtitle", "cover_id", "trip", F.unix_millis("start_at").alias("start_ms"), F.unix_millis("end_at").alias("end_ms"))


#: Kind -> most rows of a proposal, and least. The kinds of proposals and their sizes are fixed values.
MEMORIES = {"year": (32, 10), "trip": (28, 8), "moment": (20, 8), "person": (30, 12), "category": (24, 15), "onThisDay": (16, 6)}
CATEGORIES = ("pets", "sunset", "food", "beach", "mountain", "party")


def propose(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Proposals of all kinds at once: kind, key, asset_id, pick_order, is_cover. `members` has (kind, key, asset_id), `candidates`
    what `diverse` needs. Keys of fewer candidates, or fewer chosen, than their kind's least are left out."""
    size = lambda i: F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[i])) for k, v in MEMORIES.items()))
    facts = candidates.select("asset_id", "taken_at", "quality", "favorite", "faces", "emb", "phash")
    pool = checkpointed(members.distinct().join(facts, "asset_id").withColumns({"pick": size(0), "least": size(1)}))
    enough = checkpointed(pool.groupBy("key").agg(F.count("*").alias("c"), F.first("least").alias("l")).where("c >= l").select("key"))
    pool = pool.join(enough, "key")
    chosen = checkpointed(C.diverse(C.shortlist(pool, "key", pick="pick"), "key", pick="pick"))
    chosen = chosen.select("key", "asset_id", "pick_order").join(pool.select("key", "asset_id", "kind", "least", "quality", "faces", "favorite", "taken_at"), ["key", "asset_id"])
    w = Window.partitionBy("key")  # at most 32 rows a key
    worth = F.col("quality") + 0.2 * (F.col("faces") > 0).cast("int") + 0.3 * F.col("favorite").cast("int")
    first = F.row_number().over(w.orderBy(worth.desc(), "taken_at", "asset_id")) == 1
    return chosen.withColumns({"is_cover": first, "__n": F.count("*").over(w)}).where("__n >= least").select("kind", "key", "asset_id", "pick_order", "is_cover")


def memory_members(a: DataFrame, library: str, moments: DataFrame, moment_rows: DataFrame, trips: DataFrame, faces: DataFrame, labels: DataFrame, *, today: str, big: int = 30, latest: int = 60) -> DataFrame:
    """(kind, key, asset_id) of every proposal that a library supports: past years of 24 photos or more, trips, the `latest` big
    moments outside trips, named people on 20 rows or more, six categories, and this week in the 15 years before."""
    key = lambda kind, *parts: (F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), F.col(library).cast("string"), *(p.cast("string") for p in parts)).alias("key"), F.col("asset_id"))
    photos = a.where(visible() & (F.col("kind") == "photo"))
    now = F.lit(today).cast("date")
    year = F.substring("day", 1, 4)
    years = photos.where(year.cast("int") < F.year(now)).groupBy(library, year.alias("year")).agg(F.count("*").alias("n")).where("n >= 24")
    of_year = photos.withColumn("year", year).join(years, [library, "year"]).select(*key("year", F.col("year")))
    placed = moment_rows.select(library, "seg", "asset_id")
    in_trip = moments.select(library, "seg", "n", "start_at", "first_id", "trip")
    started = trips.select(library, F.col("first_id").alias("trip"), F.floor(F.unix_millis("start_at") / 86_400_000).alias("at"))
    of_trip = placed.join(in_trip.where("trip is not null").select(library, "seg", "trip"), [library, "seg"]).join(started, [library, "trip"]).select(*key("trip", F.col("at")))
    recent = F.row_number().over(Window.partitionBy(library).orderBy(F.col("start_at").desc(), F.col("seg").desc()))
    large = in_trip.where((F.col("n") >= big) & F.col("trip").isNull()).withColumn("r", recent).where(F.col("r") <= latest).select(library, "seg", "first_id")
    of_moment = placed.join(large, [library, "seg"]).select(*key("moment", F.col("first_id")))
    living = a.where("not trashed and not missing").select("asset_id", library)
    named = faces.where("name is not null").select("person_id", "asset_id").distinct().join(living, "asset_id")
    many = named.groupBy(library, "person_id").agg(F.count("*").alias("n")).where("n >= 20")
    of_person = named.join(many, [library, "person_id"]).select(*key("person", F.col("person_id")))
    of_category = labels.where(F.col("label").isin(*CATEGORIES) & (F.col("score") >= 0.5)).join(a.select("asset_id", library), "asset_id").select(*key("category", F.col("label")))
    week = F.explode(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda n: F.struct((F.year(now) - n).alias("y"), F.date_add(F.make_date(F.year(now) - n, F.month(now), F.lit(1)), F.dayofmonth(now) - 1).alias("d"))))
    back = photos.withColumn("w", week).where(F.abs(F.datediff(F.col("day").cast("date"), F.col("w.d"))) <= 3)
    of_week = back.select(*key("onThisDay", F.col("w.y"), F.month(now), F.floor(F.dayofmonth(now) / 7)))
    out = of_year
    for more in (of_trip, of_moment, of_person, of_category, of_week):
        out = out.unionByName(more)
    return out


def _memories(spark, d):
    """Three libraries of the events, with faces and labels derived from ids."""
    i, k = F.col("asset_id"), F.col("k")
    a = assets(spark, d).withColumns({"source_id": F.col("source_id") % 3, "emb": F.lit(None).cast("array<double>")}).withColumn("phash", F.col("qhash"))
    faces = a.where(i % 3 == 0).select("asset_id", (i % 20).alias("person_id"), F.when(i % 4 != 0, F.concat(F.lit("P"), (i % 20).cast("string"))).alias("name"))
    labels = a.select("asset_id", F.element_at(F.array(*map(F.lit, (*CATEGORIES, "document", "other"))), (k % 8 + 1).cast("int")).alias("label"), (k % 10 / 10.0).alias("score"))
    return a, faces, labels


@query()
def memory_proposals(spark, d) -> DataFrame:
    """Six kinds of proposals for three libraries, on the 17th of January 2025."""
    a, faces, labels = _memories(spark, d)
    moments, trips, rows = plan_moments(a, "source_id", home_country="N0")
    members = memory_members(a, "source_id", moments, rows, trips, faces, labels, today="2025-01-17")
    return propose(C.candidates(a, labels, faces), members)


def slideshow(items: DataFrame, by: str, *, seconds: float, per: float = 3.6, key: str = "asset_id") -> DataFrame:
    """The timed sequence of each group: about (seconds - 3) / per items spread over years, at most a sixth of them videos, in
    order of time. `card` marks items before which a new year is announced (2.4 s), where there are several years."""
    target = max(4, int((seconds - 3) / per + 0.5))
    chosen = checkpointed(C.sampled_by_year(items, by, target, key=key))
    w = Window.partitionBy(by)  # about `target` rows
    whole = chosen.withColumns({"__n": F.count("*").over(w), "__years": F.size(F.collect_set(F.substring("day", 1, 4)).over(w))})
    capped = C.capped_running(whole, by, item=F.col("kind") == "video", cap=F.greatest(F.lit(1), F.floor(F.col("__n") / 6)), key=key)
    shown = F.when(F.col("kind") == "video", F.greatest(F.lit(2.0), F.least(F.lit(4.0), F.coalesce("duration", F.lit(3.0)) - 0.5))).otherwise(F.lit(per))
    return capped.select(by, key, "kind", "taken_at", shown.alias("seconds"), (F.col("new_year") & (F.col("__years") > 1)).alias("card"))


@query()
def slideshow_plan(spark, d) -> DataFrame:
    """Two minutes of each of ten libraries, whose years are made of the days of the month."""
    years = F.concat((F.lit(2000) + F.floor(F.dayofmonth("taken_at") / 8)).cast("string"), F.substring("day", 5, 6))
    items = C.slideshow_items(measured(spark, d)).withColumns({"source_id": F.col("source_id") % 10, "faces": F.lit(0), "emb": F.lit(None).cast("array<double>"), "phash": F.col("qhash"), "quality": F.col("score"), "day": years})
    return slideshow(items, "source_id", seconds=120).select("source_id", "asset_id", "kind", "seconds", "card")


def move_files(files: DataFrame, moments: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """Where each file (key, path, day, date_source) would go: <year>/<year-month> <moment>/<name>. `moments` has (key, title); rows
    without one go to <year>/<year-month>. status: `skipped` (no sure day), `tidy` (there already) or `move`, with names made unique
    beside the files that stay there."""
    bad = ~F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") | (F.col("date_source") == "mtime") | F.col("day").isNull()
    plain = F.regexp_replace(F.coalesce("title", F.lit("")), r"\s*·.*$", "")
    clean = F.when(plain != "", F.substring(N.sanitize(plain), 1, 60)).otherwise("")
    month = F.concat_ws("/", F.substring("day", 1, 4), F.trim(F.concat_ws(" ", F.substring("day", 1, 7), clean)))
    rows = files.join(moments.select(key, "title"), key, "left").withColumns({"dir": month, "__from": N.rel_dir(F.col("path")), "__name": N.base_name(F.col("path"))})
    rows = rows.withColumn("status", F.when(bad, "skipped").when(F.col("__from") == F.col("dir"), "tidy").otherwise("move"))
    named = rows.where("status != 'skipped'").select(F.col(key), "dir", "status", F.struct((F.col("status") == "move").alias("m"), F.col(key).alias("k")).alias("__order"), F.expr("substring(__name, 1, length(__name) - length(substring_index(__name, '.', -1)) - 1)").alias("base"), F.substring_index("__name", ".", -1).alias("ext"))
    moved = S.unique_names(named, key="__order").select(key, "dir", "status", F.concat_ws("/", "dir", "name").alias("to"))
    return moved.unionByName(rows.where("status = 'skipped'").select(key, F.lit(None).cast("string").alias("dir"), "status", F.lit(None).cast("string").alias("to"))).drop("dir")


_MOVES = A + """, r AS (SELECT *, 'IMG_' || (asset_id % 50) AS base, CASE WHEN asset_id % 9 = 0 THEN 'mtime' ELSE 'exif' END AS ds,
    CASE WHEN asset_id % 4 <> 0 THEN city || '. · ' || day END AS title FROM assets WHERE NOT hidden AND NOT missing AND NOT trashed),
  f AS (SELECT *, substr(day, 1, 4) || '/' || substr(day, 1, 7) || CASE WHEN title IS NOT NULL THEN ' ' || city ELSE '' END AS dir FROM r WHERE ds <> 'mtime'),
  s AS (SELECT *, CASE WHEN asset_id % 10 = 0 THEN 'tidy' ELSE 'move' END AS status FROM f),
  n AS (SELECT *, row_number() OVER (PARTITION BY dir, base ORDER BY status = 'move', asset_id) AS i FROM s)
  SELECT asset_id, status, dir || '/' || base || CASE WHEN i > 1 THEN ' (' || i || ')' ELSE '' END || '.jpg' AS "to" FROM n UNION ALL SELECT asset_id, 'skipped', NULL FROM r WHERE ds = 'mtime'"""


@query(_MOVES)
def move_plan(spark, d) -> DataFrame:
    """Every visible file's move by its moment (a city and a day); every tenth lies where it belongs."""
    i = F.col("asset_id")
    a = assets(spark, d).where(visible()).withColumns({"date_source": F.when(i % 9 == 0, "mtime").otherwise("exif"), "title": F.when(i % 4 != 0, F.concat(F.col("city"), F.lit(". · "), F.col("day")))})
    there = F.concat_ws("/", F.substring("day", 1, 4), F.concat_ws(" ", F.substring("day", 1, 7), F.when(F.col("title").isNotNull(), F.col("city"))))
    path = F.concat(F.when(i % 10 == 0, there).otherwise("inbox"), F.lit("/IMG_"), (i % 50).cast("string"), F.lit(".jpg"))
    return move_files(a.select("asset_id", path.alias("path"), "day", "date_source"), a.where("title is not null").select("asset_id", "title")).select("asset_id", "status", "to")


def refresh(catalogue: DataFrame, listing: DataFrame, cities: DataFrame, *, now: Column) -> DataFrame:
    """The catalogue after a listing (path, length, modificationTime): files of known kinds are listed, states reconciled and
    applied, new rows get their date, raw files and short videos are paired with their photos, and places are looked up.

    Needs path, size, mtime (a timestamp), is_missing, missing_at, thumb_v, meta_state in the catalogue; `lat`, `lon` and `duration`
    come from later stages and may be null there. One row per path, with action, hidden, companion_path, live_video, city_id."""
    files = X.listed(listing)
    there = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    actions = checkpointed(R.reconcile(catalogue, there))
    rows = R.apply_reconcile(catalogue.drop("lat", "lon", "duration"), actions, now=now)
    known = catalogue.select("path", "lat", "lon", "duration")
    dated = X.initial_rows(rows.select("path", F.col("size").alias("length"), F.col("mtime").alias("modificationTime")), now=now).select("path", "day", "date_source", "ext", "kind", "is_raw", "stem", "rel_dir")
    rows = checkpointed(rows.join(dated, "path").join(known, "path", "left").join(actions.select("path", "action"), "path"))
    photo, there = ~F.col("is_raw") & (F.col("kind") == "photo") & ~F.col("is_missing"), ~F.col("is_missing")
    raw = R.pair_companions(rows, "rel_dir", "stem", main=photo, companion=F.col("is_raw") & there, key="path")
    short = F.col("ext").isin("mov", "mp4") & (F.col("duration").isNull() | (F.col("duration") <= 6)) & there
    live = R.pair_companions(raw.withColumnsRenamed({"companion_hidden": "raw_hidden", "companion_path": "raw_companion"}), "rel_dir", "stem", main=photo, companion=short, key="path")
    placed = geocode(live.select("path", "lat", "lon"), cities, key="path").select("path", "city_id")
    return live.join(placed, "path").select(*rows.columns, (F.col("raw_hidden") | F.col("companion_hidden")).alias("hidden"), F.col("raw_companion").alias("companion_path"), F.col("companion_path").alias("live_video"), "city_id")


@query("""WITH f AS (SELECT doc_id, doc_id // 3 AS g, ['jpg', 'nef', 'mov'][doc_id % 3 + 1] AS e, n_chars AS size, doc_id % 10 AS x FROM documents WHERE n_chars > 0),
  p AS (SELECT *, 'f' || (g % 7) || '/IMG_' || g || '.' || e AS path, x <> 0 AS old, x <> 1 AS listed, x <> 0 AND doc_id % 13 = 0 AS was FROM f),
  s AS (SELECT *, CASE WHEN NOT old THEN 'insert' WHEN NOT listed THEN CASE WHEN was THEN 'unchanged' ELSE 'missing' END WHEN doc_id % 7 = 0 THEN 'changed' WHEN was THEN 'reappeared' ELSE 'unchanged' END AS action, NOT listed AS gone FROM p),
  c AS (SELECT *, (SELECT max(y.path) FROM s y WHERE y.g = s.g AND y.e = 'nef' AND NOT y.gone) AS raw, (SELECT max(y.path) FROM s y WHERE y.g = s.g AND y.e = 'mov' AND NOT y.gone AND (NOT y.old OR y.doc_id % 10 <= 6)) AS live,
    EXISTS (SELECT 1 FROM s y WHERE y.g = s.g AND y.e = 'jpg' AND NOT y.gone) AS photo FROM s)
  SELECT path, action, gone AS is_missing, photo AND NOT gone AND (e = 'nef' OR (e = 'mov' AND (NOT old OR x <= 6))) AS hidden, CASE WHEN e = 'jpg' AND NOT gone THEN raw END AS companion_path, CASE WHEN e = 'jpg' AND NOT gone THEN live END AS live_video,
    strftime(make_timestamp((doc_id + CASE WHEN listed AND doc_id % 7 = 0 THEN 1 ELSE 0 END) * 86400000000), '%Y-%m-%d') AS day, CASE WHEN old AND doc_id % 5 <> 0 THEN doc_id % 4 END AS city_id FROM c""")
def catalogue_refresh(spark, d) -> DataFrame:
    """Documents as files: a tenth is new, a tenth gone, a seventh changed; three files share a stem."""
    i = F.col("doc_id")
    g = F.floor(i / 3)
    path = F.concat(F.lit("f"), (g % 7).cast("string"), F.lit("/IMG_"), g.cast("string"), F.lit("."), F.element_at(F.array(F.lit("jpg"), F.lit("nef"), F.lit("mov")), (i % 3 + 1).cast("int")))
    f = table(spark, d, "documents").where("n_chars > 0").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"))
    day = lambda extra: F.timestamp_seconds((i + extra) * 86400)
    old = f.where("doc_id % 10 != 0").select(
        "path", "size", day(F.lit(0)).alias("mtime"), (i % 13 == 0).alias("is_missing"), F.lit(None).cast("timestamp").alias("missing_at"), F.lit(1).alias("thumb_v"), F.lit(1).alias("meta_state"),
        F.when(i % 5 != 0, 10.0 * (i % 4)).alias("lat"), F.when(i % 5 != 0, 10.0 * (i % 4)).alias("lon"), (i % 10).cast("double").alias("duration"),
    )
    listing = f.where("doc_id % 10 != 1").select("path", F.col("size").alias("length"), day((i % 7 == 0).cast("int")).alias("modificationTime"))
    cities = spark.range(4).select(F.col("id").alias("city_id"), (10.0 * F.col("id")).alias("lat"), (10.0 * F.col("id")).alias("lon"), F.lit(5000).alias("population"))
    return refresh(old, listing, cities, now=F.lit("2024-05-01").cast("timestamp")).select("path", "action", "is_missing", "hidden", "companion_path", "live_video", "day", "city_id")
