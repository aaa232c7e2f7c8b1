"""Timelines, filters and facets over the events catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.functions import filters as P
from lightframe.operators import timeline as T
from lightframe.plans.registry import query
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table

V = "NOT hidden AND NOT missing AND NOT trashed"


def hdr_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets with is_hdr: every 31st result of a fused series."""
    made = assets(spark, d).where("asset_id % 31 = 0").select("asset_id")
    return T.with_membership(assets(spark, d), made, "asset_id", "is_hdr")


H = A + ", h AS (SELECT *, asset_id % 31 = 0 AS is_hdr FROM assets)\n"
_PRESET_SQL = {"all": V, "photos": f"{V} AND kind = 'photo'", "videos": f"{V} AND kind = 'video'", "live": f"{V} AND is_live", "screenshots": f"{V} AND is_screenshot", "favorites": f"{V} AND favorite", "raw": f"{V} AND is_raw", "hdr": f"{V} AND is_hdr", "trash": "NOT hidden AND NOT missing AND trashed"}


@query(H + " UNION ALL ".join(f"SELECT '{k}' AS preset, count(*) AS n, coalesce(sum(asset_id), 0)::BIGINT AS ids FROM h WHERE {w}" for k, w in _PRESET_SQL.items()))
def preset_filters(spark, d):
    """Rows of every preset in one pass over the catalogue."""
    hit = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in P.presets().items())))
    return hdr_assets(spark, d).select("asset_id", F.explode(hit).alias("preset")).groupBy("preset").agg(F.count("*").alias("n"), F.sum("asset_id").alias("ids"))


@query(A + f"""SELECT asset_id, day, city FROM assets WHERE {V} AND kind = 'photo' AND day >= '2024-01-01' AND day <= '2024-12-31' AND (city = 'C2' OR country = 'C2')
  AND asset_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND source_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')""")
def timeline_filter(spark, d):
    album = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("asset_id"))
    people = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("source_id"))
    of = T.timeline(assets(spark, d), kind="photo", year=2024, place="C2", album=album)
    return of.join(people, "source_id", "left_semi").select("asset_id", "day", "city")


@query("""SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') AND NOT contains(lower(p_type), 'eco')) OR p_size >= 40
  OR p_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def smart_rules(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("rel_dir"), F.lit("photo").alias("kind"), "p_size")
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("p_partkey"))
    rows = T.with_membership(part, pending, "p_partkey", "in_album_7")
    named = P.rules("all", [{"field": "name", "op": "contains", "value": "RING"}, {"field": "folder", "op": "notContains", "value": "eco"}, {"field": "nothing"}])
    return rows.where(named | (F.col("p_size") >= 40) | P.rules("any", [{"field": "album", "op": "in", "value": 7}])).select("p_partkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 3 = 1 AND o_orderstatus = 'F'")
def album_condition(spark, d):
    """Manual albums by membership, smart ones by rule, unknown ones empty."""
    o = table(spark, d, "orders")
    kind = F.col("o_custkey") % 3
    return o.where(F.when(kind == 0, F.lit(True)).when(kind == 1, F.col("o_orderstatus") == "F").otherwise(False)).select("o_custkey", "o_orderkey")


@query(A + f"""SELECT a.asset_id, CASE WHEN k % 4 = 0 THEN 1.0 ELSE k / 50.0 END::DOUBLE AS ratio, 0.5::DOUBLE AS fx, CASE WHEN k % 7 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS fy, k % 9 = 0 AS edited,
  coalesce(v.n, 0) AS versions, CASE WHEN k % 5 = 0 THEN 'x' ELSE substr(qhash, 1, 10) END || (k % 3) AS tile_key
  FROM assets a LEFT JOIN (SELECT asset_id // 3 AS p, count(*) AS n FROM assets WHERE asset_id % 3 = 1 GROUP BY 1) v ON v.p = a.asset_id WHERE {V}""")
def tile_projection(spark, d):
    k = F.col("k")
    a = assets(spark, d)
    rows = a.where(P.visible()).select(
        "asset_id", F.when(k % 4 != 0, k / 50.0).alias("ratio"), F.lit(None).cast("double").alias("focal_x"), F.when(k % 7 == 0, F.lit(0.25)).alias("focal_y"), F.when(k % 9 == 0, F.lit("{}")).alias("edit"),
        F.when(k % 5 != 0, F.col("qhash")).alias("qhash"), (k % 3).alias("thumb_v"),
    )
    return T.tiles(rows, a.where("asset_id % 3 = 1").select(F.floor(F.col("asset_id") / 3).alias("version_of")))


@query(A + f"SELECT asset_id, event_type FROM assets WHERE {V} AND (bit_count(('0x' || substr(phash, 1, 8))::BIGINT) + bit_count(('0x' || substr(phash, 9, 8))::BIGINT)) NOT BETWEEN 31 AND 33")
def low_entropy(spark, d):
    """The rejection of hashes by their set bits, with limits that md5 hashes can cross."""
    return assets(spark, d).where(P.visible() & P.low_entropy(F.col("phash"), 31, 33)).select("asset_id", "event_type")


@query(A + f"""SELECT asset_id FROM assets WHERE {V} AND kind = 'photo' AND NOT is_screenshot AND k % 10 <> 3 AND (k % 4 <> 0 OR source_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000))""")
def curation_candidates(spark, d):
    from lightframe.operators.curate import candidates

    a = assets(spark, d).withColumn("model", F.when(F.col("k") % 4 != 0, F.col("model")))
    labels = a.where("k % 10 = 3").select("asset_id", F.lit("document").alias("label"))
    known = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("source_id"))
    faces = a.join(known, "source_id", "left_semi").select("asset_id", F.lit(1).alias("person_id"))
    return candidates(a, labels, faces).select("asset_id")


@query("""SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND (o_totalprice < 100000 OR o_orderdate > TIMESTAMP '1997-01-01')""")
def share_validity(spark, d):
    from lightframe.operators.sharing import valid_shares

    shares = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("revoked"), F.when(F.col("o_totalprice") >= 100000, F.col("o_orderdate").cast("timestamp")).alias("expires_at"), F.col("o_custkey").alias("album_id"))
    albums = table(spark, d, "customer").select(F.col("c_custkey").alias("album_id"))
    return valid_shares(shares, albums, now=F.lit("1997-01-01").cast("timestamp")).select("o_orderkey", "o_custkey")


_M = """, m AS (SELECT *, (k % 20) / 20.0::DOUBLE AS contrast, (k % 13) / 12.0::DOUBLE AS screen_mishap, (k % 90)::DOUBLE AS sharpness, (k % 31) / 30.0::DOUBLE AS brightness, (k % 7) / 6.0::DOUBLE AS clip_dark,
  (k % 11) / 10.0::DOUBLE AS clip_bright, (k % 17) / 16.0::DOUBLE AS mishap, (k % 40) / 4.0::DOUBLE AS duration, size * 40 AS bytes FROM assets),
f AS (SELECT *, coalesce(is_screenshot AND (contrast < 0.01 OR screen_mishap >= 0.7), false) AS failed,
  kind = 'photo' AND NOT is_screenshot AND contrast > 0.08 AND sharpness / nullif((contrast * 255) * (contrast * 255), 0) < 0.025 AND sharpness < 40 AS blurry,
  kind = 'photo' AND NOT is_screenshot AND brightness < 0.08 AND clip_dark > 0.7 AS dark FROM m WHERE NOT hidden AND NOT missing AND NOT trashed AND NOT favorite),
c AS (SELECT asset_id, bytes, taken_at, unnest(list_filter([
  CASE WHEN failed THEN 'failed_screenshots' END, CASE WHEN is_screenshot AND taken_at < TIMESTAMP '2024-04-15' - INTERVAL 90 DAY AND NOT failed THEN 'old_screenshots' END,
  CASE WHEN kind = 'photo' AND NOT is_screenshot AND mishap >= 0.9 AND NOT coalesce(blurry, false) AND NOT coalesce(dark, false) THEN 'mishaps' END, CASE WHEN blurry THEN 'blurry' END, CASE WHEN dark THEN 'dark' END,
  CASE WHEN kind = 'photo' AND NOT is_screenshot AND clip_bright > 0.55 THEN 'overexposed' END, CASE WHEN kind = 'video' AND duration < 2 THEN 'short_videos' END,
  CASE WHEN kind = 'video' AND bytes > 1073741824 THEN 'large_videos' END], lambda x: x IS NOT NULL)) AS class FROM f)
"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return assets(spark, d).withColumns({
        "contrast": (k % 20) / 20.0, "screen_mishap": (k % 13) / 12.0, "sharpness": (k % 90).cast("double"), "brightness": (k % 31) / 30.0, "clip_dark": (k % 7) / 6.0, "clip_bright": (k % 11) / 10.0,
        "mishap": (k % 17) / 16.0, "duration": (k % 40) / 4.0, "size": F.col("size") * 40,
    })


@query(A + _M + "SELECT class, count(*) AS n, sum(bytes)::BIGINT AS bytes, arg_max(asset_id, (taken_at, asset_id)) AS newest_id FROM c GROUP BY class")
def suggestions(spark, d):
    """Eight cleanup classes in one pass; favourites are never suggested; `now` is fixed."""
    rows = measured(spark, d).where(P.visible() & ~F.col("favorite"))
    each = rows.select("asset_id", "size", "taken_at", F.explode(P.cleanup_classes(F.lit("2024-04-15").cast("timestamp"))).alias("class"))
    return each.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max_by("asset_id", F.struct("taken_at", "asset_id")).alias("newest_id"))


@query(A + _M + f"SELECT asset_id, CASE WHEN kind = 'video' THEN quality - 0.05 ELSE quality END AS score FROM m WHERE {V} AND NOT is_screenshot AND (kind = 'photo' OR duration >= 2)")
def slideshow_gate(spark, d):
    from lightframe.operators.curate import slideshow_items

    return slideshow_items(measured(spark, d)).select("asset_id", "score")


@query(A + f"SELECT day, count(*) AS n FROM assets WHERE {V} GROUP BY day")
def day_buckets(spark, d):
    return T.day_buckets(assets(spark, d).where(P.visible()))


@query(A + f"SELECT day, n, (coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM (SELECT day, count(*) AS n FROM assets WHERE {V} GROUP BY day)")
def bucket_offsets(spark, d):
    return T.bucket_offsets(T.day_buckets(assets(spark, d).where(P.visible())))


@query(A + f"""SELECT substr(day, 1, 7) AS bucket, sum(n)::BIGINT AS n, min(o)::BIGINT AS "offset" FROM (
  SELECT day, n, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT day, count(*) AS n FROM assets WHERE {V} GROUP BY day)) GROUP BY 1""")
def month_buckets(spark, d):
    return T.month_buckets(T.day_buckets(assets(spark, d).where(P.visible())))


@query(H + f"""SELECT count(*) FILTER ({V}) AS n_all, count(*) FILTER ({V} AND kind = 'photo') AS photos, count(*) FILTER ({V} AND kind <> 'photo') AS videos, count(*) FILTER ({V} AND is_live) AS live,
  count(*) FILTER ({V} AND is_screenshot) AS screenshots, count(*) FILTER ({V} AND favorite) AS favorites, count(*) FILTER ({V} AND is_raw) AS raw, count(*) FILTER ({V} AND is_hdr) AS hdr,
  count(*) FILTER (NOT hidden AND NOT missing AND trashed) AS trash FROM h""")
def library_counts(spark, d):
    return T.counters(hdr_assets(spark, d))


@query(A + f"SELECT substr(day, 1, 4) AS year, count(*) AS n FROM assets WHERE {V} GROUP BY 1")
def years(spark, d):
    return assets(spark, d).where(P.visible()).groupBy(F.substring("day", 1, 4).alias("year")).agg(F.count("*").alias("n"))


@query(A + f"SELECT substr(day, 1, 4) AS year, count(*) AS n FROM assets WHERE {V} AND kind = 'photo' GROUP BY 1 HAVING count(*) >= 24")
def eligible_years(spark, d):
    return assets(spark, d).where(P.visible() & (F.col("kind") == "photo")).groupBy(F.substring("day", 1, 4).alias("year")).agg(F.count("*").alias("n")).where("n >= 24")


@query(A + """SELECT count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (is_live) AS live, coalesce(sum(size), 0)::BIGINT AS bytes
  FROM assets WHERE asset_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def selection_summary(spark, d):
    return T.selection_summary(assets(spark, d), table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("asset_id")))


@query(A + f"""SELECT o_custkey AS album_id, count(*) AS n, arg_max(asset_id, (day, taken_at, asset_id)) AS cover_id
  FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) JOIN assets ON asset_id = o_orderkey WHERE {V} GROUP BY 1""")
def album_stats(spark, d):
    return T.album_stats(table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").alias("asset_id")), assets(spark, d))


@query(A + f"SELECT event_type AS label, count(*) AS n, max(asset_id) AS cover_id FROM assets WHERE {V} GROUP BY 1")
def category_facet(spark, d):
    return assets(spark, d).where(P.visible()).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.max("asset_id").alias("cover_id"))


@query(A + f"SELECT city, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, max(asset_id) AS cover_id, min(country) AS country FROM assets WHERE {V} AND city IS NOT NULL GROUP BY city")
def place_facet(spark, d):
    return T.place_facet(assets(spark, d)).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(A + "SELECT source_id AS person_id, count(DISTINCT asset_id) AS n FROM assets WHERE asset_id % 7 <> 0 AND NOT trashed AND NOT missing GROUP BY 1 HAVING count(DISTINCT asset_id) >= 2")
def people_facet(spark, d):
    a = assets(spark, d)
    faces = a.select("asset_id", F.col("source_id").alias("person_id"), (F.col("asset_id") % 7 == 0).alias("face_hidden"))
    return T.people_facet(faces, a)


@query(A + """SELECT source_id, arg_max(city, (n, city)) AS home FROM (SELECT source_id, city, count(*) AS n FROM assets WHERE NOT hidden AND NOT missing AND city IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def home_city(spark, d):
    return T.home_city(assets(spark, d), "source_id")


@query(A + "SELECT source_id, count(*) FILTER (NOT hidden AND NOT missing) AS n FROM assets GROUP BY 1")
def source_counters(spark, d):
    return assets(spark, d).groupBy("source_id").agg(F.count_if(~F.col("hidden") & ~F.col("missing")).alias("n"))


@query(A + """, s AS (SELECT *, k % 3 AS meta, CASE WHEN k % 3 = 1 THEN k % 2 ELSE 0 END AS thumb FROM assets WHERE NOT missing)
  SELECT stage, count(*) FILTER (state = 0) AS pending, count(*) FILTER (state = 1) AS done, count(*) FILTER (state = 2) AS failed
  FROM (SELECT 'meta' AS stage, meta AS state FROM s UNION ALL SELECT 'thumb', thumb FROM s WHERE meta = 1) GROUP BY stage""")
def stage_progress(spark, d):
    from lightframe.operators.incremental import stage_progress as progress

    k = F.col("k")
    rows = assets(spark, d).where("not missing").select((k % 3).alias("meta"), F.when(k % 3 == 1, k % 2).otherwise(0).alias("thumb"))
    return progress(rows, {"meta": None, "thumb": "meta"})


@query(A + f"""SELECT count(*) AS rank FROM assets a, (SELECT day AS d, taken_at AS t, asset_id AS i FROM assets WHERE asset_id = 456) x
  WHERE {V} AND (a.day > x.d OR (a.day = x.d AND (a.taken_at > x.t OR (a.taken_at = x.t AND a.asset_id > x.i))))""")
def index_of(spark, d):
    a = assets(spark, d)
    return T.index_of(a.where(P.visible()), a.where("asset_id = 456"))


@query(A + f"SELECT asset_id, row_number() OVER (ORDER BY day DESC, taken_at DESC, asset_id DESC) AS row_number FROM assets WHERE {V}")
def ranked_timeline(spark, d):
    """Every row's place in the timeline."""
    return T.global_row_number(assets(spark, d).where(P.visible()).select("asset_id", "day", "taken_at"), T.newest()).select("asset_id", F.col("row_number").cast("long").alias("row_number"))


@query(A + f"SELECT asset_id, day FROM assets WHERE {V} ORDER BY day DESC, taken_at DESC, asset_id DESC LIMIT 240 OFFSET 300")
def timeline_page(spark, d):
    return T.page(assets(spark, d).where(P.visible()), 300, 240).select("asset_id", "day")


@query(A + f"""SELECT floor((lon + 180) / 360 * (pow(2.0::DOUBLE, 9) * 256 / 56))::BIGINT AS cell_x,
  floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (pow(2.0::DOUBLE, 9) * 256 / 56))::BIGINT AS cell_y, count(*) AS n,
  arg_max(asset_id, (round(1000 * greatest(0, least(1, quality)))::BIGINT + 1000 * favorite::BIGINT + (kind = 'photo')::BIGINT) * 10000000000 + asset_id) AS cover_id FROM assets WHERE {V} AND lat IS NOT NULL GROUP BY 1, 2""")
def map_cells(spark, d):
    return T.map_cells(assets(spark, d), zoom=9)


@query(A + f"SELECT pos, asset_id, day FROM (SELECT unnest(ids) AS asset_id, generate_subscripts(ids, 1) - 1 AS pos FROM (SELECT list(v ORDER BY v DESC) AS ids FROM (SELECT doc_id * 3 AS v FROM documents))) JOIN assets USING (asset_id) WHERE {V}")
def tiles_by_ids(spark, d):
    ids = table(spark, d, "documents").select((F.col("doc_id") * 3).alias("asset_id"))
    ranked = T.global_row_number(ids, [F.col("asset_id").desc()], "pos").withColumn("pos", (F.col("pos") - 1).cast("long"))
    return T.by_ranked_ids(assets(spark, d).where(P.visible()), ranked).select("pos", "asset_id", "day")
