"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightframe.functions import dates as D
from lightframe.functions import media as M
from lightframe.functions import names as N
from lightframe.functions import vectors as X
from lightframe.functions.filters import hamming_hex
from lightframe.plans.registry import query
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table


@query("SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS base, lower(regexp_extract(url, '[^/]*$', 0)) AS base_lower, regexp_replace(url, '/?[^/]*$', '') AS rel_dir FROM pages")
def path_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", N.base_name(url).alias("base"), F.lower(N.base_name(url)).alias("base_lower"), N.rel_dir(url).alias("rel_dir"))


_EXT = "CASE page_id % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'MOV' WHEN 2 THEN 'nef' WHEN 3 THEN 'txt' WHEN 4 THEN 'PNG' WHEN 5 THEN 'heic' ELSE 'mp4' END"


def _named(spark, d):
    e = F.element_at(F.array(*map(F.lit, ("jpg", "MOV", "nef", "txt", "PNG", "heic", "mp4"))), (F.col("page_id") % 7 + 1).cast("int"))
    name = F.concat(F.when(F.col("page_id") % 5 == 0, F.lit("Screen Shot ")).otherwise(F.lit("IMG_")), F.col("page_id").cast("string"), F.lit("."), e)
    return table(spark, d, "pages").select("page_id", "url", name.alias("name"))


_NAMED = f"WITH n AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'Screen Shot ' ELSE 'IMG_' END || page_id || '.' || {_EXT} AS name, lower({_EXT}) AS ext FROM pages)\n"


@query(_NAMED + """SELECT page_id, ext, CASE WHEN ext IN ('mov', 'mp4') THEN 'video' WHEN ext <> 'txt' THEN 'photo' END AS kind, ext = 'nef' AS is_raw,
  contains(lower(name), 'screen shot') OR (ext = 'png' AND regexp_matches(name, '^IMG_\\d+')) AS screenshot FROM n""")
def classify_ext(spark, d):
    e = N.ext(F.col("name"))
    return _named(spark, d).select("page_id", e.alias("ext"), N.kind(e).alias("kind"), e.isin(*N.RAW).alias("is_raw"), N.is_screenshot(F.col("name"), e, F.lit(False), F.lit(None).cast("string")).alias("screenshot"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + to_seconds(l_partkey * 37 % 86400) AS w, (l_partkey % 27 - 13) * 60 AS z FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, epoch_ms(w) + 250 - z * 60000 AS taken_ms, strftime(w, '%Y-%m-%d') AS day, z AS "offset" FROM s""")
def parse_dates(spark, d):
    """Stamps with fractions and zones, back to instants and capture days."""
    wall = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("l_partkey") * 37 % 86400).cast("decimal(18,6)"))
    zone = F.col("l_partkey") % 27 - 13
    text = F.concat(F.date_format(wall, "yyyy:MM:dd HH:mm:ss"), F.lit(".25"), F.when(zone < 0, "-").otherwise("+"), F.lpad(F.abs(zone).cast("string"), 2, "0"), F.lit(":00"))
    got = table(spark, d, "lineitem").withColumn("p", D.parse_date(text))
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "p.taken_ms", "p.day", F.col("p.offset").cast("long").alias("offset"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(o_orderdate) + (15 * 3600 + 30 * 60 + 12) * 1000 WHEN 1 THEN epoch_ms(o_orderdate) + 43200000 WHEN 2 THEN epoch_ms(o_orderdate) + (19 * 3600 + 45 * 60 + 10) * 1000 END AS taken_ms FROM orders""")
def date_from_name(spark, d):
    day = F.col("o_orderdate")
    f = lambda p: F.date_format(day, p)
    name = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("IMG_"), f("yyyyMMdd"), F.lit("_153012.jpg")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("scan "), f("yyyy-MM-dd"), F.lit(" b.png")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("WhatsApp Image "), f("yyyy-MM-dd"), F.lit(" at 19.45.10.jpeg")))
        .otherwise(F.lit("IMG_1234.JPG"))
    )
    return table(spark, d, "orders").select("o_orderkey", F.unix_millis(D.date_from_name(name)).alias("taken_ms"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 3 AS k FROM orders)
  SELECT o_orderkey, CASE k WHEN 0 THEN 'mtime' WHEN 1 THEN 'folder' ELSE 'filename' END AS source,
    CASE k WHEN 0 THEN epoch_ms(t) WHEN 1 THEN epoch_ms(TIMESTAMP '2005-06-01 12:00:00') ELSE epoch_ms(t) + 43200000 END AS taken_ms FROM o""")
def infer_date(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    folder = F.when(k == 0, F.concat(F.date_format(t, "yyyy"), F.lit("/"), F.date_format(t, "yyyy-MM"))).when(k == 1, F.lit("Trips 2005/2005-06 Sea")).otherwise(F.lit("x/2001"))
    name = F.when(k == 2, F.concat(F.lit("a "), F.date_format(t, "yyyy-MM-dd"), F.lit(".jpg"))).otherwise(F.lit("IMG_1.jpg"))
    got = table(spark, d, "orders").withColumn("i", D.infer_date(name, folder, t.cast("timestamp")))
    return got.select("o_orderkey", "i.source", F.unix_millis("i.taken_at").alias("taken_ms"))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59) / 3600.0::DOUBLE), 6) AS lat FROM customer")
def gps_decimal(spark, d):
    k = F.col("c_custkey")
    lat = M.gps_decimal((k % 90).cast("double"), (k % 60).cast("double"), (k % 59).cast("double"), F.when(k % 2 == 0, "S").otherwise("N"))
    return table(spark, d, "customer").select("c_custkey", F.round(lat, 6).alias("lat"))


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 1200) / 10.0::DOUBLE - 60 AS lat, (c_custkey % 3590) / 10.0::DOUBLE - 179.5 AS lon FROM customer)
  SELECT c_custkey, round(2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(48.8566 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.8566)) * pow(sin(radians(2.3522 - lon) / 2), 2)))), 4) AS km FROM c""")
def haversine(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.round(M.haversine_km((k % 1200) / 10.0 - 60, (k % 3590) / 10.0 - 179.5, F.lit(48.8566), F.lit(2.3522)), 4).alias("km"))


@query(A + "SELECT asset_id, (bit_count(xor(('0x' || substr(phash, 1, 8))::BIGINT, ('0x' || substr(qhash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(phash, 9, 8))::BIGINT, ('0x' || substr(qhash, 9, 8))::BIGINT)))::BIGINT AS bits FROM assets")
def hamming(spark, d):
    return assets(spark, d).select("asset_id", hamming_hex(F.col("phash"), F.col("qhash")).cast("long").alias("bits"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(0.6 * greatest(0, least(1, (log10(l_extendedprice + 1) - 1) / 2.2)) + 0.3 * l_discount + 0.1 * greatest(0, least(1, log2(greatest(1.0, l_quantity)) / 5)), 3) AS quality FROM lineitem""")
def quality_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.quality_score(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity")).alias("quality"))


@query("SELECT count(DISTINCT text) AS classes, count(*) AS files FROM documents")
def quick_hash(spark, d):
    """As many classes as different contents: heads and tails tell these files apart."""
    h = M.quick_hash(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select(h.alias("h")).agg(F.countDistinct("h").alias("classes"), F.count("*").alias("files"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents")
def full_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


_MON = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_RANGE = f"""CASE WHEN a = b THEN day(a) || ' ' || {_MON}[month(a)] || ' ' || year(a)
  WHEN year(a) = year(b) AND month(a) = month(b) THEN day(a) || '–' || day(b) || ' ' || {_MON}[month(a)] || ' ' || year(a)
  WHEN year(a) = year(b) THEN day(a) || ' ' || {_MON}[month(a)] || ' – ' || day(b) || ' ' || {_MON}[month(b)] || ' ' || year(b)
  ELSE day(a) || ' ' || {_MON}[month(a)] || ' ' || year(a) || ' – ' || day(b) || ' ' || {_MON}[month(b)] || ' ' || year(b) END"""
_SPANS = """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS a, (o_orderdate::DATE + (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 40 END)::INTEGER)::DATE AS b,
  CASE WHEN o_custkey % 4 <> 0 THEN 'C' || (o_custkey % 5) END AS city, CASE o_custkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Spain' END AS country FROM orders)\n"""


def _spans(spark, d):
    first = F.col("o_orderdate").cast("date")
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", first.cast("string").alias("first"), F.date_add(first, F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 40).cast("int")).cast("string").alias("last"),
        F.when(k % 4 != 0, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("city"), F.when(k % 3 == 0, "France").when(k % 3 == 1, "Spain").alias("country"),
    )


@query(_SPANS + f"SELECT o_orderkey, {_RANGE} AS label FROM s")
def range_label(spark, d):
    return _spans(spark, d).select("o_orderkey", D.range_label(F.col("first"), F.col("last")).alias("label"))


@query(_SPANS + f""", t AS (SELECT *, {_RANGE} AS label, CASE strftime(a, '%m-%d') WHEN '12-25' THEN 'Christmas' WHEN '12-24' THEN 'Christmas Eve' WHEN '12-31' THEN 'New Year''s Eve' WHEN '01-01' THEN 'New Year'
  WHEN '07-14' THEN 'Bastille Day' WHEN '10-31' THEN 'Halloween' WHEN '02-14' THEN 'Valentine''s Day' END AS holiday, coalesce(city <> 'C2', false) AS away FROM s)
  SELECT o_orderkey, CASE WHEN city IS NOT NULL THEN CASE WHEN holiday IS NOT NULL THEN holiday || ' in ' || city WHEN a <> b AND away THEN 'Stay in ' || city WHEN country <> 'France' AND away THEN city || ', ' || country ELSE city END
    WHEN holiday IS NOT NULL THEN holiday WHEN a <> b THEN label ELSE strftime(a, '%A') || ' ' || label END AS title FROM t""")
def segment_title(spark, d):
    return _spans(spark, d).select("o_orderkey", D.segment_title(F.col("first"), F.col("last"), F.col("city"), F.col("country"), F.lit("C2")).alias("title"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ': a/b?' WHEN 1 THEN 'con' WHEN 2 THEN p_name || '. .' ELSE '' END AS name FROM part),
  q AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', '')) AS s FROM p)
  SELECT p_partkey, CASE WHEN s = '' OR s = 'con' THEN '_' || s ELSE s END AS name FROM q""")
def sanitize(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(": a/b?"))).when(k == 1, "con").when(k == 2, F.concat("p_name", F.lit(". ."))).otherwise("")
    return table(spark, d, "part").select("p_partkey", N.sanitize(name).alias("name"))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y') || '_' || lpad(o_orderkey::VARCHAR, greatest(4, length(o_orderkey::VARCHAR))::INTEGER, '0') || '_' || CASE WHEN o_custkey % 2 = 0 THEN 'Apple iPhone 15' ELSE 'camera' END || ' ' || strftime(o_orderdate + INTERVAL 2 HOUR, '%H.%M.%S') AS name FROM orders""")
def name_pattern(spark, d):
    even = F.col("o_custkey") % 2 == 0
    cam = N.camera(F.when(even, "Apple"), F.when(even, "Apple iPhone 15"))
    name = N.from_pattern("{year}_{n}_{camera} {time}", stem=F.lit("x"), taken_at=F.col("o_orderdate").cast("timestamp"), offset=F.lit(120), index=F.col("o_orderkey"), camera=cam)
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice * l_quantity)::BIGINT AS n FROM lineitem),
  u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS i FROM b), t AS (SELECT *, floor(n / pow(1024.0::DOUBLE, i) * 10 + 0.5)::BIGINT AS t FROM u)
  SELECT l_orderkey, l_linenumber, l_partkey, (t // 10) || CASE WHEN t % 10 <> 0 THEN '.' || (t % 10) ELSE '' END || ' ' || ['B', 'KB', 'MB', 'GB'][i + 1] AS label FROM t""")
def byte_label(spark, d):
    n = F.floor(F.col("l_extendedprice") * F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.byte_label(n).alias("label"))


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 9 >= 5 THEN (p_size + 1) / (p_partkey % 7 + 1) ELSE (p_partkey % 7 + 1) / (p_size + 1) END::DOUBLE, 6) AS ratio, (p_partkey % 7 + 1) * (p_size + 1) / 1e6::DOUBLE AS mpx FROM part""")
def aspect_ratio(spark, d):
    w, h = (F.col("p_partkey") % 7 + 1).cast("double"), (F.col("p_size") + 1).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(M.aspect_ratio(w, h, F.col("p_partkey") % 9), 6).alias("ratio"), M.megapixels(w, h).alias("mpx"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding[1:32] || embedding[1:32], lambda x: x::DOUBLE) AS w FROM embeddings)
  SELECT vec_id, round(list_dot_product(v, w), 6) AS d, round(sqrt(list_dot_product(w, w)), 6) AS n, round((3 * v[1] + w[1]) / 4, 6) AS m FROM e""")
def vector_math(spark, d):
    v = F.col("embedding")
    w = F.concat(F.slice(v, 1, 32), F.slice(v, 1, 32))
    mean = X.weighted_mean(v, w, F.lit(3.0), F.lit(1.0))
    return table(spark, d, "embeddings").select("vec_id", F.round(X.dot(v, w), 6).alias("d"), F.round(X.norm(w), 6).alias("n"), F.round(F.element_at(mean, 1), 6).alias("m"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, list_contains([json_extract_string(props, '$.k')::BIGINT, 1, 2], event_id % 10) AS member FROM events")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    ids = F.from_json(F.concat(F.lit("["), k.cast("string"), F.lit(",1,2]")), "array<long>")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.array_contains(ids, F.col("event_id") % 10).alias("member"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e)
  SELECT vec_id, round(scale, 9) AS scale, list_sum(list_transform(v, lambda x: floor(x / scale + 0.5)))::BIGINT AS total, round(list_sum(list_transform(v, lambda x: floor(x / scale + 0.5) * floor(x / scale + 0.5))) * scale * scale, 6) AS approx FROM s""")
def quantize(spark, d):
    q = table(spark, d, "embeddings").withColumn("q", X.quantised(F.col("embedding")))
    total = F.aggregate("q.q", F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), total.alias("total"), F.round(X.quantised_dot(F.col("q"), F.col("q")), 6).alias("approx"))


@query(A + "SELECT asset_id, round(abs((k % 31) / 30.0::DOUBLE - 0.47) + (k % 11) / 10.0::DOUBLE + greatest(0, (k % 7) / 6.0::DOUBLE - 0.05), 6) AS distance FROM assets")
def exposure_distance(spark, d):
    k = F.col("k")
    return assets(spark, d).select("asset_id", F.round(M.exposure_distance((k % 31) / 30.0, (k % 11) / 10.0, (k % 7) / 6.0), 6).alias("distance"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT *, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS med FROM e)
  SELECT vec_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', (CASE WHEN v[i * 4 + 1] > med THEN 8 ELSE 0 END + CASE WHEN v[i * 4 + 2] > med THEN 4 ELSE 0 END
    + CASE WHEN v[i * 4 + 3] > med THEN 2 ELSE 0 END + CASE WHEN v[i * 4 + 4] > med THEN 1 ELSE 0 END)::BIGINT + 1, 1)), '') AS hash FROM m""")
def sign_hash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", X.sign_hash(F.col("embedding")).alias("hash"))


@query("""WITH c AS (SELECT c_custkey, abs((c_custkey % 1200) / 10.0::DOUBLE - 60) AS a FROM customer), m AS (SELECT *, floor(a) AS d, floor((a - floor(a)) * 60) AS m FROM c)
  SELECT c_custkey, d::BIGINT || '/1 ' || m::BIGINT || '/1 ' || floor(((a - d) * 60 - m) * 60 * 10000 + 0.5)::BIGINT || '/10000' AS dms FROM m""")
def dms(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.dms((F.col("c_custkey") % 1200) / 10.0 - 60).alias("dms"))


@query(A + "SELECT source_id, (sum((asset_id * 2654435761) % 4294967296) % 4294967296)::BIGINT AS fp, count(*) AS n FROM assets GROUP BY 1")
def fingerprint(spark, d):
    return assets(spark, d).groupBy("source_id").agg(M.fingerprint(F.col("asset_id")).alias("fp"), F.count("*").alias("n"))
