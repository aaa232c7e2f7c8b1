"""Orders of lists, report totals, first rows and visual keepers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightframe.functions import names as N
from lightframe.functions.filters import visible
from lightframe.operators import dedup as U
from lightframe.operators import reconcile as R
from lightframe.plans.registry import query
from lightframe.sources import export as X
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table

V = "NOT hidden AND NOT missing AND NOT trashed"


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderpriority <> '3-MEDIUM'")
def list_orders(spark, d):
    """Proposals: pinned ones first, then the newest; dismissed ones are left out. Places come without a global window."""
    from lightframe.operators.timeline import global_row_number

    rows = table(spark, d, "orders").where("o_orderpriority <> '3-MEDIUM'").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "P").alias("pinned"))
    order = [F.col("pinned").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return global_row_number(rows, order, "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query(A + f"SELECT count(*) AS total, count(*) FILTER (kind = 'video' OR k % 4 <> 0) AS analyzed, sum(size)::BIGINT AS bytes FROM assets WHERE {V}")
def report_totals(spark, d):
    """How much of the library was analysed: videos, and photos with a hash."""
    rows = assets(spark, d).where(visible()).withColumn("phash", F.when(F.col("k") % 4 != 0, F.col("phash")))
    return rows.agg(F.count("*").alias("total"), F.count_if((F.col("kind") == "video") | F.col("phash").isNotNull()).alias("analyzed"), F.sum("size").alias("bytes"))


@query("""SELECT DISTINCT 'c' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 AND 'c' || doc_id NOT IN (SELECT 'c' || p_partkey FROM part WHERE p_partkey % 2 = 0)""")
def orphan_companions(spark, d):
    gone = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("companion_path"))
    there = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("path"))
    return R.orphan_companions(gone, there)


@query("""SELECT o_orderkey, 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_120000.NEF' AS name, 'nef' AS ext, 'photo' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS day, 'filename' AS date_source, true AS is_raw, false AS is_screenshot, 'src/' || (o_custkey % 7) AS rel_dir FROM orders""")
def initial_rows(spark, d):
    """First catalogue rows of a listing: kind, flags and date from names."""
    path = F.concat(F.lit("src/"), (F.col("o_custkey") % 7).cast("string"), F.lit("/IMG_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_120000.NEF"))
    listing = table(spark, d, "orders").select("o_orderkey", path.alias("path"), F.lit(5).alias("length"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"))
    made = X.initial_rows(listing.drop("o_orderkey").distinct(), now=F.lit("2024-01-01").cast("timestamp"))
    return listing.select("o_orderkey", "path").join(made, "path").select("o_orderkey", "name", "ext", "kind", "day", "date_source", "is_raw", "is_screenshot", "rel_dir")


_PARTS = """WITH r AS (SELECT p_partkey, p_brand, p_size, p_partkey % 5 = 0 AS favorite, p_partkey % 7 = 0 AS in_album, (p_partkey % 9 + 1) * 1000 * (p_size * 100) / 1e6::DOUBLE AS mpx, p_partkey % 3 = 0 AS orig, p_retailprice AS size FROM part),
  s AS (SELECT *, 1000 * favorite::INTEGER + 500 * in_album::INTEGER + 10 * mpx + 5 * orig::INTEGER + 0.5::DOUBLE + size / 1e10::DOUBLE AS score FROM r)
"""


def _parts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey", "p_brand", (k % 5 == 0).alias("favorite"), (k % 7 == 0).alias("in_album"), ((k % 9 + 1) * 1000).alias("width"), (F.col("p_size") * 100).alias("height"), F.when(k % 3 == 0, "jpg").otherwise("png").alias("ext"),
        F.lit(0.5).alias("quality"), F.col("p_retailprice").alias("size"),
    )


@query(_PARTS + "SELECT p_brand, count(*) AS n, arg_max(p_partkey, (score, -p_partkey)) AS keep_id FROM s GROUP BY 1")
def keeper_visual(spark, d):
    return U.groups(_parts(spark, d), "p_brand", score=U.keep_score("visual"), key="p_partkey").select("p_brand", "n", "keep_id")


@query(_PARTS + """, w AS (SELECT *, row_number() OVER o AS r, lead(mpx) OVER o AS m2, lead(orig) OVER o AS o2, lead(size) OVER o AS s2 FROM s WINDOW o AS (PARTITION BY p_brand ORDER BY score DESC, p_partkey)),
  f AS (SELECT p_brand, p_partkey AS keep_id, list_filter([CASE WHEN favorite THEN 'favourite' END, CASE WHEN mpx > m2 * 1.2 THEN 'best resolution' END, CASE WHEN orig AND NOT o2 THEN 'original format' END, CASE WHEN size > s2 * 1.3 THEN 'most complete' END], lambda x: x IS NOT NULL) AS l FROM w WHERE r = 1)
  SELECT p_brand, keep_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'equal quality' END AS reasons FROM f""")
def visual_reasons(spark, d):
    return U.visual_reasons(_parts(spark, d), "p_brand", key="p_partkey").select("p_brand", "keep_id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH r AS (SELECT p_partkey, p_brand, p_partkey % 5 = 0 AS favorite, p_partkey % 7 = 0 AS in_album, p_partkey % 4 = 0 AS dirc, p_partkey % 3 = 0 AS namec, CASE WHEN p_partkey % 4 = 0 THEN 'copies' ELSE 'photos' END AS dir FROM part),
  s AS (SELECT *, 100 * favorite::INTEGER + 50 * in_album::INTEGER - 20 * dirc::INTEGER - 15 * namec::INTEGER - 6 / 1000.0::DOUBLE - (p_partkey * 1000) / 1e15::DOUBLE AS score FROM r),
  w AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM s), c AS (SELECT p_brand, bool_or(dirc OR namec) AS c FROM w WHERE r > 1 GROUP BY 1),
  f AS (SELECT p_brand, p_partkey AS keep_id, list_filter([CASE WHEN favorite THEN 'favourite' END, CASE WHEN in_album THEN 'in an album' END, CASE WHEN c AND NOT dirc THEN 'others look like copies' END], lambda x: x IS NOT NULL) AS l FROM w LEFT JOIN c USING (p_brand) WHERE r = 1)
  SELECT p_brand, keep_id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'first imported' END AS reasons FROM f""")
def exact_reasons(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", "p_brand", (k % 5 == 0).alias("favorite"), (k % 7 == 0).alias("in_album"), F.when(k % 4 == 0, "copies").otherwise("photos").alias("rel_dir"), F.when(k % 3 == 0, "a copy").otherwise("a").alias("name"),
        F.lit("mtime").alias("date_source"), F.timestamp_millis(k * 1000).alias("added_at"),
    )
    return U.exact_reasons(rows, "p_brand", key="p_partkey").select("p_brand", "keep_id", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT doc_id, regexp_matches(source, '(1|2)$') AS dir_copy, doc_id % 4 = 0 AS name_copy FROM documents""")
def copy_marks(spark, d):
    """Folders and names that look like copies."""
    i = F.col("doc_id")
    folder = F.when(F.col("source").rlike("(1|2)$"), F.concat(F.lit("WhatsApp/"), "source")).otherwise(F.lit("photos"))
    name = F.when(i % 4 == 0, F.concat(F.lit("a"), i.cast("string"), F.lit(" (2).jpg"))).otherwise(F.concat(F.lit("a"), i.cast("string"), F.lit("x.jpg")))
    in_dir, in_name = N.looks_like_copy(folder, name)
    return table(spark, d, "documents").select("doc_id", in_dir.alias("dir_copy"), in_name.alias("name_copy"))
