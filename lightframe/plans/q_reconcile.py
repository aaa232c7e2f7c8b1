"""Reconcile, pairing, incremental plans, exports and sharing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightframe.functions.filters import visible
from lightframe.operators import incremental as I
from lightframe.operators import reconcile as R
from lightframe.operators import sharing as H
from lightframe.operators import timeline as T
from lightframe.plans.registry import query
from lightframe.sources import export as X
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table

V = "NOT hidden AND NOT missing AND NOT trashed"


def _snapshots(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    a = f.where("doc_id % 10 <> 0").withColumn("is_missing", F.col("doc_id") % 13 == 0)
    b = f.where("doc_id % 10 <> 1").withColumn("size", F.col("size") + (F.col("doc_id") % 7 == 0).cast("int"))
    return a, b


@query("""SELECT source || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 10 = 0 THEN 'insert' WHEN doc_id % 10 = 1 THEN CASE WHEN doc_id % 13 = 0 THEN 'unchanged' ELSE 'missing' END
  WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 13 = 0 THEN 'reappeared' ELSE 'unchanged' END AS action FROM documents""")
def reconcile(spark, d):
    a, b = _snapshots(spark, d)
    return R.reconcile(a, b).select("path", "action")


@query("""SELECT source || '/' || doc_id || '.txt' AS path, (n_chars + CASE WHEN doc_id % 10 <> 1 AND doc_id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS size, CASE WHEN doc_id % 10 = 1 THEN true ELSE false END AS is_missing,
  CASE WHEN doc_id % 10 NOT IN (0, 1) AND doc_id % 7 = 0 THEN 3 WHEN doc_id % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS thumb_v FROM documents""")
def catalogue_after(spark, d):
    a, b = _snapshots(spark, d)
    rows = a.withColumns({"missing_at": F.lit(None).cast("timestamp"), "thumb_v": F.lit(2), "meta_state": F.lit(1)})
    out = R.apply_reconcile(rows, R.reconcile(a, b), now=F.lit("2024-05-01").cast("timestamp"))
    return out.select("path", F.col("size").cast("long").alias("size"), "is_missing", F.col("thumb_v").cast("long").alias("thumb_v"))


@query("SELECT DISTINCT source || '/' || doc_id || '.txt' AS path FROM documents WHERE source IN ('src1', 'src12')")
def vanished_folders(spark, d):
    a = table(spark, d, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    gone = table(spark, d, "documents").where("source in ('src1', 'src12')").select(F.col("source").alias("folder"))
    return R.vanished_under(a, gone)




@query("""SELECT o_orderkey, o_orderpriority = '1-URGENT' AND exists(SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = '5-LOW') AS companion_hidden,
  CASE WHEN o_orderpriority = '5-LOW' THEN (SELECT max(o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = '1-URGENT')::VARCHAR END AS companion_path FROM orders o""")
def pair_companions(spark, d):
    """Raw and developed files of one stem: urgent orders stand for raw files, low ones for developed ones."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("path"))
    p = F.col("o_orderpriority")
    out = R.pair_companions(rows, "o_custkey", main=p == "5-LOW", companion=p == "1-URGENT", key="o_orderkey")
    return out.select("o_orderkey", "companion_hidden", "companion_path")


@query("""WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 100) / 10.0::DOUBLE END AS dur FROM orders)
  SELECT o_orderkey, o_orderstatus = 'P' AND (dur IS NULL OR dur <= 6) AND exists(SELECT 1 FROM o x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F') AS companion_hidden FROM o""")
def pair_live(spark, d):
    """Photos and their short videos: videos of over six seconds stay visible."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(k % 5 != 0, (k % 100) / 10.0).alias("duration"), k.cast("string").alias("path"))
    short = (F.col("o_orderstatus") == "P") & (F.col("duration").isNull() | (F.col("duration") <= 6))
    return R.pair_companions(rows, "o_custkey", main=F.col("o_orderstatus") == "F", companion=short, key="o_orderkey").select("o_orderkey", "companion_hidden")


@query(A + """SELECT asset_id, CASE asset_id % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'jpeg' ELSE 'edit' END AS kind, CASE WHEN asset_id % 3 = 0 AND asset_id + 1 IN (SELECT asset_id FROM assets) THEN asset_id + 1
  WHEN asset_id % 3 = 2 AND asset_id * 2 IN (SELECT asset_id FROM assets) THEN asset_id * 2 END AS version_of FROM assets""")
def link_versions(spark, d):
    i = F.col("asset_id")
    group = F.concat(F.lit("["), F.floor(i / 3).cast("string"), F.lit("]"))
    rows = assets(spark, d).select("asset_id", F.when(i % 3 == 0, "master").when(i % 3 == 1, "jpeg").otherwise("edit").alias("kind"), F.when(i % 3 == 2, F.concat(F.lit("["), (i * 2).cast("string"), F.lit(",7]"))).otherwise(group).alias("sources"), F.lit(1).alias("created_at"))
    return R.link_versions(rows)


@query("SELECT 'src' || (doc_id % 20) AS folder, CASE WHEN doc_id % 4 = 0 THEN (doc_id // 4) * 4 + 1 ELSE doc_id END AS asset_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 20 <> 6 AND (doc_id % 4 <> 0 OR (doc_id // 4) * 4 + 1 IN (SELECT doc_id FROM documents))")
def link_once(spark, d):
    """New members after a first batch (odd ids) is in the ledger and one album was deleted; every fourth file is hidden."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    links = docs.select(F.concat(F.lit("a"), i.cast("string")).alias("alias_path"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("folder"), i.cast("string").alias("target"))
    catalogue = docs.select(i.cast("string").alias("path"), i.alias("asset_id"), (i % 4 == 0).alias("hidden"), F.floor(i / 4).alias("group_key"))
    ledger = docs.where(i % 2 == 1).select(F.concat(F.lit("a"), i.cast("string")).alias("alias_path"))
    deleted = docs.where(i % 20 == 6).select(F.lit("src6").alias("folder"))
    return R.link_once(ledger, links, catalogue, deleted)[1]


@query("""WITH m AS (SELECT o_custkey AS album_id, o_orderkey AS asset_id FROM orders), r AS (SELECT DISTINCT m.album_id, l_orderkey * 10 AS asset_id FROM lineitem JOIN m ON m.asset_id = l_partkey)
  SELECT * FROM r EXCEPT SELECT * FROM m""")
def propagate_albums(spark, d):
    members = table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), F.col("o_orderkey").alias("asset_id"))
    results = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10).alias("asset_id")).agg(F.collect_list("l_partkey").alias("source_ids"))
    return R.propagate(results, members)


@query("""SELECT asset_id, path FROM (SELECT event_id AS asset_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['p' || event_id, 'c' || event_id] ELSE ['p' || event_id] END) AS path FROM events WHERE event_id % 23 = 0)
  WHERE path NOT IN (SELECT 'p' || doc_id FROM documents)""")
def purge_set(spark, d):
    i = F.col("asset_id")
    rows = assets(spark, d).select("asset_id", "trashed", F.concat(F.lit("p"), i.cast("string")).alias("path"), F.when(i % 2 == 0, F.concat(F.lit("c"), i.cast("string"))).alias("companion_path"))
    return R.purge_set(rows, table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)")
def set_diff(spark, d):
    return I.set_diff(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("v"))
    return I.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), key="user_id", version="v").select("user_id", "event_id", "value")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, -1 FROM orders WHERE o_custkey % 2 = 1")
def insert_or_ignore(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
    return I.insert_or_ignore(old, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(-1).cast("long").alias("n")), key="c_custkey")


_PLAN = "WITH o AS (SELECT o_custkey AS sig, (sum(o_orderkey))::BIGINT AS fp FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1), n AS (SELECT o_custkey AS sig, (sum(o_orderkey))::BIGINT AS fp FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 9 <> 0 GROUP BY 1)\n"


@query(_PLAN + "SELECT coalesce(o.sig, n.sig) AS sig, CASE WHEN o.sig IS NULL THEN 'insert' WHEN n.sig IS NULL THEN 'delete' WHEN o.fp = n.fp THEN 'keep' ELSE 'replace' END AS action FROM o FULL JOIN n ON o.sig = n.sig")
def plan_diff(spark, d):
    o = table(spark, d, "orders")
    fp = lambda df: df.groupBy(F.col("o_custkey").alias("sig")).agg(F.sum("o_orderkey").alias("fp"))
    return I.plan_diff(fp(o.where("o_orderkey % 5 <> 0")), fp(o.where("o_orderkey % 7 <> 0 and o_custkey % 9 <> 0")))


@query("""WITH n AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT o_custkey AS key, count(*) AS n, o_custkey % 2 = 0 AS auto FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 5 <> 0 GROUP BY 1, 3),
  j AS (SELECT n.key, CASE WHEN o.key IS NULL THEN 'insert' WHEN n.n > 1.3 * o.n THEN 'refresh' ELSE 'keep' END AS action, o.key IS NULL AS fresh, auto FROM n LEFT JOIN o USING (key))
  SELECT key, action, fresh OR (action = 'refresh' AND auto) AS retitle FROM j""")
def sync_actions(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    old = o.where("o_orderkey % 4 <> 0 and o_custkey % 5 <> 0").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n")).withColumn("auto_title", F.col("key") % 2 == 0)
    return I.sync_actions(old, n)


@query(A + f"""SELECT o_custkey AS key, count(*) AS n, count(asset_id) AS alive FROM orders LEFT JOIN (SELECT asset_id FROM assets WHERE {V} AND kind = 'video') ON asset_id = o_orderkey WHERE o_custkey % 4 <> 0 GROUP BY 1 HAVING count(asset_id) < least(6, count(*) / 2)""")
def stale_selections(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list("o_orderkey").alias("asset_ids"))
    alive = assets(spark, d).where(visible() & (F.col("kind") == "video"))
    return I.stale_selections(s, alive, protected=F.col("key") % 4 == 0).select("key", F.col("n").cast("long").alias("n"), "alive")


@query("SELECT user_id, event_type AS member FROM events WHERE event_type <> 'view' GROUP BY 1, 2 HAVING count(*) % 2 = 1 UNION ALL SELECT user_id, 'name:' || event_type FROM events WHERE event_type = 'view' GROUP BY user_id, event_type HAVING count(*) % 2 = 1")
def like_state(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("member_id"), F.col("event_type").alias("author"))
    return H.like_state(e, "user_id")


@query("SELECT c_custkey, coalesce(authors, '') AS authors FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS authors FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def likes_attach(spark, d):
    likes = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("member_id"))
    return H.with_likes(table(spark, d, "customer").select("c_custkey"), likes, key="c_custkey").select("c_custkey", F.array_join("authors", ",").alias("authors"))


@query("""SELECT album_id, sum(c)::BIGINT AS comments, sum(u)::BIGINT AS uploads FROM (SELECT o_custkey AS album_id, 1 AS c, 0 AS u FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT l_suppkey, 0, 1 FROM lineitem WHERE l_linestatus <> 'F') GROUP BY 1""")
def share_activity(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), (F.col("o_orderstatus") == "F").alias("seen"))
    u = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("album_id"), (F.col("l_linestatus") == "F").alias("seen"))
    return H.unseen_activity(c, u)


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def albums_of_asset(spark, d):
    albums = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(albums, "o_custkey").select("c_name", "o_orderkey")


@query("""SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages WHERE NOT regexp_matches(regexp_replace(url, '[?#].*$', ''), '/[.~][^/]*$') AND regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.html$')""")
def list_filter(spark, d):
    """The rules of a file listing on urls as paths: hidden names and unknown extensions go."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return X.listed(table(spark, d, "pages").select(path.alias("path"), F.length("html").alias("length")), extensions=("html",)).select("path")


@query(A + f"SELECT strftime(taken_at, '%Y') AS year, strftime(taken_at, '%Y-%m') AS year_month, count(*) AS n FROM assets WHERE {V} GROUP BY ALL")
def export_layout(spark, d):
    return X.with_layout(assets(spark, d).where(visible()), offset=F.lit(0)).groupBy("year", "year_month").agg(F.count("*").alias("n"))


@query(A + "SELECT asset_id, CASE WHEN asset_id % 3 = 0 THEN lat END AS lat, CASE WHEN asset_id % 3 <> 2 THEN model END AS model FROM assets")
def export_policy(spark, d):
    """All, no location, no metadata: a policy per row's selection."""
    policy = F.when(F.col("asset_id") % 3 == 0, "all").when(F.col("asset_id") % 3 == 1, "noLocation").otherwise("none")
    return X.with_policy(assets(spark, d).select("asset_id", "lat", "lon", "model"), policy).select("asset_id", "lat", "model")


@query(A + "SELECT asset_id, CASE WHEN kind = 'video' THEN 10 ELSE 1 END::BIGINT AS weight FROM assets WHERE NOT missing AND asset_id IN (SELECT l_orderkey FROM lineitem)")
def export_selection(spark, d):
    return X.selection(assets(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"))).select("asset_id", F.col("weight").cast("long").alias("weight"))


@query(A + f"""SELECT asset_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || printf('%.1f', lon) || ',' || printf('%.1f', lat) || ']}},"properties":{{"id":' || asset_id || '}}}}' AS feature FROM assets WHERE {V} AND lat IS NOT NULL""")
def geojson(spark, d):
    rows = assets(spark, d).where(visible()).withColumns({"lat": F.round("lat", 1), "lon": F.round("lon", 1)})
    return X.geojson(rows)
