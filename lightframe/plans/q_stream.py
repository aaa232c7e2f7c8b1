"""Streams run once over whole tables and read back, and sources and folds beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.operators import vectors as X
from lightframe.operators.graph import shared_folder
from lightframe.plans.q_sessions import SEG as SEGMENTS_SQL
from lightframe.plans.registry import query
from lightframe.sources import export as E
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table
from lightframe.streaming import late as LR
from lightframe.streaming import live as L
from lightframe.streaming.stages import Stage


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _through(df: DataFrame, base: str) -> DataFrame:
    """The rows that a stream appends until its source is read."""
    df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


@query()
def live_moments(spark, d) -> DataFrame:
    """Events streamed once through the stateful segmentation, written to a table and read back."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _stream(spark, d, "events").select(
        F.col("event_id").alias("asset_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("taken_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(k % 3 != 0, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("city"), F.when(k % 3 != 0, F.lit(40.0) + (k % 5) * F.lit(0.1)).alias("lat"), F.when(k % 3 != 0, (k % 7) * F.lit(0.1)).alias("lon"),
    )
    return _through(L.live_segments(rows), shared_folder(spark))


def _settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """`_through` with the store that keyed state needs."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    LR.state_store(spark)
    try:
        return _through(df, shared_folder(spark))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


@query(SEGMENTS_SQL + "SELECT source_id, asset_id, seg, false AS is_late FROM s")
def settled_moments(spark, d) -> DataFrame:
    """Shown events streamed through the segmentation that waits for the watermark."""
    k, i = F.col("k"), F.col("event_id")
    events = _stream(spark, d, "events").where((i % 17 != 0) & (i % 19 != 0) & (i % 23 != 0)).withColumn("k", F.get_json_object("props", "$.k").cast("long"))  # parsed once a row
    rows = events.select(
        i.alias("asset_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("taken_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(k % 3 != 0, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("city"), F.when(k % 3 != 0, F.lit(40.0) + (k % 5) * F.lit(0.1)).alias("lat"), F.when(k % 3 != 0, (k % 7) * F.lit(0.1)).alias("lon"),
    )
    return _settled(spark, LR.settled_segments(rows, delay="0 seconds"))


@query("""WITH h AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, substr(md5((event_id // 4)::VARCHAR), 1, 15) || (event_id % 2 * 7) AS phash FROM events), x AS (SELECT *, ('0x' || substr(phash, 1, 8))::BIGINT AS p, ('0x' || substr(phash, 9, 8))::BIGINT AS q FROM h)
  SELECT m.event_id AS a, n.event_id AS b, (bit_count(xor(m.p, n.p)) + bit_count(xor(m.q, n.q)))::INTEGER AS bits FROM x m JOIN x n ON substr(m.phash, 1, 12) = substr(n.phash, 1, 12) AND m.event_id < n.event_id
  WHERE abs(m.ms - n.ms) <= 864000000 AND bit_count(xor(m.p, n.p)) + bit_count(xor(m.q, n.q)) <= 3""")
def near_arrivals(spark, d) -> DataFrame:
    """Events that resemble each other within ten days, found as they arrive."""
    i = F.col("event_id")
    phash = F.concat(F.substring(F.md5(F.floor(i / 4).cast("string").cast("binary")), 1, 15), (i % 2 * 7).cast("string"))
    rows = _stream(spark, d, "events").select(i.alias("asset_id"), F.col("ts").cast("timestamp").alias("taken_at"), phash.alias("phash"))
    return _settled(spark, LR.near_arrivals(rows, within_seconds=864_000, delay="0 seconds"))


@query("""WITH e AS (SELECT 'u' || (user_id % 50) AS path, ts, event_id AS seq, floor(value)::BIGINT AS size, event_type = 'error' AS gone FROM events),
  f AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path ORDER BY ts, seq)) >= 3600000000, true) AS new FROM e), g AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY path ORDER BY ts, seq) AS n FROM f)
  SELECT path, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS events, arg_max(size, seq) AS size, arg_max(gone, seq) AS gone FROM g GROUP BY path, n
  HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events)""")
def debounced_feed(spark, d) -> DataFrame:
    """Events as changes of fifty paths: one row for each burst that has been quiet for an hour, which stands for the feature's seconds."""
    feed = _stream(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.floor("value").alias("size"), (F.col("event_type") == "error").alias("gone"))
    bursts = LR.debounced(feed, "path", gap="1 hour", delay="0 seconds", fields=("size", "gone"))
    return _through(bursts, shared_folder(spark)).select("path", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms"), "events", "size", "gone")


@query("""WITH e AS (SELECT o_orderkey AS seq, 'g' || (o_custkey % 20) || '/f' || (o_orderkey % 200) AS path, o_custkey % 2 + o_orderkey % 3 AS size, o_orderkey % 5 AS mtime, o_orderstatus = 'F' AS gone FROM orders
    UNION ALL SELECT 10000000 + c_custkey, 'g' || c_custkey, 0, 0, true FROM customer WHERE c_custkey % 20 = 3 AND c_custkey < 20),
  l AS (SELECT path, arg_max(size, seq) AS size, arg_max(mtime, seq) AS mtime, arg_max(gone, seq) AS gone FROM e GROUP BY path),
  c AS (SELECT 'g' || (i % 20) || '/f' || (i % 200) AS path, max(i % 3) AS size, max(i % 5) AS mtime, max(i) % 7 = 0 AS missing FROM (SELECT doc_id AS i FROM documents) GROUP BY 1),
  t AS (SELECT path FROM l UNION SELECT c.path FROM c JOIN l ON l.gone AND starts_with(c.path, l.path || '/')),
  k AS (SELECT c.* FROM c JOIN t USING (path)), n AS (SELECT * FROM l WHERE NOT gone),
  a AS (SELECT coalesce(k.path, n.path) AS path, CASE WHEN k.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN CASE WHEN missing THEN 'unchanged' ELSE 'missing' END
    WHEN k.size <> n.size OR k.mtime <> n.mtime THEN 'changed' WHEN missing THEN 'reappeared' ELSE 'unchanged' END AS action FROM k FULL JOIN n ON k.path = n.path)
  SELECT path, action FROM a WHERE action <> 'unchanged'""")
def change_feed(spark, d) -> DataFrame:
    """Orders as a feed of file changes, with a folder that vanishes last, against a catalogue of documents."""
    i = F.col("doc_id")
    path = lambda g, f: F.concat(F.lit("g"), (g % 20).cast("string"), F.lit("/f"), (f % 200).cast("string"))
    catalogue = table(spark, d, "documents").groupBy(path(i, i).alias("path")).agg(F.max(i % 3).alias("size"), F.max(i % 5).alias("mtime"), (F.max(i) % 7 == 0).alias("is_missing"))
    o = F.col("o_orderkey")
    feed = _stream(spark, d, "orders").select(path(F.col("o_custkey"), o).alias("path"), (F.col("o_custkey") % 2 + o % 3).alias("size"), (o % 5).alias("mtime"), (F.col("o_orderstatus") == "F").alias("gone"), o.alias("seq"))
    folders = table(spark, d, "customer").where("c_custkey % 20 = 3 and c_custkey < 20").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit(True).alias("gone"), (F.col("c_custkey") + 10_000_000).alias("seq"))
    base = shared_folder(spark)
    # an action table keyed by batch: a batch that runs again overwrites its own
    number: list[int] = []
    apply = L.change_batches(lambda: catalogue, lambda actions: actions.write.mode("overwrite").parquet(f"{base}/out/batch={number[-1]}"))

    def each(batch: DataFrame, n: int) -> None:
        number.append(n)
        apply(batch.unionByName(folders, allowMissingColumns=True), n)

    feed.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("path", "action")


@query(A + """, s AS (SELECT asset_id, (k % 4 <> 0)::INTEGER AS meta, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN 2 ELSE 1 END AS thumb, CASE WHEN k % 5 > 0 THEN (k % 3)::INTEGER END AS v FROM assets),
  d AS (SELECT *, meta = 1 AND (thumb = 0 OR coalesce(v, 0) < 2) AS due FROM s)
  SELECT asset_id, CASE WHEN due THEN CASE WHEN asset_id % 9 = 0 THEN 2 ELSE 1 END ELSE thumb END AS thumb, CASE WHEN due THEN 2 ELSE v END AS thumb_version FROM d""")
def staged_work(spark, d) -> DataFrame:
    """One stage over the catalogue: rows that are due go through it, failures are parked, old versions are done again."""
    k = F.col("k")
    rows = assets(spark, d).select("asset_id", (k % 4 != 0).cast("int").alias("meta"), F.when(k % 5 == 0, 0).when(k % 5 == 1, 2).otherwise(1).alias("thumb"), F.when(k % 5 > 0, (k % 3).cast("int")).alias("thumb_version"))
    out = L.staged(rows, "thumb", lambda due: due.select("asset_id", (F.col("asset_id") % 9 != 0).alias("ok")), need="meta", version=2)
    return out.select("asset_id", "thumb", "thumb_version")


@query(A + """SELECT asset_id, CASE WHEN k % 4 = 0 THEN 0 WHEN asset_id % 9 = 0 THEN 2 ELSE 1 END AS state, CASE WHEN k % 4 <> 0 THEN 2 END AS state_version FROM assets""")
def staged_batches(spark, d) -> DataFrame:
    """A stage over the catalogue in three or four batches, the newest first: stopped after one, then resumed; then a newer version of it."""
    rows = assets(spark, d).select("asset_id", "taken_at", (F.col("k") % 4 != 0).cast("int").alias("meta"))
    size = max(1, rows.where("meta = 1").count() // 3)
    work = lambda due: due.select("asset_id", (F.col("asset_id") % 9 != 0).alias("ok"))
    path = f"{shared_folder(spark)}/stage"
    Stage(spark, path, need="meta", batch_rows=size).run(rows, work, most_batches=1)
    Stage(spark, path, need="meta", batch_rows=size).run(rows, work)
    newer = Stage(spark, path, need="meta", version=2, batch_rows=size)
    newer.run(rows, work)
    return newer.state(rows).select("asset_id", "state", "state_version")


@query("SELECT DISTINCT event_type || ':' || floor(value)::BIGINT AS digest FROM events")
def live_exact(spark, d) -> DataFrame:
    """First arrivals of each digest, from a stream that is read once."""
    e = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("taken_at"), F.concat_ws(":", "event_type", F.floor("value").cast("string")).alias("digest"))
    return _through(L.live_exact(e, digest="digest", delay="60 days").select("digest"), shared_folder(spark))


@query("""WITH h AS (SELECT event_id, substr(md5((event_id // 2)::VARCHAR), 1, 15) || (event_id % 2 * 7) AS phash FROM events), x AS (SELECT *, ('0x' || substr(phash, 1, 8))::BIGINT AS a, ('0x' || substr(phash, 9, 8))::BIGINT AS b FROM h)
  SELECT n.event_id, k.event_id AS known_id FROM x n JOIN x k ON (substr(n.phash, 1, 4) = substr(k.phash, 1, 4) OR substr(n.phash, 5, 4) = substr(k.phash, 5, 4)) AND bit_count(xor(n.a, k.a)) + bit_count(xor(n.b, k.b)) <= 3
  WHERE n.event_id % 4 = 1 AND k.event_id % 4 <> 1""")
def live_near(spark, d) -> DataFrame:
    """Arrivals, a quarter of the events, that a known event resembles: a stream against a table."""
    i = F.col("event_id")
    hashed = lambda e: e.select("event_id", F.concat(F.substring(F.md5(F.floor(i / 2).cast("string").cast("binary")), 1, 15), (i % 2 * 7).cast("string")).alias("phash"))
    new = hashed(_stream(spark, d, "events").where("event_id % 4 = 1"))
    known = hashed(table(spark, d, "events").where("event_id % 4 != 1"))
    return _through(L.live_near(new, known, key="event_id"), shared_folder(spark)).distinct()


@query("""WITH RECURSIVE e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
  f AS (SELECT label, i, v AS c FROM e WHERE i = 1 UNION ALL SELECT e.label, e.i, list_transform(list_zip(f.c, e.v), lambda p: (p[1] * least(f.i, 50) + p[2])
    / sqrt(pow(least(f.i, 50), 2) * list_dot_product(f.c, f.c) + 2 * least(f.i, 50) * list_dot_product(f.c, e.v) + list_dot_product(e.v, e.v))) FROM f JOIN e ON e.label = f.label AND e.i = f.i + 1),
  l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1)
  SELECT label::BIGINT AS label, i AS n, unnest(range(1, 65)) AS at, round(unnest(c), 6) AS x FROM l""")
def running_means(spark, d) -> DataFrame:
    """Centroids of labels as means that remember fifty members, taken in order of id."""
    e = table(spark, d, "embeddings")
    return X.running_mean(e, "label").select(F.col("label").cast("long").alias("label"), "n", F.posexplode("centroid").alias("at", "x")).select("label", "n", (F.col("at") + 1).cast("long").alias("at"), F.round("x", 6).alias("x"))


@query("SELECT doc_id, doc_id % 5 < 2 AND strlen(coalesce(text, '')) + 16 < 65536 AS is_shortcut FROM documents")
def shortcut_files(spark, d) -> DataFrame:
    """Contents that begin like alias or shortcut files, and are small."""
    i = F.col("doc_id")
    head = F.when(i % 5 == 0, F.unhex(F.lit("626F6F6B000000006D61726B00000000"))).when(i % 5 == 1, F.unhex(F.lit("4C000000011402000000000000000000"))).otherwise(F.unhex(F.lit("FFD8FFE000104A464946000101000048")))
    files = table(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))
    return files.select("doc_id", E.is_shortcut(F.col("content"), F.octet_length("content")).alias("is_shortcut"))


@query("SELECT s_name AS city, n_name AS country, n_nationkey::VARCHAR AS cc, s_suppkey % 180 - 90.0::DOUBLE AS lat, s_suppkey % 360 - 180.0::DOUBLE AS lon, CASE WHEN s_suppkey % 3 = 0 THEN 'A' || (s_suppkey % 5) END AS admin, s_suppkey * 10 AS population FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def load_cities(spark, d) -> DataFrame:
    """Suppliers written as places in positional arrays, with the names of their countries, and read as a table."""
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    city = F.array("s_name", (s % 180 - 90).cast("string"), (s % 360 - 180).cast("string"), F.col("n_nationkey").cast("string"), F.when(s % 3 == 0, F.concat(F.lit("A"), (s % 5).cast("string"))), (s * 10).cast("string"))
    # a document holds a thousand places at most
    each = rows.groupBy("n_nationkey", "n_name", F.floor(s / 1000).alias("part")).agg(F.collect_list(city).alias("cities"))
    path = f"{shared_folder(spark)}/places"
    each.select(F.to_json(F.struct(F.create_map(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("countries"), "cities"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return E.cities(spark, path, multi_line=False).select("city", "country", "cc", "lat", "lon", "admin", "population")


@query()
def cluster_stream(spark, d) -> DataFrame:
    """Every vector in one batch of clustering against centroids of a tenth of them."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"), (F.col("vec_id") % 10 / 10.0).alias("quality"), "label")
    first = X.centroids(e.where("id % 10 = 5"), "label", emb="emb").select((F.col("label") + 1_000_000).cast("long").alias("id"), "centroid", "n", F.lit(None).cast("string").alias("name"))
    loose = e.limit(0).select("id", "emb", "quality")
    clusters, rest = L.cluster_batch(e.where("id % 10 != 5").select("id", "emb", "quality"), first, loose, join=0.3, found=0.3, merge=0.9)
    return clusters.select("id", "n", F.lit(False).alias("is_loose")).unionByName(rest.select("id", F.lit(1).cast("long").alias("n"), F.lit(True).alias("is_loose")))
