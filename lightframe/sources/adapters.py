"""The driver's tables seen as a media catalogue, by deterministic arithmetic; the SQL below repeats it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as assets: one row each, with place, hash and state columns derived from id, type, value and props."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, i = F.col("k"), F.col("event_id")
    placed = k % 3 != 0
    return e.select(
        i.alias("asset_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("taken_at"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_type") == "view", "video").otherwise("photo").alias("kind"), F.least(F.lit(1.0), F.col("value") / 100).alias("quality"),
        (F.col("event_type") == "purchase").alias("favorite"), (F.col("event_type") == "error").alias("is_screenshot"), (i % 13 == 0).alias("is_live"), (i % 29 == 0).alias("is_raw"),
        F.floor(F.col("value") * 1_000_000).cast("long").alias("size"), k, F.col("event_type"),
        (i % 17 == 0).alias("hidden"), (i % 19 == 0).alias("missing"), (i % 23 == 0).alias("trashed"),
        F.when(placed, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("city"), F.when(placed & (k % 11 != 0), F.concat(F.lit("N"), (k % 2).cast("string"))).alias("country"),
        F.when(placed, F.lit(40.0) + (k % 5) * F.lit(0.1)).alias("lat"), F.when(placed, (k % 7) * F.lit(0.1)).alias("lon"),
        F.pow(F.lit(2.0), (k % 6 - 8).cast("double")).alias("exposure"), F.concat(F.lit("M"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.substring(F.md5(F.col("event_type").cast("binary")), 1, 16).alias("phash"), F.substring(F.md5(i.cast("string").cast("binary")), 1, 16).alias("qhash"),
    )


ASSETS_SQL = """WITH assets AS (
  SELECT event_id AS asset_id, user_id AS source_id, ts AS taken_at, strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN event_type = 'view' THEN 'video' ELSE 'photo' END AS kind, least(1.0, value / 100) AS quality,
    event_type = 'purchase' AS favorite, event_type = 'error' AS is_screenshot, event_id % 13 = 0 AS is_live, event_id % 29 = 0 AS is_raw,
    floor(value * 1000000)::BIGINT AS size, k, event_type,
    event_id % 17 = 0 AS hidden, event_id % 19 = 0 AS missing, event_id % 23 = 0 AS trashed,
    CASE WHEN k % 3 <> 0 THEN 'C' || (k % 5) END AS city, CASE WHEN k % 3 <> 0 AND k % 11 <> 0 THEN 'N' || (k % 2) END AS country,
    CASE WHEN k % 3 <> 0 THEN 40.0::DOUBLE + (k % 5) * 0.1::DOUBLE END AS lat, CASE WHEN k % 3 <> 0 THEN (k % 7) * 0.1::DOUBLE END AS lon,
    pow(2.0::DOUBLE, k % 6 - 8) AS exposure, 'M' || (user_id % 3) AS model,
    substr(md5(event_type), 1, 16) AS phash, substr(md5(event_id::VARCHAR), 1, 16) AS qhash
  FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as files: content, size, folder, name, album."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("content"), F.col("n_chars").alias("size"), F.col("source").alias("rel_dir"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("lang").alias("album"))
