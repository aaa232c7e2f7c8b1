"""Shares, likes and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_shares(shares: DataFrame, albums: DataFrame, *, now: Column) -> DataFrame:
    """Shares that aren't revoked or past their end and whose album exists."""
    return shares.where(~F.col("revoked") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).join(albums.select("album_id").distinct(), "album_id")


def like_state(toggles: DataFrame, *by: str) -> DataFrame:
    """A like stands while it was toggled an odd number of times; a member counts by id, else by name."""
    member = F.coalesce(F.col("member_id").cast("string"), F.concat(F.lit("name:"), F.lower("author")))
    return toggles.groupBy(*by, member.alias("member")).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*by, "member")


def with_likes(rows: DataFrame, likes: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """Adds sorted arrays of authors and member ids."""
    grouped = likes.groupBy(key).agg(F.array_sort(F.collect_list("author")).alias("authors"), F.array_sort(F.collect_list("member_id")).alias("members"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(grouped.schema[c].dataType)).alias(c)
    return rows.join(grouped, key, "left").select(*rows.columns, empty("authors"), empty("members"))


def unseen_activity(comments: DataFrame, uploads: DataFrame, *, seen: str = "seen") -> DataFrame:
    """Unseen comments and uploads per album."""
    both = comments.select("album_id", seen, F.lit(1).alias("c"), F.lit(0).alias("u")).unionByName(uploads.select("album_id", seen, F.lit(0).alias("c"), F.lit(1).alias("u")))
    return both.where(~F.col(seen)).groupBy("album_id").agg(F.sum("c").alias("comments"), F.sum("u").alias("uploads"))
