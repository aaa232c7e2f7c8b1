"""WARC: not-modified revisits resolved against the latest earlier full response of the same canonical URL.

An as-of join without a group in one task: records are cut into time chunks of about equal counts. Per URL and chunk the
last full response is found by a partial aggregate; a small window over these (at most one row a URL and chunk) carries
it to later chunks, and a window within one URL and chunk finds the nearer ones. So however many captures a URL has, no
task holds more than a chunk of them; records travel without payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.llm.shared import stash

CHUNKS = 512
#: Headers that a not-modified answer may change (RFC 9110, 15.4.5, and RFC 9111, 3.2); the others stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")
#: Query parameters that don't tell pages apart.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Scheme and a leading www. dropped, host in lower case without default port, fragment and tracking parameters
    dropped, other parameters sorted, no trailing slash or index.html; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i:[a-z][a-z0-9+.-]*)://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\d?\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), r"/index\.html?$", "/"), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever its letters' case; null if absent."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), 0)["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers with those that the not-modified answer may change; names in lower case."""
    entries = lambda m: F.transform(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    new = F.filter(entries(fresh), lambda e: e["key"].isin(*PERMITTED))
    old = F.filter(entries(stored), lambda e: ~F.exists(new, lambda n: n["key"] == e["key"]))
    both = F.array_sort(F.array_distinct(F.concat(old, new)))
    # of names that differ only by case the greatest value stays
    return F.map_from_entries(F.filter(both, lambda e: ~F.exists(both, lambda o: (o["key"] == e["key"]) & (F.coalesce(o["value"], F.lit("")) > F.coalesce(e["value"], F.lit(""))))))


def resolve(records: DataFrame, *, chunks: int = CHUNKS) -> DataFrame:
    """One row per record: record_id, canonical_url, is_revisit, target_id, status, payload_digest, headers.

    `records`: record_id, url, captured_at (timestamp), is_revisit (boolean), headers (map of strings), digest (of the
    payload; null where a revisit names none). A revisit takes the latest response before it (by captured_at, then
    record_id) of its canonical URL. status: `full` for responses; `resolved` if the validators agree (each of etag,
    without its weak mark, last-modified and digest that both have is equal); `changed` if one differs; `unresolved`
    without an earlier response. Resolved rows have the target's digest and merged headers, others their own.
    Rows with a null URL or time are resolved with nothing; is_revisit null means false. Rows with equal id, URL and time
    count as captured at once: none is another's target. Other columns are not read; empty tables give empty results."""
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"),
        F.regexp_replace(header(F.col("headers"), "etag"), "^W/", "").alias("etag"), header(F.col("headers"), "last-modified").alias("last_modified"), "digest", "headers",
    )
    r = stash(r, "records")
    cuts = r.select(F.percentile_approx(F.col("captured_at").cast("double"), [i / chunks for i in range(1, chunks)], 20 * chunks).alias("c")).first()["c"] or []
    # the number of cuts below the time, by binary search over a literal array
    table = F.array(*(F.lit(float(c)) for c in cuts)) if cuts else F.array(F.lit(0.0))
    steps, step = [], 1 << max(0, len(cuts).bit_length() - 1)
    while step and cuts:
        steps.append(step)
        step >>= 1
    seconds = F.col("captured_at").cast("double")
    chunk = F.aggregate(F.array(*map(F.lit, steps or [0])), F.lit(0), lambda lo, s: F.when((s > 0) & (lo + s <= len(cuts)) & (F.try_element_at(table, F.greatest(lo + s, F.lit(1))) < seconds), lo + s).otherwise(lo))
    r = r.withColumn("chunk", chunk)
    full = F.when(~F.col("is_revisit") & F.col("captured_at").isNotNull(), F.struct("captured_at", "record_id", "etag", "last_modified", "digest"))
    usable = r.where("canonical_url is not null and captured_at is not null").withColumn("full", full)
    last = usable.where("full is not null").groupBy("canonical_url", "chunk").agg(F.max("full").alias("last"))
    # a row for each URL and chunk that has records: what came before it
    present = usable.groupBy("canonical_url", "chunk").agg(F.lit(1).alias("one")).join(last, ["canonical_url", "chunk"], "left")
    earlier = Window.partitionBy("canonical_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = present.select("canonical_url", "chunk", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    # of equal times and ids revisits come first, so that no response at that instant is theirs
    before = Window.partitionBy("canonical_url", "chunk").orderBy("captured_at", "record_id", F.col("is_revisit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    w = usable.withColumn("in_chunk", F.last("full", ignorenulls=True).over(before))
    w = w.join(carried, ["canonical_url", "chunk"], "left").withColumn("t", F.when(F.col("is_revisit"), F.coalesce("in_chunk", "carried")))
    agrees = lambda c: F.coalesce(F.col(c) == F.col(f"t.{c}"), F.lit(True))
    status = F.when(~F.col("is_revisit"), "full").when(F.col("t").isNull(), "unresolved").when(agrees("etag") & agrees("last_modified") & agrees("digest"), "resolved").otherwise("changed")
    w = w.withColumn("status", status).withColumn("target_id", F.when(F.col("t").isNotNull(), F.col("t.record_id")))
    w = w.select("record_id", "canonical_url", "is_revisit", "target_id", "status", F.when(F.col("status") == "resolved", F.col("t.digest")).otherwise(F.col("digest")).alias("payload_digest"), "headers", F.when(F.col("status") == "resolved", F.col("t.captured_at")).alias("target_at"))
    # the stored headers of targets, by an equi-join that adaptive execution can split where one target is named often
    stored = r.where(~F.col("is_revisit")).groupBy(F.col("record_id").alias("target_id"), "canonical_url", F.col("captured_at").alias("target_at")).agg(F.max_by(F.map_entries("headers"), F.coalesce(F.col("digest"), F.lit(""))).alias("stored"))
    done = w.join(stored, ["target_id", "canonical_url", "target_at"], "left").withColumn("headers", F.when(F.col("status") == "resolved", merged_headers(F.map_from_entries("stored"), F.col("headers"))).otherwise(F.col("headers")))
    out = ["record_id", "canonical_url", "is_revisit", "target_id", "status", "payload_digest", "headers"]
    rest = r.where("canonical_url is null or captured_at is null").select(
        "record_id", "canonical_url", "is_revisit", F.lit(None).cast(records.schema["record_id"].dataType).alias("target_id"),
        F.when(F.col("is_revisit"), "unresolved").otherwise("full").alias("status"), F.col("digest").alias("payload_digest"), "headers",
    )
    return done.select(*out).unionByName(rest.select(*out))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log over the whole of `pages` (page_id, url, html), with the fields of `resolve`.

    Every page is captured when it is found (a full response, at its id's second) and asked for again three times; the
    answers carry its entity tag, but the third of a page whose checksum is even carries another one."""
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    visits = pages.select("page_id", "url", digest.alias("digest"), F.substring(digest, 1, 8).alias("sum"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("visit"))
    renewed = (F.col("visit") == 3) & F.substring("sum", 8, 1).isin(*"02468ace")
    tag = F.concat(F.when(renewed, F.lit('W/"new-')).otherwise(F.lit('"')), F.col("sum"), F.lit('"'))
    first = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Content-Length"), F.col("sum"), F.lit("Date"), F.lit("0"))
    again = F.create_map(F.lit("etag"), tag, F.lit("Date"), F.col("visit").cast("string"), F.lit("Content-Length"), F.lit("0"))
    return visits.select(
        (F.col("page_id") * 4 + F.col("visit")).alias("record_id"), "url", F.timestamp_seconds(F.col("page_id") + F.col("visit") * 1_000_003).alias("captured_at"),
        (F.col("visit") > 0).alias("is_revisit"), F.when(F.col("visit") == 0, first).otherwise(again).alias("headers"), F.when(F.col("visit") == 0, F.col("digest")).alias("digest"),
    )
