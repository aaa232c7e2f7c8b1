"""The registered queries of this subpackage: each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.llm.oracles import OP5_SQL, OP6_SQL, OP7_SQL, OP11_SQL, OP12_SQL, OP13_SQL
from lightframe.llm.shared import documents, stash


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.secret_scan import report, scan

    return report(scan(documents(spark, sf_dir)))


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture and its three later requests (see `records_of_pages`), resolved."""
    from lightframe.llm.warc_revisit import records_of_pages, resolve

    made = resolve(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return made.withColumn("headers", listed)


OP2_SQL = """
WITH v AS (
  SELECT page_id, url, visit, page_id * 4 + visit AS record_id, page_id + visit * 1000003 AS happened,
    sha256(coalesce(html, '')) AS digest, substr(sha256(coalesce(html, '')), 1, 8) AS s
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS visit)),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:[a-z][a-z0-9+.-]*)://', '') AS b FROM v),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), '^www\\d?\\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/index\\.html?$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains(
      ['ref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'sessionid'], lower(split_part(p, '=', 1))))) AS q
  FROM bare),
r AS (
  SELECT record_id, happened, visit, digest, s, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url,
    CASE WHEN visit = 3 AND substr(s, 8, 1) IN ('0','2','4','6','8','a','c','e') THEN 'new-' || s ELSE s END AS tag
  FROM parts),
j AS (
  SELECT r.*, f.record_id AS t_id, f.digest AS t_digest, f.tag AS t_tag, f.s AS t_s
  FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE visit = 0) f ON r.canonical_url = f.canonical_url AND r.happened > f.happened),
k AS (
  SELECT *, CASE WHEN visit = 0 THEN 'full' WHEN t_id IS NULL THEN 'unresolved' WHEN tag = t_tag THEN 'resolved' ELSE 'changed' END AS status FROM j)
SELECT record_id, canonical_url, visit > 0 AS is_revisit, CASE WHEN visit > 0 THEN t_id END AS target_id, status,
  CASE WHEN status = 'full' THEN digest WHEN status = 'resolved' THEN t_digest END AS payload_digest,
  CASE WHEN status = 'full' THEN 'Content-Length=' || s || ';Content-Type=text/html;Date=0;ETag="' || s || '"'
       WHEN status = 'resolved' THEN 'content-length=' || t_s || ';content-type=text/html;date=' || visit || ';etag="' || s || '"'
       ELSE 'Content-Length=0;Date=' || visit || ';etag=' || CASE WHEN tag <> s THEN 'W/"' ELSE '"' END || tag || '"' END AS headers
FROM k
"""


def op3_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.media_archive import round_trip

    return round_trip(documents(spark, sf_dir))


def op4_shard_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.shard_sort import shard

    dealt = shard(documents(spark, sf_dir), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.minhash_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.substring_dedup import remove_repeats, report

    return report(remove_repeats(documents(spark, sf_dir), window=35))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.decontaminate import find_spans, report

    return report(find_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), piece_model(), limit=4096)


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.quality_qda import fit, score, statistics

    stats = stash(statistics(documents(spark, sf_dir)), "statistics")
    return score(stats, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def op10_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.piece_viterbi import transcoded

    return transcoded(documents(spark, sf_dir), piece_model())


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.fill_middle import cut, digests, in_order

    return digests(in_order(cut(documents(spark, sf_dir), seed=42, rate=50, spm=80)))


def op12_centroid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lightframe.llm.centroid_search import clustered, report

    return report(*clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dims=64, scale=64, seed=1))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of number -1 whose texts are made of the template's own control strings."""
    from lightframe.llm.chat_format import formatted, report

    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return report(formatted(given.unionByName(own)))


_ALL = (
    op1_secret_scan, op2_warc_revisit, op3_media_archive, op4_shard_sort, op5_minhash_dedup, op6_substring_dedup, op7_decontaminate, op8_token_counts, op9_quality_qda, op10_piece_viterbi,
    op11_fill_middle, op12_centroid_search, op13_chat_format,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op2_warc_revisit": OP2_SQL, "op5_minhash_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL,
    "op11_fill_middle": OP11_SQL, "op12_centroid_search": OP12_SQL, "op13_chat_format": OP13_SQL,
}
