"""Duplicates over documents and bursts over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightframe.functions.filters import visible
from lightframe.operators import dedup as D
from lightframe.plans.registry import query
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, files, table

V = "NOT hidden AND NOT missing AND NOT trashed"


def _sig(key: str) -> str:
    """SQL of the signature of a group of keys."""
    part = lambda i: f"sum(('0x' || substr(md5({key}::VARCHAR), {i}, 8))::BIGINT)::BIGINT"
    return f"count(*) || ':' || min({key}) || ':' || {part(1)} || ':' || {part(9)}"


@query("SELECT min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def exact_dups(spark, d):
    rows = files(spark, d).withColumn("qhash", F.sha2(F.encode("content", "UTF-8"), 256))
    return D.exact_groups(rows, key="doc_id").select("group_id", "n")


@query("""WITH g AS (SELECT doc_id, lang, source, sha256(text) AS h, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents),
  k AS (SELECT lang, source, doc_id AS keep_id, h AS kh FROM g WHERE r = 1)
  SELECT g.lang, g.source, g.doc_id, keep_id, CASE WHEN h = kh THEN 'verified' ELSE 'skipped' END AS outcome FROM g JOIN k USING (lang, source) WHERE g.doc_id <> keep_id""")
def verify_dups(spark, d):
    rows = table(spark, d, "documents").withColumn("content", F.encode("text", "UTF-8"))
    return D.verify_copies(rows, "lang", "source", keep=F.struct("n_chars", "doc_id")).select("lang", "source", "doc_id", "keep_id", "outcome")


def _burst_rows(spark, d):
    return assets(spark, d).where(visible()).withColumns({"ext": F.lit("jpg"), "width": F.lit(4000), "height": F.lit(3000)})


BURST = A + f""", v AS (SELECT *, epoch_us(taken_at) // 1000 AS ms FROM assets WHERE {V}),
p AS (SELECT a.asset_id AS a, b.asset_id AS b, 
  bit_count(xor(('0x' || substr(a.phash, 1, 8))::BIGINT, ('0x' || substr(b.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.phash, 9, 8))::BIGINT, ('0x' || substr(b.phash, 9, 8))::BIGINT)) AS bits
  FROM v a JOIN v b ON b.ms BETWEEN a.ms AND a.ms + 20000 AND (b.ms > a.ms OR b.asset_id > a.asset_id)),
pairs AS (SELECT a, b, bits::BIGINT AS bits FROM p WHERE bits <= 14)
"""


@query(BURST + "SELECT * FROM pairs")
def burst_pairs(spark, d):
    """All pairs of photos of like hash within 20 s. The feature looks at 39 successors only, which `successors` gives."""
    return D.burst_pairs(_burst_rows(spark, d), successors=None).select("a", "b", F.col("bits").cast("long").alias("bits"))


@query("WITH RECURSIVE " + BURST.removeprefix("WITH ") + """, e AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
  reach(node, other) AS (SELECT u, u FROM e UNION SELECT reach.node, e.v FROM reach JOIN e ON e.u = reach.other) SELECT node, min(other) AS component FROM reach GROUP BY node""")
def components(spark, d):
    return D.burst_groups(_burst_rows(spark, d))


@query("WITH RECURSIVE " + BURST.removeprefix("WITH ") + """, e AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
  reach(node, other) AS (SELECT u, u FROM e UNION SELECT reach.node, e.v FROM reach JOIN e ON e.u = reach.other), c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
  SELECT component, count(*) AS n, """ + _sig("node") + """ AS signature, arg_max(asset_id, (1000 * favorite::INTEGER + 100 * quality + 1.2, -asset_id)) AS keep_id,
    (sum(size) - arg_max(size, (1000 * favorite::INTEGER + 100 * quality + 1.2, -asset_id)))::BIGINT AS reclaimable FROM c JOIN assets ON asset_id = node GROUP BY component""")
def keeper_burst(spark, d):
    """Burst groups of any size with keeper, signature and bytes to reclaim; the feature leaves out those of over 60."""
    rows = _burst_rows(spark, d)
    of = rows.join(D.burst_groups(rows), F.col("asset_id") == F.col("node")).withColumn("in_album", F.lit(False))
    return D.groups(of, "component", score=D.keep_score("burst")).drop("group_id")


_EXACT = """WITH f AS (SELECT doc_id, sha256(text) AS h, source AS rel_dir, n_chars AS size, doc_id % 11 = 0 AS favorite, doc_id % 7 = 0 AS in_album,
  doc_id || CASE WHEN doc_id % 4 = 0 THEN ' copy' ELSE '' END AS name FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, 100 * favorite::INTEGER + 50 * in_album::INTEGER + 5 * (doc_id % 2 = 0)::INTEGER - 15 * (doc_id % 4 = 0)::INTEGER - length(rel_dir) / 1000.0::DOUBLE - (doc_id * 1000) / 1e15::DOUBLE AS score FROM f)
"""


@query(_EXACT + """SELECT min(doc_id) AS group_id, count(*) AS n, """ + _sig("doc_id") + """ AS signature, arg_max(doc_id, (score, -doc_id)) AS keep_id, (sum(size) - arg_max(size, (score, -doc_id)))::BIGINT AS reclaimable
  FROM s GROUP BY h HAVING count(*) > 1""")
def keeper_exact(spark, d):
    i = F.col("doc_id")
    rows = files(spark, d).where("content is not null").select(
        "doc_id", F.sha2(F.encode("content", "UTF-8"), 256).alias("h"), "rel_dir", "size", (i % 11 == 0).alias("favorite"), (i % 7 == 0).alias("in_album"), F.when(i % 2 == 0, "exif").otherwise("mtime").alias("date_source"),
        F.concat(i.cast("string"), F.when(i % 4 == 0, " copy").otherwise(""), F.lit(".txt")).alias("name"), F.timestamp_millis(i * 1000).alias("added_at"),
    )
    g = D.groups(rows, "h", score=D.keep_score("exact"), key="doc_id").where("n > 1")
    return g.select("group_id", "n", "signature", "keep_id", "reclaimable")


@query(_EXACT + """, g AS (SELECT """ + _sig("doc_id") + """ AS signature, min(doc_id) AS m, count(*) AS n FROM s GROUP BY h HAVING count(*) > 1) SELECT signature, n FROM g WHERE m % 3 <> 0""")
def ignored_groups(spark, d):
    """Groups left when some signatures are ignored."""
    g = keeper_exact(spark, d)
    return D.without_ignored(g, g.where("group_id % 3 = 0")).select("signature", "n")


@query()
def keeper_reasons(spark, d):
    k = F.col("k")
    rows = _burst_rows(spark, d).withColumns({"in_album": F.lit(False), "sharpness": (k % 90).cast("double"), "brightness": (k % 31) / 30.0, "clip_dark": (k % 7) / 6.0, "clip_bright": (k % 11) / 10.0})
    of = rows.join(D.burst_groups(rows), F.col("asset_id") == F.col("node"))
    return D.burst_reasons(of, "component").select("component", "keep_id", F.array_join("reasons", ",").alias("reasons"))


SIM = """WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT doc_id, unnest(range(64)) AS i, md5(w) AS m FROM w),
c AS (SELECT doc_id, i, sum(CASE WHEN (('0x' || substr(m, 1 + 8 * (i // 32), 8))::BIGINT >> (31 - i % 32)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM b GROUP BY ALL),
h AS (SELECT doc_id, i // 32 AS half, sum(CASE WHEN s > 0 THEN 1::BIGINT << (31 - i % 32) ELSE 0 END)::BIGINT AS v FROM c GROUP BY ALL),
f AS (SELECT doc_id, printf('%08x', max(v) FILTER (half = 0)) || printf('%08x', max(v) FILTER (half = 1)) AS phash FROM h GROUP BY doc_id)
"""


@query(SIM + "SELECT * FROM f")
def word_simhash(spark, d):
    rows = table(spark, d, "documents").select("doc_id", D.word_simhash(F.col("text")).alias("phash"))
    return rows.where("phash is not null")


@query(SIM.replace("WITH w", "WITH RECURSIVE w") + """, h2 AS (SELECT doc_id, sha256(text) AS digest, ('0x' || substr(phash, 1, 8))::BIGINT AS x, ('0x' || substr(phash, 9, 8))::BIGINT AS y FROM f JOIN documents USING (doc_id)),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h2 a JOIN h2 b ON a.digest <> b.digest AND bit_count(xor(a.x, b.x)) + bit_count(xor(a.y, b.y)) <= 3),
  reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b), cl AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), ln AS (SELECT a, count(*) AS n FROM p GROUP BY a)
  SELECT cl.a AS doc_id, class_id, coalesce(n, 0) AS n_links FROM cl LEFT JOIN ln ON ln.a = cl.a""")
def near_dup_pairs(spark, d):
    """Near-duplicates by word simhash: each document's class and the number of its links."""
    rows = table(spark, d, "documents").select("doc_id", D.word_simhash(F.col("text")).alias("phash"), F.sha2(F.encode("text", "UTF-8"), 256).alias("qhash"))
    return D.near_classes(rows, key="doc_id")
