"""Vectors, search, places and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightframe.functions.filters import visible
from lightframe.operators import geo as G
from lightframe.operators import images as M
from lightframe.operators import search as T
from lightframe.operators import vectors as X
from lightframe.operators.graph import shared_folder
from lightframe.operators.similarity import VectorIndex
from lightframe.operators.similarity import similar_pairs as near_vectors
from lightframe.operators.text_index import TextIndex
from lightframe.plans.registry import query
from lightframe.sources.adapters import ASSETS_SQL as A
from lightframe.sources.adapters import assets, table

E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)\n"


def _vectors(spark, d):
    return table(spark, d, "embeddings")


_ASKED = E + """, q AS (SELECT vec_id AS query_id, v AS w FROM e WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, list_dot_product(v, w) AS s FROM e, q)
"""


@query(_ASKED + "SELECT query_id, vec_id, round(s, 6) AS score FROM p WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 400")
def vector_topk(spark, d):
    """For every hundredth vector, itself included, the most like it of all rows."""
    e = _vectors(spark, d)
    return X.search_all(e, e.where("vec_id % 100 = 0"), least=0.1).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(_ASKED + "SELECT query_id, vec_id, round(s, 6) AS score FROM p WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 20")
def indexed_topk(spark, d):
    """For every hundredth vector the twenty most like it, from a stored inverted file whose cells are skipped by bounds."""
    e = _vectors(spark, d)
    index = VectorIndex.write(e, f"{shared_folder(spark)}/vectors")
    return index.search(e.where("vec_id % 100 = 0"), k=20, least=0.1).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(E + "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4")
def similar_pairs(spark, d):
    """All pairs of vectors whose product is 0.4 or more."""
    return near_vectors(_vectors(spark, d), least=0.4).select("a", "b", F.round("score", 6).alias("score"))


@query(E + """, s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  m AS (SELECT a, arg_max(b, (s, -b)) AS b, max(s) AS s FROM s WHERE s > 0.3 GROUP BY a) SELECT x.a, x.b, round(x.s, 6) AS score FROM m x JOIN m y ON x.b = y.a AND y.b = x.a WHERE x.a < x.b""")
def loose_mates(spark, d):
    """Vectors that are each other's best mate of all."""
    return X.loose_mates(_vectors(spark, d), found=0.3).select("a", "b", F.round("score", 6).alias("score"))


@query(E + """, q AS (SELECT vec_id AS query_id, v AS w FROM e WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, list_dot_product(v, w) AS s FROM e JOIN q ON vec_id <> query_id)
  SELECT query_id, vec_id, round(s, 6) AS score FROM p WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 60""")
def similar(spark, d):
    """For every hundredth vector, its most similar others of all rows."""
    e = _vectors(spark, d)
    return X.similar(e, e.where("vec_id % 100 = 0"), least=0.2).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(E + """, s AS (SELECT label, i, sum(v[i]) AS s, count(*) AS n FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), l AS (SELECT label, sqrt(sum(s * s)) AS len FROM s GROUP BY 1)
  SELECT label::BIGINT AS label, i, round(s / len, 6) AS x, n FROM s JOIN l USING (label)""")
def centroids(spark, d):
    c = X.centroids(_vectors(spark, d), "label")
    return c.select(F.col("label").cast("long").alias("label"), "n", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"), "n")


@query(E + """, c AS (SELECT label AS c, v AS w FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), p AS (SELECT vec_id, c, list_dot_product(v, w) AS s FROM e, c)
  SELECT vec_id, CASE WHEN max(s) > 0.25 THEN arg_max(c, (s, -c)) END::BIGINT AS cluster, round(max(s), 6) AS score FROM p GROUP BY vec_id""")
def assign_centroid(spark, d):
    e = _vectors(spark, d)
    centres = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centroid"))
    return X.assign(e, centres, least=0.25).select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.round("score", 6).alias("score"))


@query(E + """, s AS (SELECT label, i, sum(v[i]) AS s, count(*) AS n FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), l AS (SELECT label, sqrt(sum(s * s)) AS len FROM s GROUP BY 1),
  c AS (SELECT label::BIGINT AS id, label % 3 = 0 AS named, max(n) AS n, list(s / len ORDER BY i) AS v FROM s JOIN l USING (label) GROUP BY label),
  p AS (SELECT a.id AS a, b.id AS b, a.named AS na, b.named AS nb, a.n AS an, b.n AS bn, list_dot_product(a.v, b.v) AS s FROM c a JOIN c b ON a.id < b.id WHERE NOT (a.named AND b.named)),
  o AS (SELECT *, (nb AND NOT na) OR (na = nb AND bn > an) AS sw FROM p WHERE s >= -1 AND NOT (a % 2 = 0 AND b = a + 1))
  SELECT CASE WHEN sw THEN b ELSE a END AS "into", CASE WHEN sw THEN a ELSE b END AS other, round(s, 3) AS score FROM o ORDER BY round(s, 3) DESC, 1, 2 LIMIT 40""")
def merge_suggestions(spark, d):
    """Pairs of label centroids, over all vectors, that may be one; the feature reports forty."""
    c = X.centroids(_vectors(spark, d), "label").select(F.col("label").cast("long").alias("id"), (F.col("label") % 3 == 0).alias("named"), "n", "centroid")
    refused = c.where("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return X.merge_suggestions(c, refused, least=-1.0)


_PROMPTS = E + """, p AS (SELECT label AS category, vec_id % 2 = 0 AS is_bad, v AS w FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
"""


def _prompts(e):
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("f"))
    return first.select(F.col("label").alias("category"), (F.col("f.vec_id") % 2 == 0).alias("is_bad"), F.col("f.embedding").alias("emb"))


@query(_PROMPTS + """, s AS (SELECT vec_id, category, max(list_dot_product(v, w)) AS s FROM e, p GROUP BY ALL), x AS (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) * 10) AS x FROM s),
  y AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS sc FROM x) SELECT vec_id, category::BIGINT AS category, round(sc, 6) AS score FROM y WHERE sc >= 0.1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, category) <= 3""")
def zero_shot(spark, d):
    e = _vectors(spark, d)
    return X.zero_shot(e, _prompts(e), scale=10.0, least=0.1).select("vec_id", F.col("category").cast("long").alias("category"), F.round("score", 6).alias("score"))


@query(_PROMPTS + """, s AS (SELECT vec_id, is_bad, list_dot_product(v, w) AS s FROM e, p), x AS (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) * 100) AS x FROM s)
  SELECT vec_id, round(coalesce(sum(x) FILTER (is_bad), 0) / sum(x), 6) AS bad FROM x GROUP BY vec_id""")
def bad_share(spark, d):
    e = _vectors(spark, d)
    return X.bad_share(e, _prompts(e)).select("vec_id", F.round("bad", 6).alias("bad"))


@query("""WITH c AS (SELECT s_suppkey AS city_id, (s_suppkey * 12 % 1200) / 10.0::DOUBLE - 60 AS clat, (s_suppkey * 359 % 3590) / 10.0::DOUBLE - 179.5 AS clon, 1000 * (s_suppkey % 50 + 1) AS pop FROM supplier),
  p AS (SELECT c_custkey AS point_id, (c_custkey % 1200) / 10.0::DOUBLE - 60 AS lat, (c_custkey * 37 % 3590) / 10.0::DOUBLE - 179.5 AS lon FROM customer),
  x AS (SELECT point_id, city_id, pop, 2 * 6371 * asin(least(1.0, sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) AS km FROM p, c
    WHERE abs(floor(lat) - floor(clat)) <= 1 AND (abs(floor(lon) - floor(clon)) <= 1 OR abs(floor(lon) - floor(clon)) = 359)),
  b AS (SELECT point_id, arg_min(city_id, (km / (3 + 2.2 * log10(greatest(1000, pop))), city_id)) AS city_id, arg_min(km, (km / (3 + 2.2 * log10(greatest(1000, pop))), city_id)) AS km FROM x WHERE km <= 60 GROUP BY 1)
  SELECT p.point_id, b.city_id, round(b.km, 4) AS km FROM p LEFT JOIN b USING (point_id)""")
def geocode(spark, d):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    cities = table(spark, d, "supplier").select(s.alias("city_id"), ((s * 12 % 1200) / 10.0 - 60).alias("lat"), ((s * 359 % 3590) / 10.0 - 179.5).alias("lon"), (1000 * (s % 50 + 1)).alias("population"))
    points = table(spark, d, "customer").select(c.alias("point_id"), ((c % 1200) / 10.0 - 60).alias("lat"), ((c * 37 % 3590) / 10.0 - 179.5).alias("lon"))
    return G.geocode(points, cities).select("point_id", "city_id", F.round("km", 4).alias("km"))


BM25 = """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avg FROM t), x AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t),
q AS (SELECT doc_id AS query_id, term AS q FROM (SELECT DISTINCT doc_id, term FROM x WHERE doc_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(term) DESC, term) <= 2),
qs AS (SELECT query_id, q FROM q WHERE len(q) > 1), h AS (SELECT doc_id, q, count(*) AS tf, max(length) AS length FROM x JOIN (SELECT DISTINCT q FROM qs) ON starts_with(term, q) GROUP BY ALL),
df AS (SELECT q, count(*) AS df FROM h GROUP BY q), s AS (SELECT query_id, doc_id, count(*) AS hits, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))) AS score
  FROM qs JOIN h USING (q) JOIN df USING (q), n GROUP BY ALL), w AS (SELECT query_id, count(*) AS words FROM qs GROUP BY 1),
top AS (SELECT query_id, doc_id, score FROM s JOIN w USING (query_id) WHERE hits = words QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 400)
"""


#: Where this session stored the index of a folder's documents.
_STORED: dict[tuple[str, str], str] = {}


def _stored_index(spark, d, again: bool = False) -> TextIndex:
    """The index of all documents, stored once a session and folder."""
    at = (spark.sparkContext.applicationId, d)
    if again or at not in _STORED:
        path = f"{shared_folder(spark)}/text"
        TextIndex(spark, path).upsert(table(spark, d, "documents"))
        _STORED[at] = path
    return TextIndex(spark, _STORED[at])


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
  x AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS tokens FROM x GROUP BY 1""")
def text_index(spark, d):
    """The vocabulary of a newly stored index of all documents."""
    return _stored_index(spark, d, again=True).postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tokens"))


@query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'changed ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 7 = 3),
  t AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM v),
  x AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS tokens FROM x GROUP BY 1""")
def changed_text_index(spark, d):
    """The vocabulary after a fifth of the documents was deleted, a seventh changed, and segments merged."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = TextIndex(spark, f"{shared_folder(spark)}/text")
    index.upsert(docs)
    index.delete(docs.where("doc_id % 5 = 1"))
    index.upsert(docs.where("doc_id % 7 = 3").withColumn("text", F.concat(F.lit("changed "), F.coalesce("text", F.lit("")))))
    index.merge()
    return index.postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tokens"))


def _text_hits(spark, d):
    """Every hundredth document asks for its two longest words."""
    longest = F.slice(F.array_sort(F.transform(F.array_distinct(T.terms(F.coalesce("text", F.lit("")))), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1, 2)
    words = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(longest).alias("x")).select("query_id", F.col("x.t").alias("word")).where(F.length("word") > 1)
    return _stored_index(spark, d).search(words)


@query(BM25 + "SELECT query_id, doc_id, round(score, 6) AS score FROM top")
def bm25_search(spark, d):
    """The four hundred best documents for each query, of the stored index."""
    return _text_hits(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(BM25 + """, e AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), vs AS (SELECT a.doc_id AS query_id, b.doc_id, list_dot_product(a.v, b.v) AS score FROM e a, e b WHERE a.doc_id % 100 = 0),
  vk AS (SELECT * FROM vs WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 400),
  v AS (SELECT query_id, doc_id, (score - 0.2) / greatest(0.05, max(score) OVER (PARTITION BY query_id) - 0.2) AS v FROM vk), k AS (SELECT * FROM v WHERE v >= 0.1),
  r AS (SELECT query_id, doc_id, 1.2 - 0.4 * (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1) / count(*) OVER (PARTITION BY query_id) AS t FROM top),
  b AS (SELECT query_id, doc_id, greatest(coalesce(t, 0), coalesce(v, 0)) AS score FROM r FULL JOIN k USING (query_id, doc_id))
  SELECT query_id, doc_id, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 400""")
def hybrid_search(spark, d):
    e = _vectors(spark, d)
    near = X.search_all(e, e.where("vec_id % 100 = 0"), least=0.2).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return T.hybrid(_text_hits(spark, d), near, least=0.1).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') || ' Škoda foo_bar Őrség ' || CASE doc_id % 4 WHEN 0 THEN 'ÅNGSTRÖM' WHEN 1 THEN 'Čapek' WHEN 2 THEN 'e' || chr(769) || 'toile' ELSE 'Việt Nam' END AS t FROM documents),
  q AS (SELECT * FROM (VALUES (1, ['skoda']), (2, ['orseg', 'foo', 'bar']), (3, ['angstrom']), (4, ['capek']), (5, ['etoile']), (6, ['viet', 'nam'])) v(query_id, ws)),
  x AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(t)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM d)
  SELECT query_id, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM q, x WHERE len(list_filter(ws, lambda w: len(list_filter(terms, lambda t: starts_with(t, w))) > 0)) = len(ws) GROUP BY 1""")
def folded_search(spark, d):
    """Queries with and without diacritics and signs find the same documents; every text ends with words that have some."""
    i = F.col("doc_id") % 4
    tail = F.when(i == 0, "ÅNGSTRÖM").when(i == 1, "Čapek").when(i == 2, "e\u0301toile").otherwise("Việt Nam")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" Škoda foo_bar Őrség "), tail).alias("text"))
    asked = spark.createDataFrame([(1, "Škoda"), (2, "foo_bar Örség"), (3, "Angstrom"), (4, "ČAPEK"), (5, "Étoile"), (6, "viet-nam")], "query_id int, text string")
    hits = T.bm25_texts(docs, T.query_words(asked), k=1 << 30)
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(A + """SELECT asset_id, trim(regexp_replace(concat_ws(' ', 'IMG ' || asset_id, event_type || ' x', concat_ws(' ', city, country), concat_ws(' ', city, country), concat_ws(' ', city, country), model, day, 'P' || source_id, 'l' || (k % 5)), ' +', ' ', 'g')) AS content FROM assets""")
def search_document(spark, d):
    return _search_texts(assets(spark, d))


def _search_texts(a):
    rows = a.withColumns({"name": F.concat(F.lit("IMG_"), F.col("asset_id").cast("string"), F.lit(".jpg")), "rel_dir": F.concat("event_type", F.lit("/x")), "make": F.lit(None).cast("string")})
    people = a.select("asset_id", F.concat(F.lit("P"), F.col("source_id").cast("string")).alias("name"))
    labels = a.select("asset_id", F.concat(F.lit("l"), (F.col("k") % 5).cast("string")).alias("label"))
    return T.search_document(rows, people, labels)


_ASSET_TEXT = """trim(regexp_replace(concat_ws(' ', 'IMG ' || asset_id, event_type || ' x', concat_ws(' ', city, country), concat_ws(' ', city, country), concat_ws(' ', city, country), model, day, 'P' || source_id, 'l' || (k % 5)), ' +', ' ', 'g'))"""


@query(A + f""", t AS (SELECT asset_id, regexp_split_to_array(lower({_ASSET_TEXT}), '[^a-z0-9]+') AS t FROM assets WHERE NOT hidden AND NOT missing AND NOT trashed),
  n AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avg FROM t), x AS (SELECT asset_id, len(t) AS length, unnest(t) AS term FROM t),
  qs AS (SELECT asset_id AS query_id, unnest([event_type, 'p' || source_id, substr(day, 9, 2)]) AS q FROM assets WHERE asset_id % 100 = 0), h AS (SELECT asset_id, q, count(*) AS tf, max(length) AS length FROM x JOIN (SELECT DISTINCT q FROM qs) ON starts_with(term, q) GROUP BY ALL),
  df AS (SELECT q, count(*) AS df FROM h GROUP BY q), s AS (SELECT query_id, asset_id, count(*) AS hits, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))) AS score FROM qs JOIN h USING (q) JOIN df USING (q), n GROUP BY ALL),
  w AS (SELECT query_id, count(DISTINCT q) AS words FROM qs WHERE len(q) > 1 GROUP BY 1)
  SELECT query_id, asset_id, round(score, 6) AS score FROM s JOIN w USING (query_id) WHERE hits = words QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, asset_id) <= 400""")
def asset_search(spark, d):
    """The catalogue's search texts as a stored index; every hundredth row asks for its type, person and day of the month."""
    a = assets(spark, d)
    shown = a.where(visible())
    index = TextIndex(spark, f"{shared_folder(spark)}/text", key="asset_id")
    index.upsert(_search_texts(shown), text="content")
    asked = a.where("asset_id % 100 = 0").select(F.col("asset_id").alias("query_id"), F.concat_ws(" ", "event_type", F.concat(F.lit("P"), F.col("source_id").cast("string")), F.substring("day", 9, 2)).alias("text"))
    hits = index.search(T.query_words(asked))
    return hits.select("query_id", "asset_id", F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT l_orderkey, l_discount * 10 AS x, l_tax * 10 AS y, l_quantity AS w FROM lineitem WHERE l_tax * 10 >= 0.2)
  SELECT l_orderkey, round(greatest(0.05, least(0.95, sum(w * x) / sum(w))), 6) AS fx, round(greatest(0.05, least(0.95, sum(w * y) / sum(w))), 6) AS fy FROM b GROUP BY 1""")
def focal_point(spark, d):
    """Area-weighted centre of sure boxes, held inside the frame."""
    b = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"), F.col("l_quantity").alias("w")).where("y >= 0.2")
    centre = lambda c: F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.sum(F.col("w") * F.col(c)) / F.sum("w"))), 6)
    return b.groupBy("l_orderkey").agg(centre("x").alias("fx"), centre("y").alias("fy"))


@query("""WITH i AS (SELECT doc_id, list_transform(string_split(substr(md5(coalesce(text, '')) || md5(doc_id::VARCHAR), 1, 64), ''), lambda c: ord(c)::DOUBLE) AS p FROM documents)
  SELECT doc_id, round(list_avg(p) / 255, 6) AS brightness, round(list_stddev_pop(p) / 255, 6) AS contrast FROM i""")
def image_features(spark, d):
    """8x8 images made of digests' characters: mean and deviation have an oracle, the rest is tested apart."""
    text = F.concat(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.md5(F.col("doc_id").cast("string").cast("binary")))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.encode(text, "UTF-8").alias("pixels"), F.lit(8).alias("width"))
    return M.features(rows).select(F.col("id").alias("doc_id"), F.round("brightness", 6).alias("brightness"), F.round("contrast", 6).alias("contrast"))
