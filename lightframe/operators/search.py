"""Text index, BM25 and hybrid search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.operators.graph import checkpointed


def _folds() -> tuple[str, str]:
    """Lower-case letters that are another letter with marks, and that letter: what Unicode's decomposition says."""
    marked = {}
    for c in map(chr, range(0xC0, 0x2C00)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and all(unicodedata.combining(m) for m in marks):
            marked[c] = base
    return "".join(marked), "".join(marked.values())


_FOLDS = _folds()


def folded(text: Column) -> Column:
    """Lower case without diacritics, whether they are part of a letter or follow it. Texts of ASCII alone have none."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.regexp_replace(F.translate(F.lower(text), *_FOLDS), r"\p{Mn}+", ""))


def terms(text: Column) -> Column:
    """Runs of letters and digits, folded. Documents and queries are both split by it."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")


def postings(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, length): one row a term and document. `text_index` stores them."""
    each = docs.select(key, terms(F.coalesce(text, F.lit(""))).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    return each.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def query_words(queries: DataFrame, *, key: str = "query_id", text: str = "text") -> DataFrame:
    """(key, word): the distinct words of two or more letters of each query, folded like the documents'."""
    return queries.select(key, F.explode(F.array_distinct(terms(F.coalesce(text, F.lit(""))))).alias("word")).where(F.length("word") > 1)


def bm25(index: DataFrame, words: DataFrame, *, docs: int, k: int = 400, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank): for each query the `k` best documents that hold, for each of its `words` (query, word), a term
    with that prefix. `index` has the postings of all `docs` documents.

    Terms meet the words by their prefixes. A query's documents are those of its rarest word; its other words are looked up for
    these alone. See `text_index` for an index that is stored with what its search needs."""
    index = index.select("term", key, "tf", "length")
    total = index.agg(F.sum("tf").alias("t")).first()["t"] or 0
    hits = with_prefixes(index, words).groupBy("word", key, "length").agg(F.sum("tf").alias("tf"))
    return scored(hits, words, docs=docs, tokens=total, k=k, k1=k1, b=b, key=key, query=query)


def bm25_texts(docs: DataFrame, words: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`bm25` over whole texts that no index is kept of: all tokens are counted, and only those that begin with a word grouped."""
    each = docs.select(key, terms(F.coalesce(text, F.lit(""))).alias("t")).select(key, F.size("t").alias("length"), "t")
    whole = each.agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
    tokens = each.select(key, "length", F.explode("t").alias("term"))
    hits = with_prefixes(tokens, words).groupBy("word", key, "length").agg(F.count("*").alias("tf"))
    return scored(hits, words, docs=whole["n"], tokens=whole["t"] or 0, key=key, **options)


def with_prefixes(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` (term, ...) beside each of the distinct `words` (word) that their term begins with. A word is a prefix of one
    length, so this is an equi-join; a small set of words is broadcast by its measured size."""
    distinct = checkpointed(words.select("word").where(F.length("word") > 0).distinct())
    sizes = [r["n"] for r in distinct.select(F.length("word").alias("n")).distinct().collect()]  # lengths of words: a few numbers
    term = F.col("term")
    prefix = F.explode(F.array(*(F.when(F.length(term) >= n, F.substring(term, 1, n)) for n in sizes)).cast("array<string>"))
    few = distinct.agg(F.sum(F.octet_length("word") + 16).alias("b")).first()["b"] or 0
    return rows.withColumn("word", prefix).join(F.broadcast(distinct) if few <= 4 << 20 else distinct, "word")


#: Rows that a task looks up or is looked up in, about, and most tasks that rows are dealt to: up to 200 Spark writes an exchange's rows
#: straight to files, while for more it holds and sorts them.
TASK_ROWS, MOST_TASKS = 1 << 20, 200


def scored(hits: DataFrame, words: DataFrame, *, docs: int, tokens: int, k: int = 400, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank) from `hits` (word, key, length, tf), one row a word and document that has it.

    Of the documents of a query's rarest word those that can still be among the `k` best are looked up under its other
    words: first those where the rarest word counts most, which set a bar, then those that could reach it if every other word
    counted as much as it does anywhere."""
    words = checkpointed(words.select(query, "word").distinct())
    hits = checkpointed(hits)
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = checkpointed(hits.groupBy("word").agg(F.count("*").alias("n")))
    idf = F.greatest(F.log((docs - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    mean = max(tokens, 1) / max(1, docs)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    parts = checkpointed(hits.join(df, "word").select("word", key, part.alias("part")))
    most = parts.groupBy("word").agg(F.max("part").alias("most"), F.count("*").alias("n"))
    ranked = words.join(most, "word", "left")
    each = ranked.groupBy(query).agg(F.count("*").alias("words"), F.count("n").alias("found"), F.min_by(F.struct("word", "most", "n"), F.struct("n", "word")).alias("lead"), F.sum("most").alias("all"))
    each = checkpointed(each.where("words = found").select(query, "words", F.col("lead.word").alias("lead"), F.col("lead.n").alias("n"), (F.col("all") - F.col("lead.most")).alias("others")))
    # looked up at most: so many rows for the first documents, and for all of them
    sizes = each.agg(F.sum(F.least("n", F.lit(4 * k)) * F.col("words")).alias("few"), F.sum(F.col("n") * F.col("words")).alias("all")).first()
    held = parts.count()
    each = each.drop("n")
    # leading documents by what the lead counts, one rank a word whatever its queries
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.col("part").desc(), key))
    leads = parts.join(each.select(F.col("lead").alias("word")).distinct(), "word", "left_semi").select(F.col("word").alias("lead"), key, F.col("part").alias("lead_part"))
    few = leads.withColumnRenamed("lead", "word").withColumnRenamed("lead_part", "part").withColumn("r", place).where(F.col("r") <= 4 * k).select(F.col("word").alias("lead"), key, F.col("part").alias("lead_part"))

    def whole(candidates: DataFrame, rows: int) -> DataFrame:
        asked, there = candidates.select(query, key).join(words, query), parts
        n = min(MOST_TASKS, (rows + held) // TASK_ROWS)
        if n > tasks:  # else Spark's own number
            asked, there = asked.repartition(n, "word", key), there.repartition(n, "word", key)
        pairs = asked.join(there, ["word", key])
        sums = pairs.groupBy(query, key).agg(F.count("*").alias("hits"), F.sum("part").alias("score"))
        return sums.join(each.select(query, "words"), query).where("hits = words").select(query, key, "score")

    best = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key))
    first = checkpointed(whole(few.join(each, "lead"), sizes["few"] or 0))
    out = first
    if leads.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > 4 * k).limit(1).count():
        bar = first.withColumn("r", best).where(F.col("r") <= k).groupBy(query).agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") == k).select(query, "bar")
        rest = leads.join(few.select("lead", key), ["lead", key], "left_anti").join(each, "lead").join(bar, query, "left")
        more = rest.where(F.col("bar").isNull() | (F.col("lead_part") + F.col("others") >= F.col("bar") - 1e-8))
        out = first.unionByName(whole(more, sizes["all"] or 0))
    return out.select(query, key, "score", best.alias("rank")).where(F.col("rank") <= k)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, *, k: int = 400, floor: float = 0.2, least: float = 0.55, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Per query, text hits by rank (1.2 down to 0.8) and vector hits by relative score (kept from `least`); the better one
    counts. Both inputs are ranked lists of bounded length for each query."""
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), F.col(key))
    whole = Window.partitionBy(query)
    t = text_hits.select(query, key, (1.2 - 0.4 * (F.row_number().over(w) - 1) / F.count("*").over(whole)).alias("t"))
    v = vector_hits.where(F.col("score") >= floor)
    rel = (F.col("score") - floor) / F.greatest(F.lit(0.05), F.max("score").over(whole) - floor)
    v = v.select(query, key, rel.alias("v")).where(F.col("v") >= least)
    both = t.join(v, [query, key], "full_outer").select(query, key, F.greatest(F.coalesce("t", F.lit(0.0)), F.coalesce("v", F.lit(0.0))).alias("score"))
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key))
    return both.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")


def search_document(df: DataFrame, people: DataFrame, labels: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """The text under which a row is found: its name and folder as words, its place three times, camera, day, people, labels."""
    p = people.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("__p"))
    g = labels.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), " ").alias("__g"))
    name = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "[_-]", " ")
    folder = F.regexp_replace("rel_dir", "[/_-]", " ")
    place = F.concat_ws(" ", "city", "country")
    words = F.concat_ws(" ", name, folder, place, place, place, "make", "model", "day", "__p", "__g")
    return df.join(p, key, "left").join(g, key, "left").select(key, F.trim(F.regexp_replace(words, " +", " ")).alias("content"))
