"""A stored index after changes gives what an index of the changed documents gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lightframe.operators import search as T
from lightframe.operators.text_index import TextIndex

WORDS = ["skoda", "škoda", "skodovka", "red", "redder", "blue", "blueish", "a", "ab", "abc", "Zug", "zug", "x1", "x12"]


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def rebuilt(spark, docs, words, **options):
    rows = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    return ranked(T.bm25(T.postings(rows), words, docs=len(docs), **options))


def test_changes_give_what_a_rebuild_gives(spark, tmp_path):
    r = random.Random(3)
    text = lambda: None if r.random() < 0.05 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    words = spark.createDataFrame([(1, "red"), (2, "sko"), (2, "blue"), (3, "ab"), (3, "zug"), (3, "x1"), (4, "nothing"), (5, "red"), (5, "nothing"), (6, "a")], "query_id int, word string")
    index = TextIndex(spark, f"file://{tmp_path}/index")
    assert index.search(words).count() == 0 and index.documents() is None
    docs = {i: text() for i in range(120)}
    index.upsert(frame(docs))
    for step in range(3):
        new = {i: text() for i in r.sample(range(200), 30)}
        docs |= new
        index.upsert(frame(new))
        gone = r.sample(range(220), 15)
        docs = {i: t for i, t in docs.items() if i not in gone}
        index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        state = index.state()
        assert state["docs"] == len(docs) and state["version"] == 3 + 2 * step
        for k in (400, 3):
            assert ranked(index.search(words, k=k)) == rebuilt(spark, docs, words, k=k)
    assert {x["doc_id"]: x["length"] for x in index.documents().collect()}.keys() == docs.keys()
    want = rebuilt(spark, docs, words)
    index.merge()
    index.vacuum()
    assert len(index.state()["segments"]) == 1 and index.state()["docs"] == len(docs)
    assert ranked(index.search(words)) == want
    plain = T.postings(frame(docs)).select("term", "doc_id", "tf", "length")
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, plain.collect()))


def test_failed_and_rival_changes(spark, tmp_path):
    """A change that didn't reach the log isn't there; of two writers of one version the second fails."""
    index = TextIndex(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string")
    index.upsert(docs)
    index._write("seg-lost", T.postings(docs), docs.select("doc_id", F.lit(1).alias("length")))
    words = spark.createDataFrame([(1, "two")], "query_id int, word string")
    assert index.search(words).count() == 2
    old = index.state()
    index.delete(docs.where("doc_id = 1"))
    with pytest.raises(Exception, match="exist"):
        index._commit(old | {"version": old["version"] + 1})
    assert [x["doc_id"] for x in index.search(words).collect()] == [2]
    index.vacuum()
    assert not (tmp_path / "index" / "seg-lost").exists()


def test_bar_skips_nothing_that_counts(spark):
    """Many documents of the rarest word: the best come out whichever words count most."""
    r = random.Random(1)
    docs = {i: " ".join(["lead"] * r.randint(1, 4) + ["other"] * r.randint(0, 6) + ["fill"] * r.randint(0, 60)) for i in range(900)} | {i: "other " * r.randint(1, 9) for i in range(900, 1400)}
    rows = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    words = spark.createDataFrame([(1, "lead"), (1, "other"), (2, "lead")], "query_id int, word string")
    assert ranked(T.bm25(T.postings(rows), words, docs=len(docs), k=7)) == [x for x in ranked(T.bm25(T.postings(rows), words, docs=len(docs), k=5000)) if x[1] <= 7]


def test_documents_become_blocks_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """Blocks of a shard hold what a plain count gives, however texts are cut; changes take hidden postings out of whole blocks."""
    from collections import Counter

    from lightframe.operators import text_index as X

    monkeypatch.setattr(X, "SHARD_DOCS", 40)
    r = random.Random(9)
    docs = {i: " ".join(r.choice(["red", "blue", "zug", f"w{i}"]) for _ in range(r.choice([1, 5, 40]) if i == 7 else r.choice([0, 1, 5, 40]))) for i in range(150)}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    plain = lambda d: sorted((w, i, n, len(t.split())) for i, t in d.items() for w, n in Counter(t.split()).items())
    index = TextIndex(spark, f"file://{tmp_path}/index")
    index.upsert(frame(docs).unionByName(frame(docs).where("doc_id = 7")))  # a row that comes twice is one document's
    blocks = spark.read.parquet(f"{tmp_path}/index/seg-*/postings")
    assert blocks.count() < blocks.selectExpr("sum(size(keys)) as n").first()["n"]
    twice = len(docs[7].split())
    once = [x for x in sorted(map(tuple, index.postings().collect())) if x[1] != 7]
    assert once == [x for x in plain(docs) if x[1] != 7]
    assert sorted((x["term"], x["tf"]) for x in index.postings().where("doc_id = 7").collect()) == [(w, 2 * n) for w, n in sorted(Counter(docs[7].split()).items())] and twice
    index.upsert(frame({7: "red", 8: "", 200: "zug zug"}))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 150, 3)], "doc_id long"))
    docs = {i: t for i, t in (docs | {7: "red", 8: "", 200: "zug zug"}).items() if i % 3 or i >= 150}
    assert sorted(map(tuple, index.postings().collect())) == plain(docs)
    index.merge()
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    index.merge()
    del docs[1]
    assert sorted(map(tuple, index.postings().collect())) == plain(docs)


def test_blocks_of_cut_batches(monkeypatch):
    """Documents that span batches, empty ones and long ones: every posting once, in short blocks of one shard."""
    import pyarrow as pa

    from lightframe.operators import text_index as X

    monkeypatch.setattr(X, "PIECE_TOKENS", 9)
    monkeypatch.setattr(X, "BLOCK_POSTINGS", 3)
    r = random.Random(2)
    rows = sorted((k % 3, k, r.choice([0, 2, 30])) for k in range(60))
    rows = [(s, k, [r.choice("abcdef") for _ in range(n)]) for s, k, n in rows]
    rows = [x for s, k, t in rows for x in [(s, k, len(t), t)] * (3 if k % 10 == 0 else 1)]
    parts = lambda x: [pa.array([v[i] for v in x], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())))]
    batches = [pa.RecordBatch.from_arrays(parts(rows[i : i + 7]), ["shard", "key", "n", "t"]) for i in range(0, len(rows), 7)]
    got, listed = [], []
    for b in X._counted([batches[0].slice(0, 0), *batches]):
        for x in b.to_pylist():
            each = list(zip(x["keys"], x["tfs"], x["lengths"], strict=True))
            assert {k % 3 for k in x["keys"]} <= {x["shard"]}
            if x["term"] is None:
                listed += [(k, n) for k, _, n in each]
            else:
                assert 1 <= len(each) <= 3
                got += [(x["term"], *e) for e in each]
    want = {(w, k, 3 * t.count(w) if k % 10 == 0 else t.count(w), n) for _, k, n, t in rows for w in set(t)}
    assert sorted(got) == sorted(want) and sorted(listed) == sorted((k, n) for _, k, n, _ in rows)


def test_texts_without_an_index(spark):
    """Searching whole texts gives what searching their postings gives."""
    r = random.Random(4)
    docs = {i: None if i % 17 == 0 else " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9))) for i in range(80)}
    words = spark.createDataFrame([(1, "red"), (2, "sko"), (2, "blue"), (3, "ab"), (4, "none"), (5, "a")], "query_id int, word string")
    assert ranked(T.bm25_texts(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string"), words)) == rebuilt(spark, docs, words)


def test_search_counts_by_shard_before_anything_is_dealt(spark, tmp_path, monkeypatch):
    """Postings that begin with a word are counted in the task of their shard: no table of all a task reads is built before an exchange."""
    index = TextIndex(spark, f"{tmp_path}/i")
    index.upsert(spark.createDataFrame([(i, f"red{i % 7} red{i % 5} blue") for i in range(300)], "doc_id long, text string"))
    plans, plain = [], T.scored
    monkeypatch.setattr(T, "scored", lambda hits, *a, **k: (plans.append(hits._jdf.queryExecution().sparkPlan().toString()), plain(hits, *a, **k))[1])
    words = spark.createDataFrame([(1, "red"), (1, "blue")], "query_id long, word string")
    assert index.search(words).count() == 300
    above = plans[0].split("Exchange")[0]
    assert above.count("HashAggregate") == 2 and "Generate" in above


@pytest.mark.parametrize("rows", [1, 1 << 20])
def test_lookups_are_dealt_by_their_size(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(i, " ".join(["red"] * (i % 9 + 1) + ["blue"] * (i % 4) + ["x"] * (i % 13))) for i in range(400)], "doc_id long, text string")
    words = spark.createDataFrame([(q, w) for q in range(6) for w in ("red", "blue")[: q % 2 + 1]], "query_id long, word string")
    want = ranked(T.bm25_texts(docs, words, k=5))
    monkeypatch.setattr(T, "TASK_ROWS", rows)
    assert ranked(T.bm25_texts(docs, words, k=5)) == want and len(want) == 30
