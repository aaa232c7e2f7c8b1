"""Dedup, sharding, revisits and the pipeline against brute force."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightframe.llm import minhash_dedup as N
from lightframe.operators import skew
from lightframe.llm import shard_sort as H
from lightframe.llm import substring_dedup as U
from lightframe.llm import warc_revisit as W
from lightframe.llm.queries import ORACLES, QUERIES

from .conftest import EDGES


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def near_copies(n, seed=1):
    """A group whose members differ in up to eight words, some after others, and texts that share only a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(120)]]
    for _ in range(n):
        w = list(rng.choice(base[-20:] if rng.random() < 0.3 else base[:1]))
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = word()
        base.append(w)
    shared = [word() for _ in range(60)]
    return [(i, " ".join(w)) for i, w in enumerate(base)] + [(10_000 + i, " ".join(shared + [word() for _ in range(60)])) for i in range(60)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = near_copies(250) + EDGES
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    want = brute_components(rows, percent)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(key, want))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_without_ids(spark, percent):
    """Near copies without an id, as copies, as bridges between two ids, and in groups of their own."""
    w = [f"w{i}" for i in range(200)]
    put = lambda x, n, at=0: x[:at] + [f"{n}.{i}" for i in range(6)] + x[at + 6 :]
    a, b = put(w, "p"), put(put(w, "p"), "q", 100)
    c = [f"c{i}" for i in range(200)]
    rows = [(7, " ".join(w)), (None, " ".join(a)), (8, " ".join(b)), (9, "alone " * 3), (None, " ".join(c)), (None, " ".join(put(c, "r")))]
    rows += [(None if i % 3 else i + 100, t) for i, t in near_copies(120, 3)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(key, brute_components(rows, percent)))
    assert {r["doc_id"]: r["component_id"] for r in got}[8] == 7


def test_near_duplicates_with_hot_keys(spark, monkeypatch):
    """Hubs, buckets, labels and copies that hold a large share are dealt over tasks; nothing changes for it."""
    monkeypatch.setattr(skew, "LEAST_HOT", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):  # around one text, some linked and some not
        w = list(base)
        for j in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            w[j] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 85))


def test_near_duplicate_edges(edges, nothing):
    got = N.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)
    assert N.near_duplicates(nothing).count() == 0


def test_index_finds_all_within_distance():
    k, d, m = N.plan(85)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, k), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(k, d, replace=False)] ^= 1
    import pyarrow as pa

    keys = lambda x: [set() for _ in x]
    out = []
    for x in (a, b):
        got = keys(x)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array([r.tobytes() for r in x])], ["node", "sig"])
        for r in N._postings(k, m)([batch]):
            for key, node in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True):
                got[node].add(key)
        out.append(got)
    assert all(x & y for x, y in zip(*out, strict=True))


def brute_removed(rows, n):
    count = Counter()
    split = [(t or "").encode().split() for _, t in rows]
    for w in split:
        count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for (i, _), w in zip(rows, split, strict=True):
        hit = [False] * len(w)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                hit[k : k + n] = [True] * n
        yield str(i), len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit, strict=True) if not h)).hexdigest()


def check_removed(df, rows, n):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in U.report(U.remove_repeats(df, window=n)).collect())
    assert got == sorted(brute_removed(rows, n))


def test_repeats(spark, docs, rows, edges, nothing):
    check_removed(docs, rows, 35)
    check_removed(edges, EDGES, 35)
    assert U.report(U.remove_repeats(nothing)).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_repeats_in_random_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(U, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(skew, "LEAST_HOT", hot)
    monkeypatch.setattr(U, "SHARD_WORDS", 500)
    rng = random.Random(hot)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        at, size = rng.randrange(40), rng.randrange(60)
        rows.append((i % 90, " ".join(w[:20] + passage[at : at + size] + w[20:] + ["z"] * rng.choice([0, 0, 40]))))
    check_removed(spark.createDataFrame(rows, "doc_id long, text string"), rows, 12)


def check_shards(df, rows, shards):
    got = H.shard(df, shards=shards).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    return got


def test_shards(spark, docs, rows, edges, nothing):
    got = check_shards(docs, rows, 4)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got) + 0.03 * sum(sizes.values())
    check_shards(edges, EDGES, 16)
    check_shards(nothing, [], 16)
    hot = [(i, "the same text " * 20) for i in range(400)] + [(1000 + i, f"text {i} " * 30) for i in range(400)]
    got = check_shards(spark.createDataFrame(hot, "doc_id long, text string"), hot, 8)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())
    again = H.shard(spark.createDataFrame(hot, "doc_id long, text string").repartition(7), shards=8).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


@pytest.mark.parametrize("row_id", [None, 5])
def test_repeated_rows_are_dealt_out(spark, row_id):
    """A group of equal id and text that is larger than several shards is cut, and the law holds."""
    rows = [(row_id, "the same text of fifty one bytes, again and again...")] * 400 + [(i, f"text {i}") for i in range(1000, 1400)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 16)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    share = sum(sizes.values()) / 16
    # the tolerance, what may move for small groups, and a row at either end
    assert len(sizes) == 16 and max(abs(v - share) for v in sizes.values()) <= 0.012 * share + 2 * 53


def test_small_groups_stay_together(spark):
    rows = [(3 * i + j, f"text number {i} " * 40) for i in range(1000) for j in range(3)]
    got = H.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    of = {}
    for r in got:
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())


def test_revisits_match_sql(spark, duck, sf_dir):
    df = QUERIES["op2_warc_revisit"](spark, sf_dir)
    cur = duck.execute(ORACLES["op2_warc_revisit"])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_revisit_cases(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    u = "http://www.Site.org:80/a/index.html?b=2&a=1&utm_source=x#f"
    rows = [
        (1, u, t(1), False, {"ETag": '"1"', "Content-Type": "t", "Age": "9"}, "d1"), (2, "https://site.org/a/?a=1&b=2", t(5), True, {"etag": 'W/"1"', "Date": "now", "Content-Type": "other"}, None),
        (3, u, t(6), True, {"etag": '"2"'}, None), (4, u, t(0), True, {}, None), (5, u, t(9), None, {}, "d5"), (6, u, t(10), True, None, None), (7, None, t(3), True, {}, None), (8, u, None, True, {}, None),
        (9, "http://other.org/", t(3), True, {}, None), (5, u, t(9), True, {}, None), (10, u, t(11), True, {}, "other"), (None, u, t(12), True, {"ETAG": "x", "etag": "x"}, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured_at timestamp, is_revisit boolean, headers map<string,string>, digest string").withColumn("chunk", F.lit(1)).withColumn("t", F.lit(1))
    for chunks in (512, 2, 1):
        got = {(r["record_id"], r["is_revisit"]): r for r in W.resolve(df, chunks=chunks).collect()}
        assert len(got) == len(rows)
        state = lambda i: (got[i, True]["status"], got[i, True]["target_id"], got[i, True]["payload_digest"])
        assert state(2) == ("resolved", 1, "d1") and state(3) == ("changed", 1, None) and state(4) == ("unresolved", None, None)
        assert state(6) == ("resolved", 5, "d5") and state(10) == ("changed", 5, "other") and state(9)[0] == "unresolved"
        assert state(5) == ("resolved", 1, "d1")  # not the response of the same instant and id
        assert got[2, True]["headers"] == {"age": "9", "content-type": "t", "date": "now", "etag": 'W/"1"'}
        assert got[7, True]["status"] == got[8, True]["status"] == "unresolved"
        assert got[1, False]["canonical_url"] == "site.org/a?a=1&b=2"
    assert W.resolve(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = P.documents(spark, sf_dir)
    columns = set(docs.columns)
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = P.stash(stage(spark, docs, sf_dir), "test")
        assert set(docs.columns) == columns and 0 < docs.count() <= before.count(), name
        if name == "minhash near-dedup":
            want = {i for i, n, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 80) if c == i}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "benchmark decontamination":
            from .test_texts import brute_hits

            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hits = {i: (n, h) for i, n, h, _ in brute_hits([(r["doc_id"], r["text"]) for r in before.collect()], items, 10)}
            left = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(left) == {i for i, (n, h) in hits.items() if h <= n / 2} and any(h for _, h in hits.values())
            assert not any(h for _, _, h, _ in brute_hits(left.items(), items, 10))
            assert all(r["text"] == left[r["doc_id"]] for r in before.collect() if not hits[r["doc_id"]][1])
        if name == "secret scans":
            import re

            assert docs.where("text like '%[SECRET]%'").count() > 0 or before.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
            assert not any(re.search("AKIA[A-Z0-9]{16}", r["text"]) for r in docs.collect())
    last = P.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"]: r["decoded_sha256"] for r in last.collect()} == {r["doc_id"]: hashlib.sha256(r["text"].replace("▁", " ").encode()).hexdigest() for r in docs.collect()}


def test_pipeline_edges(spark, sf_dir, edges):
    import corpus_pipeline as P

    docs = edges.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_dedup_decides_by_row(spark, sf_dir, edges):
    import corpus_pipeline as P

    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [*EDGES, (20, words("a")), (21, words("b")), (21, words("a") + " z"), (None, words("c")), (None, words("a") + " y"), (None, words("c") + " z"), (None, words("d")), (None, words("d")), (22, words("e")), (22, words("e") + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    got = [(r["doc_id"], r["text"]) for r in P.near_dedup(spark, docs, sf_dir).collect()]
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    # every row kept is of no group of another, and every row is a near copy of one kept or of its group
    of = {i: c for i, _, c in brute_components([(i, t) for i, (_, t) in enumerate(distinct)], 80)}
    by_group = Counter(of[distinct.index(r)] for r in got)
    assert by_group == dict.fromkeys(of.values(), 1)
    least = {}
    for i, c in of.items():
        least.setdefault(c, distinct[i][0])
    assert all(r[0] == least[of[distinct.index(r)]] for r in got)
    assert (21, words("a") + " z") not in got and (4, EDGES[7][1]) not in got and (21, words("b")) in got


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
