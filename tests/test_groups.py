"""Near-duplicate groups and exposure series at any density, against pairs and plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lightframe.operators import dedup as U
from lightframe.operators import sessions as S
from lightframe.operators.graph import components

from . import brute as B


def near_by_pairs(rows, bits=3):
    """Components of rows (id, phash, qhash, burst, ext, width, height) by all pairs."""
    edges = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] is None or b[1] is None or (int(a[1], 16) ^ int(b[1], 16)).bit_count() > bits:
                continue
            if a[2] is not None and a[2] == b[2] or a[3] is not None and a[3:] == b[3:]:
                continue
            edges.append((a[0], b[0]))
    return {i: g[0] for g in B.components([r[0] for r in rows], edges) for i in g}


SCHEMA = "asset_id long, phash string, qhash string, burst long, ext string, width int, height int"


@pytest.mark.parametrize(("seed", "copies", "bursts", "hashes"), [(1, 40, 3, 2), (2, 3, 40, 2), (3, 6, 6, 1), (4, 25, 25, 3), (5, 2, 2, 2), (6, 200, 1, 1), (7, 1, 60, 1), (8, 5, 5, 40)])
def test_near_groups(spark, seed, copies, bursts, hashes):
    """Few or many digests, few or many bursts, one hash or several: what pairs would link, and the pairs' own components."""
    r = random.Random(seed)
    base = r.getrandbits(64)
    some = [f"{base ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 2))):016x}" for _ in range(hashes)] + [f"{r.getrandbits(64):016x}" for _ in range(3)]
    rows = [(i, r.choice(some) if r.random() < 0.97 else None, None if r.random() < 0.05 else f"q{r.randrange(copies)}", None if r.random() < 0.1 else r.randrange(bursts), r.choice("ab"), r.choice((None, 1)), 2) for i in range(260)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["asset_id"]: x["component"] for x in U.near_groups(df, burst="burst").collect()}
    assert got == near_by_pairs(rows)


def test_near_groups_of_one_hash(spark):
    """5,000 rows of one hash and different digests cost a bounded number of links each."""
    df = spark.range(5000).select(F.col("id").alias("asset_id"), F.lit("00ff00ff00ff00ff").alias("phash"), F.concat(F.lit("q"), F.col("id")).alias("qhash"), F.lit(None).cast("long").alias("burst"), F.lit("a").alias("ext"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    out = U.near_groups(df, burst="burst")
    assert out.agg(F.count("*"), F.min("component"), F.max("component")).first() == (5000, 0, 0)
    # one burst and format: nothing is linked; nor are copies of one digest
    assert U.near_groups(df.withColumn("burst", F.lit(1).cast("long")), burst="burst").count() == 0
    assert U.near_groups(df.withColumn("qhash", F.lit("same"))).count() == 0
    assert U.near_groups(df.limit(0)).count() == 0


def test_series_carry_over_batches(spark):
    """Islands longer than a batch, null sources, missing hashes, and what a plain loop makes of them."""
    r = random.Random(2)
    rows, ms = [], 0
    for i in range(6000):
        ms += r.choice((100, 400, 900, 2400, 9000 if r.random() < 0.02 else 300))
        rows.append({"id": i, "ms": ms, "exposure": r.choice((None, 0.0, 1 / 500, 1 / 250, 1 / 60, 1 / 15, 1 / 4, 1.0, 2.0)) if r.random() < 0.1 else 2.0 ** r.randint(-9, 2), "model": "m" if i % 997 else None, "fnumber": 2.8, "iso": 100, "width": 4000, "phash": f"{r.choice((0, 3, (1 << 40) - 1)):016x}"})
    df = spark.createDataFrame([(x["id"], None, x["ms"], x["exposure"], x["model"], x["fnumber"], x["iso"], x["width"], x["phash"]) for x in rows], "asset_id long, source_id long, ms long, exposure double, model string, fnumber double, iso int, width int, phash string")
    df = df.withColumn("taken_at", F.timestamp_millis("ms"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = S.bracket_series(S.bracket_islands(df, "source_id", same=("model", "fnumber", "iso", "width")), "source_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = defaultdict(list)
    for x in found:
        assert x["source_id"] is None
        got[x["series"]].append((x["asset_id"], x["is_keeper"]))
    want = B.brackets(rows, 2500, 600)
    assert want and sorted(sorted(i for i, _ in v) for v in got.values()) == sorted([x["id"] for x in s] for s in want)
    for s in want:
        by_light = sorted(s, key=lambda x: (x["exposure"], x["id"]))
        assert {i for i, k in got[s[0]["id"]] if k} == {by_light[len(s) // 2]["id"]}


@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_ordered_by_either_route(spark, sf_dir, monkeypatch, whole):
    """Groups in one part or over many: the same trips, islands, ranks, caps and names; one source holds a third of all rows."""
    from lightframe.operators import curate as C
    from lightframe.operators import ordered
    from lightframe.operators import timeline as T
    from lightframe.sources.adapters import assets

    monkeypatch.setattr(ordered, "WHOLE_ROWS", whole)
    a = assets(spark, sf_dir).withColumn("source_id", F.when(F.col("asset_id") % 3 == 0, None).otherwise(F.col("source_id") % 5))
    rows = [r.asDict() | {"id": r["asset_id"]} for r in a.withColumn("ms", F.unix_millis("taken_at")).collect()]
    rows.sort(key=lambda r: (r["ms"], r["id"]))
    per = defaultdict(list)
    for r in rows:
        per[r["source_id"]].append(r)
    home = T.home_city(a.where("source_id is not null"), "source_id")
    m = S.summarise(S.segment(a.where("source_id is not null"), "source_id"), "source_id")
    got = {(r["source_id"], r["first_id"], r["moments"]) for r in S.trips(m, home, "source_id").collect()}
    homes = {r["source_id"]: r["home"] for r in home.collect()}
    want = {(u, moments[run[0]][0]["id"], len(run)) for u, mine in per.items() if u is not None for moments in [B.segments(mine)] for run in B.trips(moments, homes[u])}
    assert got == want
    one = T.home_city(a).limit(1)
    whole_library = S.summarise(S.segment(a))
    moments = B.segments(rows)
    assert {r["first_id"] for r in S.trips(whole_library, one).collect()} == {moments[run[0]][0]["id"] for run in B.trips(moments, one.first()["home"])}
    ranks = {r["asset_id"]: r["k"] for r in ordered.rank_within(a, ["source_id"], ["taken_at", "asset_id"], "k").collect()}
    assert all(ranks[r["id"]] == i for mine in per.values() for i, r in enumerate(mine, 1))
    capped = {r["asset_id"]: r["new_year"] for r in C.capped_running(a, "source_id", item=F.col("kind") == "video", cap=F.lit(7)).collect()}
    for mine in per.values():
        n, year = 0, None
        for r in mine:
            n += r["kind"] == "video"
            if r["kind"] == "video" and n > 7:
                assert r["id"] not in capped
            else:
                assert capped[r["id"]] == (r["day"][:4] != year)
                year = r["day"][:4]


def test_hot_group_has_its_keeper_and_reasons(spark, monkeypatch):
    """A group of a third of all rows, dealt over tasks: the same keeper and reasons as a plain loop's; null groups too."""
    from lightframe.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    r = random.Random(9)
    rows = [(i, r.choice([1, None, *range(10, 30)]) if i % 3 else 0, r.random() < 0.01, r.random() < 0.05, r.random(), r.random(), r.random() / 9, r.random() / 9, r.random() * 99, r.randint(1, 4000), r.randint(1, 4000), r.choice(("jpg", "heic", None)), r.randint(1, 10**6)) for i in range(900)]
    df = spark.createDataFrame(rows, "asset_id long, g long, favorite boolean, in_album boolean, quality double, brightness double, clip_bright double, clip_dark double, sharpness double, width int, height int, ext string, size long")
    groups = defaultdict(list)
    for x in df.withColumns({"s": U.keep_score("burst"), "v": U.keep_score("visual"), "e": U.exposure_distance(F.col("brightness"), F.col("clip_bright"), F.col("clip_dark"))}).collect():
        groups[x["g"]].append(x)
    got = {x["g"]: (x["keep_id"], x["reasons"]) for x in U.burst_reasons(df, "g").collect()}
    seen = {x["g"]: (x["keep_id"], x["reasons"]) for x in U.visual_reasons(df, "g").collect()}
    assert set(got) == set(groups) and None in got
    for g, mine in groups.items():
        best, *others = sorted(mine, key=lambda x: (-x["s"], x["asset_id"]))
        why = ["favourite"] * best["favorite"] + ["sharpest"] * bool(others and best["sharpness"] > 1.25 * sum(x["sharpness"] for x in others) / len(others)) + ["best exposed"] * bool(others and best["e"] + 0.04 < min(x["e"] for x in others))
        assert got[g] == (best["asset_id"], why or ["best overall"])
        best, *others = sorted(mine, key=lambda x: (-x["v"], x["asset_id"]))
        mp = lambda x: x["width"] * x["height"] / 1e6
        why = ["favourite"] * best["favorite"]
        if others:
            why += ["best resolution"] * (mp(best) > 1.2 * mp(others[0])) + ["original format"] * bool(best["ext"] and others[0]["ext"] and best["ext"] != others[0]["ext"] and best["ext"] in U.ORIGINAL) + ["most complete"] * (best["size"] > 1.3 * others[0]["size"])
        assert seen[g] == (best["asset_id"], why or ["equal quality"])
    stamps = df.select(F.col("g").alias("source_id"), "asset_id", F.timestamp_seconds(F.col("size") % 1000).alias("missing_at"))
    kept = {x["asset_id"]: x["missing_at"] for x in S.restore_batch(stamps, F.lit(True)).collect()}
    before = {x["asset_id"]: (x["source_id"], x["missing_at"]) for x in stamps.collect()}
    newest = {g: max(t for s, t in before.values() if s == g) for g in groups}
    assert all((kept[i] is None) == ((newest[g] - t).total_seconds() <= 120) for i, (g, t) in before.items())


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_finished_rounds_leave_no_tables(spark, tmp_path, monkeypatch, few):
    """A star, a chain and what components leave behind: the last round alone."""
    import os

    from lightframe.operators import graph, skew

    monkeypatch.setattr(graph, "FEW_EDGES", few)
    monkeypatch.setattr(skew, "LEAST_HOT", 100)
    old = getattr(spark.sparkContext, "_lightframe_dir", None)
    spark.sparkContext._lightframe_dir = f"file://{tmp_path}"
    try:
        edges = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(5000, 5040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        out = graph.components(edges).groupBy("component").agg(F.count("*").alias("n")).collect()
        assert {(x["component"], x["n"]) for x in out} == {(0, 3000), (5000, 41)}
        assert len(os.listdir(tmp_path)) <= 1
    finally:
        if old is None:
            del spark.sparkContext._lightframe_dir
        else:
            spark.sparkContext._lightframe_dir = old


@pytest.mark.parametrize("successors", [39, 3, None])
def test_dense_bursts(spark, monkeypatch, successors):
    """Many rows in one slot of time: the same pairs as a plain loop's; divided slots have bounded parts."""
    from lightframe.operators import skew

    monkeypatch.setattr(skew, "LEAST_HOT", 20)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    rows = []
    for i in range(700):
        h = r.choice(base)
        for _ in range(r.randint(0, 9)):
            h ^= 1 << r.randrange(64)
        ms = 1_700_000_000_000 + (r.randrange(20_000) if i < 400 else r.randrange(600_000))
        rows.append((i, i % 2, ms, f"{h:016x}" if i % 50 else None, f"q{r.randrange(300)}", r.choice(("jpg", "heic")), 1, 1))
    df = spark.createDataFrame(rows, "asset_id long, u int, ms long, phash string, qhash string, ext string, width int, height int").withColumn("taken_at", F.timestamp_millis("ms"))
    got = {tuple(x) for x in U.burst_pairs(df, "u", successors=successors).collect()}
    want = set()
    for u in (0, 1):
        mine = sorted((x for x in rows if x[1] == u and x[3] is not None), key=lambda x: (x[2], x[0]))
        for k, a in enumerate(mine):
            for b in mine[k + 1 : k + 1 + successors] if successors else mine[k + 1 :]:
                n = (int(a[3], 16) ^ int(b[3], 16)).bit_count()
                if b[2] - a[2] <= 20_000 and n <= 14 and a[4] != b[4] and not (n <= 3 and a[5:] != b[5:]):
                    want.add((a[0], b[0], n))
    assert want and got == want


def test_ten_thousand_rows_in_twenty_seconds(spark):
    """Successors bound the pairs that are looked at, whatever the density."""
    df = spark.range(10_000).select(F.col("id").alias("asset_id"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 2).alias("taken_at"), F.lpad(F.lower(F.hex(F.col("id"))), 16, "0").alias("phash"), F.col("id").cast("string").alias("qhash"), F.lit("a").alias("ext"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    assert U.burst_pairs(df, bits=64).count() == 39 * 10_000 - 39 * 40 // 2


def test_moments_of_one_millisecond(spark, tmp_path):
    """Moments are ordered by the millisecond they start in, then by source."""
    import datetime as dt

    from lightframe.plans import q_sessions as Q

    t = dt.datetime(2024, 1, 5, 10, 0, 0)
    rows = [(1, t + dt.timedelta(microseconds=900), 1, "view", 1.0, '{"k": 1}'), (2, t + dt.timedelta(microseconds=200), 2, "view", 1.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["bucket"] for r in Q.moment_buckets(spark, str(tmp_path)).orderBy("place").collect()] == ["m:2:1", "m:1:1"]
    s = Q._segmented(spark, str(tmp_path))
    page = Q.T.moment_page(s, Q.S.summarise(s, "source_id"), 0, 240, "source_id")
    assert [r["source_id"] for r in page.collect()] == [2, 1]


@pytest.mark.parametrize(("few", "seed", "by"), [(4096, 1, []), (4096, 2, ["u"]), (0, 3, []), (0, 4, ["u"])])
def test_burst_groups_are_what_pairs_link(spark, monkeypatch, few, seed, by):
    monkeypatch.setattr(U, "FEW_LOOKS", few)
    r = random.Random(seed)
    looks = ["0" * 16, "0" * 15 + "1", "0" * 13 + "fff", "f" * 16, "f" * 14 + "00"]
    rows = []
    for i in r.sample(range(5000), 500):
        t = r.randrange(150) * 40_000 + r.choice((0, 0, r.randrange(45_000)))
        rows.append((i, r.choice((1, 2, None)), t, r.choice(looks), r.choice(("a", "b", "c", "c", "c", "c", None)) if r.random() < 0.8 else str(i), r.choice(("jpg", "jpg", "heic", None)), 4, 3))
    df = spark.createDataFrame(rows, "asset_id long, u int, t long, phash string, qhash string, ext string, width int, height int").selectExpr("*", "timestamp_millis(t) AS taken_at")
    want = {tuple(x) for x in components(U.burst_pairs(df, *by, successors=None)).collect()}
    got = [tuple(x) for x in U.burst_groups(df, *by).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_a_burst_is_not_listed_as_pairs(spark, monkeypatch):
    """A dense burst's edges are counted by its slots, not by its pairs."""
    df = spark.range(3000).selectExpr("id AS asset_id", "timestamp_millis(id * 50) AS taken_at", "'00000000000000ff' AS phash", "cast(id AS string) AS qhash", "'jpg' AS ext", "1 AS width", "1 AS height")
    seen = []
    monkeypatch.setattr(U, "components", lambda e: seen.append(e.count()) or components(e))
    assert {tuple(x) for x in U.burst_groups(df).collect()} == {(i, 0) for i in range(3000)}
    assert seen[0] < 100


def test_frames_alone_are_left_out(spark):
    """Without frames that are alone in their island the series are the same, in one part or many, and few frames are left."""
    r = random.Random(5)
    rows, ms = [], 0
    for i in range(5000):
        ms += r.choice((100, 900, 60_000, 60_000, 60_000))
        rows.append((i, i % 2, ms, r.choice((None, 0.0)) if r.random() < 0.05 else 2.0 ** r.randint(-9, 2), "m" if i % 7 else None, f"{r.getrandbits(64):016x}"))
    df = spark.createDataFrame(rows, "asset_id long, source_id long, ms long, exposure double, model string, phash string").withColumn("taken_at", F.timestamp_millis("ms"))
    for by in ((), ("source_id",)):
        for most in (1 << 20, 1):  # groups in one part, and over many
            with pytest.MonkeyPatch.context() as m:
                m.setattr("lightframe.operators.ordered.MOST_ROWS", most)
                m.setattr("lightframe.operators.ordered.WHOLE_ROWS", most)
                every, some = (S.bracket_islands(df, *by, alone=alone) for alone in (True, False))
                islands = {x["asset_id"]: x["island"] for x in every.collect()}
                left = {x["asset_id"]: x["island"] for x in some.collect()}
                n = Counter((islands[i], i % 2 if by else 0) for i in islands)
                more = {i: k for i, k in islands.items() if n[k, i % 2 if by else 0] > 1}
                assert more.items() <= left.items() <= islands.items() and len(left) <= len(more) + 16 < len(islands) / 2
                assert sorted(map(tuple, S.bracket_series(every, *by).collect())) == sorted(map(tuple, S.bracket_series(some, *by).collect())) != []
