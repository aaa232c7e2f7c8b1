"""Small cases with known answers."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightframe.functions import dates as D
from lightframe.functions import media as M
from lightframe.functions import names as N
from lightframe.functions.filters import hamming_hex, rules
from lightframe.operators import curate as C
from lightframe.operators import dedup as U
from lightframe.operators import images as I
from lightframe.operators import sessions as S
from lightframe.operators import timeline as T
from lightframe.operators.graph import components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dates(spark):
    got = one(spark, D.parse_date(F.lit("2023-08-12T15:30:12+0200")))
    assert (got["offset"], got["day"], got["taken_ms"]) == (120, "2023-08-12", 1691847012000)
    assert one(spark, D.parse_date(F.lit("2023-08-12T15:30:12Z")))["offset"] == 0
    assert one(spark, D.parse_date(F.lit("0000:00:00 00:00:00"))) is None
    assert one(spark, D.parse_date(F.lit("2023:02:31 00:00:00"))) is None
    name = lambda s: one(spark, D.date_from_name(F.lit(s)))
    assert name("IMG_20230812_153012.jpg") == dt.datetime(2023, 8, 12, 15, 30, 12)
    assert name("PXL_20240101_000102345.jpg") == dt.datetime(2024, 1, 1, 0, 1, 2)
    assert name("WhatsApp Image 2022-12-24 at 19.45.10.jpeg") == dt.datetime(2022, 12, 24, 19, 45, 10)
    assert name("IMG_1234.JPG") is None
    period = lambda s: one(spark, D.period_from_path(F.lit(s)))["start"]
    assert period("2019/2019-03") == dt.date(2019, 3, 1)
    assert period("Holidays 2017") == dt.date(2017, 1, 1)


def test_labels(spark):
    label = lambda a, b: one(spark, D.range_label(F.lit(a), F.lit(b)))
    assert label("2023-08-12", "2023-08-12") == "12 August 2023"
    assert label("2023-08-12", "2023-08-15") == "12–15 August 2023"
    assert label("2023-08-30", "2023-09-02") == "30 August – 2 September 2023"
    assert label("2023-12-30", "2024-01-02") == "30 December 2023 – 2 January 2024"
    title = lambda a, b, c, n, h: one(spark, D.segment_title(F.lit(a), F.lit(b), F.lit(c).cast("string"), F.lit(n).cast("string"), F.lit(h)))
    assert title("2023-12-25", "2023-12-25", "Lyon", "France", "Lyon") == "Christmas in Lyon"
    assert title("2023-08-12", "2023-08-15", "Florence", "Italy", "Lyon") == "Stay in Florence"
    assert title("2023-08-13", "2023-08-13", None, None, "Lyon") == "Sunday 13 August 2023"


def test_names(spark):
    assert one(spark, N.sanitize(F.lit("con"))) == "_con"
    assert one(spark, N.camera(F.lit("Apple"), F.lit("Apple iPhone 15"))) == "Apple iPhone 15"
    made = N.from_pattern("{date} {time}", stem=F.lit("x"), taken_at=F.lit("2023-08-12 13:30:05").cast("timestamp"), offset=F.lit(120), index=F.lit(7), camera=F.lit("c"))
    assert one(spark, made) == "2023-08-12 15.30.05"
    assert one(spark, N.byte_label(F.lit(1536))) == "1.5 KB"
    assert one(spark, N.ext(F.lit("no_dot"))) == ""


def test_numbers(spark):
    assert one(spark, hamming_hex(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert one(spark, hamming_hex(F.lit("8000000000000001"), F.lit("0" * 16))) == 2
    assert one(spark, M.iso6709(F.lit("+00.0+000.0/"))) is None
    assert one(spark, M.iso6709(F.lit("+48.8566+002.3522/")))["lat"] == pytest.approx(48.8566)
    h = lambda b: one(spark, M.quick_hash(F.lit(b), block=8))
    assert h(b"x" * 40) != h(b"x" * 41) and h(b"abcdefgh" + b"1" * 24 + b"end-----") == h(b"abcdefgh" + b"2" * 24 + b"end-----")


BASE = dt.datetime(2023, 8, 12, 10)


def moments_frame(spark):
    b, y = ("Biarritz", 43.48, -1.56), ("Bayonne", 43.49, -1.47)
    rows = [(0, *b), (0.5, *b), (1, *b), (2, *y), (2.2, *y), (9, *b), (30, "Biarritz", None, None), (30.1, "Biarritz", None, None)]
    data = [(i + 1, 1, BASE + dt.timedelta(hours=h), (BASE + dt.timedelta(hours=h)).strftime("%Y-%m-%d"), c, "France", la, lo) for i, (h, c, la, lo) in enumerate(rows)]
    return spark.createDataFrame(data, "asset_id long, source_id long, taken_at timestamp, day string, city string, country string, lat double, lon double")


def test_moments(spark):
    df = S.segment(moments_frame(spark), "source_id")
    got = {r["asset_id"]: r["seg"] for r in df.collect()}
    groups = [[a for a in sorted(got) if got[a] == s] for s in sorted(set(got.values()))]
    assert groups == [[1, 2, 3], [4, 5], [6], [7, 8]]
    cities = {r["seg"]: r["city"] for r in S.summarise(df, "source_id").collect()}
    assert cities[2] == "Bayonne"
    merged = {r["asset_id"]: r["seg"] for r in S.merge_tiny(df, "source_id").collect()}
    assert merged[6] != merged[4]  # over six hours apart


def test_live_segments_match_batch(spark, tmp_path):
    from lightframe.streaming.live import live_segments

    df = moments_frame(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live_segments(stream).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    live = {r["asset_id"]: r["seg"] for r in spark.table("live").collect()}
    assert live == {r["asset_id"]: r["seg"] for r in S.segment(df, "source_id").collect()}


def test_brackets(spark):
    t = [0, 300, 600, 60_000]
    rows = [(i, 1, BASE + dt.timedelta(milliseconds=ms), "M", e, "0" * 16) for i, (ms, e) in enumerate(zip(t, [1 / 800, 1 / 200, 1 / 50, 1 / 50], strict=True))]
    df = spark.createDataFrame(rows, "asset_id long, source_id long, taken_at timestamp, model string, exposure double, phash string")
    got = S.bracket_series(S.bracket_islands(df, "source_id"), "source_id").collect()
    assert {(r["asset_id"], r["is_keeper"]) for r in got} == {(0, False), (1, True), (2, False)}


def test_unique_names_cascade(spark):
    rows = [(1, "d", "a", "jpg"), (2, "d", "A", "jpg"), (3, "d", "a (2)", "jpg"), (4, "e", "a", "jpg")]
    got = S.unique_names(spark.createDataFrame(rows, "id long, dir string, base string, ext string")).collect()
    names = [(r["dir"], r["name"].lower()) for r in got]
    assert len(set(names)) == 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_burst_successors(spark):
    rows = [(i, BASE + dt.timedelta(milliseconds=10 * i), "0123456789abcdef", str(i), "jpg", 1, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "asset_id long, taken_at timestamp, phash string, qhash string, ext string, width int, height int")
    got = U.burst_pairs(df).collect()
    assert len(got) == sum(min(39, 49 - i) for i in range(50))


def test_dense_bursts_are_whole(spark, monkeypatch):
    from lightframe.plans import q_dedup as Q

    # 70 photos in 20 s: the first is like the last alone, the others like each other
    rows = [(i, BASE + dt.timedelta(milliseconds=100 * i), "0" * 16 if i in (0, 69) else "f" * 16, str(i), "jpg", 1, 1, False, i / 100, 10) for i in range(70)]
    df = spark.createDataFrame(rows, "asset_id long, taken_at timestamp, phash string, qhash string, ext string, width int, height int, favorite boolean, quality double, size long")
    monkeypatch.setattr(Q, "_burst_rows", lambda spark, d: df)
    assert {(r["a"], r["b"]) for r in Q.burst_pairs(spark, "").collect()} == {(0, 69)} | {(a, b) for a in range(1, 69) for b in range(a + 1, 69)}
    assert {(r["node"], r["component"]) for r in Q.components(spark, "").collect()} == {(i, 0 if i in (0, 69) else 1) for i in range(70)}
    assert {(r["component"], r["n"], r["keep_id"], r["reclaimable"]) for r in Q.keeper_burst(spark, "").collect()} == {(0, 2, 69, 10), (1, 68, 68, 670)}
    wide = df.withColumns({"k": F.col("asset_id"), "brightness": F.lit(0.5)})
    monkeypatch.setattr(Q, "_burst_rows", lambda spark, d: wide)
    assert {r["component"] for r in Q.keeper_reasons(spark, "").collect()} == {0, 1}


def test_near_pairs_of_hot_bands(spark):
    rng = random.Random(5)
    made = {f"abcd{rng.getrandbits(48):012x}" for _ in range(450)}  # one band over the feature's 400
    for h in sorted(made)[:60]:
        v = int(h, 16)
        for i in rng.sample(range(64), rng.randrange(1, 5)):
            v ^= 1 << i
        made.add(f"{v:016x}")
    hashes = sorted(made)
    rows = [(i, h, str(i)) for i, h in enumerate(hashes)] + [(1000 + i, hashes[0], "copy") for i in range(450)] + [(2000, hashes[0], None), (2001, hashes[0], None), (2002, hashes[1], "copy"), (2003, None, "x")]
    df = spark.createDataFrame(rows, "asset_id long, phash string, qhash string")
    got = U.near_pairs(df, hot=100).collect()
    want = set()
    for k, (i, p, c) in enumerate(rows):
        for j, q, e in rows[k + 1 :]:
            if p and q and (c is None or e is None or c != e) and (n := (int(p, 16) ^ int(q, 16)).bit_count()) <= 3:
                want.add((min(i, j), max(i, j), n))
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 900
    assert {tuple(r) for r in U.near_pairs(df).collect()} == want
    assert U.near_pairs(df, most=400).count() < len(want)


def test_diverse(spark):
    rows = [(1, 4 * h + j, BASE + dt.timedelta(hours=h, minutes=j), 0.9 if j == 0 else 0.2, False, 0) for h in range(10) for j in range(4)]
    df = spark.createDataFrame(rows, "g long, asset_id long, taken_at timestamp, quality double, favorite boolean, faces int").withColumns({"emb": F.lit(None).cast("array<double>"), "phash": F.lit(None).cast("string")})
    got = C.diverse(df, "g", pick=10).collect()
    assert len(got) == 10 and sum(r["asset_id"] % 4 == 0 for r in got) >= 8 and len({r["asset_id"] // 4 for r in got}) >= 8


def test_page_and_rank_agree(spark, sf_dir):
    from lightframe.functions.filters import visible
    from lightframe.sources.adapters import assets

    a = assets(spark, sf_dir).where(visible())
    rows = T.page(a, 40, 5).select("asset_id").collect()
    for i, r in enumerate(rows):
        assert T.index_of(a, a.where(F.col("asset_id") == r["asset_id"])).first()["rank"] == 40 + i


def test_no_usable_rule_is_true(spark):
    assert one(spark, rules("all", [{"field": "unknown"}])) is True


def test_images(spark):
    rng = np.random.default_rng(1)
    flat, noise = bytes([128] * 1024), rng.integers(0, 256, 1024, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([(1, flat, 32), (2, noise, 32), (3, None, 32), (4, b"abc", 2)], "id long, pixels binary, width int")
    got = {r["id"]: r for r in I.features(df).collect()}
    assert got[1]["sharpness"] == 0 and got[2]["sharpness"] > 1000 and got[3]["phash"] is None and got[4]["phash"] is None
    assert len(got[2]["phash"]) == 16


def test_clustering_finds_planted_people(spark):
    from lightframe.streaming.live import cluster_batch

    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    base = [unit(rng.normal(size=128)) for _ in range(3)]
    rows = [(10 * p + j, unit(base[p] + 0.55 * unit(rng.normal(size=128))).tolist(), 0.9) for j in range(6) for p in range(3)] + [(99, base[0].tolist(), 0.1)]
    empty = spark.createDataFrame([], "id long, centroid array<double>, n long")
    loose = spark.createDataFrame([], "id long, emb array<double>, quality double")
    clusters, rest = cluster_batch(spark.createDataFrame([r for r in rows if r[0] % 10 < 3 or r[0] == 99], "id long, emb array<double>, quality double"), empty, loose)
    made = clusters.collect()
    assert len(made) == 3 and all(r["n"] == 2 for r in made)
    clusters, rest = cluster_batch(spark.createDataFrame([r for r in rows if 3 <= r[0] % 10 < 9], "id long, emb array<double>, quality double"), clusters, rest)
    assert sum(r["n"] for r in clusters.collect()) >= 15
    assert 99 not in {r["id"] for r in rest.collect()}  # too poor to be held


def test_change_batches(spark):
    from lightframe.streaming.live import change_batches

    catalogue = spark.createDataFrame([("d/a", 1, 1, False), ("d/b", 1, 1, False), ("d_x/c", 1, 1, False), ("e", 1, 1, True)], "path string, size long, mtime long, is_missing boolean")
    out = {}
    apply = change_batches(lambda: catalogue, lambda df: out.update({r["path"]: r["action"] for r in df.collect()}))
    events = [("d", None, None, True, 1), ("e", 1, 1, False, 2), ("f", 1, 1, True, 3), ("f", 2, 2, False, 4)]
    apply(spark.createDataFrame(events, "path string, size long, mtime long, gone boolean, seq long"), 0)
    assert out == {"d/a": "missing", "d/b": "missing", "e": "reappeared", "f": "insert"}


def test_listing(spark):
    from lightframe.sources.export import is_shortcut, listed

    paths = ["a/b.jpg", "a/.hidden.jpg", "a/~t.jpg", ".x/b.jpg", "L.photoslibrary/b.jpg", "node_modules/b.jpg", "a/b.txt", "a/B.MOV"]
    df = spark.createDataFrame([(p, 5) for p in paths] + [("a/empty.jpg", 0)], "path string, length long")
    assert {r["path"] for r in listed(df).collect()} == {"a/b.jpg", "a/B.MOV"}
    assert one(spark, is_shortcut(F.lit(b"book\0\0\0\0mark\0\0\0\0"), F.lit(100))) is True
    assert one(spark, is_shortcut(F.lit(b"\xff\xd8\xff"), F.lit(100))) is False


def test_export_and_cities(spark, tmp_path):
    from lightframe.sources.export import cities, export, listing, with_layout

    df = spark.createDataFrame([(1, dt.datetime(2023, 12, 31, 23, 30)), (2, dt.datetime(2024, 1, 1, 9))], "asset_id long, taken_at timestamp")
    export(with_layout(df, offset=F.lit(60)), str(tmp_path / "out"), folders="month")
    back = spark.read.option("inferSchema", False).parquet(str(tmp_path / "out"))
    assert {(r["asset_id"], str(r["year"]), r["year_month"]) for r in back.collect()} == {(1, "2024", "2024-01"), (2, "2024", "2024-01")}
    assert listing(spark, str(tmp_path / "out")).count() >= 1
    (tmp_path / "geo.json").write_text('{"countries": {"FR": "France"}, "cities": [["Biarritz", 43.48, -1.56, "FR", "Nouvelle-Aquitaine", 25000], ["Nowhere", 0.5, 0.5, "XX", null, null]]}')
    got = {r["city"]: r for r in cities(spark, str(tmp_path / "geo.json")).collect()}
    assert got["Biarritz"]["country"] == "France" and got["Biarritz"]["population"] == 25000 and got["Nowhere"]["country"] is None


def test_geocode_cases(spark):
    from lightframe.operators.geo import geocode

    c = spark.createDataFrame([("Biarritz", 43.48, -1.56, 25000), ("Paris", 48.86, 2.35, 2100000), ("Fiji", -16.8, -179.95, 5000)], "city_id string, lat double, lon double, population long")
    p = spark.createDataFrame([(1, 43.4832, -1.5586), (2, 48.8566, 2.3522), (3, 0.0, 0.0), (4, None, 1.0), (5, -16.8, 179.95)], "point_id long, lat double, lon double")
    assert {r["point_id"]: r["city_id"] for r in geocode(p, c).collect()} == {1: "Biarritz", 2: "Paris", 3: None, 4: None, 5: "Fiji"}


def test_staged_work_parks_failures(spark):
    from lightframe.streaming.live import staged

    rows = spark.createDataFrame([(1, 1, 0, None), (2, 0, 0, None), (3, 1, 2, 1), (4, 1, 1, 2)], "asset_id long, meta int, thumb int, thumb_version int")
    out = {r["asset_id"]: (r["thumb"], r["thumb_version"]) for r in staged(rows, "thumb", lambda df: df.select("asset_id", (F.col("asset_id") != 3).alias("ok")), need="meta", version=2).collect()}
    assert out == {1: (1, 2), 2: (0, None), 3: (2, 2), 4: (1, 2)}


def test_live_duplicates_and_likes(spark, tmp_path):
    from lightframe.streaming.live import live_likes, live_near

    known = spark.createDataFrame([(1, "0123456789abcdef")], "asset_id long, phash string")
    new = spark.createDataFrame([(2, "0123456789abcdee"), (3, "fedcba9876543210")], "asset_id long, phash string")
    assert [(r["asset_id"], r["known_id"]) for r in live_near(new, known).distinct().collect()] == [(2, 1)]
    likes = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, None, "Bo"), (2, None, "bo")], "asset_id long, member_id long, author string")
    assert {(r["asset_id"], r["member"], r["liked"]) for r in live_likes(likes, "asset_id").collect()} == {(1, "5", False), (1, "name:bo", True), (2, "name:bo", True)}


def test_live_near_meets_few_and_loses_none(spark):
    """Pairs up to three bits apart come out once each, wherever the bits lie; one equal band alone makes no candidates."""
    import itertools
    import random

    from lightframe.streaming.live import live_near

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    far = [(b & ~0xFFFF) ^ (r.getrandbits(48) << 16) for b in base]
    new = base + far
    known = [b ^ sum(1 << i for i in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 3, 3, 4)]
    frame = lambda rows, name: spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(rows)] + [(-1, None), (-2, ""), (-3, "0123")], f"{name} long, phash string")
    a, b = frame(new, "asset_id"), frame(known, "asset_id")
    for bits in (0, 2, 3):
        got = [tuple(x) for x in live_near(a, b, bits=bits).collect()]
        assert sorted(got) == [(i, j) for (i, x), (j, y) in itertools.product(enumerate(new), enumerate(known)) if (x ^ y).bit_count() <= bits]
    shares = lambda x, y: any(((x ^ y) >> s) & 0xFFFF == 0 for s in (0, 16, 32, 48))
    wide = sorted(tuple(x) for x in live_near(a, b, bits=20).collect())
    assert wide == [(i, j) for (i, x), (j, y) in itertools.product(enumerate(new), enumerate(known)) if (x ^ y).bit_count() <= 20 and shares(x, y)]
