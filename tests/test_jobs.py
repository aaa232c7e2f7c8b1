"""Jobs and greedy folds against plain loops."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightframe.functions.filters import cleanup_classes, visible
from lightframe.functions.names import ORIGINAL
from lightframe.operators import curate as C
from lightframe.operators import incremental as I
from lightframe.operators import ordered
from lightframe.operators import sessions as S
from lightframe.plans import jobs as J
from lightframe.plans.queries import QUERIES
from lightframe.sources.adapters import assets

from . import brute as B


def rows_of(df):
    out = [r.asDict() for r in df.withColumn("ms", F.unix_millis("taken_at")).withColumn("id", F.col("asset_id")).collect()]
    return sorted(out, key=lambda r: (r["ms"], r["id"]))


def shown(rows):
    return [r for r in rows if not r["hidden"] and not r["missing"] and not r["trashed"]]


def per(rows, name="source_id"):
    out = defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


def home_of(rows):
    n = Counter(r["city"] for r in rows if not r["hidden"] and not r["missing"] and r["city"] is not None)
    return max(n, key=lambda c: (n[c], c)) if n else None


@pytest.fixture(scope="module")
def catalogue(spark, sf_dir):
    return rows_of(assets(spark, sf_dir))


def test_segments_span_tasks(spark, catalogue, monkeypatch):
    """One source in many ranges: what one range hands to the next is carried."""
    monkeypatch.setattr(ordered, "WHOLE_ROWS", 0)
    df = spark.createDataFrame([(r["id"], None if r["id"] % 7 == 0 else 1, r["taken_at"], r["day"], r["city"], r["lat"], r["lon"]) for r in catalogue], "asset_id long, source_id long, taken_at timestamp, day string, city string, lat double, lon double")
    got = {r["asset_id"]: (r["source_id"], r["seg"]) for r in S.segment(df, "source_id").collect()}
    for source, mine in per([r | {"source_id": None if r["id"] % 7 == 0 else 1} for r in catalogue]).items():
        for i, s in enumerate(B.segments(mine), 1):
            assert all(got[r["id"]] == (source, i) for r in s)


def test_merged_moments(spark, sf_dir, catalogue):
    got = {(r["source_id"], r["start_ms"], r["n"], r["day_start"], r["city"]) for r in QUERIES["merged_moments"](spark, sf_dir).collect()}
    want = {(u, s[0]["ms"], len(s), s[0]["day"], B.vote(s)) for u, mine in per(shown(catalogue)).items() for s in B.merged(B.segments(mine))}
    assert got == want


def test_merge_in_dense_sources(spark, catalogue):
    rows = [r | {"source_id": r["source_id"] % 3} for r in shown(catalogue)]
    df = spark.createDataFrame([(r["id"], r["source_id"], r["taken_at"], r["day"], r["city"], r["country"], r["lat"], r["lon"]) for r in rows], "asset_id long, source_id long, taken_at timestamp, day string, city string, country string, lat double, lon double")
    got = Counter((r["source_id"], r["seg"]) for r in S.merge_tiny(S.segment(df, "source_id"), "source_id").collect())
    assert sorted(got.values()) == sorted(len(s) for mine in per(rows).values() for s in B.merged(B.segments(mine)))


def test_only_runs_that_may_merge_are_folded(spark, monkeypatch):
    """A segment alone between days, gaps and large segments stays as it is; what follows one another within six hours is folded."""
    at = lambda h: dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    # user 1: one segment a day; user 2: a large one, then two tiny ones that join it, then one beyond the gap
    data = [(d, 1, at(24 * d + 9), d + 1) for d in range(20)] + [(100 + i, 2, at(1 + i / 10), 1) for i in range(3)] + [(110, 2, at(6), 2), (111, 2, at(11), 3), (112, 2, at(17), 4), (113, None, at(1), 1)]
    df = spark.createDataFrame([(i, u, t, t.strftime("%Y-%m-%d"), "C", seg) for i, u, t, seg in data], "asset_id long, source_id long, taken_at timestamp, day string, city string, seg long")
    folded, plain = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: (folded.append(self.count()), plain(self, *a, **k))[1])
    got = {r["asset_id"]: r["seg"] for r in S.merge_tiny(df, "source_id").collect()}
    assert got == {i: {110: 1, 111: 1}.get(i, seg) for i, u, _, seg in data if u is not None}
    assert folded == [3]


def test_plan_diff_brings_columns_along(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "sig string, fp string")
    new = spark.createDataFrame([("b", "x", 2), ("c", "y", 3), ("d", "x", 4)], "sig string, fp string, n int")
    assert {tuple(r) for r in I.plan_diff(old, new, "n").collect()} == {("a", "delete", None), ("b", "keep", 2), ("c", "replace", 3), ("d", "insert", 4)}


def brute_plan(rows, by="source_id"):
    """source -> (moments, their trips as indexes, home)"""
    return {u: (m := B.merged(B.segments(shown(mine))), B.trips(m, home_of(mine)), home_of(mine)) for u, mine in per(rows, by).items()}


def cover(moment):
    return max(moment, key=lambda r: (r["kind"] != "video", r["quality"] or 0, -r["ms"], -r["id"]))["id"]


def test_moments_plan(spark, sf_dir, catalogue):
    new = {}
    for u, (moments, runs, _) in brute_plan(catalogue).items():
        trip = {i: moments[run[0]][0]["id"] for run in runs for i in run}
        for i, m in enumerate(moments):
            new[f"{m[0]['day']}:{m[0]['id']}"] = (u, len(m), cover(m), trip.get(i), m[0]["ms"], m[-1]["ms"], [r["id"] for r in m])
    old = {f"{m[0]['day']}:{m[0]['id']}": [r["id"] for r in m] for moments, _, _ in brute_plan([r for r in catalogue if r["id"] % 97]).values() for m in moments}
    got = {r["sig"]: r for r in QUERIES["moments_plan"](spark, sf_dir).collect()}
    assert set(got) == set(new) | set(old)
    for sig, r in got.items():
        if sig not in new:
            assert r["action"] == "delete" and r["n"] is None
            continue
        assert (r["source_id"], r["n"], r["cover_id"], r["trip"], r["start_ms"], r["end_ms"]) == new[sig][:6]
        if sig not in old:
            assert r["action"] == "insert"
        elif old[sig] != new[sig][6]:
            assert r["action"] == "replace"
    assert {r["action"] for r in got.values()} >= {"keep", "delete", "insert"} or len(got) < 50


def test_trip_titles(spark):
    from lightframe.functions.dates import segment_subtitle, trip_title

    df = spark.createDataFrame([(["A"], "2024-05-01", "2024-05-03"), (["A", "B"], "2024-05-01", "2024-05-08"), (["A", "B", "C"], "2024-05-30", "2024-06-02"), (["A", "B", "C", "D"], "2024-12-30", "2025-01-02")], "c array<string>, a string, b string")
    got = [r[0] for r in df.select(trip_title(F.col("c"), F.col("a"), F.col("b"))).collect()]
    assert got == [
        "Getaway to A · May 2024 · 1–3 May 2024", "Trip to A and B · May 2024 · 1–8 May 2024", "Getaway to A, B and 1 other · May 2024 · 30 May – 2 June 2024", "Getaway to A, B and 2 others · December 2024 · 30 December 2024 – 2 January 2025",
    ]
    rows = [("2024-05-04", "2024-05-04", "A", "X", "H"), ("2024-05-04", "2024-05-06", "A", "X", "H"), ("2024-05-06", "2024-05-06", "H", "France", "H"), ("2024-12-25", "2024-12-25", None, None, "H"), ("2024-05-04", "2024-05-06", None, None, "H")]
    df = spark.createDataFrame(rows, "a string, b string, city string, country string, home string")
    assert [r[0] for r in df.select(segment_subtitle(*(F.col(c) for c in df.columns))).collect()] == ["Saturday 4 May 2024", "A, X · 4–6 May 2024", "6 May 2024", "25 December 2024", ""]


def test_cleanup_report(spark, sf_dir):
    rows = rows_of(J._cleanup_rows(spark, sf_dir))
    seen = shown(rows)
    by_id = {r["id"]: r for r in seen}
    popcount = lambda h: int(h, 16).bit_count()
    apart = lambda a, b: popcount(f"{int(a['phash'], 16) ^ int(b['phash'], 16):x}")
    tabs = defaultdict(list)  # (ids, keeper)
    exact = lambda r: 100 * r["favorite"] + 50 * r["in_album"] + 5 * (r["date_source"] == "exif") - len(r["rel_dir"]) / 1000 - r["ms"] / 1e15
    mpx = lambda r: r["width"] * r["height"] / 1e6
    visual = lambda r: 1000 * r["favorite"] + 500 * r["in_album"] + 10 * mpx(r) + 5 * (r["ext"] in ORIGINAL) + r["quality"] + r["size"] / 1e10
    burst = lambda r: 1000 * r["favorite"] + 500 * r["in_album"] + 100 * r["quality"] + 0.1 * mpx(r)
    best = lambda ids, score: max(ids, key=lambda i: (score(by_id[i]), -i))
    for g in per(seen, "qhash").values():
        if len(g) > 1:
            ids = sorted(r["id"] for r in g)
            tabs["exact"].append((ids, best(ids, exact)))
    photos = [r for r in seen if r["kind"] == "photo" and 8 <= popcount(r["phash"]) <= 56]
    timed = [r for r in photos if r["date_source"] != "mtime"]
    series = B.brackets(timed, 600_000, 600_000)
    inside = {r["id"] for s in series for r in s}
    for s in series:
        by_exposure = sorted(s, key=lambda r: (math.log2(r["exposure"]), r["id"]))
        tabs["brackets"].append((sorted(r["id"] for r in s), by_exposure[len(s) // 2]["id"]))
    single = [r for r in timed if r["id"] not in inside]
    same = lambda a, b: (a["ext"], a["width"], a["height"]) == (b["ext"], b["width"], b["height"])
    edges = []
    for i, a in enumerate(single):
        for b in single[i + 1 :]:
            if b["ms"] - a["ms"] > 86_400_000:
                break
            n = apart(a, b)
            if a["qhash"] != b["qhash"] and n <= 14 and not (n <= 3 and not same(a, b)):
                edges.append((a["id"], b["id"]))
    groups = B.components([r["id"] for r in single], edges)
    of = {i: k for k, g in enumerate(groups) for i in g}
    tabs["bursts"] += [(g, best(g, burst)) for g in groups]
    edges = [(a["id"], b["id"]) for i, a in enumerate(photos) for b in photos[i + 1 :] if a["qhash"] != b["qhash"] and apart(a, b) <= 3 and not (a["id"] in of and of[a["id"]] == of.get(b["id"]) and same(a, b))]
    tabs["visual"] += [(g, best(g, visual)) for g in B.components([r["id"] for r in photos], edges)]
    want = {}
    for tab, found in tabs.items():
        found = [(ids, keep) for ids, keep in found if ids[0] % 11]
        if found:
            want[tab] = (len(found), sum(len(ids) for ids, _ in found), 0 if tab == "brackets" else sum(by_id[i]["size"] for ids, keep in found for i in ids if i != keep))
    each = J._cleanup_rows(spark, sf_dir).where(visible() & ~F.col("favorite") & ~F.col("in_album") & (F.col("asset_id") % 41 != 0))
    for r in each.select("size", F.explode(cleanup_classes(F.lit("2024-04-15").cast("timestamp"))).alias("t")).collect():
        n, size = want.get(r["t"], (0, 0, 0))[1:]
        want[r["t"]] = (0, n + 1, size + r["size"])
    got = {r["tab"]: (r["groups"], r["items"], r["bytes"]) for r in QUERIES["cleanup_report"](spark, sf_dir, seconds=86_400).collect()}
    assert got == want and {"exact", "bursts", "visual", "brackets"} <= set(want)


def test_ignored_and_fused(spark):
    from lightframe.operators import dedup as U

    rows = spark.createDataFrame([(i, i // 3, 10 * i) for i in range(9)], "asset_id long, g long, size long")
    g = U.groups(rows, "g", score=F.col("size"))
    assert {(r["g"], r["group_id"], r["n"], r["keep_id"], r["reclaimable"]) for r in g.collect()} == {(0, 0, 3, 2, 10), (1, 3, 3, 5, 70), (2, 6, 3, 8, 130)}
    made = spark.createDataFrame([(100, i) for i in range(3)] + [(101, i) for i in (3, 4, 5)] + [(102, 6), (102, 7)], "result long, source long")
    there = spark.createDataFrame([(100, False, False), (101, True, False), (102, False, False)], "asset_id long, trashed boolean, missing boolean")
    assert {r["g"] for r in U.without_fused(g, made, there).collect()} == {1, 2}  # 101 is in the trash, 102 of other sources
    items = spark.createDataFrame([("item:4",), ("item:x",), ("3:0:1:2",)], "signature string")
    assert {r["asset_id"] for r in U.without_ignored_items(rows, items).collect()} == set(range(9)) - {4}


def test_mmr_select(spark, sf_dir, catalogue):
    want = set()
    for kind, mine in per(shown(catalogue), "event_type").items():
        pool = B.shortlist([r | {"faces": r["id"] % 3, "phash": r["qhash"]} for r in mine], 10)
        want |= {(kind, r["id"], i) for i, r in enumerate(B.diverse(pool, 10))}
    assert {(r["event_type"], r["asset_id"], r["pick_order"]) for r in QUERIES["mmr_select"](spark, sf_dir).collect()} == want


def test_memory_proposals(spark, sf_dir):
    a, faces, labels = J._memories(spark, sf_dir)
    rows = rows_of(a)
    by_id = {r["id"]: r for r in rows}
    photos = [r for r in shown(rows) if r["kind"] == "photo"]
    label = {r["asset_id"]: (r["label"], r["score"]) for r in labels.collect()}
    face = {r["asset_id"]: (r["person_id"], r["name"]) for r in faces.collect()}
    usable = {r["id"]: r | {"faces": int(r["id"] in face)} for r in photos if not r["is_screenshot"] and label[r["id"]][0] != "document" and (r["model"] or r["id"] in face)}
    members = defaultdict(set)
    for (lib, year), n in Counter((r["source_id"], r["day"][:4]) for r in photos).items():
        if n >= 24 and int(year) < 2025:
            members["year", f"year:{lib}:{year}"] = {r["id"] for r in photos if r["source_id"] == lib and r["day"][:4] == year}
    for lib, (moments, runs, _) in brute_plan(rows).items():
        for run in runs:
            members["trip", f"trip:{lib}:{moments[run[0]][0]['ms'] // 86_400_000}"] |= {r["id"] for i in run for r in moments[i]}
        inside = {i for run in runs for i in run}
        big = [m for i, m in enumerate(moments) if i not in inside and len(m) >= 30][-60:]
        for m in big:
            members["moment", f"moment:{lib}:{m[0]['id']}"] = {r["id"] for r in m}
    for (lib, person), n in Counter((by_id[i]["source_id"], p) for i, (p, name) in face.items() if name and not by_id[i]["trashed"] and not by_id[i]["missing"]).items():
        if n >= 20:
            members["person", f"person:{lib}:{person}"] = {i for i, (p, name) in face.items() if name and p == person and by_id[i]["source_id"] == lib}
    for i, (name, score) in label.items():
        if name in J.CATEGORIES and score >= 0.5:
            members["category", f"category:{by_id[i]['source_id']}:{name}"].add(i)
    for r in photos:
        if "2024-01-14" <= r["day"] <= "2024-01-20":
            members["onThisDay", f"onThisDay:{r['source_id']}:2024:1:2"].add(r["id"])
    want = set()
    for (kind, key), ids in members.items():
        most, least = J.MEMORIES[kind]
        pool = [usable[i] for i in ids if i in usable]
        chosen = B.diverse(B.shortlist(pool, most), most) if len(pool) >= least else []
        if len(chosen) >= least:
            top = max(chosen, key=lambda r: (r["quality"] + 0.2 * (r["faces"] > 0) + 0.3 * r["favorite"], -r["ms"], -r["id"]))
            want |= {(kind, key, r["id"], i, r is top) for i, r in enumerate(chosen)}
    got = {tuple(r) for r in QUERIES["memory_proposals"](spark, sf_dir).select("kind", "key", "asset_id", "pick_order", "is_cover").collect()}
    assert got == want and {k for k, *_ in want} >= {"year", "category", "onThisDay"}


def test_slideshow_plan(spark, sf_dir):
    from lightframe.plans.q_timeline import measured

    rows = rows_of(C.slideshow_items(measured(spark, sf_dir)).withColumns({"source_id": F.col("source_id") % 10, "day": F.concat((F.lit(2000) + F.floor(F.dayofmonth("taken_at") / 8)).cast("string"), F.substring("day", 5, 6))}))
    target = int((120 - 3) / 3.6 + 0.5)
    want = set()
    for u, mine in per(rows).items():
        mine = [r | {"faces": 0, "phash": r["qhash"], "quality": r["score"]} for r in mine]
        chosen = []
        for _, year in sorted(per([r | {"y": r["day"][:4]} for r in mine], "y").items()):
            quota = max(1, math.floor(len(year) / len(mine) * target + 0.5))
            chosen += B.diverse(B.shortlist(year, quota), quota, 45.0)
        if len(chosen) < target:
            taken = {r["id"] for r in chosen}
            rest = [r for r in mine if r["id"] not in taken]
            chosen += B.diverse(B.shortlist(rest, target - len(chosen)), target - len(chosen), 5.0)
        chosen.sort(key=lambda r: (r["ms"], r["id"]))
        videos, last, several = max(1, len(chosen) // 6), None, len({r["day"][:4] for r in chosen}) > 1
        for r in chosen:
            if r["kind"] == "video":
                if not videos:
                    continue
                videos -= 1
            seconds = min(4.0, max(2.0, r["duration"] - 0.5)) if r["kind"] == "video" else 3.6
            want.add((u, r["id"], r["kind"], seconds, several and r["day"][:4] != last))
            last = r["day"][:4]
    assert {tuple(r) for r in QUERIES["slideshow_plan"](spark, sf_dir).collect()} == want


def test_live_moments(spark, sf_dir, catalogue):
    """In order, the stream cuts as the batch does; it has hidden rows, too."""
    got = {r["asset_id"]: (r["source_id"], r["seg"], r["is_late"]) for r in QUERIES["live_moments"](spark, sf_dir).collect()}
    assert got == {r["id"]: (u, i, False) for u, mine in per(catalogue).items() for i, s in enumerate(B.segments(mine), 1) for r in s}


def test_keeper_reasons(spark, sf_dir, catalogue):
    seen = [r for r in shown(catalogue)]
    edges = []
    for i, a in enumerate(seen):
        for b in seen[i + 1 :]:
            if b["ms"] - a["ms"] > 20_000:
                break
            if (int(a["phash"], 16) ^ int(b["phash"], 16)).bit_count() <= 14:
                edges.append((a["id"], b["id"]))
    by_id = {r["id"]: r for r in seen}
    want = set()
    for g in B.components([r["id"] for r in seen], edges):
        of = [by_id[i] for i in g]
        expo = lambda r: abs(r["k"] % 31 / 30.0 - 0.47) + r["k"] % 11 / 10.0 + max(0.0, r["k"] % 7 / 6.0 - 0.05)
        keep = max(of, key=lambda r: (1000 * r["favorite"] + 100 * r["quality"] + 1.2, -r["id"]))
        rest = [r for r in of if r is not keep]
        said = [x for x, ok in (("favourite", keep["favorite"]), ("sharpest", keep["k"] % 90 > 1.25 * sum(r["k"] % 90 for r in rest) / len(rest)), ("best exposed", expo(keep) + 0.04 < min(map(expo, rest)))) if ok]
        want.add((g[0], keep["id"], ",".join(said or ["best overall"])))
    assert {tuple(r) for r in QUERIES["keeper_reasons"](spark, sf_dir).select("component", "keep_id", "reasons").collect()} == want


def test_cluster_batch(spark):
    """A batch against a snapshot, mates of the rest, and the merge, as loops."""
    from lightframe.streaming.live import cluster_batch

    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v)
    base = [unit(rng.normal(size=16)) for _ in range(6)]
    rows = [(i, unit(base[i % 6] + 0.5 * unit(rng.normal(size=16))), 0.1 if i % 10 == 9 else 0.9) for i in range(60)]
    known = [(1000 + j, base[j], 3, "A" if j == 0 else None) for j in range(2)]
    df = spark.createDataFrame([(i, v.tolist(), q) for i, v, q in rows], "id long, emb array<double>, quality double")
    start = spark.createDataFrame([(i, c.tolist(), n, name) for i, c, n, name in known], "id long, centroid array<double>, n long, name string")
    clusters, rest = cluster_batch(df, start, df.limit(0), pool=5)
    state = {i: [c, n, name] for i, c, n, name in known}
    free = []
    for i, v, q in rows:
        if q < 0.3:
            continue
        best = max(known, key=lambda c: float(v @ c[1]))
        if float(v @ best[1]) > 0.55:
            c, n, _ = state[best[0]]
            w = min(n, 50)
            state[best[0]][:2] = unit(c * w + v), n + 1
        else:
            free.append((i, v))
    mate = {i: max(((float(v @ w), -j) for j, w in free if j != i), default=(0, 0)) for i, v in free}
    used = set()
    for i, v in free:
        s, j = mate[i][0], -mate[i][1]
        if s > 0.62 and -mate[j][1] == i and i < j:
            state[i] = [unit(v + dict(free)[j]), 2, None]
            used |= {i, j}
    ids = sorted(state)
    edges = [(a, b) for a in ids for b in ids if a < b and (state[a][2] is None or state[b][2] is None) and float(state[a][0] @ state[b][0]) >= 0.72]
    groups = B.components(ids, edges) + [[i] for i in ids if not any(i in e for e in edges)]
    want = {g[0]: (sum(state[i][1] for i in g), unit(sum(state[i][0] * state[i][1] for i in g)), next((state[i][2] for i in g if state[i][2]), None)) for g in groups}
    got = {r["id"]: r for r in clusters.collect()}
    assert {i: (r["n"], r["name"]) for i, r in got.items()} == {i: (n, name) for i, (n, _, name) in want.items()} and any(len(g) > 1 for g in groups) and used
    assert all(np.allclose(got[i]["centroid"], c) for i, (_, c, _) in want.items())
    assert {r["id"] for r in rest.collect()} == set(sorted((i for i, _ in free if i not in used), reverse=True)[:5])


def test_cluster_stream(spark, sf_dir):
    rows = QUERIES["cluster_stream"](spark, sf_dir).collect()
    e = [r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    held = [i for i in e if i % 10 == 5 or i % 10 >= 3]
    assert sum(r["n"] for r in rows) == len(held) and {r["id"] for r in rows if r["is_loose"]} <= set(held)


def test_near_classes(spark):
    import random

    from lightframe.operators import dedup as U

    rng = random.Random(8)
    rows = []
    for i in range(300):
        h = int(f"{'abcd' if i % 2 else '1234'}{rng.choice(['0' * 12, 'f' * 12, 'a5' * 6])}", 16)
        for b in rng.sample(range(64), rng.randrange(4)):
            h ^= 1 << b
        rows.append((i, f"{h:016x}" if i % 23 else None, None if i % 29 == 0 else str(h) if i % 3 else str(i)))
    df = spark.createDataFrame(rows, "asset_id long, phash string, qhash string")
    linked = lambda a, b: a[1] and b[1] and (a[2] is None or b[2] is None or a[2] != b[2]) and (int(a[1], 16) ^ int(b[1], 16)).bit_count() <= 3
    edges = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if linked(a, b)]
    n = Counter(x for e in edges for x in e)
    of = {i: g[0] for g in B.components([r[0] for r in rows], edges) for i in g}
    for hot in (400, 3):
        assert {tuple(r) for r in U.near_classes(df, hot=hot).collect()} == {(i, of.get(i, i), n[i]) for i, _, _ in rows}


def test_cleanup_sends_on_little(spark, sf_dir, monkeypatch):
    """The report writes only what it reads of its rows, and few frames go to the fold of series."""
    written, frames = [], []
    keep, fold = J.checkpointed, J.S.bracket_series
    monkeypatch.setattr(J, "checkpointed", lambda df: written.append(df.columns) or keep(df))
    monkeypatch.setattr(J.S, "bracket_series", lambda df, **o: frames.append(df.count()) or fold(df, **o))
    catalogue = J._cleanup_rows(spark, sf_dir)
    nothing = spark.createDataFrame([], "result long, source long")
    J.cleanup(catalogue.where(visible()), nothing.selectExpr("'' as signature"), nothing, catalogue, now=F.lit("2024-04-15").cast("timestamp"), seconds=20)
    assert not {"source_id", "day", "city", "lat", "name", "rel_dir", "sharpness", "contrast", "k"} & set(written[0])
    assert frames[0] < catalogue.count() / 10
