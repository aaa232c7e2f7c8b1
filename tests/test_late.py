"""Streams that come out of order give what a batch over all rows gives; stages survive a stop between and within batches."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lightframe.streaming import late as L
from lightframe.streaming.stages import Stage

from . import brute as B

START = dt.datetime(2024, 3, 1)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def arrive(spark, path, batches, schema):
    """Each batch a file, in order of time of writing."""
    import os

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/tmp{n}")
        name = next(f for f in os.listdir(f"{path}/tmp{n}") if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/tmp{n}/{name}", f"{path}/in/{n:04d}.parquet")
        os.utime(f"{path}/in/{n:04d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def through(spark, df, path):
    L.state_store(spark)
    try:
        df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(df.schema).parquet(f"{path}/out").collect()


def shuffled(rows, seconds, n, r):
    """Rows in batches, each up to `seconds` later than its time says."""
    order = sorted(rows, key=lambda x: x["s"] + r.random() * seconds)
    size = -(-len(order) // n)
    return [order[i : i + size] for i in range(0, len(order), size)]


def test_settled_segments(spark, tmp_path):
    r = random.Random(4)
    rows, s = [], 0.0
    for i in range(400):
        s += r.choice((60, 600, 2000, 3000, 9000, 20_000))
        city = r.choice((None, "A", "A", "B"))
        placed = r.random() < 0.6
        rows.append({"id": i, "s": s, "u": r.choice((1, 2, 3)), "ms": int(s * 1000), "city": city, "lat": 40.0 + (r.random() if r.random() < 0.2 else 0) if placed else None, "lon": 1.0 if placed else None, "day": f"{at(s):%Y-%m-%d}"})
    delay = 6 * 3600
    batches = shuffled(rows, delay * 0.9, 6, r)
    make = lambda b: [(x["id"], x["u"], at(x["s"]), x["lat"], x["lon"], x["city"], x["day"]) for x in b]
    flush = [(10_000 + k, 9, at(s + d), None, None, None, "x") for k, d in enumerate((10 * delay, 20 * delay))]
    late = [(20_000, 1, at(5), None, None, None, "x")]
    stream = arrive(spark, tmp_path, [*map(make, batches), flush, late], "asset_id long, source_id long, taken_at timestamp, lat double, lon double, city string, day string")
    out = through(spark, L.settled_segments(stream, delay=f"{delay} seconds"), tmp_path)
    got = {x["asset_id"]: (x["source_id"], x["seg"]) for x in out if x["source_id"] != 9 and not x["is_late"]}
    per = defaultdict(list)
    for x in rows:
        per[x["u"]].append(x)
    want = {x["id"]: (u, i) for u, mine in per.items() for i, seg in enumerate(B.segments(mine), 1) for x in seg}
    assert got == want and len([x for x in out if x["asset_id"] < 10_000]) == len(rows)
    assert all(x["is_late"] for x in out if x["asset_id"] == 20_000)


def test_near_arrivals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L._Arrivals, "PAGE", 16)
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(300):
        h = r.choice(base)
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            h ^= 1 << r.randrange(64)
        rows.append({"id": i, "s": r.random() * 40_000, "h": f"{h:016x}"})
    delay, within = 3000, 5000
    batches = shuffled(rows, delay * 0.9, 6, r)
    make = lambda b: [(x["id"], at(x["s"]), x["h"]) for x in b]
    stream = arrive(spark, tmp_path, [*map(make, batches), [(9000, at(200_000), "0" * 16), (9001, at(5), None), (9002, None, "0" * 16)]], "asset_id long, taken_at timestamp, phash string")
    out = [tuple(x) for x in through(spark, L.near_arrivals(stream, within_seconds=within, delay=f"{delay} seconds"), tmp_path)]
    apart = lambda a, b: (int(a["h"], 16) ^ int(b["h"], 16)).bit_count()
    want = {(a["id"], b["id"], apart(a, b)) for i, a in enumerate(rows) for b in rows[i + 1 :] if abs(a["s"] - b["s"]) <= within and apart(a, b) <= 3}
    assert len(out) == len(set(out)) and set(out) == want
    with pytest.raises(ValueError):
        L.near_arrivals(stream, bits=4)


def test_debounced(spark, tmp_path):
    """A burst on a path is one action, two sessions are two; what is still noisy waits."""
    rows = [("a", at(0), 1, 1, False, 1), ("a", at(1), 2, 2, False, 2), ("a", at(2.4), 3, 3, False, 3), ("b", at(1), 9, 9, False, 4), ("a", at(10), 4, 4, True, 5), ("c", at(99), 1, 1, False, 6)]
    stream = arrive(spark, tmp_path, [[rows[2], rows[3]], [rows[0], rows[1]], [rows[4]], [rows[5]]], "path string, at timestamp, size long, mtime long, gone boolean, seq long")
    q = L.debounced(stream, "path")
    q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = sorted((x["path"], x["events"], x["size"], x["gone"]) for x in spark.read.schema(q.schema).parquet(f"{tmp_path}/out").collect())
    assert out == [("a", 1, 4, True), ("a", 3, 3, False), ("b", 1, 9, False)]


def test_stage_survives_stops(spark, tmp_path):
    rows = spark.createDataFrame([(i, at(i), int(i % 10 != 0)) for i in range(95)] + [(200, None, 1)], "asset_id long, taken_at timestamp, meta int")
    seen: list[list[int]] = []

    def work(df, stop: int | None = None):
        ids = sorted(x["asset_id"] for x in df.collect())
        if stop is not None and len(seen) == stop:
            raise RuntimeError("stopped")
        seen.append(ids)
        return df.select("asset_id", (F.col("asset_id") % 7 != 0).alias("ok"))

    make = lambda version=1: Stage(spark, f"file://{tmp_path}/stage", version=version, need="meta", batch_rows=20)
    assert make().run(rows, work, most_batches=1) == 1
    with pytest.raises(RuntimeError):
        make().run(rows, lambda df: work(df, 3))
    # a batch whose table was written, but not the log
    stage = make()
    plan = next(e for e in stage.log() if "batches" in e)
    rows.limit(3).select("asset_id", F.lit(False).alias("ok")).write.parquet(f"{tmp_path}/stage/batch-lost")
    more = rows.unionByName(spark.createDataFrame([(300, at(500), 1)], rows.schema))
    assert make().run(more, work) == 3  # what was left of the plan, then what has come since
    due = [i for i in range(95) if i % 10]
    assert plan["batches"] == 5 and sorted(i for b in seen for i in b) == sorted([*due, 200, 300])
    assert seen[0] == sorted(due)[-20:] and seen[-1] == [300] and 200 in seen[-2]  # the newest first, times unknown last
    state = {x["asset_id"]: (x["state"], x["state_version"]) for x in stage.state(more).collect()}
    assert all(state[i] == ((2 if i % 7 == 0 else 1), 1) if i in {*due, 200, 300} else state[i] == (0, None) for i in state)
    assert make().run(more, work) == 0  # failures are parked
    assert make(2).run(more, work) == 5 and stage.results().where("version = 2").count() == len(due) + 2
    with pytest.raises(Exception, match="exist"):
        stage._commit(0, {})


def test_a_key_has_one_timer():
    """Rows of many slots cost one timer, and come out whole as the watermark passes them."""
    import pandas as pd

    class Cell(dict):
        exists = lambda self: "v" in self
        get = lambda self: self["v"]
        update = lambda self, v: self.__setitem__("v", v)
        getValue = lambda self, k: self[k]
        containsKey = dict.__contains__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        def __init__(self):
            self.timers, self.most = set(), 0
            self.getValueState = self.getMapState = lambda *_: Cell()
            self.deleteTimer = self.timers.discard

        def registerTimer(self, ms):
            self.timers.add(ms)
            self.most = max(self.most, len(self.timers))

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    how, handle, out = L._Moments("u", "id", 10_000, 50.0, 50.0, 3.0, 50.0), Handle(), []
    how.init(handle)
    frame = pd.DataFrame([(i, 1000 * i, None, None, None, "x") for i in range(40)], columns=["k", "ms", "lat", "lon", "city", "day"])
    for part in (frame[20:], frame[:20].iloc[::-1]):
        list(how.handleInputRows((1,), iter([part]), Now(0)))
    for now in (0, 15_500, 15_900, 20_000, 100_000):
        for t in [t for t in handle.timers if t <= now]:
            handle.timers.discard(t)
            out += [r for f in how.handleExpiredTimer((1,), Now(now), None) for r in f.itertuples(index=False, name=None)]
        assert len(out) == sum(1000 * i <= now for i in range(40))
    assert out == [(1, i, i + 1, False) for i in range(40)] and not handle.timers and handle.most == 1


def test_owners_share_a_bucket(monkeypatch):
    """Rows of many owners wait together, in loose and slotted pages of any number, come out as their times pass with the segments of
    a batch over all, and late ones are told; the store is called by pages, not by rows."""
    import pandas as pd

    calls = [0]

    class State(dict):
        def call(f):
            def counted(*a):
                calls[0] += 1
                return f(*a)

            return counted

        exists = call(lambda self: "v" in self)
        get = call(lambda self: self["v"])
        update = call(lambda self, v: self.__setitem__("v", v))
        getValue = call(lambda self, k: self[k])
        containsKey, updateValue, removeKey = call(dict.__contains__), call(dict.__setitem__), call(dict.__delitem__)

    def run(batches):
        timers, states, out, late = set(), {}, {}, []
        handle = type("Handle", (), {"registerTimer": lambda _, ms: timers.add(ms), "deleteTimer": lambda _, ms: timers.discard(ms)})()
        handle.getValueState = handle.getMapState = lambda name, *_: states.setdefault(name, State())
        for n, (frames, now) in enumerate(batches, 1):
            how = L._Moments("u", "id", 6 * 3_600_000, 4 * 3_600_000, 40 * 60_000, 3.0, 2 * 3_600_000)  # nothing is kept but what the store has
            how.init(handle)
            clock = type("Now", (), {"getCurrentWatermarkInMs": lambda _, now=now: now})()
            for f in how.handleInputRows((0,), iter(frames), clock) if frames else ():
                late += [tuple(r) for r in f[["id", "u", "seg", "is_late"]].itertuples(index=False)]
            assert len(timers) <= 1
            for t in [t for t in timers if t <= now]:
                timers.discard(t)
                for f in how.handleExpiredTimer((0,), clock, None):
                    for i, u, seg, flag in f[["id", "u", "seg", "is_late"]].itertuples(index=False):
                        assert i not in out and not flag and ms[i] <= now
                        out[i] = (u, seg)
            assert {i for b, _ in batches[:n] for f in b for i in f["k"] if ms[i] <= now} == out.keys() | {x[0] for x in late}
        assert not timers and not states["waiting"]
        return out, late

    r = random.Random(11)
    rows, s = [], 0.0
    for i in range(900):
        s += r.choice((6, 60, 200, 300, 900, 2000))
        placed = r.random() < 0.6
        rows.append({"id": i, "s": s, "u": r.choice(("=1", "=2", "=30", "=-4", "", *(f"={k}" for k in range(50, 70)))), "ms": int(s * 1000), "city": r.choice((None, "A", "A", "B")), "lat": 40.0 + (r.random() if r.random() < 0.2 else 0) if placed else None, "lon": 1.0 if placed else None, "day": f"{at(s):%Y-%m-%d}"})
    ms = {x["id"]: x["ms"] for x in rows}
    frame = lambda some: pd.DataFrame([(x["u"], x["id"], x["ms"], x["lat"], x["lon"], x["city"], x["day"]) for x in some], columns=["owner", "k", "ms", "lat", "lon", "city", "day"])
    per = defaultdict(list)
    for x in rows:
        per[x["u"]].append(x)
    want = {x["id"]: (u, i) for u, mine in per.items() for i, seg in enumerate(B.segments(mine), 1) for x in seg}

    delay = 6 * 3600
    parts = shuffled(rows, delay * 0.9, 9, r)
    batches = [([frame(p[:70]), frame(p[70:])], max(max(x["ms"] for x in p) - delay * 1000, 0)) for p in parts] + [([], ms[899])]
    for sizes in ({}, {"PAGE": 16, "BATCH": 64, "GATHERED": 32, "OWNERS": 8}):
        for k, v in sizes.items():
            monkeypatch.setattr(L._Moments, k, v)
        monkeypatch.setattr(L._Known, "PAGES", 32 if not sizes else 3)
        assert run(batches) == (want, [])
    monkeypatch.undo()
    again = {x["id"]: x for x in rows}
    last = max((x for x in rows if x["u"] == "=2"), key=lambda x: x["ms"])
    ms[1000] = ms[1001] = 5
    old = frame([{**again[0], "id": 1000, "ms": 5, "u": "=2"}, {**again[0], "id": 1001, "ms": 5, "u": "=none"}])
    out, late = run([([frame(rows)], ms[899]), ([old], ms[899])])
    assert late == [(1000, "=2", want[last["id"]][1], True)] and out == want | {1001: ("=none", 1)}  # an owner's first row is never late
    calls[0] = 0
    run([([frame(rows)], ms[899])])
    assert calls[0] < 60, "calls of the store go by rows"
