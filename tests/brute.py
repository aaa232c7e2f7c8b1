"""The jobs' rules as plain loops over sorted rows, for tests."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

HOUR = 3_600_000


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def ms(r):
    return r["ms"]


def segments(rows):
    """Lists of rows, given in order of time and id."""
    out, prev, place = [], None, None
    for r in rows:
        here = (r["lat"], r["lon"]) if r["lat"] is not None and r["lon"] is not None else None
        gap = None if prev is None else r["ms"] - prev["ms"]
        far = here is not None and place is not None and km(place, here) > 3
        other = prev is not None and prev["city"] is not None and r["city"] is not None and prev["city"] != r["city"]
        if gap is None or gap > 4 * HOUR or (gap > 40 * 60_000 and (far or other)) or (prev["day"] != r["day"] and gap > 2 * HOUR):
            out.append([])
        out[-1].append(r)
        prev, place = r, here or place
    return out


def vote(rows, name="city"):
    n = Counter(r[name] for r in rows if r[name] is not None)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(r[name], i)
    return max(n, key=lambda c: (n[c], -first[c])) if n else None


def merged(segs):
    out = []
    for s in segs:
        if out and len(s) < 3 and s[0]["day"] == out[-1][0]["day"] and s[0]["ms"] - out[-1][-1]["ms"] < 6 * HOUR:
            a, b = vote(out[-1]), vote(s)
            if a is None or b is None or a == b:
                out[-1].extend(s)
                continue
        out.append(list(s))
    return out


def trips(moments, home):
    """Runs of moments (lists of rows) away from home that last two days and have eight rows; indexes."""
    import datetime as dt

    out, run = [], []

    def close():
        while run and not away(run[0]):
            run.pop(0)
        if run:
            first, last = moments[run[0]][0]["day"], moments[run[-1]][-1]["day"]
            days = (dt.date.fromisoformat(last) - dt.date.fromisoformat(first)).days + 1
            if days >= 2 and sum(len(moments[i]) for i in run) >= 8:
                out.append(list(run))
        run.clear()

    def away(i):
        m = moments[i]
        return vote(m) is not None and vote(m, "country") is not None and vote(m) != home

    for i, m in enumerate(moments):
        city, country = vote(m), vote(m, "country")
        unknown = (city is None or country is None) and not (city is not None and city == home)
        if run and m[0]["ms"] - moments[run[-1]][-1]["ms"] > 2 * 24 * HOUR:
            close()
        if away(i) or (unknown and run):
            run.append(i)
        elif not unknown:
            close()
    close()
    return out


def shortlist(rows, pick):
    cap = max(200, 12 * pick)
    if len(rows) <= cap:
        return list(rows)
    slices, per = 4 * pick, -(-cap // (4 * pick))
    by = defaultdict(list)
    for r, x in enumerate(sorted(rows, key=lambda x: (x["ms"], x["id"])), 1):
        by[math.ceil(r * slices / len(rows))].append(x)
    return [x for s in by.values() for x in sorted(s, key=lambda x: (-x["quality"], x["id"]))[:per]]


def diverse(rows, pick, spread=20.0):
    """The chosen rows in the order in which they are picked."""
    rows = sorted(rows, key=lambda x: x["id"])
    base = {x["id"]: 0.7 * x["quality"] + 0.35 * x["favorite"] + min(0.25, 0.1 * x["faces"]) - 0.05 for x in rows}
    like, near, alive, chosen = Counter(), Counter(), list(rows), []
    while alive and len(chosen) < pick:
        c = max(alive, key=lambda x: (0.7 * base[x["id"]] - (1 - 0.7) * (like[x["id"]] + 0.6 * near[x["id"]]), -x["id"]))
        chosen.append(c)
        left = []
        for x in alive:
            if x is c:
                continue
            bits = (int(x["phash"], 16) ^ int(c["phash"], 16)).bit_count()
            if bits <= 8:
                continue
            like[x["id"]] = max(like[x["id"]], max(0.0, 1 - bits / 24))
            near[x["id"]] = max(near[x["id"]], max(0.0, 1 - abs(x["ms"] - c["ms"]) / 60_000 / spread))
            left.append(x)
        alive = left
    return chosen


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return [sorted(g) for g in groups.values() if len(g) > 1]


def brackets(rows, gap, sure):
    """Series of frames, rows in order of time."""
    out, cur = [], []

    def close():
        if len(cur) >= 2:
            ev = [math.log2(r["exposure"]) for r in cur]
            span = max(ev) - min(ev)
            if (len(cur) >= 3 and span >= 1.5) or (len(cur) == 2 and span >= 2):
                out.append(list(cur))
        cur.clear()

    for r in rows:
        if not r["exposure"] or r["exposure"] <= 0 or not r["model"]:
            close()
            continue
        if cur:
            p = cur[-1]
            fits = r["ms"] - p["ms"] <= gap and all(r[c] == p[c] for c in ("model", "fnumber", "iso", "width")) and all(abs(math.log2(r["exposure"] / x["exposure"])) >= 0.2 for x in cur)
            if not (fits and (r["ms"] - p["ms"] <= sure or (int(r["phash"], 16) ^ int(p["phash"], 16)).bit_count() <= 22)):
                close()
        cur.append(r)
    close()
    return out
