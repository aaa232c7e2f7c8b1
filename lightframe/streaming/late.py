"""Streams whose rows come out of order: moments that wait for the watermark, arrivals that meet arrivals, debounced feeds.

State lies in the store, in pieces; what a call holds is some of these and one batch. `state_store` sets the store that these
operators need."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, TimestampType

from lightframe.functions.media import EARTH_KM

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Keyed state with timers and lists needs the store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _km(a: tuple, b: tuple) -> np.ndarray:
    """Distances of places given as arrays of degrees; NaN where one is."""
    la, lo, lb, lp = (np.radians(x) for x in (*a, *b))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


#: No time, and no name of a city or day.
_NEVER, _NONE = np.iinfo(np.int64).min, -1


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(rows)).read_all()


class _Known:
    """Of each owner that a call has met: the time, place, city, day and segment of its last row. Names are numbered. The store has
    them in `PAGES` values by the hash of the owner; those that are met are read, and written back together."""

    PAGES = 32
    FACTS = np.dtype([("ms", "i8"), ("lat", "f8"), ("lon", "f8"), ("city", "i8"), ("day", "i8"), ("seg", "i8")])

    def __init__(self, held, begun: bool):
        self.held, self.begun = held, begun
        self.names: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.at: dict = {}
        self.facts = np.zeros(1024, self.FACTS)
        self.pages: dict[int, list[int]] = {}

    def numbers(self, names: list) -> np.ndarray:
        return np.array([_NONE if n is None else self.names.setdefault(n, len(self.names)) for n in names], np.int64)

    def _add(self, owner, page: int) -> int:
        i = self.at[owner] = len(self.at)
        self.pages[page].append(i)
        if i == len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros(i, self.FACTS)))
        self.facts[i] = (_NEVER, np.nan, np.nan, _NONE, _NONE, 0)
        return i

    def places(self, owners: list) -> np.ndarray:
        """Where `facts` has the owners; the pages of those not met before are read."""
        for o in owners:
            if o in self.at:
                continue
            page = zlib.crc32(str(o).encode()) % self.PAGES
            if page not in self.pages:
                self.pages[page] = []
                if self.begun and self.held.containsKey((page,)):
                    t = _unpacked(self.held.getValue((page,))[0])
                    mine = [self._add(x, page) for x in t["owner"].to_pylist()]
                    for c in ("ms", "lat", "lon", "seg"):
                        self.facts[c][mine] = t[c].to_numpy()
                    for c in ("city", "day"):
                        self.facts[c][mine] = self.numbers(t[c].to_pylist())
            if o not in self.at:
                self._add(o, page)
        return np.fromiter((self.at[o] for o in owners), np.int64, len(owners))

    def keep(self) -> None:
        """What is known goes to the store."""
        owners, names = [*self.at], pa.array([*self.names, None], pa.string())
        for page, of in self.pages.items():
            facts = self.facts[of]
            columns = {"owner": pa.array([owners[i] for i in of])} | {c: facts[c] for c in ("ms", "lat", "lon", "seg")}
            columns |= {c: names.take(pa.array(np.where(facts[c] == _NONE, len(self.names), facts[c]))) for c in ("city", "day")}
            self.held.updateValue((page,), (_packed(pa.table(columns)),))
        self.begun = True
        self.forget()


class _Moments(StatefulProcessor):
    """Rows wait in slots of time; when the watermark passes a row, its place among its owner's rows is final. A call has the rows
    of a bucket of owners (column `owner`), or of one owner, its key. It has one timer, for the first that waits, whatever the number
    of its slots. Up to `PAGE` rows wait in one loose page, whatever their time, before they are dealt to slots. What is held in
    memory is `BATCH` rows that come, one slot and `GATHERED` rows that come out, and the last rows of up to `OWNERS` owners
    beside those of these rows."""

    #: Rows of one value of the store.
    PAGE = 4096
    #: Rows that are gathered before they go to the store and before they come out, and owners whose last rows are held.
    BATCH, GATHERED, OWNERS = 1 << 16, 1 << 14, 1 << 17

    def __init__(self, by: str, key: str, slot_ms: int, gap_ms: float, near_ms: float, far_km: float, day_gap_ms: float):
        self.by, self.key, self.slot_ms = by, key, slot_ms
        self.gap_ms, self.near_ms, self.far_km, self.day_gap_ms = gap_ms, near_ms, far_km, day_gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "page long", "rows binary")
        self.waiting = handle.getMapState("waiting", "slot long, page long", "rows binary")
        # the timer, and the time up to which rows have come out
        self.head = handle.getValueState("head", "timer long, settled long")

    def _wake(self, was: int | None, ms: int | None) -> None:
        """The timer is at `ms` instead of at `was`."""
        if was != ms:
            if was is not None:
                self.handle.deleteTimer(was)
            if ms is not None:
                self.handle.registerTimer(ms)

    def _page(self, slot: int, page: int) -> pa.Table:
        return _unpacked(self.waiting.getValue((slot, page))[0])

    def _paged(self, slot: int, rows: pa.Table, page: int) -> int:
        """Stores rows of a slot in pages from `page` on; the number of the last one."""
        for start in range(0, rows.num_rows, self.PAGE):
            page += start > 0
            self.waiting.updateValue((slot, page), (_packed(rows.slice(start, self.PAGE)),))
        return page

    def _wait(self, rows: pa.Table, pages: dict[int, list]) -> None:
        """Adds rows to the loose page or to their slots; `pages` has of each slot its last page and the rows of it, None if that
        isn't known."""
        loose = _NEVER in pages
        if loose:
            rows = pa.concat_tables((self._page(_NEVER, 0), rows))
        if rows.num_rows <= self.PAGE:
            pages[_NEVER] = (self._paged(_NEVER, rows, 0), rows.num_rows)
            return
        if loose:
            self.waiting.removeKey((_NEVER, 0))
            del pages[_NEVER]
        slots = rows["ms"].to_numpy() // self.slot_ms
        order = np.argsort(slots, kind="stable")
        rows, slots = rows.take(order), slots[order]
        edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
        for start, stop in zip(edges, edges[1:], strict=False):
            slot, more = int(slots[start]), rows.slice(start, stop - start)
            page, n = pages.get(slot, (-1, self.PAGE))
            if n is None or n + more.num_rows <= self.PAGE:
                held = self._page(slot, page)
                if held.num_rows + more.num_rows <= self.PAGE:
                    page, more = page - 1, pa.concat_tables((held, more))
            page = self._paged(slot, more, page + 1)
            pages[slot] = (page, (more.num_rows - 1) % self.PAGE + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was, settled = self.head.get() if self.head.exists() else (None, None)
        pages = {}
        if was is not None:  # nothing waits without a timer
            for slot, page in self.waiting.keys():
                pages[slot] = (max(page, pages[slot][0]) if slot in pages else page, None)
        first, known, held = was, _Known(self.last, settled is not None), []

        def taken() -> Iterator[pd.DataFrame]:
            nonlocal first
            t = pa.concat_tables(held)
            held.clear()
            ms = t["ms"].to_numpy()
            if settled is not None and (ms < settled).any():
                old = np.flatnonzero(ms < settled)
                code = t["owner"].combine_chunks().take(old).dictionary_encode()
                last = known.facts[known.places(code.dictionary.to_pylist())[code.indices.to_numpy()]]
                late = ms[old] < last["ms"]
                if late.any():
                    of = t.take(old[late])
                    yield pd.DataFrame({self.by: of["owner"].to_pandas(), self.key: of["k"].to_numpy(), "seg": last["seg"][late], "is_late": True})
                    t = t.take(np.setdiff1d(np.arange(len(ms)), old[late]))
                if len(known.at) > self.OWNERS:
                    known.forget()
            if t.num_rows:
                first = min([int(t["ms"].to_numpy().min())] + ([] if first is None else [first]))
                self._wait(t, pages)

        for frame in rows:
            column = lambda c, kind: pa.array(frame[c], kind, from_pandas=True)  # noqa: B023, E731
            owner = column("owner", pa.string()) if "owner" in frame else pa.array([key[0]] * len(frame))
            fields = {"owner": owner, "k": column("k", pa.int64()), "ms": column("ms", pa.int64()), "lat": column("lat", pa.float64()), "lon": column("lon", pa.float64()), "city": column("city", pa.string()), "day": column("day", pa.string())}
            held.append(pa.table(fields))
            if sum(t.num_rows for t in held) >= self.BATCH:
                yield from taken()
        if held:
            yield from taken()
        self._wake(was, first)
        if was != first:
            self.head.update((first, settled))

    def _settled(self, rows: pa.Table, known: _Known) -> pd.DataFrame:
        """Rows that are final, with their segments."""
        code = rows["owner"].combine_chunks().dictionary_encode()
        owners = code.dictionary.to_pylist()
        owner, k, ms = code.indices.to_numpy(), rows["k"].to_numpy(), rows["ms"].to_numpy()
        order = np.lexsort((k, ms, owner))
        owner, k, ms, lat, lon = owner[order], k[order], ms[order], rows["lat"].to_numpy()[order], rows["lon"].to_numpy()[order]

        def named(c: str) -> np.ndarray:
            code = rows[c].combine_chunks().dictionary_encode()
            numbers = known.numbers([*code.dictionary.to_pylist(), None])
            return numbers[code.indices.fill_null(len(numbers) - 1).to_numpy()[order]]

        city, day = named("city"), named("day")
        place = known.places(owners)[owner]
        last = known.facts[place]
        i, fresh = np.arange(len(ms)), np.diff(owner, prepend=-1) != 0
        start = np.maximum.accumulate(np.where(fresh, i, 0))
        back = lambda c, v: np.where(fresh, last[c], np.roll(v, 1))
        located = np.maximum.accumulate(np.where(np.isnan(lat) | np.isnan(lon), -1, i))
        seen = np.roll(located, 1)  # the last located row before; a first row has none
        mine = ~fresh & (seen >= start)
        far = _km((np.where(mine, lat[seen], last["lat"]), np.where(mine, lon[seen], last["lon"])), (lat, lon)) > self.far_km
        before, town = back("ms", ms), back("city", city)
        none = before == _NEVER
        gap = ms - np.where(none, ms, before)
        other = (town != _NONE) & (city != _NONE) & (town != city)
        new = none | (gap > self.gap_ms) | ((gap > self.near_ms) & (far | other)) | ((back("day", day) != day) & (gap > self.day_gap_ms))
        count = np.cumsum(new)
        seg = last["seg"] + count - (count - new)[start]
        ends = np.flatnonzero(np.append(fresh[1:], True))
        facts, here = last[ends], located[ends]
        placed = here >= start[ends]
        facts["ms"], facts["city"], facts["day"], facts["seg"] = ms[ends], city[ends], day[ends], seg[ends]
        facts["lat"], facts["lon"] = np.where(placed, lat[here], facts["lat"]), np.where(placed, lon[here], facts["lon"])
        known.facts[place[ends]] = facts
        return pd.DataFrame({self.by: np.array(owners, object)[owner], self.key: k, "seg": seg, "is_late": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = _Known(self.last, self.head.get()[1] is not None)
        held: dict[int, list[int]] = {}
        for slot, page in sorted(self.waiting.keys()):
            held.setdefault(slot, []).append(page)
        left, gone = [], []  # times of rows that wait on, and pages that don't
        loose, times = None, np.empty(0, np.int64)  # in order of time
        if held.pop(_NEVER, None):
            loose, rest = self._split(self._page(_NEVER, 0), now)
            loose = loose.take(np.argsort(loose["ms"].to_numpy(), kind="stable"))
            times = loose["ms"].to_numpy()
            if rest.num_rows:
                left.append(int(rest["ms"].to_numpy().min()))
                self._paged(_NEVER, rest, 0)
            else:
                gone.append((_NEVER, 0))
        taken, gathered = 0, []
        for slot, of in held.items():
            if slot * self.slot_ms > now:
                left.append(slot * self.slot_ms)
                break
            rows, rest = self._split(pa.concat_tables([self._page(slot, p) for p in of]), now)
            last = self._paged(slot, rest, 0) if rest.num_rows else -1
            left += [int(rest["ms"].to_numpy().min())] if rest.num_rows else []
            gone += [(slot, p) for p in of if p > last]
            gathered.append(rows)
            if len(times) > taken:
                until = int(np.searchsorted(times, (slot + 1) * self.slot_ms))
                gathered.append(loose.slice(taken, until - taken))
                taken = until
            if sum(t.num_rows for t in gathered) >= self.GATHERED:
                yield self._settled(pa.concat_tables(gathered), known)
                gathered = []
                if len(known.at) > self.OWNERS:
                    known.keep()
        if len(times) > taken:
            gathered.append(loose.slice(taken))
        if sum(t.num_rows for t in gathered):
            yield self._settled(pa.concat_tables(gathered), known)
        known.keep()
        ahead = min(left, default=None)
        if ahead is None:
            self.waiting.clear()
        else:
            for p in gone:
                self.waiting.removeKey(p)
            self.handle.registerTimer(ahead)  # the timer that fired is gone
        self.head.update((ahead, now))

    @staticmethod
    def _split(rows: pa.Table, now: int) -> tuple[pa.Table, pa.Table]:
        """The rows that are due, and those that aren't."""
        due = rows["ms"].to_numpy() <= now
        return (rows, rows.slice(0, 0)) if due.all() else (rows.filter(pa.array(due)), rows.filter(pa.array(~due)))

    def close(self) -> None:
        pass


#: Owners are dealt into so many buckets, each with its own state.
BUCKETS = 256


def settled_segments(stream: DataFrame, by: str = "source_id", *, key: str = "asset_id", at: str = "taken_at", delay: str = "1 day", slot_hours: float = 6.0, gap_hours: float = 4.0, near_minutes: float = 40.0, far_km: float = 3.0, day_gap_hours: float = 2.0) -> DataFrame:
    """The segmentation of `operators.sessions.segment` over a stream whose rows come up to `delay` out of order: by, key, seg, is_late.

    Rows are held, in slots of `slot_hours`, until the watermark passes them, and come out once, with the segment that a batch run over
    all rows gives. Rows that are older than what has come out are flagged is_late, with the current segment, if the source's
    own watermark lets them through. Keys of rows are integers; rows without a time are left out. Buckets of `by` share their state,
    so that calls of the store go by slots and not by rows; `by` passes as text."""
    kind = stream.schema[by].dataType
    hour = 3_600_000
    how = _Moments(by, key, int(slot_hours * hour), gap_hours * hour, near_minutes * 60_000, far_km, day_gap_hours * hour)
    text, told = F.col(by).cast("string"), F.substring(by, 2, 1 << 30)
    back = told.cast(kind)
    if isinstance(kind, BinaryType):
        text, back = F.hex(by), F.unhex(told)
    elif isinstance(kind, TimestampType):
        text, back = F.unix_micros(by).cast("string"), F.timestamp_micros(told.cast("long"))
    owner = F.coalesce(F.concat(F.lit("="), text), F.lit(""))
    rows = stream.where(F.col(at).isNotNull()).withWatermark(at, delay)
    rows = rows.select(F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int").alias("bucket"), owner.alias("owner"), F.col(key).cast("long").alias("k"), F.col(at), F.unix_millis(at).alias("ms"), "lat", "lon", "city", "day")
    out = rows.groupBy("bucket").transformWithStateInPandas(how, f"{by} string, {key} long, seg long, is_late boolean", "Append", "EventTime")
    return out.withColumn(by, F.when(F.col(by) != "", back))


class _Arrivals(StatefulProcessor):
    """Hashes that share a band; each arrival meets those that came before it, until they expire."""

    #: Hashes that are compared at once.
    PAGE = 4096

    def __init__(self, bits: int, within_ms: int):
        self.bits, self.within_ms = bits, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", "rows binary")
        self.count = handle.getValueState("count", "pages long, rows long")

    def _page(self, n: int) -> np.ndarray:
        return np.frombuffer(self.pages.getValue((n,))[0], np.int64).reshape(-1, 3)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        band = int(str(key[0]).split(":")[0])
        pages, held = self.count.get() if self.count.exists() else (0, 0)
        for frame in rows:
            new = frame[["id", "hash", "ms"]].to_numpy(np.int64)
            for start in range(0, len(new), self.PAGE):
                part = new[start : start + self.PAGE]
                yield from self._pairs(part, part, band, True)
                for n in range(pages):
                    if self.pages.containsKey((n,)):
                        yield from self._pairs(part, self._page(n), band, False)
                last = self._page(pages - 1) if pages and self.pages.containsKey((pages - 1,)) else np.empty((0, 3), np.int64)
                if pages and len(last) + len(part) <= self.PAGE:
                    self.pages.updateValue((pages - 1,), (np.concatenate((last, part)).tobytes(),))
                else:
                    self.pages.updateValue((pages,), (part.tobytes(),))
                    pages += 1
                held += len(part)
                self.handle.registerTimer(int(part[:, 2].min()) + self.within_ms + 1)
        self.count.update((pages, held))

    def _pairs(self, a: np.ndarray, b: np.ndarray, band: int, same: bool) -> Iterator[pd.DataFrame]:
        x = (a[:, 1][:, None] ^ b[:, 1][None, :]).view(np.uint64)
        near = (np.bitwise_count(x) <= self.bits) & (np.abs(a[:, 2][:, None] - b[:, 2][None, :]) <= self.within_ms) & (a[:, 0][:, None] != b[:, 0][None, :])
        if same:
            near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(near)
        # a pair is told by the first band that it shares
        first = np.full(len(i), 4)
        for k in range(3, -1, -1):
            first[((x[i, j] >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)) == 0] = k
        mine = first == band
        if mine.any():
            p, q = a[i[mine], 0], b[j[mine], 0]
            yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "bits": np.bitwise_count(x[i, j][mine]).astype(np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = timerValues.getCurrentWatermarkInMs() - self.within_ms
        for n in sorted(p[0] for p in self.pages.keys()):
            rows = self._page(n)
            left = rows[rows[:, 2] >= gone]
            if not len(left):
                self.pages.removeKey((n,))
            elif len(left) < len(rows):
                self.pages.updateValue((n,), (left.tobytes(),))
            if len(left):
                self.handle.registerTimer(int(left[:, 2].min()) + self.within_ms + 1)
        yield from ()

    def close(self) -> None:
        pass


def near_arrivals(stream: DataFrame, *, bits: int = 3, within_seconds: float = 3600.0, delay: str = "1 hour", key: str = "asset_id", at: str = "taken_at", phash: str = "phash") -> DataFrame:
    """Pairs (a, b, bits), a < b, of arrivals at most `within_seconds` apart whose hashes (16 hex digits) differ in at most `bits` bits, up
    to 3, so that they share one of four bands. What a row has to meet is kept until the watermark has passed it by that
    time; rows may come up to `delay` out of order. Rows without hash or time are left out; keys are integers."""
    if not 0 <= bits <= 3:
        raise ValueError("hashes that differ in over three bits need not share a band")
    rows = stream.where(F.col(phash).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay)
    half = lambda i: F.conv(F.substring(phash, i, 8), 16, 10).cast("long")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    bands = F.explode(F.array(*(F.concat(F.lit(f"{i}:"), F.substring(phash, i * 4 + 1, 4)) for i in range(4))))
    each = rows.select(bands.alias("band"), F.col(key).cast("long").alias("id"), value.alias("hash"), F.col(at), F.unix_millis(at).alias("ms"))
    return each.groupBy("band").transformWithStateInPandas(_Arrivals(bits, int(within_seconds * 1000)), "a long, b long, bits int", "Append", "EventTime")


def debounced(stream: DataFrame, *by: str, at: str = "at", gap: str = "1500 milliseconds", delay: str = "10 seconds", order: str = "seq", fields: tuple[str, ...] = ("size", "mtime", "gone")) -> DataFrame:
    """One row for each burst of events on a key: successive events less than `gap` apart are one session, told when it has been
    quiet for `gap`: by, first_at, last_at, events, and the `fields` of its last event by `order`."""
    session = F.session_window(at, gap)
    last = F.max_by(F.struct(*fields), F.col(order))
    out = stream.withWatermark(at, delay).groupBy(*by, session).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events"), last.alias("e"))
    return out.select(*by, "first_at", "last_at", "events", *(F.col(f"e.{c}").alias(c) for c in fields))
