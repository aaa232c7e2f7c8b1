"""Substring dedup: windows of `window` words that occur anywhere else in the corpus, by FM-indexes of shards.

What meets in a shard is decided by content. Every window has an anchor, the 6-word run in it with the least hash (the
leftmost of equals), so equal windows have equal anchors. Successive windows of one anchor are cut out as one segment,
which holds exactly these windows. Segments whose anchor occurs once in the corpus can't repeat and stay at home; the
others go, equal ones together with their number, to the shard of their anchor. There a compressed FM-index is built and
the shard's segments are streamed through it: backward search reports the windows found at least twice.

An anchor with very many different segments (the edge of a passage that countless documents hold) is dealt out by
window instead: windows go to shards by their own hash, equal ones together with their number. Exact copies of a text take
part once with their number; joins by anchor, segment or text deal keys of many rows over several tasks. So no key gathers
more than a bounded part.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.llm.fm_index import FMIndex, repeated_windows
from lightframe.llm.shared import checked, drop_stash, hot_keys, spread_join, stash
from lightframe.llm.words import Words, gram_hashes, mix, pieces, spread

ANCHOR = 6
#: An anchor with more different segments is dealt out by window.
HOT_SEGMENTS = 256
#: Words in one FM-index, about.
SHARD_WORDS = 400_000

#: Low bits that hold a place among the grams of one block; the rest of a gram's hash ranks it.
_PLACE = np.uint64((1 << 22) - 1)
_BLOCK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `size` words from `first`: differences of one running polynomial."""
    running = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h)), out=running[1:], dtype=np.uint64)
    inside = running[first + size] - running[first]
    return mix(inside * _inverse_powers(len(h))[first] + size.astype(np.uint64))


_GROWN: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    return _grown("up", _BASE, n)[:n]


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", np.uint64(pow(int(_BASE), -1, 1 << 64)), n)[:n]


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64, kept and lengthened as longer texts come."""
    if len(_GROWN.get(name, ())) <= n:
        _GROWN[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(4096, 2 * n), base))), dtype=np.uint64)
    return _GROWN[name]


def segments(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of texts, text k having words first[k] to first[k + 1]: the hash of the anchor, the first window
    and the number of windows of each segment."""
    grams = gram_hashes(h, ANCHOR)
    span = window - ANCHOR + 1
    n = max(0, len(h) - window + 1)
    # the least of each `span` grams: the high bits are the hash's, so the leftmost of equals wins
    at = np.empty(n, np.int64)
    for i in range(0, n, _BLOCK):
        low = (grams[i : min(n, i + _BLOCK) + span - 1] & ~_PLACE) | np.arange(min(n - i, _BLOCK) + span - 1, dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: size - span], low[span - size :])
        at[i : i + _BLOCK] = (low & _PLACE).astype(np.int64) + i
    # windows lie within one text
    opens = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(first) >= window)
    opens[first[long]] += 1
    opens[first[long + 1] - window + 1] -= 1
    inside = np.flatnonzero(np.cumsum(opens)[:-1])
    at = at[inside]
    lead = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
    return grams[at[lead]].view(np.int64), inside[lead], np.diff(np.concatenate((lead, [len(at)])))


def _cut(window: int):
    """Texts -> a row for each different (anchor, segment) of a text, with all its starts."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, 3):
                words = Words(b.column(3))
                h = words.hashes()
                anchor, first, width = segments(h, words.first, window)
                seg = run_hashes(h, first, width + window - 1).view(np.int64)
                text = np.searchsorted(words.first, first, "right") - 1
                order = np.lexsort((seg, anchor, text))
                anchor, seg, text, first, width = anchor[order], seg[order], text[order], first[order], width[order]
                new = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
                lead = np.flatnonzero(np.concatenate(([True], new))) if len(text) else np.empty(0, np.int64)
                ends = np.concatenate((lead, [len(text)]))
                starts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first - words.first[text], pa.int32()))
                k1, k2, copies = (b.column(i).to_numpy(zero_copy_only=False)[text[lead]] for i in range(3))
                cols = (anchor[lead], seg[lead], k1, k2, width[lead], np.diff(ends) * copies)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), starts], ["anchor", "seg", "k1", "k2", "width", "occurs", "starts"])

    return run


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for `size[0]` numbers, then those of the next run."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _words_of_segments(window: int):
    """(text, cuts) -> units for the shards: whole segments, or single windows of hot anchors."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, 0):
                words = Words(b.column(0))
                h = words.hashes()
                cuts = b.column(1)
                ends = cuts.offsets.to_numpy()
                anchor, seg, start, width, occurs, hot = (cuts.values.field(f).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for f in ("anchor", "seg", "start", "width", "occurs", "hot"))
                start = start + words.first[np.repeat(np.arange(b.num_rows), np.diff(ends))]
                # an anchor's segments are told apart by their own hash, its windows by theirs
                parts = np.where(hot, width, 1)
                of = np.repeat(np.arange(len(seg)), parts)
                offset = runs(np.zeros(len(seg), np.int64), parts)
                hot, start, n = hot[of], start[of] + offset, np.where(hot, window, width + window - 1)[of]
                unit = np.where(hot, run_hashes(h, start, n).view(np.int64), seg[of])
                cols = (anchor[of], seg[of], hot, offset, unit, np.where(hot, 1, width[of]), occurs[of])
                for lo, hi in _bounded(n):
                    yield _unit_batch([c[lo:hi] for c in cols], h[runs(start[lo:hi], n[lo:hi])], n[lo:hi])

    return run


def _bounded(n: np.ndarray, most: int = 1 << 20):
    """Slices of units with about `most` words."""
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _unit_batch(cols: list[np.ndarray], flat: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    ends = np.concatenate(([0], np.cumsum(n) * 8)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), words], ["anchor", "seg", "hot", "offset", "unit", "width", "occurs", "words"])


def _search(window: int):
    """Units sorted by group -> (anchor, unit, mask). Shards of about SHARD_WORDS words are cut between groups.

    A shard's words are numbered, its units indexed, and the same units streamed through the index."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        words = rows.column(5).combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        raw, ends = spread(words)
        sizes = np.diff(ends) // 8
        codes = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)[1]
        index = FMIndex(codes, sizes, rows.column(4).to_numpy() > 1)
        masks = repeated_windows(index, codes, sizes, rows.column(3).to_numpy(), window)
        return pa.RecordBatch.from_arrays([rows.column(1).combine_chunks(), rows.column(2).combine_chunks(), pa.array(masks)], ["anchor", "unit", "mask"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for b in (whole.slice(i, 2048) for i in range(0, whole.num_rows, 2048)):
                held.append(b)
                size += b.column(5).nbytes // 8
                if size >= SHARD_WORDS:
                    rows = pa.Table.from_batches(held)
                    group = rows.column(0).to_numpy()
                    turns = np.flatnonzero(group[1:] != group[:-1])
                    if len(turns):
                        cut = int(turns[-1]) + 1
                        yield flush(rows.slice(0, cut).combine_chunks())
                        held = rows.slice(cut).combine_chunks().to_batches()
                        size = sum(x.column(5).nbytes // 8 for x in held)
        if held and sum(x.num_rows for x in held):
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def _gone(marks: pa.ListArray, words: Words, window: int) -> np.ndarray:
    """Whether each word lies in a marked window: bits of the masks, moved to every start of their segment."""
    ends = marks.offsets.to_numpy()
    marked = marks.values.slice(ends[0], ends[-1] - ends[0])
    text = np.repeat(np.arange(len(marks)), np.diff(ends))
    starts, mask = marked.field("starts"), marked.field("mask").to_numpy()
    at = starts.offsets.to_numpy()
    of = np.repeat(np.arange(len(mask)), np.diff(at))
    start = starts.values.to_numpy()[at[0] : at[-1]] + words.first[text[of]]
    turns = np.zeros(len(words.start) + 1, np.int64)
    for lo in range(0, len(of), 1 << 16):
        bits = np.unpackbits(mask[of[lo : lo + (1 << 16)]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        first = start[lo + row] + bit
        turns += np.bincount(first, minlength=len(turns)) - np.bincount(first + window, minlength=len(turns))
    return np.cumsum(turns)[:-1] > 0


def _remove(window: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, 1):
                words = Words(b.column(1))
                gone = _gone(b.column(2), words, window)
                n = np.diff(words.first)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                kept = []
                for text, lost, first in zip(b.column(1).to_pylist(), removed.tolist(), words.first.tolist(), strict=False):
                    parts = (text or b"").split()
                    if lost:
                        parts = list(compress(parts, (~gone[first : first + len(parts)]).tolist()))
                    kept.append(b" ".join(parts))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (UTF-8 of the words left, joined by one space) for every row.

    Words are runs without ASCII white space, unchanged. A word goes if a window of `window` words over it (at most 60)
    starts anywhere else too, in another row or the same one; windows are judged on the input. Null texts have no
    words; shorter texts no windows. Repeated rows are copies of each other whatever their id, null included; ids are
    passed through and other columns not read. An empty table gives an empty result."""
    if not ANCHOR < window <= 60:
        raise ValueError("windows take 7 to 60 words")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("k1"), F.crc32(text.cast("binary")).alias("k2"))
    keys = ["k1", "k2"]
    texts = rows.where("text is not null")
    # of the rows that repeat a text, one of the least id; its id may be on several, which then fold into one
    per_id = texts.groupBy(*keys, "id").agg(F.count("*").alias("n"))
    copies = per_id.groupBy(*keys).agg(F.sum("n").alias("copies"), F.min(F.struct("id", "n")).alias("least")).where("copies > 1")
    copies = stash(copies.select(*keys, "copies", F.col("least.id").alias("first"), (F.col("least.n") > 1).alias("again")), "copies")
    firsts = texts.join(checked(copies), keys, "left").where(F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("first")))
    fields = [*keys, F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "text"]
    again = F.coalesce("again", F.lit(False))
    firsts, folded = firsts.where(~again).select(*fields), firsts.where(again).select(*fields)
    if copies.where("again").limit(1).count():
        firsts = firsts.unionByName(stash(folded.groupBy(*keys, "copies").agg(F.first("text").alias("text")), "folded"))

    found = stash(firsts.mapInArrow(_cut(window), "anchor long, seg long, k1 long, k2 long, width int, occurs long, starts array<int>"), "segments")
    again = stash(found.groupBy("anchor").agg(F.sum("occurs").alias("occurs"), F.count("*").alias("n")).where("occurs > 1"), "again")
    kept = stash(spread_join(found, again.select("anchor"), ["anchor"], hot_keys(again, ["anchor"], always=True), keys), "anchored")
    drop_stash(found, again)
    distinct = stash(
        kept.groupBy("anchor", "seg", "width").agg(F.sum("occurs").alias("occurs"), F.count("*").alias("n"), F.min(F.struct("k1", "k2", F.col("starts")[0].alias("start"))).alias("at")).select("anchor", "seg", "width", "occurs", "n", "at.*"),
        "distinct",
    )
    many = stash(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEGMENTS), "many")
    cuts = spread_join(distinct, many.select("anchor", F.lit(True).alias("hot")), ["anchor"], hot_keys(many, ["anchor"], always=True), ["seg"], "left").groupBy(*keys).agg(F.collect_list(F.struct("anchor", "seg", "start", "width", "occurs", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("cuts"))
    units = stash(
        firsts.join(cuts, keys).select("text", "cuts").mapInArrow(_words_of_segments(window), "anchor long, seg long, hot boolean, offset int, unit long, width int, occurs long, words binary"), "units"
    )
    whole = units.where("not hot").select(F.xxhash64("anchor").alias("g"), "anchor", "unit", "width", "occurs", "words")
    single = units.where("hot").groupBy("anchor", "unit", "width").agg(F.sum("occurs").alias("occurs"), F.first("words").alias("words"))
    every = whole.unionByName(single.select(F.xxhash64("anchor", "unit").alias("g"), "anchor", "unit", "width", "occurs", "words"))
    words = units.agg(F.sum(F.octet_length("words") / 8).alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(words // SHARD_WORDS))
    masks = stash(every.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_search(window), "anchor long, unit long, mask long").where("mask != 0"), "masks")
    # back from units to segments, from segments to texts
    of_unit = units.select("anchor", "seg", "offset", "unit").join(masks, ["anchor", "unit"])
    of_segment = of_unit.groupBy("anchor", "seg").agg(F.bit_or(F.call_function("shiftleft", F.col("mask"), F.col("offset"))).alias("mask"))
    marks = spread_join(kept, of_segment, ["anchor", "seg"], hot_keys(distinct, ["anchor", "seg"], always=True), keys).groupBy(*keys).agg(F.collect_list(F.struct("starts", "mask")).alias("marks"))
    out = spread_join(rows, marks, keys, hot_keys(copies.withColumnRenamed("copies", "n"), keys, always=True), ["id"], "left").select("id", "text", "marks")
    return out.mapInArrow(_remove(window), f"doc_id {kind}, n_words long, n_removed long, kept binary")


def report(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
