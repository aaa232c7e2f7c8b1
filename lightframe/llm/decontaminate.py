"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. The automaton accepts every run of words
of every item; each document is streamed through it, tracking the length of the longest match that ends at each word.
A match of `window` words or more is a run of item windows, so all of its words are hit; items of fewer words
are one window each. For the items of a window, the state of the window's length is found by `anchor` links made offline.

The items are a stated query set: they are dealt into blocks of at most BLOCK_WORDS words and each block's automaton is
broadcast, so what a task holds is bounded however many items there are.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.llm.shared import stash

#: Words of benchmark items in one broadcast automaton.
BLOCK_WORDS = 300_000
#: The same words in a text whose letters keep their case.
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEEP).split()


class WindowAutomaton:
    """Generalised suffix automaton over word numbers, with item numbers at the states of windows."""

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        coded = [[self.number.setdefault(w, len(self.number)) for w in item] for item in items]
        self.next, self.link, self.length = [{}], [-1], [0]
        for item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        n = len(self.next)
        #: the state of a match's last `window` words; the nearest state at or above it that is a whole short item
        self.anchor, self.short = [-1] * n, [-1] * n
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, set[int]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            above = self.link[v]
            if self.length[v] >= window:
                self.anchor[v] = v if self.length[above] < window else self.anchor[above]
        for k, item in enumerate(coded):
            at = 0
            for j, c in enumerate(item, 1):
                at = self.next[at][c]
                if j >= window:
                    self.items.setdefault(self.anchor[at], set()).add(k)
            if 0 < len(item) < window:
                # the state that holds exactly this item: the shortest suffix state at least as long
                while self.length[self.link[at]] >= len(item):
                    at = self.link[at]
                self.whole.setdefault((at, len(item)), set()).add(k)
        shorts: dict[int, list[int]] = {}
        for at, size in self.whole:
            shorts.setdefault(at, []).append(size)
        self.shorts = {at: sorted(sizes, reverse=True) for at, sizes in shorts.items()}
        for v in order:
            self.short[v] = v if v in self.shorts else self.short[self.link[v]]
        self.least = min([window, *(len(i) for i in coded if i)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (word numbers, end exclusive, merged) and the numbers of items with occurring windows."""
        get = self.number.get
        code = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], (code >= 0).view(np.int8), [0]))
        turns = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for lo, hi in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if hi - lo >= self.least:
                self._run(code[lo:hi].tolist(), lo, spans, found)
        return spans, found

    def _run(self, code, lo, spans, found) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at = size = 0
        for end, c in enumerate(code, lo + 1):
            while c not in nxt[at] and at:
                at = link[at]
                size = length[at]
            if c not in nxt[at]:
                continue
            at = nxt[at][c]
            size += 1
            most = size if size >= window else 0
            if most:
                found |= self.items[self.anchor[at]]
            v = self.short[at]
            while v > 0:
                for n in self.shorts[v]:
                    if n <= size:
                        found |= self.whole[v, n]
                        most = max(most, n)
                v = self.short[link[v]]
            if most:
                start = end - most
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def _blocks(items: DataFrame):
    """Item ids and words, block by block; a block is bounded, however many there are."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    # a word takes two bytes at least, with what parts it from the next
    words = F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1
    n = max(1, math.ceil((rows.agg(F.sum(words).alias("w")).first()["w"] or 0) / BLOCK_WORDS))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], words_of(r["text"])) for r in part.collect()]


#: A worker keeps the automaton of the block that it met last, by the broadcast's name.
_BUILT: dict[tuple[str, int], WindowAutomaton] = {}


def _automaton(shared, window: int) -> WindowAutomaton:
    key = (shared.value[0], window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WindowAutomaton([w for _, w in shared.value[1]], window)
    return _BUILT[key]


def find_spans(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, finish=None) -> DataFrame:
    """doc_id, text, n_words, spans (array of start, end in words: merged, sorted), item_ids (sorted) for every row.

    Null texts have no words. Items without words have no windows. Repeated items count once each by their id; items
    with a null id hit words but are not listed. Rows' ids are passed through. `finish`, a function of a batch of this
    result and its schema, runs in the last block's workers, so that no second set of workers is held."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("item_ids"),
    )
    blocks = _blocks(items)
    block, k = next(blocks), 0
    while block is not None:
        after = next(blocks, None)
        shared, last = sc.broadcast((uuid.uuid4().hex, block)), finish[0] if finish and after is None else None

        def run(batches, shared=shared, last=last):
            ids = [i for i, _ in shared.value[1]]
            automaton = _automaton(shared, window)
            for b in batches:
                n, spans, hit = [], [], []
                for text, was, had in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    words = words_of(None if text is None else text.encode())
                    got, found = automaton.scan(words)
                    n.append(len(words))
                    spans.append([{"start": a, "end": e} for a, e in _union([(s["start"], s["end"]) for s in was or ()], got)])
                    hit.append(sorted({ids[i] for i in found if ids[i] is not None} | set(had or ())))
                made = pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(hit, pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "spans", "item_ids"],
                )
                yield made if last is None else last(made)

        out = out.mapInArrow(run, schema if last is None else finish[1])
        if after is not None and k % 8 == 7:
            out = stash(out, "spans")
        block, k = after, k + 1
    return out


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not a:
        return b
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from `find_spans`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, e in spans:
        out.append(text[last : at[a][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def decontaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """`docs` without hit spans; documents of which more than `max_coverage` of the words are hit go. Others stay as
    they are, with all their columns."""
    name = "__row__"
    packed = docs.select(F.struct(*docs.columns).alias(name), F.col(text_col).alias("text"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        for text, n, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            got = [(s["start"], s["end"]) for s in spans]
            keep.append(sum(e - a for a, e in got) <= max_coverage * n)
            texts.append(remove_spans(text, got) if got else text)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [name, "text"]).filter(pa.array(keep, pa.bool_()))

    # the whole row travels as the id, so that rows need no join
    row = packed.schema[name].dataType.simpleString()
    left = find_spans(packed, items, id_col=name, text_col="text", window=window, finish=(cut, f"{name} {row}, text string"))
    return left.select(*((F.col("text") if c == text_col else F.col(f"{name}.`{c}`")).alias(c) for c in docs.columns))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
