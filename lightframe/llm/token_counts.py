"""Token counts with a whole-token shortcut.

Offline (once a worker, from the vocabulary alone) it is proved
* that no piece has a space mark after another character, so merges never cross the start of a word, and
* which characters occur in no piece of two or more characters, so merges never cross those either, and
* for each piece of word shape, that merging its characters alone gives this one piece.
A text is cut at those points into pre-tokens. Pre-tokens of the proved set count 1 without any merging; the others are
merged once, best-scored leftmost pair first, and remembered up to a bound.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.llm.piece_vocab import BYTE, NORMAL, SPACE, pieces, splits_before_space

#: A worker remembers the counts of at most so many pre-tokens, of at most so many characters each.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64


class MergeCounter:
    def __init__(self, path: str):
        vocab = pieces(path)
        if not splits_before_space(vocab):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        self.score = {p: s for p, s, kind in vocab if kind == NORMAL}
        self.has_bytes = any(kind == BYTE for _, _, kind in vocab)
        inside = {c for p in self.score if len(p) > 1 for c in p}
        #: a space-led or plain run of characters that can merge, or one character that can't
        joins = "".join(re.escape(c) for c in sorted(inside - {SPACE}))
        self.cut = re.compile(f"{SPACE}+[{joins}]*|[{joins}]+|[^{joins}{SPACE}]")
        self.whole = {p for p in self.score if self.cut.fullmatch(p) and self._merge(p) == 1}
        self.known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def _merge(self, text: str) -> int:
        """Tokens of one pre-token."""
        score, part = self.score, list(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-score[p], i, len(p)) for i in range(n - 1) if (p := part[i] + part[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged meanwhile
            part[i] += part[j]
            part[j] = ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := part[i] + part[k]) in score:
                    heapq.heappush(heap, (-score[p], i, len(p)))
            if (h := left[i]) >= 0 and (p := part[h] + part[i]) in score:
                heapq.heappush(heap, (-score[p], h, len(p)))
        return sum(1 if p in score or not self.has_bytes else len(p.encode()) for p in part if p)

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, known = 0, self.known
        for word in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(word)
            if n is None:
                n = self._merge(word)
                if len(word) <= REMEMBERED_CHARS and len(known) < REMEMBERED:
                    known[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def _kernel(path: str):
    def run(batches):
        count = counter(path).count
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the library for this model counts them without added
    tokens. Null texts are empty: no bytes, no tokens. Ids, null or repeated, are passed through."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_kernel(model_path), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
