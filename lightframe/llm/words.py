"""Word hashing for the Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


#: Texts are taken in pieces of about so many bytes, so that arrays over their words stay small.
PIECE_BYTES = 1 << 20
#: Longer words are hashed as a whole; shorter ones eight bytes at a time, all words of a piece at once.
LONG_WORD = 256
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spread(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and where each row begins in it; a null has none."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `size` bytes, or one row."""
    if not batch.num_rows:
        return
    ends = spread(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words (runs without ASCII white space) of a column of texts: where they start and end in `raw`, and the number
    of the first word of each text (`first` has one more entry, the number of all words). `lower` takes A-Z as a-z."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.raw, rows = spread(column)
        if lower:
            self.raw = _LOWER[self.raw]
        blank = _SPACE[self.raw]
        inside = ~blank
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= blank[:-1]
        end[:-1] &= blank[1:]
        edges = rows[(rows > 0) & (rows < len(self.raw))]  # a word ends where its text does
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        size = self.end - self.start
        raw = np.concatenate((self.raw, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.raw) + 1,), np.uint64, raw.data, strides=(1,))  # the eight bytes from each position
        h = mix(size.astype(np.uint64) * _P ^ (eight[self.start] & _FIRST_BYTES[np.minimum(size, 8)]))
        more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(more):
            h[more] = mix(h[more] * _P ^ (eight[self.start[more] + done] & _FIRST_BYTES[np.minimum(size[more] - done, 8)]))
            done += 8
            more = more[size[more] > done]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.raw[self.start[i] : self.end[i]].tobytes())
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of `n` words; empty where there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, size = np.zeros(len(h) - n + 1, np.uint64), len(h) - n + 1
    for j in range(n):
        out = out * _P + h[j : j + size]
    return mix(out + np.uint64(n))
