"""A compressed FM-index of one shard: a wavelet matrix over the words' transform, and backward search in lock step.

The index holds the transform's bits with their running counts, the number of words below each word, and one bit a
position for strings that occur more than once: about 1.5 bits for each bit of a word's number. The words themselves
are not kept; those that are searched come from outside. Suffixes are ordered by as many words as the longest string
has, which is what patterns within strings need."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class BitRank:
    """A bit vector in 64-bit words with a running count for each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate(([0], counts[:-1])).astype(np.int32)
        self.zeros = len(bits) - int(counts[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((_ONE << (i & 63).view(np.uint64)) - _ONE))

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).view(np.uint64) & _ONE).astype(bool)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the `depth` symbols from each; ties stand by position. Symbols are small integers.

    Prefix doubling; a round sorts pairs of ranks with their position in the low bits."""
    n = len(text)
    bits = max(n, int(text.max(initial=0)) + 2).bit_length()
    position = np.arange(n)
    rank, order, known = text, position, 1
    if depth <= 1:
        return np.argsort(text, kind="stable")
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = (rank << bits) | after
        if 3 * bits < 63:
            key = np.sort((key << bits) | position)
            order, key = key & ((1 << bits) - 1), key >> bits
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        known += step
        if new[-1] == n - 1:
            break
    return order


class FMIndex:
    """Index of strings of word numbers, one after another in `codes`; `often` marks strings that occur more than once."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, often: np.ndarray):
        self.n = len(codes) + len(sizes)
        text = np.zeros(self.n, np.int64)  # 0 ends a string
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(self.n, bool)
        inside[ends] = False
        text[inside] = codes + 1
        order = suffix_order(text, int(sizes.max(initial=1)))
        self.often = BitRank(np.repeat(often, sizes + 1)[order])
        words = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=words))))
        last = text[order - 1].astype(np.int32)
        self.levels: list[tuple[int, BitRank]] = []
        for shift in range(max(1, (words - 1).bit_length()) - 1, -1, -1):
            bit = (last >> shift & 1).astype(bool)
            self.levels.append((shift, BitRank(bit)))
            last = np.concatenate((last[~bit], last[bit]))
        symbols = np.arange(words)
        self.move = self.first[:-1] - self._walk(symbols, np.zeros(words, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, ranks in self.levels:
            ones = ranks.ones(at)
            at = np.where(symbol >> shift & 1, ranks.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of symbol + pattern from those of the patterns."""
        k = len(symbol)
        at = self._walk(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        move = self.move[symbol]
        return at[:k] + move, at[k:] + move

    def repeated(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the patterns of these intervals occur at least twice."""
        return (hi - lo > 1) | ((hi - lo == 1) & self.often.at(lo))


#: Lengths of the short probes that rule out windows left of a break.
_PROBES = (35, 4, 12)


def repeated_windows(index: FMIndex, codes: np.ndarray, sizes: np.ndarray, widths: np.ndarray, window: int) -> np.ndarray:
    """For each of the strings in `codes`, a bit for each of its `widths` windows that the index holds at least twice.

    Matching statistics from the right: let b be the last open window. A full probe searches backwards from the end of
    b; where it breaks, at j, the windows from j to b are repeated, or b alone is not. Left of a break, short probes
    from b's start rule out all windows that hold a short unrepeated run."""
    m = len(widths)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(m, np.int64)
    unit = np.arange(m)
    b = widths.astype(np.int64) - 1
    mode = np.zeros(m, np.int64)
    tried = np.zeros(m, bool)  # short probes after a full one that failed at once: only the first time
    reach = np.array([window, *(min(p, window) for p in _PROBES[1:])])
    end = b + window
    j = end.copy()
    lo, hi = np.zeros(m, np.int64), np.full(m, index.n, np.int64)
    one = np.int64(1)
    while len(unit):
        symbol = codes[starts[unit] + j - 1] + 1
        lo2, hi2 = index.extend(symbol, lo, hi)
        again = index.repeated(lo2, hi2)
        j = np.where(again, j - 1, j)
        lo, hi = np.where(again, lo2, lo), np.where(again, hi2, hi)
        full = mode == 0
        turn = ~again | np.where(full, j == 0, j == b)  # the probe is over
        if not turn.any():
            continue
        marked = turn & full & (j <= b)
        out[unit[marked]] |= (one << (b[marked] + 1)) - (one << j[marked])
        lost = turn & full & ~marked
        killed = turn & ~full & ~again
        kept = turn & ~full & again
        nb = np.where(marked, j - 1, np.where(lost, b - 1, np.where(killed, end - window - 1, b)))
        nmode = np.where(marked | (lost & ~tried), 1, np.where(lost | killed, 0, np.where(kept, (mode + 1) % 3, mode)))
        b, mode, tried = nb, nmode, tried | lost
        fresh = b + reach[mode]
        end = np.where(turn, fresh, end)
        j = np.where(turn, end, j)
        lo, hi = np.where(turn, 0, lo), np.where(turn, index.n, hi)
        live = b >= 0
        if not live.all():
            unit, b, mode, tried, end, j, lo, hi = (x[live] for x in (unit, b, mode, tried, end, j, lo, hi))
    return out
