"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each character the automaton's state names, over its output links, every piece that ends there; each relaxes the
best score of that position by the best score where the piece begins. Characters that no piece covers take the
unknown score and come out as their bytes. As no piece crosses the start of a word, the best path of a text is the best
paths of its words one after another; a worker remembers those of short words up to a bound.

Scores are those of the file. For this model the file's own library merges pairs greedily by rank; this operator finds
the path of the highest total score over the same pieces instead, as unigram models do. Scores are summed in double precision; ties go to the longer last piece.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.llm.piece_vocab import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, pieces, splits_before_space

REMEMBERED, REMEMBERED_CHARS = 150_000, 40
#: At most so many moves over failure links are remembered.
MOVES = 100_000
#: Ids of so many rows are held as Python objects at once.
ROWS = 128
#: An unknown character scores so much below the least piece.
UNKNOWN_GAP = 10.0


class PieceAutomaton:
    def __init__(self, path: str):
        vocab = pieces(path)
        if not splits_before_space(vocab):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocab) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = next(i for i, v in enumerate(vocab) if v[2] == UNKNOWN)
        self.text_of = {i: p for i, (p, _, kind) in enumerate(vocab) if kind == NORMAL}
        self.silent = {i for i, v in enumerate(vocab) if v[2] == CONTROL}
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(vocab) if kind == NORMAL]
        self.unk_score = min(s for _, _, s in normal) - UNKNOWN_GAP
        self.known = _Known(self._encoded)
        self._normal = normal
        #: scores by id; of an unknown character's bytes the first has its score
        self.scores = np.zeros(len(vocab))
        for i, _, s in normal:
            self.scores[i] = s
        for b, i in self.byte_ids.items():
            self.scores[i] = 0.0 if 0x80 <= b < 0xC0 else self.unk_score
        self.scores[self.unk] = self.unk_score
        self.bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else self.text_of.get(i, " ⁇ ").replace(SPACE, " ").encode() for i in range(len(vocab))]
        self.goto: list[dict[str, int]] = []

    def _build(self) -> None:
        """The automaton: built when a text is first encoded, as decoding needs none."""
        self.goto = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]
        for i, p, s in self._normal:
            at = 0
            for c in p:
                if c not in self.goto[at]:
                    self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                at = self.goto[at][c]
            self.piece[at] = (len(p), i, s)
        self.fail = [0] * len(self.goto)
        #: the pieces that end at a state, over its output links: (characters, id, score), longest first
        self.ends: list[tuple] = [()] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            at = queue.popleft()
            f = self.fail[at]
            self.ends[at] = (self.piece[at], *self.ends[f]) if self.piece[at] else self.ends[f]
            for c, to in self.goto[at].items():
                g = f
                while g and c not in self.goto[g]:
                    g = self.fail[g]
                self.fail[to] = self.goto[g].get(c, 0)
                queue.append(to)
        self.moves = 0

    def _fall(self, at: int, c: str) -> int:
        """The state after c where the trie has no such edge: the longest suffix that has one."""
        g = self.fail[at]
        while g and c not in self.goto[g]:
            g = self.fail[g]
        to = self.goto[g].get(c, 0)
        if self.moves < MOVES:
            self.moves += 1
            self.goto[at][c] = to
        return to

    def _best(self, word: str) -> list[int]:
        """Ids of the best path: one pass over the characters, each relaxing all pieces that end there."""
        goto, ends, unknown = self.goto, self.ends, self.unk_score
        best, sizes, pieces_, at = [0.0], [0], [0], 0
        for end, c in enumerate(word, 1):
            to = goto[at].get(c)
            at = self._fall(at, c) if to is None else to
            top, size, piece = -math.inf, 0, 0
            for n, i, s in ends[at]:
                v = best[end - n] + s
                if v > top:
                    top, size, piece = v, n, i
            if (not ends[at] or ends[at][-1][0] != 1) and best[-1] + unknown > top:
                top, size, piece = best[-1] + unknown, 1, self.unk
            best.append(top)
            sizes.append(size)
            pieces_.append(piece)
        ids, end = [], len(word)
        while end:
            if pieces_[end] == self.unk and self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode()))
            else:
                ids.append(pieces_[end])
            end -= sizes[end]
        return ids[::-1]

    def _encoded(self, word: str) -> bytes:
        if not self.goto:
            self._build()
        return np.array(self._best(word), np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32); none for an empty text."""
        words = _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)

    def score(self, ids: np.ndarray) -> float:
        return float(self.scores[ids].sum())

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: space marks become spaces, the added first one goes, runs of bytes are UTF-8."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw[raw.startswith(b" ") :].decode(errors="replace")


class _Known(dict):
    """Ids of words as bytes, made when first asked for; short words are remembered up to a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        made = self.make(word)
        if len(word) <= REMEMBERED_CHARS and len(self) < REMEMBERED:
            self[word] = made
        return made


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")


@lru_cache(maxsize=2)
def automaton(path: str) -> PieceAutomaton:
    return PieceAutomaton(path)


def _slices(batch: pa.RecordBatch):
    return (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS))


def _lists(made: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(m) for m in made]))) if made else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made) if made else [], pa.int32()))


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and score of every row. Null and empty texts have no ids and score 0. Ids of rows,
    null or repeated, are passed through; other columns are not read."""

    def run(batches):
        a = automaton(model_path)
        for batch in batches:
            for b in _slices(batch):
                made = [a.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(made), pa.array([a.score(m) for m in made], pa.float64())], ["doc_id", "ids", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, score double")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds `decoded` to doc_id, ids, score; null ids decode to null, and null entries of an array are left out."""

    def run(batches):
        one = automaton(model_path).decode
        for batch in batches:
            for b in _slices(batch):
                yield b.append_column("decoded", pa.array([None if ids is None else one(np.array([i for i in ids if i is not None], np.int64)) for ids in b.column(1).to_pylist()], pa.string()))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "score").mapInArrow(run, f"doc_id {kind}, ids array<int>, score double, decoded string")


def transcoded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """`encode` and `decode` of every row in one pass: doc_id, n_pieces, score, pieces_sha256 (of the ids as little-endian
    32-bit integers), decoded_sha256, and with `keep_ids` ids. Ids by the hundred million needn't leave the worker."""

    def run(batches):
        a = automaton(model_path)
        for batch in batches:
            for b in _slices(batch):
                made = [a.encode(t or "") for t in b.column(1).to_pylist()]
                cols = [
                    b.column(0), pa.array([len(m) for m in made], pa.int64()), pa.array([a.score(m) for m in made], pa.float64()), pa.array([hashlib.sha256(m.astype("<i4").tobytes()).hexdigest() for m in made], pa.string()),
                    pa.array([hashlib.sha256(a.decode(m).encode()).hexdigest() for m in made], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*cols, *([_lists(made)] if keep_ids else [])], names)

    names = ["doc_id", "n_pieces", "score", "pieces_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, score double, pieces_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
