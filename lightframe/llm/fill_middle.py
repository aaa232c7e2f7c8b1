"""Fill-in-the-middle: documents are cut into prefix, middle and suffix, and written with the middle last.

Secondary-sort assembly. A kernel cuts each whole text at two unit boundaries and emits pieces, each a chunk of whole units
(a unit longer than a chunk is divided), keyed by row and output position. One exchange by row, with rows sorted by
output position, lets the next kernel stream a document's output into an incremental digest, however long the document.
Restoration reads that stream alone: the markers in it say which section a piece belongs to, so pieces are keyed anew
by section and position, sorted again where they are, and streamed into the digest of the rebuilt text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightframe.llm.words import Words, pieces, spread

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a piece, about.
CHUNK = 1 << 16
#: Rows of pieces in one Arrow batch of a kernel's output.
BATCH_PIECES = 2048
_SECTION = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_META = ("doc_id", "n", "form", "prefix_chars", "middle_chars")


def _code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _chunks(raw: np.ndarray, ends: np.ndarray, a: int, b: int, size: int) -> Iterator[bytes]:
    """raw[a:b] in pieces of about `size` bytes that end with a unit, unless a unit is longer."""
    while a < b:
        i = int(np.searchsorted(ends, a + size, "right")) - 1
        to = int(ends[i]) if i >= 0 and ends[i] > a else a + size
        to = min(to, b)
        yield raw[a:to].tobytes()
        a = to


class _Out:
    """Rows of pieces, gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= BATCH_PIECES or self.bytes >= 8 << 20

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


def _schema(first: pa.DataType, *middle: tuple) -> pa.Schema:
    return pa.schema([("row", pa.int64()), *middle, ("doc_id", first), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("data", pa.binary())])


def _cut(rate: int, spm: int, size: int):
    def run(batches):
        out = None
        for b in (piece for whole in batches for piece in pieces(whole, 2)):
            if out is None:
                out = _Out(_schema(b.schema.field(1).type, ("at", pa.int32())))
            words, bounds = Words(b.column(2)), spread(b.column(2))[1]
            row, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            h1, h2, h3, h4 = (b.column(i).to_pylist() for i in range(3, 7))
            for i, name in enumerate(row):
                a, z = int(bounds[i]), int(bounds[i + 1])
                ends = words.end[words.first[i] : words.first[i + 1]]
                if (int(ends[-1]) if len(ends) else a) < z:  # blanks at the end are a unit of their own
                    ends = np.append(ends, z)
                n, raw = len(ends), words.raw
                text = raw[a:z].tobytes()
                plain = not text or h3[i] % 100 >= rate or any(m in text for m in _SECTION)
                if plain:
                    parts, meta = ((None, a, z),), (ids[i], n, "plain", None, None)
                else:
                    x, y = sorted((h1[i] % (n + 1), h2[i] % (n + 1)))
                    x, y = (int(ends[u - 1]) if u else a for u in (x, y))
                    p, s, m = (PREFIX, a, x), (SUFFIX, y, z), (MIDDLE, x, y)
                    parts = (s, p, m) if h4[i] % 100 < spm else (p, s, m)
                    meta = (ids[i], n, "spm" if parts[0] is s else "psm", _code_points(raw[a:x]), _code_points(raw[x:y]))
                out.add((name, 0, *meta, None))
                at = 0
                for mark, start, stop in parts:
                    for data in (*([mark] if mark else []), *_chunks(raw, ends, start, stop, size)):
                        at += 1
                        out.add((name, at, None, None, None, None, None, data), len(data))
                        if out.full():
                            yield out.batch()
        if out is not None:
            yield out.batch()

    return run


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Pieces of every row's output: row, at, data. The piece at 0 has no data but doc_id, n (units), form and the code points of
    prefix and middle; those at 1, 2, ... make up the output.

    Units are a word with the blanks before it, and blanks at the end. `rate` percent of documents are cut, `spm` percent of
    them with the suffix first, all drawn from a digest of `seed` and the id. Documents that are empty or null, or that
    contain a marker, stay plain. Null ids draw as an empty string and rows that repeat an id draw alike. Rows are named by
    their place in the scan: give a table, not the unsorted result of an exchange. Other columns are not read."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    meta = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long"
    return rows.select("*", *draws).mapInArrow(_cut(rate, spm, chunk), f"row long, at int, {meta}, data binary")


def in_order(cut_pieces: DataFrame) -> DataFrame:
    """The pieces of each row in one partition, by output position."""
    return cut_pieces.repartition("row").sortWithinPartitions("row", "at")


def _each(batches) -> Iterator[dict]:
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        yield from zip(*columns, strict=True)


def _read_output(kind: pa.DataType):
    """Streams outputs: digests them, and keys their pieces by section and place for the text's own order."""

    def run(batches):
        out = _Out(_schema(kind, ("section", pa.int32()), ("place", pa.int32()), ("output_sha256", pa.string())))
        row = digest = form = None
        section = place = 0
        for name, at, doc_id, n, this_form, before, inside, data in _each(batches):
            if at == 0:
                if digest is not None:
                    out.add((row, 3, 0, digest.hexdigest(), None, None, None, None, None, None))
                row, digest, form, section, place = name, hashlib.sha256(), this_form, 0, 0
                out.add((row, -1, 0, None, doc_id, n, form, before, inside, None))
                continue
            digest.update(data)
            if form != "plain" and data in _SECTION:  # such a document's own text has none
                section = _SECTION[data]
                continue
            place += 1
            out.add((row, section, place, None, None, None, None, None, None, data), len(data))
            if out.full():
                yield out.batch()
        if digest is not None:
            out.add((row, 3, 0, digest.hexdigest(), None, None, None, None, None, None))
        yield out.batch()

    return run


def _read_restored(kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def run(batches):
        out = _Out(schema)
        digest = meta = None
        for _, section, _, output, *this, data in _each(batches):
            if section < 0:
                digest, meta = hashlib.sha256(), this
            elif section < 3:
                digest.update(data)
            else:
                out.add((*meta, output, digest.hexdigest()))
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


def _arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def digests(ordered: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row of the pieces `in_order`; the
    restored text is rebuilt from the output's own pieces and markers. No further exchange: pieces are sorted where they are."""
    kind, name = _arrow_kind(ordered, "doc_id"), ordered.schema["doc_id"].dataType.simpleString()
    meta = f"doc_id {name}, n long, form string, prefix_chars long, middle_chars long"
    read = ordered.mapInArrow(_read_output(kind), f"row long, section int, place int, output_sha256 string, {meta}, data binary")
    return read.sortWithinPartitions("row", "section", "place").mapInArrow(_read_restored(kind), f"{meta}, output_sha256 string, restored_sha256 string")


def _join_pieces(kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        out, meta, parts = _Out(schema), None, []
        for _, at, *this, data in _each(batches):
            if at:
                parts.append(data)
                continue
            if meta is not None:
                text = b"".join(parts)
                out.add((*meta, text.decode()), len(text))
                if out.full():
                    yield out.batch()
            meta, parts = this, []
        if meta is not None:
            out.add((*meta, b"".join(parts).decode()))
        yield out.batch()

    return run


def transformed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every row; options as for `cut`."""
    ordered = in_order(cut(docs, **options))
    name = ordered.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(_join_pieces(_arrow_kind(ordered, "doc_id")), f"doc_id {name}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
