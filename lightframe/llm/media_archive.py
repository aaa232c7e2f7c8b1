"""Media columns: a Spark data source over directories of archives.

Writing: every task writes zip archives of stored members, each a lossless grey PNG of one payload, and the commit
publishes a list of the archives of the tasks that succeeded; archives of failed attempts are never listed. Every commit has
a list of its own, put in place by one rename, so commits at the same time don't lose each other's archives.
Reading: the planner turns the published archives into byte-range partitions (names and sizes alone reach the driver). A
directory without such lists is taken as it is: all its zip files are read.
A task reads its archive's directory, then the members whose headers start in its range, block by block, and streams
them as bounded Arrow batches. A member that doesn't come out of its block whole is read again by its offset, with retries of
its own, whatever the fault. One that stays unreadable fails the task, so that Spark tries it elsewhere; with
`on_error=null` it gives a row with an error and no bytes, and so does, once, an archive without a readable directory.
"""

from __future__ import annotations

import hashlib
import contextlib
import json
import re
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lightframe.llm.shared import new_path

UNIT, WIDTH = 576, 576
#: An archive is closed at this size; a partition is a range of this many bytes; a batch holds about this many.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 16 << 20, 4 << 20
MANIFEST = "_archives"
#: What a read of damaged or moving bytes may raise.
FAULTS = (OSError, ValueError, EOFError, struct.error, zlib.error, zipfile.BadZipFile)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_png(payload: bytes) -> bytes:
    """Rows of WIDTH 8-bit grey samples, no filter."""
    rows = len(payload) // WIDTH
    samples = np.zeros((rows, WIDTH + 1), np.uint8)
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(samples.tobytes(), 6)), (b"IEND", b""))
    return _SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def from_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without interlace whose rows use no filter; checks every chunk's sum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, data, head = 8, [], None
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's sum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("not 8-bit grey without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Archives(WriterCommitMessage):
    files: tuple  # (name, bytes)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, overwrite: bool):
        self.path, self.archive_bytes, self.overwrite = path, archive_bytes, overwrite

    def write(self, iterator):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        files, out, zipped, name, n = [], None, None, "", 0

        def close():
            zipped.close()
            files.append((name, out.tell()))
            out.close()

        for batch in iterator:
            for member, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if zipped is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    zipped = zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED)
                inside = f"{n:08d}.png" if member is None else f"{n:08d}/{quote(member, safe='')}.png"
                if len(inside) > MOST_NAME:
                    raise ValueError(f"an id of {len(member)} characters doesn't fit the name of a member")
                info = zipfile.ZipInfo(inside)
                zipped.writestr(info, to_png(padded(text)))
                n += 1
                if out.tell() >= self.archive_bytes:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        return Archives(tuple(files))

    def commit(self, messages):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        before = _manifests(fs, root)
        if not before and not self.overwrite and any(not OWN_NAME.fullmatch(name) for name, _ in _listed(self.path)):
            raise ValueError(f"{root} holds archives that no list names; a list would hide them: overwrite, or choose another directory")
        stale = [name for name, _ in _listed(self.path)] if before and self.overwrite else []
        name = f"{root}/{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps([list(f) for m in messages if m is not None for f in m.files]).encode())
        fs.move(f"{name}.part", f"{name}.json")
        if self.overwrite:  # what the old lists named goes after them, so that no reader of a list misses an archive for long
            for old in before:
                fs.delete_file(old)
            for name in stale:
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_file(f"{root}/{name}")

    def abort(self, messages):
        fs, root = _open(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/{name}")


#: Archives of this writer, whose list may still be to come.
OWN_NAME = re.compile(r"[0-9a-f]{32}\.zip")
#: Bytes of a member's name that the format can hold.
MOST_NAME = 65_535


class _Forward:
    """A file object for zipfile over a stream that can't seek."""

    def __init__(self, out):
        self.out = out

    def write(self, data):
        return self.out.write(data)

    def flush(self):
        pass


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root))
    return sorted(f.path for f in found if f.base_name.startswith(f"{MANIFEST}-") and f.base_name.endswith(".json"))


def _listed(path: str) -> list:
    """Names and sizes of the archives in a directory, by its lists or, where it has none, those there are; an error if there is
    no such directory."""
    fs, root = _open(path)
    lists = _manifests(fs, root)
    if not lists:
        return sorted([f.base_name, f.size] for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.base_name.lower().endswith(".zip"))
    out = []
    for name in lists:
        with fs.open_input_stream(name) as f:
            out += json.loads(f.read())
    return out


@dataclass
class ByteRange(InputPartition):
    name: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int, on_error: str):
        self.path, self.range_bytes, self.retries, self.on_error = path, range_bytes, retries, on_error

    def partitions(self):
        found = [ByteRange(name, a, min(size, a + self.range_bytes)) for name, size in _listed(self.path) for a in range(0, size, self.range_bytes)]
        return found or [ByteRange("", 0, 0)]

    def _tried(self, work):
        """work(), tried again after a fault; or None and the last fault, if that is what is asked for."""
        for attempt in range(self.retries + 1):
            try:
                return work(), None
            except FAULTS as e:
                if attempt == self.retries:
                    if self.on_error != "null":
                        raise
                    return None, f"{type(e).__name__}: {e}"
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, partition):
        if not partition.name:
            return
        fs, root = _open(self.path)
        path = f"{root}/{partition.name}"

        def directory() -> tuple[list[zipfile.ZipInfo], int]:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.header_offset), z.start_dir

        def alone(info: zipfile.ZipInfo) -> bytes:
            with fs.open_input_file(path) as f:
                head = f.read_at(30, info.header_offset)
                size = sum(struct.unpack("<HH", head[26:30])) + info.compress_size
                return _member(head + f.read_at(size, info.header_offset + 30), 0, info)

        found, error = self._tried(directory)
        if found is None:
            if partition.start == 0:
                yield _batch([(None, partition.name, 0, None, error)])
            return
        members, end = found
        ends = [*(i.header_offset for i in members[1:]), end]
        mine = [(i, e) for i, e in zip(members, ends, strict=True) if partition.start <= i.header_offset < partition.end]
        at = 0
        while at < len(mine):
            to, start = at + 1, mine[at][0].header_offset
            while to < len(mine) and mine[to][1] - start <= BATCH_BYTES:
                to += 1
            try:
                with fs.open_input_file(path) as f:
                    block = f.read_at(mine[to - 1][1] - start, start)
            except FAULTS:
                block = b""  # each member is read alone
            rows = []
            for info, _ in mine[at:to]:
                try:
                    media, error = _member(block, info.header_offset - start, info), None
                except FAULTS:
                    media, error = self._tried(lambda info=info: alone(info))
                rows.append((_id_of(info.filename), partition.name, info.header_offset, media, error))
            yield _batch(rows)
            at = to


def _id_of(name: str) -> str | None:
    """The id in a member's name; other archives' members are named by their path."""
    if m := re.fullmatch(r"\d{8}(?:/(.*))?\.png", name, re.DOTALL):
        return None if m[1] is None else unquote(m[1])
    return name


def _member(block: bytes, at: int, info: zipfile.ZipInfo) -> bytes:
    """One member's bytes out of a block: the header there must name it, and its bytes must have their sum."""
    names, extra = struct.unpack("<HH", block[at + 26 : at + 30])
    start = at + 30 + names + extra
    if block[at : at + 4] != b"PK\x03\x04" or block[at + 30 : at + 30 + names] != info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437"):
        raise ValueError(f"no member {info.filename} at {info.header_offset}")
    body = block[start : start + info.compress_size]
    if info.compress_type == zipfile.ZIP_DEFLATED:
        body = zlib.decompress(body, -15)
    elif info.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"{info.filename} is packed by a method that is not read")
    if zlib.crc32(body) != info.CRC or len(body) != info.file_size:
        raise ValueError(f"the sum of {info.filename} is wrong")
    return body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["member", "archive", "offset", "media", "error"])


class MediaArchive(DataSource):
    """Options: path; archive_bytes; range_bytes; retries; on_error (fail or null).
    Reads member, archive, offset, media, error; writes two columns, member name and payload bytes."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "member string, archive string, offset long, media binary, error string"

    def reader(self, schema):
        o = self.options
        return ArchiveReader(o["path"], int(o.get("range_bytes", RANGE_BYTES)), int(o.get("retries", 3)), o.get("on_error", "fail"))

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)), overwrite)


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES, overwrite: bool = False) -> None:
    """Stores each row's text, padded, as a member named by the row's id (nothing for null). Null texts are empty. An id whose quoted
    form exceeds MOST_NAME bytes fails, and so does adding to a directory with archives that no list names. `overwrite`
    replaces all archives that the directory's lists name."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("string").alias("member"), F.col(text_col).cast("binary").alias("payload"))
    rows.write.format("media_archive").mode("overwrite" if overwrite else "append").option("archive_bytes", archive_bytes).option("path", path).save()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).option("path", path).load()


def _features(batches):
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in b.column(1).to_pylist():
            if media is None:
                for v in out.values():
                    v.append(None)
                continue
            payload = from_png(media)
            x = np.frombuffer(payload, np.uint8)
            share = np.bincount(x, minlength=256) / len(x)
            entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
            steps = np.abs(np.diff(x.astype(np.int16)))
            # UTF-8 never holds the byte 255, so the padding is what stands at the end
            for k, v in zip(out, (len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{x.mean():.4f};{x.std():.4f};{entropy:.4f};{steps.mean():.4f}"), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["member", *out])


def features(media: DataFrame) -> DataFrame:
    """member and, from the bytes read back: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (mean, deviation, entropy and mean step of the samples). Null media give nulls."""
    schema = "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("member", "media").mapInArrow(_features, schema)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every row of `docs` to archives in the shared folder and returns `features` of what is read back, with
    the id in its own type. Equal texts give equal values; an empty table gives an empty result."""
    path = new_path(docs.sparkSession, "archives")
    write(docs, path, id_col=id_col, text_col=text_col)
    out = features(read(docs.sparkSession, path))
    return out.select(F.col("member").cast(docs.schema[id_col].dataType).alias("doc_id"), *out.columns[1:])
