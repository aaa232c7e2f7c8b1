"""A stored text index that takes changes: segments, tombstones, merges.

A segment holds what one change added: postings in blocks (term, shard, keys, tfs, lengths; at most BLOCK_POSTINGS), sorted by term so
that prefixes read few row groups, and the lengths of its documents. Documents are dealt into `of` shards by their key, and a block
has postings of one shard, so that what is hidden meets whole blocks and postings are never dealt one by one. A key in a later segment or deletion hides what earlier
segments have of it. A log of numbered files says which segments and deletions are valid; it is written last and never
overwritten, so a change that fails halfway leaves the index as it was, and of two writers at once one fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.operators import search as T
from lightframe.operators.graph import checkpointed, discarded

BLOCK_POSTINGS = 128
#: Documents of a shard, about, where there are many; tokens that a task counts at once, about; blocks that a task sorts, about.
SHARD_DOCS, PIECE_TOKENS, TASK_BLOCKS = 16_384, 1 << 22, 100_000


def _blocks(part: pa.RecordBatch) -> pa.RecordBatch:
    """Documents (shard, key, n, terms) of one shard, by key, as blocks; the block without a term has the documents. Rows
    that repeat key and length are one document."""
    n, lists = np.asarray(part.column(2)), part.column(3)
    repeats = np.asarray(pc.equal(part.column(1).slice(1), part.column(1).slice(0, len(n) - 1)).to_numpy(zero_copy_only=False), bool) & (n[1:] == n[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~repeats)))
    words = lists.flatten().dictionary_encode()
    doc = np.repeat(np.cumsum(np.concatenate(([0], ~repeats))), n)
    both = np.sort(np.asarray(words.indices).astype(np.int64) * len(first) + doc)
    at = np.flatnonzero(np.concatenate((both[:1] == both[:1], both[1:] != both[:-1])))
    tf, (term, doc) = np.diff(np.append(at, len(both))), np.divmod(both[at], len(first))
    place = np.arange(len(term))
    begins = np.maximum.accumulate(np.where(np.concatenate((term[:1] == term[:1], term[1:] != term[:-1])), place, 0))
    starts = np.flatnonzero((place - begins) % BLOCK_POSTINGS == 0)
    rows, edges = first[doc], [*starts, len(term), len(term) + len(n)]
    keys = pa.concat_arrays([part.column(1).take(pa.array(rows)), part.column(1)])
    cut = lambda values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
    terms = pa.concat_arrays([words.dictionary.take(pa.array(term[starts])), pa.nulls(1, words.dictionary.type)])
    shard = pa.array(np.full(len(terms), part.column(0)[0].as_py(), np.int32))
    ints = lambda x, y: pa.array(np.concatenate((x, y)).astype(np.int32))
    return pa.RecordBatch.from_arrays([terms, shard, cut(keys), cut(ints(tf, n)), cut(ints(n[rows], n))], ["term", "shard", "keys", "tfs", "lengths"])


def _counted(batches):
    """Documents sorted by shard, key and length as blocks, some tokens at a time; one document is never cut."""
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        shard, upto = np.asarray(b.column(0)), np.cumsum(np.asarray(b.column(2)))
        other = pc.not_equal(b.column(1).slice(1), b.column(1).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.flatnonzero(other) + 1))  # first rows of documents
        held = b.slice(first[-1])
        cuts = np.concatenate(([True], (shard[first[1:]] != shard[first[:-1]]) | (upto[first[1:]] // PIECE_TOKENS != upto[first[:-1]] // PIECE_TOKENS)))
        edges = sorted({*first[cuts].tolist(), int(first[-1])})
        for x, y in zip(edges, edges[1:], strict=False):
            yield _blocks(b.slice(x, y - x))
    if held is not None:
        yield _blocks(held)


def _unhidden(batches):
    """Blocks without the hidden keys that come before them: rows by segment, shard and side (0: hidden keys)."""
    at, hidden = None, []
    for b in batches:
        if not b.num_rows:
            continue
        where = np.stack([np.asarray(b.column(i)) for i in range(4)], axis=1)
        edges = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:], strict=False):
            *this, side = where[x].tolist()
            if this != at:
                at, hidden = this, []
            part = b.slice(x, y - x)
            keys = part.column(5)
            if side == 0:
                hidden.append(keys.flatten())
                continue
            columns = [part.column(i) for i in (5, 6, 7)]
            terms, shard = part.column(4), part.column(2)
            if hidden:
                hidden = [pa.concat_arrays(hidden)]
                good = ~np.asarray(pc.is_in(keys.flatten(), value_set=hidden[0]).to_numpy(zero_copy_only=False), bool)
                upto = np.concatenate(([0], np.cumsum(good)))
                cuts = np.asarray(keys.offsets)
                ends = upto[cuts - cuts[0]]
                left, kept = np.flatnonzero(np.diff(ends)), pa.array(np.flatnonzero(good))
                offsets = pa.array(np.append(ends[left], ends[-1]).astype(np.int32))
                columns = [pa.ListArray.from_arrays(offsets, c.flatten().take(kept)) for c in columns]
                terms, shard = terms.take(pa.array(left)), shard.take(pa.array(left))
            yield pa.RecordBatch.from_arrays([terms, shard, pa.array(np.full(len(terms), this[1], np.int32)), *columns], ["term", "shard", "of", "keys", "tfs", "lengths"])


class TextIndex:
    """An index at `path`; `key` names the documents' unique key. Each change gives the index a new version."""

    def __init__(self, spark: SparkSession, path: str, *, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # the log

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def state(self) -> dict:
        """version, segments (name, version), numbers of shards by segment, deletes (name, version), docs and tokens that are valid."""
        fs, path = self._fs("log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
        if not names:
            return {"version": 0, "segments": [], "shards": {}, "deletes": [], "docs": 0, "tokens": 0}
        return json.loads(self.spark.read.text(f"{self.path}/log/{names[-1]}").first()["value"])

    def _commit(self, state: dict) -> None:
        fs, path = self._fs(f"log/{state['version']:012d}.json")
        out = fs.create(path, False)  # fails if another writer was first
        out.write(json.dumps(state).encode())
        out.close()

    # what is valid

    def _rows(self, state: dict, table: str) -> DataFrame | None:
        """A table of all valid segments, with the version of each."""
        parts = [self.spark.read.parquet(f"{self.path}/{name}/{table}").withColumn("__v", F.lit(v)) for name, v in state["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _hidden(self, state: dict) -> DataFrame | None:
        """(key, by): the last version that hides earlier segments' entries of a key."""
        first = min((v for _, v in state["segments"]), default=0)
        parts = [self.spark.read.parquet(f"{self.path}/{name}/docs").select(self.key, F.lit(v).alias("by")) for name, v in state["segments"] if v > first]
        parts += [self.spark.read.parquet(f"{self.path}/{name}").select(self.key, F.lit(v).alias("by")) for name, v in state["deletes"] if v > first]
        return reduce(DataFrame.unionByName, parts).groupBy(self.key).agg(F.max("by").alias("__by")) if parts else None

    def _valid(self, rows: DataFrame, state: dict) -> DataFrame:
        hidden = self._hidden(state)
        if hidden is None:
            return rows.drop("__v")
        return rows.join(hidden, self.key, "left").where(F.col("__by").isNull() | (F.col("__by") <= F.col("__v"))).drop("__v", "__by")

    def documents(self) -> DataFrame | None:
        """(key, length) of every valid document; None before the first change."""
        state = self.state()
        rows = self._rows(state, "docs")
        return None if rows is None else self._valid(rows, state)

    def postings(self) -> DataFrame | None:
        """(term, key, tf, length) of every valid document."""
        state = self.state()
        if not state["segments"]:
            return None
        return self._opened(self._standing(state).withColumn("__v", F.lit(0))).drop("__v")

    def _standing(self, state: dict) -> DataFrame:
        """The blocks (term, shard, of, keys, tfs, lengths) of all valid documents. Hidden keys go to the shards that can have them."""
        hidden, blocks = self._hidden(state), self._rows(state, "postings")
        if hidden is None:
            return blocks.drop("__v")
        kind = hidden.schema[self.key].dataType.simpleString()
        homes = self.spark.createDataFrame([(v, of) for name, v in state["segments"] for of in state["shards"][name]], "__v int, of int")  # a row a change
        hidden = hidden.join(F.broadcast(homes), F.col("__by") > F.col("__v")).withColumn("shard", self._shard(F.col("of")))
        none = lambda t: F.lit(None).cast(t)
        lead = hidden.select("__v", "of", "shard", F.lit(0).alias("side"), none("string").alias("term"), F.array(self.key).alias("keys"), none("array<int>").alias("tfs"), none("array<int>").alias("lengths"))
        rows = lead.unionByName(blocks.select("__v", "of", "shard", F.lit(1).alias("side"), "term", "keys", "tfs", "lengths"))
        dealt = rows.repartition("__v", "of", "shard").sortWithinPartitions("__v", "of", "shard", "side")
        return dealt.mapInArrow(_unhidden, f"term string, shard int, of int, keys array<{kind}>, tfs array<int>, lengths array<int>")

    def _shard(self, of):
        return F.pmod(F.xxhash64(self.key), of).cast("int")

    def _opened(self, blocks: DataFrame, *more: str) -> DataFrame:
        each = blocks.select("term", *more, "__v", F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("p"))
        return each.select("term", *more, "__v", F.col("p.keys").alias(self.key), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))

    # changes

    def _write(self, name: str, postings: DataFrame, docs: DataFrame, rows: int = 0) -> None:
        """Writes a segment of about `rows` blocks; the second column of `postings` deals the rows of a frequent term."""
        order, n = postings.columns[:2], min(T.MOST_TASKS, rows // TASK_BLOCKS)
        ranged = postings.repartitionByRange(n, *order) if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else postings.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.parquet(f"{self.path}/{name}/postings")
        docs.write.parquet(f"{self.path}/{name}/docs")

    def _counted(self, docs: DataFrame, text: str) -> tuple[DataFrame, int]:
        """A written table of blocks of documents, and the number of their shards. Texts are split once."""
        n, parts = docs.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        of = max(1, -(-n // SHARD_DOCS), min(-(-n // 1024), parts))
        kind = docs.schema[self.key].dataType.simpleString()
        dealt = docs.select(self._shard(F.lit(of)).alias("shard"), self.key, F.coalesce(text, F.lit("")).alias("t")).repartition(of, "shard")
        each = dealt.select("shard", self.key, T.terms(F.col("t")).alias("t")).select("shard", self.key, F.size("t").alias("n"), "t").sortWithinPartitions("shard", self.key, "n")
        blocks = each.mapInArrow(_counted, f"term string, shard int, keys array<{kind}>, tfs array<int>, lengths array<int>")
        return checkpointed(blocks.select("term", "shard", F.lit(of).alias("of"), "keys", "tfs", "lengths")), of

    def _drop_from(self, state: dict, keys: DataFrame) -> tuple[int, int]:
        """Documents and tokens that are valid under `keys`."""
        rows = self._rows(state, "docs")
        if rows is None:
            return 0, 0
        r = self._valid(rows, state).join(keys.select(self.key), self.key, "left_semi").agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
        return r["n"], r["t"] or 0

    def upsert(self, docs: DataFrame, *, text: str = "text") -> int:
        """Adds documents, each in place of what the index has under its key; the new version. Null keys are left out."""
        state, name = self.state(), f"seg-{uuid.uuid4().hex}"
        known = docs.where(F.col(self.key).isNotNull())
        blocks, of = self._counted(known, text)
        listed = blocks.where("term is null").select(F.explode(F.arrays_zip("keys", "lengths")).alias("d"))
        self._write(name, blocks.where("term is not null"), listed.select(F.col("d.keys").alias(self.key), F.col("d.lengths").alias("length")), blocks.count())
        discarded(blocks)
        mine = self.spark.read.parquet(f"{self.path}/{name}/docs")
        gone_n, gone_t = self._drop_from(state, mine)
        new = mine.agg(F.count("*").alias("n"), F.sum("length").alias("t")).first()
        v = state["version"] + 1
        self._commit(state | {"version": v, "segments": [*state["segments"], (name, v)], "shards": state["shards"] | {name: [of]}, "docs": state["docs"] - gone_n + new["n"], "tokens": state["tokens"] - gone_t + (new["t"] or 0)})
        return v

    def delete(self, keys: DataFrame) -> int:
        """Takes documents out, by key; the new version. Keys that the index doesn't have do nothing."""
        state, name = self.state(), f"del-{uuid.uuid4().hex}"
        keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().write.parquet(f"{self.path}/{name}")
        gone_n, gone_t = self._drop_from(state, self.spark.read.parquet(f"{self.path}/{name}"))
        v = state["version"] + 1
        self._commit(state | {"version": v, "deletes": [*state["deletes"], (name, v)], "docs": state["docs"] - gone_n, "tokens": state["tokens"] - gone_t})
        return v

    def merge(self) -> int:
        """All valid documents as one segment, without what is hidden; the new version. Old files stay for readers at work
        until `vacuum`."""
        state, name = self.state(), f"seg-{uuid.uuid4().hex}"
        if len(state["segments"]) < 2 and not state["deletes"]:
            return state["version"]
        self._write(name, self._standing(state), self.documents(), self._rows(state, "postings").count())
        v = state["version"] + 1
        self._commit(state | {"version": v, "segments": [(name, v)], "shards": {name: sorted({of for s, _ in state["segments"] for of in state["shards"][s]})}, "deletes": []})
        return v

    def vacuum(self) -> None:
        """Deletes the files of segments and deletions that the last version doesn't name."""
        state = self.state()
        named = {name for name, _ in (*state["segments"], *state["deletes"])} | {"log"}
        fs, root = self._fs("")
        for f in fs.listStatus(root):
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)

    # search

    def search(self, words: DataFrame, *, k: int = 400, query: str = "query_id", **options) -> DataFrame:
        """(query, key, score, rank) as `operators.search.bm25` gives for an index of the valid documents; `words` (query, word). Only
        the blocks of terms that begin with a word are opened, and only what these name is looked up among what is hidden."""
        state = self.state()
        blocks = self._rows(state, "postings")
        if blocks is None:
            return words.select(query, F.lit(None).cast("long").alias(self.key), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        found = T.with_prefixes(blocks, words)
        # all postings of a document lie in one shard, so blocks are dealt by shard and counted there
        shards = sum(of for name, _ in state["segments"] for of in state["shards"][name])
        found = found.repartition(max(1, min(T.MOST_TASKS, shards)), "of", "shard")
        hits = self._valid(self._opened(found, "word", "of", "shard"), state).groupBy("of", "shard", "word", self.key, "length").agg(F.sum("tf").alias("tf"))
        hits = hits.drop("of", "shard")
        return T.scored(hits, words, docs=state["docs"], tokens=state["tokens"], k=k, key=self.key, query=query, **options)
