"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has k b-bit symbols, one for each of k hash orders of its word shingles. Two documents with
Jaccard similarity s differ in Binomial(k, 1 - s) symbols, so `plan(s)` picks k and a distance d with
P(more than d) <= MISS for pairs just at the threshold. The signature is cut into m = d // 2 + 1 chunks: by the
pigeonhole principle two signatures at most d apart have a chunk in which they differ in at most d // m = 1 symbol.
The allowed error is enumerated (each symbol of a chunk left out once), so equal keys find every pair within d.
Candidates are then confirmed on the full shingle sets.

Links are wanted only for their components, so no group is expanded into all of its pairs:

1. documents with equal shingle sets become one node;
2. in each bucket of the index every node is compared with one centre; linked nodes share a label;
3. buckets that still hold several labels are searched again. A node's *shared* count is the number of its shingles
   that another of these nodes has too; an intersection can't be larger, which rules out most pairs by two integers.
   First every node is compared with the bucket's hub, the node of the most widely shared shingles, and labels are
   merged. Two nodes of different labels can then be linked only if both have enough in common with their hub, or if they
   share a shingle that the hub hasn't; pairs of either kind are compared. This is exact: no pair is skipped by a cap.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.llm.shared import checked, drop_stash, hot_keys, spread_join, stash
from lightframe.llm.words import Words, gram_hashes, mix, pieces

SHINGLE = 5
#: A pair just at the threshold is missed with at most this probability.
MISS = 1e-5
CHUNK = 4
_ODD = np.uint64(0xD6E8FEB86659FD93)


def plan(percent: int) -> tuple[int, int, int]:
    """k symbols, distance d and m chunks of CHUNK symbols for a similarity of percent / 100."""
    for m in range(2, 64):
        k, d = CHUNK * m, 2 * m - 1
        p = 1 - percent / 100
        if sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(d + 1, k + 1)) <= MISS:
            return k, d, m
    raise ValueError("the similarity is too low for this index")


def shingle_sets(texts: pa.Array):
    """For each text the sorted distinct hashes of its 5-word shingles; of the whole sequence where it is shorter."""
    words = Words(texts, lower=True)
    h = words.hashes()
    grams = gram_hashes(h, SHINGLE)
    first = words.first.tolist()
    for lo, hi in zip(first, first[1:], strict=False):
        yield np.unique(grams[lo : hi - SHINGLE + 1] if hi - lo >= SHINGLE else gram_hashes(h[lo:hi], max(1, hi - lo)))


def _orders(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * _ODD)
    return seeds[:k], seeds[k:] | np.uint64(1)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k symbols of 16 bits: under each order, bits of the smallest shingle hash."""
    xor, odd = _orders(k)
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, ((shingles[i : i + 2048, None] ^ xor) * odd).min(axis=0))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def _sketch(k: int):
    def run(batches):
        for b in (piece for whole in batches for piece in pieces(whole, 1)):
            n, keys, sigs = [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s))
                sigs.append(signature(s, k).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "n", "skey", "sig"],
            )

    return run


def _postings(k: int, m: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, k).astype(np.uint64)
            keys = []
            for c in range(m):
                chunk = sig[:, c * CHUNK : (c + 1) * CHUNK]
                for left_out in range(CHUNK):
                    h = np.full(len(sig), c * CHUNK + left_out + 1, np.uint64)
                    for j in range(CHUNK):
                        if j != left_out:
                            h = mix(h * _ODD + chunk[:, j])
                    keys.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(node, k))], ["key", "node"])

    return run


def _near_signatures(k: int, d: int):
    """(u, v, sig_u, sig_v) -> (u, v) for signatures at most d apart."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, k) for i in (2, 3))
            near = pa.array((x != y).sum(axis=1) <= d)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["u", "v"])

    return run


def _sets(batches):
    for b in (piece for whole in batches for piece in pieces(whole, 0)):
        keys, sets = [], []
        for s in shingle_sets(b.column(0)):
            keys.append(xxhash.xxh3_128_digest(s))
            sets.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["skey", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (u, v): label is the smallest node of its connected component.

    Min-label propagation with pointer jumping; each round is a written table, the driver sees one count a round. Hubs, and
    labels of large components, are dealt over several tasks where they are joined."""
    both = stash(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    degrees = stash(both.groupBy("v").agg(F.count("*").alias("n")), "degrees")
    labels = stash(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    hubs = hot_keys(degrees, ["v"])
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "v"), ["v"], hubs, ["u"]).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
        new = stash(spread_join(low, up, ["label"], hot_keys(sizes, ["label"]), ["node"]).select("node", "was", F.least("label", "up").alias("label")), "labels")
        drop_stash(labels)
        labels = new.select("node", "label")
        if not new.where("was != label").limit(1).count():
            drop_stash(both, degrees)
            return labels


def blocks_join(df: DataFrame, on: list[str], node: str, condition, columns) -> DataFrame:
    """Pairs of rows of `df` with equal `on` that meet `condition` (over columns with _u and _v). A key of many rows is dealt into
    blocks by the hash of `node`, and each pair of blocks is a task's own."""
    hot = hot_keys(df.groupBy(*on).agg(F.count("*").alias("n")), on, power=2)
    keys, x, y = list(on), df, df
    if hot is not None:
        dealt = df.join(hot, on, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
        dealt = dealt.withColumns({"__a": F.pmod(F.xxhash64(node), "__parts").cast("int"), "__b": F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))})
        turned = [F.col("__b").alias("__a"), F.col("__a").alias("__b")]  # each pair of blocks from both sides
        x, y, keys = dealt, dealt.select(*on, *(c for c in columns if c not in on), *turned), [*on, "__a", "__b"]
    side = lambda d, z: d.select(*(F.col(k) for k in keys), *(F.col(c).alias(f"{c}_{z}") for c in columns))
    return side(x, "u").join(side(y, "v"), keys).where(condition)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of 5-word shingles (words are
    lower-cased runs without ASCII white space; fewer than 5 words make one shingle).
    Null, empty or blank texts have no shingles and no links: each is its own component. Rows with a null id take part
    by their text, and get the component's smallest non-null id, or null; `kept` is false for them unless no row of their
    component has an id, where it is null. Repeated rows and equal texts share a component; other columns are not read.
    An empty table gives an empty result."""
    k, d, m = plan(percent)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sk = stash(rows.mapInArrow(_sketch(k), f"id {kind}, n long, skey binary, sig binary"), "sketches")
    nodes = stash(
        sk.where("n > 0").groupBy("skey").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.max("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    postings = nodes.select("node", "sig").mapInArrow(_postings(k, m), "key long, node long")

    def near(pairs: DataFrame) -> DataFrame:
        u, v = (nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "uv")
        return spread_join(pairs.join(u, "u"), v, ["v"], hot_keys(pairs.groupBy("v").agg(F.count("*").alias("n")), ["v"]), ["u"]).select("u", "v", "sig_u", "sig_v").mapInArrow(_near_signatures(k, d), "u long, v long")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The full shingle sets of some nodes, made again from their texts."""
        ids = stash(wanted.join(nodes, "node").select("id", "node", "skey"), "wanted")
        texts = rows.join(checked(ids.where("id is not null").select("id").distinct()), "id", "left_semi").select("text")
        if ids.where("id is null").limit(1).count():  # no row of these texts has an id; they are found by their keys alone
            texts = texts.unionByName(rows.where("id is null").select("text"))
        made = texts.mapInArrow(_sets, "skey binary, shingles array<long>")
        sets = stash(made.join(checked(ids.select("skey", "node")), "skey").select("node", "shingles").dropDuplicates(["node"]), "sets")
        drop_stash(ids)
        return sets

    def linked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        pairs = stash(pairs, "pairs")
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        made = sets is None
        sets = sets_of(ends) if made else sets
        u, v = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "uv")
        both = F.size(F.array_intersect("set_u", "set_v"))
        found = stash(spread_join(pairs.join(u, "u"), v, ["v"], hot_keys(pairs.groupBy("v").agg(F.count("*").alias("n")), ["v"]), ["u"]).where(100 * both >= percent * (F.size("set_u") + F.size("set_v") - both)).select("u", "v"), "links")
        drop_stash(pairs, *([sets] if made else []))
        return found

    # every node of a bucket against the bucket's smallest
    centres = stash(postings.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("v")).where("n > 1"), "centres")
    full = hot_keys(centres, ["key"])
    found = stash(spread_join(postings.withColumnRenamed("node", "u"), centres.select("key", "v"), ["key"], full, ["u"]).where("u != v").select("key", "u", "v"), "buckets")
    pairs = stash(found.select("u", "v").distinct(), "pairs")
    links = linked(near(pairs))
    drop_stash(pairs)
    labels = components(links)

    # buckets with several labels
    members = found.select("key", F.col("u").alias("node")).union(found.select("key", F.col("v").alias("node")).distinct())
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    rest = stash(spread_join(labelled, mixed, ["key"], full, ["node"]), "rest")
    drop_stash(found)
    if rest.limit(1).count():
        sets = sets_of(rest.select("node").distinct())
        each = sets.select("node", F.explode("shingles").alias("shingle"))
        often = stash(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "often")
        common = hot_keys(often, ["shingle"])
        shared = spread_join(each, often, ["shingle"], common, ["node"]).groupBy("node").agg(F.count("*").alias("shared"), F.sum("n").alias("weight"))
        counts = sets.select("node", F.size("shingles").alias("n")).join(shared, "node").where(100 * F.col("shared") >= percent * F.col("n"))
        alive = stash(rest.join(counts, "node"), "alive")
        hubs = stash(alive.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub")), "hubs")
        spokes = stash(spread_join(alive, hubs, ["key"], full, ["node"]).where("node != hub").select("node", "hub").distinct(), "spokes")
        of_hub = stash(spokes.groupBy("hub").agg(F.count("*").alias("n")), "of-hub")
        hub_sets = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_set"))
        spokes = spread_join(spokes.join(sets, "node"), hub_sets, ["hub"], hot_keys(of_hub, ["hub"]), ["node"]).select(
            "node", "hub", F.size("shingles").alias("n_u"), F.size("hub_set").alias("n_v"), F.size(F.array_intersect("shingles", "hub_set")).alias("common")
        )
        spokes = stash(spokes, "spokes")
        near_hub = (100 + percent) * F.col("common") >= percent * (F.col("n_u") + F.col("n_v"))
        links = links.unionByName(spokes.where(near_hub).select(F.col("node").alias("u"), F.col("hub").alias("v")))
        labels = components(links)
        a = alive.drop("label", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = a.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
        a = spread_join(a, mixed.join(hubs, "key"), ["key"], full, ["node"]).join(spokes.select("node", "hub", "common"), ["node", "hub"], "left")
        a = stash(a.select("key", "hub", "node", "label", "n", "shared", F.coalesce("common", "n").alias("common")), "open")
        # 100 i >= p (n_u + n_v - i)  <=>  (100 + p) i >= p (n_u + n_v), and i is at most either shared count; and i is at
        # most the lesser of what the two have in common with a hub, plus what they share that the hub hasn't
        enough = lambda c: (100 + percent) * F.least(f"{c}_u", f"{c}_v") >= percent * (F.col("n_u") + F.col("n_v"))
        apart = (F.col("node_u") < F.col("node_v")) & (F.col("label_u") != F.col("label_v")) & enough("shared")
        columns = ("node", "label", "n", "shared", "common")
        as_pair = (F.col("node_u").alias("u"), F.col("node_v").alias("v"))
        by_hub = blocks_join(a, ["key"], "node", apart & enough("common"), columns).select(*as_pair)
        each = spread_join(a.join(sets, "node"), hub_sets, ["hub"], hot_keys(a.groupBy("hub").agg(F.count("*").alias("n")), ["hub"]), ["node"])
        each = each.select("key", "node", "label", "n", "shared", "common", F.explode(F.array_except("shingles", "hub_set")).alias("shingle"))
        each = stash(spread_join(each, often.select("shingle"), ["shingle"], common, ["node"]), "beside")
        by_rest = blocks_join(each, ["key", "shingle"], "node", apart & ~enough("common"), columns).select(*as_pair)
        pairs = stash(by_hub.union(by_rest).distinct(), "pairs")
        labels = components(links.unionByName(linked(near(pairs), sets)))
        drop_stash(pairs, each, a, alive, sets)

    groups = nodes.select("skey", "node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = groups.groupBy("label").agg(F.min("id").alias("component_id"))
    of_set = spread_join(groups, least, ["label"], hot_keys(groups.groupBy("label").agg(F.count("*").alias("n")), ["label"]), ["node"]).select("skey", "component_id")
    out = spread_join(sk.select("id", "n", "skey"), of_set, ["skey"], hot_keys(nodes.select("skey", F.col("rows").alias("n")), ["skey"]), ["id"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.when(F.col("component_id").isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
