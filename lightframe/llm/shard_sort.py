"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters fit.

Rows are ordered by a 62-bit key: 30 bits of the text's hash, 20 of the id's, and 12 that deal out rows of equal id and
text by where they are read. So equal texts lie together, and a group of copies that is larger than a shard can still be
cut, whatever its ids. Every round counts the bytes of each key interval that
still holds an unmet splitter, cut into 2^BITS equal intervals (one row an interval reaches the driver: at most
splitters * 2^BITS), and puts the splitter at the nearest boundary; it is met when its error is within `tolerance` of
a shard's size or the key's bits are used up. Only rows inside open intervals are counted again.

More splitters are found than shards need: each shard is cut into `cuts` parts, rows are exchanged once to their parts,
and a row's slot is its rank in the part plus the counts of the shard's earlier parts. Nothing gathers a whole shard.

Shard boundaries inside a group of equal texts move to the group's edge where that shifts at most `group_slack` of a
shard's size.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.llm.shared import stash

KEY_BITS, TEXT_BITS, TIE_BITS, BITS = 62, 30, 12, 6
#: A part has about so many rows at most, as far as MOST_CUTS parts a shard allow.
PART_ROWS, LEAST_CUTS, MOST_CUTS = 1_000_000, 32, 512


def _key(text: Column, row_id: Column) -> Column:
    of_text = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    of_id = F.shiftrightunsigned(F.xxhash64(row_id.cast("string")), 64 - (KEY_BITS - TEXT_BITS - TIE_BITS))
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE_BITS)
    return F.shiftleft(of_text, KEY_BITS - TEXT_BITS).bitwiseOR(F.shiftleft(of_id, TIE_BITS)).bitwiseOR(tie)


def _intervals(rows: DataFrame, shift: int, wide: list[int] | None, wide_shift: int) -> dict[int, tuple[int, int]]:
    """Bytes of each non-empty interval of 2^shift keys, of those inside the wider open ones."""
    if wide is not None:
        rows = rows.where(F.shiftright("key", wide_shift).isin(wide))
    return {r["i"]: r["b"] for r in rows.groupBy(F.shiftright("key", shift).alias("i")).agg(F.sum("size").alias("b")).collect()}


def splitters(rows: DataFrame, n: int, *, tolerance: float) -> tuple[list[int], int]:
    """n - 1 keys that cut `rows` (key, size) into n parts of near equal bytes, and all bytes."""
    total, first = None, 12
    shift = KEY_BITS - first
    below_open: dict[int, int] = {}  # open interval -> bytes below it
    met: dict[int, int] = {}
    wanted: list[int] = []
    wide, wide_shift, slack = None, shift, 0.0
    while True:
        counts = _intervals(rows, shift, wide, wide_shift)
        if total is None:
            total = sum(counts.values())
            wanted = [total * k // n for k in range(1, n)]
            slack = tolerance * total / n
            below_open = {0: 0}
        edges: dict[int, list[tuple[int, int]]] = {}  # by wide interval: (edge, bytes below it)
        size = 1 << (wide_shift - shift) if wide is not None else 1 << first
        for w, low in below_open.items():
            at, found = low, [(w * size, low)]
            for i in sorted(i for i in counts if wide is None or i >> (wide_shift - shift) == w):
                if found[-1][0] != i:
                    found.append((i, at))
                at += counts[i]
                found.append((i + 1, at))
            edges[w] = found
        nxt: dict[int, int] = {}
        for k, target in enumerate(wanted):
            if k in met:
                continue
            w = max((w for w, low in below_open.items() if low <= target), default=min(below_open))
            found = edges[w]
            j = bisect_left([b for _, b in found], target)
            near = min(found[max(0, j - 1) : j + 1] or found[-1:], key=lambda e: abs(e[1] - target))
            if abs(near[1] - target) <= slack or shift == 0 or j == 0:
                met[k] = near[0] << shift
            else:
                i, low = found[j - 1]
                nxt[i] = low
        if not nxt:
            return [met[k] for k in range(n - 1)], total
        below_open, wide, wide_shift = nxt, sorted(nxt), shift
        shift = max(0, shift - BITS)


def _snapped(rows: DataFrame, keys: list[int], every: int, slack: float) -> list[int]:
    """Shard splitters at the edges of the groups that they cut, where few bytes move for it."""
    low_bits = KEY_BITS - TEXT_BITS
    shard_keys = {k: keys[k] for k in range(every - 1, len(keys), every) if keys[k] & ((1 << low_bits) - 1)}
    if not shard_keys:
        return keys
    groups = sorted({v >> low_bits for v in shard_keys.values()})
    at = F.coalesce(*(F.when(F.shiftright("key", low_bits) == v >> low_bits, F.lit(v)) for v in shard_keys.values()))
    cut = rows.where(F.shiftright("key", low_bits).isin(groups)).withColumn("at", at)
    moved = {r["at"]: r for r in cut.groupBy("at").agg(F.sum(F.when(F.col("key") < F.col("at"), F.col("size")).otherwise(0)).alias("down"), F.sum(F.when(F.col("key") >= F.col("at"), F.col("size")).otherwise(0)).alias("up")).collect()}
    out = list(keys)
    for k, v in shard_keys.items():
        r = moved.get(v)
        if r and min(r["down"], r["up"]) <= slack:
            out[k] = (v >> low_bits << low_bits) if r["down"] <= r["up"] else ((v >> low_bits) + 1 << low_bits)
    # parts beside a moved boundary keep their order
    for k in shard_keys:
        for j in range(k - 1, -1, -1):
            out[j] = min(out[j], out[k])
        for j in range(k + 1, len(out)):
            out[j] = max(out[j], out[k])
    return out


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 0.002, group_slack: float = 0.01) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0 in each shard) for every row.

    Sizes differ by about `tolerance` of a shard, what `group_slack` moves, and one row. Null texts have size 1 and the empty
    text's checksum. Null ids take part as one id; rows that repeat id and text may be cut like any group of equal texts. An
    empty table gives an empty result; shards may be empty where there are few rows."""
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), _key(F.coalesce(text, F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key")
    )
    rows = stash(narrow, "keys")
    cuts = min(MOST_CUTS, max(LEAST_CUTS, rows.count() // (shards * PART_ROWS)))
    parts = shards * cuts
    keys, total = splitters(rows.select("key", "size"), parts, tolerance=tolerance)
    keys = _snapped(rows.select("key", "size"), keys, cuts, group_slack * total / shards)
    # binary search: the number of splitters at or below the key
    table = F.array(*(F.lit(k).cast("long") for k in keys))
    steps, step = [], 1 << (len(keys).bit_length() - 1) if keys else 0
    while step:
        steps.append(step)
        step >>= 1
    part = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= len(keys)) & (F.try_element_at(table, lo + s) <= F.col("key")), lo + s).otherwise(lo)
    ) if keys else F.lit(0)
    dealt = rows.withColumn("part", part)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n")).collect()  # at most shards * cuts rows
    n = {r["part"]: r["n"] for r in counts}
    offsets = [sum(n.get(q, 0) for q in range(p - p % cuts, p)) for p in range(parts)]
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32", "size"))
    offset = F.element_at(F.array(*(F.lit(o).cast("long") for o in offsets)), F.col("part") + 1)
    return dealt.select("doc_id", "size", "text_crc32", F.floor(F.col("part") / cuts).cast("int").alias("shard"), (offset + rank - 1).alias("slot"))
