"""Predicates over catalogue columns, and the smart-rule compiler."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(hidden: str = "hidden", missing: str = "missing", trashed: str = "trashed") -> Column:
    return ~F.col(hidden) & ~F.col(missing) & ~F.col(trashed)


def presets() -> dict[str, Column]:
    """The nine library views; `hdr` reads a flag that `operators.timeline.with_membership` can make."""
    v = visible()
    return {
        "all": v, "photos": v & (F.col("kind") == "photo"), "videos": v & (F.col("kind") == "video"), "live": v & F.col("is_live"), "screenshots": v & F.col("is_screenshot"),
        "favorites": v & F.col("favorite"), "raw": v & F.col("is_raw"), "hdr": v & F.col("is_hdr"), "trash": ~F.col("hidden") & ~F.col("missing") & F.col("trashed"),
    }


def year_range(year: int, day: str = "day") -> Column:
    """A range over the day string, so that scans can prune by it."""
    return (F.col(day) >= f"{year:04d}-01-01") & (F.col(day) <= f"{year:04d}-12-31")


def contains_ci(col: Column, needle: str) -> Column:
    """ASCII case-insensitive substring test; % and _ are ordinary characters."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(col).contains("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle))


FLAGS = {"favorite": "favorite", "live": "is_live", "screenshot": "is_screenshot", "raw": "is_raw"}
TEXTS = {"folder": "rel_dir", "name": "name"}


def rule(field: str, op: str, value=None) -> Column | None:
    """One rule as a predicate; None if it isn't usable. Album rules read boolean columns `in_album_<id>`."""
    if field == "kind" and value in ("photo", "video"):
        return F.col("kind") == value
    if field in FLAGS:
        return F.col(FLAGS[field]) == bool(True if value is None else value)
    if field == "hasLocation":
        return F.col("lat").isNotNull()
    if field == "noLocation":
        return F.col("lat").isNull()
    if field == "year" and isinstance(value, int):
        return {"is": year_range(value), "before": F.col("day") < f"{value:04d}", "after": F.col("day") > f"{value:04d}-12-31"}.get(op)
    if field == "month" and isinstance(value, int):
        return F.substring("day", 6, 2) == f"{value:02d}"
    if field == "dateRange" and value:
        return F.col("day").between(*value)
    if field == "ext" and value:
        return F.col("ext") == str(value).lower()
    if field == "camera" and value:
        camera = F.concat(F.coalesce("make", F.lit("")), F.lit(" "), F.coalesce("model", F.lit("")))
        hit = contains_ci(camera, value)
        return ~hit if op == "notContains" else hit
    if field in TEXTS and value:
        hit = contains_ci(F.col(TEXTS[field]), value)
        return ~hit if op == "notContains" else hit
    if field == "album" and value is not None:
        member = F.coalesce(F.col(f"in_album_{value}"), F.lit(False))
        return ~member if op == "notIn" else member
    return None


def rules(match: str, items: list[dict], most: int = 50) -> Column:
    """All (`match="all"`) or any of the usable rules; true if there is none."""
    usable = [c for r in items[:most] if (c := rule(r["field"], r.get("op", "is"), r.get("value"))) is not None]
    if not usable:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), usable)


#: Cleanup classes and their limits: fixed values.
OLD_DAYS, LARGE_BYTES, SHORT_SECONDS = 90, 1 << 30, 2.0


def cleanup_classes(now: Column) -> Column:
    """Array of the classes that a row belongs to; null measures belong to none."""
    photo, shot = F.col("kind") == "photo", F.col("is_screenshot")
    failed = shot & ((F.col("contrast") < 0.01) | (F.col("screen_mishap") >= 0.7))
    spread = F.col("contrast") * 255
    blurry = photo & ~shot & (F.col("contrast") > 0.08) & (F.col("sharpness") / F.nullif(spread * spread, F.lit(0.0)) < 0.025) & (F.col("sharpness") < 40)
    dark = photo & ~shot & (F.col("brightness") < 0.08) & (F.col("clip_dark") > 0.7)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    classes = {
        "failed_screenshots": failed, "old_screenshots": shot & (F.col("taken_at") < now - F.make_dt_interval(F.lit(OLD_DAYS))) & no(failed),
        "mishaps": photo & ~shot & (F.col("mishap") >= 0.9) & no(blurry) & no(dark), "blurry": blurry, "dark": dark, "overexposed": photo & ~shot & (F.col("clip_bright") > 0.55),
        "short_videos": (F.col("kind") == "video") & (F.col("duration") < SHORT_SECONDS), "large_videos": (F.col("kind") == "video") & (F.col("size") > LARGE_BYTES),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in classes.items())))


def low_entropy(phash: Column, least: int = 8, most: int = 56) -> Column:
    """Hashes with too few or too many set bits tell nothing."""
    ones = popcount_hex(phash)
    return (ones < least) | (ones > most)


def _half(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("long")


def popcount_hex(h: Column) -> Column:
    """Set bits of a 16-digit hex string, by two 32-bit halves."""
    return F.bit_count(_half(h, 1)) + F.bit_count(_half(h, 9))


def hamming_hex(a: Column, b: Column) -> Column:
    return F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))


def hash_bits(h: Column) -> Column:
    """The 64 bits of a 16-digit hex string as a long; null where a half isn't a number."""
    half = lambda start: F.conv(F.substring(h, start, 8), 16, 10).try_cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))
