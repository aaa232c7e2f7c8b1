"""Numbers of media rows: quality, exposure, geometry, positions, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1e6


def exposure_score(brightness: Column) -> Column:
    return 1 - F.least(F.lit(1.0), F.abs(brightness - 0.47) / 0.47)


def quality_score(sharpness: Column, exposure: Column, mpx: Column) -> Column:
    """0.6 sharpness, 0.3 exposure, 0.1 resolution; three decimals."""
    sharp = clamp((F.log10(sharpness + 1) - 1) / 2.2)
    size = clamp(F.log2(F.greatest(F.lit(1.0), mpx)) / 5)
    return F.round(0.6 * sharp + 0.3 * exposure + 0.1 * size, 3)


def exposure_distance(brightness: Column, clip_bright: Column, clip_dark: Column) -> Column:
    return F.abs(F.coalesce(brightness, F.lit(0.47)) - 0.47) + F.coalesce(clip_bright, F.lit(0.0)) + F.greatest(F.lit(0.0), F.coalesce(clip_dark, F.lit(0.0)) - 0.05)


def aspect_ratio(width: Column, height: Column, orientation: Column) -> Column:
    """Width by height as displayed: orientations of 5 and more lie on their side."""
    return F.when(F.coalesce(orientation, F.lit(1)) >= 5, height / width).otherwise(width / height)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # `least` would pass over a null


def gps_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    v = d + F.coalesce(m, F.lit(0.0)) / 60 + F.coalesce(s, F.lit(0.0)) / 3600
    return F.when(ref.isin("S", "W"), -v).otherwise(v)


def iso6709(text: Column) -> Column:
    """`+48.8566+002.3522/` as a struct of lat and lon; (0, 0) is no place."""
    part = lambda i: F.regexp_extract(text, r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", i).try_cast("double")
    lat, lon = part(1), part(2)
    return F.when(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)), F.struct(lat.alias("lat"), lon.alias("lon")))


def quick_hash(content: Column, block: int = 65536) -> Column:
    """Size, head and tail of the bytes: equality classes of files without reading all of a large one."""
    n = F.octet_length(content)
    tail = F.when(n > block, F.substring(content, F.greatest(F.lit(block) + 1, n - block + 1), F.lit(block))).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.concat(n.cast("string"), F.lit(":")).cast("binary"), F.substring(content, F.lit(1), F.lit(block)), tail), 256)


def fingerprint(ids: Column) -> Column:
    """An aggregate: order-insensitive sum of ids times a multiplier, modulo 2^32."""
    m = F.lit(1 << 32)
    return F.pmod(F.sum(F.pmod(F.pmod(ids, m) * F.lit(2654435761), m)), m)
