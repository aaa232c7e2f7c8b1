"""Arrays of numbers as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def weighted_mean(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x * wa + y * wb) / (wa + wb))


def quantised(a: Column) -> Column:
    """Struct: scale (largest magnitude / 127, or 1) and small integers."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.floor(x.cast("double") / scale + 0.5).cast("tinyint")).alias("q"))


def quantised_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) * a["scale"] * b["scale"]


def sign_hash(a: Column) -> Column:
    """64 signs against the median of the first 64 values, as 16 hex digits."""
    x = F.transform(F.slice(a, 1, 64), lambda v: v.cast("double"))
    middle = F.sort_array(x)
    median = (F.element_at(middle, 32) + F.element_at(middle, 33)) / 2
    nibble = lambda i: F.aggregate(F.slice(x, i * 4 + 1, 4), F.lit(0), lambda s, v: s * 2 + F.when(v > median, 1).otherwise(0))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(nibble(i).cast("string"), 10, 16)), ""))
