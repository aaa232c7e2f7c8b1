"""Ordered operators over groups of any size: rows are dealt by ranges of (group, order), so that a group may span tasks,
and what one range hands to the next is carried by a table of at most one row a range and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightframe.operators.graph import checkpointed

PART = "__part"
#: Groups of up to so many rows are one task's, whatever their share.
WHOLE_ROWS = 1024
#: Groups of more rows are never one task's.
MOST_ROWS = 1 << 20


def ranged(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """`df` sorted into ranges of `order`, numbered by PART; a written table, as what follows reads it more than once."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))


def laid_out(df: DataFrame, by: list[str], *order: Column | str) -> tuple[DataFrame, bool]:
    """`df` with PART, and whether groups may span parts. Where no group holds more than a quarter of a task's share, each
    is one part and nothing is written; else rows are `ranged`."""
    if by:
        sizes = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
        share = (sizes["total"] or 0) // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if (sizes["most"] or 0) <= max(WHOLE_ROWS, min(share, MOST_ROWS)):
            return df.withColumn(PART, F.lit(0)), False
    return ranged(df, *by, *order), True


def before(parts: DataFrame, by: list[str], **carried: Column) -> DataFrame:
    """For each (by, PART) that follows another of its group: what `carried`, aggregates of a part, were in the earlier
    parts: the last one that isn't null."""
    ends = parts.groupBy(*by, PART).agg(*(c.alias(k) for k, c in carried.items()))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    known = F.count("*").over(earlier) > 0
    out = ends.withColumns({f"__{k}": F.last(k, ignorenulls=True).over(earlier) for k in carried} | {"__follows": known}).where("__follows")
    return F.broadcast(out.select(*by, PART, *(F.col(f"__{k}").alias(k) for k in carried)))  # a group's first part has none: at most one row a range


def carried(parts: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """`parts` with the columns of `table` (by, PART, ...), null where it has no row; null groups are groups."""
    t = table.withColumnsRenamed({c: f"__on_{c}" for c in (*by, PART)})
    match = F.col(PART) == F.col(f"__on_{PART}")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return parts.join(t, match, "left").drop(*(f"__on_{c}" for c in (*by, PART)))


def running_sum(parts: DataFrame, by: list[str], order: list[Column | str], value: Column, name: str, *, split: bool = True) -> DataFrame:
    """Adds the running sum of `value` within each group, in order; `split` as `laid_out` says."""
    within = F.sum(value).over(Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not split:
        return parts.withColumn(name, within)
    return after_sums(parts.withColumn(name, within), parts.groupBy(*by, PART).agg(F.sum(value).alias("__sum")), by, name)


def after_sums(parts: DataFrame, sums: DataFrame, by: list[str], name: str) -> DataFrame:
    """`parts` with what `sums` (by, PART, `__sum`) has of the earlier parts of each row's group added to `name`."""
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("__ahead", F.sum("__sum").over(earlier)).where("__ahead is not null").select(*by, PART, "__ahead")
    return carried(parts, F.broadcast(ahead), by).withColumn(name, F.col(name) + F.coalesce("__ahead", F.lit(0))).drop("__ahead")


def rank_within(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds each row's rank, from 1, within its group."""
    parts, split = laid_out(df, by, *order)
    return running_sum(parts, by, order, F.lit(1).cast("long"), name, split=split).drop(PART)


def with_previous(parts: DataFrame, by: list[str], order: list[str], split: bool, **columns: tuple[Column, bool]) -> DataFrame:
    """Adds, under each name, what a column was in the row before; or, where told to skip nulls, in the last row before that
    had it. Groups may span parts."""
    w = Window.partitionBy(*by, PART).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({k: F.last(c, ignorenulls=True).over(back) if skip else F.lag(c).over(w) for k, (c, skip) in columns.items()})
    if not split:
        return out
    place = F.struct(*order)
    ends = before(parts, by, **{f"__end_{k}": F.max_by(c, F.when(c.isNotNull(), place) if skip else place) for k, (c, skip) in columns.items()})
    return carried(out, ends, by).withColumns({k: F.coalesce(k, f"__end_{k}") for k in columns}).drop(*(f"__end_{k}" for k in columns))
