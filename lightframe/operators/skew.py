"""Joins whose large side may have keys that hold a large share of all rows, and query sets joined in blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.operators.graph import checkpointed

#: No key with fewer rows counts as hot.
LEAST_HOT = 1024
#: Rows of a query set, or of a small side joined to every row, that are broadcast at once.
BLOCK_ROWS = 4096


def hot_keys(counts: DataFrame, on: list[str], power: int = 1, *, always: bool = False) -> DataFrame | None:
    """Of keys with their rows (on, n; a written table) those whose n ** power is over a quarter of a task's share, with the number of tasks
    (`__parts`) that they are dealt over. There are at most four a task, so they are broadcast. Where there are none: None, or with
    `always` the largest key alone, in one part, so that plans are alike at every size."""
    work = F.pow(F.col("n").cast("double"), F.lit(power))
    total = counts.agg(F.sum(work).alias("work"), F.max("n").alias("most")).first()
    limit = max(LEAST_HOT, ((total["work"] or 0) / (4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))) ** (1 / power))
    hot = counts.where(F.col("n") > limit)
    if (total["most"] or 0) <= limit:
        if not always or not total["most"]:
            return None
        hot = counts.where(F.col("n") == total["most"]).limit(1)
    return F.broadcast(hot.select(*on, F.ceil(F.col("n") / limit).cast("int").alias("__parts")))


def spread_join(large: DataFrame, small: DataFrame, on: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """`large` joined to `small`, which has a row for each key. The keys in `hot` (see `hot_keys`) are dealt over several tasks by
    the hash of `by`, and their row of `small` goes to each of them."""
    if hot is None:
        return large.join(small, on, how)
    parts = F.coalesce("__parts", F.lit(1))
    large = large.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__parts")
    small = small.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return large.join(small, [*on, "__part"], how).drop("__part")


def with_facts(df: DataFrame, facts: DataFrame, *by: str, deal: str, rows: str = "n") -> DataFrame:
    """`df` with what `facts` has on its group (by, `rows`, ...; one row each), null groups as well. Groups that hold much of all rows
    are dealt over tasks by the hash of `deal`; nothing gathers a group. The number of rows isn't added."""
    group = F.struct(*(F.col(c).alias(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    held = checkpointed(facts.select(group.alias("__g"), F.col(rows).alias("__rows"), *(c for c in facts.columns if c not in (*by, rows))))
    hot = hot_keys(held.select("__g", F.col("__rows").alias("n")), ["__g"])
    return spread_join(df.withColumn("__g", group), held.drop("__rows"), ["__g"], hot, [deal]).drop("__g")


def blocks(queries: DataFrame, key: str, *, rows: int = BLOCK_ROWS) -> Iterator[DataFrame]:
    """A query set in broadcast blocks of about `rows` rows, so that all rows meet it block by block however large it is."""
    n = queries.count()
    parts = 1 if n <= rows else -(-2 * n // rows)
    for k in range(parts):
        yield F.broadcast(queries if parts == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k))


def meet(df: DataFrame, queries: DataFrame, key: str, condition=None) -> DataFrame:
    """Every row of `df` beside every row of a stated query set (that meets `condition`), in blocks."""
    out = None
    for block in blocks(queries, key):
        part = df.join(block) if condition is None else df.join(block, condition)
        out = part if out is None else out.unionByName(part)
    return out
