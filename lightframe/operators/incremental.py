"""Set differences, upserts and plans of change between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_progress(df: DataFrame, stages: dict[str, str | None]) -> DataFrame:
    """Pending (0), done (1) and failed (2) rows per stage; a stage counts rows whose prerequisite is done."""
    each = F.array(*(F.struct(F.lit(s).alias("stage"), F.when(F.lit(True) if need is None else F.col(need) == 1, F.col(s)).alias("state")) for s, need in stages.items()))
    n = lambda v, name: F.count_if(F.col("state") == v).alias(name)
    return df.select(F.inline(each)).where("state is not null").groupBy("stage").agg(n(0, "pending"), n(1, "done"), n(2, "failed"))


def set_diff(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, *, key: str, version: str) -> DataFrame:
    """One row per key: the one of the highest version, new rows winning ties."""
    cols = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*cols).withColumn("__new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "__new")).alias("r"))
    return best.select("r.*")


def insert_or_ignore(old: DataFrame, new: DataFrame, *, key: str) -> DataFrame:
    return old.unionByName(new.select(*old.columns).dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def plan_diff(old: DataFrame, new: DataFrame, *more: str, sig: str = "sig", fp: str = "fp") -> DataFrame:
    """What to do with each signature: insert, replace, keep or delete. Only changed ones are written again. `more` columns of `new`
    come along, null where it lacks the signature."""
    o, n = old.select(F.col(sig).alias("__o"), F.col(fp).alias("__of")), new.select(F.col(sig).alias("__n"), F.col(fp).alias("__nf"), *more)
    action = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").when(F.col("__of").eqNullSafe(F.col("__nf")), "keep").otherwise("replace")
    return o.join(n, F.col("__o") == F.col("__n"), "full_outer").select(F.coalesce("__o", "__n").alias(sig), action.alias("action"), *more)


def sync_actions(old: DataFrame, new: DataFrame, *, key: str = "key", grown: float = 1.3) -> DataFrame:
    """Proposals: new keys are inserted; known ones are refreshed once their list is `grown` times the old one; automatic
    titles follow, those of users stay."""
    o = old.select(key, F.col("n").alias("old_n"), "auto_title")
    j = new.select(key, "n").join(o, key, "left")
    action = F.when(F.col("old_n").isNull(), "insert").when(F.col("n") > grown * F.col("old_n"), "refresh").otherwise("keep")
    return j.select(key, action.alias("action"), (F.col("old_n").isNull() | ((action == "refresh") & F.col("auto_title"))).alias("retitle"))


def stale_selections(selections: DataFrame, alive: DataFrame, *, key: str = "asset_id", protected: Column | None = None) -> DataFrame:
    """Selections of which fewer than min(6, n / 2) members are left, protected ones excepted."""
    rows = selections.where(~protected) if protected is not None else selections
    each = rows.select("key", F.size("asset_ids").alias("n"), F.explode_outer("asset_ids").alias(key)).join(alive.select(F.col(key), F.lit(1).alias("__a")), key, "left")
    return each.groupBy("key", "n").agg(F.count("__a").alias("alive")).where(F.col("alive") < F.least(F.lit(6.0), F.col("n") / 2))
