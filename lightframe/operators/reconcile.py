"""Snapshots against the catalogue, companion files, versions and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(catalogue: DataFrame, listing: DataFrame, *, path: str = "path") -> DataFrame:
    """What a listing (path, size, mtime) means for the catalogue (path, size, mtime, is_missing): insert, changed, missing,
    reappeared, unchanged. A file that is back and differs counts as changed. Paths listed twice count once."""
    c = catalogue.select(F.col(path).alias("__c"), F.col("size").alias("__cs"), F.col("mtime").alias("__cm"), F.col("is_missing").alias("__x"))
    n = listing.groupBy(path).agg(F.max(F.struct("mtime", "size")).alias("l")).select(F.col(path).alias("__l"), F.col("l.size").alias("size"), F.col("l.mtime").alias("mtime"))
    differs = ~(F.col("__cs").eqNullSafe(F.col("size")) & F.col("__cm").eqNullSafe(F.col("mtime")))
    action = (
        F.when(F.col("__c").isNull(), "insert").when(F.col("__l").isNull(), F.when(F.col("__x"), "unchanged").otherwise("missing")).when(differs, "changed").when(F.col("__x"), "reappeared").otherwise("unchanged")
    )
    return c.join(n, F.col("__c") == F.col("__l"), "full_outer").select(F.coalesce("__c", "__l").alias(path), "size", "mtime", action.alias("action"))


def apply_reconcile(catalogue: DataFrame, actions: DataFrame, *, now: Column, path: str = "path") -> DataFrame:
    """The catalogue after the actions: a union rewrite. Rows are marked missing, never deleted."""
    a = actions.where("action != 'unchanged'").select(path, F.col("size").alias("__s"), F.col("mtime").alias("__m"), "action")
    j = catalogue.join(a, path, "left")
    changed, gone = F.coalesce(F.col("action") == "changed", F.lit(False)), F.coalesce(F.col("action") == "missing", F.lit(False))
    old = j.select(
        path, F.when(changed, F.col("__s")).otherwise(F.col("size")).alias("size"), F.when(changed, F.col("__m")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(gone, F.lit(True)).when(F.col("action").isNotNull(), F.lit(False)).otherwise(F.col("is_missing")).alias("is_missing"), F.when(gone, now).when(F.col("action").isNotNull(), F.lit(None).cast("timestamp")).otherwise(F.col("missing_at")).alias("missing_at"),
        (F.col("thumb_v") + changed.cast("int")).alias("thumb_v"), F.when(changed, 0).otherwise(F.col("meta_state")).alias("meta_state"),
    )
    new = a.where("action = 'insert'").select(path, F.col("__s").alias("size"), F.col("__m").alias("mtime"), F.lit(False).alias("is_missing"), F.lit(None).cast("timestamp").alias("missing_at"), F.lit(0).alias("thumb_v"), F.lit(0).alias("meta_state"))
    return old.unionByName(new)


def vanished_under(catalogue: DataFrame, folders: DataFrame, *, path: str = "path", folder: str = "folder") -> DataFrame:
    """Paths below vanished folders: each path is exploded into its ancestors and meets them by equality."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = catalogue.select(path, F.explode(up).alias(folder))
    return each.join(folders.select(folder).distinct(), folder, "left_semi").select(path).distinct()


def pair_companions(df: DataFrame, *by: str, main: Column, companion: Column, key: str = "asset_id", path: str = "path") -> DataFrame:
    """Rows that `companion` marks are hidden when a `main` row has the same key; that row learns the path of the companion
    with the highest id. Companions without a main row are visible. Adds `companion_hidden` and `companion_path`."""
    rows = df.withColumns({"__m": F.coalesce(main, F.lit(False)), "__c": F.coalesce(companion, F.lit(False))})
    sides = rows.groupBy(*by).agg(F.max("__m").alias("__has"), F.max_by(F.when(F.col("__c"), F.col(path)), F.when(F.col("__c"), F.col(key))).alias("__p"))
    match = F.lit(True)
    s = sides.select(*(F.col(c).alias(f"__{c}") for c in by), "__has", "__p")
    for c in by:
        match = match & (rows[c] == s[f"__{c}"])
    out = rows.join(s, match, "left")
    return out.select(*df.columns, (F.col("__c") & F.coalesce("__has", F.lit(False))).alias("companion_hidden"), F.when(F.col("__m"), F.col("__p")).alias("companion_path"))


def link_versions(df: DataFrame, *, key: str = "asset_id", sources: str = "sources", created: str = "created_at") -> DataFrame:
    """Edits (sources: JSON list of ids) point at their first source when it exists; others stay visible orphans. Of rows
    with equal sources and time, the one of kind `master` points at the other."""
    first = F.get_json_object(sources, "$[0]").cast("long")
    edits = df.where(F.col(sources).isNotNull() & (F.col("kind") == "edit")).select(key, first.alias("version_of"))
    real = df.select(F.col(key).alias("version_of"))
    linked = edits.join(real, "version_of", "left_semi").select(key, "version_of")
    twin = df.where((F.col("kind") == "jpeg") & F.col(sources).isNotNull()).groupBy(sources, created).agg(F.min(key).alias("version_of"))
    masters = df.where(F.col("kind") == "master").select(key, sources, created).join(twin, [sources, created]).select(key, "version_of")
    return df.select(key, "kind").join(linked.unionByName(masters), key, "left")


def link_once(ledger: DataFrame, links: DataFrame, catalogue: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports each alias once: links (alias_path, folder, target) not in the ledger whose target is known. A hidden target
    gives its visible sibling of the same group. Folders become albums unless an album of that name was deleted.
    Returns new ledger rows and new (folder, asset_id) members; unresolved links are tried again later."""
    new = links.join(ledger.select("alias_path"), "alias_path", "left_anti").dropDuplicates(["alias_path"])
    found = new.join(catalogue.select(F.col("path").alias("target"), "asset_id", "hidden", "group_key"), "target")
    shown = catalogue.where(~F.col("hidden")).groupBy("group_key").agg(F.min("asset_id").alias("sibling"))
    found = found.join(shown, "group_key", "left").withColumn("member", F.when(F.col("hidden"), F.col("sibling")).otherwise(F.col("asset_id"))).where("member is not null")
    members = found.join(deleted.select("folder").distinct(), "folder", "left_anti").select("folder", F.col("member").alias("asset_id")).distinct()
    return found.select("alias_path", "folder", "target"), members


def propagate(results: DataFrame, members: DataFrame) -> DataFrame:
    """A derived file joins every album of its sources (asset_id, source_ids); memberships that exist are left out."""
    each = results.select("asset_id", F.explode("source_ids").alias("source_id"))
    new = each.join(members.select("album_id", F.col("asset_id").alias("source_id")), "source_id").select("album_id", "asset_id").distinct()
    return new.join(members.select("album_id", "asset_id"), ["album_id", "asset_id"], "left_anti")


def purge_set(df: DataFrame, failed: DataFrame) -> DataFrame:
    """Paths that go with trashed rows: their own and their companions'; paths that failed to be deleted stay."""
    paths = df.where("trashed").select("asset_id", F.explode(F.array_compact(F.array("path", "companion_path"))).alias("path"))
    return paths.join(failed.select("path").distinct(), "path", "left_anti").select("asset_id", "path")


def orphan_companions(deleted: DataFrame, df: DataFrame, *, path: str = "path", companion: str = "companion_path") -> DataFrame:
    """Companion paths of deleted rows that no row of the catalogue has as its own."""
    return deleted.where(F.col(companion).isNotNull()).select(F.col(companion).alias(path)).distinct().join(df.select(path), path, "left_anti")
