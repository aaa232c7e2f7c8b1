"""File listings in, selections out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.functions.names import PHOTO, VIDEO, base_name, ext, is_screenshot, kind, rel_dir, stem

#: Folders that listings never enter.
SYSTEM_DIRS = ("@eaDir", "$RECYCLE.BIN", "System Volume Information", ".thumbnails", "node_modules", "#recycle", ".Trashes", ".Spotlight-V100", ".fseventsd")
BUNDLES = r"\.(photoslibrary|photolibrary|app)$"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents are pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def listed(files: DataFrame, *, extensions: tuple[str, ...] = (*PHOTO, *VIDEO)) -> DataFrame:
    """Files of known extensions that aren't empty, hidden or temporary, nor in hidden, system or bundle folders."""
    name, folders = base_name(F.col("path")), F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    bad = F.exists(folders, lambda s: s.startswith(".") | s.isin(*SYSTEM_DIRS) | F.lower(s).rlike(BUNDLES))
    return files.where((F.col("length") > 0) & ~name.rlike("^[.~]") & ext(name).isin(*extensions) & ~bad)


def is_shortcut(content: Column, length: Column) -> Column:
    """Alias and shortcut files by their first bytes; only small files are looked at."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(16)))
    mac = (F.substring(head, 1, 8) == "626F6F6B") & (F.substring(head, 17, 8) == "6D61726B")
    return (length < 65536) & (mac | (F.substring(head, 1, 16) == "4C00000001140200"))


def initial_rows(files: DataFrame, *, now: Column) -> DataFrame:
    """First catalogue rows of listed files, from their paths and times."""
    from lightframe.functions.dates import infer_date
    from lightframe.functions.names import RAW

    name = base_name(F.col("path"))
    e = ext(name)
    rows = files.withColumn("__d", infer_date(name, rel_dir(F.col("path")), F.col("modificationTime")))
    return rows.select(
        "path", rel_dir(F.col("path")).alias("rel_dir"), name.alias("name"), stem(name).alias("stem"), e.alias("ext"), kind(e).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        "__d.taken_at", F.date_format("__d.taken_at", "yyyy-MM-dd").alias("day"), F.col("__d.source").alias("date_source"), e.isin(*RAW).alias("is_raw"), is_screenshot(name, e, F.lit(False), F.lit(None).cast("string")).alias("is_screenshot"), now.alias("added_at"),
    )


def cities(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """A place table from JSON of positional arrays: {countries: {cc: name}, cities: [[name, lat, lon, cc, admin, pop]]}, one
    document a file, or a line."""
    raw = spark.read.schema("countries map<string,string>, cities array<array<string>>").option("multiLine", multi_line).json(path)
    each = raw.select("countries", F.explode("cities").alias("c"))
    at = lambda i: F.get(F.col("c"), F.lit(i))
    return each.select(at(0).alias("city"), at(1).cast("double").alias("lat"), at(2).cast("double").alias("lon"), at(3).alias("cc"), at(4).alias("admin"), at(5).cast("double").cast("long").alias("population"), F.try_element_at("countries", at(3)).alias("country"))


def with_layout(df: DataFrame, *, offset: Column, at: str = "taken_at") -> DataFrame:
    """Adds year and year_month of the capture zone's wall clock."""
    wall = F.timestamp_millis(F.unix_millis(at) + F.coalesce(offset, F.lit(0)) * 60_000)
    return df.withColumns({"year": F.date_format(wall, "yyyy"), "year_month": F.date_format(wall, "yyyy-MM")})


def export(df: DataFrame, path: str, *, folders: str = "month") -> None:
    """Writes a selection flat, by year, or by year and month; one task writes a folder's rows, salted by adaptive splits."""
    keys = {"flat": [], "year": ["year"], "month": ["year", "year_month"]}[folders]
    out = df.hint("rebalance", *keys) if keys else df
    (out.write.partitionBy(*keys) if keys else out.write).mode("overwrite").parquet(path)


def with_policy(df: DataFrame, policy: Column, *, place: tuple[str, ...] = ("lat", "lon"), key: str = "asset_id") -> DataFrame:
    """`all` keeps columns, `noLocation` blanks the place, `none` blanks all but the key."""
    return df.select(*((F.col(c) if c == key else F.when((policy == "all") | ((policy == "noLocation") & F.lit(c not in place)), F.col(c))).alias(c) for c in df.columns))


def selection(df: DataFrame, ids: DataFrame, *, key: str = "asset_id", at: str = "taken_at") -> DataFrame:
    """Chosen rows that exist, once each, by time, with their weight in progress bars (ten for a transcoded video)."""
    chosen = df.where("not missing").join(ids.select(key).distinct(), key, "left_semi")
    return chosen.withColumn("weight", F.when(F.col("kind") == "video", 10).otherwise(1)).orderBy(at, key)


def geojson(df: DataFrame, *, key: str = "asset_id") -> DataFrame:
    """A GeoJSON feature per located row, as text; write it with `write.text`."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(F.col(key).alias("id")).alias("properties")))
    return df.where("lat is not null and lon is not null").select(key, feature.alias("feature"))
