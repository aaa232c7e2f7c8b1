"""Places by coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.functions.media import haversine_km


def geocode(points: DataFrame, cities: DataFrame, *, key: str = "point_id", city_key: str = "city_id", max_km: float = 60.0) -> DataFrame:
    """The place of each point: of the cities in its one-degree cell and the eight around it, within `max_km`, the one of
    the least distance divided by 3 + 2.2 log10(population, 1000 at least). Points without one, or without coordinates, have
    nulls. Cells wrap at the date line. Cities, a dimension table, are exploded into their nine cells."""
    wrap = lambda x: F.pmod(x + 180, F.lit(360)) - 180
    around = F.sequence(F.lit(-1), F.lit(1))
    c = cities.select(F.col(city_key), F.col("lat").alias("__clat"), F.col("lon").alias("__clon"), "population")
    c = c.withColumn("__dy", F.explode(around)).withColumn("__dx", F.explode(around))
    c = c.withColumns({"__cy": F.floor("__clat") + F.col("__dy"), "__cx": wrap(F.floor("__clon") + F.col("__dx"))})
    p = points.select(key, "lat", "lon").where("lat is not null and lon is not null").withColumns({"__cy": F.floor("lat"), "__cx": wrap(F.floor("lon"))})
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("__clat"), F.col("__clon"))
    found = p.join(c, ["__cy", "__cx"]).withColumn("km", km).where(F.col("km") <= max_km)
    score = F.col("km") / (3 + 2.2 * F.log10(F.greatest(F.lit(1000), F.col("population")).cast("double")))
    best = found.groupBy(key).agg(F.min(F.struct(score.alias("score"), F.col(city_key), "km")).alias("b"))
    return points.select(key).join(best, key, "left").select(key, F.col(f"b.{city_key}").alias(city_key), F.col("b.km").alias("km"))
