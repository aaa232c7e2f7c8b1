"""Connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a local one only in local mode."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lightframe_dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc._lightframe_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes `df` once into the folder that the cluster shares and reads it back: lineage ends here, lost executors cost no
    rework, and later reads take the columns that they need."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*dfs: DataFrame) -> None:
    """Deletes written tables (see `checkpointed`) that nothing reads any more."""
    for df in dfs:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)


#: Up to so many edges no star's centre is worth dealing over tasks.
FEW_EDGES = 1 << 17


def _told(edges: DataFrame) -> tuple:
    """Number of edges, and two sums that tell one set of edges from another."""
    sums = (F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long")))
    return tuple(edges.agg(F.count("*"), *sums).first())


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; a component is named by its smallest node.

    Large-star and small-star in turn (Kiveris et al., 2014) until nothing moves; each round is a written table that the next
    replaces, and the driver sees a few numbers a round. A star's centre is one key of its many edges: such keys are dealt over
    tasks. Self-loops and nulls are ignored."""
    from lightframe.operators.skew import hot_keys, spread_join

    def to_least(large: DataFrame, least: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
        if few:
            return large.join(least.select("u", "m"), "u"), []
        least = checkpointed(least)
        return spread_join(large, least.select("u", "m"), ["u"], hot_keys(least, ["u"]), ["v"]), [least]

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    told = _told(e)
    while True:
        few = told[0] <= FEW_EDGES
        # large star: neighbours above a node go to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        up, used = to_least(both.where("v > u"), low, few)
        large = up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large if few else checkpointed(large)
        # small star: a node and its neighbours below it go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down, more = to_least(large, least, few)
        small = down.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = checkpointed(small)
        discarded(e, *used, *more, *([] if few else [large]))
        was, told, e = told, _told(new), new
        if told == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
