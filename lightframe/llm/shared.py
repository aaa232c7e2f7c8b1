"""What the operators of this subpackage share: the cluster's shared folder, written tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

from lightframe.operators.skew import hot_keys, spread_join

__all__ = ["checked", "documents", "drop_stash", "hot_keys", "new_path", "shared_dir", "spread_join", "stash"]

#: A join side of at most so many bytes may be broadcast; beyond it, both sides are shuffled.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, in local mode alone, a new one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lightframe_dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = sc._lightframe_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` once into the shared folder and reads it back: lineage ends here, and lost executors cost no rework."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(*dfs: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in dfs:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(field) -> Column | int:
    """Bytes of a column's values: fixed, or of the row."""
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    return 16 if isinstance(kind, AtomicType) else F.octet_length(F.to_json(F.struct(c)))


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A hint to broadcast `df` (stashed) if its bytes, measured row by row, are few; else `df` as it is."""
    widths = [_width(f) for f in df.schema.fields]
    row = sum((w for w in widths if not isinstance(w, int)), F.lit(sum(w for w in widths if isinstance(w, int))))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0) <= most else df.hint("shuffle_merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
