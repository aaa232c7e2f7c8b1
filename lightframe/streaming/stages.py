"""Work on a catalogue in batches, the newest rows first, that survives a stop at any point.

A plan deals what is due into numbered batches and is written once. Each batch's results are a table of their own; a numbered log
file, written last and never overwritten, says which tables count. A run that starts again goes on with the first batch
that the log doesn't name; what an unfinished batch left behind is never read. So nothing is done twice in the results
and nothing is lost."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightframe.operators.ordered import rank_within


class Stage:
    """One stage of work at `path`. `need` names the column that says whether a row's prerequisite is done (1)."""

    def __init__(self, spark: SparkSession, path: str, *, version: int = 1, need: str | None = None, key: str = "asset_id", at: str = "taken_at", batch_rows: int = 100_000):
        self.spark, self.path, self.version, self.need, self.key, self.at, self.batch_rows = spark, path.rstrip("/"), version, need, key, at, batch_rows

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def log(self) -> list[dict]:
        """What was committed, in order: plans (plan, batches) and batches (plan, batch, version, table)."""
        fs, path = self._fs("log")
        if not fs.exists(path):
            return []
        rows = self.spark.read.text(f"{self.path}/log").select("value", F.col("_metadata.file_name").alias("n")).collect()
        return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["n"])]

    def _commit(self, number: int, entry: dict) -> None:
        fs, path = self._fs(f"log/{number:012d}.json")
        out = fs.create(path, False)  # fails if another run was first
        out.write(json.dumps(entry).encode())
        out.close()

    def results(self) -> DataFrame:
        """(key, ok, version) of every row that was worked on: its last result."""
        kind = "key long, ok boolean, version int, number int"
        parts = [self.spark.read.parquet(f"{self.path}/{e['table']}").select(F.col(self.key).alias("key"), "ok", F.lit(e["version"]).alias("version"), F.lit(n).alias("number")) for n, e in enumerate(self.log()) if "table" in e]
        whole = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kind)
        last = whole.groupBy("key").agg(F.max_by(F.struct("ok", "version"), "number").alias("r"))
        return last.select(F.col("key").alias(self.key), "r.ok", "r.version")

    def due(self, rows: DataFrame) -> DataFrame:
        """Rows that have no result of this version, failed ones included: those are parked until the version rises."""
        ready = rows.where(F.col(self.need) == 1) if self.need else rows
        return ready.join(self.results().where(F.col("version") >= self.version), self.key, "left_anti")

    def _plan(self, rows: DataFrame, number: int) -> dict | None:
        """Deals due rows into batches by time, the newest first, ties by key."""
        name = f"plan-{uuid.uuid4().hex}"
        placed = rank_within(self.due(rows), [], [F.col(self.at).desc_nulls_last(), F.col(self.key)], "__r")
        dealt = placed.withColumn("batch", F.floor((F.col("__r") - 1) / self.batch_rows).cast("int")).drop("__r")
        dealt.write.partitionBy("batch").parquet(f"{self.path}/{name}")
        fs, path = self._fs(name)
        made = [f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("batch=")]
        if not made:
            return None
        last = max(int(m.removeprefix("batch=")) for m in made)
        entry = {"plan": name, "batches": last + 1, "version": self.version}
        self._commit(number, entry)
        return entry

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], *, most_batches: int | None = None) -> int:
        """Works on what is due, batch by batch; `work` takes rows and gives key and ok. A plan of this version that was left
        unfinished is finished first; rows that `work` loses stay due for the next plan. How many batches were done."""
        log, done = self.log(), 0
        left = lambda plan: sorted(set(range(plan["batches"])) - {e["batch"] for e in log if "table" in e and e["plan"] == plan["plan"]})
        plan = next((e for e in reversed(log) if "batches" in e and e["version"] == self.version), None)
        plan = plan if plan and left(plan) else None
        while True:
            fresh = plan is None
            if fresh:
                plan = self._plan(rows, len(log))
                if plan is None:
                    return done
                log.append(plan)
            for b in left(plan):
                if most_batches is not None and done >= most_batches:
                    return done
                table = f"batch-{uuid.uuid4().hex}"
                mine = self.spark.read.parquet(f"{self.path}/{plan['plan']}").where(F.col("batch") == b).drop("batch")
                work(mine).select(self.key, "ok").write.parquet(f"{self.path}/{table}")
                entry = {"plan": plan["plan"], "batch": b, "version": self.version, "table": table}
                self._commit(len(log), entry)
                log.append(entry)
                done += 1
            if fresh:
                return done
            plan = None

    def state(self, rows: DataFrame) -> DataFrame:
        """`rows` with state (0 to do, 1 done, 2 failed) and version of the last result."""
        found = self.results().withColumnRenamed("version", "state_version")
        out = rows.join(found, self.key, "left").withColumn("state", F.when(F.col("ok").isNull(), 0).when(F.col("ok"), 1).otherwise(2))
        return out.drop("ok")
