"""The stored results of scoring: pilot rows, one summary per task, and what is still to be scored.

A save replaces the rows of the tasks it scored and leaves all others alone.  Pilot rows lie partitioned by task and are
replaced partition by partition; summaries and ingest state are one row per task, and every save writes a new version of them.
Readers take the newest complete version, so a save that dies midway is not seen in them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exports

PILOTS = "pilot_id string, rank int, state string, score double, distance_m double, task_id string"
SUMMARIES = "task_id string, processed_epoch bigint, point_count bigint, status string, summary string, error string"
STATE = "task_id string, latest_epoch bigint, point_count bigint, dirty boolean"


class ResultTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def pilots(self) -> DataFrame:
        """Pilot rows of the last successful save of every task."""
        return self._read("pilots", PILOTS).where("pilot_id is not null")

    def summaries(self) -> DataFrame:
        return self._newest("summaries", SUMMARIES)

    def state(self) -> DataFrame:
        return self._newest("state", STATE)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:    # nothing has been saved yet
            return self.spark.createDataFrame([], schema)

    def _newest(self, name: str, schema: str) -> DataFrame:
        versions = self._read(f"{name}", f"{schema}, version bigint")
        last = versions.agg(F.max("version")).first()[0]
        return versions.where(F.col("version") == last).drop("version") if last is not None else versions.drop("version")

    def _add(self, name: str, rows: DataFrame) -> None:
        last = self._read(name, "version bigint").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        part = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        rows.write.parquet(part)    # read from here: an overwrite must not read what it replaces
        self.spark.read.parquet(part).coalesce(1).write.parquet(f"{self.root}/{name}/version={last + 1}")

    def put_state(self, state: DataFrame) -> None:
        """The ingest state as it is now."""
        self._add("state", state.select("task_id", "latest_epoch", "point_count", "dirty"))

    def save(self, scored: DataFrame, board: DataFrame) -> None:
        """Store one run.

        ``scored`` has a row per task (task_id, processed_epoch, point_count, status, summary, error) with the epoch and the count the run saw.
        A task with status ``ok`` gets the rows of ``board`` in place of its old ones - none, if the board has none - and is no longer dirty,
        unless points have arrived since.  Any other status stores the summary with its error text; pilot rows stay and so does ``dirty``.
        """
        scored = scored.select("task_id", "processed_epoch", "point_count", "status",
                               F.when(F.col("status") == "ok", F.col("summary")).otherwise(F.lit("{}")).alias("summary"),
                               F.when(F.col("status") == "ok", F.lit("")).otherwise(F.col("error")).alias("error"))
        good = scored.where("status = 'ok'").select("task_id")
        rows = good.join(board.select("pilot_id", "rank", "state", "score", "distance_m", "task_id"), "task_id", "left")
        exports.write_task_partitions(rows.select("pilot_id", F.col("rank").cast("int").alias("rank"), "state", F.col("score").cast("double").alias("score"),
                                                  F.col("distance_m").cast("double").alias("distance_m"), "task_id"), f"{self.root}/pilots")
        self._add("summaries", self.summaries().join(scored.select("task_id"), "task_id", "left_anti").unionByName(scored))
        seen = scored.where("status = 'ok'").select("task_id", F.col("processed_epoch").alias("e"), F.col("point_count").alias("n"))
        done = F.coalesce((F.col("e") == F.col("latest_epoch")) & (F.col("n") == F.col("point_count")), F.lit(False))
        self._add("state", self.state().join(seen, "task_id", "left").withColumn("dirty", F.col("dirty") & ~done).drop("e", "n"))
