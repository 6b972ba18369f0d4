"""Session settings and lineage cuts shared by every plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan relies on.  All of them are runtime SQL settings, so they
#: can be applied to a session that somebody else created.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods above 8000 bytes of bytecode; larger fused stages
    # would run interpreted, so let Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "skyrank", **extra: str) -> SparkSession:
    """A local session for tests, benchmarks and small boards."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage cuts are written to.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) and everything runs in one process do we pick a temporary folder ourselves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyrank-checkpoint-"))
    return sc.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few but costly rows out to all reducers.

    By size alone the rows of a task-level table would be put together into one partition,
    and a Python function of them would run on one core.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def table(df: DataFrame) -> DataFrame:
    """Write a task-level table to the shared folder and read it back.

    Its size is then known before a join with fixes is planned, so Spark broadcasts it
    while it is small and shuffles once it is not.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget how it was made.

    Used where several later passes read one expensive intermediate table; a lost
    executor re-reads files instead of recomputing.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dealt(rows: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Materialise ``finish(rows)`` like :func:`cut`, and keep how ``finish`` dealt and sorted it.

    A checkpoint of an adaptive plan forgets its partitioning, so every later pass would shuffle and sort the
    table again.  ``rows`` still run adaptively, with all their joins; only the last shuffle and what follows it
    are planned ahead, with as many partitions as the shuffles of tables that are joined with it.
    """
    spark, adaptive = rows.sparkSession, "spark.sql.adaptive.enabled"
    ensure_checkpoint_dir(spark)
    run = rows._jdf.queryExecution().toRdd()
    held = DataFrame(spark._jsparkSession.internalCreateDataFrame(run, rows._jdf.schema(), False), spark)
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        return finish(held).checkpoint(eager=True)
    finally:
        spark.conf.set(adaptive, before)
