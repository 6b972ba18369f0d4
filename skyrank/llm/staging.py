"""Written tables between the steps of an operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, tune

#: Rows of text in one Arrow batch: a Python worker holds a few megabytes at a time.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
#: Once a staged table is written nothing reads the shuffle files behind it, so Spark may drop them.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators rely on."""
    if spark.conf.get(ARROW_ROWS[0], None) != ARROW_ROWS[1]:
        spark.conf.set(*ARROW_ROWS)
    return tune(spark)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder that nothing else uses."""
    return f"{ensure_checkpoint_dir(prepared(spark))}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or the new folder ``path`` in it, and read it back.

    This cuts the lineage: a lost executor re-reads files.  The size of the table is known to
    the plans that follow.
    """
    spark = prepared(df.sparkSession)
    path = path or new_folder(spark, "stage")
    before = spark.conf.get(RELEASE_SHUFFLES, None)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(RELEASE_SHUFFLES)
        else:
            spark.conf.set(RELEASE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that grows with the input: neither side of it goes through the driver.

    Spark takes an exploded table for no larger than what it was made of, and a packed file for
    no more than its bytes, so by their sizes it would broadcast tables that the driver cannot hold.
    """
    return df.hint("merge")


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete written tables that nothing reads any more, and forget their names."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(conf).delete(path, True)


def around(docs: DataFrame, name: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` leaves of ``docs``, with their own columns - one called ``name``, which the step adds, included."""
    taken = {c.lower() for c in docs.columns}
    if name not in taken:
        return step(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    free = name
    while free in taken:
        free += "_"
    inner = {c: free if c.lower() == name else c for c in docs.columns}
    rows = step(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()]))
    return rows.select(*[F.col(f"`{x}`").alias(c) for c, x in inner.items()])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of any table; further columns and their names play no part."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
