"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents of a source queue up in a shuffled order.  The r-th copy of a document finishes at virtual
time (tokens of its source up to and with it) / target; copies leave by finish time until the budget is
spent, so every source gets its share at every moment.

Running sums never put a source or the queue in one task: they are taken within hash buckets of a
source, whose sums are added up first, and the cut is found by histograms of finish time, coarse and
then fine, and by sorting the one fine range in which the budget runs out.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own and comes
last; repeated rows queue up one by one; null doc_ids are kept and shuffled as ''; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

MAX_REPEATS = 3
BUCKET_ROWS = 4096
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """The columns ``mix_*`` the queue works on, and the document as ``mix_row``."""
    return docs.select(
        F.struct(*docs.columns).alias("mix_row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("mix_source"),
        (word_count(F.col("text")) if size is None else size).alias("mix_size"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_id")).withColumn(
        "mix_order", F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), "mix_id").cast("binary")), 1, 8), 16, 10).cast("long"))


def source_targets(rows: DataFrame, weights: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(mix_source, mix_rows, source_size, target) per source.

    ``weights`` may use ``place``, the source's place by code point from 0, null last; the default is
    1, 2, 3, repeating.  Sources share the total by weight; none is given more than ``max_repeats`` times
    its size, and what it leaves is shared by the others.
    """
    sources = rows.groupBy("mix_source").agg(
        F.count(F.lit(1)).alias("mix_rows"), F.sum("mix_size").alias("source_size"))
    weight = F.col("place") % 3 + 1 if weights is None else weights
    w = sources.withColumn("place", F.row_number().over(Window.orderBy("mix_source")) - 1).withColumns({
        "w": weight.cast("double"), "cap": F.col("source_size") * max_repeats}).withColumn("ratio", F.col("cap") / F.col("w"))
    # sources fill up in the order of cap to weight; the first that stays below its cap sets the level
    before = Window.orderBy("ratio", "mix_source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "mix_source", "level"))).over(whole)["level"]
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * first)).select(
        "mix_source", "mix_rows", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def bucket() -> Column:
    """The hash bucket of a row within its source, from ``mix_order`` and the rows of the source."""
    return F.floor(F.col("mix_order") * (F.floor(F.col("mix_rows") / BUCKET_ROWS) + 1) / 4294967296).cast("long")


def bucket_sums(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_source, mix_bucket, mix_before): tokens of a source before each of its buckets."""
    sums = rows.join(targets, "mix_source").groupBy("mix_source", bucket().alias("mix_bucket")).agg(
        F.sum("mix_size").alias("s"))
    w = Window.partitionBy("mix_source").orderBy("mix_bucket")
    return sums.select("mix_source", "mix_bucket", (F.sum("s").over(w) - F.col("s")).alias("mix_before"))


def queue(rows: DataFrame, targets: DataFrame, sums: DataFrame) -> DataFrame:
    """``rows`` with ``mix_done``: tokens of the source up to and with the row."""
    w = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_order", "mix_id", "mix_size").rowsBetween(
        Window.unboundedPreceding, 0)
    return (rows.join(targets, "mix_source").withColumn("mix_bucket", bucket())
            .join(sums, ["mix_source", "mix_bucket"])
            .withColumn("mix_done", F.col("mix_before") + F.sum("mix_size").over(w)))


def finish(repeat: Column) -> Column:
    """Virtual finish time of a copy; null where the source is to give nothing."""
    return F.when(F.col("target") > 0, (repeat * F.col("source_size") + F.col("mix_done")) / F.col("target"))


def last_copy(queued: DataFrame, budget: Column | None = None, max_repeats: int = MAX_REPEATS) -> tuple | None:
    """(finish, source, order, id) of the last copy that leaves before the budget is spent."""
    copies = queued.select(
        "mix_source", "mix_order", "mix_id", "mix_size",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), finish)).alias("at")).where("at is not null")
    rough = F.least(F.floor(F.col("at") * RANGES), F.lit(4 * RANGES)).cast("long")
    exact = F.floor((F.col("at") * RANGES - rough) * RANGES).cast("long")
    left = queued.agg((F.coalesce(F.sum("mix_size"), F.lit(0)) if budget is None else budget).alias("b")).first()["b"]
    taken, last = [], None
    for part in (rough, F.least(exact, F.lit(RANGES))):
        sums = copies.groupBy(part.alias("part")).agg(F.sum("mix_size").alias("s"))
        run = sums.withColumn("run", F.sum("s").over(Window.orderBy("part")))    # at most 4 * RANGES + 1 rows
        over = run.where(F.col("run") > left).orderBy("part").select("part", (F.col("run") - F.col("s")).alias("b")).first()
        below = copies if over is None else copies.where(part < over["part"])
        taken.append(below)
        if over is None:
            break
        left -= over["b"]
        copies = copies.where(part == over["part"])
    else:
        w = Window.orderBy("at", "mix_source", "mix_order", "mix_id").rowsBetween(Window.unboundedPreceding, 0)
        taken.append(copies.withColumn("run", F.sum("mix_size").over(w)).where(F.col("run") <= left).drop("run"))
    for some in reversed(taken):    # ranges in order, so the last that has a copy decides
        last = some.agg(F.max(F.struct("at", "mix_source", "mix_order", "mix_id")).alias("m")).first()["m"]
        if last is not None:
            return tuple(last)
    return None


def leaves(repeat: Column, last: tuple | None) -> Column:
    """Whether a copy leaves the queue no later than the last one."""
    if last is None:
        return F.lit(False)
    mine = F.struct(finish(repeat).alias("a"), F.col("mix_source").alias("b"), F.col("mix_order").alias("c"),
                    F.col("mix_id").alias("d"))
    end = F.struct(F.lit(last[0]).alias("a"), F.lit(last[1]).alias("b"), F.lit(last[2]).cast("long").alias("c"),
                   F.lit(last[3]).alias("d"))
    return F.coalesce(finish(repeat).isNotNull() & (mine <= end), F.lit(False))


def _plan(docs: DataFrame, weights: Column | None, max_repeats: int):
    rows = stage(keyed(docs).select("mix_source", "mix_size", "mix_id", "mix_order", F.col("mix_row.doc_id").alias("doc_id")))
    targets = stage(source_targets(rows, weights, max_repeats))
    sums = stage(bucket_sums(rows, targets))
    queued = stage(queue(rows, targets, sums))
    return targets, sums, queued, last_copy(queued, max_repeats=max_repeats)


def copies_taken(last: tuple | None, max_repeats: int) -> Column:
    return sum((leaves(F.lit(r), last).cast("long") for r in range(1, max_repeats)), leaves(F.lit(0), last).cast("long"))


def mix_report(docs: DataFrame, weights: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; ``taken`` counts repeats."""
    _, _, queued, last = _plan(docs, weights, max_repeats)
    return queued.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target",
                         (F.col("mix_size") * copies_taken(last, max_repeats)).alias("taken"))


def mix(docs: DataFrame, weights: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix with their own columns, each as often as the mix takes it.

    Rows are spread over range partitions of finish time, so partitions and the rows in them
    follow the order in which documents leave the queue.
    """
    targets, sums, _, last = _plan(docs, weights, max_repeats)
    queued = queue(keyed(docs), targets, sums)
    copies = queued.withColumn("mix_repeat", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).where(
        leaves(F.col("mix_repeat"), last))
    return copies.withColumn("mix_at", finish(F.col("mix_repeat"))).repartitionByRange(
        "mix_at", "mix_source", "mix_order").sortWithinPartitions("mix_at", "mix_source", "mix_order").select("mix_row.*")
