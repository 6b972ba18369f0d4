"""Event-stream and export queries over whole logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..operators.ranking import final_ranking
from ..operators.tracks import KEY
from ..session import cut, ensure_checkpoint_dir, spread, table
from ..sinks import exports
from ..streaming import events as ev
from ..streaming import live, silence
from .live_tables import _batch, _scoring_tables, _state0, _stored
from .race import Race, big, r


def event_lines(c: Race, points: DataFrame | None = None) -> DataFrame:
    """Received points as canonical lines in order of arrival, some malformed, repeated or set-up."""
    e = F.col("event_id")
    kind = (F.when(e % 100 == 8, ev.TYPES[1]).when(e % 100 == 18, ev.TYPES[0]).when(e % 100 == 28, ev.TYPES[4])
            .when(e % 10 == 9, ev.TYPES[2]).when(e % 51 == 1, "posn").otherwise(ev.TYPES[3]))
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    data = F.concat(F.lit('{"pilot_id":'), q(F.col("pilot_id")), F.lit(',"timestamp":'), F.col("epoch").cast("string"),
                    F.lit(',"lat":'), F.round("lat", 6).cast("string"), F.lit(',"lon":'), F.round("lon", 6).cast("string"),
                    F.lit(',"alt_gps":'), F.coalesce("alt_gps", F.lit(0.0)).cast("int").cast("string"), F.lit("}"))
    seq = (e + 1).cast("string")
    stamp = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.concat(
        F.lit('{"schema":'), q(F.when(e % 50 == 0, "v0").otherwise(ev.SCHEMA)), F.lit(',"event_id":"e'), e.cast("string"),
        F.lit('","competition_id":'), q(F.col("task_id")), F.lit(',"sequence":'), F.when(e % 53 == 3, q(seq)).otherwise(seq),
        F.when(e % 54 == 4, F.lit("")).otherwise(F.concat(F.lit(',"observed_at":'), q(stamp))), F.lit(',"type":'), q(kind),
        F.lit(',"data":'), F.when(e % 52 == 2, F.lit('"none"')).otherwise(data), F.lit("}"))
    arrival = F.col("ord") + F.when(e % 10 == 3, 1500).otherwise(0)
    return (c.views.points() if points is None else points).select(arrival.alias("arrival"), value.alias("value"))


def _events(c: Race) -> DataFrame:
    return ev.split_log(event_lines(c))[0].drop("value")


def event_stream_read(c: Race) -> DataFrame:
    return ev.checked(event_lines(c)).select(big("arrival"), "competition_id", "event_id", "sequence", "type")


def event_validate(c: Race) -> DataFrame:
    return ev.checked(event_lines(c)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def event_dedupe(c: Race) -> DataFrame:
    return ev.drop_repeats(_events(c)).select("competition_id", "event_id", "sequence", "type", big("arrival"), "observed_at",
                                              F.get_json_object("data", "$.alt_gps").cast("long").alias("alt_gps"))


def sequence_guard(c: Race) -> DataFrame:
    """What the stream took in and what it refused, by competition."""
    tables, _ = _streamed(c)
    letters = tables.read("dead_letters", "value string, reason string")
    refused = letters.where("reason in ('event id already seen', 'sequence already taken')").groupBy(
        F.get_json_object("value", "$.competition_id").alias("competition_id")).agg(F.count("*").alias("refused"))
    accepted = tables.read("events", live.EVENTS).groupBy("competition_id").agg(F.count("*").alias("accepted"), F.max("sequence").alias("top"))
    return accepted.join(refused, "competition_id", "left").select(
        "competition_id", "accepted", F.coalesce("refused", F.lit(0)).cast("long").alias("refused"), "top")


def setup_state(c: Race) -> DataFrame:
    return ev.setup_state(_events(c)).select("competition_id", "type", "key", "sequence")


def position_gate(c: Race) -> DataFrame:
    events = ev.drop_repeats(_events(c))
    return ev.gate_positions(ev.positions(events), events).groupBy(
        "competition_id", F.coalesce("refused", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def position_append(c: Race) -> DataFrame:
    rows = ev.append_strict(ev.positions(ev.drop_repeats(_events(c))))
    return rows.groupBy("competition_id", "pilot_id").agg(
        F.count_if("accepted").alias("appended"), F.count_if(~F.col("accepted")).alias("refused"), F.max("t").alias("clock"))


def publish_cadence(c: Race) -> DataFrame:
    return ev.publish_points(ev.drop_repeats(_events(c)))


def snapshot_upsert(c: Race) -> DataFrame:
    snaps = _events(c).select("competition_id", (F.floor(F.col("sequence") / 5) * 5).alias("sequence"),
                              F.col("arrival").alias("id"), F.col("event_id").alias("payload"))
    return ev.snapshot_upsert(snaps, 10)


def reorder_buffer(c: Race) -> DataFrame:
    pts = c.views.points().select(*KEY, "epoch", "ord", (F.col("epoch") + F.col("ord") % 7 * 3).alias("arrived"))
    return ev.reorder(pts).select("slot", "place", *KEY, "epoch", "ord")


def dirty_task_scoring(c: Race) -> DataFrame:
    """Tasks a micro-batch made stale: new points since a snapshot that was up to date."""
    batch = _batch(c)
    state0 = _state0(c)
    state = ingest.ingest_state(state0, ingest.ingest_counts(batch, ingest.upsert_points(_stored(c), batch)))
    tasks = _scoring_tables(c)[0]
    snaps = state0.select("task_id", F.col("latest_epoch").alias("processed_epoch"), "point_count", F.lit("ok").alias("status"))
    return ingest.tasks_to_score(tasks, state, snaps).select("task_id", "point_count", "latest_epoch")


def tracking_lost(c: Race) -> DataFrame:
    return silence.lost_periods(c.s.track)


def late_recompute(c: Race) -> DataFrame:
    """Points of some pilots arrive late: only those pilots are replayed, the board equals an on-time run."""
    v = c.views
    late = F.col("pilot_id").cast("long") % 10 == 2
    scores, _ = live.rescore_touched(c.s.staged_state, v.raw_fixes().where(late & (F.col("ord") % 13 == 0)),
                                     v.raw_fixes(), v.task_rows(), v.waypoint_rows(), c.s.course, c.s.rims)
    return final_ranking(scores).select(*KEY, "rank", "state", r("distance_m", 2), r("total_points", 1))


_STREAMED: dict[tuple[str, str], tuple[live.LiveTables, DataFrame]] = {}


def _streamed(c: Race) -> tuple[live.LiveTables, DataFrame]:
    """The log as a stream of five micro-batches: its tables, and the log.  Queries of one application share it."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _STREAMED:
        root = f"{ensure_checkpoint_dir(c.spark)}/live-{uuid.uuid4().hex}"
        # written once: every part of the log and the batch side read it, on all cores
        lines = table(event_lines(c, spread(c.views.points())).withColumn("arrival", F.col("arrival").cast("long")))
        cuts = lines.selectExpr("approx_percentile(arrival, array(0.2, 0.4, 0.6, 0.8)) as q").first()["q"]
        for low, high in zip([None, *cuts], [*cuts, None]):    # two files after the other, in order of arrival
            part = lines if low is None else lines.where(F.col("arrival") > low)
            part = part if high is None else part.where(F.col("arrival") <= high)
            part.repartition(2).select("arrival", "value").write.mode("append").parquet(f"{root}/log")
        tables = live.LiveTables(c.spark, root)
        live.run_available(spread(ev.read_offset_log(c.spark, f"{root}/log", 2)), tables, f"{root}/checkpoint")
        _STREAMED[key] = tables, lines
    return _STREAMED[key]


def replay_equals_live(c: Race) -> DataFrame:
    """The log as a stream of several micro-batches and as one batch: rows on one side only."""
    tables, lines = _streamed(c)
    batch = live.batch_tables(lines)
    streamed, cols = tables.read("fixes", live.FIXES), batch.columns
    count = tables.read("events", live.EVENTS, keep_batch=True).select("batch").distinct().count()
    over = cut(live.surplus(batch, streamed.select(*cols)))
    only = lambda n, side: over.select(F.col(n).alias("n"), F.lit(side).alias("side"))
    return only("left", "batch only").unionByName(only("right", "stream only")).unionByName(
        c.spark.range(1).select(F.lit(count).cast("long").alias("n"), F.lit("micro-batches").alias("side")))


def snapshot_publish(c: Race) -> DataFrame:
    return exports.snapshots(c.s.board, c.s.task_scores, c.views.task_rows().select(
        "task_id", F.lit(25).cast("long").alias("sequence"), F.lit("open").alias("status"), F.col("deadline").alias("calculated_t")))


def results_export(c: Race) -> DataFrame:
    return exports.result_pages(c.s.board, c.s.task_scores)


def events_export(c: Race) -> DataFrame:
    from ..operators.tracks import first_reports
    v = c.views
    pilots = v.pilots().join(v.task_rows().select("task_id", "midnight"), "task_id")
    return ev.export_log(v.task_rows(), pilots, first_reports(v.raw_fixes()), 100).select("competition_id", "sequence", "type", "pilot_id", "t")


def partition_layout(c: Race) -> DataFrame:
    """Write the fixes partitioned by task, sorted by pilot and time, and read the layout back."""
    root = f"{ensure_checkpoint_dir(c.spark)}/layout-{uuid.uuid4().hex}"
    exports.write_task_partitions(c.s.track.select(*KEY, "t", "lat", "lon"), root)
    return c.spark.read.parquet(root).groupBy("task_id").agg(F.count("*").alias("fixes"), F.countDistinct("pilot_id").alias("pilots"))


QUERIES = {f.__name__: f for f in (
    event_stream_read, event_validate, event_dedupe, sequence_guard, setup_state, position_gate, position_append, publish_cadence,
    snapshot_upsert, reorder_buffer, dirty_task_scoring, tracking_lost, late_recompute, replay_equals_live, snapshot_publish,
    results_export, events_export, partition_layout)}
