"""The canonical event stream: envelope checks, repeats, order, set-up and positions.

Every step is a DataFrame transformation that works on a whole log and on the rows of
one micro-batch alike; only maxima per key are carried from batch to batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import spread_running_max, spread_row_number

# Fixed values of the event contract.
SCHEMA = "live-scoring.v1"
TYPES = ["competition.upsert", "task.upsert", "pilot.upsert", "position", "competition.status"]
REQUIRED = ["schema", "event_id", "competition_id", "sequence", "observed_at", "type", "data"]
ENVELOPE = ("struct<schema:string,event_id:string,competition_id:string,sequence:bigint,observed_at:string,"
            "type:string,data:string>")
POSITION = "struct<pilot_id:string,timestamp:bigint,lat:double,lon:double,alt_gps:int,alt_baro:int>"
ROWS_PER_BUCKET = 1_000_000


def read_log(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Tail a folder of JSON-lines files; the checkpoint remembers what was read.

    Lines of plain text have no offsets of their own; those of one file arrive together.
    """
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select(
        "value", F.unix_millis("_metadata.file_modification_time").alias("arrival"))


def read_offset_log(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Tail a folder of (arrival, value) files, where ``arrival`` is the line's offset in the log."""
    return spark.readStream.schema("arrival bigint, value string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def checked(lines: DataFrame) -> DataFrame:
    """Envelope fields of each line and ``reason``: null for a canonical event."""
    e = F.from_json("value", ENVELOPE)
    rows = lines.withColumns({"e": e, "keys": F.json_object_keys("value")})
    missing = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), "keys")
    data_keys = F.json_object_keys("e.data")
    reason = (F.when(F.col("keys").isNull(), "not an object")
              .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
              .when(~F.col("e.schema").eqNullSafe(SCHEMA), "schema")
              .when(~F.coalesce(F.col("e.type").isin(*TYPES), F.lit(False)), "type")
              .when(data_keys.isNull(), "data is not an object")
              .when(F.col("e.sequence").isNull(), "sequence is not an integer"))
    keep = [c for c in lines.columns]
    return rows.withColumn("reason", reason).select(*keep, "e.*", "reason")


def split_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical events, dead letters)."""
    rows = checked(lines)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("value", "reason")


#: What decides between events that claim the same id or sequence: the first to arrive, then the lesser line.
ORDER = ["arrival", "sequence", "observed_at", "type", "data"]


def drop_repeats(events: DataFrame) -> DataFrame:
    """First event per id, by arrival: a keyed aggregate."""
    rest = [c for c in events.columns if c not in ("competition_id", "event_id", *ORDER)]
    return events.groupBy("competition_id", "event_id").agg(F.min(F.struct(*ORDER, *rest)).alias("f")).select(
        "competition_id", "event_id", *[F.col(f"f.{c}").alias(c) for c in (*ORDER, *rest)])


def first_of_sequence(events: DataFrame) -> DataFrame:
    """(competition_id, sequence, event_id): the event a sequence belongs to, by arrival."""
    return events.groupBy("competition_id", "sequence").agg(F.min_by("event_id", F.struct(*ORDER, "event_id")).alias("event_id"))


REMEMBERED = "value string, arrival bigint, " + ENVELOPE[7:-1].replace(":", " ").replace(",", ", ") + ", reason string, repeated boolean"


#: Groups the event ids are dealt to.  A Python call marks all lines of a group, so their number does not grow with the log.
ID_GROUPS = 1024


def _remember(ttl_s: int):
    """The state of a group of event ids: each id with its last arrival, forgotten ``ttl_s`` after that."""

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(ORDER, kind="stable")
        now = int(rows["heard"].max().timestamp() * 1000)
        known = {i: t for i, t in zip(*state.get) if t + ttl_s * 1000 > now} if state.exists else {}
        named = rows["id"].notna()
        rows["repeated"] = named & (rows["id"].isin(known.keys()) | rows["id"].duplicated())
        known.update(dict.fromkeys(rows["id"][named], now))
        if known:
            state.update((list(known), list(known.values())))
            state.setTimeoutTimestamp(max(max(known.values()), state.getCurrentWatermarkMs()) + ttl_s * 1000)
        yield rows[[c.split()[0] for c in REMEMBERED.split(", ")]]

    return step


def remember_ids(lines: DataFrame, ttl_s: int = 86_400) -> DataFrame:
    """A stream of lines, checked, with ``repeated`` set where an event id was met in this batch or an earlier one.

    Ids live in keyed state, dealt to :data:`ID_GROUPS` groups, in the checkpoint; the clock that forgets them is that
    of arrival, so no event is ever too late.  A malformed line has no id and leaves no state.
    """
    competition, event = F.coalesce("competition_id", F.lit("")), F.coalesce("event_id", F.lit(""))
    good = F.col("reason").isNull()
    rows = checked(lines).withColumns({
        "id": F.when(good, F.concat(F.length(competition).cast("string"), F.lit(":"), competition, event)),
        "heard": F.current_timestamp()})
    rows = rows.withColumns({
        # a null would turn the whole numbers of other lines into doubles in pandas
        "sequence": F.coalesce("sequence", F.lit(0)),
        "id_group": F.pmod(F.xxhash64(F.coalesce("id", "value")), F.lit(ID_GROUPS))})
    return rows.withWatermark("heard", "1 second").groupBy("id_group").applyInPandasWithState(
        _remember(ttl_s), REMEMBERED, "ids array<string>, heard array<bigint>", "append", "EventTimeTimeout")


TAKEN = "competition_id string, low bigint, high bigint"


def guard_batch(events: DataFrame, taken: DataFrame) -> DataFrame:
    """Mark one micro-batch: a sequence belongs to the first event that has it, whenever it arrives.

    ``taken`` holds the sequences of earlier batches as ranges.  A late event is accepted; what comes a
    second time, in the batch or after it, is not.
    """
    first = first_of_sequence(events).withColumnRenamed("event_id", "first_id")
    ranges = taken.groupBy("competition_id").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    rows = events.join(first, ["competition_id", "sequence"]).join(ranges, "competition_id", "left")
    again = F.coalesce(F.exists("ranges", lambda r: F.col("sequence").between(r["low"], r["high"])), F.lit(False))
    return rows.withColumn("accepted", ~again & (F.col("event_id") == F.col("first_id"))).drop("first_id", "ranges")


def taken_after(taken: DataFrame, accepted: DataFrame) -> DataFrame:
    """Ranges of taken sequences with those of a batch, neighbours put together."""
    new = accepted.select("competition_id", F.col("sequence").alias("low"), F.col("sequence").alias("high"))
    from pyspark.sql import Window
    order = Window.partitionBy("competition_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = taken.unionByName(new).withColumn("fresh", F.coalesce(F.col("low") > reach + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("competition_id", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


KNOWN = "competition_id string, kind string, pilot_id string, known_at bigint"


def known_after(known: DataFrame, accepted: DataFrame) -> DataFrame:
    """The first sequence of every pilot, task and parameter set, one row per key."""
    new = accepted.where(F.col("type").isin("pilot.upsert", "task.upsert", "competition.upsert")).select(
        "competition_id", F.col("type").alias("kind"), F.when(
            F.col("type") == "pilot.upsert", F.get_json_object("data", "$.pilot_id")).alias("pilot_id"),
        F.col("sequence").alias("known_at"))
    return known.unionByName(new).groupBy("competition_id", "kind", "pilot_id").agg(F.min("known_at").alias("known_at"))


def setup_state(events: DataFrame) -> DataFrame:
    """Latest competition, task, pilot and status document per key."""
    rows = events.where("type <> 'position'").withColumn("key", F.when(
        F.col("type") == "pilot.upsert", F.get_json_object("data", "$.pilot_id")).otherwise(F.lit("")))
    return rows.groupBy("competition_id", "type", "key").agg(
        F.max("sequence").alias("sequence"), F.max_by("data", "sequence").alias("data"))


def positions(events: DataFrame) -> DataFrame:
    p = F.from_json("data", POSITION)
    return events.where("type = 'position'").withColumn("p", p).select(
        "competition_id", "sequence", F.col("p.pilot_id").alias("pilot_id"), F.col("p.timestamp").alias("t"), "p.lat", "p.lon",
        F.coalesce("p.alt_gps", F.lit(0)).alias("alt_gps"), F.coalesce("p.alt_baro", F.lit(0)).alias("alt_baro"))


def gate_positions(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``refused``: null, unknown pilot, or before task and parameters exist, as of each sequence."""
    none = events.sparkSession.createDataFrame([], KNOWN)
    return gate_known(rows, known_after(none, events))


def gate_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same by what is ``known``, see :func:`known_after`."""
    pilots = known.where("kind = 'pilot.upsert'").select("competition_id", "pilot_id", "known_at")
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("known_at")))
    setup = known.groupBy("competition_id").agg(at("task.upsert").alias("task_at"), at("competition.upsert").alias("params_at"))
    joined = rows.join(pilots, ["competition_id", "pilot_id"], "left").join(setup, "competition_id", "left")
    late = lambda c: F.coalesce(F.col(c) > F.col("sequence"), F.lit(True))
    return joined.withColumn("refused", F.when(late("known_at"), "unknown pilot").when(
        late("task_at") | late("params_at"), "before setup")).drop("known_at", "task_at", "params_at")


def append_strict(rows: DataFrame) -> DataFrame:
    """``accepted`` where a pilot's clock rises strictly; ``now`` is the competition's latest time."""
    per = ["competition_id", "pilot_id"]
    out = spread_running_max(rows, per, F.floor(F.col("sequence") / ROWS_PER_BUCKET), [F.col("sequence")], F.col("t"), "last_t")
    return out.withColumn("accepted", F.col("last_t").isNull() | (F.col("t") > F.col("last_t"))).drop("last_t")


def publish_points(events: DataFrame, every: int = 25) -> DataFrame:
    """Sequences at which a snapshot is due: each N-th event and every status change."""
    return events.where((F.col("sequence") % every == 0) | (F.col("type") == "competition.status")).select(
        "competition_id", "sequence", (F.col("type") == "competition.status").alias("on_status"))


def due_snapshots(events: DataFrame, every: int = 25) -> DataFrame:
    """(competition_id, sequence, status) of the competitions for which a batch of events makes a snapshot due.

    It stands for the last sequence at which one was due; ``status`` is that of the last status event, null without one.
    """
    named = F.when(F.col("type") == "competition.status", F.get_json_object("data", "$.status"))
    due = (F.col("sequence") % every == 0) | (F.col("type") == "competition.status")
    return events.where(due).withColumn("named", named).groupBy("competition_id").agg(
        F.max("sequence").alias("sequence"), F.max_by("named", F.when(F.col("named").isNotNull(), F.col("sequence"))).alias("status"))


def snapshot_upsert(snapshots: DataFrame, history: int = 10) -> DataFrame:
    """One payload per (competition, sequence), last write wins; ``place`` 1 is the latest, N kept."""
    one = snapshots.groupBy("competition_id", "sequence").agg(F.max_by("payload", "id").alias("payload"))
    ranked = spread_row_number(one, ["competition_id"], [-F.floor(F.col("sequence") / 1000)], [F.col("sequence").desc()], "place")
    return ranked.where(F.col("place") <= history)


def reorder(points: DataFrame, hold_s: int = 10) -> DataFrame:
    """Release points in slots of the hold time, sorted by pilot and time inside a slot."""
    rows = points.withColumn("slot", F.floor(F.col("arrived") / hold_s))
    return spread_row_number(rows, ["slot"], [F.substring("pilot_id", 1, 3)], [F.col("pilot_id"), F.col("epoch"), F.col("ord")], "place")


def export_log(tasks: DataFrame, pilots: DataFrame, fixes: DataFrame, last_sequence: int = 0) -> DataFrame:
    """Tables as an ordered canonical log: set-up, pilots, positions by (time, pilot), final status.

    ``last_sequence`` continues an existing log.
    """
    none = F.lit(None)
    base = lambda d, rank, kind, pilot, t, data: d.select(
        F.col("task_id").alias("competition_id"), F.lit(rank).alias("kind_rank"), F.lit(kind).alias("type"),
        pilot.cast("string").alias("pilot_id"), t.cast("long").alias("t"), F.to_json(data).alias("data"))
    day = F.col("midnight")
    last = fixes.groupBy("task_id").agg(F.max("t").alias("end_t"))
    rows = base(tasks, 0, TYPES[0], none, day, F.struct(F.struct("nominal_distance", "minimum_distance", "nominal_time").alias("config"))).unionByName(
        base(tasks, 1, TYPES[1], none, day, F.struct(F.col("task_id").alias("name"), day.alias("date_epoch")))).unionByName(
        base(pilots, 2, TYPES[2], F.col("pilot_id"), day, F.struct("pilot_id", "name"))).unionByName(
        base(fixes, 3, TYPES[3], F.col("pilot_id"), F.col("t"), F.struct(
            "pilot_id", F.col("t").alias("timestamp"), "lat", "lon", "alt_gps", "alt_baro"))).unionByName(
        base(last, 4, TYPES[4], none, F.col("end_t"), F.struct(F.lit("final").alias("status"))))
    numbered = spread_row_number(rows, ["competition_id"], [F.col("kind_rank"), F.floor(F.col("t") / 600)],
                                 [F.col("kind_rank"), F.col("t"), F.col("pilot_id")], "n")
    return numbered.withColumn("sequence", F.col("n") + last_sequence).drop("n", "kind_rank")


def envelope(log: DataFrame) -> DataFrame:
    """Log rows as JSON lines in the canonical envelope."""
    stamp = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.concat_ws("-", "competition_id", "sequence").alias("event_id"),
                              "competition_id", "sequence", stamp.alias("observed_at"), "type"))
    return log.select("competition_id", "sequence", F.concat(
        F.regexp_replace(head, r"\}$", ""), F.lit(',"data":'), "data", F.lit("}")).alias("value"))
