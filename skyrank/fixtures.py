"""Race views over the given tables.

Every view is plain arithmetic on ``supplier``, ``lineitem`` and ``events``, so it
grows with them, and is written once as expressions both Spark and an ANSI SQL
engine evaluate identically.  There is no window and no join in ``raw_fixes``:
a fix's clock and place are functions of its own row, so a supplier that owns a
third of ``lineitem`` costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GATE_BASE = 1749945600   # 2025-06-15 00:00 UTC

#: (column, expression) stages; each stage may use the columns of the earlier ones.
TASK_STAGES = [
    [("task_id", "concat('T', cast(task_no as string))"),
     ("variant", "task_no % 5"),
     ("midnight", f"{GATE_BASE} + 86400 * (task_no % 30)"),
     ("lat0", "42e0 + 0.5e0 * (task_no % 7)"),
     ("lon0", "1e0 + 0.4e0 * (task_no % 11)")],
    [("gate", "midnight + 43200"),
     ("gate2", "case when variant = 4 then midnight + 44100 end"),
     ("deadline", "midnight + 43200 + case when variant = 3 then 7200 else 10800 end"),
     ("start_type", "case when task_no % 10 = 9 then 'ELAPSED-TIME' else 'RACE' end"),
     ("progress_curve", "case when task_no % 10 = 8 then 'HUMP_V2A' else 'WEIGHTED' end"),
     ("goal_elevated", "variant = 2"),
     ("goal_elevation", "300e0"),
     ("nominal_distance", "50000e0"),
     ("minimum_distance", "5000e0"),
     ("nominal_time", "5400e0"),
     ("nominal_goal", "0.3e0"),
     ("nominal_launch", "0.96e0"),
     ("leading_time_ratio", "0.26e0"),
     ("ess_no_goal_time_factor", "case when variant = 2 then 0.8e0 else 0e0 end"),
     ("pilots_present", "case when task_no % 2 = 0 then 12 end")],
]

WAYPOINT_STAGES = [
    [("name", "concat('D', cast(wp_ix as string))"),
     ("declared", "case wp_ix when 0 then 'TAKEOFF' when 1 then 'SSS' when 4 then 'ESS' end"),
     ("u", "case wp_ix when 0 then 0e0 when 1 then case when variant = 1 then 1.5e0 else 0.5e0 end "
           "when 2 then 1.5e0 when 3 then 2.75e0 "
           "when 4 then case when variant = 0 then 4.5e0 else 4e0 end "
           "else case when variant = 3 then 6.5e0 else 4.5e0 end end"),
     ("radius", "case wp_ix when 0 then 400e0 when 1 then case when variant = 1 then 6000e0 else 2000e0 end "
                "when 2 then 1000e0 when 3 then case when variant = 3 then 8000e0 else 1500e0 end "
                "when 4 then case when variant = 0 then 2000e0 else 1000e0 end else 400e0 end"),
     ("alt", "900e0 + 10 * wp_ix")],
    [("lat", "lat0 + 0.12e0 * u"),
     ("lon", "lon0 + 0.01e0 * u * (u - 2.5e0) * (u - 5e0) "
             "- case when variant = 3 and wp_ix = 3 then 0.08e0 else 0e0 end")],
]

FIX_STAGES = [
    [("task_no", "cast(floor(l_suppkey / 10) as bigint)"),
     ("pilot_id", "lpad(cast(l_suppkey as string), 10, '0')"),
     ("sec", "(l_orderkey * 7919 + l_linenumber * 1009 + l_partkey * 31) % 14400 - 1800"),
     ("ord", "(l_orderkey * 8 + l_linenumber) * 100003 "
             "+ (l_partkey * 31 + cast(round(l_extendedprice * 100) as bigint)) % 100003"),
     ("rate", "4.5e0 / (5400 + 420 * ((l_suppkey * 7) % 13))"),
     ("u_land", "case when (l_suppkey * 7) % 13 < 6 then 4.6e0 "
                "else 0.8e0 + ((l_suppkey * 37) % 36) / 10e0 end")],
    [("task_id", "concat('T', cast(task_no as string))"),
     ("t", f"{GATE_BASE} + 86400 * (task_no % 30) + 43200 + sec"),
     ("saw", "0.02e0 * ((sec + 13 * l_suppkey + 6000) % 600 - 300) / 300"),
     ("climb", "rate * (sec + 1500 - 90 * (l_suppkey % 10))")],
    [("u_air", "case when l_suppkey % 20 = 8 then 0e0 "
               "when l_suppkey % 10 = 3 then climb + saw "
               "when l_suppkey % 10 = 5 and sec >= 600 then "
               "case when sec < 1000 then 0.45e0 else 0.45e0 + rate * (sec - 1000) + saw end "
               "when sec < 20 * (l_suppkey % 7) then least(climb, 0.64e0) + saw "
               "else 0.64e0 + rate * (sec - 20 * (l_suppkey % 7)) + saw end")],
    [("u", "case when l_suppkey % 10 = 7 and sec > 9600 then 4.5e0 "
           "else greatest(0e0, least(u_air, u_land)) end")],
    [("lat", "42e0 + 0.5e0 * (task_no % 7) + 0.12e0 * u + (l_quantity - 25.5e0) * 2e-6"),
     ("lon", "1e0 + 0.4e0 * (task_no % 11) + 0.01e0 * u * (u - 2.5e0) * (u - 5e0) "
             "+ (l_linenumber - 4) * 2e-6"),
     ("alt_gps", "case when u = 0e0 or u = u_land then 500 + l_linenumber "
                 "else 700 + 25 * cast(l_quantity as int) end")],
    [("alt_baro", "alt_gps - 30 + l_linenumber")],
]
FIX_COLUMNS = ["task_id", "pilot_id", "ord", "t", "lat", "lon", "alt_baro", "alt_gps"]

PILOT_STAGES = [
    [("task_id", "concat('T', cast(cast(floor(s_suppkey / 10) as bigint) as string))"),
     ("pilot_id", "lpad(cast(s_suppkey as string), 10, '0')"),
     ("name", "s_name")],
    [("source_file", "concat('tracks/', pilot_id, '.igc')")],
]

PENALTY_STAGES = [
    [("task_id", "concat('T', cast(cast(floor(s_suppkey / 10) as bigint) as string))"),
     ("ord", "s_suppkey"),
     ("pilot_key", "case s_suppkey % 20 when 4 then cast(s_suppkey as string) "
                   "when 11 then concat(' ', s_name) "
                   "when 12 then concat('#', lpad(cast(s_suppkey as string), 9, '0')) "
                   "when 15 then 'plier#0' "
                   "when 17 then concat('nobody-', cast(s_suppkey as string)) "
                   "when 5 then lpad(cast(s_suppkey - 1 as string), 10, '0') end"),
     ("reason", "concat('report ', cast(s_suppkey as string))"),
     ("percent_own", "case when s_suppkey % 20 in (4, 12) then 10e0 else 0e0 end"),
     ("percent_task", "case when s_suppkey % 20 = 11 then 5e0 else 0e0 end"),
     ("points", "case when s_suppkey % 20 in (5, 12) then 25e0 else 0e0 end")],
]
PENALTY_COLUMNS = ["task_id", "ord", "pilot_key", "reason", "percent_own", "percent_task", "points"]

POINT_STAGES = [
    [("task_id", "concat('E', cast(cast(floor(user_id / 30) as bigint) as string))"),
     ("pilot_id", "concat('u', cast(user_id as string))"),
     ("batch_id", "cast(floor(event_id / 500) as bigint)"),
     ("ord", "event_id"),
     ("lat", "40e0 + value / 100"),
     ("lon", "1e0 + value / 200"),
     ("alt_gps", "case when event_id % 11 = 0 then null else cast(floor(value) as double) + 500 end"),
     ("alt_baro", "case when event_id % 13 = 0 then null else cast(floor(value) as double) + 480 end"),
     ("source", "event_type"),
     ("raw", "props")],
]


def apply_stages(df: DataFrame, stages: list[list[tuple[str, str]]]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{expr} as {name}" for name, expr in stage])
    return df


def stages_sql(source: str, stages: list[list[tuple[str, str]]]) -> str:
    """The same stages as nested ANSI SQL, for checking against another engine."""
    sql = f"select * from {source}"
    for stage in stages:
        sql = ("select *, " + ", ".join(f"{e} as {n}" for n, e in stage) + f" from ({sql})")
    return sql


class Views:
    """The race views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def task_rows(self) -> DataFrame:
        """Task definitions with their scoring parameters, one per ten suppliers."""
        keys = self.table("supplier").selectExpr(
            "cast(floor(s_suppkey / 10) as bigint) as task_no").distinct()
        return apply_stages(keys, TASK_STAGES).withColumn(
            "gates", F.array_compact(F.array("gate", "gate2")))

    def waypoint_rows(self) -> DataFrame:
        rows = self.task_rows().select(
            "task_id", "variant", "lat0", "lon0",
            F.explode(F.sequence(F.lit(0), F.lit(5))).alias("wp_ix"))
        return apply_stages(rows, WAYPOINT_STAGES).select(
            "task_id", "wp_ix", "name", "declared", "lat", "lon", "radius", "alt")

    def raw_fixes(self) -> DataFrame:
        """Position reports as received: unordered, with repeats of a pilot's second."""
        return apply_stages(self.table("lineitem"), FIX_STAGES).select(*FIX_COLUMNS)

    def pilots(self) -> DataFrame:
        return apply_stages(self.table("supplier"), PILOT_STAGES).select(
            "task_id", "pilot_id", "name", "source_file")

    def penalties(self) -> DataFrame:
        return apply_stages(self.table("supplier"), PENALTY_STAGES).select(
            *PENALTY_COLUMNS).where("pilot_key is not null")

    def points(self) -> DataFrame:
        """Received point batches, with every seventh event sent twice."""
        base = apply_stages(self.table("events"), POINT_STAGES).withColumn(
            "epoch", F.unix_timestamp("ts")).select(
            "task_id", "pilot_id", "batch_id", "ord", "epoch", "lat", "lon",
            "alt_gps", "alt_baro", "source", "raw", "event_id")
        again = base.where("event_id % 7 = 0").withColumns({
            "ord": F.col("ord") + 1000000000, "alt_gps": F.lit(777.0),
            "alt_baro": F.lit(None).cast("double")})
        return base.unionByName(again)
