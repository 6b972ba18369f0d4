"""Logger files: bulk loading, header scan, clock roll-over."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROLLOVER_S = 43200


def igc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every .igc file below ``path``; members of .zip files included."""
    loose = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[iI][gG][cC]").load(path).select("path", "content"))
    packed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("path", "content"))
    return loose.unionByName(packed.mapInPandas(unzip, "path string, content binary"))


def unzip(batches):
    """Members of zipped logger files, one row each."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    if name.lower().endswith(".igc"):
                        yield pd.DataFrame({"path": [f"{path}!{name}"], "content": [z.read(name)]})


def decode_text(content):
    """UTF-8 where the bytes are valid UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1"))


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line); a file is one recording, so its lines stay a bounded group."""
    return files.select("path", F.posexplode(F.split(decode_text(F.col("content")), "\n")).alias("line_no", "line"))


def _stem_name(path):
    base = F.element_at(F.split(path, "[/!]"), -1)
    return F.replace(F.split(base, r"\.")[0], F.lit("_"), F.lit(" "))


def _header_day(line):
    d = lambda i: F.regexp_extract(line, r"^HFDTE(?:DATE:)?(\d{2})(\d{2})(\d{2})", i)
    text = F.concat(F.lit("20"), d(3), F.lit("-"), d(2), F.lit("-"), d(1))
    return F.when(line.startswith("HFDTE"), F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def _header_pilot(line):
    name = F.btrim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    return F.when(line.startswith("HFPLT"), name)


def parse_lines(lines: DataFrame) -> DataFrame:
    """B records as fixes, with the date in force at their line and the file's pilot.

    Fixed columns; short, unlocated (V) and malformed records are skipped.  Each time
    the clock falls by more than half a day within a file a day is added.
    """
    at = Window.partitionBy("path").orderBy("line_no")
    line = F.col("line")
    whole = Window.partitionBy("path")
    rows = lines.withColumns({
        "day": F.coalesce(F.last(_header_day(line), ignorenulls=True).over(
            at.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
        "named": F.max_by(_header_pilot(line), F.when(line.startswith("HFPLT"), F.col("line_no"))).over(whole)})
    n = lambda start, size: F.substring(line, start, size).try_cast("int")
    lat = n(8, 2) + n(10, 5) / F.lit(60000.0)
    lon = n(16, 3) + n(19, 5) / F.lit(60000.0)
    fixes = rows.where(line.startswith("B") & (F.length(line) >= 35) & (F.substring(line, 25, 1) != "V")).select(
        "path", "line_no", "day", "named",
        (n(2, 2) * 3600 + n(4, 2) * 60 + n(6, 2)).cast("long").alias("secs"),
        F.when(F.substring(line, 15, 1) == "S", -lat).otherwise(lat).alias("lat"),
        F.when(F.substring(line, 24, 1) == "W", -lon).otherwise(lon).alias("lon"),
        n(26, 5).alias("alt_baro"), n(31, 5).alias("alt_gps")).where(
        "secs is not null and lat is not null and lon is not null and alt_baro is not null and alt_gps is not null")
    fell = F.when(F.col("secs") < F.lag("secs").over(at) - ROLLOVER_S, 86400).otherwise(0)
    fixes = fixes.withColumn("fell", fell).withColumn(
        "added", F.sum("fell").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return fixes.select("path", F.coalesce(F.when(F.col("named") != "", F.col("named")), _stem_name(F.col("path"))).alias("pilot"),
                        "line_no", (F.col("day") + F.col("added") + F.col("secs")).alias("t"),
                        "lat", "lon", "alt_baro", "alt_gps", (F.col("added") > 0).alias("rolled"))


def read_igc(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(file_lines(igc_files(spark, path)))


def header_lines(files: DataFrame) -> DataFrame:
    """Lines before the first fix of each file, however many; the fixes are not split."""
    whole = decode_text(F.col("content"))
    head = F.when(whole.startswith("B"), F.lit("")).otherwise(F.substring_index(whole, "\nB", 1))
    return files.select("path", F.posexplode(F.split(head, "\n")).alias("line_no", "line"))


def scan_headers(lines: DataFrame) -> DataFrame:
    """Pilot and day per file from the lines before its first B record."""
    first_b = F.min(F.when(F.col("line").startswith("B"), F.col("line_no"))).over(Window.partitionBy("path"))
    head = lines.withColumn("b", first_b).where(F.col("b").isNull() | (F.col("line_no") < F.col("b")))
    day, name = _header_day(F.col("line")), _header_pilot(F.col("line"))
    found = head.groupBy("path").agg(
        F.coalesce(F.min_by(day, F.when(day.isNotNull(), F.col("line_no"))), F.lit(0)).alias("day"),
        F.max_by(name, F.when(name.isNotNull(), F.col("line_no"))).alias("name"))
    pilot = F.coalesce(F.when(F.col("name") != "", F.col("name")), _stem_name(F.col("path")))
    return found.select("path", "day", pilot.alias("pilot"), F.lower(F.trim(pilot)).alias("pilot_key"))


def track_date_check(headers: DataFrame, task_days: DataFrame) -> DataFrame:
    """Files whose header date is not the task's date (task_days: path, midnight)."""
    return headers.join(task_days, "path").where(F.col("day") != F.col("midnight"))
