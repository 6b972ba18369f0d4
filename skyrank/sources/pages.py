"""Result pages: leaderboards, scoring parameters and task configuration from HTML.

A page is cut into table rows of plain-text cells, and into blocks of plain text.  What a
cell means comes from the layout tables below; what a clock means from the label before it in
its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of the published pages.
PARAMETERS = {"Nominal distance": "nominal_distance_km", "Minimum distance": "minimum_distance_km",
              "Nominal time": "nominal_time_min", "Leading-time ratio": "leading_time_ratio"}
KINDS = {"TOFF": "TAKEOFF", "SSS": "SSS", "TURN": "TURNPOINT", "ESS": "ESS", "GOAL": "GOAL"}
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
#: Columns of a leaderboard row: place, name, type.
BOARD = [(0, "rank", "long"), (1, "pilot_id", "text"), (2, "name", "text"), (8, "distance_km", "number"), (9, "sss", "text"),
         (10, "ess", "text"), (11, "time", "text"), (12, "speed_kmh", "number"), (13, "status", "text"),
         (14, "height_m", "number"), (15, "distance_points", "number"), (16, "leading_points", "number"),
         (17, "time_points", "number")]
BOARD_CLASS, BOARD_CELLS = "result", 4
#: Columns of a turnpoint row, counted from the cell that has the kind.
TURNPOINT = {"name": 2, "radius_km": 3, "lat": 4, "lon": 5}
GATE_LABEL, DEADLINE_LABEL = "startgate", "task deadline"
DEFAULT_GATE, DEFAULT_DEADLINE = "11:00", "17:00"

BLOCKS = "p|div|tr|table|h[1-6]|li|ul|ol|body"


def text(html: Column) -> Column:
    """Visible text of a fragment."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def in_tag(rest: Column) -> Column:
    """Visible text of a fragment that starts inside a tag."""
    return text(F.concat(F.lit("<x"), rest))


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, n, marks, c): every table row with the attributes of its tag and its cells as text."""
    rest = lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    rows = pages.select("page_id", F.posexplode(rest(F.split("html", r"(?i)<tr(?=[\s>])"))).alias("n", "row"))
    body = F.element_at(F.split("row", "(?i)</tr", 2), 1)
    inner = F.split(body, r"(?i)<t[dh](?=[\s>])")
    cell = lambda p: in_tag(F.element_at(F.split(p, "(?i)</t[dh]", 2), 1))
    return rows.select("page_id", "n", F.element_at(F.split("row", ">", 2), 1).alias("marks"), F.transform(
        rest(inner), cell).alias("c"))


def number(cell: Column) -> Column:
    """A published number; a decimal comma is a point, a dash is nothing."""
    return F.replace(F.trim(cell), F.lit(","), F.lit(".")).try_cast("double")


def leaderboard(pages: DataFrame) -> DataFrame:
    """Published rows of each page; the score is the last number of a row."""
    kinds = {"long": lambda c: c.try_cast("long"), "text": F.trim, "number": number}
    rows = table_rows(pages).where(
        (F.size("c") >= BOARD_CELLS) & F.lower("marks").rlike(rf"class\s*=\s*[\"']?{BOARD_CLASS}\b"))
    score = F.try_element_at(F.array_compact(F.transform("c", number)), F.lit(-1))
    return rows.select("page_id", score.alias("score"), *[
        kinds[kind](F.get("c", F.lit(place))).alias(name) for place, name, kind in BOARD]).where(
        (F.col("rank") >= 0) & (F.col("pilot_id") != "") & F.col("score").isNotNull())


def parameters(pages: DataFrame) -> DataFrame:
    """Labelled GAP parameters, one row per page and key; the last one given counts, a ratio above 1 is a percentage."""
    known = F.create_map(*[F.lit(x) for pair in PARAMETERS.items() for x in pair])
    given = table_rows(pages).select(
        "page_id", "n", F.try_element_at(known, F.get("c", F.lit(0))).alias("key"), number(F.get("c", F.lit(1))).alias("v"))
    last = given.where("key is not null and v is not null").groupBy("page_id", "key").agg(
        F.max(F.struct("n", "v"))["v"].alias("v"))
    percent = (F.col("key") == "leading_time_ratio") & (F.col("v") > 1)
    return last.select("page_id", "key", F.when(percent, F.col("v") / 100).otherwise(F.col("v")).alias("value"))


def text_blocks(html: Column) -> Column:
    """The page as plain text, a paragraph, row or heading each."""
    return F.filter(F.transform(F.split(html, rf"(?i)</?({BLOCKS})(?=[\s>])"), 
                                lambda b, i: F.when(i == 0, text(b)).otherwise(in_tag(b))), lambda b: b != "")


def labelled_clock(blocks: Column, label: str) -> Column:
    """The first clock after a label in the label's own block, or null."""
    after = F.transform(F.filter(blocks, lambda b: F.contains(F.lower(b), F.lit(label))), lambda b: F.regexp_extract(
        F.substring(b, F.locate(label, F.lower(b)) + len(label), F.length(b)), r"\b(\d{1,2}:\d\d)\b", 1))
    return F.get(F.filter(after, lambda clock: clock != ""), F.lit(0))


def page_date(html: Column) -> Column:
    """The date that a third-level heading consists of, else the last one on the page."""
    day = r"20\d\d-\d\d-\d\d"
    heads = F.transform(F.split(html, r"(?i)<h3(?=[\s>])"), lambda p: in_tag(F.element_at(F.split(p, "</", 2), 1)))
    alone = F.filter(heads, lambda head, i: (i > 0) & head.rlike(f"^{day}$"))
    return F.coalesce(F.get(alone, F.lit(0)), F.try_element_at(F.regexp_extract_all(html, F.lit(f"({day})"), 1), F.lit(-1)))


def task_config(pages: DataFrame, timezone: str) -> tuple[DataFrame, DataFrame]:
    """(task date and UTC clocks, turnpoints) of each page that shows at least two turnpoints.

    Clocks are local time.  A page without a clock gets the usual one, and ``gate_given`` or
    ``deadline_given`` says so.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    place = F.transform("c", lambda cell: cell.isin(*KINDS))
    at = F.array_position(place, F.lit(True)) - 1
    cell = {name: F.get("c", (F.col("at") + offset).cast("int")) for name, offset in TURNPOINT.items()}
    points = table_rows(pages).withColumn("at", at).where("at >= 0").select(
        "page_id", F.col("n").alias("i"), F.try_element_at(kinds, F.get("c", F.col("at").cast("int"))).alias("kind"),
        cell["name"].alias("name"), (number(cell["radius_km"]) * 1000).alias("radius_m"),
        number(cell["lat"]).alias("lat"), number(cell["lon"]).alias("lon")).where(
        "radius_m is not null and lat is not null and lon is not null")
    enough = points.groupBy("page_id").agg(F.count("*").alias("turnpoints")).where("turnpoints >= 2")
    blocks = text_blocks(F.col("html"))
    found = pages.join(enough, "page_id").select(
        "page_id", "turnpoints", page_date(F.col("html")).alias("task_date"),
        labelled_clock(blocks, GATE_LABEL).alias("g"), labelled_clock(blocks, DEADLINE_LABEL).alias("d"))
    utc = lambda clock: F.date_format(F.to_utc_timestamp(F.try_to_timestamp(
        F.concat_ws(" ", "task_date", clock), F.lit("yyyy-MM-dd H:mm")), timezone), "HH:mm")
    tasks = found.select(
        "page_id", "task_date", F.coalesce("g", F.lit(DEFAULT_GATE)).alias("gate"),
        F.coalesce("d", F.lit(DEFAULT_DEADLINE)).alias("deadline"), F.col("g").isNotNull().alias("gate_given"),
        F.col("d").isNotNull().alias("deadline_given"), "turnpoints").withColumns(
        {"gate_utc": utc("gate"), "deadline_utc": utc("deadline")})
    return tasks, points.join(enough.select("page_id"), "page_id", "left_semi")
