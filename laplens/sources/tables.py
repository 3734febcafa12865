"""Tables, sheets, JSON records, report grids and pasted lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laplens.functions.text import headers, lap_seconds, lenient_double, lenient_long, settled

# Labels that mark a session column in row 7 of a report.
SESSION_LABELS = ["FP", "FP1", "QP", "SP", "WUP", "WUP1", "WUP2", "RACE1", "RACE2", "RACE", "TEST"]
# Cells (column, row) of a report's head and of its base setup.
REPORT_HEAD = {"rider": ("B", 1), "circuit": ("H", 2), "round_id": ("H", 3), "session_date": ("D", 4), "bike_model": ("H", 4)}
REPORT_SETUP = {"fork_type": 11, "f_spring": 14, "f_preload": 15, "f_comp": 17, "f_reb": 18, "shock_type": 21,
                "r_spring": 23, "r_preload": 24, "r_comp": 25, "r_reb": 26, "ride_height": 30, "swing_arm": 31}
LAP_ROWS = (38, 79)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None,
         order: list[Column] | None = None, fmt: str = "parquet") -> DataFrame:
    """Stored table with the filter and the columns pushed to the files."""
    df = spark.read.format(fmt).load(path)
    if where:
        df = df.filter(where)
    if columns:
        df = df.select(*columns)
    return df.orderBy(*order) if order else df


def read_records(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """JSON records; the schema keeps dates as text. One record per line can be split over tasks, files
    holding one JSON array (``whole_files``) cannot."""
    return spark.read.schema(schema).json(path, multiLine=whole_files)


def read_sheet(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """Exported sheet whose header is on line ``header_row``; title lines above it are left out,
    repeated or empty headers are renamed, empty rows dropped. All columns are text."""
    raw = spark.read.csv(path, header=False, multiLine=False)
    names = headers(list(raw.take(header_row)[-1]))
    # Title lines go by their place: the first ones of the first piece of each file, where rows are numbered in file order.
    placed = raw.toDF(*[f"_c{i}" for i in range(len(names))]).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    first = placed.filter("_at = 0").groupBy("_file").agg(F.min("_row").alias("_first"))
    title = (F.col("_at") == 0) & (F.col("_row") < F.col("_first") + header_row)
    body = placed.join(first, "_file", "left").filter(~F.coalesce(title, F.lit(False)))
    return body.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)]).na.drop("all")


def run_log(df: DataFrame, run_col: str) -> DataFrame:
    """Run log rows whose run number reads as a number, as a whole number."""
    return df.withColumn(run_col, lenient_long(F.col(run_col))).filter(F.col(run_col).isNotNull())


def report_head(cells: DataFrame) -> DataFrame:
    """Head and base setup of every sheet from its fixed cells; only those cells are grouped."""
    spots = {n: (r, ord(c) - ord("A") + 1) for n, (c, r) in REPORT_HEAD.items()}
    spots.update({n: (r, ord("D") - ord("A") + 1) for n, r in REPORT_SETUP.items()})
    wanted = cells.filter(F.col("row").isin(sorted({r for r, _ in spots.values()})) & F.col("col").isin(sorted({c for _, c in spots.values()})))
    out = wanted.groupBy("file", "sheet").agg(*[
        F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.trim("value"))).alias(n) for n, (r, c) in spots.items()])
    return (out.withColumns({"circuit": F.upper("circuit"), "round_id": F.upper("round_id")})
            .filter(F.coalesce("rider", F.lit("")) != "").filter(F.coalesce("circuit", F.lit("")) != ""))


def report_sessions(cells: DataFrame) -> DataFrame:
    """One row per sheet and session column that has a lap total; the air temperature stands one column right."""
    pick = lambda row: F.max(F.when(F.col("row") == row, F.trim("value")))
    texts = cells.filter(F.col("row").isin(7, 9, 32, 34, 36, 37)).groupBy("file", "sheet", "col").agg(
        F.upper(pick(7)).alias("session_type"), pick(9).alias("_t9"), pick(32).alias("f_tyre"), pick(34).alias("r_tyre"),
        pick(36).alias("_n"), pick(37).alias("_best"))
    right = texts.filter("_t9 is not null").select("file", "sheet", (F.col("col") - 1).alias("col"), F.col("_t9").alias("_air"))
    labelled = texts.filter(F.col("session_type").isin(SESSION_LABELS)).groupBy("file", "sheet", "session_type").agg(
        F.max("col").alias("col"), *[F.max_by(c, "col").alias(c) for c in ("_t9", "f_tyre", "r_tyre", "_n", "_best")])
    found = labelled.join(right, ["file", "sheet", "col"], "left").select(
        "file", "sheet", "col", "session_type", lenient_double(F.col("_t9"), True).alias("track_temp"),
        lenient_double(F.col("_air"), True).alias("air_temp"), "f_tyre", "r_tyre", lenient_long(F.col("_n")).alias("total_laps"),
        lap_seconds(F.col("_best")).alias("best_lap_s"))
    return found.filter(F.coalesce("total_laps", F.lit(0)) > 0).join(report_head(cells), ["file", "sheet"])


def lap_cells(cells: DataFrame, sessions: DataFrame, lap_rows: tuple[int, int]) -> DataFrame:
    """Filled cells from the first lap row on, with the row of the first empty cell below it (``_stop``)."""
    lo, hi = lap_rows
    laps = cells.filter((F.col("row") >= lo) & F.col("value").isNotNull())
    # a column has hi-lo+1 lap rows, so its list of filled rows is short
    rows = laps.filter(F.col("row") <= hi).groupBy("file", "sheet", "col").agg(F.collect_set("row").alias("_rows"))
    full = F.sequence(F.lit(lo), F.lit(hi + 1)).cast("array<int>")
    stops = rows.select("file", "sheet", "col", F.array_min(F.array_except(full, "_rows")).alias("_stop"))
    keep = sessions.select("file", "sheet", "col", *[c for c in ("rider", "rider_num", "circuit", "round_id", "session_type") if c in sessions.columns])
    placed = laps.join(stops, ["file", "sheet", "col"], "left").withColumn("_stop", F.coalesce("_stop", F.lit(lo))).join(keep, ["file", "sheet", "col"])
    return settled(placed, lap_no=(F.col("row") - (lo - 1)).cast("long"), lap_time=lap_seconds(F.col("value")))


def report_laps(cells: DataFrame, sessions: DataFrame, lap_rows: tuple[int, int] = LAP_ROWS) -> DataFrame:
    """Lap cells under each session column down to the first empty one, within ``lap_rows``."""
    rows = lap_cells(cells, sessions, lap_rows).filter((F.col("row") < F.col("_stop")) & F.col("lap_time").isNotNull())
    return rows.select("file", "sheet", "rider", "circuit", "round_id", "session_type", "lap_no", "lap_time")


def rejected_laps(cells: DataFrame, sessions: DataFrame, lap_rows: tuple[int, int] = LAP_ROWS) -> DataFrame:
    """The lap cells that :func:`report_laps` leaves out, with the reason."""
    reason = (F.when(F.col("row") > lap_rows[1], "past the last lap row").when(F.col("lap_time").isNull(), "unreadable time")
              .when(F.col("row") >= F.col("_stop"), "below an empty cell"))
    return (lap_cells(cells, sessions, lap_rows).withColumn("reason", reason).filter("reason is not null")
            .select("file", "sheet", "session_type", "lap_no", "value", "reason"))


def pasted_laps(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """``round, circuit, session, rider_num, lap_no, lap_time[, speed]`` lines: (good rows, rejected lines)."""
    field = lambda i: F.trim(F.get("_f", F.lit(i)))
    parsed = settled(settled(lines, _f=F.split(text, ",")), **{
        "round_id": F.upper(field(0)), "circuit": F.upper(field(1)), "session_type": F.upper(field(2)),
        "rider_num": lenient_long(field(3)), "lap_no": lenient_long(field(4)), "lap_time": lap_seconds(field(5)),
        "speed": lenient_double(field(6))})
    ok = (F.size("_f") >= 6) & F.col("rider_num").isNotNull() & F.col("lap_no").isNotNull() & F.col("lap_time").isNotNull()
    reason = F.when(F.size("_f") < 6, "too few fields").otherwise("unreadable number")
    good = parsed.filter(ok).drop(text, "_f")
    return good, parsed.filter(~F.coalesce(ok, F.lit(False))).select(*lines.columns, reason.alias("reason"))
