"""CSV, TSV and JSON files of the pipeline: readers with fixed schemas, and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonspark import schemas


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """date, demand, floortables; the file's columns may stand in any order."""
    names = spark.read.option("header", True).csv(path).columns
    kinds = dict(x.strip().split(" ") for x in schemas.DAILY.split(","))
    found = _csv(spark, path, ", ".join(f"{n} {kinds.get(n.strip(), 'string')}" for n in names))
    return found.select("date", "demand", "floortables")


def read_storms(spark: SparkSession, path: str) -> DataFrame:
    """Storm days; a file that isn't there means none. Any other fault is raised."""
    try:
        return _csv(spark, path, schemas.STORMS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.STORMS)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.HOURLY)


def read_workdays(spark: SparkSession, path: str) -> DataFrame:
    """date, is_workday of a real calendar."""
    return _csv(spark, path, schemas.WORKDAYS)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that write_csv wrote, by the columns that schema names."""
    kinds = dict(x.strip().split(" ") for x in schema.split(","))
    found = spark.read.option("header", True).csv(path)
    return found.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def read_reservations(spark: SparkSession, path: str) -> DataFrame:
    """update_date, inhouse_date, rooms_otb, from either format; a missing or unusable file means no rows.

    With rooms_otb the last row of a pair of dates counts (by input order), values that aren't
    numbers are dropped; with patron_id the rows of a pair are counted.
    """
    empty = spark.createDataFrame([], "update_date date, inhouse_date date, rooms_otb double")
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return empty
    if not {"update_date", "inhouse_date"} <= set(raw.columns):
        return empty
    dates = [F.expr(f"try_cast({c} AS date)").alias(c) for c in ("update_date", "inhouse_date")]
    if "patron_id" in raw.columns and "rooms_otb" not in raw.columns:
        return raw.select(*dates).na.drop().groupBy("update_date", "inhouse_date").agg(F.count("*").cast("double").alias("rooms_otb"))
    if "rooms_otb" not in raw.columns:
        return empty
    rows = raw.select(*dates, F.expr("try_cast(rooms_otb AS double)").alias("rooms_otb"), F.monotonically_increasing_id().alias("seq")).na.drop()
    return rows.groupBy("update_date", "inhouse_date").agg(F.max_by("rooms_otb", "seq").alias("rooms_otb"))


def read_reservations_strict(spark: SparkSession, path: str) -> DataFrame:
    """The same without repairs: a missing file means no rows, but a missing column or a value that is no date or number is an error, and repeated pairs all stay.

    With patron_id the rows of a pair are counted, whatever else the file has.
    """
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "update_date date, inhouse_date date, rooms_otb double")
    to = lambda c, kind: F.when(F.col(c).isNotNull(), F.coalesce(F.expr(f"try_cast(trim({c}) AS {kind})"), F.raise_error(F.concat(F.lit(f"{c} is no {kind}: "), c)))).alias(c)
    pair = [to("update_date", "date"), to("inhouse_date", "date")]
    if "patron_id" in raw.columns:
        return raw.select(*pair).groupBy("update_date", "inhouse_date").agg(F.count("*").cast("double").alias("rooms_otb"))
    return raw.select(*pair, to("rooms_otb", "double"))


def parse_signals(lines: DataFrame, value: str = "value") -> DataFrame:
    """Signal records of tab-separated lines: start, end, signal, name.

    Lines are trimmed first, so a record whose last field is empty has too few fields and is dropped, as are
    blank lines, records of fewer than 16 fields and signals that aren't whole numbers or days that don't exist.
    """
    f = F.split(F.trim(F.regexp_replace(F.col(value), "^﻿|\\s+$", "")), "\t")
    # generators of one row each: a filter is not pushed below them, where it would split the line again for every use of a field
    rows = lines.select(F.explode(F.array(f)).alias("f")).where(F.size("f") >= 16)

    def day(at: int) -> Column:
        return F.expr(f"try_to_date(concat_ws('-', trim(f[{at + 2}]), trim(f[{at + 1}]), trim(f[{at}])), 'y-M-d')")

    signal = F.expr("CASE WHEN trim(f[3]) RLIKE '^[+-]?[0-9]+$' THEN try_cast(trim(f[3]) AS int) END")
    out = rows.select(F.inline(F.array(F.struct(day(6).alias("start"), day(11).alias("end"), signal.alias("signal"), F.element_at("f", 3).alias("name")))))
    return out.where("signal is not null and start is not null and end is not null")


def write_run(predictions: DataFrame, root: str) -> None:
    """Predictions of runs, a folder for each run_date; writing a run again replaces it alone."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(root)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def write_metadata(metadata: DataFrame, path: str, run_date: str) -> None:
    """One record in a folder of its own for the run; writing a run again replaces it."""
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/run_{run_date.replace('-', '')}")


def read_metadata(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Metadata of the runs that have predictions; records that aren't JSON are skipped, missing flags are false."""
    m = spark.read.schema(schemas.RUN_METADATA).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    m = m.where("_corrupt_record is null and run_date is not null").drop("_corrupt_record")
    for c in ("use_reservations", "use_weather", "initial_forecast"):
        m = m.withColumn(c, F.coalesce(c, F.lit(False)))
    return m.join(runs.select(F.col("run_date").cast("string").alias("run_date")).distinct(), "run_date", "left_semi")


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A sorted CSV table with a header."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)
