"""From an archive of downloads to the vintage table: parse, choose, check, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.session import cut, delete_folder
from tidemark.sources import publications as P
from tidemark.sources.stores import exists, merge_vintages, write_vintages


def stored_files(manifest: DataFrame, upto: str | None = None) -> DataFrame:
    """Of each period and day of snapshot the file to be parsed: records without an error, CSV before
    XLSX before XLS, known by `upto` if that is given."""
    m = manifest.where("error is null and path is not null")
    if upto:
        m = m.where(F.col("day") <= F.lit(upto).cast("date"))
    return P.prefer_formats(m, ["period", "day"])


def parsed_files(spark: SparkSession, manifest: DataFrame, raw: str, header: str, rules: list[tuple[str, str]], ids: dict[str, str], preferred: tuple[str, ...] = (), only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(long rows with period, snapshot and source, failures). A file whose title states another month
    than the manifest is a failure. only: files (paths below raw) to be read instead of all."""
    cells, failures = P.read_cells(spark, raw if only is None else [f"{raw.rstrip('/')}/{p}" for p in only], preferred)
    files = stored_files(manifest).select(F.col("path").alias("source"), F.to_date(F.concat("period", F.lit("-01"))).alias("period"), F.col("day").alias("snapshot"))
    long = P.to_long(P.with_header(cells, header), rules, ids)
    stated = P.title_period(cells).withColumnRenamed("period", "stated")
    rows = long.join(stated, "path", "left").withColumn("source", P.relative(F.col("path"), raw)).join(files, "source")
    wrong = F.col("stated").isNotNull() & (F.col("stated") != F.col("period"))
    bad = rows.where(wrong).select("path", "sha256", F.concat(F.lit("states "), F.date_format("stated", "yyyy-MM")).alias("error")).distinct()
    return rows.where(~wrong).drop("stated", "path"), failures.unionByName(bad)


def vintages(long: DataFrame) -> DataFrame:
    """period, org_code, metric, version, value, snapshot: one row a key and snapshot (of repeated rows
    of a file the first), versions numbered in order of snapshot; totals left out."""
    rows = long.where("not is_total").withColumn("_r", F.row_number().over(Window.partitionBy("period", "org_code", "metric", "snapshot").orderBy("source", "line"))).where("_r = 1")
    version = F.row_number().over(Window.partitionBy("period", "org_code", "metric").orderBy("snapshot"))
    return rows.select("period", "org_code", "metric", version.alias("version"), "value", "snapshot")


def build(spark: SparkSession, manifest: DataFrame, raw: str, folder: str, header: str, rules: list[tuple[str, str]], ids: dict[str, str], floor: float = 0.0, preferred: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Write all vintages and the latest view; (the validation report, failures)."""
    long, failures = parsed_files(spark, manifest, raw, header, rules, ids, preferred)
    v = vintages(long)
    write_vintages(v, folder)
    back = spark.read.parquet(f"{folder}/latest")
    return quality.validate(back, floor), failures


HELD = "path string, period string, day date, step int"


def update(spark: SparkSession, manifest: DataFrame, raw: str, folder: str, header: str, rules: list[tuple[str, str]], ids: dict[str, str], preferred: tuple[str, ...] = ()) -> DataFrame:
    """Bring the tables of a folder up to date with the manifest, reading only files that it does not yet hold;
    their failures. The tables are those that `build` would write from the whole archive.

    What is held is a log (path, period, day, step), appended last: an update that was cut short is done
    again by the next one, and changes nothing twice. A file that gives way to another of its period and
    day, or to none (a null path in the log), takes its rows with it. Files that failed are held too.
    """
    files = stored_files(manifest).select("path", "period", "day")
    log, touched = f"{folder}/_held", f"{folder}/_touched"
    begun = exists(spark, log)
    events = spark.read.schema(HELD).parquet(log) if begun else spark.createDataFrame([], HELD)
    held = events.groupBy("period", "day").agg(F.max_by("path", "step").alias("path")).where("path is not null")
    step = (events.agg(F.max("step")).first()[0] or 0) + 1
    new, old = cut(files.join(held, ["path", "period", "day"], "left_anti")), cut(held.join(files, ["path", "period", "day"], "left_anti"))
    only = sorted(r.path for r in new.collect())  # names of the files of one increment; a reader lists them in any case
    rows, failures = spark.createDataFrame([], "period date, org_code string, metric string, version int, value double, snapshot date"), spark.createDataFrame([], "path string, sha256 string, error string")
    if not only and old.isEmpty():
        return failures
    if only:
        long, failures = parsed_files(spark, manifest, raw, header, rules, ids, preferred, only)
        rows, failures = cut(vintages(long)), cut(failures)
    if begun:
        days = new.select("period", "day").unionByName(old.select("period", "day")).distinct()
        merge_vintages(spark, rows, cut(days.select(F.to_date(F.concat("period", F.lit("-01"))).alias("period"), F.col("day").alias("snapshot"))), folder)
    else:
        write_vintages(rows, folder, "overwrite")  # a first build that was cut short is begun again
    ended = old.join(new, ["period", "day"], "left_anti").select(F.lit(None).cast("string").alias("path"), "period", "day")
    new.select("path", "period", "day").unionByName(ended).withColumn("step", F.lit(step)).coalesce(1).write.mode("append").parquet(log)
    delete_folder(spark, touched)
    return failures
