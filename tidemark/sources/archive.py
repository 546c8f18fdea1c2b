"""An archive of fetched files that keeps bytes once, by their SHA-256, and logs every fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut
from tidemark.sources.stores import exists

CONTENT = "sha256 string, name string, bytes long, content binary"
LOG = "url string, filename string, fetched timestamp, sha256 string, name string, bytes long, is_new boolean, error string"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/content", CONTENT)


def fetches(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/log", LOG)


def suffixed(filename: Column, sha: Column) -> Column:
    """The name with the first digits of the hash before its extension."""
    ext = F.regexp_extract(filename, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(F.substring(filename, F.lit(1), F.length(filename) - F.length(ext)), F.lit("-"), F.substring(sha, 1, 12), ext)


def keep(spark: SparkSession, fetched: DataFrame, folder: str) -> int:
    """Add fetched files (url, filename, fetched, content) to the archive; how many bodies were new. A fetch is
    named by url and time; a null url is an empty one, a file without a name is "unnamed".

    Bytes that the archive holds under any name are not written again. A name whose bytes differ from
    those it already stands for gets digits of the hash. A row without content is logged with an error. Only
    hashes and names are compared; new bodies alone are joined to their names and written. is_new in the log says
    that the run wrote the body.
    Bodies are written before the log, and rows logged before (url and time) are left out, so running it
    again after a loss, or for nothing, adds nothing twice.
    """
    fetched = fetched.withColumns({"url": F.coalesce("url", F.lit("")), "filename": F.coalesce(F.nullif("filename", F.lit("")), F.lit("unnamed"))})
    log = fetches(spark, folder)
    rows = fetched.select("url", "filename", "fetched", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes")).join(log.select("url", "fetched"), ["url", "fetched"], "left_anti")
    rows = cut(rows.dropDuplicates(["url", "fetched"]))
    known = contents(spark, folder).select("sha256", "name")
    order = Window.partitionBy("sha256").orderBy("fetched", "url")
    fresh = rows.where("sha256 is not null").join(known, "sha256", "left_anti").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    taken = known.select(F.col("name").alias("filename"), F.lit(True).alias("_taken")).distinct()
    first = F.row_number().over(Window.partitionBy("filename").orderBy("fetched", "url")) == 1
    named = fresh.withColumn("_first", first).join(taken, "filename", "left").withColumn("name", F.when(F.col("_first") & F.col("_taken").isNull(), F.col("filename")).otherwise(suffixed(F.col("filename"), F.col("sha256"))))
    fresh = cut(named.select("url", "fetched", "sha256", "name", "bytes"))
    n = fresh.count()
    if n:
        bodies = fetched.select("url", "fetched", "content").join(fresh, ["url", "fetched"]).dropDuplicates(["sha256"])
        bodies.select("sha256", "name", "bytes", "content").write.mode("append").parquet(f"{folder}/content")
    names = contents(spark, folder).select("sha256", "name")
    new = fresh.select("url", "fetched", F.lit(True).alias("_new"))
    out = rows.join(names, "sha256", "left").join(new, ["url", "fetched"], "left")
    error = F.when(F.col("sha256").isNull(), "no content")
    out = out.select("url", "filename", "fetched", "sha256", "name", "bytes", F.coalesce("_new", F.lit(False)).alias("is_new"), error.alias("error"))
    out.write.mode("append").parquet(f"{folder}/log")
    return n
