"""Sinks: partitioned tables kept up by increments, sealed stores that refuse to be overwritten, result folders."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.quality import row_hash
from tidemark.operators.vintage import latest
from tidemark.session import cut, delete_folder

KEY = ["period", "org_code", "metric"]
ALL = "period date, org_code string, metric string, version int, value double, snapshot date, year int"
LATEST = "period date, org_code string, metric string, value double, year int"


def file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of a folder, and what makes its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = file_system(spark, folder)
    return fs.exists(path(folder))


def _all(v: DataFrame) -> DataFrame:
    return v.withColumn("year", F.year("snapshot")).repartition("year", F.pmod(F.xxhash64("org_code"), F.lit(8)))


def _latest(v: DataFrame) -> DataFrame:
    return v.withColumn("year", F.year("period")).repartition("year", F.pmod(F.xxhash64("org_code"), F.lit(8)))


def write_vintages(v: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """All versions by year of snapshot, and the latest view by year of period."""
    _all(v).write.partitionBy("year").mode(mode).parquet(f"{folder}/all")
    _latest(latest(v)).write.partitionBy("year").mode(mode).parquet(f"{folder}/latest")


def merge_vintages(spark: SparkSession, new: DataFrame, replaced: DataFrame, folder: str) -> None:
    """Bring `all` and `latest` up to date with new rows (KEY, value, snapshot), as if all had been built at once.

    replaced (period, snapshot) says which earlier rows the new ones stand for. Versions are numbered
    anew for the keys concerned only; years before the first period concerned are not read, and only
    those whose rows change are written again. The keys are noted in `_touched` until the caller
    deletes that, so a merge that was cut short is completed by doing it again.
    """
    held, view = (spark.read.schema(schema).parquet(f"{folder}/{t}") for t, schema in (("all", ALL), ("latest", LATEST)))
    touched = f"{folder}/_touched"
    before = cut(spark.read.parquet(touched)) if exists(spark, touched) else None
    first = replaced.agg(F.min("period")).first()[0]
    if before is not None:
        first = min(x for x in (first, before.agg(F.min("period")).first()[0]) if x is not None)
    if first is None:
        return
    old = held.where(F.col("year") >= first.year)
    dropped = old.join(replaced, ["period", "snapshot"], "left_semi")
    keys = new.select(*KEY).unionByName(dropped.select(*KEY))
    keys = (keys if before is None else keys.unionByName(before)).distinct()
    keys.write.mode("overwrite").parquet(touched)
    keys = spark.read.parquet(touched)
    rest = old.join(keys, KEY, "left_semi").join(replaced, ["period", "snapshot"], "left_anti")
    both = rest.select(*KEY, "value", "snapshot", F.col("version").alias("_was")).unionByName(new.select(*KEY, "value", "snapshot", F.lit(None).cast("int").alias("_was")))
    now = cut(both.withColumn("version", F.row_number().over(Window.partitionBy(*KEY).orderBy("snapshot"))).withColumn("year", F.year("snapshot")))
    moved = now.where("_was is null or _was <> version").select("year").unionByName(dropped.select("year")).distinct()
    years, periods = ([r[0] for r in t.collect()] for t in (moved, keys.select(F.year("period")).distinct()))  # calendar years
    # both are worked out before either is touched; the view goes first, as it can be made from what `all` still holds
    ours, theirs = [*KEY, "version", "value", "snapshot"], [*KEY, "value"]
    whole = cut(old.where(F.col("year").isin(years)).join(keys, KEY, "left_anti").select(*ours).unionByName(now.where(F.col("year").isin(years)).select(*ours)))
    seen = cut(view.where(F.col("year").isin(periods)).join(keys, KEY, "left_anti").select(*theirs).unionByName(latest(now).select(*theirs)))
    _replace(spark, _latest(seen), f"{folder}/latest", periods)
    _replace(spark, _all(whole), f"{folder}/all", years)


def _replace(spark: SparkSession, table: DataFrame, folder: str, years: list[int]) -> None:
    """Write years again; one that has no rows any more goes."""
    table.write.option("partitionOverwriteMode", "dynamic").partitionBy("year").mode("overwrite").parquet(folder)
    left = {r.year for r in table.select("year").distinct().collect()}
    for y in set(years) - left:
        delete_folder(spark, f"{folder}/year={y}")


class Store:
    """Named tables, each written once with the hash of its rows, checked when it is read.

    A put has four steps: the table is written aside, read back and hashed; the hash is noted beside it; the
    folder gets its name in one rename; the record is written, in one rename too. A put that was cut short
    is finished (from the rename on) or begun again by the next put of that name, so a name is either
    loadable or free.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, name: str, table: DataFrame, meta: dict[str, str] | None = None) -> None:
        if self.state(name) == "sealed":
            raise FileExistsError(f"{name} already exists")
        if self.state(name) == "free":
            self._write_aside(name, table, meta or {})
        if self.state(name) == "written":
            self._rename(f"_aside/{name}", name)
        self._seal(name)

    def state(self, name: str) -> str:
        """free (nothing, or an unfinished table aside), written (whole, aside), named (without a record) or sealed."""
        there = lambda p: exists(self.spark, f"{self.folder}/{p}")
        if there(f"_records/{name}.json"):
            return "sealed"
        if not there(f"_pending/{name}.json"):
            return "free"
        return "named" if there(name) else "written" if there(f"_aside/{name}") else "free"

    def _write_aside(self, name: str, table: DataFrame, meta: dict[str, str]) -> None:
        if exists(self.spark, f"{self.folder}/{name}"):
            raise FileExistsError(f"{name} already exists")
        aside = f"{self.folder}/_aside/{name}"
        table.write.mode("overwrite").parquet(aside)
        back = self.spark.read.parquet(aside)
        got = row_hash(back).first()
        self._note(f"_pending/{name}.json", {"name": name, "hash": got["hash"], "rows": got["rows"], "columns": json.dumps(back.dtypes), "meta": json.dumps(meta)})

    def _seal(self, name: str) -> None:
        self._rename(f"_pending/{name}.json", f"_records/{name}.json")

    def _rename(self, a: str, b: str) -> None:
        fs, path = file_system(self.spark, self.folder)
        to = path(f"{self.folder}/{b}")
        fs.mkdirs(to.getParent())
        if not fs.rename(path(f"{self.folder}/{a}"), to):
            raise OSError(f"{a} could not be renamed to {b}")

    def _note(self, at: str, record: dict) -> None:
        """One small file, whole or not there."""
        fs, path = file_system(self.spark, self.folder)
        aside = f"_new/{uuid.uuid4().hex}"
        out = fs.create(path(f"{self.folder}/{aside}"), True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        fs.delete(path(f"{self.folder}/{at}"), False)
        self._rename(aside, at)

    def records(self) -> DataFrame:
        return self.spark.read.schema("name string, hash string, rows long, columns string, meta string").json(f"{self.folder}/_records")

    def load(self, name: str) -> DataFrame:
        if self.state(name) != "sealed":
            raise FileNotFoundError(f"{name} is not stored")
        table = self.spark.read.parquet(f"{self.folder}/{name}")
        want = self.records().where(F.col("name") == name).first()
        got = row_hash(table).first()
        if want["hash"] != got["hash"]:
            raise ValueError(f"{name} is not what was stored")
        return table


def write_slices(table: DataFrame, slices: list[str], folder: str) -> list[str]:
    """CSV split by each slice column with more than one value; returns those columns."""
    n = table.agg(*(F.countDistinct(c).alias(c) for c in slices)).first()
    split = [c for c in slices if n[c] > 1]
    writer = table.drop(*(c for c in slices if c not in split)).write.mode("errorifexists").option("header", "true")
    (writer.partitionBy(*split) if split else writer).csv(folder)
    return split


def recomputed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with how often."""
    return new.exceptAll(old).withColumn("side", F.lit("new")).unionByName(old.exceptAll(new).withColumn("side", F.lit("old")))


def markdown(table: DataFrame, rows: int = 50) -> str:
    """A small table as text, for reports; `rows` is how many are shown."""
    head = table.limit(rows).collect()
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head)])
