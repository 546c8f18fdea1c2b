"""Vintage views over the driver's star schema, and the same views as DuckDB SQL.

period is the ship month, org the supplier, metric the return flag; version v (line number) of a
cell is the running sum of quantities of lines 1..v, current from the second Thursday of the
month v months after the period. Parents of an org are its nation (group) and region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_floor, second_thursday

#: Lines in a part of vintages(), so that what a task holds does not grow with the table.
PART_LINES = 1 << 18

METRICS = ("A", "N", "R")
#: Targets and the metrics they add up; null if any part is missing.
TARGETS = {"all": ("A", "N", "R"), "first": ("A",), "rest": ("N", "R")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vintages(spark: SparkSession, sf_dir: str, form: str = "value") -> DataFrame:
    """period, org_code, metric, version, value, snapshot; or, in the form `change`, a row for each line with
    what it adds to its version and the later ones.

    Lines are dealt by org once, into parts of about PART_LINES; sums, windows and joins by org or by keys
    that hold it follow where they lie.
    """
    n = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PART_LINES))
    line = table(spark, sf_dir, "lineitem").select(month_floor("l_shipdate").alias("period"), F.col("l_suppkey").alias("org_code"), F.col("l_returnflag").alias("metric"), F.col("l_linenumber").cast("int").alias("version"), "l_quantity")
    line = line.repartition(parts, "org_code")
    snapshot = second_thursday(F.add_months("period", F.col("version")))
    if form == "change":
        return line.withColumnRenamed("l_quantity", "change").withColumn("snapshot", snapshot)
    cells = line.groupBy("period", "org_code", "metric", "version").agg(F.sum("l_quantity").alias("qty"))
    running = Window.partitionBy("org_code", "period", "metric").orderBy(F.asc_nulls_last("version"))
    return cells.select("period", "org_code", "metric", "version", F.sum("qty").over(running).alias("value"), snapshot.alias("snapshot"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """org_code, group_code, region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("org_code"), F.col("n_name").alias("group_code"), F.col("r_name").alias("region"))


def months(spark: SparkSession, first: str, last: str, name: str = "origin") -> DataFrame:
    """A row for each month start from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias(name))


def beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A versioned quarterly table: nation, quarter, version, available, occupied, published."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("long").alias("org_code"), F.trunc("o_orderdate", "QUARTER").alias("quarter"), F.substring("o_orderpriority", 1, 1).cast("int").alias("version"), "o_totalprice")
    cells = rows.groupBy("org_code", "quarter", "version").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    run = Window.partitionBy("org_code", "quarter").orderBy("version")
    value, n = F.sum("v").over(run), F.sum("n").over(run)
    published = second_thursday(F.add_months("quarter", F.col("version") + 4))
    return cells.select("org_code", "quarter", "version", (value / 1000).alias("available"), (value / 1000 * (0.6 + 0.4 * (F.pmod(n * 7 + F.col("org_code"), F.lit(11)) / 11))).alias("occupied"), published.alias("published"))


# The same views for DuckDB.
THURSDAY = "CAST({m} AS DATE) + CAST((11 - isodow(CAST({m} AS DATE))) % 7 + 7 AS INT)"


def sql_thursday(month: str) -> str:
    return "(" + THURSDAY.format(m=month) + ")"


SQL_VINT = f"""
vint AS (
  SELECT period, org_code, metric, version, sum(qty) OVER (PARTITION BY period, org_code, metric ORDER BY version) AS value,
         {sql_thursday('period + to_months(version)')} AS snapshot
  FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_suppkey AS org_code, l_returnflag AS metric,
               CAST(l_linenumber AS INT) AS version, sum(l_quantity) AS qty
        FROM lineitem GROUP BY ALL))"""
SQL_HIER = """
hier AS (
  SELECT s_suppkey AS org_code, n_name AS group_code, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_BEDS = f"""
beds AS (
  SELECT org_code, quarter, version, v2 / 1000 AS available, v2 / 1000 * (0.6 + 0.4 * (((n2 * 7 + org_code) % 11) / 11)) AS occupied,
         {sql_thursday('quarter + to_months(version + 4)')} AS published
  FROM (SELECT *, sum(v) OVER w AS v2, sum(n) OVER w AS n2 FROM (
          SELECT CAST(c_nationkey AS BIGINT) AS org_code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
                 CAST(substr(o_orderpriority, 1, 1) AS INT) AS version, sum(o_totalprice) AS v, count(*) AS n
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
        WINDOW w AS (PARTITION BY org_code, quarter ORDER BY version)))"""


def sql_months(first: str, last: str, name: str = "origin") -> str:
    return f"(SELECT CAST(range AS DATE) AS {name} FROM range(DATE '{first}', DATE '{last}' + INTERVAL 1 DAY, INTERVAL 1 MONTH))"
