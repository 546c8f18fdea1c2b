"""Quality checks of forecasts and tables, access marks, hashes, and the org hierarchy's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A

SEALED = ("2024-01-01", "2026-02-01")


def sealed(origin: str = "origin", period: str = "period", window: tuple[str, str] = SEALED) -> Column:
    inside = lambda c: F.coalesce(F.trunc(F.col(c), "MM").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")), F.lit(False))
    return inside(origin) | inside(period)


def drop_sealed(df: DataFrame, **kw) -> DataFrame:
    return df.where(~sealed(**kw))


def require_unsealed(df: DataFrame, token: str | None = None, **kw) -> DataFrame:
    """Pass the table on, or refuse if it holds sealed rows and there is no token."""
    if token is None and not df.where(sealed(**kw)).isEmpty():
        raise PermissionError("the table holds sealed rows")
    return df


def require_one_slice(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Refuse tables that mix slices or repeat a key."""
    row = df.agg(*(F.countDistinct(c).alias(c) for c in columns)).first()
    mixed = [c for c in columns if row[c] > 1]
    if mixed:
        raise ValueError(f"more than one {', '.join(mixed)}")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("keys repeat")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the right side repeats keys")
    return left.join(right, keys, how)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def validate(cells: DataFrame, floor: float) -> DataFrame:
    """Duplicates, negatives and months whose national sum is below a floor."""
    dup = F.lit(0) + F.sum((F.col("n") - 1).cast("long"))
    per_key = cells.groupBy("period", "org_code", "metric").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("neg"), F.sum("value").alias("v"))
    months = per_key.groupBy("period").agg(dup.alias("dups"), F.sum("neg").alias("neg"), F.sum("v").alias("v"))
    return months.agg(F.sum("dups").alias("duplicates"), F.sum("neg").alias("negatives"), F.count_if(F.col("v") < floor).alias("months_below_floor"), F.count("*").alias("months"))


def forecast_checks(f: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Counts of duplicates, missing, negative, crossed and all-zero forecasts, and wrong periods."""
    copies = F.count("*").over(Window.partitionBy(*keys))
    missing = F.exists("q", lambda x: x.isNull()) | F.col("q").isNull()
    expected = F.expr("add_months(origin, horizon - 1)")
    return f.withColumn("_n", copies).groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicated"), F.count_if(missing).alias("missing"),
        F.count_if(F.exists("q", lambda x: x < 0)).alias("negative"), F.count_if(A.crossed("q")).alias("crossed"),
        F.count_if(A.all_zero("q")).alias("all_zero"), F.count_if(F.col("period") != expected).alias("wrong_period"),
    )


def grid_problems(f: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from the expected grid or not in it."""
    have, want = f.select(*keys), expected.select(*keys)
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


def same_keys(f: DataFrame, by: list[str], model: str, keys: list[str]) -> DataFrame:
    """Whether all models of a cell forecast the same keys, by order-free sums of key hashes."""
    h = F.xxhash64(*keys).cast("decimal(38,0)")
    one = f.groupBy(*by, model).agg(F.sum(h).alias("h"), F.count("*").alias("n"))
    return one.groupBy(*by).agg(F.countDistinct("h", "n").alias("_d"), F.count("*").alias("models")).select(*by, "models", (F.col("_d") == 1).alias("same"))


def row_hash(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free hash of all rows: sums of two hashes and the count, so that it aggregates partially."""
    cols = [c for c in df.columns if not by or c not in by]
    sums = [F.sum(F.xxhash64(F.lit(s), *cols).cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2)]
    out = df.groupBy(*(by or [])).agg(*sums, F.count("*").alias("rows"))
    return out.select(*(by or []), F.sha2(F.concat_ws(":", *(F.col(f"h{s}").cast("string") for s in (1, 2)), F.col("rows").cast("string")), 256).alias("hash"), "rows")


def portable_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free hash of each slice that other engines can repeat: the first 60 bits of the MD5 of
    each row's values as text (doubles to four decimals, nulls left out), summed."""
    kinds = dict(df.dtypes)
    shown = [F.col(c).cast("decimal(28,4)" if kinds[c] == "double" else "string").cast("string") for c in df.columns if c not in by]
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *shown)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.sum(part).cast("string").alias("hash"), F.count("*").alias("rows"))


def follow(spark: SparkSession, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(code, final): the end of each chain of successions with a single successor a step.

    final is null for a code whose chain does not end within `limit` hops or runs in a circle.
    """
    one = edges.where("predecessor <> successor").groupBy("predecessor").agg(F.min("successor").alias("successor"), F.countDistinct("successor").alias("n")).where("n = 1").drop("n")
    step = one.select(F.col("predecessor").alias("_c"), F.col("successor").alias("_f"), F.lit(1).alias("_h"))
    now = step.toDF("code", "final", "hops")
    reach = 1
    while reach < limit:  # each round doubles the hops that can be followed
        nxt = now.toDF("_c", "_f", "_h")
        now = now.join(nxt, now.final == nxt["_c"], "left").select("code", F.coalesce("_f", "final").alias("final"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        reach *= 2
    goes_on = now.join(step.select(F.col("_c")), now.final == step["_c"], "left")
    ended = F.col("_c").isNull() & (F.col("hops") <= limit)
    return goes_on.select("code", F.when(ended, F.col("final")).alias("final"))


def crosswalk(old: DataFrame, new: DataFrame, member: str, code: str) -> DataFrame:
    """Old code to the one new code to which all its members moved; null where they split."""
    j = old.select(member, F.col(code).alias("old_code")).join(new.select(member, F.col(code).alias("new_code")), member)
    g = j.groupBy("old_code").agg(F.min("new_code").alias("new_code"), F.countDistinct("new_code").alias("n_targets"), F.count("*").alias("members"))
    return g.withColumn("new_code", F.when(F.col("n_targets") == 1, F.col("new_code")))


def in_force(days: DataFrame, specs: DataFrame, day: str) -> DataFrame:
    """The specification in force on a day: the latest that started by then."""
    s = specs.orderBy("valid_from")
    w = Window.orderBy("valid_from")
    iv = s.withColumn("until", F.lead("valid_from").over(w))
    return days.join(F.broadcast(iv), (F.col(day) >= F.col("valid_from")) & (F.col("until").isNull() | (F.col(day) < F.col("until"))), "left")
