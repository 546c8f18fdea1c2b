"""Monthly panels in long form (series, period, y) on a gap-free spine, and their features.

Every window is by rows over the spine, so a row is a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import LEVELS
from tidemark.functions.calendar import is_winter, months_between


def spine(y: DataFrame, by: list[str], last: Column | None = None) -> DataFrame:
    """Every month of each series from its first to the last one (of its own, or given)."""
    ends = y.groupBy(*by).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    months = ends.select(*by, F.explode(F.sequence("_lo", last if last is not None else F.col("_hi"), F.expr("interval 1 month"))).alias("period"))
    return months.join(y, [*by, "period"], "left")


def _series(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("period")


def _back(by: list[str], n: int, to: int = 0) -> Window:
    return _series(by).rowsBetween(-n, to)


def guarded_mean(by: list[str], n: int, least: int) -> Column:
    w = _back(by, n - 1)
    return F.when(F.count("y").over(w) >= least, F.avg("y").over(w))


def features(panel: DataFrame, by: list[str]) -> DataFrame:
    """Lags, the same month of earlier years, trailing means, growth and length of history."""
    w = _series(by)
    lags = {f"lag{k}": F.lag("y", k).over(w) for k in (1, 2, 3, 6, 11, 12)}
    year, before = F.avg("y").over(_back(by, 11)), F.avg("y").over(_back(by, 23, -12))
    return panel.withColumns(
        {
            **lags,
            "mean3": guarded_mean(by, 3, 2),
            "mean12": guarded_mean(by, 12, 6),
            "growth12": F.when((F.count("y").over(_back(by, 11)) >= 6) & (F.count("y").over(_back(by, 23, -12)) >= 6) & (before > 0), year / before),
            "history": F.count("y").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )


def mase_scale(panel: DataFrame, by: list[str], m: int = 12) -> DataFrame:
    """Mean absolute change over m months; null with fewer than two pairs."""
    step = F.abs(F.col("y") - F.lag("y", m).over(_series(by)))
    return panel.withColumn("_d", step).groupBy(*by).agg(F.when(F.count("_d") >= 2, F.avg("_d")).alias("scale"))


def last_observed(panel: DataFrame, by: list[str]) -> DataFrame:
    return panel.where("y is not null").groupBy(*by).agg(F.max("period").alias("last_period"), F.max_by("y", "period").alias("last_y"))


def recent_mean(panel: DataFrame, by: list[str], n: int = 6) -> DataFrame:
    """Mean of the last n values that are not null."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("period").desc()))
    return panel.where("y is not null").withColumn("_r", rank).where(F.col("_r") <= n).groupBy(*by).agg(F.avg("y").alias("recent"), F.count("*").alias("n"))


def interpolate(panel: DataFrame, by: list[str]) -> DataFrame:
    """Linear between neighbours; after the last value it stays, before the first is left out."""
    seen = F.when(F.col("y").isNotNull(), F.struct("period", "y"))
    a = F.last(seen, ignorenulls=True).over(_series(by).rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(seen, ignorenulls=True).over(_series(by).rowsBetween(0, Window.unboundedFollowing))
    out = panel.withColumns({"_a": a, "_b": b}).where("_a is not null")
    share = months_between("_a.period", "period") / F.nullif(months_between("_a.period", "_b.period"), F.lit(0))
    filled = F.coalesce("y", F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * share, F.col("_a.y"))
    return out.withColumn("filled", filled).drop("_a", "_b")


def implausible(panel: DataFrame, by: list[str], share: float = 0.1, n: int = 12, least: int = 6) -> DataFrame:
    """y_clean: null where y is not positive, or far below the median of the months before."""
    w = _back(by, n, -1)
    low = (F.count("y").over(w) >= least) & (F.col("y") < share * F.percentile("y", 0.5).over(w))
    return panel.withColumn("y_clean", F.when(~((F.col("y") <= 0) | F.coalesce(low, F.lit(False))), F.col("y")))


def active(panel: DataFrame, by: list[str], months: int = 12, least: int = 24) -> DataFrame:
    """Series with a value in the last months of the panel and enough months of it."""
    end = panel.agg(F.max("period").alias("_end"))
    s = panel.groupBy(*by).agg(F.max(F.when(F.col("y").isNotNull(), F.col("period"))).alias("last_seen"), F.count("*").alias("n_months"))
    return s.crossJoin(F.broadcast(end)).where((F.col("last_seen") > F.add_months("_end", -months)) & (F.col("n_months") >= least)).drop("_end")


def missing_by_month(panel: DataFrame, by: list[str], back: int = 11) -> DataFrame:
    """By month, series that have a value in the months before and none now."""
    before = F.count("y").over(_back(by, back, -1))
    return panel.withColumn("_b", before).groupBy("period").agg(F.count_if((F.col("_b") > 0) & F.col("y").isNull()).alias("n_missing"), F.count("y").alias("n_present"))


def seasonal_naive(panel: DataFrame, by: list[str], horizons: tuple[int, ...] = (1, 2, 3, 4, 5, 6), window: int = 36, own: int = 12) -> DataFrame:
    """Seasonal naive forecasts from the last month of each panel, in window functions alone.

    The point is the value of 12 months before times the paired growth; the quantiles multiply it
    by the quantiles of the series' own log errors over the last `window` months, or of all
    series' errors at that horizon where it has fewer than `own`.
    """
    w = _series(by)
    p = panel.withColumn("_past", F.lag("y", 12).over(w))
    pair = F.col("y").isNotNull() & F.col("_past").isNotNull()
    p = p.withColumns({"_n": F.when(pair, F.col("y")), "_o": F.when(pair, F.col("_past"))})
    year = _back(by, 11)
    num, den, k = F.sum("_n").over(year), F.sum("_o").over(year), F.count("_n").over(year)
    history = F.row_number().over(w)
    growth = F.when((history >= 24) & (k >= 6) & (den > 0), num / den).otherwise(F.lit(1.0))
    p = p.withColumn("_g", growth).withColumn("_end", F.max("period").over(Window.partitionBy(*by)))
    p = p.withColumn("_made", F.array(*(F.struct(F.lit(h).alias("horizon"), (F.lag("y", 12 - h).over(w) * F.col("_g")).alias("point")) for h in horizons)))
    made = F.explode("_made")
    points = p.select(*by, "period", "y", "_end", made.alias("m")).select(*by, F.col("period").alias("made_at"), "_end", "m.horizon", "m.point").withColumn("period", F.expr("add_months(made_at, horizon)"))
    truth = panel.select(*by, "period", "y")
    tested = points.join(truth, [*by, "period"]).where((F.col("y") > 0) & (F.col("point") > 0) & (F.col("period") > F.add_months("_end", -window)) & (F.col("period") <= F.col("_end")))
    errors = tested.select(*by, "horizon", F.log(F.col("y") / F.col("point")).alias("e"))
    q = [float(x) for x in LEVELS]
    mine = errors.groupBy(*by, "horizon").agg(F.count("*").alias("n"), F.percentile("e", q).alias("own"))
    pooled = errors.groupBy(*[b for b in by if b != "series"], "horizon").agg(F.percentile("e", q).alias("pooled"))
    keys = [b for b in by if b != "series"]
    out = points.where("made_at = _end and point is not null").join(mine, [*by, "horizon"], "left").join(pooled, [*keys, "horizon"], "left")
    e = F.when(F.col("n") >= own, F.col("own")).otherwise(F.col("pooled"))
    return out.select(*by, "horizon", "period", "point", F.transform(e, lambda x: F.greatest(F.col("point") * F.exp(x), F.lit(0.0))).alias("q"))


def seasonal_profile(panel: DataFrame, by: list[str]) -> DataFrame:
    """Mean log departure of each calendar month from the trailing year, centred by series."""
    dep = panel.withColumn("_l", F.log(F.when(F.col("y") > 0, F.col("y")) / F.avg("y").over(_back(by, 11))))
    eff = dep.where("_l is not null").groupBy(*by, F.month("period").cast("long").alias("month")).agg(F.avg("_l").alias("effect"))
    return eff.withColumn("effect", F.col("effect") - F.avg("effect").over(Window.partitionBy(*by)))


def prepared(panel: DataFrame, targets: tuple[str, ...], relative: dict[str, str], n: int = 12) -> DataFrame:
    """target, series, period, y and offset, as a joint model of all targets takes them: series that have every
    target, implausible values left out, and the log of the mean of a series' last n values (at least 1) to
    centre it on; for targets in `relative` less that of the target named there."""
    by = ["target", "series"]
    whole = panel.where(F.col("target").isin(*targets)).groupBy("series").agg(F.countDistinct("target").alias("_n")).where(F.col("_n") == len(targets)).select("series")
    clean = implausible(panel.where(F.col("target").isin(*targets)).join(whole, "series", "left_semi"), by).select(*by, "period", F.col("y_clean").alias("y"))
    recent = recent_mean(clean, by, n).select(*by, F.log(F.greatest("recent", F.lit(1.0))).alias("_level"))
    base = F.create_map(*(F.lit(x) for pair in relative.items() for x in pair)) if relative else None
    other = recent.select(F.col("target").alias("_of"), "series", F.col("_level").alias("_base"))
    out = clean.join(recent, by, "left").withColumn("_of", F.try_element_at(base, F.col("target")) if relative else F.lit(None).cast("string"))
    out = out.join(other, ["_of", "series"], "left")
    return out.select(*by, "period", "y", (F.coalesce("_level", F.lit(0.0)) - F.coalesce("_base", F.lit(0.0))).alias("offset"))


def mark_winter(df: DataFrame, period: str = "period") -> DataFrame:
    return df.withColumn("winter", is_winter(period))
