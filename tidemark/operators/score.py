"""Scoring of quantile forecasts, summaries, coverage tables and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.calendar import assessable, is_winter

BAND = (0.85, 0.95)


def score(forecasts: DataFrame, truth: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scored rows, one row of drop counts).

    forecasts has keys, q and scale; truth has keys and y. Rows are dropped, in this order, for a
    missing quantile, a missing outturn, or a scale that is present and not positive.
    """
    joined = forecasts.join(truth, keys, "left")
    no_forecast = F.col("q").isNull() | F.exists("q", lambda x: x.isNull() | F.isnan(x))
    reason = F.when(no_forecast, "no_forecast").when(F.col("y").isNull(), "no_outturn").when(F.col("scale").isNotNull() & ~(F.col("scale") > 0), "degenerate")
    marked = joined.withColumn("_drop", reason)
    counts = marked.agg(*(F.count_if(F.col("_drop") == r).alias(r) for r in ("no_forecast", "no_outturn", "degenerate")), F.count_if(F.col("_drop").isNull()).alias("scored"))
    error = F.abs(F.col("y") - A.at("q", 0.5))
    scored = marked.where("_drop is null").drop("_drop").withColumns(
        {
            "wis": A.wis("q", "y"),
            "abs_err": error,
            "mase": F.when(F.col("scale") > 0, error / F.col("scale")),
            "cov50": A.covers("q", "y", 0.25, 0.75),
            "cov90": A.covers("q", "y", 0.05, 0.95),
            "pit": A.pit("q", "y"),
            "winter": is_winter("period"),
        }
    )
    return scored, counts


def summarise(scored: DataFrame, by: list[str]) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return scored.groupBy(*by).agg(F.avg("wis").alias("wis"), F.avg("abs_err").alias("mae"), F.avg("mase").alias("mase"), share("cov50"), share("cov90"), F.count("*").alias("n"))


def coverage_cells(scored: DataFrame, by: list[str], least_origins: int = 6, band: tuple[float, float] = BAND) -> DataFrame:
    """Coverage by origin year and horizon; only cells with enough origins are judged."""
    cells = scored.where(assessable("origin", "period")).groupBy(*by, F.year("origin").cast("long").alias("year"), "horizon").agg(F.avg(F.col("cov90").cast("double")).alias("cov90"), F.countDistinct("origin").alias("origins"))
    judged = F.col("origins") >= least_origins
    return cells.withColumn("in_band", F.when(judged, F.col("cov90").between(*band)))


def acceptance(cells: DataFrame, by: list[str], nominal: float = 0.9) -> DataFrame:
    judged = F.col("in_band").isNotNull()
    return cells.groupBy(*by).agg(F.max(F.when(judged, F.abs(F.col("cov90") - nominal))).alias("worst"), F.count_if(F.coalesce("in_band", F.lit(False))).alias("n_in"), F.count_if(judged).alias("n_judged"))


def coverage_by_window(scored: DataFrame, by: list[str]) -> DataFrame:
    """All rows, and those inside and outside the excluded window, in one pass of grouping sets."""
    marked = scored.withColumn("window", F.when(assessable("origin", "period"), "outside").otherwise("inside"))
    sets = [[*map(F.col, by), F.col("window")], [*map(F.col, by)]]
    out = marked.groupingSets(sets, *by, "window").agg(F.avg(F.col("cov90").cast("double")).alias("cov90"), F.count("*").alias("n"), F.grouping("window").alias("_all"))
    return out.withColumn("window", F.when(F.col("_all") == 1, "all").otherwise(F.col("window"))).drop("_all")


def relative_scores(scored: DataFrame, model: str, base: str, by: list[str], metric: str = "wis") -> DataFrame:
    means = scored.groupBy("model", *by).agg(F.avg(metric).alias("m"))
    b = means.where(F.col("model") == base).select(*by, F.col("m").alias("b"))
    return means.where(F.col("model") == model).join(b, by).select(*by, (F.col("m") / F.col("b") - 1).alias("rel"))


def geometric_mean_change(rel: DataFrame, by: list[str]) -> DataFrame:
    return rel.groupBy(*by).agg((F.exp(F.avg(F.log1p("rel"))) - 1).alias("gm"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], metric: str = "wis") -> DataFrame:
    """Rows that both have, with both values present."""
    x = a.select(*keys, F.col(metric).alias("a")).where("a is not null")
    return x.join(b.select(*keys, F.col(metric).alias("b")).where("b is not null"), keys)


def paired_difference(a: DataFrame, b: DataFrame, keys: list[str], unit: str, metric: str = "wis") -> DataFrame:
    """Mean difference b - a and relative change over unit means."""
    units = paired(a, b, keys, metric).groupBy(unit).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return units.agg(F.avg(F.col("b") - F.col("a")).alias("diff"), (F.avg("b") / F.avg("a") - 1).alias("rel"), F.count("*").alias("units"))


def leave_one_out(rows: DataFrame, origins: DataFrame, statistic: dict[str, Column]) -> DataFrame:
    """A statistic with each origin left out; from sums by origin, not from copies of the rows.

    statistic names sums; each row of the result has them for all origins but `dropped`.
    """
    sums = rows.groupBy("origin").agg(*(F.sum(c).alias(n) for n, c in statistic.items()))
    every = Window.partitionBy()
    left = origins.join(sums, "origin", "left")
    return left.select(F.col("origin").alias("dropped"), *((F.sum(n).over(every) - F.coalesce(n, F.lit(0))).alias(n) for n in statistic))


def range_fragile(values: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """Whether leaving one out can carry the value across the threshold."""
    lo, hi = F.min(value), F.max(value)
    return values.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"), ((lo <= threshold) & (hi >= threshold) & (F.count(value) >= 2)).alias("fragile"))


def band_status(x: Column, band: tuple[float, float] = BAND) -> Column:
    """below, inside or above; edges are inside."""
    return F.when(x < band[0], "below").when(x > band[1], "above").when(x.isNotNull(), "inside")


def verdict_primary(table: DataFrame, by: list[str], band: tuple[float, float] = BAND) -> DataFrame:
    """From intervals by horizon: any wholly outside, all inside, or neither."""
    outside = (F.col("hi") < band[0]) | (F.col("lo") > band[1])
    inside = (F.col("lo") >= band[0]) & (F.col("hi") <= band[1])
    return table.groupBy(*by).agg(F.when(F.bool_or(outside), "outside tolerance").when(F.bool_and(inside), "within tolerance").otherwise("inconclusive").alias("verdict"))


def verdict_late_horizons(table: DataFrame, by: list[str], first: int = 4, band: tuple[float, float] = BAND) -> DataFrame:
    """Points outside the band at late horizons confirm; none anywhere refutes."""
    out = ~F.col("cov90").between(*band)
    return table.groupBy(*by).agg(F.when(F.bool_or(out & (F.col("horizon") >= first)), "confirmed").when(~F.bool_or(out), "refuted").otherwise("neither").alias("verdict"))


def rank_models(scored: DataFrame, metric: str = "mase") -> DataFrame:
    """Mean over series of each series' mean, ranked; names break ties."""
    by_series = scored.groupBy("model", "series").agg(F.avg(metric).alias("m")).groupBy("model").agg(F.avg("m").alias("score"))
    return by_series.withColumn("rank", F.row_number().over(Window.orderBy("score", "model")).cast("long"))


def common_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return a.join(b.select(*keys), keys, "left_semi"), b.join(a.select(*keys), keys, "left_semi")


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows in both, in one only, and values that differ (null equal to null)."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina"))
    y = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    j = x.join(y, keys, "full_outer")
    both = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    return j.agg(
        F.count_if(both).alias("both"), F.count_if(F.col("_inb").isNull()).alias("left_only"), F.count_if(F.col("_ina").isNull()).alias("right_only"),
        F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differ"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"),
    )


def pit_histogram(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return scored.groupBy(*by, b).agg(F.count("*").alias("n"))


def pit_summary(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Chi-square distance from uniform and tail shares; the pooled row has null keys."""
    h = pit_histogram(scored, by, bins)
    total = h.rollup(*by).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(0)).alias(f"_{i}") for i in range(bins)))
    e = F.col("n") / bins
    chi2 = sum(((F.col(f"_{i}") - e) * (F.col(f"_{i}") - e) / e for i in range(1, bins)), (F.col("_0") - e) * (F.col("_0") - e) / e)
    return total.select(*by, "n", chi2.alias("chi2"), (F.col("_0") / F.col("n")).alias("low_tail"), (F.col(f"_{bins - 1}") / F.col("n")).alias("high_tail"))


def cluster_mean(rows: DataFrame, x: str, cluster: str) -> DataFrame:
    """Mean with a standard error robust to clusters (CR1)."""
    mean = rows.agg(F.avg(x).alias("_mean"), F.count(x).alias("_n"))
    r = rows.where(F.col(x).isNotNull()).crossJoin(F.broadcast(mean)).groupBy(cluster).agg(F.sum(F.col(x) - F.col("_mean")).alias("u"), F.first("_mean").alias("_mean"), F.first("_n").alias("_n"))
    g = F.count("*")
    se = F.sqrt(F.when(g > 1, g / (g - 1)) * F.sum(F.col("u") * F.col("u"))) / F.first("_n")
    return r.agg(F.first("_mean").alias("mean"), se.alias("se"), g.alias("clusters"), F.first("_n").alias("n"))


def cluster_slope(rows: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """Least-squares slope with a cluster-robust (CR1) standard error."""
    rows = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = rows.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(x).alias("_mx"), F.regr_sxx(y, x).alias("_sxx"), F.count("*").alias("_n"))
    dx = F.col(x) - F.col("_mx")
    u = rows.crossJoin(F.broadcast(fit)).groupBy(cluster).agg(F.sum(dx * (F.col(y) - F.col("_a") - F.col("_b") * F.col(x))).alias("u"), *(F.first(c).alias(c) for c in ("_b", "_sxx", "_n")))
    g, n = F.count("*"), F.first("_n")
    factor = g / (g - 1) * (n - 1) / (n - 2)
    return u.agg(F.first("_b").alias("slope"), (F.sqrt(factor * F.sum(F.col("u") * F.col("u"))) / F.first("_sxx")).alias("se"), g.alias("clusters"))


def pareto(points: DataFrame, a: str, b: str) -> DataFrame:
    """Points that no other beats on both of two minimised measures, by a running minimum."""
    w = Window.orderBy(a, b).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_m", F.min(b).over(w)).where(F.col("_m").isNull() | (F.col(b) < F.col("_m"))).drop("_m")


def choose(points: DataFrame, cost: str, tie: str, tolerance: float) -> DataFrame:
    """The least cost; within the tolerance of it, the least `tie`."""
    best = points.agg(F.min(cost).alias("_best"))
    return points.crossJoin(F.broadcast(best)).where(F.col(cost) <= F.col("_best") + tolerance).drop("_best").orderBy(tie, cost).limit(1)


def dev_flags(now: DataFrame, dev: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Where a value lies in the range of development values of its key."""
    span = dev.groupBy(*keys).agg(F.min(value).alias("dev_min"), F.max(value).alias("dev_max"), F.count(value).alias("dev_n"))
    flag = F.when(F.col("dev_n").isNull(), "absent").when(F.col(value) < F.col("dev_min"), "below").when(F.col(value) > F.col("dev_max"), "above").otherwise("within")
    return now.join(span, keys, "left").withColumn("flag", flag)
