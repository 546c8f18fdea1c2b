"""Reports over tables of runs: seed pairs, reproduction, sampling checks, retention, embargo pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays as A


def relative(new: Column, old: Column) -> Column:
    return F.when(old != 0, new / old - 1)


def paired_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of two runs (wis, cov50, cov90) on the rows that both have."""
    cols = ("wis", "cov50", "cov90")
    side = lambda df, s: df.select(*keys, *(F.col(c).cast("double").alias(f"{c}_{s}") for c in cols))
    return side(a, "orig").join(side(b, "retry"), keys)


def seed_differences(pairs: DataFrame) -> DataFrame:
    """By origin and target, by target (null origin), and the geometric mean over targets (target 'gm'):
    means of both runs, WIS difference in %, coverage differences in points."""
    cols = ("wis", "cov50", "cov90")
    means = [F.avg(f"{c}_{s}").alias(f"{c}_{s}") for c in cols for s in ("orig", "retry")]
    sets = pairs.groupingSets([[F.col("origin"), F.col("target")], [F.col("target")]], "origin", "target").agg(*means, F.count("*").alias("rows"))
    points = [(100 * (F.col(f"{c}_retry") - F.col(f"{c}_orig"))).alias(f"{c}_diff_pp") for c in cols[1:]]
    out = sets.select("origin", "target", "rows", *(f"{c}_{s}" for c in cols for s in ("orig", "retry")), (100 * relative(F.col("wis_retry"), F.col("wis_orig"))).alias("wis_diff_pct"), *points)
    pooled = out.where("origin is null")
    mean = pooled.agg(F.sum("rows").alias("rows"), (100 * (F.exp(F.avg(F.log(F.col("wis_retry") / F.col("wis_orig")))) - 1)).alias("wis_diff_pct"))
    return out.unionByName(mean.withColumn("target", F.lit("gm")), allowMissingColumns=True)


def reproduction(new: DataFrame, old: DataFrame, keys: list[str], by: str = "origin") -> DataFrame:
    """Largest relative difference of quantiles by origin, rows compared and rows that only one has."""
    j = new.select(*keys, F.col("q").alias("_n"), F.lit(1).alias("_in_new")).join(old.select(*keys, F.col("q").alias("_o"), F.lit(1).alias("_in_old")), keys, "full_outer")
    gap = F.array_max(F.zip_with("_n", "_o", lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(1.0))))
    both = F.col("_in_new").isNotNull() & F.col("_in_old").isNotNull()
    return j.groupBy(by).agg(F.max(F.when(both, gap)).alias("max_rel_diff"), F.count_if(both).alias("compared"), F.count_if(~both).alias("unmatched"))


def sampling_checks(fits: DataFrame, expected: int, rhat: float = 1.15, ess: float = 20.0, rhat_median: float = 1.05, ess_median: float = 70.0) -> DataFrame:
    """(check, value, passes) of fits with rhat_max, ess_bulk_min, divergences and error."""
    ok = F.col("rhat_max").isNotNull()
    row = fits.agg(
        (F.count_if(F.col("error").isNotNull()) + F.greatest(F.lit(expected) - F.count("*"), F.lit(0))).alias("failed"),
        F.count_if(ok & (F.col("divergences") > 0)).alias("diverging"), F.count_if(F.col("rhat_max") > rhat).alias("high"), F.count_if(ok & (F.col("ess_bulk_min") < ess)).alias("low"),
        F.median(F.when(ok, F.col("rhat_max"))).alias("rhat_median"), F.median(F.when(ok, F.col("ess_bulk_min"))).alias("ess_median"),
    )
    check = lambda name, value, good: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.coalesce(good, F.lit(False)).alias("passes"))
    c = F.col
    named = [
        check("failed or missing fits", c("failed"), c("failed") == 0), check("fits with a divergence", c("diverging"), c("diverging") == 0),
        check("fits with high R-hat", c("high"), c("high") == 0), check("fits with low ESS", c("low"), c("low") == 0),
        check("median of R-hat", c("rhat_median"), c("rhat_median") <= rhat_median), check("median of ESS", c("ess_median"), c("ess_median") >= ess_median),
    ]
    return row.select(F.inline(F.array(*named)))


def family_diagnostics(summary: DataFrame, parameter: str = "parameter") -> DataFrame:
    """R-hat and ESS by family of parameters: the name without its index in brackets."""
    family = F.regexp_replace(parameter, r"\[.*", "").alias("family")
    return summary.groupBy(family).agg(F.count("*").alias("n"), F.max("r_hat").alias("rhat_max"), F.min("ess_bulk").alias("ess_bulk_min"), F.min("ess_tail").alias("ess_tail_min"))


def embargo_pairs(forecasts: DataFrame, origins: DataFrame, horizons: int, first: str) -> DataFrame:
    """(origin, horizon, problem): embargoed pairs in the forecasts that the rule does not give, and
    those of the rule (origin + horizon - 1 months from `first` on) that the forecasts lack."""
    day = F.lit(first).cast("date")
    found = forecasts.where(F.col("period") >= day).select("origin", F.col("horizon").cast("int").alias("horizon")).distinct()
    rule = origins.select("origin", F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon")).where(F.expr("add_months(origin, horizon - 1)") >= day)
    j = found.withColumn("_f", F.lit(1)).join(rule.withColumn("_r", F.lit(1)), ["origin", "horizon"], "full_outer")
    return j.select("origin", "horizon", F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "extra").alias("problem")).where("problem is not null")


def sealed_scored(scored: DataFrame, first: str) -> DataFrame:
    """How many scored rows are of an embargoed period."""
    return scored.agg(F.count_if(F.col("period") >= F.lit(first).cast("date")).alias("sealed"), F.count("*").alias("rows"))


def rung_summary(scored: DataFrame, reference: DataFrame, model: str = "model") -> DataFrame:
    """One row a model: geometric mean over targets of the relative change in WIS to the reference (winter,
    third month), and the worst deviation of an assessable coverage cell."""
    from tidemark.operators.score import acceptance, coverage_cells

    some = F.col("winter") & (F.col("horizon") == 3)
    mean = scored.where(some).groupBy(model, "target").agg(F.avg("wis").alias("w"))
    base = reference.where(some).groupBy("target").agg(F.avg("wis").alias("_w"))
    gm = mean.join(base, "target").groupBy(model).agg((F.exp(F.avg(F.log(F.col("w") / F.col("_w")))) - 1).alias("gm_wis"))
    return gm.join(acceptance(coverage_cells(scored, [model]), [model]).select(model, "worst"), model, "left")


def retention(rungs: DataFrame, steps: DataFrame, mmd_pct: float, model: str = "model") -> DataFrame:
    """steps (candidate, against): the change in WIS in %, in the worst cell in points, and whether the
    candidate is retained, which needs both to improve, WIS by more than mmd_pct. A step of which a
    side is missing gives no row."""
    side = lambda name, s: rungs.select(F.col(model).alias(name), F.col("gm_wis").alias(f"_g{s}"), F.col("worst").alias(f"_w{s}"))
    j = steps.join(side("candidate", 1), "candidate").join(side("against", 0), "against")
    wis, worst = 100 * ((1 + F.col("_g1")) / (1 + F.col("_g0")) - 1), 100 * (F.col("_w1") - F.col("_w0"))
    return j.select("candidate", "against", wis.alias("wis_pct"), worst.alias("worst_pp"), F.coalesce((wis < -mmd_pct) & (worst < 0), F.lit(False)).alias("retained"))


def minimum_differences(noise: DataFrame, run: str = "floor", of: str = "winter_h3") -> DataFrame:
    """Least differences that mean something, as fractions by target, and their mean ('gm'). noise: run,
    slice, target, mmd_wis_pct, mmd_cov90_pp."""
    n = noise.where((F.col("run") == run) & (F.col("slice") == of)).select("target", (F.col("mmd_wis_pct") / 100).alias("wis"), (F.col("mmd_cov90_pp") / 100).alias("cov90"))
    return n.unionByName(n.agg(F.avg("wis").alias("wis")).withColumn("target", F.lit("gm")), allowMissingColumns=True)


def wis_by_set_and_window(tested: DataFrame, reference: DataFrame, sets: DataFrame, keys: list[str], window: Column) -> DataFrame:
    """Relative WIS by set of origins (set, origin), window ('all' and each value of `window`) and target,
    with the geometric mean over targets as target 'gm'."""
    j = tested.select(*keys, F.col("wis").alias("b")).join(reference.select(*keys, F.col("wis").alias("a")), keys).join(sets, "origin")
    j = j.withColumn("window", F.explode(F.array(F.lit("all"), window)))
    by = j.groupBy("set", "window", "target").agg((F.avg("b") / F.avg("a")).alias("ratio"), F.countDistinct("origin").alias("origins"))
    mean = by.groupBy("set", "window").agg(F.exp(F.avg(F.log("ratio"))).alias("ratio"), F.max("origins").alias("origins")).withColumn("target", F.lit("gm"))
    return by.unionByName(mean).select("set", "window", "target", (F.col("ratio") - 1).alias("rel"), "origins")


def tagged(rows: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Rows with constant columns that say which slice they are; refuses a column that is there with
    another value."""
    for name, value in tags.items():
        if name in rows.columns:
            if not rows.where(~F.col(name).eqNullSafe(F.lit(value))).isEmpty():
                raise ValueError(f"{name} is not {value} throughout")
        else:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def reconciliation_verdicts(pairs: DataFrame) -> DataFrame:
    """pairs: base, level (icb or provider), rel, rel_hi of reconciled against raw. Holds where the icb
    upper bound is below 0 and the provider change at most 2 %."""
    at = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
    one = pairs.groupBy("base").agg(at("icb", "rel_hi").alias("icb_hi"), at("provider", "rel").alias("provider_rel"))
    return one.withColumn("holds", F.coalesce((F.col("icb_hi") < 0) & (F.col("provider_rel") <= 0.02), F.lit(False)))


def config_grid(spark: SparkSession, space: dict[str, tuple], n: int, seed: int = 0) -> DataFrame:
    """n configurations drawn without repeats from the grid of all values (columns as in `space`)."""
    grid = spark.range(1)
    for name, values in space.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    grid = grid.drop("id")
    drawn = grid.orderBy(F.xxhash64(F.lit(seed), *space)).limit(n)  # as many as are asked for
    return drawn.withColumn("config", F.xxhash64(*space))


def seed_grid(tasks: DataFrame, seeds: int) -> DataFrame:
    """Every task with every seed, dealt over tasks of the cluster."""
    return tasks.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))


def quantile_rows(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of quantile arrays: keys, quantile, value."""
    levels = F.array(*map(F.lit, A.LEVELS))
    return forecasts.select(*keys, F.explode(F.arrays_zip(levels.alias("quantile"), F.col("q").alias("value"))).alias("x")).select(*keys, F.col("x.quantile").alias("quantile"), F.col("x.value").alias("value"))
