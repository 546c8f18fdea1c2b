"""Decisions: a quarterly ratio model with empirical-Bayes shrinkage, occupancy and its costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import LEVELS, Z, normal_quantile, quantile_sorted, uniform
from tidemark.functions.calendar import COVID

WINDOW = 8
BREAK = math.log(1.3)
PRIOR_DF = 4
THRESHOLD = 0.92
ESCALATE = 0.20
COST_RATIOS = (0.1, 0.25, 0.5)


def quarterly(monthly: DataFrame, by: list[str]) -> DataFrame:
    """Sums of quarters of which all three months are there, and their days."""
    q = F.trunc("period", "QUARTER").alias("quarter")
    out = monthly.where("y is not null").groupBy(*by, q).agg(F.sum("y").alias("adm"), F.count("*").alias("n"), F.countDistinct("period").alias("months"))
    return out.where("months = 3").select(*by, "quarter", "adm", F.datediff(F.add_months("quarter", 3), "quarter").cast("long").alias("days"))


def usable(beds: DataFrame, day: str | None = None) -> DataFrame:
    """Latest version known on a day, with beds, outside the excluded window."""
    known = beds if day is None else beds.where(F.col("published") <= F.lit(day).cast("date"))
    latest = known.groupBy("org_code", "quarter").agg(F.max_by("available", "version").alias("available"), F.max_by("occupied", "version").alias("occupied"))
    overlaps = (F.col("quarter") <= F.lit(COVID[1]).cast("date")) & (F.add_months("quarter", 3) > F.lit(COVID[0]).cast("date"))
    return latest.where((F.col("available") > 0) & (F.col("occupied") > 0) & ~overlaps)


def after_breaks(d: DataFrame, values: tuple[str, ...], jump: float = BREAK) -> DataFrame:
    """Of each org the quarters after its last jump in any of the values."""
    w = Window.partitionBy("org_code").orderBy("quarter")
    flag = F.lit(False)
    for v in values:
        flag = flag | (F.abs(F.log(F.col(v)) - F.lag(F.log(F.col(v))).over(w)) > jump)
    marked = d.withColumn("_seg", F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w))
    return marked.withColumn("_last", F.max("_seg").over(Window.partitionBy("org_code"))).where("_seg = _last").drop("_seg", "_last")


def coefficients(d: DataFrame, window: int = WINDOW) -> DataFrame:
    """log_c and s of each org: its mean log ratio shrunk towards that of all, and its spread.

    d has org_code, quarter, occupied, adm, days.
    """
    rank = F.row_number().over(Window.partitionBy("org_code").orderBy(F.col("quarter").desc()))
    y = F.log(F.col("occupied") * F.col("days") / F.col("adm"))
    last = d.withColumn("_r", rank).where(F.col("_r") <= window).withColumn("_y", y)
    own = last.groupBy("org_code").agg(F.avg("_y").alias("ybar"), F.var_samp("_y").alias("s2"), F.count("*").alias("n"))
    weight = F.greatest(F.col("n") - 1, F.lit(0)) + 1e-9
    s2 = F.coalesce("s2", F.lit(0.0))
    pool = own.agg((F.sum(weight * s2) / F.sum(weight)).alias("s2p"), (F.sum(F.col("n") * F.col("ybar")) / F.sum("n")).alias("mu"), F.var_samp("ybar").alias("vy"), F.avg(1 / F.col("n")).alias("inv"))
    pool = pool.select("s2p", "mu", F.greatest(F.coalesce("vy", F.lit(0.0)) - F.col("s2p") * F.col("inv"), F.lit(1e-6)).alias("tau2"))
    j = own.crossJoin(F.broadcast(pool))
    w = F.col("tau2") / (F.col("tau2") + F.col("s2p") / F.col("n"))
    spread = F.sqrt((F.greatest(F.col("n") - 1, F.lit(0)) * s2 + PRIOR_DF * F.col("s2p")) / (F.greatest(F.col("n") - 1, F.lit(0)) + PRIOR_DF))
    return j.select("org_code", "n", (w * F.col("ybar") + (1 - w) * F.col("mu")).alias("log_c"), spread.alias("s"), w.alias("weight"))


def out_of_sample(beds: DataFrame, adm: DataFrame, quarters: DataFrame) -> DataFrame:
    """Reconstructed against published occupancy, each quarter from what was known before it."""
    q = quarters.select(F.col("quarter").alias("at"))
    known = beds.join(F.broadcast(q), (F.col("published") <= F.col("at")) & (F.col("quarter") < F.col("at")))
    known = known.groupBy("at", "org_code", "quarter").agg(F.max_by("occupied", "version").alias("occupied"))
    hist = known.where("occupied > 0").join(adm, ["org_code", "quarter"]).where("adm > 0")
    rank = F.row_number().over(Window.partitionBy("at", "org_code").orderBy(F.col("quarter").desc()))
    c = hist.withColumn("_r", rank).where(F.col("_r") <= WINDOW).groupBy("at", "org_code").agg(F.avg(F.log(F.col("occupied") * F.col("days") / F.col("adm"))).alias("log_c"))
    final = beds.groupBy("org_code", "quarter").agg(F.max_by("available", "version").alias("available"), F.max_by("occupied", "version").alias("occupied"))
    now = final.join(adm, ["org_code", "quarter"]).withColumnRenamed("quarter", "at")
    made = F.exp("log_c") * F.col("adm") / F.col("days") / F.col("available")
    return now.join(c, ["at", "org_code"]).select("at", "org_code", made.alias("reconstructed"), (F.col("occupied") / F.col("available")).alias("published"))


def validation_summary(v: DataFrame, within: float = 0.10) -> DataFrame:
    err = F.abs(F.col("reconstructed") - F.col("published"))
    return v.agg(F.median(err).alias("median_abs"), F.avg((err <= within).cast("double")).alias("share_within"), F.count("*").alias("n"), ((F.median(err) <= 0.05) & (F.avg((err <= within).cast("double")) >= 0.8)).alias("passes"))


def persistence(beds: DataFrame) -> DataFrame:
    """Error of last quarter's and last year's occupancy as predictors."""
    o = beds.groupBy("org_code", "quarter").agg((F.max_by("occupied", "version") / F.max_by("available", "version")).alias("occ"))
    before = lambda k, name: o.select("org_code", F.add_months("quarter", k).alias("quarter"), F.col("occ").alias(name))
    j = o.join(before(3, "prev"), ["org_code", "quarter"], "left").join(before(12, "year"), ["org_code", "quarter"], "left")
    return j.agg(F.median(F.abs(F.col("occ") - F.col("prev"))).alias("median_prev"), F.median(F.abs(F.col("occ") - F.col("year"))).alias("median_year"), F.count("prev").alias("n_prev"), F.count("year").alias("n_year"))


def draws_on_grid(q: Column, n: int = 99) -> Column:
    """Values of a quantile function at n even levels, linear between, log-linear beyond the ends."""
    levels = F.array(*map(F.lit, LEVELS))

    def value(u: Column) -> Column:
        inner = quantile_between(q, levels, u)
        lo, hi = F.element_at(q, 1), F.element_at(q, -1)
        low = F.greatest(lo, F.lit(0.0)) * F.exp(F.log(u / LEVELS[0]) * 0.1)
        high = hi * F.exp(-F.log((1 - u) / (1 - LEVELS[-1])) * 0.1)
        return F.when(u < LEVELS[0], low).when(u > LEVELS[-1], high).otherwise(inner)

    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: value(i / (n + 1)))


def quantile_between(q: Column, levels: Column, u: Column) -> Column:
    """Linear interpolation of (levels, q) at u, u within the levels."""
    i = F.greatest(F.size(F.filter(levels, lambda v: v <= u)), F.lit(1))
    i = F.least(i, F.lit(len(LEVELS) - 1))
    a, b = F.element_at(q, i), F.element_at(q, i + 1)
    la, lb = F.element_at(levels, i), F.element_at(levels, i + 1)
    return a + (b - a) * (u - la) / (lb - la)


def value_at(logs: Column, z: Column) -> Column:
    """The value of a forecast at a standard normal score: the logs of its quantiles lie on lines over the
    scores of their levels, the outermost of which go on into the tails."""
    line = lambda i: F.element_at(logs, i + 1) + (F.element_at(logs, i + 2) - F.element_at(logs, i + 1)) / (Z[i + 1] - Z[i]) * (z - Z[i])
    out = F.when(z < Z[1], line(0))
    for i in range(1, len(Z) - 2):
        out = out.when(z < Z[i + 1], line(i))
    return F.exp(out.otherwise(line(len(Z) - 2)))


def occupied_draws(forecasts: DataFrame, coefs: DataFrame, by: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """forecasts (by, org_code, q, days) with draws of occupied beds: a draw of admissions a day times one
    of the bed days of an admission, whose log is normal around log_c with spread s.

    Both come from hashes of (seed, by, draw): no state, no order, and the same after a lost executor.
    """
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(b).cast("string") for b in by))
    j = forecasts.join(coefs.select("org_code", "log_c", "s"), "org_code").withColumn("_l", F.transform("q", lambda v: F.log(F.greatest(v, F.lit(1e-9))))).withColumn("_k", key)
    # a lambda's variable stands for each number, as an expression would be written out at every use
    scores = lambda which: F.transform(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda k: uniform(F.col("_k"), k, which)), normal_quantile)
    beds = F.zip_with(scores(0), scores(1), lambda z, e: F.exp(F.col("log_c") + F.col("s") * e) * value_at(F.col("_l"), z) / F.col("days"))
    return j.withColumn("draws", beds).drop("_l", "_k")


def breaches(occ: DataFrame, by: list[str]) -> DataFrame:
    """occ: by, draws (occupied beds), beds. Probability over the threshold, and what to open."""
    over = F.aggregate("draws", F.lit(0), lambda a, x: a + (x > THRESHOLD * F.col("beds")).cast("int"))
    p = over / F.size("draws")
    need = quantile_sorted(F.array_sort("draws"), F.lit(1 - ESCALATE)) / THRESHOLD - F.col("beds")
    calls = [(p > r).alias(f"call_{int(100 * r)}") for r in COST_RATIOS]
    return occ.select(*by, p.alias("p_breach"), F.greatest(F.ceil(need), F.lit(0)).cast("long").alias("extra_beds"), *calls)


def expense(rows: DataFrame, ratio: float, p: str = "p", event: str = "event") -> DataFrame:
    """Mean cost of acting whenever p exceeds the cost ratio: the ratio if acted, 1 if missed."""
    cost = F.when(F.col(p) > ratio, ratio).when(F.col(event), 1.0).otherwise(0.0)
    return rows.agg(F.avg(cost).alias("expense"), F.avg(F.pow(F.col(p) - F.col(event).cast("double"), 2)).alias("brier"), F.count("*").alias("n"))
