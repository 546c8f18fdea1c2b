"""Online conformal calibration with delayed feedback, failure marks, ensembles.

forecasts: keys, origin, horizon, q. A truth counts at issuing origin t if it was resolved by t.
Scores live on log1p: how far the truth lies outside a central interval.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.session import ship

ALPHAS = (0.05, 0.10, 0.20, 0.50)
POOL_ORIGINS = 12
POOL_LEAST = 10
KAPPA = 12


def logs(q: Column | str) -> Column:
    return F.transform(F.col(q) if isinstance(q, str) else q, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))


def mark_failed(forecasts: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """failed: nine exact zeros although the last known value is positive."""
    return forecasts.join(last, keys, "left").withColumn("failed", F.coalesce(A.all_zero("q") & (F.col("last_y") > 0), F.lit(False)))


def conformity(forecasts: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an outturn: origin, resolved, horizon, and s, the scores by interval."""
    j = forecasts.where("not failed").join(truth, keys).where("resolved is not null")
    q, y = logs("q"), F.log1p("y_first")
    n = len(A.LEVELS)
    s = F.array(*(F.greatest(F.element_at(q, i + 1) - y, y - F.element_at(q, n - i)) for i in range(len(ALPHAS))))
    return j.withColumn("s", s)


def ranked_pools(scores: DataFrame, origins: DataFrame, by: list[str]) -> DataFrame:
    """origin, by, horizon, i, n, rank and x: the pooled scores of each interval i in order.

    The pool of t holds the scores of the POOL_ORIGINS latest distinct origins with anything
    resolved by t. Which (origin, resolved) belong to a pool is settled on their distinct values;
    scores join these by equality and are ranked within pool and interval, so no pool is collected
    into one row.
    """
    cell = [*by, "horizon", "made", "resolved"]
    rows = scores.withColumnRenamed("origin", "made").select(*cell, "s")
    seen = rows.select(*cell).distinct().join(origins.select("origin"), F.col("resolved") <= F.col("origin"))
    rank = F.dense_rank().over(Window.partitionBy("origin", *by, "horizon").orderBy(F.col("made").desc()))
    pools = seen.withColumn("_r", rank).where(F.col("_r") <= POOL_ORIGINS).drop("_r")
    pool = ["origin", *by, "horizon"]
    each = rows.join(pools, cell).select(*pool, F.posexplode("s").alias("i", "x"))
    among = Window.partitionBy(*pool, "i")
    return each.withColumns({"n": F.count("*").over(among), "rank": F.row_number().over(among.orderBy("x")) - 1}).where(F.col("n") >= POOL_LEAST)


def pooled_widths(scores: DataFrame, origins: DataFrame, by: list[str]) -> DataFrame:
    """origin, by, horizon, n and e (one widening for each interval) from the pooled scores: of each
    pool the two ranks around the wanted level are kept."""
    pool = ["origin", *by, "horizon"]
    each = ranked_pools(scores, origins, by)
    level = F.least(F.lit(1.0), (1 - F.element_at(F.array(*map(F.lit, ALPHAS)), F.col("i") + 1)) * (1 + 1 / F.col("n")))
    share = 1 - F.abs(F.col("rank") - level * (F.col("n") - 1))  # of the ranks beside the level, by nearness
    each = each.withColumn("share", share).where("share > 0")
    widths = [F.sum(F.when(F.col("i") == i, F.col("x") * F.col("share"))) for i in range(len(ALPHAS))]
    return each.groupBy(*pool).agg(F.max("n").alias("n"), F.array(*widths).alias("e"))


def series_widths(scores: DataFrame, pooled: DataFrame, by: list[str], window: int = 36) -> DataFrame:
    """Own widenings of each series, shrunk towards the pooled ones with weight KAPPA."""
    t = pooled.select("origin", *by, "horizon", F.col("e").alias("_pool"))
    seen = scores.withColumnRenamed("origin", "made").join(t, [*by, "horizon"]).where(F.col("resolved") <= F.col("origin"))
    rank = F.row_number().over(Window.partitionBy("origin", *by, "horizon", "series").orderBy(F.col("made").desc()))
    own = seen.withColumn("_r", rank).where(F.col("_r") <= window).groupBy("origin", *by, "horizon", "series").agg(F.collect_list("s").alias("rows"), F.first("_pool").alias("_pool"))
    n = F.size("rows")

    def width(i: int, a: float) -> Column:
        level = F.least(F.lit(1.0), (1 - a) * (1 + 1 / n))
        mine = A.quantile_sorted(F.array_sort(F.transform("rows", lambda r: F.element_at(r, i + 1))), level)
        pool = F.element_at("_pool", i + 1)
        return F.when(n >= F.ceil(F.lit(1 / a)), (n * mine + KAPPA * pool) / (n + KAPPA)).otherwise(pool)

    return own.select("origin", *by, "horizon", "series", n.cast("long").alias("n_own"), F.array(*(width(i, a) for i, a in enumerate(ALPHAS))).alias("e"))


def widen(q: Column | str, e: Column | str) -> Column:
    """Move the bounds of each interval outwards by its widening, on log1p; sort and floor."""
    x, n = logs(q), len(A.LEVELS)
    e = F.col(e) if isinstance(e, str) else e
    moved = [F.element_at(x, i + 1) - F.element_at(e, i + 1) for i in range(len(ALPHAS))]
    moved += [F.element_at(x, len(ALPHAS) + 1)]
    moved += [F.element_at(x, n - i) + F.element_at(e, i + 1) for i in reversed(range(len(ALPHAS)))]
    return A.tidy(F.transform(F.array(*moved), F.expm1))


def apply_widths(forecasts: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Calibrated forecasts; failed ones and those without a pool stay as they are."""
    j = forecasts.join(widths, keys, "left")
    return j.withColumn("q", F.when(F.col("failed") | F.col("e").isNull(), F.col("q")).otherwise(widen("q", "e"))).drop("e")


class Experts:
    """Dynamically tuned adaptive levels of some series: eight step sizes each, weighted by their recent losses.

    Losses are forgotten by steps of the learner, whether or not a series took part in them.
    """

    def __init__(self, a: float, series: int = 1, span: int = 60, k: int = 8):
        self.a, self.gamma, self.sigma, self.span = a, 0.001 * 2.0 ** np.arange(k), 1 / (2 * span), span
        self.alpha, self.w = np.full((series, k), a), np.ones((series, k))
        self.past: list[tuple[int, np.ndarray, np.ndarray]] = []  # step, series, losses

    def level(self) -> np.ndarray:
        return np.clip(1 - (self.w * self.alpha).sum(1) / self.w.sum(1), 0, 1)

    def update(self, beta: np.ndarray, series: np.ndarray, step: int) -> None:
        """A step of the series numbered in `series`, each at most once, with their betas."""
        alpha, w = self.alpha[series], self.w[series]
        gap = beta[:, None] - alpha
        loss = self.a * gap - np.minimum(0, gap)
        self.past = [p for p in self.past if p[0] > step - self.span]
        self.past.append((step, series, (w / w.sum(1, keepdims=True) * loss**2).sum(1)))
        total = np.zeros(len(self.alpha))
        for _, who, x in self.past:
            total[who] += x
        total, k = total[series], alpha.shape[1]
        eta = np.where(total > 0, np.sqrt((np.log(k * self.span) + 2) / np.where(total > 0, total, 1)), 0.0)
        w = w * np.exp(-eta[:, None] * (loss - loss.min(1, keepdims=True)))
        w = (1 - self.sigma) * w + self.sigma / k * w.sum(1, keepdims=True)
        self.w[series] = w / w.sum(1, keepdims=True)
        self.alpha[series] = alpha + self.gamma * (self.a - (alpha > beta[:, None]))


def betas(scores: DataFrame, pools: DataFrame, by: list[str]) -> DataFrame:
    """origin, resolved, by, horizon, series, i and beta: one less the level at which the pool that the
    forecast was issued with reaches its score, between ranks by interpolation.

    Scores and pools stand in one order, in which each score sees the last pooled score up to it, how
    many there are, and the next one.
    """
    pool = ["origin", *by, "horizon", "i"]
    asked = scores.select("origin", "resolved", *by, "horizon", "series", F.posexplode("s").alias("i", "x"))
    known = pools.select(*pool, "x", F.lit(True).alias("pooled"), "n")
    both = known.unionByName(asked.withColumn("pooled", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*pool).orderBy("x", F.col("pooled").desc())
    mine = F.when(F.col("pooled"), F.col("x"))
    back, on = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    seen = both.withColumns({"below": F.count(mine).over(back), "low": F.last(mine, ignorenulls=True).over(back), "high": F.first(mine, ignorenulls=True).over(on), "size": F.max("n").over(Window.partitionBy(*pool))})
    part = F.coalesce((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0))
    level = F.when(F.col("below") == 0, 0.0).when(F.col("below") == F.col("size"), 1.0).otherwise((F.col("below") - 1 + part) / (F.col("size") - 1))
    return seen.where("not pooled and size is not null").select("origin", "resolved", *by, "horizon", "series", "i", (1 - level).alias("beta"))


def adaptive_levels(scores: DataFrame, pools: DataFrame, origins: DataFrame, by: list[str], bucket: int = 500) -> DataFrame:
    """origin, by, horizon, series and its level for each interval at each issuing origin.

    State is kept by series. A learner (by, horizon, interval) takes a step for each origin whose
    forecasts are resolved at an issuing origin, oldest first; steps are numbered over all series, and
    then buckets of about `bucket` series go through them on their own.
    """
    ship(scores.sparkSession)
    issued = [r[0] for r in origins.select("origin").distinct().orderBy("origin").collect()]  # months
    known = betas(scores, pools, by).where(F.col("resolved").isin(issued))
    rows = known.groupBy(*by, "horizon", "series", "origin", "resolved").agg(F.sort_array(F.collect_list(F.struct("i", "beta"))).alias("b"))  # one score's intervals
    step = F.row_number().over(Window.partitionBy(*by, "horizon").orderBy("resolved", "origin"))
    steps = rows.select(*by, "horizon", "origin", "resolved").distinct().withColumn("step", step)  # months by months
    n = max(1, (scores.select("series").distinct().count() + bucket - 1) // bucket)
    dealt = rows.join(F.broadcast(steps), [*by, "horizon", "origin", "resolved"]).withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(n)))
    schema = ", ".join([*(f"{b} string" for b in by), "horizon int, series string, origin date, levels array<double>"])

    def run(table: pa.Table) -> pa.Table:
        names, who = np.unique(np.array(table["series"].to_pylist(), object), return_inverse=True)
        step = table["step"].to_numpy()
        when = np.array(table["resolved"].to_pylist(), object)
        beta = np.array([[x["beta"] for x in b] for b in table["b"].to_pylist()])
        experts = [Experts(a, len(names)) for a in ALPHAS]
        order = np.argsort(step, kind="stable")
        cuts = np.flatnonzero(np.diff(step[order])) + 1
        turns, at, out = [g for g in np.split(order, cuts) if len(g)], 0, []
        for t in issued:
            while at < len(turns) and when[turns[at][0]] <= t:
                rows_ = turns[at]
                for i, e in enumerate(experts):
                    e.update(beta[rows_, i], who[rows_], int(step[rows_[0]]))
                at += 1
            out.append(np.stack([e.level() for e in experts], 1))
        k, m = len(names), len(issued)
        cols = {**{b: [str(table[b][0].as_py())] * (k * m) for b in by}, "horizon": [table["horizon"][0].as_py()] * (k * m), "series": list(names) * m, "origin": [t for t in issued for _ in range(k)], "levels": np.concatenate(out).tolist()}
        types = {**{b: pa.string() for b in by}, "horizon": pa.int32(), "series": pa.string(), "origin": pa.date32(), "levels": pa.list_(pa.float64())}
        return pa.table({c: pa.array(v, types[c]) for c, v in cols.items()})

    read = dealt.select(*by, F.col("horizon").cast("int").alias("horizon"), F.col("series").cast("string").alias("series"), "bucket", "resolved", "step", "b")
    return read.groupBy(*by, "horizon", "bucket").applyInArrow(run, schema)


def adaptive_widths(levels: DataFrame, pools: DataFrame, by: list[str]) -> DataFrame:
    """levels with e: the widening of each interval, between the two pooled scores around the level.
    Origins without a pool give no row."""
    key = ["origin", *by, "horizon", "i"]
    each = levels.select("origin", *by, "horizon", "series", "levels", F.posexplode("levels").alias("i", "level"))
    sizes = pools.groupBy(*key).agg(F.max("n").alias("n"))
    place = F.col("level") * (F.col("n") - 1)
    near = each.join(sizes, key).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).withColumn("share", 1 - F.abs(F.col("rank") - place))
    met = near.join(pools.select(*key, "rank", "x"), [*key, "rank"])
    own = ["origin", *by, "horizon", "series"]
    widths = [F.sum(F.when(F.col("i") == i, F.col("x") * F.col("share"))) for i in range(len(ALPHAS))]
    return met.groupBy(*own, "levels").agg(F.array(*widths).alias("e"))


def ensemble(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Level-wise mean of two forecasts; the second alone where the first is all zero or absent."""
    x = a.select(*keys, F.col("q").alias("_a"))
    y = b.select(*keys, F.col("q").alias("_b"))
    bad = F.col("_a").isNull() | A.all_zero("_a") | F.exists("_a", lambda v: v.isNull())
    return y.join(x, keys, "left").select(*keys, F.when(bad, A.tidy(F.col("_b"))).otherwise(A.mean_of("_a", "_b")).alias("q"))


def aggregate_draws(draws: DataFrame, by: list[str]) -> DataFrame:
    """draws: by and an array of paths' values; sums path by path, then quantiles."""
    one = draws.select(*by, F.posexplode("draws").alias("path", "x")).groupBy(*by, "path").agg(F.sum("x").alias("x"))
    return one.groupBy(*by).agg(F.percentile("x", [float(v) for v in A.LEVELS]).alias("q"))

