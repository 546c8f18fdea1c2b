"""Queries from panels to forecasts, scores, calibration and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.calendar import second_thursday
from tidemark.operators import calibrate as C
from tidemark.operators import decide as D
from tidemark.operators import panel as P
from tidemark.operators import copula, quality, reconcile, score, seasonal, stats
from tidemark.operators import vintage as V
from tidemark.plans import testbed as T
from tidemark.plans.queries_vintage import SQL_FINAL, SQL_FR, SQL_TARGETS, W, targets_now
from tidemark.plans.queries_vintage import ORIGINS as SQL_ORIGINS
from tidemark.plans.registry import query, rounded
from tidemark.session import cut

FIRST, LAST = "1998-01-01", "2000-12-01"
BY = ["target", "series"]
GRID = ["origin", "target", "series"]
KEYS = [*GRID, "horizon", "period"]
LV = "[" + ", ".join(map(str, A.LEVELS)) + "]"


def panel_now(spark, d):
    """Final values by group and target on a spine; the values, parents by months, are written once."""
    return P.spine(cut(truth(spark, d)), BY)


def panels_asof(spark, d, *levels):
    """Panels of each level as each origin saw them, from one reading of the lines."""
    o = T.months(spark, FIRST, LAST)
    sums = V.as_of_sums(T.vintages(spark, d, "change"), T.TARGETS, T.hierarchy(spark, d), [*levels], o)
    sums = cut(sums) if len(levels) > 1 else sums  # parents by months
    return [P.spine(V.as_of_parents(sums, T.TARGETS, level, o), GRID) for level in levels]


def truth(spark, d):
    return V.roll_up(targets_now(spark, d).where("y is not null"), T.hierarchy(spark, d), "group_code", ["target", "period"])


def panels_cut(spark, d, level="group_code"):
    """Panels of one level, written once for queries that read them several times."""
    return cut(panels_asof(spark, d, level)[0])


def panels_of_both(spark, d):
    """Panels of groups and regions, each written once."""
    return [cut(p) for p in panels_asof(spark, d, "group_code", "region")]


def forecasts(spark, d, p=None):
    p = p or panels_cut(spark, d)
    return P.seasonal_naive(p, GRID).join(P.mase_scale(p, GRID), GRID, "left").withColumn("model", F.lit("naive"))


def outturns(spark, d):
    """Panels of groups as each origin saw them, and their final values, each written once, from one reading of the lines."""
    o = T.months(spark, FIRST, LAST)
    sums = cut(V.as_of_sums(T.vintages(spark, d, "change"), T.TARGETS, T.hierarchy(spark, d), ["group_code"], o, finals=True))
    return cut(P.spine(V.as_of_parents(sums, T.TARGETS, "group_code", o), GRID)), cut(V.final_parents(sums, T.TARGETS, "group_code"))


def scores(spark, d):
    """Scored rows, and the counts of those left out."""
    p, y = outturns(spark, d)
    return score.score(forecasts(spark, d, p), y, ["target", "series", "period"])


def scored(spark, d):
    return scores(spark, d)[0]


SQL_Y = f"f AS ({SQL_FINAL}), y0 AS (SELECT * FROM ({SQL_TARGETS.format(keys='period, org_code', src='f')}) WHERE y IS NOT NULL), truth AS (SELECT target, coalesce(group_code, 'UNMAPPED') AS series, period, sum(y) AS y FROM y0 LEFT JOIN hier USING (org_code) GROUP BY ALL)"
SQL_PANEL = f"""{SQL_Y}, sp AS (SELECT target, series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT target, series, min(period) AS lo, max(period) AS hi FROM truth GROUP BY ALL)),
 panel AS (SELECT sp.*, y FROM sp LEFT JOIN truth USING (target, series, period))"""
SER = "PARTITION BY target, series ORDER BY period"


def _rows(n: int, to: str = "CURRENT ROW") -> str:
    return f"({SER} ROWS BETWEEN {n} PRECEDING AND {to})"


@query(f"{W}, {SQL_PANEL} SELECT target, series, period, round(y, 6) AS y FROM panel")
def panel_spine(spark, d):
    return rounded(panel_now(spark, d))


@query(f"{W}, {SQL_PANEL}, s AS (SELECT target, series, abs(y - lag(y, 12) OVER ({SER})) AS e FROM panel) SELECT target, series, CASE WHEN count(e) >= 2 THEN round(avg(e), 6) END AS scale FROM s GROUP BY ALL")
def mase_scale(spark, d):
    return rounded(P.mase_scale(panel_now(spark, d), BY))


@query(f"""{W}, {SQL_PANEL} SELECT target, series, period, round(y, 6) AS y, {', '.join(f'round(lag(y, {k}) OVER ({SER}), 6) AS lag{k}' for k in (1, 2, 3, 6, 11, 12))},
 CASE WHEN count(y) OVER {_rows(2)} >= 2 THEN round(avg(y) OVER {_rows(2)}, 6) END AS mean3, CASE WHEN count(y) OVER {_rows(11)} >= 6 THEN round(avg(y) OVER {_rows(11)}, 6) END AS mean12,
 CASE WHEN count(y) OVER {_rows(11)} >= 6 AND count(y) OVER {_rows(23, '12 PRECEDING')} >= 6 AND avg(y) OVER {_rows(23, '12 PRECEDING')} > 0 THEN round(avg(y) OVER {_rows(11)} / avg(y) OVER {_rows(23, '12 PRECEDING')}, 6) END AS growth12,
 count(y) OVER ({SER} ROWS UNBOUNDED PRECEDING) AS history FROM panel""")
def panel_features(spark, d):
    return rounded(P.features(panel_now(spark, d), BY))


@query(f"{W}, {SQL_PANEL} SELECT target, series, max(period) FILTER (WHERE y IS NOT NULL) AS last_period, round(arg_max(y, period) FILTER (WHERE y IS NOT NULL), 6) AS last_y FROM panel GROUP BY ALL")
def last_observed(spark, d):
    return rounded(P.last_observed(panel_now(spark, d), BY))


@query(f"{W}, {SQL_PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY target, series ORDER BY period DESC) AS k FROM panel WHERE y IS NOT NULL) SELECT target, series, round(avg(y), 6) AS recent, count(*) AS n FROM k WHERE k <= 6 GROUP BY ALL")
def recent_mean(spark, d):
    return rounded(P.recent_mean(panel_now(spark, d), BY))


SQL_ORG = f"{SQL_Y}, so AS (SELECT target, series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT target, CAST(org_code AS VARCHAR) AS series, min(period) AS lo, max(period) AS hi FROM y0 GROUP BY ALL)), panel AS MATERIALIZED (SELECT so.*, y FROM so LEFT JOIN (SELECT *, CAST(org_code AS VARCHAR) AS series FROM y0) USING (target, series, period))"


def org_panel(spark, d):
    y = targets_now(spark, d).where("y is not null").select("target", F.col("org_code").cast("string").alias("series"), "period", "y")
    return P.spine(y, BY)


@query(f"""{W}, {SQL_ORG}, n AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN period END IGNORE NULLS) OVER ({SER} ROWS UNBOUNDED PRECEDING) AS pa, first_value(CASE WHEN y IS NOT NULL THEN period END IGNORE NULLS) OVER ({SER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb FROM panel),
 v AS (SELECT n.*, a.y AS ya, b.y AS yb FROM n LEFT JOIN panel a ON a.target = n.target AND a.series = n.series AND a.period = n.pa LEFT JOIN panel b ON b.target = n.target AND b.series = n.series AND b.period = n.pb WHERE pa IS NOT NULL)
 SELECT target, series, period, round(y, 6) AS y, round(coalesce(y, ya + (yb - ya) * datediff('month', pa, period) / datediff('month', pa, pb), ya), 6) AS filled FROM v""")
def interpolated(spark, d):
    return rounded(P.interpolate(org_panel(spark, d), BY))


@query(f"""{W}, {SQL_ORG}, m AS (SELECT *, count(y) OVER {_rows(12, '1 PRECEDING')} AS n, quantile_cont(y, 0.5) OVER {_rows(12, '1 PRECEDING')} AS med FROM panel)
 SELECT target, series, period, round(y, 6) AS y, CASE WHEN NOT (y <= 0 OR coalesce(n >= 6 AND y < 0.1 * med, false)) THEN round(y, 6) END AS y_clean FROM m""")
def implausible_values(spark, d):
    return rounded(P.implausible(org_panel(spark, d), BY))


@query(f"""{W}, {SQL_ORG}, m AS (SELECT *, count(y) OVER {_rows(12, '1 PRECEDING')} AS n, quantile_cont(y, 0.5) OVER {_rows(12, '1 PRECEDING')} AS med FROM panel),
 c AS (SELECT target, series, period, CASE WHEN NOT (y <= 0 OR coalesce(n >= 6 AND y < 0.1 * med, false)) THEN y END AS y FROM m WHERE series IN (SELECT series FROM panel GROUP BY series HAVING count(DISTINCT target) = 3)),
 l AS (SELECT target, series, ln(greatest(avg(y), 1)) AS level FROM (SELECT *, row_number() OVER (PARTITION BY target, series ORDER BY period DESC) AS k FROM c WHERE y IS NOT NULL) WHERE k <= 12 GROUP BY ALL)
 SELECT c.target, c.series, c.period, round(y, 6) AS y, round(coalesce(l.level, 0) - coalesce(f.level, 0), 6) AS offset FROM c LEFT JOIN l USING (target, series) LEFT JOIN l f ON f.series = c.series AND f.target = 'first' AND c.target = 'rest'""")
def prepared_panels(spark, d):
    """All targets of each organisation, cleaned and centred for a joint model."""
    return rounded(P.prepared(org_panel(spark, d), ("all", "first", "rest"), {"rest": "first"}))


@query(f"{W}, {SQL_ORG}, b AS (SELECT *, count(y) OVER {_rows(11, '1 PRECEDING')} AS n FROM panel) SELECT period, count(*) FILTER (WHERE n > 0 AND y IS NULL) AS n_missing, count(y) AS n_present FROM b GROUP BY ALL")
def missing_by_month(spark, d):
    return P.missing_by_month(org_panel(spark, d), BY)


@query(f"{W}, {SQL_ORG}, s AS (SELECT target, series, max(period) FILTER (WHERE y IS NOT NULL) AS last_seen, count(*) AS n_months FROM panel GROUP BY ALL) SELECT * FROM s WHERE last_seen > (SELECT max(period) FROM panel) - INTERVAL 12 MONTH AND n_months >= 24")
def active_series(spark, d):
    return P.active(org_panel(spark, d), BY)


@query(f"""{W}, {SQL_PANEL}, l AS (SELECT target, series, period, ln(CASE WHEN y > 0 THEN y END / avg(y) OVER {_rows(11)}) AS l FROM panel),
 e AS (SELECT target, series, CAST(month(period) AS BIGINT) AS month, avg(l) AS effect FROM l WHERE l IS NOT NULL GROUP BY ALL)
 SELECT target, series, month, round(effect - avg(effect) OVER (PARTITION BY target, series), 6) AS effect FROM e""")
def seasonal_profile(spark, d):
    return rounded(P.seasonal_profile(panel_now(spark, d), BY))


@query(f"""{W}, {SQL_PANEL}, x AS (SELECT target, series, sin(month(period) * {2 * 3.141592653589793 / 12!r}::DOUBLE) AS s, cos(month(period) * {2 * 3.141592653589793 / 12!r}::DOUBLE) AS c, ln(y) AS l FROM panel WHERE y > 0),
 u AS (SELECT target, series, count(*) AS n, sum(s) AS s1, sum(c) AS c1, sum(s * s) AS ss, sum(c * c) AS cc, sum(s * c) AS sc, sum(l) AS l1, sum(s * l) AS sl, sum(c * l) AS cl FROM x GROUP BY ALL HAVING count(*) >= 12),
 v AS (SELECT *, n * (ss * cc - sc * sc) - s1 * (s1 * cc - sc * c1) + c1 * (s1 * sc - ss * c1) AS det FROM u)
 SELECT target, series, n, round((l1 * (ss * cc - sc * sc) - s1 * (sl * cc - sc * cl) + c1 * (sl * sc - ss * cl)) / det, 6) AS mean,
   round((n * (sl * cc - sc * cl) - l1 * (s1 * cc - sc * c1) + c1 * (s1 * cl - sl * c1)) / det, 6) AS b_sin, round((n * (ss * cl - sl * sc) - s1 * (s1 * cl - sl * c1) + l1 * (s1 * sc - ss * c1)) / det, 6) AS b_cos FROM v""")
def seasonal_harmonic(spark, d):
    """The first harmonic of each series' logs by least squares."""
    p = panel_now(spark, d).where("y > 0")
    fit = seasonal.least_squares(p, BY, [F.lit(1.0), *seasonal.fourier("period", 1)], F.log("y")).where("n >= 12")
    return rounded(fit.select(*BY, "n", F.get("b", 0).alias("mean"), F.get("b", 1).alias("b_sin"), F.get("b", 2).alias("b_cos")))


GSER = "PARTITION BY origin, target, series ORDER BY period"
SQL_GP = f"""g AS (SELECT origin, period, org_code, metric, arg_max_null(value, version) AS value FROM vint, {SQL_ORIGINS}
   WHERE snapshot <= {T.sql_thursday('origin')} AND period <= CAST(origin - INTERVAL 1 MONTH AS DATE) GROUP BY ALL),
 gt AS (SELECT * FROM ({SQL_TARGETS.format(keys='origin, period, org_code', src='g')}) WHERE y IS NOT NULL),
 gy AS (SELECT origin, target, coalesce(group_code, 'UNMAPPED') AS series, period, sum(y) AS y FROM gt LEFT JOIN hier USING (org_code) GROUP BY ALL),
 gs AS (SELECT origin, target, series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT origin, target, series, min(period) AS lo, max(period) AS hi FROM gy GROUP BY ALL)),
 gp AS MATERIALIZED (SELECT gs.*, y FROM gs LEFT JOIN gy USING (origin, target, series, period))"""
SQL_B0 = f"""{SQL_GP}, b1 AS (SELECT *, lag(y, 12) OVER ({GSER}) AS past, row_number() OVER ({GSER}) AS k, max(period) OVER (PARTITION BY origin, target, series) AS pend FROM gp),
 b2 AS (SELECT *, CASE WHEN past IS NOT NULL THEN y END AS n, CASE WHEN y IS NOT NULL THEN past END AS o FROM b1),
 b3 AS MATERIALIZED (SELECT *, CASE WHEN k >= 24 AND count(n) OVER w >= 6 AND sum(o) OVER w > 0 THEN sum(n) OVER w / sum(o) OVER w ELSE 1 END AS gr FROM b2 WINDOW w AS ({GSER} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 b4 AS ({' UNION ALL '.join(f"SELECT origin, target, series, {h} AS horizon, period AS made_at, pend, CAST(period + INTERVAL {h} MONTH AS DATE) AS period, lag(y, {12 - h}) OVER ({GSER}) * gr AS point FROM b3" for h in range(1, 7))}),
 be AS MATERIALIZED (SELECT b4.origin, b4.target, b4.series, horizon, ln(gp.y / point) AS e FROM b4 JOIN gp USING (origin, target, series, period) WHERE gp.y > 0 AND point > 0 AND b4.period > CAST(pend - INTERVAL 36 MONTH AS DATE) AND b4.period <= pend),
 bo AS (SELECT origin, target, series, horizon, count(*) AS n, quantile_cont(e, {LV}) AS own FROM be GROUP BY ALL),
 bp AS (SELECT origin, target, horizon, quantile_cont(e, {LV}) AS pooled FROM be GROUP BY ALL),
 sc AS (SELECT origin, target, series, CASE WHEN count(e) >= 2 THEN avg(e) END AS scale FROM (SELECT origin, target, series, abs(y - lag(y, 12) OVER ({GSER})) AS e FROM gp) GROUP BY ALL),
 fc AS MATERIALIZED (SELECT b4.origin, b4.target, b4.series, b4.horizon, b4.period, point, scale, list_transform(CASE WHEN n >= 12 THEN own ELSE pooled END, lambda x: greatest(point * exp(x), 0)) AS q
   FROM b4 LEFT JOIN bo ON (bo.origin, bo.target, bo.series, bo.horizon) = (b4.origin, b4.target, b4.series, b4.horizon) LEFT JOIN bp ON (bp.origin, bp.target, bp.horizon) = (b4.origin, b4.target, b4.horizon)
   LEFT JOIN sc ON (sc.origin, sc.target, sc.series) = (b4.origin, b4.target, b4.series) WHERE made_at = pend AND point IS NOT NULL)"""


def _pit() -> str:
    parts = [f"WHEN y > q[{i}] AND y <= q[{i + 1}] THEN {A.LEVELS[i - 1]} + ({A.LEVELS[i]} - {A.LEVELS[i - 1]}) * CASE WHEN q[{i + 1}] > q[{i}] THEN (y - q[{i}]) / (q[{i + 1}] - q[{i}]) ELSE 1 END" for i in range(8, 0, -1)]
    return f"CASE WHEN y > q[9] THEN 1 {' '.join(parts)} WHEN y = q[1] THEN {A.LEVELS[0]} WHEN y < q[1] THEN 0 END"


WIS = "2 * (" + " + ".join(f"CASE WHEN y >= q[{i}] THEN {t} * (y - q[{i}]) ELSE ({t} - 1) * (y - q[{i}]) END" for i, t in enumerate(A.LEVELS, 1)) + ") / 9"
SQL_SCORED = f"""{SQL_Y}, {SQL_B0}, s AS (SELECT fc.*, truth.y, {WIS} AS wis, abs(y - q[5]) AS abs_err, CASE WHEN scale > 0 THEN abs(y - q[5]) / scale END AS mase, y >= q[4] AND y <= q[6] AS cov50, y >= q[2] AND y <= q[8] AS cov90, {_pit()} AS pit, month(fc.period) IN (12, 1, 2, 3) AS winter
   FROM fc JOIN truth USING (target, series, period) WHERE q IS NOT NULL AND (scale IS NULL OR scale > 0))"""


@query(f"{W}, {SQL_B0} SELECT origin, target, series, horizon, period, round(point, 3) AS point, round(q[1], 3) AS q_lo, round(q[5], 3) AS q_mid, round(q[9], 3) AS q_hi FROM fc")
def seasonal_naive_backtest(spark, d):
    f = forecasts(spark, d)
    return rounded(f.select(*KEYS, "point", A.at("q", 0.025).alias("q_lo"), A.at("q", 0.5).alias("q_mid"), A.at("q", 0.975).alias("q_hi")), 3)


@query(f"{W}, {SQL_SCORED} SELECT origin, target, series, horizon, period, round(wis, 4) AS wis, round(abs_err, 4) AS abs_err, round(mase, 4) AS mase, cov50, cov90, round(pit, 4) AS pit, winter FROM s")
def scored_rows(spark, d):
    return rounded(scored(spark, d).select(*KEYS, "wis", "abs_err", "mase", "cov50", "cov90", "pit", "winter"), 4)


@query(f"{W}, {SQL_SCORED} SELECT count(*) AS n, round(max(abs(wis - wis2)), 6) AS gap FROM (SELECT *, {WIS} AS wis2 FROM s)")
def wis_identity(spark, d):
    s = scored(spark, d)
    return s.agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("wis") - A.wis_from_intervals("q", "y"))), 6).alias("gap"))


@query(f"{W}, {SQL_Y}, {SQL_B0} SELECT count(*) FILTER (WHERE q IS NULL) AS no_forecast, count(*) FILTER (WHERE q IS NOT NULL AND y IS NULL) AS no_outturn, count(*) FILTER (WHERE q IS NOT NULL AND y IS NOT NULL AND scale IS NOT NULL AND NOT scale > 0) AS degenerate, count(*) FILTER (WHERE q IS NOT NULL AND y IS NOT NULL AND (scale IS NULL OR scale > 0)) AS scored FROM fc LEFT JOIN truth USING (target, series, period)")
def score_drops(spark, d):
    return scores(spark, d)[1]


SUM_SQL = "round(avg(wis), 4) AS wis, round(avg(abs_err), 4) AS mae, round(avg(mase), 4) AS mase, round(avg(CAST(cov50 AS INT)), 4) AS cov50, round(avg(CAST(cov90 AS INT)), 4) AS cov90, count(*) AS n"


@query(f"{W}, {SQL_SCORED} SELECT target, horizon, {SUM_SQL} FROM s GROUP BY ALL")
def score_summary(spark, d):
    return rounded(score.summarise(scored(spark, d), ["target", "horizon"]), 4)


@query(f"{W}, {SQL_SCORED} SELECT slice, target, {SUM_SQL} FROM (SELECT *, unnest(CASE WHEN winter AND horizon = 3 THEN ['all', 'winter_h3'] ELSE ['all'] END) AS slice FROM s) GROUP BY ALL")
def overlapping_slices(spark, d):
    s = scored(spark, d).withColumn("slice", F.explode(F.when(F.col("winter") & (F.col("horizon") == 3), F.array(F.lit("all"), F.lit("winter_h3"))).otherwise(F.array(F.lit("all")))))
    return rounded(score.summarise(s, ["slice", "target"]), 4)


SQL_CELLS = f"{SQL_SCORED}, cells AS (SELECT target, CAST(year(origin) AS BIGINT) AS year, horizon, avg(CAST(cov90 AS INT)) AS cov90, count(DISTINCT origin) AS origins FROM s GROUP BY ALL)"


@query(f"{W}, {SQL_CELLS} SELECT target, year, horizon, round(cov90, 6) AS cov90, origins, CASE WHEN origins >= 6 THEN cov90 BETWEEN 0.85 AND 0.95 END AS in_band FROM cells")
def coverage_cells(spark, d):
    return rounded(score.coverage_cells(scored(spark, d), ["target"]))


@query(f"{W}, {SQL_CELLS} SELECT target, round(max(CASE WHEN origins >= 6 THEN abs(cov90 - 0.9) END), 6) AS worst, count(*) FILTER (WHERE origins >= 6 AND cov90 BETWEEN 0.85 AND 0.95) AS n_in, count(*) FILTER (WHERE origins >= 6) AS n_judged FROM cells GROUP BY ALL")
def coverage_acceptance(spark, d):
    return rounded(score.acceptance(score.coverage_cells(scored(spark, d), ["target"]), ["target"]))


@query(f"{W}, {SQL_SCORED} SELECT target, \"window\", round(avg(CAST(cov90 AS INT)), 6) AS cov90, count(*) AS n FROM (SELECT *, unnest(['all', CASE WHEN origin BETWEEN DATE '2020-03-01' AND DATE '2021-06-01' OR period BETWEEN DATE '2020-03-01' AND DATE '2021-06-01' THEN 'inside' ELSE 'outside' END]) AS \"window\" FROM s) GROUP BY ALL")
def coverage_by_window(spark, d):
    return rounded(score.coverage_by_window(scored(spark, d), ["target"]))


@query(f"{W}, {SQL_SCORED} SELECT target, CAST(least(floor(pit * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL")
def pit_histogram(spark, d):
    return score.pit_histogram(scored(spark, d), ["target"])


@query(f"""{W}, {SQL_SCORED}, h AS (SELECT target, CAST(least(floor(pit * 10), 9) AS BIGINT) AS bin FROM s), t AS (SELECT target, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE bin = {i}) AS b{i}' for i in range(10))} FROM h GROUP BY ROLLUP (target))
 SELECT target, n, round({' + '.join(f'(b{i} - n / 10.0) * (b{i} - n / 10.0) / (n / 10.0)' for i in range(10))}, 4) AS chi2, round(b0 / n, 4) AS low_tail, round(b9 / n, 4) AS high_tail FROM t""")
def pit_summary(spark, d):
    return rounded(score.pit_summary(scored(spark, d), ["target"]), 4)


@query(f"{W}, {SQL_SCORED}, o AS (SELECT origin, sum(wis) AS w, count(*) AS n FROM s GROUP BY ALL) SELECT a.origin AS dropped, round(sum(b.w) / sum(b.n), 4) AS wis FROM o a JOIN o b ON a.origin <> b.origin GROUP BY ALL")
def leave_one_origin_out(spark, d):
    s = scored(spark, d)
    out = score.leave_one_out(s, s.select("origin").distinct(), {"w": F.col("wis"), "n": F.lit(1)})
    return rounded(out.select("dropped", (F.col("w") / F.col("n")).alias("wis")), 4)


@query(f"{W}, {SQL_SCORED}, m AS (SELECT series, avg(mase) AS m FROM s GROUP BY ALL) SELECT series, CAST(row_number() OVER (ORDER BY m, series) AS BIGINT) AS rank FROM m WHERE m IS NOT NULL")
def series_ranking(spark, d):
    s = scored(spark, d).withColumn("model", F.col("series"))
    return score.rank_models(s.where("mase is not null")).select(F.col("model").alias("series"), "rank")


@query(f"""{W}, {SQL_SCORED}, m AS (SELECT avg(abs_err) AS mean, count(*) AS n FROM s), u AS (SELECT series, sum(abs_err - mean) AS u FROM s, m GROUP BY series)
 SELECT round(any_value(mean), 4) AS mean, round(sqrt(count(*) / (count(*) - 1) * sum(u * u)) / any_value(n), 4) AS se, count(*) AS clusters, any_value(n) AS n FROM u, m""")
def cluster_mean(spark, d):
    return rounded(score.cluster_mean(cut(scored(spark, d)), "abs_err", "series"), 4)


@query(f"""{W}, {SQL_SCORED}, fit AS (SELECT regr_slope(abs_err, horizon) AS b, regr_intercept(abs_err, horizon) AS a, avg(horizon) AS mx, regr_sxx(abs_err, horizon) AS sxx, count(*) AS n FROM s),
 u AS (SELECT series, sum((horizon - mx) * (abs_err - a - b * horizon)) AS u FROM s, fit GROUP BY series)
 SELECT round(any_value(b), 4) AS slope, round(sqrt(count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 2) * sum(u * u)) / any_value(sxx), 4) AS se, count(*) AS clusters FROM u, fit""")
def cluster_slope(spark, d):
    return rounded(score.cluster_slope(cut(scored(spark, d)), "abs_err", "horizon", "series"), 4)


SQL_MODELS = f"{SQL_SCORED}, m2 AS (SELECT *, 'naive' AS model FROM s UNION ALL SELECT * REPLACE (wis * (0.9 + 0.02 * horizon) AS wis, mase * (0.9 + 0.02 * horizon) AS mase), 'other' FROM s)"


def two_models(spark, d):
    """The naive scores, and a stand-in that is better near and worse far."""
    s = cut(scored(spark, d))
    k = 0.9 + 0.02 * F.col("horizon")
    return s.unionByName(s.withColumns({"model": F.lit("other"), "wis": F.col("wis") * k, "mase": F.col("mase") * k}))


@query(f"{W}, {SQL_MODELS}, t AS (SELECT model, target, avg(wis) AS m FROM m2 GROUP BY ALL) SELECT round(exp(avg(ln(1 + (o.m / n.m - 1)))) - 1, 6) AS gm FROM t o JOIN t n USING (target) WHERE o.model = 'other' AND n.model = 'naive'")
def geometric_mean_change(spark, d):
    return rounded(score.geometric_mean_change(score.relative_scores(two_models(spark, d), "other", "naive", ["target"]), []))


@query(f"{W}, {SQL_MODELS}, u AS (SELECT origin, avg(wis) FILTER (WHERE model = 'naive') AS a, avg(wis) FILTER (WHERE model = 'other') AS b FROM m2 GROUP BY ALL) SELECT round(avg(b - a), 4) AS diff, round(avg(b) / avg(a) - 1, 6) AS rel, count(*) AS units FROM u")
def paired_difference(spark, d):
    m = two_models(spark, d)
    of = lambda n: m.where(F.col("model") == n)
    out = score.paired_difference(of("naive"), of("other"), KEYS, "origin")
    return out.select(F.round("diff", 4).alias("diff"), F.round("rel", 6).alias("rel"), "units")


@query(f"{W}, {SQL_MODELS}, p AS (SELECT model, horizon, avg(wis) AS w, avg(mase) AS m FROM m2 GROUP BY ALL) SELECT model, horizon FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.w <= a.w AND b.m <= a.m AND (b.w < a.w OR b.m < a.m))")
def pareto_front(spark, d):
    p = two_models(spark, d).groupBy("model", "horizon").agg(F.avg("wis").alias("w"), F.avg("mase").alias("m"))
    return score.pareto(p, "w", "m").select("model", "horizon")


@query(f"""{W}, {SQL_MODELS}, now AS (SELECT target, horizon, avg(CAST(cov90 AS INT)) AS v FROM s WHERE month(origin) > 6 GROUP BY ALL), dev AS (SELECT target, min(v) AS lo, max(v) AS hi FROM (SELECT target, horizon, avg(CAST(cov90 AS INT)) AS v FROM s WHERE month(origin) <= 6 GROUP BY ALL) GROUP BY ALL)
 SELECT now.target, horizon, CASE WHEN lo IS NULL THEN 'absent' WHEN v < lo THEN 'below' WHEN v > hi THEN 'above' ELSE 'within' END AS flag FROM now LEFT JOIN dev USING (target)""")
def development_flags(spark, d):
    c = scored(spark, d).groupBy("target", "horizon", (F.month("origin") > 6).alias("late")).agg(F.avg(F.col("cov90").cast("double")).alias("v"))
    return score.dev_flags(c.where("late").drop("late"), c.where("not late").select("target", "v"), ["target"], "v").select("target", "horizon", "flag")


@query(f"""{W}, {SQL_CELLS}, t AS (SELECT target, horizon, cov90, cov90 - 0.03 AS lo, cov90 + 0.03 AS hi FROM cells)
 SELECT target, CASE WHEN bool_or(hi < 0.85 OR lo > 0.95) THEN 'outside tolerance' WHEN bool_and(lo >= 0.85 AND hi <= 0.95) THEN 'within tolerance' ELSE 'inconclusive' END AS verdict,
 CASE WHEN bool_or(horizon >= 4 AND NOT cov90 BETWEEN 0.85 AND 0.95) THEN 'confirmed' WHEN NOT bool_or(NOT cov90 BETWEEN 0.85 AND 0.95) THEN 'refuted' ELSE 'neither' END AS late_horizons FROM t GROUP BY ALL""")
def coverage_verdicts(spark, d):
    t = score.coverage_cells(scored(spark, d), ["target"]).withColumns({"lo": F.col("cov90") - 0.03, "hi": F.col("cov90") + 0.03})
    return score.verdict_primary(t, ["target"]).join(score.verdict_late_horizons(t, ["target"]).withColumnRenamed("verdict", "late_horizons"), "target")


def with_failures(f, p):
    """Forecasts with some made to fail, and the last values that G1 looks at."""
    f = f.withColumn("q", F.when((F.pmod(F.month("origin") + F.col("horizon"), F.lit(7)) == 0) & (F.col("target") == "first"), F.transform("q", lambda x: x * 0)).otherwise(F.col("q")))
    last = P.last_observed(p, GRID).select(*GRID, "last_y")
    return C.mark_failed(f, last, GRID)


@query(f"{W}, {SQL_B0}, z AS (SELECT *, target = 'first' AND (month(origin) + horizon) % 7 = 0 AS zero FROM fc), l AS (SELECT origin, target, series, arg_max(y, period) FILTER (WHERE y IS NOT NULL) AS last_y FROM gp GROUP BY ALL) SELECT target, horizon, count(*) FILTER (WHERE (zero OR list_max(q) = 0) AND last_y > 0) AS failed, count(*) AS n FROM z LEFT JOIN l USING (origin, target, series) WHERE q IS NOT NULL GROUP BY ALL")
def failed_forecasts(spark, d):
    p = panels_cut(spark, d)
    return with_failures(forecasts(spark, d, p), p).where("q is not null").groupBy("target", "horizon").agg(F.count_if("failed").alias("failed"), F.count("*").alias("n"))


def release(p):
    """First values of groups, and the origin at which they were resolved."""
    return p.where("y is not null").groupBy("target", "series", "period").agg(F.min("origin").alias("resolved"), F.min_by("y", "origin").alias("y_first"))


def conformal_scores(spark, d, p=None, f=None):
    p = p or panels_cut(spark, d)
    f = f or forecasts(spark, d, p)
    return C.conformity(f.withColumn("failed", F.lit(False)), release(p), ["target", "series", "period"])


SQL_REL = "rel AS (SELECT target, series, period, min(origin) AS resolved, arg_min(y, origin) AS y_first FROM gp WHERE y IS NOT NULL GROUP BY ALL)"
_s = [f"greatest(ln(1 + greatest(q[{i}], 0)) - ln(1 + y_first), ln(1 + y_first) - ln(1 + greatest(q[{10 - i}], 0)))" for i in (1, 2, 3, 4)]
_w = [f"quantile_cont(s{i}, least(1, (1 - {a}) * (1 + 1 / n)))" for i, a in enumerate(C.ALPHAS, 1)]
SQL_POOL = f"""{SQL_B0}, {SQL_REL}, cs AS (SELECT fc.*, resolved, {', '.join(f'{x} AS s{i}' for i, x in enumerate(_s, 1))} FROM fc JOIN rel USING (target, series, period) WHERE q IS NOT NULL),
 pr AS (SELECT o.origin AS t, cs.*, dense_rank() OVER (PARTITION BY o.origin, target, horizon ORDER BY cs.origin DESC) AS k FROM cs JOIN {SQL_ORIGINS} o ON cs.resolved <= o.origin),
 pl AS (SELECT t, target, horizon, count(*) AS n, {', '.join(f'list_sort(list(s{i})) AS l{i}' for i in (1, 2, 3, 4))} FROM pr WHERE k <= 12 GROUP BY ALL HAVING count(*) >= 10)"""


def _interp(i: int, a: float) -> str:
    p = f"((n - 1) * least(1, (1 - {a}) * (1 + 1 / n)))"
    lo = f"CAST(floor{p} AS INT)"
    return f"l{i}[{lo} + 1] + (l{i}[least({lo} + 2, n)] - l{i}[{lo} + 1]) * ({p} - {lo})"


@query(f"{W}, {SQL_POOL} SELECT t AS origin, target, horizon, n, {', '.join(f'round({_interp(i, a)}, 6) AS e{i}' for i, a in enumerate(C.ALPHAS, 1))} FROM pl")
def pooled_conformal_widths(spark, d):
    w = C.pooled_widths(conformal_scores(spark, d), T.months(spark, FIRST, LAST), ["target"])
    return rounded(w.select("origin", "target", "horizon", "n", *(F.element_at("e", i).alias(f"e{i}") for i in (1, 2, 3, 4))))


@query(f"{W}, {SQL_POOL} SELECT t AS origin, target, horizon, string_agg(DISTINCT strftime(origin, '%Y-%m'), ',' ORDER BY strftime(origin, '%Y-%m')) AS pooled FROM pr WHERE k <= 12 GROUP BY ALL")
def pool_trace(spark, d):
    s = conformal_scores(spark, d).withColumnRenamed("origin", "made").select("made", "target", "horizon", "resolved").distinct()
    seen = s.join(T.months(spark, FIRST, LAST), F.col("resolved") <= F.col("origin"))
    rank = F.dense_rank().over(V.Window.partitionBy("origin", "target", "horizon").orderBy(F.col("made").desc()))
    kept = seen.withColumn("_r", rank).where(F.col("_r") <= C.POOL_ORIGINS)
    return kept.groupBy("origin", "target", "horizon").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("made", "yyyy-MM"))), ",").alias("pooled"))


SQL_PW = f"pw AS (SELECT t, target, horizon, n, {', '.join(f'{_interp(i, a)} AS e{i}' for i, a in enumerate(C.ALPHAS, 1))} FROM pl)"
_x = [f"ln(1 + greatest(q[{i}], 0))" for i in range(1, 10)]
_moved = ", ".join([*(f"{_x[i - 1]} - e{i}" for i in (1, 2, 3, 4)), _x[4], *(f"{_x[9 - i]} + e{i}" for i in (4, 3, 2, 1))])


@query(f"""{W}, {SQL_POOL}, {SQL_PW}, l AS (SELECT origin, target, series, arg_max(y, period) FILTER (WHERE y IS NOT NULL) AS last_y FROM gp GROUP BY ALL),
 z AS (SELECT fc.* REPLACE (CASE WHEN target = 'first' AND (month(origin) + horizon) % 7 = 0 THEN list_transform(q, lambda x: x * 0) ELSE q END AS q), last_y FROM fc LEFT JOIN l USING (origin, target, series)),
 c AS (SELECT z.origin, z.target, z.series, z.horizon, z.period, CASE WHEN coalesce(list_max(q) = 0 AND list_min(q) = 0 AND last_y > 0, false) OR e1 IS NULL THEN q ELSE list_sort(list_transform([{_moved}], lambda x: greatest(exp(x) - 1, 0))) END AS q
       FROM z LEFT JOIN pw ON (pw.t, pw.target, pw.horizon) = (z.origin, z.target, z.horizon))
 SELECT origin, target, series, horizon, period, round(q[2], 4) AS lo, round(q[8], 4) AS hi FROM c""")
def calibrated_forecasts(spark, d):
    """Pooled conformal calibration applied to all forecasts."""
    p = panels_cut(spark, d)
    f = cut(forecasts(spark, d, p))
    w = C.pooled_widths(conformal_scores(spark, d, p, f), T.months(spark, FIRST, LAST), ["target"]).select("origin", "target", "horizon", "e")
    out = C.apply_widths(with_failures(f, p), w, ["origin", "target", "horizon"])
    return rounded(out.select(*KEYS, A.at("q", 0.05).alias("lo"), A.at("q", 0.95).alias("hi")), 4)


@query(f"""{W}, {SQL_POOL}, {SQL_PW}, so AS (SELECT pw.t, cs.target, cs.horizon, cs.series, s2, e2, row_number() OVER (PARTITION BY pw.t, cs.target, cs.horizon, cs.series ORDER BY cs.origin DESC) AS k FROM cs JOIN pw ON (pw.target, pw.horizon) = (cs.target, cs.horizon) AND cs.resolved <= pw.t),
 sw AS (SELECT t, target, horizon, series, count(*) AS n, any_value(e2) AS e2, list_sort(list(s2)) AS l2 FROM so WHERE k <= 36 GROUP BY ALL)
 SELECT t AS origin, target, horizon, series, n AS n_own, round(CASE WHEN n >= 10 THEN (n * ({_interp(2, 0.1)}) + {C.KAPPA} * e2) / (n + {C.KAPPA}) ELSE e2 END, 6) AS e90 FROM sw""")
def series_conformal_widths(spark, d):
    s = cut(conformal_scores(spark, d))
    w = C.series_widths(s, C.pooled_widths(s, T.months(spark, FIRST, LAST), ["target"]), ["target"])
    return rounded(w.select("origin", "target", "horizon", "series", "n_own", F.element_at("e", 2).alias("e90")))


_eight = lambda x: f"list_transform(range(1, 9), lambda j: {x})"
SQL_ADAPTIVE = f"""ai AS (SELECT cs.target, cs.horizon, cs.series, cs.origin, cs.resolved, i, [{', '.join(map(str, C.ALPHAS))}][i] AS a, [s1, s2, s3, s4][i] AS s, CASE i WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l4 END AS pool, n
   FROM cs JOIN pl ON (pl.t, pl.target, pl.horizon) = (cs.origin, cs.target, cs.horizon), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE cs.resolved IN (SELECT origin FROM {SQL_ORIGINS})),
 ac AS (SELECT *, len(list_filter(pool, lambda x: x <= s)) AS c FROM ai),
 ab AS MATERIALIZED (SELECT *, 1 - CASE WHEN c = 0 THEN 0 WHEN c = n THEN 1 ELSE (c - 1 + (s - pool[c]) / (pool[c + 1] - pool[c])) / (n - 1) END AS beta,
   dense_rank() OVER (PARTITION BY target, horizon ORDER BY resolved, origin) AS step, row_number() OVER (PARTITION BY target, horizon, series, i ORDER BY resolved, origin) AS k FROM ac),
 ae AS (SELECT DISTINCT target, horizon, series, i, CAST(0 AS BIGINT) AS k, CAST('1900-01-01' AS DATE) AS resolved, {_eight('CAST(a AS DOUBLE)')} AS alpha, {_eight('CAST(1 AS DOUBLE)')} AS w, CAST([] AS STRUCT(step BIGINT, x DOUBLE)[]) AS past FROM ab
   UNION ALL
   SELECT target, horizon, series, i, k, resolved, {_eight('alpha[j] + 0.001 * pow(2, j - 1) * (a - CASE WHEN alpha[j] > beta THEN 1 ELSE 0 END)')}, list_transform(v, lambda x: x / list_sum(v)), past2
   FROM (SELECT *, list_transform(u, lambda x: (1 - 1 / 120.0::DOUBLE) * x + list_sum(u) / 960) AS v
   FROM (SELECT *, {_eight('w[j] * exp(-(CASE WHEN total > 0 THEN sqrt((ln(480) + 2) / total) ELSE 0 END) * (loss[j] - list_min(loss)))')} AS u
   FROM (SELECT *, list_sum(list_transform(past2, lambda p: p.x)) AS total
   FROM (SELECT *, list_append(list_filter(past, lambda p: p.step > m.step - 60), {{'step': m.step, 'x': list_sum({_eight('w[j] / list_sum(w) * loss[j] * loss[j]')})}}) AS past2
   FROM (SELECT ab.target, ab.horizon, ab.series, ab.i, ab.k, ab.resolved, ab.a, ab.beta, ab.step, ae.alpha, ae.w, ae.past, {_eight('ab.a * (ab.beta - ae.alpha[j]) - least(0, ab.beta - ae.alpha[j])')} AS loss
     FROM ae JOIN ab ON (ab.target, ab.horizon, ab.series, ab.i) = (ae.target, ae.horizon, ae.series, ae.i) AND ab.k = ae.k + 1) m))))),
 al AS (SELECT o.origin, target, horizon, series, i, arg_max({{'alpha': alpha, 'w': w}}, k) AS z FROM ae JOIN {SQL_ORIGINS} o ON ae.resolved <= o.origin GROUP BY ALL),
 av AS (SELECT al.origin, al.target, al.horizon, series, i, n, CASE i WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l4 END AS pool, least(1, greatest(0, 1 - list_sum({_eight('z.w[j] * z.alpha[j]')}) / list_sum(z.w))) AS level
   FROM al JOIN pl ON (pl.t, pl.target, pl.horizon) = (al.origin, al.target, al.horizon)),
 aw AS (SELECT *, CAST(floor(level * (n - 1)) AS INT) AS lo FROM av)"""


@query(f"""{W.replace('WITH ', 'WITH RECURSIVE ', 1)}, {SQL_POOL}, {SQL_ADAPTIVE}
 SELECT origin, target, horizon, series, {', '.join(f'max(CASE WHEN i = {i} THEN round(level, 6) END) AS level{i}, max(CASE WHEN i = {i} THEN round(pool[lo + 1] + (pool[least(lo + 2, n)] - pool[lo + 1]) * (level * (n - 1) - lo), 6) END) AS e{i}' for i in (1, 2, 3, 4))} FROM aw GROUP BY ALL""")
def adaptive_conformal_levels(spark, d):
    """Levels of every series, and the widenings that they give within the pools."""
    s = cut(conformal_scores(spark, d))
    o = T.months(spark, FIRST, LAST)
    pools = cut(C.ranked_pools(s, o, ["target"]))
    levels = C.adaptive_levels(s, pools, o, ["target"])
    w = C.adaptive_widths(levels, pools, ["target"])
    return rounded(w.select("origin", "target", "horizon", "series", *(F.element_at(c, i).alias(f"{name}{i}") for i in (1, 2, 3, 4) for c, name in (("levels", "level"), ("e", "e")))))


@query(None)
def two_way_differences(spark, d):
    """Coverage of the stand-in less that of the naive model, both drawn alike."""
    s = cut(scored(spark, d))
    wider = s.withColumn("cov90", F.col("cov90") | (F.col("pit") > 0.02) & (F.col("pit") < 0.98))
    return rounded(stats.two_way_difference(s, wider, ["target", "horizon"], "series", "origin", "cov90"))


@query(None)
def joint_bootstrap(spark, d):
    m = cut(two_models(spark, d))
    of = lambda n: m.where(F.col("model") == n)
    return rounded(stats.joint_bootstrap(of("naive"), of("other"), KEYS, "origin", "target"))


@query(None)
def paired_bootstrap(spark, d):
    m = two_models(spark, d)
    of = lambda n: m.where(F.col("model") == n)
    return rounded(stats.paired_bootstrap(of("naive"), of("other"), KEYS, "origin", ["target"]), 6)


@query(None)
def two_way_bootstrap(spark, d):
    return rounded(stats.two_way_share(scored(spark, d), ["target", "horizon"], "series", "origin", "cov90"), 6)


@query(f"{W}, {SQL_B0}, e AS (SELECT origin, target, series, horizon, period, list_transform(list_zip(q, list_transform(q, lambda x: x * 1.1)), lambda z: (z[1] + z[2]) / 2) AS q FROM fc WHERE q IS NOT NULL) SELECT origin, target, series, horizon, period, round(q[1], 4) AS lo, round(q[5], 4) AS mid, round(q[9], 4) AS hi FROM e")
def vincentised_ensemble(spark, d):
    f = forecasts(spark, d).where("q is not null")
    g = f.withColumn("q", F.transform("q", lambda x: x * 1.1))
    e = C.ensemble(f, g, KEYS)
    return rounded(e.select(*KEYS, A.at("q", 0.025).alias("lo"), A.at("q", 0.5).alias("mid"), A.at("q", 0.975).alias("hi")), 4)


def levels_of_forecasts(spark, d, p, regions):
    """Naive forecasts of groups and regions, independently made."""
    out = forecasts(spark, d, p).select(F.lit("org").alias("level"), *KEYS, "q")
    return out.unionByName(P.seasonal_naive(regions, GRID).select(F.lit("region").alias("level"), *KEYS, "q"))


SQL_REG = SQL_B0.replace("group_code", "region")
SQL_RFC = SQL_REG[SQL_REG.index("gy AS"):]


@query(f"""{W}, {SQL_B0}, {' '.join(SQL_RFC.split()).replace('gy', 'ry').replace('gs', 'rs').replace('gp', 'rp').replace('b1', 'r1').replace('b2', 'r2').replace('b3', 'r3').replace('b4', 'r4').replace(' be ', ' re ').replace('bo', 'ro').replace('bp', 'rq').replace(' sc ', ' rsc ').replace('sc.', 'rsc.').replace('fc AS', 'rfc AS')},
 c AS (SELECT origin, target, horizon, period, region AS series, sum(q[5]) AS child, count(*) AS children FROM fc JOIN (SELECT DISTINCT group_code, region FROM hier) h ON h.group_code = series GROUP BY ALL)
 SELECT rfc.origin, rfc.target, rfc.horizon, rfc.period, rfc.series, round(rfc.q[5], 4) AS m, round(child, 4) AS child, children, CASE WHEN rfc.q[5] > 0 THEN round(abs(rfc.q[5] - child) / rfc.q[5], 4) END AS gap FROM rfc JOIN c ON (c.origin, c.target, c.horizon, c.period, c.series) = (rfc.origin, rfc.target, rfc.horizon, rfc.period, rfc.series)""")
def coherence_gaps(spark, d):
    parents = T.hierarchy(spark, d).select(F.col("group_code").alias("org_code"), "region").distinct()
    return rounded(reconcile.coherence_gaps(levels_of_forecasts(spark, d, *panels_of_both(spark, d)), parents, "region", ["origin", "target", "horizon", "period"]), 4)


@query(None)
def reconciled_forecasts(spark, d):
    """MinT over groups and regions; the result adds up at every quantile's median projection."""
    p, regions = panels_of_both(spark, d)
    f = cut(levels_of_forecasts(spark, d, p, regions))
    pairs = T.hierarchy(spark, d).select("group_code", "region").distinct().collect()  # dimension rows
    parents: dict[str, tuple[str, ...]] = {}
    for g, reg in pairs:
        parents[reg] = (*parents.get(reg, ()), g)
    known = release(p).unionByName(release(regions))
    e = f.join(known, ["target", "series", "period"]).select("target", "horizon", "series", F.col("origin").alias("made"), "resolved", (F.col("y_first") - A.at("q", 0.5)).alias("e"))
    # which origins' errors an origin knows is settled on their distinct values
    seen = e.select("target", "horizon", "made", "resolved").distinct().join(T.months(spark, FIRST, LAST), F.col("resolved") <= F.col("origin"))
    rank = F.dense_rank().over(V.Window.partitionBy("target", "horizon", "origin").orderBy(F.col("made").desc()))
    seen = seen.withColumn("_r", rank).where(F.col("_r") <= reconcile.ERROR_ORIGINS).drop("_r")
    errors = e.join(seen, ["target", "horizon", "made", "resolved"])
    out = reconcile.reconcile(f, errors, parents, ["target", "horizon", "origin"])
    return rounded(out.select("target", "horizon", "origin", "series", A.at("q", 0.05).alias("lo"), A.at("q", 0.5).alias("mid"), A.at("q", 0.95).alias("hi")), 4)


SQL_INNOVATIONS = f"""ch AS (SELECT target, series, period, round(ln(CASE WHEN y > 0 THEN y END) - lag(ln(CASE WHEN y > 0 THEN y END)) OVER ({SER}), 9) AS c FROM panel),
 rk AS (SELECT *, rank() OVER (PARTITION BY target, series ORDER BY c) + (count(*) OVER (PARTITION BY target, series, c) - 1) / 2 AS k FROM ch WHERE c IS NOT NULL),
 pc AS (SELECT x.target, x.series AS a, z.series AS b, count(*) AS n, corr(x.k, z.k) AS rho FROM rk x JOIN rk z ON x.target = z.target AND x.period = z.period AND x.series < z.series GROUP BY ALL)"""


@query(f"{W}, {SQL_PANEL}, {SQL_INNOVATIONS} SELECT target, a, b, n, round(CASE WHEN n >= {copula.LEAST} AND NOT isnan(rho) THEN rho END, 6) AS rho, round(coalesce(CASE WHEN n >= {copula.LEAST} AND NOT isnan(rho) THEN {(1 - copula.SHRINK) * 2!r}::DOUBLE * sin(rho * {3.141592653589793 / 6!r}::DOUBLE) END, 0), 6) AS r FROM pc")
def innovation_correlations(spark, d):
    """How the groups' monthly changes move together, by target."""
    return rounded(copula.correlations(copula.changes(panel_now(spark, d), BY[:1]), BY[:1]))


@query(None)
def coupled_totals(spark, d):
    """Totals by region of draws that move together as the groups did up to each origin."""
    p = panels_cut(spark, d)
    by = ["origin", "target"]
    matrix = copula.matrices(copula.correlations(copula.changes(p, by), by), by)
    draws = copula.coupled_draws(forecasts(spark, d, p), matrix, by, ["origin", "target", "horizon"])
    regions = T.hierarchy(spark, d).select(F.col("group_code").alias("series"), "region").distinct()
    out = C.aggregate_draws(draws.join(regions, "series"), ["origin", "target", "horizon", "region"])
    return rounded(out.select("origin", "target", "horizon", "region", A.at("q", 0.05).alias("lo"), A.at("q", 0.5).alias("mid"), A.at("q", 0.95).alias("hi")), 4)


@query(f"{W}, {SQL_B0} SELECT target, count(*) AS rows, count(*) FILTER (WHERE q IS NULL) AS missing, count(*) FILTER (WHERE list_min(q) < 0) AS negative, count(*) FILTER (WHERE q <> list_sort(q)) AS crossed, count(*) FILTER (WHERE list_max(q) = 0) AS all_zero, count(*) FILTER (WHERE period <> CAST(origin + to_months(CAST(horizon - 1 AS INT)) AS DATE)) AS wrong_period, 0 AS duplicated FROM fc GROUP BY ALL")
def forecast_checks(spark, d):
    out = quality.forecast_checks(forecasts(spark, d), ["target"], KEYS)
    return out.withColumn("duplicated", F.col("duplicated").cast("int"))


@query(f"{W}, {SQL_B0}, e AS (SELECT o.origin, t.target, s.series, h.range AS horizon FROM {SQL_ORIGINS} o, (SELECT DISTINCT target FROM fc) t, (SELECT DISTINCT series FROM fc) s, range(1, 7) h) SELECT problem, count(*) AS n FROM (SELECT 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT origin, target, series, horizon FROM fc) UNION ALL SELECT 'unexpected' FROM (SELECT origin, target, series, horizon FROM fc EXCEPT SELECT * FROM e)) GROUP BY ALL")
def ship_grid(spark, d):
    f = forecasts(spark, d)
    horizons = spark.range(1, 7).select(F.col("id").cast("int").alias("horizon"))
    dims = f.select("target").distinct().crossJoin(f.select("series").distinct()).crossJoin(horizons)  # names by names
    grid = T.months(spark, FIRST, LAST).crossJoin(dims)
    return quality.grid_problems(f, grid, ["origin", "target", "series", "horizon"]).groupBy("problem").agg(F.count("*").alias("n"))


Q_ADM = "adm AS (SELECT CAST(s_nationkey AS BIGINT) AS org_code, CAST(date_trunc('quarter', period) AS DATE) AS quarter, sum(y) AS adm, datediff('day', CAST(date_trunc('quarter', period) AS DATE), CAST(CAST(date_trunc('quarter', period) AS DATE) + INTERVAL 3 MONTH AS DATE)) AS days FROM (SELECT s_nationkey, period, sum(y) AS y FROM y0 JOIN supplier ON s_suppkey = org_code WHERE target = 'all' GROUP BY ALL) GROUP BY ALL HAVING count(DISTINCT period) = 3)"


def adm(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("org_code"), F.col("s_nationkey").cast("long").alias("nation"))
    y = targets_now(spark, d).where("y is not null and target = 'all'").join(s, "org_code").groupBy(F.col("nation").alias("org_code"), "period").agg(F.sum("y").alias("y"))
    return D.quarterly(y, ["org_code"])


@query(f"{W}, {SQL_Y}, {Q_ADM} SELECT org_code, quarter, round(adm, 6) AS adm, days FROM adm")
def quarterly_admissions(spark, d):
    return rounded(adm(spark, d))


SQL_US = f"{T.SQL_BEDS}, us AS (SELECT org_code, quarter, arg_max(available, version) AS available, arg_max(occupied, version) AS occupied FROM beds WHERE published <= DATE '2001-01-01' GROUP BY ALL HAVING arg_max(available, version) > 0 AND arg_max(occupied, version) > 0)"


@query(f"WITH {SQL_US} SELECT org_code, quarter, round(available, 6) AS available, round(occupied, 6) AS occupied FROM us")
def usable_beds(spark, d):
    return rounded(D.usable(T.beds(spark, d), "2001-01-01"))


@query(f"""{W}, {SQL_Y}, {Q_ADM}, {SQL_US}, j AS (SELECT us.*, adm, days FROM us JOIN adm USING (org_code, quarter)),
 m AS (SELECT *, CASE WHEN abs(ln(available) - lag(ln(available)) OVER w) > ln(3) THEN 1 ELSE 0 END AS brk FROM j WINDOW w AS (PARTITION BY org_code ORDER BY quarter)),
 g AS (SELECT *, sum(brk) OVER (PARTITION BY org_code ORDER BY quarter) AS seg FROM m), z AS (SELECT *, max(seg) OVER (PARTITION BY org_code) AS last, row_number() OVER (PARTITION BY org_code ORDER BY quarter DESC) AS k FROM g),
 o AS (SELECT org_code, avg(ln(occupied * days / adm)) AS ybar, var_samp(ln(occupied * days / adm)) AS s2, count(*) AS n FROM z WHERE seg = last AND k <= 8 GROUP BY ALL),
 p AS (SELECT sum((greatest(n - 1, 0) + 1e-9) * coalesce(s2, 0)) / sum(greatest(n - 1, 0) + 1e-9) AS s2p, sum(n * ybar) / sum(n) AS mu, var_samp(ybar) AS vy, avg(1 / n) AS inv FROM o),
 t AS (SELECT *, greatest(coalesce(vy, 0) - s2p * inv, 1e-6) AS tau2 FROM p)
 SELECT org_code, n, round(tau2 / (tau2 + s2p / n) * ybar + (1 - tau2 / (tau2 + s2p / n)) * mu, 6) AS log_c, round(sqrt((greatest(n - 1, 0) * coalesce(s2, 0) + 4 * s2p) / (greatest(n - 1, 0) + 4)), 6) AS s FROM o, t""")
def shrunk_coefficients(spark, d):
    j = D.usable(T.beds(spark, d), "2001-01-01").join(adm(spark, d), ["org_code", "quarter"])
    import math

    return rounded(D.coefficients(D.after_breaks(j, ("available",), math.log(3))).select("org_code", "n", "log_c", "s"))


@query(f"""{W}, {SQL_Y}, {Q_ADM}, {T.SQL_BEDS}, q AS (SELECT CAST(range AS DATE) AS asat FROM range(DATE '1997-01-01', DATE '2001-01-02', INTERVAL 3 MONTH)),
 k AS (SELECT asat, org_code, quarter, arg_max(occupied, version) AS occupied FROM beds, q WHERE published <= asat AND quarter < asat GROUP BY ALL),
 h AS (SELECT asat, org_code, ln(occupied * days / adm) AS y, row_number() OVER (PARTITION BY asat, org_code ORDER BY quarter DESC) AS k FROM k JOIN adm USING (org_code, quarter) WHERE occupied > 0 AND adm > 0),
 c AS (SELECT asat, org_code, avg(y) AS log_c FROM h WHERE k <= 8 GROUP BY ALL), fin AS (SELECT org_code, quarter AS asat, arg_max(available, version) AS available, arg_max(occupied, version) AS occupied FROM beds GROUP BY ALL),
 v AS (SELECT exp(log_c) * adm / days / available AS r, occupied / available AS p FROM fin JOIN (SELECT *, quarter AS asat FROM adm) USING (org_code, asat) JOIN c USING (org_code, asat))
 SELECT round(median(abs(r - p)), 6) AS median_abs, round(avg(CAST(abs(r - p) <= 0.1 AS INT)), 6) AS share_within, count(*) AS n, median(abs(r - p)) <= 0.05 AND avg(CAST(abs(r - p) <= 0.1 AS INT)) >= 0.8 AS passes FROM v""")
def reconstruction_validation(spark, d):
    quarters = spark.range(1).select(F.explode(F.sequence(F.lit("1997-01-01").cast("date"), F.lit("2001-01-01").cast("date"), F.expr("interval 3 month"))).alias("quarter"))
    return rounded(D.validation_summary(D.out_of_sample(T.beds(spark, d), adm(spark, d), quarters)))


@query(f"""WITH {T.SQL_BEDS}, o AS (SELECT org_code, quarter, arg_max(occupied, version) / arg_max(available, version) AS occ FROM beds GROUP BY ALL)
 SELECT round(median(abs(o.occ - p.occ)), 6) AS median_prev, round(median(abs(o.occ - y.occ)), 6) AS median_year, count(p.occ) AS n_prev, count(y.occ) AS n_year
 FROM o LEFT JOIN o p ON p.org_code = o.org_code AND p.quarter = o.quarter - INTERVAL 3 MONTH LEFT JOIN o y ON y.org_code = o.org_code AND y.quarter = o.quarter - INTERVAL 12 MONTH""")
def persistence_check(spark, d):
    return rounded(D.persistence(T.beds(spark, d)))


def _draw(u: float) -> str:
    if u < A.LEVELS[0]:
        return f"greatest(q[1], 0) * exp(ln({u} / {A.LEVELS[0]}) * 0.1)"
    if u > A.LEVELS[-1]:
        return f"q[9] * exp(-ln((1 - {u}::DOUBLE) / (1 - {A.LEVELS[-1]}::DOUBLE)) * 0.1)"
    k = min(max(sum(v <= u for v in A.LEVELS), 1), 8)
    return f"q[{k}] + (q[{k + 1}] - q[{k}]) * {(u - A.LEVELS[k - 1]) / (A.LEVELS[k] - A.LEVELS[k - 1])!r}::DOUBLE"


@query(f"""{W}, {SQL_B0}, o AS (SELECT origin, target, series, horizon, period, point * 1.1 AS beds, list_sort([{', '.join(_draw(i / 100) for i in range(1, 100))}]) AS w FROM fc WHERE q IS NOT NULL),
 p AS (SELECT *, len(list_filter(w, lambda x: x > 0.92 * beds)) / 99 AS p, w[79] + (w[80] - w[79]) * 0.4::DOUBLE AS hi FROM o)
 SELECT origin, target, series, horizon, period, round(p, 6) AS p_breach, CAST(greatest(ceil(round(hi / 0.92 - beds, 6)), 0) AS BIGINT) AS extra_beds, p > 0.1 AS call_10, p > 0.25 AS call_25, p > 0.5 AS call_50 FROM p""")
def breach_table(spark, d):
    """Draws of each group's forecast on an even grid against a bed count of its own."""
    f = forecasts(spark, d).where("q is not null")
    occ = f.select(*KEYS, D.draws_on_grid(F.col("q")).alias("draws"), (F.col("point") * 1.1).alias("beds"))
    return rounded(D.breaches(occ, KEYS))


def _sql_polynomial(x: str, powers: tuple[float, ...]) -> str:
    out = f"{powers[0]!r}::DOUBLE"
    for c in powers[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _sql_normal(u: str) -> str:
    tail = lambda t: f"{_sql_polynomial(t, A.NORMAL_TAIL)} / {_sql_polynomial(t, A.NORMAL_TAIL_BELOW)}"
    d = f"({u} - 0.5)"
    return f"CASE WHEN {u} < {A.NORMAL_LOW} THEN {tail(f'sqrt(-2 * ln({u}))')} WHEN {u} > {1 - A.NORMAL_LOW!r}::DOUBLE THEN -({tail(f'sqrt(-2 * ln(1 - {u}))')}) ELSE {d} * {_sql_polynomial(f'({d} * {d})', A.NORMAL_MIDDLE)} / {_sql_polynomial(f'({d} * {d})', A.NORMAL_MIDDLE_BELOW)} END"


def _sql_line(i: int) -> str:
    return f"l[{i + 1}] + (l[{i + 2}] - l[{i + 1}]) / {A.Z[i + 1] - A.Z[i]!r}::DOUBLE * (z1[k] - ({A.Z[i]!r})::DOUBLE)"


_value = f"exp(CASE {' '.join(f'WHEN z1[k] < ({A.Z[i + 1]!r})::DOUBLE THEN {_sql_line(i)}' for i in range(7))} ELSE {_sql_line(7)} END)"
_bits = "list_transform(range(1, 201), lambda k: (CAST('0x' || substr(md5(key || '|' || k), {at}, 13) AS BIGINT) + 0.5) / 4503599627370496::DOUBLE)"
SQL_COEFS = """j AS (SELECT us.*, adm, days FROM us JOIN adm USING (org_code, quarter)),
 m AS (SELECT *, CASE WHEN abs(ln(available) - lag(ln(available)) OVER w) > ln(3) THEN 1 ELSE 0 END AS brk FROM j WINDOW w AS (PARTITION BY org_code ORDER BY quarter)),
 g2 AS (SELECT *, sum(brk) OVER (PARTITION BY org_code ORDER BY quarter) AS seg FROM m), z0 AS (SELECT *, max(seg) OVER (PARTITION BY org_code) AS last, row_number() OVER (PARTITION BY org_code ORDER BY quarter DESC) AS k FROM g2),
 ow AS (SELECT org_code, avg(ln(occupied * days / adm)) AS ybar, var_samp(ln(occupied * days / adm)) AS s2, count(*) AS n FROM z0 WHERE seg = last AND k <= 8 GROUP BY ALL),
 po AS (SELECT sum((greatest(n - 1, 0) + 1e-9) * coalesce(s2, 0)) / sum(greatest(n - 1, 0) + 1e-9) AS s2p, sum(n * ybar) / sum(n) AS mu, var_samp(ybar) AS vy, avg(1 / n) AS inv FROM ow),
 ta AS (SELECT *, greatest(coalesce(vy, 0) - s2p * inv, 1e-6) AS tau2 FROM po),
 co AS (SELECT org_code, tau2 / (tau2 + s2p / n) * ybar + (1 - tau2 / (tau2 + s2p / n)) * mu AS log_c, sqrt((greatest(n - 1, 0) * coalesce(s2, 0) + 4 * s2p) / (greatest(n - 1, 0) + 4)) AS s FROM ow, ta)"""


@query(f"""{W}, {SQL_Y}, {SQL_B0}, {Q_ADM}, {SQL_US}, {SQL_COEFS}, lb AS (SELECT org_code, arg_max(available, quarter) AS beds FROM us GROUP BY ALL),
 sf AS (SELECT fc.origin, fc.target, fc.series, fc.horizon, fc.period, q, log_c, s, beds, datediff('day', fc.period, CAST(fc.period + INTERVAL 1 MONTH AS DATE)) AS days, concat_ws('|', '0', fc.origin, fc.target, fc.series, fc.horizon, fc.period) AS key
   FROM fc JOIN co ON fc.series = 'NATION_' || co.org_code JOIN lb ON lb.org_code = co.org_code WHERE q IS NOT NULL AND target = 'all'),
 su AS (SELECT *, list_transform(q, lambda v: ln(greatest(v, 1e-9))) AS l, {_bits.format(at=1)} AS u1, {_bits.format(at=14)} AS u2 FROM sf),
 sz AS (SELECT *, list_transform(u1, lambda u: {_sql_normal('u')}) AS z1, list_transform(u2, lambda u: {_sql_normal('u')}) AS z2 FROM su),
 w AS (SELECT *, list_sort(list_transform(range(1, 201), lambda k: exp(log_c + s * z2[k]) * {_value} / days)) AS w FROM sz),
 p AS (SELECT *, len(list_filter(w, lambda x: x > 0.92 * beds)) / 200 AS p, w[160] + (w[161] - w[160]) * 0.2::DOUBLE AS hi FROM w)
 SELECT origin, target, series, horizon, period, round(w[100], 4) AS low_median, round(p, 6) AS p_breach, CAST(greatest(ceil(round(hi / 0.92 - beds, 6)), 0) AS BIGINT) AS extra_beds, p > 0.1 AS call_10, p > 0.25 AS call_25, p > 0.5 AS call_50 FROM p""")
def simulated_breaches(spark, d):
    """Occupied beds simulated from forecasts of admissions and the shrunk coefficients, against the
    latest beds of each organisation."""
    import math

    known = cut(D.usable(T.beds(spark, d), "2001-01-01"))
    coefs = D.coefficients(D.after_breaks(known.join(adm(spark, d), ["org_code", "quarter"]), ("available",), math.log(3)))
    latest = known.groupBy("org_code").agg(F.max_by("available", "quarter").alias("beds"))
    f = forecasts(spark, d).where("q is not null and target = 'all' and series like 'NATION\\_%'")
    f = f.select(*KEYS, "q", F.substring_index("series", "_", -1).cast("long").alias("org_code"), F.datediff(F.add_months("period", 1), "period").alias("days"))
    occ = D.occupied_draws(f.join(latest, "org_code"), coefs, KEYS)
    median = F.element_at(F.array_sort("draws"), 100)
    return rounded(D.breaches(occ.withColumn("low_median", F.round(median, 4)), [*KEYS, "low_median"]))


@query(f"{W}, {SQL_SCORED} SELECT round(avg(CASE WHEN p > 0.25 THEN 0.25 WHEN event THEN 1 ELSE 0 END), 6) AS expense, round(avg((p - CAST(event AS INT)) * (p - CAST(event AS INT))), 6) AS brier, count(*) AS n FROM (SELECT CASE WHEN q[7] > 1.1 * point THEN 0.3 ELSE 0.05 END AS p, y > 1.1 * point AS event FROM s)")
def cost_loss(spark, d):
    s = scored(spark, d).select(F.when(A.at("q", 0.9) > 1.1 * F.col("point"), 0.3).otherwise(0.05).alias("p"), (F.col("y") > 1.1 * F.col("point")).alias("event"))
    return rounded(D.expense(s, 0.25))


@query(f"SELECT origin, {T.sql_thursday('origin')} AS as_of FROM {SQL_ORIGINS}")
def origins_and_days(spark, d):
    return T.months(spark, FIRST, LAST).select("origin", second_thursday("origin").alias("as_of"))


def _model(name):
    def run(spark, d):
        from tidemark.operators import models

        p = cut(panel_now(spark, d))  # fits read it in many jobs
        return rounded(models.forecast(p, name, ["target"]).select("target", "series", "horizon", A.at("q", 0.05).alias("lo"), A.at("q", 0.5).alias("mid"), A.at("q", 0.95).alias("hi")), 4)

    return run


for _name in ("ets", "stl_arima", "boosted", "ensemble"):
    query(None, f"model_{_name}")(_model(_name))


def _rolling(name):
    def run(spark, d):
        """Forecasts of a local model as each origin would have made them."""
        from tidemark.operators import models

        f = models.rolling(panels_cut(spark, d), name, ["target"])
        return rounded(f.select("origin", "target", "series", "horizon", A.at("q", 0.05).alias("lo"), A.at("q", 0.5).alias("mid"), A.at("q", 0.95).alias("hi")), 4)

    return run


for _name in ("ets", "stl_arima"):
    query(None, f"rolling_{_name}")(_rolling(_name))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL)
 SELECT day, event_type, n, mean FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_daily_events(spark, d):
    """The daily event counts as a stream with a watermark, drained once."""
    from tidemark.streaming import events as S

    return rounded(S.run_once(S.daily(S.read_table(spark, d, "events"))), 6)
