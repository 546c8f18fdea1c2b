"""Reports over runs, with stand-ins for second runs made from the first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import published as PB
from tidemark.operators import reports as R
from tidemark.plans import testbed as T
from tidemark.plans.queries_forecast import FIRST, KEYS, LAST, SQL_B0, SQL_MODELS, SQL_SCORED, forecasts, scored, two_models
from tidemark.plans.queries_vintage import ORIGINS as SQL_ORIGINS
from tidemark.plans.queries_vintage import W
from tidemark.plans.registry import query, rounded
from tidemark.session import cut

_MEANS = ", ".join(f"avg(CAST({s}.{c} AS DOUBLE)) AS {c}_{n}" for c in ("wis", "cov50", "cov90") for s, n in (("a", "orig"), ("b", "retry")))
_ROUND = ", ".join(f"round({c}_{n}, 4) AS {c}_{n}" for c in ("wis", "cov50", "cov90") for n in ("orig", "retry"))


@query(f"""{W}, {SQL_MODELS}, sd AS (SELECT a.origin, a.target, {_MEANS}, count(*) AS rows FROM m2 a JOIN m2 b ON (a.origin, a.target, a.series, a.horizon, a.period) = (b.origin, b.target, b.series, b.horizon, b.period) WHERE a.model = 'naive' AND b.model = 'other' GROUP BY GROUPING SETS ((a.origin, a.target), (a.target)))
 SELECT origin, target, rows, {_ROUND}, round(100 * (wis_retry / wis_orig - 1), 4) AS wis_diff_pct, round(100 * (cov50_retry - cov50_orig), 4) AS cov50_diff_pp, round(100 * (cov90_retry - cov90_orig), 4) AS cov90_diff_pp FROM sd
 UNION ALL SELECT NULL, 'gm', CAST(sum(rows) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, round(100 * (exp(avg(ln(wis_retry / wis_orig))) - 1), 4), NULL, NULL FROM sd WHERE origin IS NULL""")
def seed_differences(spark, d):
    m = cut(two_models(spark, d))
    of = lambda n: m.where(F.col("model") == n)
    return rounded(R.seed_differences(R.paired_runs(of("naive"), of("other"), KEYS)), 4)


@query(f"""{W}, {SQL_B0} SELECT origin, round(max(CASE WHEN month(origin) <> 5 OR horizon < 6 THEN g END), 6) AS max_rel_diff, count(*) FILTER (WHERE month(origin) <> 5 OR horizon < 6) AS compared, count(*) FILTER (WHERE month(origin) = 5 AND horizon = 6) AS unmatched
 FROM (SELECT *, list_max(list_transform(q, lambda x: abs(x * (CASE WHEN month(origin) = 3 THEN 1.001 ELSE 1 END) - x) / greatest(abs(x), 1))) AS g FROM fc WHERE q IS NOT NULL) GROUP BY ALL""")
def run_reproduction(spark, d):
    """A second run that differs in March and lacks the last horizon in May."""
    f = cut(forecasts(spark, d).where("q is not null").select(*KEYS, "q"))
    again = f.where("month(origin) <> 5 or horizon < 6").withColumn("q", F.when(F.month("origin") == 3, F.transform("q", lambda x: x * 1.001)).otherwise(F.col("q")))
    return rounded(R.reproduction(again, f, KEYS))


SQL_FITS = "fits AS (SELECT o_custkey AS fit, 1 + (max(o_orderkey) % 200) / 1000.0 AS rhat_max, count(*) * 20.0 AS ess_bulk_min, CAST(sum(o_orderkey) % 7 = 0 AS INT) AS divergences, CASE WHEN min(o_orderkey) % 31 = 0 THEN 'failed' END AS error FROM orders GROUP BY ALL)"


def fits(spark, d):
    """Diagnostics of made-up fits, one a customer."""
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("fit"))
    return o.agg((1 + F.max("o_orderkey") % 200 / 1000.0).alias("rhat_max"), (F.count("*") * 20.0).alias("ess_bulk_min"), (F.sum("o_orderkey") % 7 == 0).cast("int").alias("divergences"), F.when(F.min("o_orderkey") % 31 == 0, "failed").alias("error"))


@query(f"""WITH {SQL_FITS}, a AS (SELECT count(error) + greatest(2000 - count(*), 0) AS failed, count(*) FILTER (WHERE divergences > 0) AS diverging, count(*) FILTER (WHERE rhat_max > 1.15) AS high, count(*) FILTER (WHERE ess_bulk_min < 20) AS low, median(rhat_max) AS rm, median(ess_bulk_min) AS em FROM fits)
 SELECT 'failed or missing fits' AS "check", round(CAST(failed AS DOUBLE), 6) AS value, failed = 0 AS passes FROM a UNION ALL SELECT 'fits with a divergence', CAST(diverging AS DOUBLE), diverging = 0 FROM a UNION ALL SELECT 'fits with high R-hat', CAST(high AS DOUBLE), high = 0 FROM a
 UNION ALL SELECT 'fits with low ESS', CAST(low AS DOUBLE), low = 0 FROM a UNION ALL SELECT 'median of R-hat', round(CAST(rm AS DOUBLE), 6), rm <= 1.05 FROM a UNION ALL SELECT 'median of ESS', round(CAST(em AS DOUBLE), 6), em >= 70 FROM a""")
def sampling_checks(spark, d):
    return rounded(R.sampling_checks(fits(spark, d), 2000))


@query("SELECT regexp_replace(p, '\\[.*', '') AS family, count(*) AS n, round(max(r), 6) AS rhat_max, round(min(e), 6) AS ess_bulk_min, round(min(t), 6) AS ess_tail_min FROM (SELECT l_returnflag || '_' || l_linestatus || '[' || l_linenumber || ', ' || l_suppkey || ']' AS p, 1 + l_discount AS r, l_quantity AS e, l_extendedprice AS t FROM lineitem) GROUP BY ALL")
def family_diagnostics(spark, d):
    line = T.table(spark, d, "lineitem")
    name = F.concat("l_returnflag", F.lit("_"), "l_linestatus", F.lit("["), F.col("l_linenumber").cast("string"), F.lit(", "), F.col("l_suppkey").cast("string"), F.lit("]"))
    s = line.select(name.alias("parameter"), (1 + F.col("l_discount")).alias("r_hat"), F.col("l_quantity").alias("ess_bulk"), F.col("l_extendedprice").alias("ess_tail"))
    return rounded(R.family_diagnostics(s))


@query(f"""{W}, {SQL_B0}, f AS (SELECT DISTINCT origin, CAST(horizon AS INT) AS horizon FROM fc WHERE period >= DATE '2000-10-01' AND NOT (month(origin) = 9 AND horizon = 4)),
 e AS (SELECT o.origin, CAST(h.range AS INT) AS horizon FROM {SQL_ORIGINS} o, range(1, 7) h WHERE CAST(o.origin + to_months(CAST(h.range - 1 AS INT)) AS DATE) >= DATE '2000-10-01')
 SELECT origin, horizon, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT origin, horizon, 'extra' FROM (SELECT * FROM f EXCEPT SELECT * FROM e)""")
def embargo_pairs(spark, d):
    """Pairs of an embargo from 2000-10 on, against forecasts that lack one."""
    f = forecasts(spark, d).where("not (month(origin) = 9 and horizon = 4)")
    return R.embargo_pairs(f, T.months(spark, FIRST, LAST), 6, "2000-10-01")


@query(f"""{W}, {SQL_MODELS}, r AS (SELECT * FROM m2 UNION ALL SELECT * REPLACE (wis * 0.95 AS wis, cov90 OR pit > 0.02 AND pit < 0.98 AS cov90, 'wide' AS model) FROM m2 WHERE model = 'naive'),
 w AS (SELECT model, target, avg(wis) AS w FROM r WHERE winter AND horizon = 3 GROUP BY ALL), gm AS (SELECT w.model, exp(avg(ln(w.w / b.w))) - 1 AS gm FROM w JOIN w b ON b.target = w.target AND b.model = 'naive' GROUP BY ALL),
 c AS (SELECT model, year(origin) AS y, horizon, avg(CAST(cov90 AS INT)) AS cov, count(DISTINCT origin) AS o FROM r GROUP BY ALL), k AS (SELECT model, max(CASE WHEN o >= 6 THEN abs(cov - 0.9) END) AS worst FROM c GROUP BY ALL), t AS (SELECT gm.model, gm.gm, worst FROM gm JOIN k USING (model))
 SELECT a.model AS candidate, b.model AS against, round(100 * ((1 + a.gm) / (1 + b.gm) - 1), 4) AS wis_pct, round(100 * (a.worst - b.worst), 4) AS worst_pp, coalesce(100 * ((1 + a.gm) / (1 + b.gm) - 1) < -1 AND a.worst < b.worst, false) AS retained
 FROM t a JOIN t b ON (a.model, b.model) IN (('other', 'naive'), ('wide', 'naive'), ('wide', 'other'))""")
def rung_retention(spark, d):
    m = two_models(spark, d)
    wide = m.where("model = 'naive'").withColumns({"wis": F.col("wis") * 0.95, "cov90": F.col("cov90") | ((F.col("pit") > 0.02) & (F.col("pit") < 0.98)), "model": F.lit("wide")})
    every = cut(m.unionByName(wide))
    steps = spark.createDataFrame([("other", "naive"), ("wide", "naive"), ("wide", "other"), ("absent", "naive")], "candidate string, against string")
    return rounded(R.retention(R.rung_summary(every, every.where("model = 'naive'")), steps, 1.0), 4)


@query("""WITH n AS (SELECT p_brand AS target, stddev_samp(p_retailprice) / avg(p_retailprice) * 2.8 AS wis, count(*) / 10000.0 AS cov90 FROM part WHERE p_size < 25 GROUP BY ALL)
 SELECT target, round(wis, 6) AS wis, round(CAST(cov90 AS DOUBLE), 6) AS cov90 FROM n UNION ALL SELECT 'gm', round(avg(wis), 6), NULL FROM n""")
def minimum_differences(spark, d):
    p = T.table(spark, d, "part")
    noise = p.groupBy(F.when(F.col("p_size") < 25, "floor").otherwise("comparison").alias("run"), F.col("p_brand").alias("target"))
    noise = noise.agg((100 * F.stddev_samp("p_retailprice") / F.avg("p_retailprice") * 2.8).alias("mmd_wis_pct"), (F.count("*") / 100).alias("mmd_cov90_pp")).withColumn("slice", F.lit("winter_h3"))
    return rounded(R.minimum_differences(noise))


@query(f"""{W}, {SQL_MODELS}, j AS (SELECT a.origin, a.target, a.wis AS a, b.wis AS b, CASE WHEN a.winter THEN 'winter' ELSE 'other' END AS w FROM m2 a JOIN m2 b ON (a.origin, a.target, a.series, a.horizon, a.period) = (b.origin, b.target, b.series, b.horizon, b.period) WHERE a.model = 'naive' AND b.model = 'other'),
 t AS (SELECT "set", "window", target, avg(b) / avg(a) AS ratio, count(DISTINCT origin) AS origins FROM (SELECT *, unnest(CASE WHEN month(origin) % 2 = 0 THEN ['every', 'even'] ELSE ['every'] END) AS "set" FROM j), (SELECT unnest(['all', 'winter', 'other']) AS "window") v WHERE "window" IN ('all', w) GROUP BY ALL)
 SELECT "set", "window", target, round(ratio - 1, 6) AS rel, origins FROM t UNION ALL SELECT "set", "window", 'gm', round(exp(avg(ln(ratio))) - 1, 6), max(origins) FROM t GROUP BY ALL""")
def wis_by_set_and_window(spark, d):
    m = cut(two_models(spark, d))
    of = lambda n: m.where(F.col("model") == n)
    o = T.months(spark, FIRST, LAST)
    sets = o.withColumn("set", F.lit("every")).unionByName(o.where("month(origin) % 2 = 0").withColumn("set", F.lit("even")))
    return rounded(R.wis_by_set_and_window(of("other"), of("naive"), sets, [*KEYS, "winter"], F.when(F.col("winter"), "winter").otherwise("other")))


_DATES = "o_orderkey AS id, CAST(o_orderdate AS DATE) AS t, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 40 END AS r, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS l, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_trunc('month', o_orderdate + to_days(CAST(o_orderkey % 60 AS INT))) AS DATE) END AS u, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 35 END AS s"


@query(f"""WITH x AS (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN t END AS t) FROM (SELECT {_DATES} FROM orders)),
 y AS (SELECT *, coalesce(CASE WHEN r IS NULL THEN l WHEN l IS NULL THEN r ELSE greatest(r, l) END, t) AS d, CASE WHEN l IS NOT NULL AND (r IS NULL OR l > r) THEN 'link_text_revised' WHEN r IS NOT NULL THEN 'title_block_revised' WHEN t IS NOT NULL THEN 'title_block_published' END AS why FROM x)
 SELECT id, CASE WHEN d IS NOT NULL AND (u IS NULL OR d >= u) THEN d WHEN s IS NOT NULL AND (u IS NULL OR s >= u) THEN s WHEN u IS NOT NULL THEN last_day(u) END AS published,
  CASE WHEN d IS NOT NULL AND (u IS NULL OR d >= u) THEN why WHEN s IS NOT NULL AND (u IS NULL OR s >= u) THEN 'first_page_capture' || coalesce(' (' || why || ' ' || d || ' precedes upload folder ' || strftime(u, '%Y-%m') || ')', '')
       WHEN u IS NOT NULL THEN 'upload_month_end' || coalesce(' (' || why || ' ' || d || ' precedes upload folder ' || strftime(u, '%Y-%m') || ')', '') ELSE 'unknown' END AS source FROM y""")
def resolved_dates(spark, d):
    """The day of publication from title blocks, link texts, upload folders and first sightings."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    k, day = F.col("id"), F.col("day")
    x = o.select(
        "id", F.when(k % 11 != 0, day).alias("t"), F.when(k % 3 == 0, F.date_add(day, 40)).alias("r"), F.when(k % 5 == 0, F.date_add(day, (k % 90).cast("int"))).alias("l"),
        F.when(k % 7 != 0, F.trunc(F.date_add(day, (k % 60).cast("int")), "MM")).alias("u"), F.when(k % 4 == 0, F.date_add(day, 35)).alias("s"),
    )
    return x.select("id", PB.resolve_published(*map(F.col, "trlus")).alias("p")).select("id", "p.published", "p.source")


@query(f"{W}, {SQL_B0} SELECT origin, target, series, horizon, period, quantile, round(value, 3) AS value FROM (SELECT origin, target, series, horizon, period, unnest([0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975]::DOUBLE[]) AS quantile, unnest(q) AS value FROM fc WHERE q IS NOT NULL AND target = 'all')")
def quantile_rows(spark, d):
    """Long form of the forecasts of one target."""
    return rounded(R.quantile_rows(forecasts(spark, d).where("q is not null and target = 'all'"), KEYS), 3)


@query(f"{W}, {SQL_SCORED} SELECT count(*) FILTER (WHERE period >= DATE '2000-10-01') AS sealed, count(*) AS rows FROM s")
def sealed_scored(spark, d):
    return R.sealed_scored(scored(spark, d), "2000-10-01")
