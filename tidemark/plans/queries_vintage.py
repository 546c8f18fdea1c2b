"""Queries over the vintage table: slices, targets, roll-ups, releases, revisions, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality, score
from tidemark.operators import vintage as V
from tidemark.plans import testbed as T
from tidemark.plans.registry import query, rounded

FIRST, LAST, DAY, UPTO = "1998-01-01", "2000-12-01", "2000-10-12", "2000-09-01"
W = f"WITH {T.SQL_VINT}, {T.SQL_HIER}"
SQL_LATEST = "SELECT period, org_code, metric, arg_max_null(value, version) AS value FROM vint {where} GROUP BY ALL"
SQL_ASOF = SQL_LATEST.format(where=f"WHERE snapshot <= DATE '{DAY}' AND period <= DATE '{UPTO}'")
SQL_FINAL = SQL_LATEST.format(where="")
SQL_TARGETS = """
  SELECT {keys}, 'all' AS target, CASE WHEN count(value) = 3 THEN sum(value) END AS y FROM {src} GROUP BY {keys}
  UNION ALL SELECT {keys}, 'first', max(CASE WHEN metric = 'A' THEN value END) FROM {src} GROUP BY {keys}
  UNION ALL SELECT {keys}, 'rest', CASE WHEN count(CASE WHEN metric <> 'A' THEN value END) = 2 THEN sum(CASE WHEN metric <> 'A' THEN value END) END FROM {src} GROUP BY {keys}"""
ORIGINS = T.sql_months(FIRST, LAST)
SQL_GRID = f"""
  SELECT origin, period, org_code, metric, arg_max_null(value, version) AS value
  FROM vint, {ORIGINS} WHERE snapshot <= {T.sql_thursday('origin')} AND period <= CAST(origin - INTERVAL 1 MONTH AS DATE) GROUP BY ALL"""


def targets_now(spark, d):
    return V.targets(V.latest(T.vintages(spark, d)), T.TARGETS, ["period", "org_code"])


@query(f"""{W}, a AS ({SQL_ASOF}), z AS ({SQL_LATEST.format(where=f"WHERE period <= DATE '{UPTO}'")}),
 ta AS ({SQL_TARGETS.format(keys='period, org_code', src='a')}), tz AS ({SQL_TARGETS.format(keys='period, org_code', src='z')}),
 j AS (SELECT coalesce(ta.period, tz.period) AS period, coalesce(ta.org_code, tz.org_code) AS org_code, ta.y AS seen, tz.y AS final
       FROM (SELECT * FROM ta WHERE target = 'all') ta FULL JOIN (SELECT * FROM tz WHERE target = 'all') tz ON ta.period = tz.period AND ta.org_code = tz.org_code)
 SELECT region, period, round(sum(seen), 6) AS seen, round(sum(final), 6) AS final,
        round(coalesce(sum(CASE WHEN seen IS NOT NULL AND final IS NOT NULL THEN final - seen END), 0), 6) AS revised,
        round(coalesce(sum(CASE WHEN seen IS NULL THEN final END), 0), 6) AS late
 FROM j JOIN hier USING (org_code) GROUP BY ALL""")
def asof_region_revisions(spark, d):
    v = T.vintages(spark, d)
    target = lambda s: V.targets(s, {"all": T.TARGETS["all"]}, ["period", "org_code"])
    seen = target(V.as_of(v, DAY, UPTO)).select("period", "org_code", F.col("y").alias("seen"))
    final = target(V.latest(v.where(F.col("period") <= UPTO))).select("period", "org_code", F.col("y").alias("final"))
    j = seen.join(final, ["period", "org_code"], "full_outer").join(T.hierarchy(spark, d), "org_code")
    both = F.col("seen").isNotNull() & F.col("final").isNotNull()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rounded(j.groupBy("region", "period").agg(F.sum("seen").alias("seen"), F.sum("final").alias("final"), zero(F.when(both, F.col("final") - F.col("seen"))).alias("revised"), zero(F.when(F.col("seen").isNull(), F.col("final"))).alias("late")))


@query(f"{W} SELECT period, org_code, metric, round(value, 6) AS value, snapshot FROM vint WHERE metric IN ('A', 'R')")
def load_view(spark, d):
    return rounded(T.vintages(spark, d).where(F.col("metric").isin("A", "R")).select(*V.KEY, "value", "snapshot"))


@query(f"{W} SELECT period, org_code, metric, round(value, 6) AS value FROM ({SQL_ASOF})")
def asof_slice(spark, d):
    return rounded(V.as_of(T.vintages(spark, d), DAY, UPTO))


@query(f"{W} SELECT origin, metric, count(*) AS cells, round(sum(value), 6) AS total FROM ({SQL_GRID}) GROUP BY ALL")
def asof_grid(spark, d):
    grid = V.as_of_grid(T.vintages(spark, d), T.months(spark, FIRST, LAST))
    return rounded(grid.groupBy("origin", "metric").agg(F.count("*").alias("cells"), F.sum("value").alias("total")))


@query(f"{W}, f AS ({SQL_FINAL}) SELECT period, org_code, target, round(y, 6) AS y FROM ({SQL_TARGETS.format(keys='period, org_code', src='f')})")
def targets_long(spark, d):
    return rounded(targets_now(spark, d))


@query(f"""{W}, k AS (SELECT period, org_code, metric, min(snapshot) AS first_day, arg_max_null(value, version) AS newest FROM vint GROUP BY ALL)
 SELECT metric, count(*) AS cells, round(sum(newest), 6) AS total FROM k WHERE first_day <= DATE '{DAY}' GROUP BY ALL""")
def asof_first_published_latest_values(spark, d):
    """The leaky slice: cells known on the day, with the values of today."""
    k = T.vintages(spark, d).groupBy(*V.KEY).agg(F.min("snapshot").alias("first_day"), F.max_by("value", "version").alias("newest"))
    return rounded(k.where(F.col("first_day") <= DAY).groupBy("metric").agg(F.count("*").alias("cells"), F.sum("newest").alias("total")))


def _truth_sql(extra: str = "") -> str:
    return f"{W}, f AS ({SQL_FINAL}), t AS (SELECT * FROM ({SQL_TARGETS.format(keys='period, org_code', src='f')}) WHERE y IS NOT NULL){extra}"


@query(_truth_sql() + """
 SELECT 'org' AS level, CAST(org_code AS VARCHAR) AS series, period, target, round(y, 6) AS y FROM t
 UNION ALL SELECT 'group', coalesce(group_code, 'UNMAPPED'), period, target, round(sum(y), 6) FROM t LEFT JOIN hier USING (org_code) GROUP BY ALL
 UNION ALL SELECT 'region', coalesce(region, 'UNMAPPED'), period, target, round(sum(y), 6) FROM t LEFT JOIN hier USING (org_code) GROUP BY ALL
 UNION ALL SELECT 'all', 'ALL', period, target, round(sum(y), 6) FROM t GROUP BY ALL""")
def truth_all_levels(spark, d):
    y, h = targets_now(spark, d).where("y is not null"), T.hierarchy(spark, d)
    keys = ["period", "target"]
    out = y.select(F.lit("org").alias("level"), F.col("org_code").cast("string").alias("series"), *keys, "y")
    for level, column in (("group", "group_code"), ("region", "region")):
        out = out.unionByName(V.roll_up(y, h, column, keys).select(F.lit(level).alias("level"), "series", *keys, "y"))
    top = y.groupBy(*keys).agg(V.min_count_sum("y").alias("y"))
    return rounded(out.unionByName(top.select(F.lit("all").alias("level"), F.lit("ALL").alias("series"), *keys, "y")))


@query(_truth_sql(", n AS (SELECT group_code, count(DISTINCT org_code) AS need FROM hier GROUP BY ALL)") + """
 SELECT period, target, group_code AS series, round(sum(y), 6) AS y FROM t JOIN hier USING (org_code) JOIN n USING (group_code)
 GROUP BY period, target, group_code, need HAVING count(y) = need""")
def truth_complete_only(spark, d):
    return rounded(V.complete_sums(targets_now(spark, d), T.hierarchy(spark, d), "group_code", ["period", "target"]))


SQL_FR = f"""g AS ({SQL_GRID}), gt AS (SELECT * FROM ({SQL_TARGETS.format(keys='origin, period, org_code', src='g')}) WHERE y IS NOT NULL),
 fr AS (SELECT target, org_code, period, min(origin) AS first_origin, arg_min(y, origin) AS y_first FROM gt GROUP BY ALL)"""


@query(f"{W}, {SQL_FR} SELECT target, org_code, period, first_origin, round(y_first, 6) AS y_first, {T.sql_thursday('first_origin')} AS resolved FROM fr")
def first_release(spark, d):
    return rounded(V.first_release(T.vintages(spark, d), T.TARGETS, T.months(spark, FIRST, LAST)))


@query(f"""{W}, {SQL_FR}, n AS (SELECT group_code, count(DISTINCT org_code) AS need FROM hier GROUP BY ALL)
 SELECT target, group_code AS series, period, round(sum(y_first), 6) AS y_first, max({T.sql_thursday('first_origin')}) AS resolved
 FROM fr JOIN hier USING (org_code) JOIN n USING (group_code) GROUP BY target, group_code, period, need HAVING count(*) = need""")
def first_release_groups(spark, d):
    fr = V.first_release(T.vintages(spark, d), T.TARGETS, T.months(spark, FIRST, LAST))
    return rounded(V.first_release_of_parents(fr, T.hierarchy(spark, d), "group_code"))


SQL_CELLS = """c AS (SELECT period, org_code, metric, arg_min_null(value, version) AS first, arg_max_null(value, version) AS last, min(snapshot) AS first_day FROM vint GROUP BY ALL),
 cd AS (SELECT *, min(first_day) OVER (PARTITION BY period, metric) AS due FROM c),
 audit AS (SELECT period, metric, count(*) FILTER (WHERE first_day = due) AS n_first, count(*) FILTER (WHERE first_day <> due) AS n_late,
   count(*) FILTER (WHERE first_day = due AND last IS NULL) AS n_withdrawn, count(*) FILTER (WHERE first_day = due AND last <> first) AS n_changed,
   sum(CASE WHEN first_day = due THEN first END) AS first_total, sum(last) AS last_total,
   max(CASE WHEN first_day = due THEN abs(last - first) END) AS max_change, median(CASE WHEN first_day = due THEN abs(last - first) END) AS median_change
  FROM cd GROUP BY ALL)"""


@query(f"{W}, {SQL_CELLS} SELECT period, metric, n_first, n_late, n_withdrawn, n_changed, round(first_total, 6) AS first_total, round(last_total, 6) AS last_total, round(max_change, 6) AS max_change, round(median_change, 6) AS median_change FROM audit")
def revision_audit(spark, d):
    return rounded(V.revision_audit(T.vintages(spark, d)))


@query(f"""{W}, {SQL_CELLS} SELECT CAST(year(period) - CASE WHEN month(period) < 4 THEN 1 ELSE 0 END AS BIGINT) AS fy, metric, round(avg(n_changed), 6) AS mean_changed, round(avg(n_late), 6) AS mean_late,
 round(max(abs(last_total / first_total - 1)), 6) AS worst_national, round(avg(abs(last_total / first_total - 1)), 6) AS mean_national FROM audit GROUP BY ALL""")
def audit_by_financial_year(spark, d):
    return rounded(V.audit_by_year(V.revision_audit(T.vintages(spark, d))))


@query(f"{W}, {SQL_CELLS} SELECT period, org_code, metric, round(last - first, 6) AS change FROM c WHERE last - first IS NOT NULL ORDER BY abs(last - first) DESC, period, org_code, metric LIMIT 10")
def largest_revisions(spark, d):
    return rounded(V.largest_revisions(T.vintages(spark, d)))


SQL_BOTH = f"""g AS ({SQL_GRID}), f AS ({SQL_FINAL}),
 b AS (SELECT o.origin, f.period, f.org_code, f.metric, f.value AS final, g.value AS seen
       FROM f JOIN {ORIGINS} o ON f.period >= CAST(o.origin - INTERVAL 12 MONTH AS DATE) AND f.period <= CAST(o.origin - INTERVAL 1 MONTH AS DATE)
       LEFT JOIN g ON g.origin = o.origin AND g.period = f.period AND g.org_code = f.org_code AND g.metric = f.metric)"""
SQL_COMP = """comp AS (SELECT origin, metric, coalesce(sum(CASE WHEN seen IS NOT NULL AND final IS NOT NULL THEN final - seen END), 0) AS revised,
   coalesce(sum(CASE WHEN seen IS NULL THEN final END), 0) AS late, coalesce(sum(CASE WHEN final IS NULL THEN seen END), 0) AS withdrawn,
   count(*) FILTER (WHERE seen IS NULL AND final IS NOT NULL) AS n_late FROM b GROUP BY ALL)"""


@query(f"{W}, {SQL_BOTH} SELECT origin, metric, count(*) AS cells, count(*) FILTER (WHERE seen IS NULL) AS unseen, count(*) FILTER (WHERE seen <> final) AS changed, round(sum(final) - sum(seen), 6) AS leak FROM b GROUP BY ALL")
def training_leakage(spark, d):
    return rounded(V.training_leakage(T.vintages(spark, d), T.months(spark, FIRST, LAST)))


@query(f"{W}, {SQL_BOTH}, {SQL_COMP} SELECT origin, metric, round(revised, 6) AS revised, round(late, 6) AS late, round(withdrawn, 6) AS withdrawn, n_late FROM comp")
def change_components(spark, d):
    return rounded(V.change_components(T.vintages(spark, d), T.months(spark, FIRST, LAST)))


@query(f"""{W}, {SQL_BOTH}, {SQL_COMP}, m AS (SELECT metric, count(*) FILTER (WHERE abs(late) > abs(revised)) AS n_larger, count(*) AS n FROM comp GROUP BY ALL)
 SELECT metric, n_larger, n, n // 2 + 1 AS need, n_larger >= n // 2 + 1 AS late_dominates FROM m""")
def late_majority(spark, d):
    return V.late_majority(V.change_components(T.vintages(spark, d), T.months(spark, FIRST, LAST)))


@query(f"WITH {T.SQL_BEDS} SELECT org_code, quarter, version, row_number() OVER w AS version_no, count(*) OVER e AS n_versions, row_number() OVER w = count(*) OVER e AS is_latest, min(published) OVER e AS first_published FROM beds WINDOW w AS (PARTITION BY org_code, quarter ORDER BY published, version), e AS (PARTITION BY org_code, quarter)")
def version_numbers(spark, d):
    v = V.number_versions(T.beds(spark, d), ["org_code", "quarter"])
    return v.select("org_code", "quarter", "version", "version_no", "n_versions", "is_latest", "first_published")


@query(f"""WITH {T.SQL_VINT}, p AS (SELECT DISTINCT a.period, a.version FROM vint a JOIN vint b ON a.period = b.period AND b.version = a.version + 1),
 m AS (SELECT period, version, org_code || metric AS k, value FROM vint),
 j AS (SELECT coalesce(a.period, b.period) AS period, coalesce(a.version, b.version - 1) AS version, a.value AS va, b.value AS vb FROM m a FULL JOIN m b ON a.period = b.period AND a.k = b.k AND b.version = a.version + 1)
 SELECT period, version, count(*) FILTER (WHERE va IS NULL) AS added, count(*) FILTER (WHERE vb IS NULL) AS dropped, count(*) FILTER (WHERE va <> vb) AS changed
 FROM j SEMI JOIN p USING (period, version) GROUP BY ALL""")
def version_changes(spark, d):
    v = T.vintages(spark, d).withColumn("k", F.concat(F.col("org_code").cast("string"), "metric"))
    return V.version_changes(v, ["period", "k"], "value")


@query(f"""{W}, e AS (SELECT o.origin, CAST(p.period AS DATE) AS period FROM {ORIGINS} o, {T.sql_months('1999-01-01', '2000-11-01', 'period')} p WHERE p.period < o.origin),
 u AS (SELECT metric, count(DISTINCT org_code) AS orgs FROM vint GROUP BY metric),
 h AS (SELECT o.origin, v.metric, v.period, count(DISTINCT v.org_code) AS seen FROM vint v, {ORIGINS} o WHERE v.period < o.origin AND v.snapshot <= {T.sql_thursday('o.origin')} GROUP BY ALL)
 SELECT e.origin, u.metric, count(*) * any_value(orgs) AS expected, CAST(sum(orgs - coalesce(seen, 0)) AS BIGINT) AS missing, count(*) FILTER (WHERE coalesce(seen, 0) < orgs) AS periods_short, count(*) FILTER (WHERE seen IS NULL) AS periods_empty
 FROM e CROSS JOIN u LEFT JOIN h ON h.origin = e.origin AND h.metric = u.metric AND h.period = e.period GROUP BY ALL""")
def archive_coverage(spark, d):
    """Of each metric, how many (organisation, period) the versions known at an origin do not cover,
    and in how many periods some or all organisations are missing."""
    o, p = T.months(spark, FIRST, LAST), T.months(spark, "1999-01-01", "2000-11-01", "period")
    expected = o.crossJoin(p).where("period < origin")  # months by months
    v = T.vintages(spark, d)
    orgs = v.groupBy("metric").agg(F.countDistinct("org_code").alias("orgs"))
    first = v.groupBy("metric", "org_code", "period").agg(F.min("snapshot").alias("known"))
    counts = first.groupBy("metric", "period", "known").agg(F.count("*").alias("n"))  # months by months from here on
    days = o.select("origin", V.second_thursday("origin").alias("day"))
    seen = counts.join(F.broadcast(days), (F.col("known") <= F.col("day")) & (F.col("period") < F.col("origin"))).groupBy("origin", "metric", "period").agg(F.sum("n").alias("seen"))
    grid = expected.crossJoin(orgs).join(seen, ["origin", "metric", "period"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return grid.groupBy("origin", "metric").agg(
        F.sum("orgs").alias("expected"), F.sum(F.col("orgs") - F.col("seen")).alias("missing"), F.count_if(F.col("seen") < F.col("orgs")).alias("periods_short"), F.count_if(F.col("seen") == 0).alias("periods_empty")
    )


@query(f"{W}, a AS ({SQL_ASOF}), z AS ({SQL_FINAL}), j AS (SELECT a.value AS x, z.value AS y, a.period AS pa, z.period AS pz FROM a FULL JOIN z USING (period, org_code, metric)) SELECT count(*) FILTER (WHERE pa IS NOT NULL AND pz IS NOT NULL) AS both, count(*) FILTER (WHERE pz IS NULL) AS left_only, count(*) FILTER (WHERE pa IS NULL) AS right_only, count(*) FILTER (WHERE pa IS NOT NULL AND pz IS NOT NULL AND x IS DISTINCT FROM y) AS differ, round(max(abs(x - y)), 6) AS max_diff FROM j")
def compare_slices(spark, d):
    v = T.vintages(spark, d)
    return rounded(score.compare_tables(V.as_of(v, DAY, UPTO), V.latest(v), V.KEY, "value"))


@query(f"{W}, a AS ({SQL_ASOF}), z AS ({SQL_FINAL}) SELECT period, org_code, metric FROM z EXCEPT SELECT period, org_code, metric FROM a")
def late_keys(spark, d):
    v = T.vintages(spark, d)
    return V.latest(v).select(*V.KEY).exceptAll(V.as_of(v, DAY, UPTO).select(*V.KEY))


@query(f"{W}, a AS ({SQL_ASOF}) SELECT period, org_code FROM a WHERE metric = 'A' INTERSECT SELECT period, org_code FROM a WHERE metric = 'R'")
def keys_of_both_metrics(spark, d):
    a = V.as_of(T.vintages(spark, d), DAY, UPTO)
    of = lambda m: a.where(F.col("metric") == m).select("period", "org_code")
    return of("A").intersect(of("R"))


@query(f"{W} SELECT count(*) - count(DISTINCT (period, org_code, metric, version)) AS duplicates, count(*) FILTER (WHERE value < 0) AS negatives, (SELECT count(*) FROM (SELECT period FROM vint WHERE version = 1 GROUP BY period HAVING sum(value) < 4000)) AS months_below_floor, (SELECT count(DISTINCT period) FROM vint WHERE version = 1) AS months FROM vint WHERE version = 1")
def validation_report(spark, d):
    return quality.validate(T.vintages(spark, d).where("version = 1"), 4000.0)


@query(f"""{W}, k AS (SELECT period, org_code, metric, arg_max(group_code, version) AS g FROM vint JOIN hier USING (org_code) GROUP BY ALL)
 SELECT org_code, arg_max(g, period) AS label, max(period) AS latest_period FROM k GROUP BY ALL""")
def latest_label(spark, d):
    v = T.vintages(spark, d).join(T.hierarchy(spark, d), "org_code")
    return v.groupBy("org_code").agg(F.max_by("group_code", "period").alias("label"), F.max("period").alias("latest_period"))


@query(f"WITH {T.SQL_VINT} SELECT period, CAST(org_code AS VARCHAR) AS org_code, metric, CAST(row_number() OVER (PARTITION BY period, org_code, metric ORDER BY snapshot) AS INT) AS version, value, snapshot, value = last_value(value) OVER (PARTITION BY period, org_code, metric ORDER BY snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_latest FROM vint")
def incremental_vintages(spark, d):
    """All versions, kept up by three deliveries out of order, the last with a part of the first again; is_latest
    by the view that was kept up beside them."""
    from tidemark.session import cut, scratch
    from tidemark.sources import stores

    folder = scratch(spark, "vintages")
    v = cut(T.vintages(spark, d).select("period", F.col("org_code").cast("string").alias("org_code"), "metric", "version", F.col("value").cast("double").alias("value"), "snapshot"))
    due = F.pmod(F.month("snapshot"), F.lit(3))
    w = V.Window.partitionBy(*stores.KEY).orderBy("snapshot")
    first = v.where(due == 0).withColumn("version", F.row_number().over(w))
    # the first delivery was wrong in some months, which the last one gives again
    stores.write_vintages(first.withColumn("value", F.col("value") + F.when(F.month("snapshot") == 6, 1).otherwise(0)), folder)
    for part in (due == 1, (due == 2) | (F.month("snapshot") == 6)):
        rows = v.where(part)
        stores.merge_vintages(spark, rows.select(*stores.KEY, "value", "snapshot"), rows.select("period", "snapshot").distinct(), folder)
    last = spark.read.schema(stores.LATEST).parquet(f"{folder}/latest").select(*stores.KEY, F.col("value").alias("_last"))
    kept = spark.read.schema(stores.ALL).parquet(f"{folder}/all").join(last, stores.KEY)
    return kept.select(*stores.KEY, "version", "value", "snapshot", (F.col("value") == F.col("_last")).alias("is_latest"))
