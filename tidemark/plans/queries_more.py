"""Further queries: seasons, shapes, spreads, variants, lineages, draws, tables in text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.calendar import season
from tidemark.operators import calibrate as C
from tidemark.plans import testbed as T
from tidemark.plans.queries_forecast import KEYS, SQL_B0, SQL_MODELS, SQL_SCORED, SUM_SQL, forecasts, scored, two_models
from tidemark.plans.queries_vintage import W
from tidemark.plans.registry import query, rounded


@query("SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, round(avg(nullif(floor(value), 0)), 6) AS mean, count(nullif(floor(value), 0)) AS days_reported, count(*) AS n FROM events GROUP BY ALL")
def monthly_averages(spark, d):
    """Averages that leave out zeros standing for missing days."""
    v = F.nullif(F.floor("value"), F.lit(0))
    e = T.table(spark, d, "events").groupBy("event_type", F.trunc("ts", "MM").alias("month"))
    return rounded(e.agg(F.avg(v).alias("mean"), F.count(v).alias("days_reported"), F.count("*").alias("n")))


@query(f"{W}, {SQL_SCORED} SELECT season, target, {SUM_SQL} FROM (SELECT *, (year(period) - CASE WHEN month(period) < 12 THEN 1 ELSE 0 END) || '/' || lpad(CAST((year(period) - CASE WHEN month(period) < 12 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season FROM s WHERE winter) GROUP BY ALL")
def scores_by_season(spark, d):
    from tidemark.operators import score

    s = scored(spark, d).where("winter").withColumn("season", season("period"))
    return rounded(score.summarise(s, ["season", "target"]), 4)


@query(f"{W}, {SQL_B0}, m AS (SELECT origin, series, horizon, max(CASE WHEN target = 'all' THEN q[5] END) AS a, max(CASE WHEN target = 'first' THEN q[5] END) AS b FROM fc GROUP BY ALL) SELECT round(avg(CASE WHEN a < b THEN 1 ELSE 0 END), 6) AS share, count(*) AS n FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def incoherent_medians(spark, d):
    """How often the whole is forecast below its part."""
    mid = A.at("q", 0.5)
    m = forecasts(spark, d).groupBy("origin", "series", "horizon").agg(F.max(F.when(F.col("target") == "all", mid)).alias("a"), F.max(F.when(F.col("target") == "first", mid)).alias("b"))
    return rounded(m.where("a is not null and b is not null").agg(F.avg((F.col("a") < F.col("b")).cast("double")).alias("share"), F.count("*").alias("n")))


@query(f"{W}, {SQL_B0} SELECT target, horizon, count(*) FILTER (WHERE q[9] > 3 * q[5]) AS n_wide, array_to_string(list_slice(list_sort(list(DISTINCT series) FILTER (WHERE q[9] > 3 * q[5])), 1, 4), ',') AS first_series FROM fc GROUP BY ALL")
def wide_forecasts(spark, d):
    """Intervals that blow up, and up to four of the series in which they do."""
    wide = A.at("q", 0.975) > 3 * A.at("q", 0.5)
    some = F.array_sort(F.collect_set(F.when(wide, F.col("series"))))
    out = forecasts(spark, d).groupBy("target", "horizon").agg(F.count_if(wide).alias("n_wide"), some.alias("s"))
    return out.select("target", "horizon", "n_wide", F.when(F.size("s") > 0, F.array_join(F.slice("s", 1, 4), ",")).alias("first_series"))


@query(f"{W}, {SQL_SCORED}, c AS (SELECT series, abs_err - avg(abs_err) OVER (PARTITION BY series) AS y, wis - avg(wis) OVER (PARTITION BY series) AS x FROM s) SELECT round(sum(x * y) / sum(x * x), 6) AS slope, count(*) AS n FROM c")
def within_group_slope(spark, d):
    """Slope after taking out each series' mean."""
    w = Window.partitionBy("series")
    c = scored(spark, d).select((F.col("abs_err") - F.avg("abs_err").over(w)).alias("y"), (F.col("wis") - F.avg("wis").over(w)).alias("x"))
    return rounded(c.agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"), F.count("*").alias("n")))


@query(f"{W}, {SQL_MODELS}, r AS (SELECT a.horizon, b.wis / nullif(a.wis, 0) AS ratio FROM m2 a JOIN m2 b USING (origin, target, series, horizon, period) WHERE a.model = 'naive' AND b.model = 'other') SELECT horizon, round(median(ratio), 6) AS med, round(quantile_cont(ratio, 0.95), 6) AS p95, round(max(ratio), 6) AS hi, count(*) FILTER (WHERE ratio IS NULL) AS undefined FROM r GROUP BY ALL")
def ratios_of_models(spark, d):
    m = two_models(spark, d)
    of = lambda n: m.where(F.col("model") == n).select(*KEYS, F.col("wis").alias(n))
    r = of("naive").join(of("other"), KEYS).select("horizon", (F.col("other") / F.nullif(F.col("naive"), F.lit(0.0))).alias("ratio"))
    return rounded(r.groupBy("horizon").agg(F.median("ratio").alias("med"), F.percentile("ratio", 0.95).alias("p95"), F.max("ratio").alias("hi"), F.count_if(F.col("ratio").isNull()).alias("undefined")))


@query(f"""{W}, {SQL_SCORED}, t AS (SELECT target, horizon, avg(CASE WHEN pit < 0.1 THEN 1 ELSE 0 END) AS lo, avg(CASE WHEN pit >= 0.9 THEN 1 ELSE 0 END) AS hi FROM s GROUP BY ALL)
 SELECT target, horizon, concat_ws('+', CASE WHEN lo > 0.15 THEN 'low tail' END, CASE WHEN hi > 0.15 THEN 'high tail' END, CASE WHEN lo < 0.05 AND hi < 0.05 THEN 'too wide' END) AS shape FROM t""")
def pit_shapes(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    t = scored(spark, d).groupBy("target", "horizon").agg(share(F.col("pit") < 0.1).alias("lo"), share(F.col("pit") >= 0.9).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return t.select("target", "horizon", F.concat_ws("+", F.when(lo > 0.15, "low tail"), F.when(hi > 0.15, "high tail"), F.when((lo < 0.05) & (hi < 0.05), "too wide")).alias("shape"))


@query(f"{W}, {SQL_SCORED} SELECT target, CAST(len(list_filter(q, lambda x: x < y)) AS BIGINT) AS below, count(*) AS n FROM s WHERE NOT list_contains(q, y) GROUP BY ALL")
def ranks_among_quantiles(spark, d):
    """How many quantiles lie below the outturn, where none equals it."""
    s = scored(spark, d).where(~F.array_contains("q", F.col("y")))
    return s.groupBy("target", F.size(F.filter("q", lambda x: x < F.col("y"))).cast("long").alias("below")).agg(F.count("*").alias("n"))


@query(f"{W}, {SQL_SCORED}, a AS (SELECT target, horizon, origin, avg(wis) AS m FROM s GROUP BY ALL), b AS (SELECT target, horizon, stddev_samp(m) AS sd, avg(m) AS mean FROM a GROUP BY ALL) SELECT target, round(avg(sd / mean), 6) AS within_sd, round(stddev_samp(mean) / avg(mean), 6) AS between_sd FROM b GROUP BY ALL")
def spread_within_and_between(spark, d):
    a = scored(spark, d).groupBy("target", "horizon", "origin").agg(F.avg("wis").alias("m"))
    b = a.groupBy("target", "horizon").agg(F.stddev_samp("m").alias("sd"), F.avg("m").alias("mean"))
    return rounded(b.groupBy("target").agg(F.avg(F.col("sd") / F.col("mean")).alias("within_sd"), (F.stddev_samp("mean") / F.avg("mean")).alias("between_sd")))


@query(f"{W}, {SQL_SCORED}, f AS (SELECT *, month(origin) % 5 = 0 AS failed FROM s) SELECT variant, target, round(avg(wis), 4) AS wis, count(*) AS n FROM f, (VALUES ('as issued'), ('failed dropped')) v(variant) WHERE variant = 'as issued' OR NOT failed GROUP BY ALL".replace(", f AS (SELECT *", ", fl AS (SELECT *").replace("FROM f, (VALUES", "FROM fl, (VALUES"))
def score_variants(spark, d):
    """Each score with and without failed forecasts, in one pass."""
    s = scored(spark, d)
    failed = F.month("origin") % 5 == 0
    v = s.withColumn("variant", F.explode(F.when(failed, F.array(F.lit("as issued"))).otherwise(F.array(F.lit("as issued"), F.lit("failed dropped")))))
    return rounded(v.groupBy("variant", "target").agg(F.avg("wis").alias("wis"), F.count("*").alias("n")), 4)


@query(f"{W}, {SQL_B0} SELECT origin, count(*) AS fits, bool_or(q IS NULL OR scale IS NULL) AS any_bad, count(DISTINCT series) AS series FROM fc GROUP BY ALL")
def fit_status(spark, d):
    bad = F.col("q").isNull() | F.col("scale").isNull()
    return forecasts(spark, d).groupBy("origin").agg(F.count("*").alias("fits"), F.bool_or(bad).alias("any_bad"), F.countDistinct("series").alias("series"))


@query("SELECT a AS predecessor, b AS successor, count(*) AS records FROM (SELECT user_id % 30 AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) % 30 AS b FROM events) WHERE a <> b AND b IS NOT NULL GROUP BY ALL")
def lineage_edges(spark, d):
    """Succession edges out of JSON records, each once with the number of records that tell it."""
    e = T.table(spark, d, "events").select((F.col("user_id") % 30).alias("predecessor"), (F.get_json_object("props", "$.k").cast("long") % 30).alias("successor"))
    return e.where("predecessor <> successor and successor is not null").groupBy("predecessor", "successor").agg(F.count("*").alias("records"))





@query("SELECT p_partkey, trim(string_split(line, chr(1))[2]) AS id, trim(split_part(replace(string_split(line, chr(1))[3], chr(2), '|'), ':', 1)) AS title, trim(replace(string_split(line, chr(1))[4], chr(2), '|')) AS day FROM (SELECT p_partkey, replace(replace('| D' || p_size || ' | ' || p_type || ': body \\| more | 2024-01-0' || (p_partkey % 9 + 1) || ' |', '\\|', chr(2)), '|', chr(1)) AS line FROM part)")
def amendment_rows(spark, d):
    """Rows of a pipe table with escaped pipes: id, title and day."""
    line = F.concat(F.lit("| D"), F.col("p_size").cast("string"), F.lit(" | "), F.col("p_type"), F.lit(": body \\| more | 2024-01-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" |"))
    cells = F.split(line, r"(?<!\\)\|")
    cell = lambda i: F.trim(F.regexp_replace(F.element_at(cells, i), r"\\\|", "|"))
    return T.table(spark, d, "part").select("p_partkey", cell(2).alias("id"), F.trim(F.substring_index(cell(3), ":", 1)).alias("title"), cell(4).alias("day"))


@query("WITH o AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) AS seen FROM orders), e AS (SELECT DISTINCT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS ev FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, max(ev) AS dated FROM o LEFT JOIN e ON o.k = e.k AND ev <= seen GROUP BY ALL")
def dated_by_event(spark, d):
    """Each observation dated by the latest event of its key up to it, by a running maximum."""
    o = T.table(spark, d, "orders")
    seen = o.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("ev"))
    ev = o.where("o_orderstatus = 'F'").select(F.lit(None).cast("long").alias("o_orderkey"), F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "MM").alias("day")).distinct()
    both = seen.unionByName(ev.withColumns({"kind": F.lit(0), "ev": F.col("day")}))
    w = Window.partitionBy("k").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("dated", F.max("ev").over(w)).where("kind = 1").select("o_orderkey", "dated")


@query("WITH dr AS (SELECT s_nationkey % 5 AS grp, s_suppkey, k.range AS path, s_acctbal * (1 + ((s_suppkey * 7 + k.range * 13) % 17) / 100.0) AS x FROM supplier, range(40) k), p AS (SELECT grp, path, sum(x) AS x FROM dr GROUP BY ALL) SELECT CAST(grp AS INT) AS grp, round(quantile_cont(x, 0.05), 4) AS lo, round(quantile_cont(x, 0.5), 4) AS mid, round(quantile_cont(x, 0.95), 4) AS hi FROM p GROUP BY ALL")
def coherent_draws(spark, d):
    """Paths are summed one by one before quantiles are taken."""
    path = F.sequence(F.lit(0), F.lit(39))
    draws = F.transform(path, lambda k: F.col("s_acctbal") * (1 + ((F.col("s_suppkey") * 7 + k * 13) % 17) / 100.0))
    s = T.table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("grp"), draws.alias("draws"))
    out = C.aggregate_draws(s, ["grp"])
    return rounded(out.select("grp", A.at("q", 0.05).alias("lo"), A.at("q", 0.5).alias("mid"), A.at("q", 0.95).alias("hi")), 4)


@query("""WITH f AS (SELECT page_id % 2 AS batch, page_id AS secs, url, html FROM pages UNION ALL SELECT 1, page_id + 1000000000, url || '?again', html FROM pages WHERE page_id % 3 = 0),
 n AS (SELECT batch, secs, coalesce(url, '') AS url, coalesce(nullif(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), ''), 'unnamed') AS filename, sha256(html) AS sha, CAST(strlen(html) AS BIGINT) AS bytes FROM f),
 o AS (SELECT *, sha IS NOT NULL AND row_number() OVER (PARTITION BY sha ORDER BY batch, secs, url) = 1 AS is_new FROM n),
 k AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY batch, secs, url) AS place, regexp_extract(filename, '(\\.[A-Za-z0-9]+)$', 1) AS ext FROM o WHERE is_new),
 m AS (SELECT sha, CASE WHEN place = 1 THEN filename ELSE left(filename, length(filename) - length(ext)) || '-' || left(sha, 12) || ext END AS name FROM k)
 SELECT url, filename, o.sha AS sha256, name, bytes, is_new FROM o LEFT JOIN m ON m.sha = o.sha""")
def kept_once(spark, d):
    """Pages fetched in two rounds, a third of them twice: each body kept once, under a name of its own."""
    from tidemark.session import scratch
    from tidemark.sources import archive

    folder = scratch(spark, "archive")
    pages = T.table(spark, d, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content"))
    again = pages.where("page_id % 3 = 0").select(F.lit(1).alias("batch"), F.col("page_id") + 1000000000, F.concat("url", F.lit("?again")), "content")
    both = pages.select((F.col("page_id") % 2).cast("int").alias("batch"), F.col("page_id").alias("at"), "url", "content").union(again)
    named = both.select("batch", "url", F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1).alias("filename"), F.timestamp_seconds("at").alias("fetched"), "content")
    for batch in (0, 1):
        archive.keep(spark, named.where(F.col("batch") == batch).drop("batch"), folder)
    return archive.fetches(spark, folder).select("url", "filename", "sha256", "name", "bytes", "is_new")
