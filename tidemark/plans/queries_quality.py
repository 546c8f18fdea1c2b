"""Queries over access marks, keys, joins, hierarchies' histories and manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as K
from tidemark.operators import quality, score
from tidemark.plans import testbed as T
from tidemark.plans.registry import query, rounded

SQL_SHIFT = "(SELECT l_orderkey, CAST(l_shipdate + INTERVAL 24 YEAR AS DATE) AS period, CAST(l_shipdate + INTERVAL 279 MONTH AS DATE) AS origin, l_quantity FROM lineitem)"


def shifted(spark, d):
    """Line items moved into the years of the excluded and sealed windows."""
    line = T.table(spark, d, "lineitem")
    return line.select("l_orderkey", F.add_months(F.col("l_shipdate").cast("date"), 288).alias("period"), F.add_months(F.col("l_shipdate").cast("date"), 279).alias("origin"), "l_quantity")


def _mask(c: str) -> str:
    return f"date_trunc('month', {c}) BETWEEN DATE '2024-01-01' AND DATE '2026-02-01'"


@query(f"SELECT CAST(year(period) AS BIGINT) AS year, count(*) AS rows, count(*) FILTER (WHERE {_mask('origin')} OR {_mask('period')}) AS sealed FROM {SQL_SHIFT} GROUP BY ALL")
def sealed_rows(spark, d):
    s = shifted(spark, d).withColumn("s", quality.sealed())
    return s.groupBy(F.year("period").cast("long").alias("year")).agg(F.count("*").alias("rows"), F.count_if("s").alias("sealed"))


@query(f"SELECT count(*) AS rows, round(sum(l_quantity), 2) AS qty FROM {SQL_SHIFT} WHERE NOT ({_mask('origin')} OR {_mask('period')})")
def drop_sealed(spark, d):
    return quality.drop_sealed(shifted(spark, d)).agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(f"SELECT count(*) FILTER (WHERE NOT (origin BETWEEN DATE '2020-03-01' AND DATE '2021-06-01' OR period BETWEEN DATE '2020-03-01' AND DATE '2021-06-01')) AS assessable, count(*) FILTER (WHERE month(period) IN (12, 1, 2, 3)) AS winter, count(*) AS rows FROM {SQL_SHIFT}")
def assessable_and_winter(spark, d):
    s = shifted(spark, d)
    return s.agg(F.count_if(K.assessable("origin", "period")).alias("assessable"), F.count_if(K.is_winter("period")).alias("winter"), F.count("*").alias("rows"))


@query(f"""SELECT period, CAST(last_day(period) AS DATE) AS month_end, CAST(date_trunc('quarter', period) AS DATE) AS quarter, CAST(year(period) - CASE WHEN month(period) < 4 THEN 1 ELSE 0 END AS BIGINT) AS fy,
 CAST((month(period) + 8) % 12 // 3 + 1 AS BIGINT) AS fyq, (year(period) - CASE WHEN month(period) < 12 THEN 1 ELSE 0 END) || '/' || lpad(CAST((year(period) - CASE WHEN month(period) < 12 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season,
 {T.sql_thursday('period + INTERVAL 1 MONTH')} AS published FROM {T.sql_months('1995-01-01', '2003-12-01', 'period')}""")
def calendar(spark, d):
    m = T.months(spark, "1995-01-01", "2003-12-01", "period")
    return m.select("period", K.month_end("period").alias("month_end"), K.quarter_start("period").alias("quarter"), K.financial_year("period").alias("fy"), K.fy_quarter("period").alias("fyq"), K.season("period").alias("season"), K.publication_date("period").alias("published"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    line = T.table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return quality.duplicate_keys(line, ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return T.table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def preferred_form(spark, d):
    """One row a key, by a preference among forms, then by date."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(rank, "o_orderdate", "o_orderkey")
    return T.table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def anti_join(spark, d):
    return T.table(spark, d, "customer").join(T.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.c_nationkey, a.n AS n_open, b.n AS n_filled FROM (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY ALL) a FULL JOIN (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL) b USING (c_nationkey) WHERE a.n IS DISTINCT FROM b.n AND a.c_nationkey IS NOT NULL")
def count_mismatches(spark, d):
    j = T.table(spark, d, "orders").join(T.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = lambda s, name: j.where(F.col("o_orderstatus") == s).groupBy("c_nationkey").agg(F.count("*").alias(name))
    both = n("O", "n_open").join(n("F", "n_filled"), "c_nationkey", "full_outer")
    return both.where(~F.col("n_open").eqNullSafe(F.col("n_filled")) & F.col("n_open").isNotNull())


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AS flagged FROM orders")
def membership_flag(spark, d):
    big = T.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k")).distinct()
    return T.table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.col("k").isNotNull().alias("flagged"))


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def keys_in_all(spark, d):
    """Intersection of the keys of several tables as one aggregate."""
    line = T.table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N", "R"))
    return line.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n")).where("n = 3").select("l_orderkey")


@query("SELECT s_suppkey, coalesce(r_name, 'UNMAPPED') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 LEFT JOIN region ON n_regionkey = r_regionkey")
def map_lookup(spark, d):
    s, n, r = (T.table(spark, d, t) for t in ("supplier", "nation", "region"))
    n = n.where("n_nationkey < 20")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", F.coalesce("r_name", F.lit("UNMAPPED")).alias("region"))


EDGES = "(SELECT DISTINCT p_partkey AS predecessor, p_partkey + 1 + p_partkey % 3 AS successor FROM part WHERE p_partkey % 7 <> 0)"


@query(f"""WITH RECURSIVE e AS {EDGES}, w AS (SELECT predecessor AS code, successor AS final, 1 AS hop FROM e UNION ALL SELECT w.code, e.successor, hop + 1 FROM w JOIN e ON w.final = e.predecessor WHERE hop < 40)
 SELECT code, arg_max(final, hop) AS final FROM w GROUP BY ALL""")
def canonical_codes(spark, d):
    """Chains of successions followed to their ends."""
    p = T.table(spark, d, "part").where("p_partkey % 7 <> 0")
    e = p.select(F.col("p_partkey").alias("predecessor"), (F.col("p_partkey") + 1 + F.col("p_partkey") % 3).alias("successor")).distinct()
    return quality.follow(spark, e, 40)


@query("WITH o AS (SELECT DISTINCT l_suppkey AS m, l_partkey % 50 AS c FROM lineitem WHERE l_shipdate < DATE '1995-06-01'), n AS (SELECT DISTINCT l_suppkey AS m, l_partkey % 40 AS c FROM lineitem WHERE l_shipdate >= DATE '2001-09-01') SELECT o.c AS old_code, CASE WHEN count(DISTINCT n.c) = 1 THEN min(n.c) END AS new_code, count(DISTINCT n.c) AS n_targets, count(*) AS members FROM o JOIN n USING (m) GROUP BY ALL")
def code_crosswalk(spark, d):
    line = T.table(spark, d, "lineitem")
    of = lambda cond, k: line.where(cond).select(F.col("l_suppkey").alias("m"), (F.col("l_partkey") % k).alias("c")).distinct()
    return quality.crosswalk(of(F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp"), 50), of(F.col("l_shipdate") >= F.lit("2001-09-01").cast("timestamp"), 40), "m", "c")


@query("WITH s(spec, valid_from) AS (VALUES ('a', DATE '1995-01-01'), ('b', DATE '1997-04-15'), ('c', DATE '2000-02-01')), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, spec, spec IS NOT NULL AND date_trunc('month', valid_from) = date_trunc('month', day) AND day(valid_from) > 1 AS mid_month FROM o ASOF LEFT JOIN s ON day >= valid_from")
def specification_in_force(spark, d):
    specs = spark.createDataFrame([("a", "1995-01-01"), ("b", "1997-04-15"), ("c", "2000-02-01")], "spec string, valid_from string").withColumn("valid_from", F.col("valid_from").cast("date"))
    o = T.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    j = quality.in_force(o, specs, "day")
    mid = F.col("spec").isNotNull() & (F.trunc("valid_from", "MM") == F.trunc("day", "MM")) & (F.dayofmonth("valid_from") > 1)
    return j.select("o_orderkey", "spec", F.coalesce(mid, F.lit(False)).alias("mid_month"))


MANIFEST = "(SELECT event_id, CAST(ts AS DATE) AS day, user_id % 40 AS url, CAST(floor(value) AS BIGINT) AS content, event_type FROM events)"


def manifest(spark, d):
    """A download log: each event a fetch of a url with some content on a day."""
    return T.table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"), (F.col("user_id") % 40).alias("url"), F.floor("value").cast("long").alias("content"), "event_type")


@query(f"SELECT content, min(event_id) AS first_event, count(*) AS fetches, count(DISTINCT url) AS urls, min(day) AS first_day FROM {MANIFEST} GROUP BY ALL")
def content_versions(spark, d):
    """Distinct contents, with their first record and first day."""
    return manifest(spark, d).groupBy("content").agg(F.min("event_id").alias("first_event"), F.count("*").alias("fetches"), F.countDistinct("url").alias("urls"), F.min("day").alias("first_day"))


@query(f"SELECT url, arg_max(event_id, (day, event_id)) AS event_id, max(day) AS day FROM {MANIFEST} WHERE day <= DATE '2024-01-15' GROUP BY ALL")
def latest_stored_file(spark, d):
    m = manifest(spark, d).where(F.col("day") <= F.lit("2024-01-15").cast("date"))
    return m.groupBy("url").agg(F.max(F.struct("day", "event_id")).alias("s")).select("url", "s.event_id", "s.day")


@query(f"SELECT url, min(day) AS first_seen, max(day) AS last_seen, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels, count(DISTINCT day) AS days FROM {MANIFEST} GROUP BY ALL")
def sightings(spark, d):
    return manifest(spark, d).groupBy("url").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("labels"), F.countDistinct("day").alias("days"))


@query(f"SELECT event_type, count(*) FILTER (WHERE content IS NULL) AS gaps, CASE WHEN count(*) FILTER (WHERE content > 100) > 0 THEN 'late crash' WHEN count(*) > 0 THEN 'clean' END AS kind FROM {MANIFEST} GROUP BY ALL")
def progress_cases(spark, d):
    late = F.count_if(F.col("content") > 100) > 0
    return manifest(spark, d).groupBy("event_type").agg(F.count_if(F.col("content").isNull()).alias("gaps"), F.when(late, "late crash").when(F.count("*") > 0, "clean").alias("kind"))


@query(f"SELECT a.event_type, count(*) AS both, count(*) FILTER (WHERE abs(a.v - b.v) <= 0.5) AS equal FROM (SELECT event_type, url, avg(content) AS v FROM {MANIFEST} WHERE day <= DATE '2024-01-15' GROUP BY ALL) a JOIN (SELECT event_type, url, avg(content) AS v FROM {MANIFEST} WHERE day > DATE '2024-01-15' GROUP BY ALL) b USING (event_type, url) GROUP BY ALL")
def values_equal(spark, d):
    m = manifest(spark, d)
    cut_ = F.lit("2024-01-15").cast("date")
    v = lambda cond, name: m.where(cond).groupBy("event_type", "url").agg(F.avg("content").alias(name))
    j = v(F.col("day") <= cut_, "a").join(v(F.col("day") > cut_, "b"), ["event_type", "url"])
    return j.groupBy("event_type").agg(F.count("*").alias("both"), F.count_if(F.abs(F.col("a") - F.col("b")) <= 0.5).alias("equal"))


@query("SELECT p_type, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(lo, 4) AS lo, round(hi, 4) AS hi, round(p95, 4) AS p95 FROM (SELECT p_type, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi, quantile_cont(p_retailprice, 0.95) AS p95 FROM part GROUP BY ALL)")
def noise_table(spark, d):
    p = F.col("p_retailprice")
    return rounded(T.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("sd"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.percentile(p, 0.95).alias("p95")), 4)


@query("SELECT coalesce(CAST(y AS VARCHAR), 'all') AS year, round(median(v), 4) AS med, count(*) AS n FROM (SELECT year(o_orderdate) AS y, o_totalprice AS v FROM orders) GROUP BY ROLLUP (y)")
def diagnostics_by_year(spark, d):
    o = T.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_totalprice")
    return rounded(o.rollup("y").agg(F.median("o_totalprice").alias("med"), F.count("*").alias("n")).select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("year"), "med", "n"), 4)


@query("SELECT l_returnflag, n_o, n_f FROM (PIVOT (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linestatus IN ('O', 'F')) ON l_linestatus IN ('O' AS n_o, 'F' AS n_f) USING count(*) GROUP BY l_returnflag)")
def pivoted_counts(spark, d):
    line = T.table(spark, d, "lineitem").where(F.col("l_linestatus").isin("O", "F"))
    out = line.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count("l_linestatus"))
    return out.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("n_o"), F.coalesce("F", F.lit(0)).alias("n_f"))


@query(f"WITH {T.SQL_VINT} SELECT CAST(year(period) AS INT) AS year, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', period, org_code, metric, version, CAST(value AS DECIMAL(28, 4)), snapshot)), 1, 15) AS BIGINT)) AS VARCHAR) AS hash, count(*) AS rows FROM vint GROUP BY ALL")
def table_hashes(spark, d):
    """Order-free hash of the slice of each origin year."""
    v = T.vintages(spark, d).withColumn("year", F.year("period"))
    return quality.portable_hash(v, ["year"])


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) = (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS complete, count(DISTINCT l_suppkey) AS keys FROM lineitem GROUP BY ALL")
def key_sets_complete(spark, d):
    line = T.table(spark, d, "lineitem")
    every = line.agg(F.countDistinct("l_suppkey").alias("n"))
    out = line.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("keys"))
    return out.crossJoin(F.broadcast(every)).select("l_returnflag", (F.col("keys") == F.col("n")).alias("complete"), "keys")


@query("WITH m AS (SELECT DISTINCT l_suppkey, l_returnflag, CAST(date_trunc('year', l_shipdate) AS DATE) AS y FROM lineitem), c AS (SELECT y, l_returnflag, list_sort(list(l_suppkey)) AS ks FROM m GROUP BY ALL) SELECT y AS year, count(*) AS models, count(DISTINCT ks) = 1 AS same FROM c GROUP BY ALL")
def same_keys_across_models(spark, d):
    m = T.table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.trunc("l_shipdate", "YEAR").alias("year")).distinct()
    return quality.same_keys(m, ["year"], "l_returnflag", ["l_suppkey"])


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN x < 0.85 THEN 'below' WHEN x > 0.95 THEN 'above' WHEN x IS NOT NULL THEN 'inside' END AS status FROM (SELECT 0.8 + l_discount * 2 AS x FROM lineitem)) GROUP BY ALL")
def band_status(spark, d):
    x = T.table(spark, d, "lineitem").select(score.band_status(0.8 + F.col("l_discount") * 2).alias("status"))
    return x.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT metric, min(v) AS lo, max(v) AS hi, min(v) <= 25.5 AND max(v) >= 25.5 AND count(v) >= 2 AS fragile FROM (SELECT l_returnflag AS metric, l_linenumber, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL")
def range_fragile(spark, d):
    v = T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), "l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return score.range_fragile(v, ["metric"], "v", 25.5)


@query("WITH f(line) AS (SELECT p_brand || '==' || p_size FROM part WHERE p_partkey % 2 = 0), l(line) AS (SELECT p_brand || '==' || p_size FROM part WHERE p_partkey % 3 = 0) SELECT 'drifted' AS side, count(*) AS n FROM (SELECT * FROM f EXCEPT SELECT * FROM l) UNION ALL SELECT 'missing', count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM f)")
def environment_drift(spark, d):
    p = T.table(spark, d, "part")
    lines = lambda k: p.where(F.col("p_partkey") % k == 0).select(F.concat_ws("==", "p_brand", "p_size").alias("line"))
    one = lambda a, b, side: a.distinct().join(b.distinct(), "line", "left_anti").agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return one(lines(2), lines(3), "drifted").unionByName(one(lines(3), lines(2), "missing"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL")
def daily_events(spark, d):
    """Batch form of the streaming window query."""
    return rounded(T.table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 9)


@query("WITH o AS (SELECT range AS origin FROM range(TIMESTAMP '2018-01-01', TIMESTAMP '2019-12-02', INTERVAL 1 MONTH)) SELECT CAST(origin AS DATE) AS origin FROM o WHERE month(origin + INTERVAL 2 MONTH) IN (12, 1, 2, 3)")
def winter_origins(spark, d):
    return T.months(spark, "2018-01-01", "2019-12-01").where(K.is_winter(F.add_months("origin", 2)))


@query("SELECT strftime(m, '%B-%Y') AS label, 'file-' || p || '-' || strftime(m, '%Y-%m') AS name FROM range(DATE '2020-01-01', DATE '2020-12-02', INTERVAL 1 MONTH) t(m), (VALUES ('a'), ('b')) v(p)")
def url_candidates(spark, d):
    m = T.months(spark, "2020-01-01", "2020-12-01", "m").withColumn("p", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return m.select(F.date_format("m", "MMMM-yyyy").alias("label"), F.concat_ws("-", F.lit("file"), "p", F.date_format("m", "yyyy-MM")).alias("name"))


