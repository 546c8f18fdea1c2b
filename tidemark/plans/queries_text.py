"""Queries over messy text: headers, numbers, labels, links, dates, tables in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as K
from tidemark.functions import text as X
from tidemark.plans import testbed as T
from tidemark.plans.registry import query

RULES = [(r"^promo", "promotional"), (r"brass$", "brass"), (r"\bplated\b", "plated"), (r"^(economy|small)", "cheap"), (r"over 4", "over_four_hours")]
SQL_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '>|greater than|more than', ' over ', 'g'), '<|less than', ' under ', 'g'), '[^a-z0-9+]+', ' ', 'g'))"
SIGNS = [" >", " < ", " More than ", " LESS THAN ", " greater than ", " 4+ "]
RAW = f"p_type || ' & ' || p_brand || (CASE p_partkey % 6 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SIGNS))} END) || p_size"


def raw_headers(spark, d):
    return T.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_type"), F.lit(" & "), F.col("p_brand"), F.element_at(F.array(*map(F.lit, SIGNS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_size").cast("string")).alias("h"))


@query(f"SELECT p_partkey, {SQL_NORM.format(c=RAW)} AS header FROM part")
def normalised_headers(spark, d):
    return raw_headers(spark, d).select("p_partkey", X.normalise_header("h").alias("header"))


_case = " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{n}'" for p, n in RULES)


@query(f"SELECT p_partkey, CASE {_case} ELSE 'unmapped__' || replace(h, ' ', '_') END AS canonical FROM (SELECT p_partkey, {SQL_NORM.format(c=RAW)} AS h FROM part)".replace("\\b", "\\b"))
def mapped_headers(spark, d):
    return raw_headers(spark, d).select("p_partkey", X.map_header("h", RULES).alias("canonical"))


NUMBERS = "CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN ' 1,2' || p_size || ' ' WHEN 2 THEN '*' WHEN 3 THEN CAST(p_retailprice AS VARCHAR) ELSE 'n/a' END"


@query(f"SELECT p_partkey, CASE WHEN t NOT IN ('', '-', '*') THEN try_cast(t AS DOUBLE) END AS value FROM (SELECT p_partkey, replace(trim({NUMBERS}), ',', '') AS t FROM part)")
def parsed_numbers(spark, d):
    p = T.table(spark, d, "part")
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "-").when(k == 1, F.concat(F.lit(" 1,2"), F.col("p_size").cast("string"), F.lit(" "))).when(k == 2, "*").when(k == 3, F.col("p_retailprice").cast("string")).otherwise("n/a")
    return p.select("p_partkey", X.to_number(raw).alias("value"))


@query("SELECT c_custkey, coalesce(regexp_matches(trim(code), '^(-|TOTAL|ENG)$'), false) OR coalesce(lower(trim(name)) IN ('total', 'england', 'national total'), false) AS total FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN 'TOTAL' WHEN 2 THEN NULL ELSE 'R1' END AS code, CASE c_custkey % 3 WHEN 0 THEN ' England' ELSE c_name END AS name FROM customer)")
def total_rows(spark, d):
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, " - ").when(k % 4 == 1, "TOTAL").when(k % 4 == 3, "R1")
    name = F.when(k % 3 == 0, " England").otherwise(F.col("c_name"))
    return T.table(spark, d, "customer").select("c_custkey", X.is_total(code, name).alias("total"))


@query("SELECT label, CASE WHEN r IN ('ASIA', 'EUROPE', 'AMERICA') THEN r ELSE 'LEGACY' END AS region FROM (SELECT label, trim(regexp_replace(regexp_replace(regexp_replace(upper(label), '\\([^)]*\\)', ' ', 'g'), '^\\s*(NHS )?(ENGLAND )?', ''), '\\s+', ' ', 'g')) AS r FROM (SELECT CASE r_regionkey % 3 WHEN 0 THEN 'NHS England ' || r_name WHEN 1 THEN lower(r_name) || ' (commissioning)' ELSE '  ' || r_name END AS label FROM region))")
def region_labels(spark, d):
    k = F.col("r_regionkey") % 3
    label = F.when(k == 0, F.concat(F.lit("NHS England "), "r_name")).when(k == 1, F.concat(F.lower("r_name"), F.lit(" (commissioning)"))).otherwise(F.concat(F.lit("  "), "r_name"))
    return T.table(spark, d, "region").select(label.alias("label"), X.normalise_region(label, ("ASIA", "EUROPE", "AMERICA")).alias("region"))


MEASURES = [(("standard", "steel"), "standard steel"), (("steel",), "steel"), (("promo",), "promo"), (("a",), "other")]


@query("SELECT p_partkey, CASE WHEN contains(t, 'standard') AND contains(t, 'steel') THEN 'standard steel' WHEN contains(t, 'steel') THEN 'steel' WHEN contains(t, 'promo') THEN 'promo' WHEN contains(t, 'a') THEN 'other' END AS measure FROM (SELECT p_partkey, lower(p_type) AS t FROM part)")
def classified_measures(spark, d):
    return T.table(spark, d, "part").select("p_partkey", X.classify("p_type", MEASURES).alias("measure"))


@query("SELECT page_id, 'https://' || lower(regexp_extract(u, '^[A-Za-z]+://([^/]+)', 1)) || regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/]+(.*)$', 1), '/$', '') AS url FROM (SELECT page_id, regexp_replace(trim(url), '[#?].*$', '') AS u FROM pages)")
def canonical_urls(spark, d):
    return T.table(spark, d, "pages").select("page_id", X.canonical_url("url").alias("url"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, CASE WHEN regexp_matches(url, '[?]page=') THEN 'listing' WHEN contains(url, '#') THEN 'anchor' ELSE 'plain' END AS kind FROM pages")
def parsed_links(spark, d):
    u = F.col("url")
    kind = F.when(u.rlike("[?]page="), "listing").when(u.contains("#"), "anchor").otherwise("plain")
    return T.table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "^https?://[^/]+/([a-z]{2})/", 1).alias("lang"), F.nullif(F.regexp_extract(u, "/([0-9]+)", 1), F.lit("")).try_cast("long").alias("number"), kind.alias("kind"))


@query("SELECT href, min(page_id) AS first_page, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL")
def links_of_pages(spark, d):
    """Links in pages, each once with the first page that has it."""
    p = T.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return p.groupBy("href").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


DATES = "(VALUES ('2026-08-20', DATE '2026-08-20'), ('20.8.26', DATE '2026-08-20'), ('3/02/2021', DATE '2021-02-03'), ('20th August 2026', DATE '2026-08-20'), ('1st MARCH 2019', DATE '2019-03-01'), ('31.02.2020', NULL), ('soon', NULL), ('', NULL))"


@query(f"SELECT t AS raw, d AS day FROM {DATES} v(t, d)")
def parsed_dates(spark, d):
    raw = spark.createDataFrame([(t,) for t in ("2026-08-20", "20.8.26", "3/02/2021", "20th August 2026", "1st MARCH 2019", "31.02.2020", "soon", "")], "raw string")
    return raw.select("raw", K.parse_date("raw").alias("day"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))) AS table_lines, trim(list_extract(string_split(list_extract(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), 1), '|'), 1)) AS first_cell FROM documents")
def tables_in_text(spark, d):
    """Pipe tables in texts: their lines, and the first cell."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("|"))
    return T.table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("table_lines"), F.trim(F.try_element_at(F.split(F.try_element_at(lines, F.lit(1)), r"\|"), F.lit(1)), F.lit(" ")).alias("first_cell"))


@query("SELECT user_id % 10 AS family, count(*) AS n, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS hi, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS lo FROM events GROUP BY ALL")
def json_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return T.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("family")).agg(F.count("*").alias("n"), F.max(k).alias("hi"), F.min(k).alias("lo"))
