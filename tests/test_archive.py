"""Mapping files, bed and discharge tables, days of publication, and the build from an archive."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_sources import IDS, RULES, workbook

from tidemark.functions import published as PB
from tidemark.operators import reports as R
from tidemark.sources import build as B
from tidemark.sources import capacity as K
from tidemark.sources import mappings as M
from tidemark.sources import publications as P

COLS = {"org code": "org_code", "org name": "org_name", "icb code": "icb_code", "icb name": "icb_name", "region": "region_label"}
HEAD = ["Org  Code", "Org Name", "ICB Code", "ICB Name", "Region", "Org code"]


def mapping(rows, updated="20th August 2026"):
    return workbook([["Title:", "System Mapping"], ["Last updated:", updated], [], HEAD, *rows])


def test_mapping_files_become_versions(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(mapping([["ra1", " North  Trust", "q1", "One", "London Commissioning Region", "x"], ["RA1", "North Trust", "Q1", "One", "London Commissioning Region", "x"], ["", "note"], ["RB2", "South", "Q2", "Two", "", "x"]]))
    (tmp_path / "b.xlsx").write_bytes(mapping([["RA1", "North Trust", "Q9", "Nine", "London", "x"]], "18.11.2026"))
    cells, failures = P.read_cells(spark, str(tmp_path), ("Data",))
    rows = M.system_mapping(cells, COLS, ("LONDON",))
    got = {(r.path[-6:], r.org_code): (r.org_name, r.icb_code, r.region, str(r.last_updated)) for r in rows.collect()}
    assert got == {("a.xlsx", "RA1"): ("North Trust", "Q1", "LONDON", "2026-08-20"), ("a.xlsx", "RB2"): ("South", "Q2", "LEGACY", "2026-08-20"), ("b.xlsx", "RA1"): ("North Trust", "Q9", "LONDON", "2026-11-18")}
    assert failures.count() == 0
    manifest = spark.createDataFrame([("a.xlsx", "2025-26", "2025-05", "2025-06-12"), ("b.xlsx", "2026-27", "2026-04", "2026-05-14")], "path string, financial_year string, period string, published string")
    history = M.mapping_versions(rows, manifest, str(tmp_path))
    assert {r.icb_code for r in M.selected_version(history).collect()} == {"Q9"}
    assert {(r.icb_code, str(r.valid_from), r.source) for r in M.selected_version(history, "2025-26").collect()} == {("Q1", "2025-04-01", "a.xlsx"), ("Q2", "2025-04-01", "a.xlsx")}
    fill = M.selected_version(history, "2025-26").withColumn("method", F.lit("earlier version"))
    both = {r.org_code: (r.icb_code, r.method) for r in M.reference(M.selected_version(history), fill).collect()}
    assert both == {"RA1": ("Q9", "mapping"), "RB2": ("Q2", "earlier version")}


def test_versions_of_files_whose_names_end_alike(spark):
    rows = spark.createDataFrame([(f"file:/raw/{p}", p) for p in ("a.csv", "data.csv", "x/a.csv")], "path string, org_code string")
    manifest = spark.createDataFrame([(p, "2021-22", m, "2022-05-14") for p, m in (("a.csv", "2022-03"), ("data.csv", "2023-03"), ("x/a.csv", "2023-04"))], "path string, financial_year string, period string, published string")
    for folder in ("/raw", "file:///raw/", "file:/raw"):
        got = {(r.org_code, r.source, str(r.valid_from)) for r in M.mapping_versions(rows, manifest, folder).collect()}
        assert got == {("a.csv", "a.csv", "2022-07-01"), ("data.csv", "data.csv", "2022-07-01"), ("x/a.csv", "x/a.csv", "2023-04-01")}


def test_header_comparisons_and_late_discharges(spark):
    from tidemark.functions import text as X

    heads = ["More than 4 hours", "> 4 hours", "< 4 hours", "Less than 4 hours", "Greater than 12", "A&E 4+ hours"]
    got = [r.h for r in spark.createDataFrame([(h,) for h in heads], "t string").select(X.normalise_header("t").alias("h")).collect()]
    assert got == ["over 4 hours", "over 4 hours", "under 4 hours", "under 4 hours", "over 12", "a e 4+ hours"]
    said = ["Discharged 17:01 to 23:59", "Discharged between 17:01 and 23:59", "Discharged by 17:00", "Patients discharged"]
    got = [r.m for r in spark.createDataFrame([(h,) for h in said], "t string").select(X.classify(K.plain(F.col("t")), K.MEASURES).alias("m")).collect()]
    assert got == ["discharged_after_17", "discharged_after_17", "discharged_by_17", "discharged"]


def test_a_code_with_two_parents_is_refused(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(mapping([["RA1", "N", "Q1", "One", "London", "x"], ["RA1", "N", "Q2", "Two", "London", "x"], ["RB1", "N", "Q2", "Two", "London", "x"]]))
    cells, _ = P.read_cells(spark, str(tmp_path), ("Data",))
    with pytest.raises(ValueError, match="two parents: RA1$"):
        M.system_mapping(cells, COLS, ("LONDON",))
    assert M.system_mapping(cells, COLS, ("LONDON",), strict=False).count() == 3


def test_former_parents_come_from_the_legacy_sheet(spark, tmp_path):
    cols = {"org code": "org_code", "org name": "org_name", "stp": "stp_name"}
    (tmp_path / "a.xlsx").write_bytes(workbook([["Org Code", "Org Name", "STP"], ["ra1", "N", "Old"], ["RA1", "N", "Older"], ["RB1", "M", ""]], "STP Mapping"))
    (tmp_path / "b.xlsx").write_bytes(workbook([["Org Code", "Org Name", "STP"], ["RZ1", "N", "Old"]], "Data"))
    cells, _ = P.read_cells(spark, str(tmp_path), pattern="stp")
    assert [tuple(r) for r in M.former_parents(cells, cols).collect()] == [("RA1", "N", "Old")]


def test_bed_tables(spark, tmp_path):
    group = ["", "", "Available", "", "Occupied", "", "% Occupied", ""]
    head = ["Org Code", "Org Name", "General & Acute", "Total", "General & Acute", "Total", "General & Acute", "Total"]
    (tmp_path / "a.xlsx").write_bytes(workbook([["Title:", "Beds open overnight"], group, [], head, ["", "England", "1,000", "1200", "900", "1000", "90", "83"], ["RA1", "North", "600", "700", "540", "600", "90", "86"], ["RB-1", "?", "1"], ["RC1", "No beds", "-", "", "3"], ["Note 1", "x", "5"]], "NHS Trust by Sector"))
    (tmp_path / "b.xlsx").write_bytes(workbook([group, head, ["RA1", "North", "600", "700", "540", "600", "0.9", "0.86"]], "NHS Trust by Sector"))
    cells, _ = P.read_cells(spark, str(tmp_path), pattern="trust")
    got = {(r.path[-6:], r.org_code): r for r in K.bed_tables(cells).collect()}
    assert set(got) == {("a.xlsx", "ENG"), ("a.xlsx", "RA1"), ("b.xlsx", "RA1")}
    r = got["a.xlsx", "ENG"]
    assert (r.is_total, r.ga_available, r.total_available, r.ga_occupied, r.total_occupied, r.ga_occupancy) == (True, 1000, 1200, 900, 1000, 0.9)
    assert got["b.xlsx", "RA1"].ga_occupancy == 0.9
    s = spark.createDataFrame([("Published 18 November 2010 and revised 24 November 2011",), ("Published 18.11.2010",), ("none",)], "s string").select(K.status_dates(F.col("s")).alias("d")).collect()
    assert [(str(x.d.published), str(x.d.revised)) for x in s] == [("2010-11-18", "2011-11-24"), ("2010-11-18", "None"), ("None", "None")]


def test_quality_flags(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Did not submit"], ["RA1", "North Trust"], [], ["Estimated figures"], ["", "RB1"], ["RA1"]], "Data Quality"))
    cells, _ = P.read_cells(spark, str(tmp_path), pattern="quality")
    assert {r.org_code: r.flag for r in K.quality_flags(cells).collect()} == {"RA1": "Estimated figures", "RB1": "Estimated figures"}


def test_discharge_tables_become_monthly_averages(spark, tmp_path):
    rows = [
        ["Table 2"], ["", "", "", "2022-06-01", "", "", "", "2022-06-02", "", "", ""], ["", "", "", "codes", "x"],
        ["", "", "", "Patients who no longer meet the criteria", "Discharged by 17:00", "Discharged between 17:01 and 23:59", "Patients remaining in hospital who no longer meet", "Patients who no longer meet the criteria", "Discharged by 17:00", "Discharged between 17:01 and 23:59", "Patients remaining in hospital who no longer meet"],
        ["", "", "ENGLAND", "100", "10", "5", "85", "0", "0", "0", "0"], ["Region", "Org Code", "Org Name"],
        ["N", "RA1", "North", "10", "2", "-", "8", "20", "4", "2", "14"], ["N", "bad code!", "?", "1"], ["N", "RB1", "South", "-", "-", "-", "-", "5", "1", "0", "4"],
    ]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows, "Table 2"))
    cells, _ = P.read_cells(spark, str(tmp_path), pattern=r"^table\s*2$")
    got = {r.org_code: (r.nctr_avg, r.remaining_avg, r.discharged_avg, r.days_reported, r.days_in_period) for r in K.discharge_averages(K.discharge_days(cells)).collect()}
    assert got == {"ENG": (100, 85, 15, 1, 2), "RA1": (15, 11, 4, 2, 2), "RB1": (5, 4, 1, 1, 2)}


def test_stated_dates_and_uploads(spark):
    texts = ["20th August 2026", "21 May 2020", "2024-06-19 00:00:00", "18.11.2021", "1/2/21", "31.02.2021", "-", "", None, "no date", "3 Foo 2020", "Published: 3rd sept 2020 (revised)", "(as at 5/6/2022.)", "2021-02-30 1 May 2021"]
    got = [str(r.d) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(PB.stated_date("t").alias("d")).collect()]
    assert got == ["2026-08-20", "2020-05-21", "2024-06-19", "2021-11-18", "2021-02-01", *["None"] * 6, "2020-09-03", "2022-06-05", "2021-05-01"]
    urls = spark.createDataFrame([("https://x.org/wp-content/uploads/sites/2/2021/03/a.csv",), ("https://x.org/a.csv",)], "u string")
    assert [str(r.m) for r in urls.select(PB.upload_month("u").alias("m")).collect()] == ["2021-03-01", "None"]


def test_records_are_dated_anew_and_first_publication(spark):
    d = dt.date
    rows = [("a", d(2021, 3, 9), None, None, d(2021, 3, 1), None, d(2000, 1, 1), "old"), ("b", d(2021, 1, 9), None, None, d(2021, 3, 1), d(2021, 3, 20), None, None), ("c", None, None, None, None, None, d(2000, 1, 1), "old")]
    df = spark.createDataFrame(rows, "id string, title_published date, title_revised date, link_revised date, upload_month date, first_seen date, published date, published_source string")
    got = {r.id: (str(r.published), r.published_source) for r in PB.redated(df).collect()}
    assert got == {"a": ("2021-03-09", "title_block_published"), "b": ("2021-03-20", "first_page_capture (title_block_published 2021-01-09 precedes upload folder 2021-03)"), "c": ("2000-01-01", "old")}
    p = df.groupBy(F.lit(1)).agg(PB.first_publication(F.col("title_published"), F.col("published")).alias("p")).first().p
    assert p == d(2021, 1, 9)


def test_build_from_an_archive(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    csv = lambda *rows: "\n".join(",".join(r) for r in rows).encode()
    (raw / "m1.csv").write_bytes(csv(["Year: 2020-21"], ["Period Name: MARCH"], ["Code", "Name", "Type 1", "Other"], ["R1", "North", "10", "-"], ["-", "Total", "10", ""]))
    (raw / "m1b.csv").write_bytes(csv(["Code", "Name", "Type 1", "Other"], ["R1", "North", "12", "3"], ["R1", "North", "99", "3"]))
    (raw / "wrong.csv").write_bytes(csv(["Period: May 2021"], ["Code", "Name", "Type 1"], ["R1", "North", "7"]))
    (raw / "bad.xlsx").write_bytes(b"no zip")
    log = [{"path": "m1.csv", "period": "2021-03", "snapshot": "2021-04-08"}, {"path": "m1b.csv", "period": "2021-03", "snapshot": "2021-06-10"}, {"path": "wrong.csv", "period": "2021-04", "snapshot": "2021-05-13"}, {"path": "bad.xlsx", "period": "2021-05", "snapshot": "2021-06-10"}, {"path": None, "period": "2021-06", "snapshot": "2021-07-08", "error": "404"}]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, log)))
    manifest = P.read_manifest(spark, str(tmp_path / "manifest.jsonl"))
    report, failures = B.build(spark, manifest, str(raw), str(tmp_path / "out"), r"^code$", RULES, IDS, 5.0)
    every = {(r.metric, r.version): (r.value, str(r.snapshot)) for r in spark.read.parquet(str(tmp_path / "out/all")).collect()}
    assert every == {("type1", 1): (10.0, "2021-04-08"), ("type1", 2): (12.0, "2021-06-10"), ("other", 1): (None, "2021-04-08"), ("other", 2): (3.0, "2021-06-10")}
    assert {r.path[-9:]: r.error for r in failures.collect() if "wrong" in r.path} == {"wrong.csv": "states 2021-05"}
    assert any("bad.xlsx" in r.path for r in failures.collect())
    assert tuple(report.first()) == (0, 0, 0, 1)


def test_grids_and_tags(spark):
    space = {"rate": (0.1, 0.2), "leaves": (7, 15, 31)}
    got = R.config_grid(spark, space, 4).collect()
    assert len({(r.rate, r.leaves) for r in got}) == 4 and got == R.config_grid(spark, space, 4).collect()
    assert Counter(r.seed for r in R.seed_grid(spark.range(3), 5).collect()) == Counter({s: 3 for s in range(5)})
    rows = spark.createDataFrame([("a", 1)], "model string, x int")
    assert R.tagged(rows, {"mode": "asof", "model": "a"}).first().mode == "asof"
    with pytest.raises(ValueError, match="model is not b"):
        R.tagged(rows, {"model": "b"})
    pairs = spark.createDataFrame([("m", "icb", -0.05, -0.01), ("m", "provider", 0.01, 0.03), ("e", "icb", -0.05, 0.01), ("e", "provider", 0.01, 0.02)], "base string, level string, rel double, rel_hi double")
    assert {r.base: r.holds for r in R.reconciliation_verdicts(pairs).collect()} == {"m": True, "e": False}
