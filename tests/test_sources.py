import io
import zipfile
from html import escape

import pytest
from pyspark.sql import functions as F

from tidemark.sources import publications as P
from tidemark.sources import stores

RULES = [(r"^code$|org code", "org_code"), (r"^name$|org name", "org_name"), (r"type 1", "type1"), (r"other", "other"), (r"^note", "DROP")]
IDS = {"org_code": "org_code", "org_name": "org_name"}


def workbook(rows, name="Data"):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(r) if v != "") + "</row>" for i, r in enumerate(rows, 1))
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Cover" sheetId="1" r:id="a"/><sheet name="{name}" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {m}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {m}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    rows = [["Period: March 2021"], ["", "", "Attendances", ""], ["Code", "Name", "Type 1", "Other"], ["R1", "North", "1,200", "-"], ["-", "Total", "1,200", "7"]]
    (tmp_path / "a.csv").write_bytes("﻿".encode() + "\n".join(",".join(f'"{c}"' for c in r) for r in rows).encode())
    (tmp_path / "b.csv").write_bytes("Org code,Org name,Type 1,Note\nR2,Caf\xe9,5,x\n".encode("cp1252"))
    (tmp_path / "c.xlsx").write_bytes(workbook([["Code", "Name", "Type 1"], ["R3", "South", "33"]]))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "old.xls").write_bytes(b"?")
    return str(tmp_path)


def test_files_become_one_long_table(spark, folder):
    cells, failures = P.read_cells(spark, folder, ("Data",))
    long = P.to_long(P.with_header(cells, r"^(org )?code$"), RULES, IDS)
    got = {(r.org_code, r.metric): (r.value, r.is_total) for r in long.collect()}
    assert got == {("R1", "type1"): (1200.0, False), ("R1", "other"): (None, False), ("-", "type1"): (1200.0, True), ("-", "other"): (7.0, True), ("R2", "type1"): (5.0, False), ("R3", "type1"): (33.0, False)}
    assert {r.path.rsplit("/", 1)[1] for r in failures.collect()} == {"bad.xlsx", "old.xls"}
    assert [str(r.period) for r in P.title_period(cells).collect()] == ["2021-03-01"]
    assert "Café" in {r.org_name for r in long.collect()}


def test_preferred_formats(spark):
    files = spark.createDataFrame([("x/1.xls", "m"), ("x/1.xlsx", "m"), ("x/2.csv", "n"), ("x/2.xlsx", "n")], "path string, period string")
    assert {r.path for r in P.prefer_formats(files, ["period"]).collect()} == {"x/1.xlsx", "x/2.csv"}


def test_links_of_pages(spark):
    pages = spark.createDataFrame([(1, '<ul><li><a href="/a.csv">March <b>2021</b></a></li><a>none</a></ul>'), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in P.page_links(pages).collect()] == [(1, "/a.csv", "March 2021")]


def test_store_seals_tables(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    table = spark.range(50).withColumn("x", F.col("id") * 2)
    s.put("t", table, {"made": "here"})
    assert s.load("t").count() == 50 and s.records().first().rows == 50
    with pytest.raises(Exception, match="already exists"):
        s.put("t", table)
    table.limit(3).write.mode("append").parquet(str(tmp_path / "store/t"))
    with pytest.raises(ValueError, match="not what was stored"):
        s.load("t")


def test_slices_and_recomputation(spark, tmp_path):
    t = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], "model string, mode string, v int")
    assert stores.write_slices(t, ["model", "mode"], str(tmp_path / "out")) == ["model"]
    assert stores.recomputed(t, t).isEmpty() and stores.recomputed(t, t.limit(1)).count() == 1
    assert stores.markdown(t).startswith("| model | mode | v |")


def test_vintages_are_written_by_year(spark, tmp_path):
    from tidemark.plans import testbed as T

    v = T.vintages(spark, "/root/testdata/sf0.001")
    stores.write_vintages(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v/all")).count() == v.count()
