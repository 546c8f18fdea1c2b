"""Increments of the archive against one build of it all, and sealed tables whose writing was cut short."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_sources import IDS, RULES

from tidemark.sources import archive as A
from tidemark.sources import build as B
from tidemark.sources import publications as P
from tidemark.sources import stores

LOG = [("m1.csv", "2020-12", "2021-01-14"), ("m2.csv", "2021-01", "2021-02-11"), ("m1b.csv", "2020-12", "2021-06-10"), ("m1c.csv", "2020-12", "2021-03-11"), ("bad.xlsx", "2021-02", "2021-03-11"), ("m2.xlsx", "2021-03", "2021-04-08")]
FILES = {"m1.csv": ["R1,North,10,1", "R2,South,5,"], "m2.csv": ["R1,North,11,2"], "m1b.csv": ["R1,North,14,1", "R9,East,1,1"], "m1c.csv": ["R1,North,12,1", "-,Total,12,1"], "m3.csv": ["R2,South,6,6"]}


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, rows in FILES.items():
        (folder / name).write_text("\n".join(["Code,Name,Type 1,Other", *rows]))
    for name in ("bad.xlsx", "m2.xlsx"):
        (folder / name).write_bytes(b"no zip")
    return folder


def manifest(spark, tmp_path, log):
    at = tmp_path / f"{len(log)}-{log[-1][0]}.jsonl"
    at.write_text("\n".join(json.dumps({"path": p, "period": m, "snapshot": d}) for p, m, d in log))
    return P.read_manifest(spark, str(at))


def state(spark, folder):
    read = lambda t: sorted(map(repr, spark.read.parquet(f"{folder}/{t}").drop("year").collect()))
    return read("all"), read("latest")


def rebuilt(spark, tmp_path, raw, log, name):
    B.build(spark, manifest(spark, tmp_path, log), str(raw), str(tmp_path / name), r"^code$", RULES, IDS)
    return state(spark, tmp_path / name)


def test_increments_equal_one_build(spark, tmp_path, raw):
    out = str(tmp_path / "kept")
    go = lambda log: {r.path.rsplit("/", 1)[1] for r in B.update(spark, manifest(spark, tmp_path, log), str(raw), out, r"^code$", RULES, IDS).collect()}
    assert go(LOG[:2]) == set() and state(spark, out) == rebuilt(spark, tmp_path, raw, LOG[:2], "a")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    assert go(LOG[:2]) == set() and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet")}
    assert go(LOG[:3]) == set() and state(spark, out) == rebuilt(spark, tmp_path, raw, LOG[:3], "b")
    # an earlier snapshot that comes late, and two files that fail
    assert go(LOG) == {"bad.xlsx", "m2.xlsx"} and state(spark, out) == rebuilt(spark, tmp_path, raw, LOG, "c")
    # a CSV takes the place of a workbook of the same day, and a file is withdrawn
    log = [*(x for x in LOG if x[0] != "m1b.csv"), ("m3.csv", "2021-03", "2021-04-08")]
    assert go(log) == set() and state(spark, out) == rebuilt(spark, tmp_path, raw, log, "d")
    assert {(r.org_code, r.version) for r in spark.read.parquet(f"{out}/all").where("metric = 'type1'").collect()} == {("R1", 1), ("R1", 2), ("R2", 1)}


@pytest.mark.parametrize("at", ["latest", "all", "log"])
def test_an_update_that_was_cut_short_is_done_again(spark, tmp_path, raw, monkeypatch, at):
    out = str(tmp_path / "kept")
    go = lambda log: B.update(spark, manifest(spark, tmp_path, log), str(raw), out, r"^code$", RULES, IDS)
    go(LOG[:3])
    log = [LOG[0], LOG[1], LOG[3]]  # m1b.csv is withdrawn
    with monkeypatch.context() as m:
        if at == "log":
            m.setattr(B, "delete_folder", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        else:
            inner = stores._replace
            m.setattr(stores, "_replace", lambda s, t, f, y: (_ for _ in ()).throw(OSError("lost")) if f.endswith(at) else inner(s, t, f, y))
        with pytest.raises(OSError, match="lost"):
            go(log)
    go(log)
    assert state(spark, out) == rebuilt(spark, tmp_path, raw, log, "whole")


@pytest.mark.parametrize("step", ["_write_aside", "_rename", "_seal"])
def test_a_put_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch, step):
    s = stores.Store(spark, str(tmp_path / "store"))
    table = spark.range(20).withColumn("x", F.col("id") * 2)
    with monkeypatch.context() as m:
        m.setattr(stores.Store, step, lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            s.put("t", table)
    assert s.state("t") != "sealed"
    with pytest.raises(FileNotFoundError):
        s.load("t")
    s.put("t", table, {"made": "again"})
    assert s.load("t").count() == 20 and s.records().count() == 1
    with pytest.raises(FileExistsError):
        s.put("t", table)
    s.put("u", table)
    assert {r.name for r in s.records().collect()} == {"t", "u"}


def fetched(spark, rows):
    made = [(u, n, datetime.datetime(2021, 1, 1) + datetime.timedelta(hours=h), None if c is None else bytearray(c.encode())) for u, n, h, c in rows]
    return spark.createDataFrame(made, "url string, filename string, fetched timestamp, content binary")


def test_bytes_are_kept_once(spark, tmp_path, monkeypatch):
    folder, sha = str(tmp_path / "archive"), lambda c: hashlib.sha256(c.encode()).hexdigest()
    names = lambda: {r.name: bytes(r.content).decode() for r in A.contents(spark, folder).collect()}
    files = lambda: sorted((tmp_path / "archive").rglob("*.parquet"))
    one = fetched(spark, [("u1", "a.csv", 1, "x"), ("u2", "b.csv", 2, "x"), ("u3", "a.csv", 3, "y"), ("u4", None, 4, "z"), (None, "c", 5, None)])
    assert A.keep(spark, one, folder) == 3
    assert names() == {"a.csv": "x", f"a-{sha('y')[:12]}.csv": "y", "unnamed": "z"}
    log = {(r.url, r.fetched.hour): r for r in A.fetches(spark, folder).collect()}
    assert [log["u2", 2][c] for c in ("sha256", "name", "bytes", "is_new", "error")] == [sha("x"), "a.csv", 1, False, None]
    assert log["u1", 1].is_new and log["", 5].error == "no content" and log["", 5].sha256 is None
    before = {p: p.stat().st_mtime_ns for p in files() if p.stat().st_size}
    assert A.keep(spark, one, folder) == 0 and A.fetches(spark, folder).count() == 5
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    # lost between bodies and log
    two = fetched(spark, [("u1", "a.csv", 9, "w"), ("u5", "d.tar", 9, "x"), ("u6", "unnamed", 9, "v")])
    with monkeypatch.context() as m:
        inner = A.contents
        calls = iter([True])
        m.setattr(A, "contents", lambda *a: inner(*a) if next(calls, False) else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            A.keep(spark, two, folder)
    assert A.keep(spark, two, folder) == 0
    assert names() == {"a.csv": "x", f"a-{sha('y')[:12]}.csv": "y", "unnamed": "z", f"a-{sha('w')[:12]}.csv": "w", f"unnamed-{sha('v')[:12]}": "v"}
    assert A.fetches(spark, folder).count() == 8 and A.contents(spark, folder).count() == 5
