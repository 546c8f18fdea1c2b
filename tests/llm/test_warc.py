"""WARC bundles: format, index, copies and round trips."""

import hashlib
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import warc

LONG = "x" * 100


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html)."""
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h or "")
        later = len(data) >= 100 and first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", first if later else None))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("digest", "record", "payload", "first", "bundle", "size", "_join_key", "_deal"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(seed):
    rng = random.Random(seed)
    bodies = [None, "", "é" * 49, "é" * 50, LONG, "<p>" + "word " * 500, "y" * 99, "WARC/1.1\r\n\r\n" * 20, "\r\n" * 80]
    rows = [(i, rng.choice([None, "http://a.example/ü b", "http://b/\r\nX: y"]), rng.choice([*bodies, f"{i} " * 60])) for i in range(120)]
    return [*rows, (3, None, LONG), (3, None, LONG), (None, "u", LONG), (None, None, None), (-5, "u", LONG)]


def read(spark, folder, **how):
    return spark.createDataFrame(warc.records(spark, folder, **how).collect(), warc.RECORDS)


@pytest.mark.parametrize("sizes", [(1 << 18, 8 << 20), (600, 2000), (1, 1)])
def test_archive_matches_brute_force(spark, tmp_path, sizes):
    rows = rows_of(sizes[0])
    pages = table(spark, rows)
    warc.write_archive(warc.with_first_copies(pages, pages.page_id, pages.url, pages.html), str(tmp_path / "a"), *sizes)
    got = warc.records(spark, str(tmp_path / "a")).collect()
    number = lambda x: None if x in (None, "null") else int(x)
    assert sorted(repr((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to))) for r in got) == sorted(map(repr, brute(rows)))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    bodies = sorted((h or "").encode() for (_, _, h), b in zip(rows, brute(rows), strict=True) if b[3] == "response")
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == bodies
    responses = {r.record_id: r.payload_digest for r in got if r.record_type == "response"}
    assert all(responses[r.refers_to] == r.payload_digest for r in got if r.record_type == "revisit")
    assert all(r.target is None or not re.search(r"\s", r.target) for r in got)


def test_index_points_into_frames(spark, tmp_path):
    folder = str(tmp_path / "a")
    pages = table(spark, rows_of(1)).coalesce(1)
    warc.write_archive(warc.with_first_copies(pages, pages.page_id, pages.url, pages.html).coalesce(1), folder, 900, 4000)
    bundles = {r.bundle: bytes(r.content) for r in spark.read.parquet(f"{folder}/bundles").collect()}
    index = warc.index_of(spark, folder).collect()
    assert len(bundles) > 1 and len({(r.bundle, r.frame) for r in index}) > len(bundles)
    whole = {b: 0 for b in bundles}
    for r in index:
        frame = warc.read_frame(bundles[r.bundle], warc.read_seek_table(bundles[r.bundle])[r.frame])
        assert warc.parse_record(frame[r.offset : r.offset + r.length])[0] == r.record_id
        whole[r.bundle] += r.length
    for name, content in bundles.items():
        text = warc.plain(content)
        assert len(text) == whole[name] == sum(s for _, _, s in warc.read_seek_table(content))
        assert text.startswith(b"WARC/1.1\r\n")


def test_lookup_and_export(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.archive(table(spark, rows_of(2)), folder)
    wanted = spark.createDataFrame([("7",), ("11",), ("7",), ("no such",)], "record_id string")
    got = {r.record_id: r for r in warc.lookup(spark, folder, wanted).collect()}
    every = {r.record_id: r for r in warc.records(spark, folder).collect()}
    assert set(got) == {"7", "11"} and all(got[k] == every[k] for k in got)
    files = warc.export(spark, folder, str(tmp_path / "files")).collect()
    assert warc.export(spark, folder, str(tmp_path / "files")).count() == len(files)
    assert len(list((tmp_path / "files").iterdir())) == len(files)
    total = sum(len(re.findall(rb"WARC-Record-ID: ", warc.plain((tmp_path / "files" / f"{r.bundle}.warc.zst").read_bytes()))) for r in files)
    assert total == len(rows_of(2))


def test_damage_is_told():
    bundler = warc.Bundler("b")
    bundler.add("1", warc.make_record("1", None, b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    ((_, content, _),) = bundler.close()
    with pytest.raises(ValueError, match="no seek table"):
        warc.read_seek_table(content[:-1])
    record = warc.read_frame(content, warc.read_seek_table(content)[0])
    with pytest.raises(ValueError, match="not that of its digest"):
        warc.parse_record(record.replace(b"payload\r\n", b"paxload\r\n"))
    with pytest.raises(zstandard.ZstdError):
        warc.read_frame(b"\0" * len(content), (0, 20, 5))


def test_empty_table_and_a_very_long_page(spark, tmp_path):
    warc.archive(table(spark, rows_of(3)).limit(0), str(tmp_path / "none"))
    assert warc.records(spark, str(tmp_path / "none")).count() == 0
    body = "long page " * 2_000_000
    warc.archive(table(spark, [(1, "u", body), (2, "u", body), (3, "v", "short")]), str(tmp_path / "long"))
    got = {r.record_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.records(spark, str(tmp_path / "long"), payloads=False).collect()}
    assert got == {"1": ("response", 20_000_000, None), "2": ("revisit", 20_000_000, "1"), "3": ("response", 5, None)}
