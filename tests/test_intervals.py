"""Targets by the origins that saw them, against slices made for every origin."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import second_thursday
from tidemark.operators import vintage as V
from tidemark.plans import catalog, queries_forecast
from tidemark.plans import testbed as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Withdrawn values, several versions on a day, days on a publication day, missing metrics, orgs and periods,
    and origins with gaps."""
    rng = random.Random(5)
    rows = []
    for org in (1, 2, 3, 4, None):
        for month in range(1, 7):
            for metric in ("A", "N", "R", "X"):
                if rng.random() < 0.8:
                    for version in range(1, rng.randint(2, 5)):
                        day = date(1999, min(12, month + rng.randint(0, version)), rng.choice([1, 8, 9, 10, 11, 12, 13, 14, 28]))
                        rows.append((date(1999, month, 1) if rng.random() < 0.97 else None, org, metric, version, None if rng.random() < 0.15 else float(rng.randint(0, 9)), day))
    # a later version never has an earlier day
    days: dict = {}
    for i, r in enumerate(rows):
        days[r[:3]] = max(r[5], days.get(r[:3], r[5]))
        rows[i] = (*r[:5], days[r[:3]])
    v = spark.createDataFrame(rows, "period date, org_code long, metric string, version int, value double, snapshot date")
    v = v.groupBy("period", "org_code", "metric", "version").agg(F.min_by("value", "snapshot").alias("value"), F.min("snapshot").alias("snapshot"))
    o = T.months(spark, "1999-01-01", "1999-12-01").where("month(origin) not in (4, 8)")
    return v, o, V.targets(V.as_of_grid(v, o), T.TARGETS, ["origin", "period", "org_code"]).where("y is not null")


def shown(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_first_releases_are_those_of_the_slices(odd):
    v, o, grid = odd
    want = grid.groupBy("target", "org_code", "period").agg(F.min("origin").alias("first_origin"), F.min_by("y", "origin").alias("y_first"))
    got = V.first_release(v, T.TARGETS, o)
    assert shown(got.drop("resolved")) == shown(want) and got.count() > 20


@pytest.mark.parametrize("level", ["group_code", "region"])
def test_sums_of_parents_are_those_of_the_slices(spark, odd, level):
    v, o, grid = odd
    parents = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], "org_code long, group_code string, region string")
    want = V.roll_up(grid, parents, level, ["origin", "target", "period"])
    sums = V.as_of_sums(v, T.TARGETS, parents, ["group_code", "region"], o)
    got = V.as_of_parents(sums, T.TARGETS, level, o)
    assert shown(got) == shown(want) and {r.series for r in got.collect()} >= {"UNMAPPED"}


def test_lines_are_dealt_once_whatever_the_origins(spark):
    """No exchange of cells by origin: releases come from the parts of the lines."""
    plan = catalog.QUERIES["first_release"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan


def test_parts_of_the_lines_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_LINES", 500, raising=False)
    lines = T.table(spark, SF, "lineitem").count()
    assert T.vintages(spark, SF).rdd.getNumPartitions() >= lines // 500


def test_panels_of_groups_and_regions_read_the_lines_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(T, "vintages", lambda *a, f=T.vintages: calls.append(a) or f(*a))
    catalog.QUERIES["coherence_gaps"](spark, SF)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["model_ets", "panel_spine"])
def test_panels_are_not_read_from_the_lines_again(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan, plan


@pytest.mark.parametrize("level", ["group_code", "region"])
def test_final_sums_of_parents_are_those_of_the_newest_versions(spark, odd, level):
    """Of all periods, whether or not an origin saw them; versions without a number are no one's."""
    v, o, _ = odd
    late = [(date(1999, 12, 1), 1, m, 1, 3.0, date(2000, 2, 10)) for m in "ANR"] + [(date(1999, 5, 1), 2, "A", None, 8.0, None)]
    v = v.select("period", "org_code", "metric", "version", "value", "snapshot").union(spark.createDataFrame(late, "period date, org_code long, metric string, version int, value double, snapshot date"))
    parents = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], "org_code long, group_code string, region string")
    known = v.where("period is not null and version is not null")
    want = V.roll_up(V.targets(V.latest(known), T.TARGETS, ["period", "org_code"]).where("y is not null"), parents, level, ["target", "period"])
    sums = V.as_of_sums(v, T.TARGETS, parents, ["group_code", "region"], o, finals=True)
    got = V.final_parents(sums, T.TARGETS, level)
    assert shown(got) == shown(want) and date(1999, 12, 1) in {r.period for r in got.collect()}
    grid = V.targets(V.as_of_grid(v, o), T.TARGETS, ["origin", "period", "org_code"]).where("y is not null")
    assert shown(V.as_of_parents(sums, T.TARGETS, level, o)) == shown(V.roll_up(grid, parents, level, ["origin", "target", "period"]))


@pytest.mark.parametrize("name", ["two_way_differences", "paired_bootstrap", "cluster_mean", "score_drops"])
def test_scores_and_their_outturns_come_from_one_reading_of_the_lines(spark, monkeypatch, name):
    calls = []
    monkeypatch.setattr(T, "vintages", lambda *a, f=T.vintages: calls.append(a) or f(*a))
    catalog.QUERIES[name](spark, SF)
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["cluster_mean", "cluster_slope"])
def test_scores_of_clusters_are_made_once(spark, name):
    """The mean or the fit, and the residuals, read scores that were written."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan, plan


def test_intervals_of_changes_are_those_of_their_running_sums(spark):
    """Several rows of a version, rows without a version or a change, metrics and orgs that are missing."""
    rng = random.Random(8)
    rows = [(date(1999, rng.randint(1, 6), 1), rng.choice([1, 2, 3, None]), rng.choice("ANRX"), rng.choice([1, 2, 3, 4, None]), rng.choice([1.0, 2.0, -5.0, None])) for _ in range(400)]
    rows.append((None, 1, "A", 1, 1.0))
    c = spark.createDataFrame(rows, "period date, org_code long, metric string, version int, change double").withColumn("snapshot", second_thursday(F.add_months("period", F.col("version"))))
    of = V.Window.partitionBy("org_code", "period", "metric").orderBy(F.asc_nulls_last("version"))
    v = c.groupBy("period", "org_code", "metric", "version", "snapshot").agg(F.sum("change").alias("_c")).withColumn("value", F.sum("_c").over(of)).drop("_c")
    o = T.months(spark, "1999-01-01", "1999-12-01").where("month(origin) not in (4, 8)")
    for finals in (False, True):
        got = V.target_intervals(c, T.TARGETS, o, finals=finals)
        assert shown(got) == shown(V.target_intervals(v, T.TARGETS, o, finals=finals)) and got.where("all is not null").count() > 20
    assert shown(V.first_release(c, T.TARGETS, o)) == shown(V.first_release(v, T.TARGETS, o))


def test_lines_are_the_changes_of_the_versions(spark):
    c, v = T.vintages(spark, SF, "change"), T.vintages(spark, SF)
    o = T.months(spark, "1998-01-01", "2000-12-01")
    assert shown(V.target_intervals(c, T.TARGETS, o, finals=True)) == shown(V.target_intervals(v, T.TARGETS, o, finals=True))


@pytest.mark.parametrize("name", ["paired_bootstrap", "fit_status", "coherence_gaps"])
def test_panels_sort_the_lines_once(spark, monkeypatch, name):
    """One window over the lines, and no sums by version before it."""
    plans = []
    monkeypatch.setattr(queries_forecast, "cut", lambda df, f=queries_forecast.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    catalog.QUERIES[name](spark, SF)
    lines = [p for p in plans if "l_suppkey" in p]
    assert lines and all(p.count("Window [") == p.count("RepartitionByExpression [") and "l_linenumber" in p and "Aggregate [period" not in p.split("Window [")[-1] for p in lines), lines
