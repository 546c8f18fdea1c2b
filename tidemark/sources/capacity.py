"""Tables of beds and of discharges: grids with group labels or dates above the header, to long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.published import stated_date
from tidemark.functions.text import classify, to_number

HEAD_ROWS = 40
CODE = r"^[A-Z0-9]{3,5}$"
#: Phrases of the public discharge files' headers, as `plain` writes them, and the measures
#: they stand for. A header on who remains also says "no longer meet", and one with a span of hours
#: also says "discharged", so the first phrase found decides.
MEASURES = [
    (("remaining in hospital",), "remaining"),
    (("no longer meet",), "nctr"),
    (("discharged by 17",), "discharged_by_17"),
    (("discharged between 17",), "discharged_after_17"),
    (("17 01",), "discharged_after_17"),
    (("discharged",), "discharged"),
]


def plain(cell: Column) -> Column:
    """The words of a cell in lower case with one space between: runs of letters, digits and %."""
    words = F.split(F.lower(F.coalesce(cell, F.lit(""))), "[^a-z0-9%]+")
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def filled_right(row: str) -> Column:
    """Each cell, or the last one to its left that is not empty."""
    empty = F.array().cast("array<string>")
    return F.aggregate(row, empty, lambda acc, c: F.concat(acc, F.array(F.when(plain(c) != "", c).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))))))


def _row(cells: DataFrame, at: DataFrame, name: str) -> DataFrame:
    """(path, name): the cells of one line of each file."""
    return cells.join(at, "path").where(F.col("line") == F.col("at")).select("path", F.col("cells").alias(name))


def bed_tables(cells: DataFrame) -> DataFrame:
    """path, org_code, org_name, is_total, ga_available, ga_occupied, ga_occupancy, total_available,
    total_occupied of each trust and of England.

    The header is the first row with 'Org Code' and 'General & Acute'; one or two rows above it are
    the groups Available, Occupied and % Occupied. Where a file's shares have a median over 1.5 they
    are percentages. Rows whose code is none, and rows without available beds, are left out.
    """
    low = F.transform("cells", plain)
    head = cells.where((F.col("line") < HEAD_ROWS) & F.array_contains(low, "org code") & F.array_contains(low, "general acute")).groupBy("path").agg(F.min("line").alias("at"))
    above = cells.join(head, "path").where(F.col("line").between(F.col("at") - 2, F.col("at") - 1) & F.array_contains(low, "available") & F.array_contains(low, "occupied"))
    groups = above.groupBy("path").agg(F.max_by("cells", "line").alias("groups"))
    names = _row(cells, head, "names").join(groups, "path").withColumn("groups", filled_right("groups"))
    both = F.zip_with(F.transform("names", plain), F.transform("groups", plain), lambda n, g: F.when(n.isin("general acute", "total"), F.concat_ws("|", n, g)).otherwise(n))
    rows = cells.join(names.select("path", both.alias("names")), "path").join(head, "path").where(F.col("line") > F.col("at"))
    text = lambda label: F.trim(F.coalesce(F.try_element_at("cells", F.array_position("names", label).cast("int")), F.lit("")))
    number = lambda label: to_number(text(label))
    code, name = F.upper(text("org code")), text("org name")
    total = (code == "") & (F.lower(name) == "england")
    out = rows.select(
        "path", F.when(total, "ENG").otherwise(code).alias("org_code"), name.alias("org_name"), total.alias("is_total"),
        number("general acute|available").alias("ga_available"), number("general acute|occupied").alias("ga_occupied"), number("general acute|% occupied").alias("ga_occupancy"),
        number("total|available").alias("total_available"), number("total|occupied").alias("total_occupied"),
    )
    out = out.where((F.col("is_total") | F.col("org_code").rlike(CODE)) & F.coalesce("ga_available", "total_available").isNotNull())
    percent = out.groupBy("path").agg((F.median("ga_occupancy") > 1.5).alias("_percent"))
    return out.join(percent, "path").withColumn("ga_occupancy", F.when(F.col("_percent"), F.col("ga_occupancy") / 100).otherwise(F.col("ga_occupancy"))).drop("_percent")


def status_dates(status: Column) -> Column:
    """struct<published, revised> of 'Published 18 November 2010 and revised 24 November 2011'."""
    after = lambda word: F.regexp_extract(status, rf"(?i){word}(.*?)(?=revised|$)", 1)
    return F.struct(stated_date(after("published")).alias("published"), stated_date(F.regexp_extract(status, r"(?i)revised(.*)$", 1)).alias("revised"))


def quality_flags(cells: DataFrame) -> DataFrame:
    """path, org_code and the heading that it stands under, from a sheet of data-quality notes.

    A row without a code is a heading; a code under several headings keeps the last.
    """
    filled = cells.select("path", "line", F.filter(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "").alias("c")).where(F.size("c") > 0)
    codes = F.filter(F.transform("c", lambda v: F.upper(v)), lambda v: v.rlike(CODE))
    marked = filled.withColumn("codes", codes).withColumn("title", F.when(F.size("codes") == 0, F.element_at("c", 1)))
    heading = F.last("title", ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    under = marked.withColumn("flag", heading).select("path", "line", "flag", F.explode("codes").alias("org_code"))
    return under.groupBy("path", "org_code").agg(F.max_by("flag", "line").alias("flag"))


def discharge_days(cells: DataFrame) -> DataFrame:
    """path, org_code, is_total, day, measure, value of a grid of dates (above) by measures.

    The row of dates is that with most of them above the header ('Org Code'); each date holds to the
    right up to the next. The row of measures is the one below it with most known measures. England
    stands above the header, trusts below it.
    """
    low = F.transform("cells", plain)
    head = cells.where(F.array_contains(low, "org code")).groupBy("path").agg(F.min("line").alias("at"))
    top = cells.join(head, "path").where(F.col("line") < F.col("at"))
    n_days = F.size(F.filter("cells", lambda c: stated_date(c).isNotNull()))
    n_known = F.size(F.filter("cells", lambda c: classify(plain(c), MEASURES).isNotNull()))
    dates = top.where(n_days > 0).groupBy("path").agg(F.max_by("line", F.struct(n_days, -F.col("line"))).alias("day_line"))
    measures = top.join(dates, "path").where((F.col("line") > F.col("day_line")) & (n_known > 0)).groupBy("path").agg(F.max_by("line", F.struct(n_known, -F.col("line"))).alias("measure_line"))
    lines = head.join(dates, "path").join(measures, "path")
    line_of = lambda c: lines.select("path", F.col(c).alias("at"))
    days = _row(cells, line_of("day_line"), "days").select("path", filled_right("days").alias("days"))
    names = _row(cells, line_of("measure_line"), "measures")
    labels = _row(cells, line_of("at"), "labels").select("path", F.transform("labels", plain).alias("labels"))
    at_code = F.array_position("labels", "org code").cast("int")
    body = cells.join(lines, "path").where((F.col("line") > F.col("measure_line")) & (F.col("line") != F.col("at")))
    body = body.join(days, "path").join(names, "path").join(labels, "path")
    england = F.exists(F.slice("cells", F.lit(1), at_code + 1), lambda c: F.upper(F.trim(c)).startswith("ENGLAND"))
    total = (F.col("line") < F.col("at")) & F.coalesce(england, F.lit(False))
    code = F.upper(F.trim(F.try_element_at("cells", at_code)))
    body = body.withColumns({"is_total": total, "org_code": F.when(total, "ENG").otherwise(code)}).where(F.col("is_total") | ((F.col("line") > F.col("at")) & F.col("org_code").rlike(CODE)))
    each = body.select("path", "line", "org_code", "is_total", F.explode(F.arrays_zip("days", "measures", "cells")).alias("c"))
    out = each.select("path", "line", "org_code", "is_total", stated_date("c.days").alias("day"), classify(plain(F.col("c.measures")), MEASURES).alias("measure"), to_number("c.cells").alias("value"))
    return out.where("day is not null and measure is not null")


def discharge_averages(days: DataFrame) -> DataFrame:
    """Monthly averages of each organisation: nctr_avg, remaining_avg, discharged_avg, days_reported,
    days_in_period. Early and late discharges add up where there is no whole; zeros of England are
    lost days."""
    of = lambda m: F.max(F.when(F.col("measure") == m, F.col("value")))
    wide = days.groupBy("path", "org_code", "is_total", "day").agg(*(of(m).alias(m) for m in dict.fromkeys(name for _, name in MEASURES)))
    early, late = F.col("discharged_by_17"), F.col("discharged_after_17")
    parts = F.when(early.isNotNull() | late.isNotNull(), F.coalesce(early, F.lit(0.0)) + F.coalesce(late, F.lit(0.0)))
    wide = wide.withColumn("discharged", F.coalesce("discharged", parts))
    kept = lambda c: F.when(~(F.col("is_total") & (F.col(c) == 0)), F.col(c))
    every = days.groupBy("path").agg(F.countDistinct("day").alias("days_in_period"))
    out = wide.groupBy("path", "org_code", "is_total").agg(*(F.avg(kept(c)).alias(f"{c}_avg") for c in ("nctr", "remaining", "discharged")), F.count(kept("nctr")).alias("days_reported"))
    return out.join(every, "path")
