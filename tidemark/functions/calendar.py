"""Calendar columns: publication days, months, quarters, financial years, seasons, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COVID = ("2020-03-01", "2021-06-01")
WINTER_MONTHS = (12, 1, 2, 3)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_floor(c: Column | str) -> Column:
    return F.trunc(col(c), "MM")


def second_thursday(month: Column | str) -> Column:
    """Second Thursday of the month that starts at `month`."""
    return F.date_add(F.next_day(F.date_sub(month_floor(month), 1), "THU"), 7)


def publication_date(period: Column | str) -> Column:
    """A period is published on the second Thursday of the month after it."""
    return second_thursday(F.add_months(month_floor(period), 1))


def month_end(c: Column | str) -> Column:
    return F.last_day(col(c))


def quarter_start(c: Column | str) -> Column:
    return F.trunc(col(c), "QUARTER")


def quarter_end(c: Column | str) -> Column:
    return F.last_day(F.add_months(quarter_start(c), 2))


def financial_year(c: Column | str) -> Column:
    """April to March, named by its first year."""
    return (F.year(col(c)) - (F.month(col(c)) < 4).cast("int")).cast("long")


def fy_label(c: Column | str) -> Column:
    fy = financial_year(c)
    return F.concat(fy.cast("string"), F.lit("-"), F.lpad(F.pmod(fy + 1, F.lit(100)).cast("string"), 2, "0"))


def fy_quarter(c: Column | str) -> Column:
    """1 for April to June."""
    return (F.pmod(F.floor((F.month(col(c)) - 1) / 3) + 3, F.lit(4)) + 1).cast("long")


def is_winter(c: Column | str) -> Column:
    return F.month(col(c)).isin(*WINTER_MONTHS)


def season(c: Column | str) -> Column:
    """Winter season, named from its December: 2019/20 for December 2019 to March 2020."""
    y = F.year(col(c)) - (F.month(col(c)) < 12).cast("int")
    return F.concat(y.cast("string"), F.lit("/"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def in_window(c: Column | str, first: str, last: str) -> Column:
    return col(c).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def assessable(origin: Column | str, period: Column | str, window: tuple[str, str] = COVID) -> Column:
    """Neither end of the forecast lies in the excluded window."""
    return ~(in_window(origin, *window) | in_window(period, *window))


def months_between(first: Column | str, last: Column | str) -> Column:
    """Whole months from one month start to another."""
    return ((F.year(col(last)) - F.year(col(first))) * 12 + F.month(col(last)) - F.month(col(first))).cast("long")


def parse_date(text: Column | str) -> Column:
    """ISO, dd.mm.yy(yy), dd/mm/yyyy and '20th August 2026'; null for anything else."""
    t = F.trim(col(text))
    plain = F.regexp_replace(t, r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")
    dotted = F.regexp_replace(t, "[.]", "/")
    out = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    out = out.when(dotted.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(dotted, "d/M/yyyy"))
    out = out.when(dotted.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(dotted, "d/M/yy"))
    return out.when(plain.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.try_to_date(F.initcap(plain), "d MMMM yyyy"))
