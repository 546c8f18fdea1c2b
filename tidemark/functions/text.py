"""Text columns of messy publications: headers, numbers, labels, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.calendar import col

SUPPRESSED = ("", "-", "*")
#: How publications write comparisons, and the word kept for them.
COMPARISONS = ((">", " over "), ("<", " under "), ("greater than", "over"), ("more than", "over"), ("less than", "under"))
TOTAL_NAMES = ("total", "england", "national total")


def normalise_header(header: Column | str) -> Column:
    """Lower case; comparisons, as signs or in words, to 'over' and 'under'; all else but letters,
    digits and + to single spaces."""
    h = F.lower(col(header))
    for said, name in COMPARISONS:
        h = F.replace(h, F.lit(said), F.lit(name))
    return F.trim(F.regexp_replace(h, r"[^a-z0-9+]+", " "))


def first_match(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """Ordered regular expressions, the first that matches names the result."""
    out = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return default if out is None else out.otherwise(default)


def map_header(header: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Canonical column for a raw header; unknown ones are kept under unmapped__."""
    h = normalise_header(header)
    return first_match(h, rules, F.concat(F.lit("unmapped__"), F.regexp_replace(h, " ", "_")))


def to_number(text: Column | str) -> Column:
    """Numbers with thousands commas; suppression marks and anything else are null."""
    t = F.regexp_replace(F.trim(col(text)), ",", "")
    return F.when(~t.isin(*SUPPRESSED), t.try_cast("double"))


def is_total(code: Column | str, name: Column | str) -> Column:
    """National total rows, by code or by name."""
    return F.coalesce(F.trim(col(code)).rlike(r"^(-|TOTAL|ENG)$"), F.lit(False)) | F.coalesce(F.lower(F.trim(col(name))).isin(*TOTAL_NAMES), F.lit(False))


def normalise_region(label: Column | str, known: tuple[str, ...], default: str = "LEGACY") -> Column:
    """Upper case without bracketed parts or organisational prefixes; unknown labels are legacy."""
    r = F.regexp_replace(F.upper(col(label)), r"\([^)]*\)", " ")
    r = F.regexp_replace(r, r"^\s*(NHS )?(ENGLAND )?", "")
    r = F.trim(F.regexp_replace(r, r"\s+", " "))
    return F.when(r.isin(*known), r).otherwise(F.lit(default))


def classify(text: Column | str, rules: list[tuple[tuple[str, ...], str]], default: str | None = None) -> Column:
    """Ordered rules of substrings that must all occur."""
    t = F.lower(col(text))
    out = F.lit(default)
    for parts, name in reversed(rules):
        hit = F.lit(True)
        for p in parts:
            hit = hit & t.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def canonical_url(url: Column | str) -> Column:
    """Lower-case scheme and host, https, without fragment, query or final slash."""
    u = F.regexp_replace(F.trim(col(url)), r"[#?].*$", "")
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/]+)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/]+(.*)$", 1)
    return F.concat(F.lit("https://"), host, F.regexp_replace(path, "/$", ""))
