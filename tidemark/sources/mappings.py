"""Mappings of organisations to parents: header-located tables, versions with provenance, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.published import stated_date
from tidemark.functions.text import normalise_region
from tidemark.sources.publications import relative

HEAD_ROWS = 50
VERSION_ORDER = ("valid_from", "published", "source")
#: Fixed value: the day on which integrated care boards came to be.
STATUTORY_START = "2022-07-01"


def collapsed(cell: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(cell) if isinstance(cell, str) else cell, F.lit("")), r"\s+", " "))


def header_rows(cells: DataFrame, labels: list[str]) -> DataFrame:
    """(path, at): the first of each file's top rows that holds all labels."""
    low = F.transform("cells", lambda c: F.lower(collapsed(c)))
    whole = F.forall(F.array(*map(F.lit, labels)), lambda v: F.array_contains(low, v))
    return cells.where((F.col("line") < HEAD_ROWS) & whole).groupBy("path").agg(F.min("line").alias("at"))


def picked_table(cells: DataFrame, columns: dict[str, str], key: str = "org_code") -> DataFrame:
    """Rows below the header that names all of `columns` (label to name), one column for each name (of
    repeated labels the first), white space collapsed, the key in upper case and not empty."""
    head = header_rows(cells, list(columns))
    names = cells.join(head, "path").where(F.col("line") == F.col("at")).select("path", "at", F.transform("cells", lambda c: F.lower(collapsed(c))).alias("names"))
    rows = cells.join(names, "path").where(F.col("line") > F.col("at"))
    value = lambda label: collapsed(F.try_element_at("cells", F.array_position("names", label).cast("int")))
    out = rows.select("path", "sha256", "line", *(value(label).alias(name) for label, name in columns.items()))
    return out.withColumn(key, F.upper(key)).where(F.col(key) != "")


def title_fields(cells: DataFrame, labels: list[str]) -> DataFrame:
    """(path, field, value): 'Field:' and the next cell that is not empty, above the header row."""
    above = cells.join(header_rows(cells, labels), "path").where(F.col("line") < F.col("at"))
    filled = F.filter(F.transform("cells", collapsed), lambda c: c != "")
    pairs = above.withColumn("filled", filled).where((F.size("filled") >= 2) & F.try_element_at("filled", F.lit(1)).endswith(":"))
    return pairs.groupBy("path", F.lower(F.rtrim(F.try_element_at("filled", F.lit(1)), F.lit(":"))).alias("field")).agg(F.max_by(F.try_element_at("filled", F.lit(2)), "line").alias("value"))


def clashing_codes(rows: DataFrame, key: str = "org_code", parent: str = "icb_code") -> DataFrame:
    """Codes that one file maps to two parents."""
    return rows.groupBy("path", key).agg(F.array_sort(F.collect_set(parent)).alias("parents")).where(F.size("parents") > 1)


def system_mapping(cells: DataFrame, columns: dict[str, str], regions: tuple[str, ...], strict: bool = True) -> DataFrame:
    """Mapping files as rows of path, org_code, org_name, icb_code, icb_name, region_label, region, and
    last_updated from the title block. Refuses a file that maps a code to two parents."""
    rows = picked_table(cells, columns).withColumn("icb_code", F.upper("icb_code"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path", "org_code", "icb_code").orderBy("line"))).where("_r = 1").drop("_r", "line")
    if strict:
        bad = clashing_codes(rows).limit(5).collect()  # for the message
        if bad:
            raise ValueError(f"codes mapped to two parents: {', '.join(sorted(r.org_code for r in bad))}")
    label = F.regexp_replace("region_label", r"(?i)commissioning region", "")
    updated = title_fields(cells, list(columns)).where("field = 'last updated'").select("path", stated_date("value").alias("last_updated"))
    return rows.withColumn("region", normalise_region(label, regions)).join(updated, "path", "left")


def former_parents(cells: DataFrame, columns: dict[str, str], key: str = "org_code", parent: str = "stp_name") -> DataFrame:
    """The legacy sheet: one row a code, the first with a parent."""
    rows = picked_table(cells, columns).where(F.col(parent) != "")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("path", key).orderBy("line"))).where("_r = 1").select(key, *(c for c in columns.values() if c != key))


def mapping_versions(rows: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """Rows of all archived versions with their provenance: source, financial_year, period, valid_from
    and published. manifest: path below the folder, financial_year, period (yyyy-MM), published.

    A version is valid from 1 April of its period's financial year, but not before the day on which the
    boards came to be.
    """
    m = manifest.select(F.col("path").alias("source"), "financial_year", "period", "published")
    month = F.to_date(F.concat("period", F.lit("-01")))
    april = F.make_date(F.year(F.add_months(month, -3)), F.lit(4), F.lit(1))
    joined = rows.withColumn("source", relative(F.col("path"), folder)).join(m, "source")
    return joined.withColumn("valid_from", F.greatest(april, F.lit(STATUTORY_START).cast("date"))).drop("path", "sha256")


def selected_version(history: DataFrame, financial_year: str | None = None) -> DataFrame:
    """The rows of the latest version, of all or of those for one year's data."""
    h = history if financial_year is None else history.where(F.col("financial_year") == financial_year)
    last = h.agg(F.max(F.struct(*VERSION_ORDER)).alias("last")).select("last.source")
    return h.join(last, "source", "left_semi")


def reference(current: DataFrame, fill: DataFrame | None = None) -> DataFrame:
    """One mapping with the method of each row; codes that it lacks come from `fill`."""
    cols = ["org_code", "org_name", "icb_code", "icb_name", "region"]
    out = current.select(*cols, F.lit("mapping").alias("method"))
    if fill is None:
        return out
    return out.unionByName(fill.join(current.select("org_code"), "org_code", "left_anti").select(*cols, "method"))
