"""The bi-temporal table: as-of slices, NULL-strict targets, releases, revisions, versions.

vintages has period, org_code, metric, version, value and snapshot (the day a version became
current); a later version replaces an earlier one even where its value is null. Some functions also
take changes, what each version adds to its metric, in place of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import col, financial_year, second_thursday

KEY = ["period", "org_code", "metric"]


def latest(v: DataFrame, keys: list[str] = KEY, value: str = "value", version: str = "version") -> DataFrame:
    """Newest version of each key."""
    return v.groupBy(*keys).agg(F.max_by(value, version).alias(value))


def as_of(v: DataFrame, day: str, upto: str | None = None) -> DataFrame:
    """What was known on a day, for periods up to `upto`."""
    known = v.where(F.col("snapshot") <= F.lit(day).cast("date"))
    if upto:
        known = known.where(F.col("period") <= F.lit(upto).cast("date"))
    return latest(known)


def version_intervals(v: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Days on which each version is current: snapshot <= day < until (null: still current).

    Versions that appear on one day leave only the last of them.
    """
    w = Window.partitionBy(*keys).orderBy("snapshot", "version")
    return v.withColumn("until", F.lead("snapshot").over(w)).where("until is null or until > snapshot")


def as_of_grid(v: DataFrame, origins: DataFrame, lag: int = 1) -> DataFrame:
    """Slices of all origins at once: one row for each origin and key, of periods <= origin - lag.

    Each version is matched with the months inside its interval, and these with the origins (which
    are first days of months) by equality, so nothing is aggregated after the join and versions that
    an origin does not see are not multiplied.
    """
    o = origins.select("origin", second_thursday("origin").alias("as_of"), F.add_months("origin", -lag).alias("last_period"))
    begin, end = origins.agg(F.min("origin"), F.max("origin")).first()
    iv = version_intervals(v)
    last = F.least(F.trunc(F.coalesce("until", F.lit(end)), "MM"), F.lit(end))
    first = F.greatest(F.trunc("snapshot", "MM"), F.add_months("period", lag), F.lit(begin))
    by_month = iv.where(first <= last).withColumn("origin", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    inside = (F.col("snapshot") <= F.col("as_of")) & (F.col("until").isNull() | (F.col("until") > F.col("as_of"))) & (F.col("period") <= F.col("last_period"))
    return by_month.join(o, "origin").where(inside).select("origin", *KEY, "value")


def targets(slices: DataFrame, parts: dict[str, tuple[str, ...]], keys: list[str]) -> DataFrame:
    """Long targets: the sum of a target's metrics, null unless all of them have a value."""
    wide = slices.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"_{m}") for m in sorted({m for p in parts.values() for m in p})))

    def strict(p: tuple[str, ...]) -> Column:
        out = F.col(f"_{p[0]}")
        for m in p[1:]:
            out = out + F.col(f"_{m}")
        return out

    named = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), strict(p).alias("y")) for t, p in parts.items())))
    return wide.select(*keys, named.alias("t")).select(*keys, "t.target", "t.y")


def min_count_sum(value: Column | str, least: int = 1) -> Column:
    """Sum that is null with fewer than `least` values."""
    return F.when(F.count(col(value)) >= least, F.sum(col(value)))


def roll_up(y: DataFrame, parents: DataFrame, level: str, keys: list[str], missing: str = "UNMAPPED", least: int = 1) -> DataFrame:
    """Sums of children by parent; orgs without a parent go to `missing`."""
    joined = y.join(parents.select("org_code", F.col(level).alias("_parent")), "org_code", "left")
    return joined.groupBy(*keys, F.coalesce("_parent", F.lit(missing)).alias("series")).agg(min_count_sum("y", least).alias("y"))


def complete_sums(y: DataFrame, parents: DataFrame, level: str, keys: list[str]) -> DataFrame:
    """Sums only where every child that the parent ever has carries a value."""
    need = parents.groupBy(level).agg(F.countDistinct("org_code").alias("need"))
    joined = y.where("y is not null").join(parents, "org_code").groupBy(*keys, level).agg(F.sum("y").alias("y"), F.count("y").alias("n"))
    return joined.join(need, level).where("n = need").select(*keys, F.col(level).alias("series"), "y")


def target_intervals(v: DataFrame, parts: dict[str, tuple[str, ...]], origins: DataFrame, lag: int = 1, finals: bool = False) -> DataFrame:
    """period, org_code, a column for each target, and the origins, `seen_first` to `seen_last`, that saw these values.

    A target has a new value whenever one of its metrics has a new version, so a (period, org) has as many
    rows as days with a new version, whatever the number of origins; origins (first days of months, which
    may have gaps) are found by counting months, so nothing is multiplied or joined. With `finals` the newest
    values are marked `final` and kept whether or not an origin saw them (the span is null where none did).

    Where v has `change` for `value`, a version may have any number of rows, and values are their running sums in
    the window that finds the days: rows are sorted once and need not be summed by version before.
    """
    v = v.where("period is not null and snapshot is not null")  # no origin sees others
    listed = sorted(r[0] for r in origins.select("origin").distinct().collect())  # months
    begin, end = listed[0], listed[-1]
    month_no = lambda c: F.year(c) * 12 + F.month(c)
    span = [(begin.year * 12 + begin.month - 1 + i) for i in range((end.year - begin.year) * 12 + end.month - begin.month + 1)]
    following = F.array(*(F.lit(next(o for o in listed if o.year * 12 + o.month - 1 >= n)) for n in span))
    w = Window.partitionBy("org_code", "period").orderBy("snapshot", "version")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    metrics = sorted({m for p in parts.values() for m in p})
    if "change" in v.columns:  # rows of equal day and version stand at one value; the last of them is kept
        current = {f"_{m}": F.struct(F.sum(F.when(F.col("metric") == m, F.col("change"))).over(w).alias("value")) for m in metrics}
    else:
        current = {f"_{m}": F.last(F.when(F.col("metric") == m, F.struct("value")), ignorenulls=True).over(upto) for m in metrics}
    iv = v.withColumns({**current, "_until": F.lead("snapshot").over(w)}).where("_until is null or _until > snapshot")
    seen = F.when(second_thursday("snapshot") >= F.col("snapshot"), F.trunc("snapshot", "MM")).otherwise(F.add_months(F.trunc("snapshot", "MM"), 1))
    until = F.when(second_thursday("_until") < F.col("_until"), F.trunc("_until", "MM")).otherwise(F.add_months(F.trunc("_until", "MM"), -1))
    iv = iv.withColumns({"final": F.col("_until").isNull(), "_from": F.greatest(seen, F.add_months("period", lag), F.lit(begin)), "seen_last": F.least(F.coalesce(until, F.lit(end)), F.lit(end))})
    iv = iv.withColumn("seen_first", F.when(F.col("_from") <= F.col("seen_last"), F.get(following, month_no("_from") - month_no(F.lit(begin)))))
    known = F.col("seen_first") <= F.col("seen_last")
    if finals:
        iv = iv.withColumns({c: F.when(known, F.col(c)) for c in ("seen_first", "seen_last")}).where("final or seen_first is not null")
    else:
        iv = iv.where(known)

    def strict(p: tuple[str, ...]) -> Column:
        out = F.col(f"_{p[0]}.value")
        for m in p[1:]:
            out = out + F.col(f"_{m}.value")
        return out

    return iv.select("period", "org_code", *(strict(p).alias(t) for t, p in parts.items()), "seen_first", "seen_last", *(["final"] if finals else []))


def as_of_sums(v: DataFrame, parts: dict[str, tuple[str, ...]], parents: DataFrame, levels: list[str], origins: DataFrame, missing: str = "UNMAPPED", finals: bool = False) -> DataFrame:
    """Sums of targets by the parents of all levels, period, and the origins, `seen_first` to `seen_last`, that saw them:
    as many rows as there are parents and spans of months. Orgs without a parent go to `missing`. With `finals` the
    newest values have sums of their own, for final_parents()."""
    joined = target_intervals(v, parts, origins, finals=finals).join(parents.select("org_code", *(F.col(x).alias(f"_{x}") for x in levels)), "org_code", "left")
    named = [F.coalesce(f"_{x}", F.lit(missing)).alias(x) for x in levels]
    return joined.groupBy("period", "seen_first", "seen_last", *(["final"] if finals else []), *named).agg(*(F.sum(t).alias(t) for t in parts))


def _long(wide: DataFrame, parts: dict[str, tuple[str, ...]], keys: list[str]) -> DataFrame:
    """Targets from columns to rows, those with a value."""
    named = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in parts)))
    return wide.select(*keys, named.alias("t")).select(*keys, "t.target", "t.y").where("y is not null")


def as_of_parents(sums: DataFrame, parts: dict[str, tuple[str, ...]], level: str, origins: DataFrame) -> DataFrame:
    """origin, target, period, series and y of one level from as_of_sums()."""
    month = F.explode(F.sequence("seen_first", "seen_last", F.expr("interval 1 month"))).alias("origin")
    each = sums.select("period", F.col(level).alias("series"), *parts, month).join(F.broadcast(origins.select("origin").distinct()), "origin")
    wide = each.groupBy("origin", "period", "series").agg(*(F.sum(t).alias(t) for t in parts))
    return _long(wide, parts, ["origin", "period", "series"])


def final_parents(sums: DataFrame, parts: dict[str, tuple[str, ...]], level: str) -> DataFrame:
    """target, period, series and y of one level by the newest versions, from as_of_sums() with finals."""
    wide = sums.where("final").groupBy("period", F.col(level).alias("series")).agg(*(F.sum(t).alias(t) for t in parts))
    return _long(wide, parts, ["period", "series"])


def first_release(v: DataFrame, parts: dict[str, tuple[str, ...]], origins: DataFrame) -> DataFrame:
    """First origin at which a target is complete, and its value as that origin saw it."""
    iv = target_intervals(v, parts, origins)
    when = {t: F.when(F.col(t).isNotNull(), F.col("seen_first")) for t in parts}
    firsts = iv.groupBy("org_code", "period").agg(*(F.struct(F.lit(t).alias("target"), F.min(o).alias("first_origin"), F.min_by(t, o).alias("y_first")).alias(f"_{t}") for t, o in when.items()))
    out = firsts.select("org_code", "period", F.explode(F.array(*(f"_{t}" for t in parts))).alias("t")).where("t.first_origin is not null")
    return out.select("t.target", "org_code", "period", "t.first_origin", "t.y_first").withColumn("resolved", second_thursday("first_origin"))


def first_release_of_parents(fr: DataFrame, parents: DataFrame, level: str) -> DataFrame:
    """Released when the last child is: sums of first values, where all children have one."""
    need = parents.groupBy(level).agg(F.countDistinct("org_code").alias("need"))
    agg = fr.join(parents, "org_code").groupBy("target", level, "period").agg(F.sum("y_first").alias("y_first"), F.max("resolved").alias("resolved"), F.count("*").alias("n"))
    return agg.join(need, level).where("n = need").select("target", F.col(level).alias("series"), "period", "y_first", "resolved")


def first_and_last(v: DataFrame) -> DataFrame:
    return v.groupBy(*KEY).agg(F.min_by("value", "version").alias("first"), F.max_by("value", "version").alias("last"), F.min("snapshot").alias("first_day"), F.max("snapshot").alias("last_day"), F.count("*").alias("versions"))


def revision_audit(v: DataFrame, on_time: int = 1) -> DataFrame:
    """By period and metric: first against latest values; late cells missed the first release."""
    cells = first_and_last(v).withColumn("due", F.min("first_day").over(Window.partitionBy("period", "metric")))
    prompt, change = F.col("first_day") == F.col("due"), F.abs(F.col("last") - F.col("first"))
    return cells.groupBy("period", "metric").agg(
        F.count_if(prompt).alias("n_first"),
        F.count_if(~prompt).alias("n_late"),
        F.count_if(prompt & F.col("last").isNull()).alias("n_withdrawn"),
        F.count_if(prompt & (F.col("last") != F.col("first"))).alias("n_changed"),
        F.sum(F.when(prompt, F.col("first"))).alias("first_total"),
        F.sum("last").alias("last_total"),
        F.max(F.when(prompt, change)).alias("max_change"),
        F.median(F.when(prompt, change)).alias("median_change"),
    )


def audit_by_year(audit: DataFrame) -> DataFrame:
    rel = F.abs(F.col("last_total") / F.col("first_total") - 1)
    return audit.groupBy(financial_year("period").alias("fy"), "metric").agg(F.avg("n_changed").alias("mean_changed"), F.avg("n_late").alias("mean_late"), F.max(rel).alias("worst_national"), F.avg(rel).alias("mean_national"))


def largest_revisions(v: DataFrame, k: int = 10) -> DataFrame:
    """The k cells with the largest absolute change; k is the report's size."""
    change = first_and_last(v).select(*KEY, (F.col("last") - F.col("first")).alias("change")).where("change is not null")
    return change.orderBy(F.abs("change").desc(), *KEY).limit(k)


def as_of_against_final(v: DataFrame, origins: DataFrame, window: int = 12) -> DataFrame:
    """By origin and key in the window before it: the value as seen then and the latest value."""
    near = F.sequence(F.add_months("period", 1), F.add_months("period", window), F.expr("interval 1 month"))
    cells = latest(v).withColumnRenamed("value", "final").withColumn("origin", F.explode(near)).join(origins.select("origin"), "origin")
    seen = as_of_grid(v, origins).withColumnRenamed("value", "seen")
    return cells.join(seen, ["origin", *KEY], "left")


def training_leakage(v: DataFrame, origins: DataFrame, window: int = 12) -> DataFrame:
    """How much a training window would differ had later versions been used."""
    both = as_of_against_final(v, origins, window)
    return both.groupBy("origin", "metric").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("seen").isNull()).alias("unseen"),
        F.count_if(F.col("seen") != F.col("final")).alias("changed"),
        (F.sum("final") - F.sum("seen")).alias("leak"),
    )


def change_components(v: DataFrame, origins: DataFrame, window: int = 12) -> DataFrame:
    """Value revisions, late arrivals and withdrawals between each origin's slice and the end."""
    both = as_of_against_final(v, origins, window)
    seen, final = F.col("seen"), F.col("final")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return both.groupBy("origin", "metric").agg(
        zero(F.when(seen.isNotNull() & final.isNotNull(), final - seen)).alias("revised"),
        zero(F.when(seen.isNull(), final)).alias("late"),
        zero(F.when(final.isNull(), seen)).alias("withdrawn"),
        F.count_if(seen.isNull() & final.isNotNull()).alias("n_late"),
    )


def late_majority(components: DataFrame) -> DataFrame:
    """In how many origins the late part outweighs revisions, against a simple majority."""
    larger = F.abs("late") > F.abs("revised")
    out = components.groupBy("metric").agg(F.count_if(larger).alias("n_larger"), F.count("*").alias("n"))
    need = (F.floor(F.col("n") / 2) + 1).cast("long")
    return out.withColumn("need", need).withColumn("late_dominates", F.col("n_larger") >= F.col("need"))


def number_versions(v: DataFrame, keys: list[str], published: str = "published", tiebreak: str = "version") -> DataFrame:
    """version_no, n_versions, is_latest and first_published of each row of a key."""
    w, every = Window.partitionBy(*keys).orderBy(published, tiebreak), Window.partitionBy(*keys)
    n = F.count("*").over(every)
    no = F.row_number().over(w).cast("long")
    return v.withColumns({"version_no": no, "n_versions": n, "is_latest": no == n, "first_published": F.min(published).over(every)})


def drop_reuploads(v: DataFrame, keys: list[str], group: list[str], values: list[str], published: str = "published") -> DataFrame:
    """Leave out a version whose whole content equals that of the version before it.

    keys name a version's subject (a quarter), group the rows within it (an org). Content is two
    sums of hashes and a count, which add up partially and know no order, so equality with the last
    kept version is equality with the one before.
    """
    sums = [F.sum(F.xxhash64(F.lit(s), *group, *values).cast("decimal(38,0)")) for s in (1, 2)]
    content = v.groupBy(*keys, published).agg(F.struct(*sums, F.count("*")).alias("content"))
    kept = content.withColumn("before", F.lag("content").over(Window.partitionBy(*keys).orderBy(published))).where("before is null or before <> content")
    return v.join(kept.select(*keys, published), [*keys, published], "left_semi")


def version_changes(v: DataFrame, keys: list[str], value: str) -> DataFrame:
    """From each version to the next: rows added, dropped and changed. keys end with the row's."""
    subject, row = keys[:-1], keys[-1]
    numbered = v.select(*keys, "version", value)
    after = numbered.select(*subject, F.col(row).alias("_row"), (F.col("version") - 1).alias("version"), F.col(value).alias("_next"))
    pairs = v.select(*subject, "version").distinct()
    pairs = pairs.join(pairs.select(*subject, (F.col("version") - 1).alias("version")), [*subject, "version"])
    joined = numbered.withColumnRenamed(row, "_row").join(after, [*subject, "_row", "version"], "full_outer").join(pairs, [*subject, "version"], "left_semi")
    return joined.groupBy(*subject, "version").agg(F.count_if(F.col(value).isNull()).alias("added"), F.count_if(F.col("_next").isNull()).alias("dropped"), F.count_if(F.col(value) != F.col("_next")).alias("changed"))
