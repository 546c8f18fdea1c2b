"""Pooled forecast models fitted on all series at once, without a task that holds a panel.

A pool is one value of `by` (target, and origin if there is one) and one horizon; its rows are
(series, month). A pool has members, fitted side by side on the same rows: quantile levels, or
bootstrap replicates. Features are cut into BINS at approximate percentiles of their pool, once.
Boosting then goes round by round, with two jobs each for all pools and members:

* tasks predict their rows with the trees so far and count, by (pool, feature, bin) and member, rows
  and rows below the prediction, which is the gradient of the pinball loss; the counts are summed in
  one shuffle, and the split of the largest gain is one row a pool;
* tasks give the residuals on either side of the split, and each leaf takes their quantile.

What the driver holds is the trees: ROUNDS rows a pool, whatever the number of series. Counts are
whole numbers and ties go to the first feature and bin, so splits do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.session import cut, ship

HORIZONS = 6
SEASON = 12
BINS = 32
ROUNDS = 12
RATE = 0.4
LEAST = 10
LEAST_ROWS = 50
REPLICATES = 20
BLOCK = 12
LAGS = (0, 1, 2, 5, 11)
FEATURES = len(LAGS) + 4


def training_rows(panel: DataFrame, by: list[str], horizons: tuple[int, ...] = tuple(range(1, HORIZONS + 1))) -> DataFrame:
    """by, horizon, series, age, level, x and y of every month of a panel on a spine: x from the months up
    to it, y the log of the value `horizon` months later over the level, null if it is not known. age is
    the months from the target month to the last month of the panel, negative beyond it."""
    w = Window.partitionBy(*by, "series").orderBy("period")
    last = Window.partitionBy(*by)
    p = panel.withColumn("v", F.log1p(F.greatest("y", F.lit(0.0))))
    year = w.rowsBetween(1 - SEASON, 0)
    p = p.withColumn("level", F.when(F.count("v").over(year) >= SEASON // 2, F.avg("v").over(year)))
    p = p.withColumns({"to_end": F.months_between(F.max("period").over(last), "period").cast("int"), "before": F.lag("level", SEASON).over(w)})
    for k in LAGS:
        p = p.withColumn(f"v{k}", F.lag("v", k).over(w))
    for h in horizons:
        p = p.withColumns({f"ahead{h}": F.lead("v", h).over(w), f"same{h}": F.lag("v", SEASON - h).over(w)})
    each = p.where("level is not null").select(*by, "series", "period", "to_end", "level", "before", *(f"v{k}" for k in LAGS), F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"ahead{h}").alias("ahead"), F.col(f"same{h}").alias("same")) for h in horizons))).alias("t"))
    angle = 2 * np.pi * (F.month("period") + F.col("t.horizon")) / SEASON
    x = F.array(*(F.col(f"v{k}") - F.col("level") for k in LAGS), F.col("t.same") - F.col("level"), F.col("level") - F.col("before"), F.sin(angle), F.cos(angle))
    return each.select(*by, "t.horizon", "series", (F.col("to_end") - F.col("t.horizon")).cast("int").alias("age"), "level", x.alias("x"), (F.col("t.ahead") - F.col("level")).alias("y"))


def pool_key(by: list[str]) -> Column:
    return F.concat_ws("|", *(F.col(b).cast("string") for b in by), "horizon")


def _binned(rows: DataFrame) -> DataFrame:
    """rows with their features as bytes: 0 for a missing value, else one more than the edges below it."""
    levels = [i / BINS for i in range(1, BINS)]
    cuts = rows.groupBy("pool").agg(F.array(*(F.percentile_approx(F.get("x", i), levels, 1000) for i in range(FEATURES))).alias("cuts")).collect()  # a row a pool
    edges = {r.pool: [np.unique(np.array(c if c is not None else [], float)) for c in r.cuts] for r in cuts}
    known = rows.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch.column("x").to_pylist()], float).reshape(-1, FEATURES)
            pools = np.array(batch.column("pool").to_pylist(), object)
            out = np.zeros(x.shape, np.uint8)
            for pool in np.unique(pools):
                at = np.flatnonzero(pools == pool)
                for f in range(FEATURES):
                    out[at, f] = np.where(np.isnan(x[at, f]), 0, 1 + np.searchsorted(known.value[pool][f], x[at, f], side="left"))
            cols = [batch.column(c) for c in ("pool", "series", "age", "level", "y")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes() for r in out], pa.binary())], ["pool", "series", "age", "level", "y", "bins"])

    return rows.select("pool", "series", "age", "level", "y", "x").mapInArrow(run, "pool string, series string, age int, level double, y double, bins binary")


class Trees:
    """The members of one pool: a start and a split of two leaves for each round and member."""

    def __init__(self, start: np.ndarray):
        self.start, self.rounds = start, []

    def add(self, feature: np.ndarray, edge: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.rounds.append((feature, edge, left, right))

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """(rows, members)"""
        out = np.tile(self.start, (len(bins), 1))
        for feature, edge, left, right in self.rounds:
            out += RATE * np.where(bins[:, feature] <= edge, left, right)
        return out


def _pools_of(batches: Iterator[pa.RecordBatch], trees: dict[str, Trees]) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """pool, its rows of a batch, their bins and predictions; pools without trees are left out."""
    for batch in batches:
        pools = np.array(batch.column("pool").to_pylist(), object)
        for pool in np.unique(pools):
            if pool in trees:
                rows = batch.filter(pa.array(pools == pool))
                bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, FEATURES)
                yield pool, rows, bins, trees[pool].predict(bins)


def multiplicities(replicates: int, blocks: int, seed: int) -> np.ndarray:
    """(replicates, blocks): how often each block is drawn, from hashes of (seed, replicate, draw) alone."""
    out = np.zeros((replicates, blocks), np.int64)
    for r in range(replicates):
        for j in range(blocks):
            out[r, xxhash.xxh64_intdigest(f"{seed}|{r}|{j}") % blocks] += 1
    return out


class Members:
    """What the members of a pool are: their quantile levels, and how often each counts a row of an age."""

    def __init__(self, taus: list[float], drawn: np.ndarray | None = None):
        self.taus, self.drawn = taus, drawn

    def weights(self, age: np.ndarray) -> np.ndarray:
        """(rows, members)"""
        if self.drawn is None:
            return np.ones((len(age), len(self.taus)), np.int64)
        return self.drawn[:, np.minimum(age // BLOCK, self.drawn.shape[1] - 1)].T


def fit(train: DataFrame, members: Members, rounds: int = ROUNDS) -> dict[str, Trees]:
    """Trees of every pool with LEAST_ROWS rows or more. train: pool, age, y, bins; y is never null."""
    sc, taus, m = train.sparkSession.sparkContext, members.taus, len(members.taus)
    begun = train.groupBy("pool").agg(F.count("*").alias("n"), F.percentile_approx("y", taus, 10_000).alias("start")).where(F.col("n") >= LEAST_ROWS).collect()
    trees = {r.pool: Trees(np.array(r.start)) for r in begun}
    counted = ", ".join(["pool string, f int, b int", *(f"n{i} long, k{i} long" for i in range(m))])
    names = [c.split()[0] for c in counted.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for pool, rows, bins, made in _pools_of(batches, model.value):
            y, w = rows.column("y").to_numpy(), members.weights(rows.column("age").to_numpy())
            below = np.where(y[:, None] < made, w, 0)
            got = held.setdefault(pool, np.zeros((FEATURES, BINS + 1, 2 * m), np.int64))
            for f in range(FEATURES):
                for i in range(m):
                    got[f, :, 2 * i] += np.bincount(bins[:, f], w[:, i], BINS + 1).astype(np.int64)
                    got[f, :, 2 * i + 1] += np.bincount(bins[:, f], below[:, i], BINS + 1).astype(np.int64)
        for pool, got in held.items():
            f, b = (x.reshape(-1) for x in np.indices(got.shape[:2]))
            flat = got.reshape(-1, 2 * m)
            yield pa.RecordBatch.from_arrays([pa.array([pool] * len(f)), pa.array(f, pa.int32()), pa.array(b, pa.int32()), *(pa.array(flat[:, c]) for c in range(2 * m))], names)

    sides = "pool string, r array<double>, l array<boolean>"

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool, rows, bins, made in _pools_of(batches, model.value):
            feature, edge = chosen.value[pool]
            r, w = rows.column("y").to_numpy()[:, None] - made, members.weights(rows.column("age").to_numpy())
            left = bins[:, feature] <= edge
            for copy in range(int(w.max())):  # a row drawn twice counts twice
                on = np.flatnonzero((w > copy).any(1))
                values = pa.array(np.where(w[on] > copy, r[on], np.nan).reshape(-1), from_pandas=True)
                offsets = pa.array(np.arange(len(on) + 1, dtype=np.int32) * m)
                yield pa.RecordBatch.from_arrays([pa.array([pool] * len(on)), pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, pa.array(left[on].reshape(-1)))], ["pool", "r", "l"])

    along, whole = Window.partitionBy("pool", "f").orderBy("b"), Window.partitionBy("pool", "f")

    def gain(i: int) -> Column:
        """Of the best split of member i: gain, feature and bin, the least of both first."""
        n, k = F.sum(f"n{i}").over(along), F.sum(f"k{i}").over(along)
        rest_n, rest_k = F.sum(f"n{i}").over(whole) - n, F.sum(f"k{i}").over(whole) - k
        worth = F.pow(taus[i] * n - k, 2) / n + F.pow(taus[i] * rest_n - rest_k, 2) / rest_n
        return F.when((n >= LEAST) & (rest_n >= LEAST), F.struct(worth.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b")))

    for _ in range(rounds):
        if not trees:
            break
        model = sc.broadcast(trees)
        sums = train.mapInArrow(count, counted).groupBy("pool", "f", "b").agg(*(F.sum(c).alias(c) for c in names[3:]))
        best = sums.select("pool", *(gain(i).alias(f"g{i}") for i in range(m))).groupBy("pool").agg(*(F.max(f"g{i}").alias(f"g{i}") for i in range(m))).collect()
        split = {r.pool: (np.array([-r[f"g{i}"].f if r[f"g{i}"] else 0 for i in range(m)]), np.array([-r[f"g{i}"].b if r[f"g{i}"] else BINS for i in range(m)])) for r in best}
        chosen = sc.broadcast(split)
        leaf = lambda i, left: F.percentile_approx(F.when(F.get("l", i) if left else ~F.get("l", i), F.get("r", i)), taus[i], 10_000)
        grown = train.mapInArrow(residuals, sides).groupBy("pool").agg(F.array(*(leaf(i, True) for i in range(m))).alias("left"), F.array(*(leaf(i, False) for i in range(m))).alias("right")).collect()
        for r in grown:
            values = [np.array([0.0 if v is None else v for v in side]) for side in (r.left, r.right)]
            trees[r.pool].add(*split[r.pool], *values)
        model.unpersist()
        chosen.unpersist()
    return trees


def predicted(rows: DataFrame, trees: dict[str, Trees], keep: list[str]) -> DataFrame:
    """keep (of pool, series, age, level, y) and q, the predictions of the members."""
    model = rows.sparkSession.sparkContext.broadcast(trees)
    kinds = {"pool": "string", "series": "string", "age": "int", "level": "double", "y": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, _, made in _pools_of(batches, model.value):
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(made.reshape(-1)))], [*keep, "q"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "q array<double>"]))


def _prepared(panel: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Binned rows, written once; and (pool, by, horizon)."""
    ship(panel.sparkSession)
    rows = training_rows(panel, by).withColumn("pool", pool_key(by)).withColumn("series", F.col("series").cast("string"))
    names = rows.select("pool", *by, "horizon").distinct()
    return cut(_binned(rows)), names


def _forecasts(made: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    values = A.tidy(F.transform("q", lambda v: F.expm1(v + F.col("level"))))
    return made.join(F.broadcast(names), "pool").select(*by, "series", "horizon", values.alias("q"))


def boosted_quantiles(panel: DataFrame, by: list[str], rounds: int = ROUNDS) -> DataFrame:
    """by, series, horizon, q: direct quantile models, trained up to a year before the end and moved by
    the conformal width of each central interval over that year. Pools with under LEAST_ROWS rows to
    train on, or under LEAST of the last year, give no row."""
    rows, names = _prepared(panel, by)
    trees = fit(rows.where("y is not null").where(F.col("age") >= SEASON), Members([float(v) for v in A.LEVELS]), rounds)
    half, n = len(A.LEVELS) // 2, len(A.LEVELS)
    held = predicted(rows.where("y is not null").where(F.col("age") < SEASON), trees, ["pool", "y"]).withColumn("q", F.array_sort("q"))
    score = lambda j: F.greatest(F.get("q", j) - F.col("y"), F.col("y") - F.get("q", n - 1 - j))
    sizes = held.groupBy("pool").agg(F.count("*").alias("n"), *(F.percentile_approx(score(j), [i / 1000 for i in range(1, 1001)], 10_000).alias(f"s{j}") for j in range(half))).where(F.col("n") >= LEAST)

    def width(j: int) -> Column:
        level = F.least(F.lit(1.0), (1 - 2 * A.LEVELS[j]) * (1 + 1 / F.col("n")))
        return F.get(f"s{j}", F.ceil(level * 1000).cast("int") - 1)

    now = predicted(rows.where(F.col("age") < 0).where(F.col("age") == -F.substring_index("pool", "|", -1).cast("int")), trees, ["pool", "series", "level"])
    moved = now.withColumn("q", F.array_sort("q")).join(F.broadcast(sizes.select("pool", *(width(j).alias(f"e{j}") for j in range(half)))), "pool")
    out = [F.get("q", j) - F.col(f"e{j}") for j in range(half)] + [F.get("q", half)] + [F.get("q", n - 1 - j) + F.col(f"e{j}") for j in reversed(range(half))]
    return _forecasts(moved.withColumn("q", F.array(*out)), names, by)


def bootstrap_ensemble(panel: DataFrame, by: list[str], replicates: int = REPLICATES, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """by, series, horizon, q: the mean of medians of models, each on blocks of a year drawn with
    replacement, and quantiles of the errors that the models without a row's block make in the last year."""
    rows, names = _prepared(panel, by)
    known = rows.where("y is not null")
    blocks = (known.agg(F.max("age")).first()[0] or 0) // BLOCK + 1
    drawn = multiplicities(replicates, blocks, seed)
    members = Members([0.5] * replicates, drawn)
    trees = fit(known, members, rounds)
    free = F.get(F.array(*(F.array(*(F.lit(bool(d == 0)) for d in drawn[:, b])) for b in range(blocks))), F.floor(F.col("age") / BLOCK).cast("int"))
    outside = F.filter(F.transform(F.arrays_zip(F.col("q"), free.alias("free")), lambda z: F.when(z["free"], z["q"])), lambda v: v.isNotNull())
    last = predicted(known.where(F.col("age") < SEASON), trees, ["pool", "age", "y"]).withColumn("o", outside).where(F.size("o") > 0)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    errors = last.groupBy("pool").agg(F.count("*").alias("n"), F.percentile_approx(F.col("y") - mean(F.col("o")), [float(v) for v in A.LEVELS], 10_000).alias("e")).where(F.col("n") >= LEAST)
    now = predicted(rows.where(F.col("age") == -F.substring_index("pool", "|", -1).cast("int")), trees, ["pool", "series", "level"])
    moved = now.join(F.broadcast(errors.select("pool", "e")), "pool").withColumn("centre", mean(F.col("q")))
    return _forecasts(moved.withColumn("q", F.transform("e", lambda v: v + F.col("centre"))), names, by)
