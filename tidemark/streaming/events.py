"""Structured Streaming forms of batch operators: windows with late data, version dedupe, state.

Each takes a streaming DataFrame and returns one; run_once() drains what is there into files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.calibrate import Experts
from tidemark.session import scratch, ship


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    plain = [c for c, kind in stream.dtypes if kind == "timestamp_ntz"]  # watermarks need an instant
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else stream


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and means by day and type; rows later than the watermark are left out."""
    w = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def new_versions(rows: DataFrame, keys: list[str], day: str = "ts", late: str = "7 days") -> DataFrame:
    """Published rows without re-uploads of what was published within the watermark."""
    return rows.withWatermark(day, late).dropDuplicatesWithinWatermark(keys)


POOL_CELLS = 256


def _rank_of(counts: np.ndarray, edges: np.ndarray, s: float) -> float:
    """The share of a histogram's scores up to s; those in the cell of s count as up to it, as ties do."""
    cell = int(np.searchsorted(edges, s, side="right")) - 1
    return float(counts[: min(cell, len(counts) - 1) + 1].sum() / counts.sum())


def _with_score(counts: np.ndarray, edges: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """Count s; a range that lacks it doubles, pairs of cells being joined, until it holds it."""
    while not edges[0] <= s < edges[-1]:
        half = counts.reshape(-1, 2).sum(1)
        none, width = np.zeros(len(half)), edges[-1] - edges[0]
        low = edges[0] - width if s < edges[0] else edges[0]
        counts = np.concatenate([none, half] if s < edges[0] else [half, none])
        edges = np.linspace(low, low + 2 * width, len(counts) + 1)
    counts = counts.copy()
    counts[int(np.searchsorted(edges, s, side="right")) - 1] += 1
    return counts, edges


class _Levels(StatefulProcessor):
    """Per key: the experts' levels and weights, their latest losses, and a histogram of the scores."""

    def __init__(self, key: str, alpha: float):
        self.key, self.alpha = key, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "alpha array<double>, w array<double>, losses array<double>, counts array<double>, low double, high double, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        expert, counts, edges, seen = Experts(self.alpha), np.zeros(POOL_CELLS), np.linspace(-1.0, 1.0, POOL_CELLS + 1), 0
        if self.held.exists():
            a, w, losses, counts, low, high, seen = self.held.get()
            expert.alpha, expert.w = np.array([a]), np.array([w])
            expert.past = [(seen - len(losses) + i + 1, np.array([0]), np.array([x])) for i, x in enumerate(losses)]
            counts, edges = np.array(counts), np.linspace(low, high, POOL_CELLS + 1)
        now = pd.concat(list(rows)).sort_values("seq")
        for s in now["s"].astype(float):
            seen += 1
            if counts.sum():
                expert.update(np.array([1 - _rank_of(counts, edges, s)]), np.array([0]), seen)
            counts, edges = _with_score(counts, edges, s)
        losses = [float(x[0]) for _, _, x in expert.past]
        self.held.update((expert.alpha[0].tolist(), expert.w[0].tolist(), losses, counts.tolist(), float(edges[0]), float(edges[-1]), seen))
        yield pd.DataFrame({self.key: [key[0]], "seen": [len(now)], "level": [float(expert.level()[0])]})

    def close(self) -> None:
        pass


def adaptive_levels(scores: DataFrame, key: str, alpha: float = 0.1) -> DataFrame:
    """Online form of the adaptive level by key: scores (key, seq, s) update it in order of arrival.

    A score is ranked among all of its key before it, which the state keeps as counts in POOL_CELLS
    cells of a range that doubles as needed: a state of fixed size, whatever has been seen, and a rank
    within one cell of the exact one. Finite scores only. Needs the RocksDB state store.
    """
    ship(scores.sparkSession)
    kind = dict(scores.dtypes)[key]
    return scores.groupBy(key).transformWithStateInPandas(_Levels(key, alpha), f"{key} {kind}, seen long, level double", "Update", "None")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain what is there: to Parquet where the mode allows it, batch by batch otherwise."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
