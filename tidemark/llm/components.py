"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def _tally(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour: the larger ones, or the others."""
    both = edges.union(edges.select("v", "u")).where("v > u") if large else edges
    source = edges.union(edges.select("v", "u")) if large else edges
    least = source.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return cut(hung.where("u <> v").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (u, v); component is the least node reached.

    Each round writes its edges to the shared checkpoint folder, and joins read them from there,
    so a node with very many neighbours is an ordinary skewed join. An empty table gives an
    empty table.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _tally(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = _star(_star(now, True), False)
        tally = _tally(now)
        if tally == seen:
            break
        seen = tally
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups (node, component) after further edges (u, v): only components that an edge joins are gone
    through again, and nodes of edges that are in no group yet are groups of their own."""
    at = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
    met = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    ends = cut(met.select("u", "v", F.coalesce("u_", "u").alias("cu"), F.coalesce("v_", "v").alias("cv")))
    moved = components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).toDF("component", "to")
    fresh = ends.select(F.col("u").alias("node"), F.col("cu").alias("component")).union(ends.select("v", "cv")).where("node = component").distinct()
    every = groups.union(fresh.join(groups, "node", "left_anti"))
    return cut(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
