"""Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

Leaves are numbered in order of (group, key, leaf); every run of ARITY consecutive nodes of a level
(the last run of a level may be shorter, even one node) has one parent, until one node remains. The
roots of the groups, in order of group, are the leaves of the outer tree in the same way.

Sparse forests. A forest is a set of nodes (tree, level, index) -> hash whose parents are not known
yet. Since the number of leaves of each tree is known, so is the length of each run: `settle` makes
the parent as soon as a run is complete, the root of a group becoming a leaf of the outer tree.
Union followed by `settle` is associative and commutative with the empty forest as its unit. Each
part of the ordered leaves settles its own forest, which leaves some 14 nodes a level at its two
edges; then a tree reduction merges FAN neighbouring forests at a time, round by round, until one
node, the root, is left. Rounds are grouped tasks (`treeReduce` with rows as values), because the
children that a round settles are needed as rows: proofs of the leaves join them.

Proofs. A part knows the siblings of the runs within it; those of the runs at its edges, and of all
runs above them (some 16 nodes a level), come by a join with the settled nodes of the rounds.

Nulls: a null group is the first one; a null key comes first; a null value is `-` in a leaf. Rows that
repeat a key are ordered by leaf, equal ones in any order, as they give the same results. Only the
columns named are read, so further columns may have any name. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import scratch, ship

ARITY = 8
FAN = 32
PART_LEAVES = 100_000
OUTER = -1

OPEN, NEED, SETTLED, SPAN = range(4)
NODES = "part int, kind int, tree long, size long, level int, idx long, hash string, n long"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

Node = tuple[int, int, int]


def encoded(value: Column) -> Column:
    """A value as it enters a leaf: length in bytes, colon, value; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def digest(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


class Shape:
    """Numbers of nodes by level, of each tree that a task meets."""

    def __init__(self, groups: int, arity: int):
        self.arity, self.sizes, self._widths = arity, {OUTER: groups}, {}

    def widths(self, tree: int) -> list[int]:
        size = self.sizes[tree]
        if size not in self._widths:
            out = [size]
            while out[-1] > 1:
                out.append(-(-out[-1] // self.arity))
            self._widths[size] = out
        return self._widths[size]

    def run(self, tree: int, level: int, number: int) -> range:
        return range(number * self.arity, min((number + 1) * self.arity, self.widths(tree)[level]))

    def is_top(self, tree: int, level: int) -> bool:
        return level == len(self.widths(tree)) - 1

    def up(self, tree: int, level: int, idx: int) -> Node | None:
        """The parent; for the root of a group itself, as a leaf of the outer tree; None for the root."""
        if not self.is_top(tree, level):
            return tree, level + 1, idx // self.arity
        return None if tree == OUTER else (OUTER, 0, tree)


def settle(nodes: dict[Node, str], shape: Shape) -> dict[Node, str]:
    """Replace complete runs by their parents in `nodes`, as far as it goes; returns the children."""
    settled: dict[Node, str] = {}
    work = {(t, lv, i // shape.arity) for t, lv, i in nodes}
    while work:
        tree, level, number = work.pop()
        if shape.is_top(tree, level):
            if tree == OUTER:
                continue
            run = [(tree, level, 0)]
            value = nodes[run[0]]
        else:
            run = [(tree, level, i) for i in shape.run(tree, level, number)]
            if not all(k in nodes for k in run):
                continue
            value = digest([nodes[k] for k in run])
        for k in run:
            settled[k] = nodes.pop(k)
        up = shape.up(tree, level, number * shape.arity)
        nodes[up] = value
        work.add((up[0], up[1], up[2] // shape.arity))
    return settled


def runs_above(nodes: dict[Node, str], shape: Shape) -> set[Node]:
    """(tree, level, run) of the runs of these nodes and of all their ancestors."""
    runs: set[Node] = set()
    for node in nodes:
        at: Node | None = node
        while at is not None:
            tree, level, idx = at
            if not shape.is_top(tree, level):
                run = (tree, level, idx // shape.arity)
                if run in runs:
                    break
                runs.add(run)
            at = shape.up(*at)
    return runs


class Paths:
    """The siblings of nodes on their ways to the root, among the nodes that a part knows."""

    def __init__(self, known: dict[Node, str], shape: Shape):
        self.known, self.shape, self._above = known, shape, {}

    def beside(self, node: Node) -> tuple[str, str]:
        tree, level, idx = node
        run = self.shape.run(tree, level, idx // self.shape.arity)
        return "".join(self.known[tree, level, i] for i in run if i < idx), "".join(self.known[tree, level, i] for i in run if i > idx)

    def above(self, node: Node | None) -> tuple[tuple[tuple[str, str], ...], str]:
        """(left, right) of each step from the node to the root, and all of them as one string."""
        if node is None:
            return (), ""
        if node not in self._above:
            steps, text = self.above(self.shape.up(*node))
            if not self.shape.is_top(node[0], node[1]):
                left, right = self.beside(node)
                steps, text = ((left, right), *steps), left + right + text
            self._above[node] = steps, text
        return self._above[node]

    def of_leaf(self, node: Node) -> tuple[tuple[tuple[str, str], ...], str]:
        """As `above`, but nothing is kept of the leaf itself."""
        if self.shape.is_top(node[0], node[1]):
            return self.above(node)
        steps, text = self.above(self.shape.up(*node))
        left, right = self.beside(node)
        return ((left, right), *steps), left + right + text


def fold(leaf: str, steps: tuple[tuple[str, str], ...]) -> str:
    for left, right in steps:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


@dataclass
class Manifest:
    """Where the ordered leaves and the nodes of a table lie, and the root (None of an empty table)."""

    spark: SparkSession
    folder: str
    groups: int
    rounds: int
    arity: int
    root: str | None

    @property
    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/leaves")

    @property
    def spans(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/spans")

    def nodes(self, number: int) -> DataFrame:
        """Nodes of a round: 0 is that of the parts, with the runs that each part needs."""
        return self.spark.read.schema(NODES).parquet(f"{self.folder}/round-{number}")

    def settled(self) -> DataFrame:
        """The children that the merging rounds have settled."""
        out = self.spark.createDataFrame([], NODES)
        for r in range(1, self.rounds + 1):
            out = out.unionByName(self.nodes(r).where(F.col("kind") == SETTLED))
        return out


def _table(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in NODES.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})


def _as_rows(part: int, kind: int, nodes: dict[Node, str], shape: Shape) -> list[tuple]:
    return [(part, kind, t, shape.sizes[t], lv, i, h, None) for (t, lv, i), h in nodes.items()]


def _local(leaves: pa.Table, spans: pa.Table, groups: int, arity: int) -> tuple[Shape, list[tuple[Node, int]], dict[Node, str]]:
    """The shape, (node, row) of each leaf in order, and the leaves' hashes of a part."""
    shape = Shape(groups, arity)
    rows = np.argsort(leaves.column("place").to_numpy()).tolist()
    hashes = leaves.column("leaf").to_pylist()
    at, k, nodes = [], 0, {}
    for tree, size, first, n in sorted(zip(*(spans.column(c).to_pylist() for c in ("tree", "size", "idx", "n")), strict=True)):
        shape.sizes[tree] = size
        for i in range(n):
            node = (tree, 0, first + i)
            at.append((node, rows[k]))
            nodes[node] = hashes[rows[k]].hex()
            k += 1
    return shape, at, nodes


def build(rows: DataFrame, group: Column, key: Column, leaf: Column, claim: Column | None = None, arity: int = ARITY, fan: int = FAN, part_leaves: int = PART_LEAVES) -> Manifest:
    """Number the leaves, settle the parts' forests and reduce them to the root.

    `leaf` is a hash in hex; `claim`, if given, is a leaf that somebody holds for this row, to be
    tested against the root by `proofs`.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = scratch(spark, "merkle")
    claimed = F.lit(None).cast("string") if claim is None else claim
    rows.select(
        group.cast("string").alias("grp"), key.cast("long").alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(claimed).alias("claim"), F.monotonically_increasing_id().alias("row")
    ).write.parquet(f"{folder}/read")
    read = spark.read.parquet(f"{folder}/read")
    n = read.count()
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // part_leaves), n // min(1024, part_leaves)) + 1
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")]  # the row splits any number of equal leaves
    ordered = read.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered.select(F.spark_partition_id().alias("part"), place.alias("place"), "grp", "key", "leaf", "claim").write.parquet(f"{folder}/leaves")
    leaves = spark.read.parquet(f"{folder}/leaves")

    # windows here run over a row for each part and group in it, and over a row for each part
    along = Window.partitionBy("grp").orderBy("part")
    before = Window.unboundedPreceding, -1
    counts = leaves.groupBy("part", "grp").agg(F.count("*").alias("n")).select(
        "part", "grp", "n", F.coalesce(F.sum("n").over(along.rowsBetween(*before)), F.lit(0)).alias("idx"), F.sum("n").over(Window.partitionBy("grp")).alias("size"), (F.row_number().over(along) == 1).cast("long").alias("opens")
    )
    bases = counts.groupBy("part").agg(F.sum("opens").alias("opened")).select(F.col("part").alias("_part"), F.coalesce(F.sum("opened").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.sum("opens").over(Window.partitionBy("part").orderBy(F.col("grp").asc_nulls_first())) - 1
    numbered = counts.join(bases, counts["part"] == bases["_part"]).withColumn("tree", F.when(F.col("opens") == 1, F.col("base") + inside))
    numbered.select("part", "grp", F.max("tree").over(Window.partitionBy("grp")).alias("tree"), "size", "idx", "n", "opens").write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    groups = spans.agg(F.sum("opens")).first()[0] or 0

    def first(mine: pa.Table, where: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _table([])
        part = mine.column("part")[0].as_py()
        shape, _, nodes = _local(mine, where, groups, arity)
        settle(nodes, shape)
        return _table(_as_rows(part, OPEN, nodes, shape) + [(part, NEED, t, None, lv, r, None, None) for t, lv, r in runs_above(nodes, shape)])

    narrow = leaves.select("part", "place", "leaf").groupBy("part").cogroup(spans.drop("grp", "opens").groupBy("part"))
    narrow.applyInArrow(first, NODES).write.parquet(f"{folder}/round-0")

    def merge(forests: pa.Table) -> pa.Table:
        shape, nodes = Shape(groups, arity), {}
        part = forests.column("part")[0].as_py()
        for t, size, lv, i, h in zip(*(forests.column(c).to_pylist() for c in ("tree", "size", "level", "idx", "hash")), strict=True):
            shape.sizes[t], nodes[t, lv, i] = size, h
        settled = settle(nodes, shape)
        return _table(_as_rows(part, OPEN, nodes, shape) + _as_rows(part, SETTLED, settled, shape))

    out, left = Manifest(spark, folder, groups, 0, arity, None), parts
    while left > 1:
        forests = out.nodes(out.rounds).where(F.col("kind") == OPEN).withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        out.rounds, left = out.rounds + 1, -(-left // fan)
        forests.groupBy("part").applyInArrow(merge, NODES).write.parquet(f"{folder}/round-{out.rounds}")
    last = out.nodes(out.rounds).where(F.col("kind") == OPEN).limit(2).collect()
    if len(last) > 1:
        raise RuntimeError("the forests did not merge to one root")
    out.root = last[0].hash if last else None
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """Per row: leaf, root of its group, root, hash of its siblings in order from leaf to root, and
    the root as recomputed from the claimed leaf (the own one where none is claimed) and the siblings."""
    arity, groups, root = manifest.arity, manifest.groups, manifest.root
    settled = manifest.settled()
    needs = manifest.nodes(0).where(F.col("kind") == NEED).select("part", "tree", "level", F.col("idx").alias("run"))
    by_run = settled.withColumn("run", F.floor(F.col("idx") / arity)).drop("part", "n")
    context = needs.join(by_run, ["tree", "level", "run"]).select("part", F.lit(SETTLED).alias("kind"), "tree", "size", "level", "idx", "hash", F.lit(None).cast("long").alias("n"))
    spans = manifest.spans.select("part", F.lit(SPAN).alias("kind"), "tree", "size", F.lit(0).alias("level"), "idx", F.lit(None).cast("string").alias("hash"), "n")

    def prove(mine: pa.Table, side: pa.Table) -> pa.Table:
        kind = side.column("kind").to_numpy()
        shape, at, nodes = _local(mine, side.filter(pa.array(kind == SPAN)), groups, arity)
        known = settle(nodes, shape) | nodes
        for t, size, lv, i, h in zip(*(side.filter(pa.array(kind == SETTLED)).column(c).to_pylist() for c in ("tree", "size", "level", "idx", "hash")), strict=True):
            shape.sizes[t], known[t, lv, i] = size, h
        paths, keys, claims = Paths(known, shape), mine.column("key").to_pylist(), mine.column("claim").to_pylist()
        out: list[list] = [[] for _ in range(7)]
        for node, row in at:
            steps, text = paths.of_leaf(node)
            leaf, claim = known[node], claims[row]
            back = fold(leaf if claim is None else claim.hex(), steps)
            subroot = root if groups == 1 else known[OUTER, 0, node[0]]
            for column, value in zip(out, (keys[row], leaf, subroot, root, hashlib.sha256(text.encode()).hexdigest(), back, back == root), strict=True):
                column.append(value)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table({c.split()[0]: pa.array(v, k) for c, v, k in zip(PROOFS.split(", "), out, kinds, strict=True)})

    leaves = manifest.leaves.select("part", "place", "key", "leaf", "claim").groupBy("part")
    return leaves.cogroup(context.unionByName(spans).groupBy("part")).applyInArrow(prove, PROOFS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over documents: leaves of all rows by lang, proofs, and roots folded from leaves of which
    those with a crc32 of doc_id that 3 divides are tampered with (upper case of the text lost). A
    null doc_id is never tampered with; other nulls, ties and empty tables as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"]]
    lower = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return proofs(build(docs, docs["lang"], docs["doc_id"], leaf_of(*head, docs["text"]), F.when(hit, leaf_of(*head, lower))))
