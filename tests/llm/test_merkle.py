"""Merkle manifests: against a plain tree, and the laws of the forests' monoid."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes, arity=8):
    """Root, and the siblings of each leaf on the way to it as (left, right)."""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for way, i in zip(ways, at, strict=True):
            run = range(i // arity * arity, min(i // arity * arity + arity, len(level)))
            way.append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        at = [i // arity for i in at]
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], ways


def brute(rows, arity=8):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]),) for g in names}
    trees = {g: (x, *climb([y[2] for y in x], arity)) for g, (x,) in trees.items()}
    root, outer = climb([trees[g][1] for g in names], arity)
    out = []
    for g, above in zip(names, outer, strict=True):
        members, subroot, ways = trees[g]
        for (_, _, h, r), way in zip(members, ways, strict=True):
            claim = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                claim = leaf(*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            steps = [*way, *above]
            for a, b in steps:
                claim = sha(a, claim, b)
            out.append((r[0], h, subroot, root, sha(*(a + b for a, b in steps)), claim, claim == root))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("part", "place", "grp", "leaf", "hash"):  # clashing names
        df = df.withColumn(c, F.lit("x"))
    return df


def made(df, **how):
    values = [df[c] for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate(df["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 0
    return merkle.build(df, df["lang"], df["doc_id"], merkle.leaf_of(*values, df["text"]), F.when(hit, merkle.leaf_of(*values, low)), **how)


def rows_of(n, langs, seed=0):
    rng = random.Random(seed)
    out = [(i * 7 % n, rng.choice([None, "a", "b:é"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "Ab C", "É" * i, "word " * 40])) for i in range(n)]
    return [*out, *out[:3], (None, None, langs[0], None, "X"), (None, None, langs[0], 1, "Y"), (5, "z", langs[0], 1, "Tie")]


CASES = {
    "one group": (rows_of(70, ["en"]), {}),
    "many parts": (rows_of(300, [None, "", "de", "en", "Ü"]), {"part_leaves": 20, "fan": 3}),
    "many groups": (rows_of(150, [f"l{i}" for i in range(90)]), {"part_leaves": 10, "fan": 2}),
    "equal rows": ([(1, "s", "en", 1, "Same")] * 130 + [(2, "s", "fr", 1, "Other")], {"part_leaves": 15, "fan": 2}),
    "binary": (rows_of(60, ["a", "b"]), {"arity": 2, "part_leaves": 9, "fan": 2}),
    "a row": ([(9, None, None, None, None)], {}),
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_matches_a_plain_tree(spark, case):
    rows, how = CASES[case]
    manifest = made(table(spark, rows), **how)
    got = [tuple(r) for r in merkle.proofs(manifest).collect()]
    want = brute(rows, how.get("arity", 8))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert manifest.root == want[0][3]
    assert how.get("part_leaves") is None or manifest.rounds > 1


def test_empty_table_has_no_root(spark):
    manifest = made(table(spark, rows_of(5, ["a"])).limit(0))
    assert manifest.root is None and merkle.proofs(manifest).count() == 0


def test_a_very_long_text(spark):
    rows = [(i, "s", "en", 1, "Long text " * 2_000_000 if i == 3 else "Short") for i in range(4)]
    got = sorted(tuple(r) for r in merkle.proofs(made(table(spark, rows))).collect())
    assert got == sorted(brute(rows))


@pytest.mark.parametrize("seed", range(20))
def test_forests_merge_in_any_order(seed):
    """Union and settle: associative, commutative, and to one root however the leaves are dealt."""
    rng = random.Random(seed)
    groups, arity = rng.randint(1, 30), rng.choice([2, 3, 8])
    sizes = {g: rng.randint(1, 60) for g in range(groups)}
    leaves = {(g, 0, i): sha(str((g, i))) for g, n in sizes.items() for i in range(n)}
    shape = merkle.Shape(groups, arity)
    shape.sizes |= sizes
    keys = list(leaves)
    rng.shuffle(keys)
    forests = [{k: leaves[k] for k in keys[i::7]} for i in range(7)]

    def join(a, b):
        out = a | b
        merkle.settle(out, shape)
        return out

    x, y, z = forests[:3]
    assert join(join(x, y), z) == join(x, join(y, z)) == join(join(z, x), y) and join(x, {}) == join({}, x)
    while len(forests) > 1:
        forests.append(join(forests.pop(rng.randrange(len(forests))), forests.pop(rng.randrange(len(forests)))))
    roots = [climb([leaves[g, 0, i] for i in range(n)], arity)[0] for g, n in sizes.items()]
    assert list(forests[0].values()) == [climb(roots, arity)[0]]


def test_parts_leave_few_nodes(spark):
    """What the reduction carries is some nodes a level at the edges of the parts, not the leaves."""
    rows = [(i, "s", "en", 1, str(i)) for i in range(4000)]
    manifest = made(table(spark, rows), part_leaves=500)
    per_part = [r["count"] for r in manifest.nodes(0).where(F.col("kind") == merkle.OPEN).groupBy("part").count().collect()]
    assert len(per_part) > 5 and max(per_part) <= 14 * 5
