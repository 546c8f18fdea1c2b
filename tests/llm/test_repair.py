"""Conversation repair: against all edit strings of short conversations, and long ones by their parts."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair

FINE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for r, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", t)
        out.append("blank" if not bare else "duplicate" if (r, t) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((r, t))
    return out


def brute(rows):
    """(cost, audit, repaired turns) by trying every edit string with up to two inserts in a gap."""
    best = None
    gaps = ["", "I", "II"]
    options = ["D" if f in ("blank", "duplicate") else "KRD" for f in faults(rows)]
    for edits in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(i + e for i, e in itertools.zip_longest(inserts, edits, fillvalue=""))
            kept = [r for (r, _), e in zip(rows, edits, strict=True) if e != "D"]
            lead = 1 if audit.lstrip("D")[:1] == "K" and kept[0][:1] == "s" else 0
            cost, out, k = 0, [], 0
            for e in audit:
                role = ("user", "assistant")[(len(out) - lead) % 2]
                if e == "I":
                    cost += 3
                    out.append((role, ""))
                    continue
                r, t = rows[k]
                extra = 3 if faults(rows)[k] == "truncated" else 0
                k += 1
                if e == "D":
                    cost += 4
                else:
                    out.append((r if e == "K" else role, t))
                    cost += extra + (3 if e == "R" else 0)
            if FINE.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def parse(rows, state):
    chart = repair.Chart(state)
    for (r, t), f in zip(rows, faults(rows), strict=True):
        chart.turn(r, t, f)
    return chart.end()


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


ROLES = ["user", "assistant", "system", "tool", "", "s", "User", "u"]
TEXTS = ["Fine.", "Also fine! \n", "cut off", "", " \t", "why?", "Fine."]


@pytest.mark.parametrize("seed", range(45))
def test_repair_is_the_cheapest(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.choice([0, 1, 2, 3, 3]))]
    cost, audit, turns = brute(rows)
    assert parse(rows, repair.Hashed()) == (cost, audit, sha(turns))
    assert [(r, t) for r, t, *_ in parse(rows, repair.Kept())[2]] == turns


@pytest.mark.parametrize("seed", range(4))
def test_longer_repairs_against_states(seed):
    """Against a table of least values by place in the pattern, on conversations beyond the cut of audits."""
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{rng.choice(TEXTS)}{i if rng.random() < 0.9 else ''}" + rng.choice(["", "."])) for i in range(900)]
    up = {0: {"u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(table):
        for _ in range(3):
            for q, (c, a) in list(table.items()):
                for p in up[q].values():
                    if (c + 3, a + "I") < table.get(p, (1 << 60, "")):
                        table[p] = c + 3, a + "I"
        return table

    table = inserted({0: (0, "")})
    for (r, _), f in zip(rows, faults(rows), strict=True):
        new = {}
        for q, (c, a) in table.items():
            moves = [(q, 4, "D")]
            if f not in ("blank", "duplicate"):
                extra = 3 if f == "truncated" else 0
                moves += [(p, extra if r[:1] == s else extra + 3, "K" if r[:1] == s else "R") for s, p in up[q].items()]
                moves += [(1, extra, "K")] if q == 0 and r[:1] == "s" else []
            for p, k, e in moves:
                if (c + k, a + e) < new.get(p, (1 << 60, "")):
                    new[p] = c + k, a + e
        table = inserted(new)
    cost, audit, turns = parse(rows, repair.Kept())
    assert (cost, audit) == min(table[q] for q in (0, 3) if q in table)
    assert FINE.fullmatch("".join(r[:1] for r, *_ in turns))
    assert parse(rows, repair.Hashed())[2] == sha((r, t) for r, t, *_ in turns)


def run(spark, rows, fn=repair.repairs):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("times", "kind", "cost", "audit", "place"):
        df = df.withColumn(c, F.lit("clash"))
    return fn(repair.in_order(df, df.conv_id, df.turn, df.role, df.text, F.lit(1))).collect()


def test_nulls_ties_and_orders(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."),
        (2, 5, None, None), (2, None, "user", "First."), (2, 9, "assistant", None), (2, 9, "assistant", "At last."), (2, 9, "assistant", "At last."),
        (None, 1, "user", "Lost"), (None, None, "assistant", "Found."), (3, 1, "assistant", "B."), (3, 1, "assistant", "A."),
    ]
    got = {r.conv_id: r for r in run(spark, rows)}
    assert set(got) == {1, 2, 3, None}
    assert got[1][1:8] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[2][1:6] == (3, 2, 1, 0, 4) and got[2].audit == "KDDKD"  # first, null role, null text, the answer, again
    for conv, texts in ((None, [("assistant", "Found."), ("user", "Lost")]), (3, [("assistant", "A."), ("assistant", "B.")])):
        cost, audit, turns = brute(texts)
        assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == (cost, audit, sha(turns))
    out = run(spark, rows, repair.repaired_turns)
    for conv, r in got.items():
        assert sha((x.role, x.text) for x in sorted((x for x in out if x.conv_id == conv), key=lambda x: x.place)) == r.repaired_sha256


def test_damage(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}? {'x' * c}.") for c in range(60) for t in range(6)] + [(99, t, "system", "!") for t in (None, 3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.repairs(repair.damaged(df)).collect()
    assert {r.conv_id for r in got} == {*range(60), 99, None}
    import zlib

    for r in got:
        mine = []
        for c, t, role, text in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0)):
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = "user" if k == 4 else " " if role is None else role, " " if text is None else text
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            mine += [(t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        numbers = [t for t, *_ in mine if t is not None]
        f = faults([x[1:] for x in mine])
        initials = [x[1][:1] for x in mine]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(f.count(x) for x in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        if not mine:
            assert (r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_and_long_input(spark):
    assert run(spark, []) == []
    text = "A very long turn. " * 1_000_000
    (r,) = run(spark, [(1, 0, "user", text), (1, 1, "assistant", "Yes.")])
    assert (r.audit, r.repaired_sha256) == ("KK", sha([("user", text), ("assistant", "Yes.")]))
    (r,) = run(spark, [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(20_000)])
    assert (r.cost, r.audit) == (0, "K" * 20_000)
