import duckdb
import pandas as pd
import pytest

from tidemark.llm import preferences as p

SCHEMA = "conv_id long, turn long, role string, text string"


def show(t):
    return f"<|{t[2] or ''}|>\n{t[3] or ''}<|end|>\n"


def brute(rows):
    key = lambda t: tuple((v is not None, v if v is not None else 0 if i == 0 else "") for i, v in enumerate(t[1:]))
    out = []
    for pair in sorted({r[0] >> 1 for r in rows if r[0] is not None}):
        sides = [sorted((r for r in rows if r[0] == 2 * pair + k), key=key) for k in (0, 1)]
        n = 0
        while n < min(map(len, sides)) and sides[0][n][2:] == sides[1][n][2:]:
            n += 1
        row = [pair, n, "".join(map(show, sides[0][:n]))]
        for s in sides:
            at, spans = 0, []
            for t in s[n:]:
                size = len(show(t))
                if t[2] == "assistant":
                    spans.append(f"{at + 5 + len(t[2])}:{at + size - 1}")
                at += size
            row += ["".join(map(show, s[n:])), ",".join(spans)] if s else [None, None]
        out.append(tuple(row))
    return out


ROWS = [
    (0, 0, "user", "hé"), (0, 1, "assistant", "good"), (1, 0, "user", "hé"), (1, 1, "assistant", "bad"), (1, 2, "user", "oh"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, "user", "alone"), (7, None, None, None), (7, 0, "assistant", None), (6, None, None, None), (6, 0, "assistant", ""),
    (8, 0, "user", "x"), (8, 0, "user", "x"), (9, 0, "user", "x"), (9, 5, "system", "y"), (None, 0, "user", "lost"),
    (10, 0, "user", "w " * 50000), (11, 0, "user", "w " * 50000), (11, 1, "assistant", "é" * 1000),
]


def test_matches_brute_force_and_sql(spark):
    got = sorted(tuple(r) for r in p.format_pairs(p.pair_conversations(spark.createDataFrame(ROWS, SCHEMA).repartition(3))).collect())
    assert got == brute(ROWS)
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert sorted(con.execute(p.ORACLE).fetchall()) == got


@pytest.mark.parametrize("side", ["chosen", "rejected"])
def test_masks_cut_what_the_assistant_says(spark, side):
    df = p.format_pairs(p.pair_conversations(spark.createDataFrame(ROWS, SCHEMA)))
    for r in df.where("pair_id = 0").collect():
        a, b = map(int, r[f"{side}_mask"].split(",")[0].split(":"))
        assert r[f"{side}_completion"][a:b] == ("good" if side == "chosen" else "bad") + "<|end|>"


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, 0, "user", "x", 1, 2)], SCHEMA + ", chosen int, pair_id int")
    assert p.format_pairs(p.pair_conversations(df)).count() == 1
    assert p.format_pairs(p.pair_conversations(df.limit(0))).count() == 0
