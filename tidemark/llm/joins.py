"""Joins of a large side with a side that is usually, but not provably, small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALTS = 32


def join_side(left: DataFrame, right: DataFrame, key: str, spread: Column, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on `key`, null meeting null; right has one row a key and should be materialised.

    Up to `limit` counted rows the right side is broadcast. Beyond that both sides shuffle, and
    the right side is repeated once a salt, so that a key with a third of all rows is dealt over
    SALTS tasks.
    """
    renamed = right.withColumnRenamed(key, "_join_key")
    if right.count() <= limit:
        return left.join(F.broadcast(renamed), left[key].eqNullSafe(renamed["_join_key"]), "left").drop("_join_key")
    salted = renamed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("_deal", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    on = dealt[key].eqNullSafe(salted["_join_key"]) & (dealt["_deal"] == salted["_salt"])
    return dealt.join(salted, on, "left").drop("_join_key", "_salt", "_deal")


def hash_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of 2 ** bits bits with those of the upper bits of each 64-bit hash; never a miss.

    What comes to the driver is at most the set itself, whatever the number of hashes.
    """
    slot = F.shiftrightunsigned(column, 64 - bits).alias("slot")
    cells = hashes.select(slot).selectExpr("slot >> 6 AS cell", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit").groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in cells.collect():
        out[r.cell] = r.bits
    return out


def passes(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which uint64 hashes may be in a hash_filter()."""
    place = (hashes >> np.uint64(58 - int(len(known)).bit_length() + 1)).astype(np.int64)
    return ((known[place >> 6] >> (place & 63)) & 1).astype(bool)
