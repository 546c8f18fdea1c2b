"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of turns (role and text equal, null equal to null) of the chosen and
the rejected conversation is rendered once as the prompt; the turns after it are rendered as the
two completions. A mask lists the spans of a completion that count for the loss: what the
assistant says and the end mark after it, as start:end in code points.

In the table, conversation 2k is the chosen and 2k + 1 the rejected one of pair k.

Nulls: a null role or text is rendered as nothing; turns without conversation id belong to no
conversation and are left out. Turns are in order of turn (null first), then role, then text;
repeated turns stay. Where one side is missing, its completion and mask are null and the prefix
is empty. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>"
SPEAKER = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit(f"{END}\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        size = F.length(_rendered(turn)).cast("long")
        begin = state["at"] + F.length(F.coalesce(turn["role"], F.lit(""))) + 5
        span = F.concat_ws(":", begin.cast("string"), (state["at"] + size - 1).cast("string"))
        spans = F.when(turn["role"] == SPEAKER, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen and rejected (arrays of turns, null for a missing side)."""
    shorter = F.coalesce(F.least(F.size("chosen"), F.size("rejected")), F.lit(0))
    shorter = F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), 0).otherwise(shorter)
    at = lambda side, i: F.element_at(side, i)
    differs = lambda i: ~(at("chosen", i)["role"].eqNullSafe(at("rejected", i)["role"]) & at("chosen", i)["text"].eqNullSafe(at("rejected", i)["text"]))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.col("shorter")), differs))
    out = pairs.withColumn("shorter", shorter).withColumn("n_prefix", F.when(F.col("shorter") == 0, 0).otherwise(F.coalesce(first - 1, F.col("shorter"))))
    rest = lambda side: F.slice(side, F.col("n_prefix") + 1, F.greatest(F.size(side) - F.col("n_prefix"), F.lit(0)))
    prompt = F.when(F.col("n_prefix") == 0, "").otherwise(_joined(F.slice("chosen", F.lit(1), F.col("n_prefix"))))
    masked = [c for side in ("chosen", "rejected") for c in (F.when(F.col(side).isNotNull(), _joined(rest(side))).alias(f"{side}_completion"), F.when(F.col(side).isNotNull(), _mask(rest(side))).alias(f"{side}_mask"))]
    return out.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), prompt.alias("prompt"), *masked)


def pair_conversations(conversations: DataFrame) -> DataFrame:
    turn = F.struct("turn", "role", "text")
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("conv_id").bitwiseAND(1) == k, turn)))
    pairs = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id is not null")
    pairs = pairs.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(side(0).alias("c"), side(1).alias("r"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return pairs.select("pair_id", some("c").alias("chosen"), some("r").alias("rejected"))


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over conversations; nulls, ties and empty tables as the module says."""
    return format_pairs(pair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
         a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, max(pos)) AS n_prefix FROM p GROUP BY pair_id),
r AS (
  SELECT t.*, n_prefix, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS body
  FROM t JOIN n USING (pair_id)),
s AS (
  SELECT *, sum(CASE WHEN pos > n_prefix THEN length(body) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY pos) AS upto FROM r),
m AS (
  SELECT *, (upto - length(body) + 5 + length(coalesce(role, '')))::BIGINT || ':' || (upto - 1)::BIGINT AS span FROM s)
SELECT pair_id, any_value(n_prefix)::BIGINT AS n_prefix,
       coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= n_prefix), '') AS prompt,
       CASE WHEN bool_or(side = 0) THEN coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n_prefix), '') END AS chosen_completion,
       CASE WHEN bool_or(side = 0) THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n_prefix AND role = 'assistant'), '') END AS chosen_mask,
       CASE WHEN bool_or(side = 1) THEN coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n_prefix), '') END AS rejected_completion,
       CASE WHEN bool_or(side = 1) THEN coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n_prefix AND role = 'assistant'), '') END AS rejected_mask
FROM m GROUP BY pair_id
"""
