"""Mixing sources to target weights, with DataFrame operations only.

Sources weigh 5, 2, 1, repeating, in code-point order (null last), and share RATIO times all
words; a target stops at LIMIT times its source's size and the excess is shared again by weight.

1. Packing. The words of a source, document after document, are cut into blocks of equal length:
   BLOCK words, fewer in a source of under BLOCK * FINENESS words, so that a block is a small share
   of every source. Offsets are running sums over small buckets of documents, added to running
   sums over buckets.
2. Draws. A source has as many slots as come nearest its target. Each output shard draws how many
   it gets of each source: multinomial counts, given the totals of the sources, so that the totals
   have no sampling error. A draw halves the slots of a run, and the halves again, by fair coins
   that are bits of seeded hashes, until each shard has its count.
3. Index permutation. Shards take a source's slots in turn, as many as they drew. Slot j takes block
   p(j mod n) of the n blocks, where p is a swap-or-not permutation seeded by source and epoch;
   within an epoch no block comes twice.
4. Blocks are joined to slots by (source, index).

taken counts the words of a document in all blocks taken; no block is taken over LIMIT times.

Nulls: a null text has no words, null sources form one source. Repeated rows are mixed as
separate documents. Empty tables give empty tables. Extra columns are not read. Sources without
words have a target of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut

BLOCK = 64
FINENESS = 256
WEIGHTS = (5, 2, 1)
RATIO = 1.5
LIMIT = 2
LEAST_SHARDS = 16
SHARD_SLOTS = 1 << 20
RUN_SLOTS = 1 << 16
ROUNDS = 12
SEED = 20240229
BUCKET_DOCS = 2000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def numbered_sources(sizes: DataFrame, source: str) -> DataFrame:
    """sizes with source_no, from 1 in code-point order, null last: a sort by ranges, and the counts
    of the ranges before added to the row numbers within each."""
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(sizes.repartitionByRange(tasks, F.col(source).asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("range").orderBy(F.col(source).asc_nulls_last()))
    return ranged.join(bases, "range").withColumn("source_no", F.col("base") + number).drop("range", "base")


def source_targets(sized: DataFrame, source: str = "source") -> DataFrame:
    """One row a source: source_no, source_size, target. sized has a row a source and bucket."""
    sizes = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = cut(numbered_sources(sizes, source).withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(LIMIT))))
    # words for each unit of weight; the excess over caps is shared again until no source is above its own
    words = (s.agg(F.sum("source_size")).first()[0] or 0) * RATIO
    level, settled = 0.0, False
    while words and not settled:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        row = s.agg(F.sum(F.when(full, F.col("cap"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        new = (words - (row["capped"] or 0.0)) / row["open"] if row["open"] else level
        settled, level = new <= level, new
    return s.select(source, F.col("source_no").cast("long").alias("source_no"), "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _halved(n: Column, *seeds: Column) -> Column:
    """A draw of Binomial(n, 1/2): the ones among n bits of seeded hashes."""
    bits = lambda i: F.xxhash64(F.lit(SEED + 1), *seeds, i)
    words = F.floor(n / 64)
    full = F.aggregate(F.sequence(F.lit(1).cast("long"), words), F.lit(0).cast("long"), lambda total, i: total + F.bit_count(bits(i)))
    rest = F.pmod(n, F.lit(64)).cast("int")
    few = F.bit_count(F.call_function("shiftrightunsigned", bits(F.lit(0).cast("long")), 64 - rest))
    return F.when(words > 0, full).otherwise(F.lit(0)) + F.when(rest > 0, few).otherwise(F.lit(0))


def shard_counts(plan: DataFrame, shards: int) -> DataFrame:
    """(source_no, shard, count): how many slots of each source a shard draws.

    plan has source_no and slots; `shards` is a power of two. Slots are dealt in runs, so that a
    source of any size is drawn in many tasks; sums of multinomial counts are multinomial.
    """
    runs = plan.where("slots > 0").select("source_no", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / RUN_SLOTS))).alias("run"))
    node = runs.select("source_no", "run", F.lit(1).alias("node"), F.least(F.lit(RUN_SLOTS), F.col("slots") - F.col("run") * RUN_SLOTS).alias("n"))
    for _ in range(shards.bit_length() - 1):
        left = _halved(F.col("n"), F.col("source_no"), F.col("run"), F.col("node"))
        node = node.withColumn("left", left)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("left")).alias("n")))
        node = node.select("source_no", "run", F.inline(halves)).where("n > 0")
    return node.groupBy("source_no", (F.col("node") - shards).alias("shard")).agg(F.sum("n").alias("count"))


def _permuted(index: Column, n: Column, seed: Column) -> Column:
    """Swap-or-not: in each round an index is exchanged with its mirror image, or not."""

    def one_round(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(seed, r, F.lit(SEED)), n) - x + n, n)
        swap = F.pmod(F.xxhash64(seed, r, F.greatest(x, mirror)), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, one_round)


def packed_documents(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document: doc_id, source, size, bucket, and its place in the bucket."""
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[source].alias("source"), n_words(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("print"))
    sized = cut(sized)
    buckets = max(64, sized.count() // BUCKET_DOCS)
    return sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "print", F.lit(SEED)), F.lit(buckets)))


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots).

    documents: doc_id, source, size, print, rn (a number among rows of one bucket), bucket,
    source_no, source_size, target, start (its offset in the source). pieces: the part of each
    document in each block (source_no, block, bucket, rn, from_word, words). slots: shard, slot,
    source_no, block.
    """
    docs = packed_documents(docs, text, source)
    by_bucket = cut(docs.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    block_words = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.col("source_size") / FINENESS))).cast("long")
    targets = cut(source_targets(by_bucket).withColumn("block_words", block_words))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("source", "bucket", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("base"))
    base = cut(base.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "print", "size")
    placed = docs.withColumn("rn", F.row_number().over(inside)).withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    base = base.withColumnsRenamed({"source": "s", "bucket": "b"})
    placed = placed.join(base, placed["source"].eqNullSafe(base["s"]) & (placed["bucket"] == base["b"])).drop("s", "b")
    documents = cut(placed.withColumn("start", F.col("base") + F.col("before")).drop("base", "before"))

    first, last = F.expr("start div block_words"), F.expr("(start + size - 1) div block_words")
    pieces = documents.where("size > 0").select("source_no", "bucket", "rn", "start", "size", "block_words", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    pieces = pieces.select("source_no", "block", "bucket", "rn", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("words"))

    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    nearest = F.when(F.col("target") >= F.col("source_size") * LIMIT, blocks * LIMIT).otherwise(F.least(F.round(F.col("target") / F.col("block_words")).cast("long"), blocks * LIMIT))
    plan = cut(targets.where("source_size > 0").select("source_no", blocks.alias("blocks"), nearest.alias("slots")))
    every = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(LEAST_SHARDS, 1 << (-(-every // SHARD_SLOTS) - 1).bit_length() if every else 0)
    counts = cut(shard_counts(plan, shards))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    taken = counts.withColumn("from", F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(plan, "source_no")
    # slots are made in runs, so that a large source is dealt over many tasks
    dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = taken.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr("(count - 1) div 4096")))).repartition(dealt, "source_no", "shard", "run")
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("from") + F.col("run") * 4096, F.col("from") + F.least(F.col("run") * 4096 + 4095, F.col("count") - 1))))
    epoch = F.expr("slot div blocks")
    block = _permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.xxhash64(F.lit(SEED), "source_no", epoch))
    return documents, pieces, slots.select(F.col("shard").cast("int").alias("shard"), "slot", "source_no", block.alias("block"))


def taken_pieces(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Pieces with the number of times that their block is taken (once or more), and the first of the
    shards that take it."""
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    return pieces.join(times, ["source_no", "block"])


def document_totals(docs: DataFrame) -> DataFrame:
    """A row for each document: its size, its source's size and target, the words taken of it over all
    shards, and the first shard that takes any (null for none)."""
    documents, pieces, slots = mix(docs)
    taken = taken_pieces(pieces, slots).groupBy("source_no", "bucket", "rn").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    return documents.join(taken, ["source_no", "bucket", "rn"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_shard")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: the words of each that the mix takes, repeats after the first pass.

    A document taken whole once keeps its text as it is; one not taken at all goes. n_chars is
    counted anew where the text changes. Rows of null id or source are mixed like others; an empty
    table gives an empty table, a document without words goes.
    """
    documents, pieces, slots = mix(docs)
    piece = F.struct("from_word", "words", F.col("times").cast("int").alias("times"))
    taken = taken_pieces(pieces, slots).groupBy("source_no", "bucket", "rn").agg(F.array_sort(F.collect_list(piece)).alias("taken_"), F.sum("words").alias("once"), F.sum(F.col("words") * F.col("times")).alias("all_"), F.max("times").alias("most"))
    chosen = documents.join(taken, ["source_no", "bucket", "rn"]).select(F.col("doc_id").alias("id_"), F.col("print").alias("print_"), F.col("source").alias("source_"), "rn", "size", "taken_", "once", "all_", "most")
    # rows that share id, source and text are told apart by their number among equals
    same = Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy("lang", "n_chars")
    numbered = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("again", F.row_number().over(same))
    chosen = chosen.withColumn("again_", F.row_number().over(Window.partitionBy("id_", "source_", "print_").orderBy("rn")))
    on = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.xxhash64("text") == F.col("print_")) & (F.col("again") == F.col("again_"))
    whole_once = (F.col("all_") == F.col("size")) & (F.col("most") == 1)
    out = numbered.join(chosen, on).withColumn("words_", F.when(~whole_once, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    part = lambda k: F.flatten(F.transform(F.filter("taken_", lambda p: p["times"] >= k), lambda p: F.slice("words_", p["from_word"].cast("int") + 1, p["words"].cast("int"))))
    mixed = F.array_join(F.concat(*(part(k) for k in range(1, LIMIT + 1))), " ")
    out = out.withColumn("mixed_", F.when(whole_once, F.col("text")).otherwise(mixed))
    return out.select("doc_id", F.col("mixed_").alias("text"), "lang", "source", F.when(whole_once, F.col("n_chars")).otherwise(F.length("mixed_").cast("long")).alias("n_chars"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over documents; nulls, ties and empty tables as the module says."""
    return document_totals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
