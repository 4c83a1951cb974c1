"""Mixing sources to target weights by fixed-length blocks of words.

The documents of a source follow each other in the order of a hash, and their words are cut into blocks of
``BLOCK`` words. A source takes target / ``BLOCK`` slots of the mix. Each slot is thrown into one of the
output shards by hash: the counts of a source over the shards are a multinomial draw whose total is exact.
Slot ``k`` of a source holds block ``perm(k mod blocks)`` in its round ``k div blocks``, where ``perm`` is a
pseudorandom affine permutation of its own for each source and round. So no block occurs more often than
the rounds begun, and two of them bound the number of times a document is taken. The last slot of a source
takes only the words that are missing to its target. Blocks and slots are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import n_words, stored
from seqloom.llm.ranking import running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SHARD_SLOTS = 4096
#: Prime multipliers; no two of them divide the same number of up to 2**62 blocks.
PRIMES = (2147483659, 2147483693, 2147483713, 2147483743)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size: one row per source): adds ``target``.

    Sources by code point, null last, have the weights in turn. A target stops at ``most`` times its
    source's size; the excess goes to the others by weight until none is above. The sources that stop are
    those with the smallest room per weight: with them in this order, the level is found by running sums.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    w = w.withColumn("room", F.lit(most) * F.col("source_size"))
    by = Window.orderBy((F.col("room") / F.col("weight")), F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (w.withColumn("all_", F.sum("source_size").over(all_) * F.lit(share))
         .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
         .withColumn("left_", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("all_") - F.col("full")) / F.col("left_")))
    # the first source, in this order, that its level leaves below its room sets the level of all later ones
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))
    w = w.withColumn("final", F.first(open_, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return w.select("source", "source_size",
                    F.when(F.col("final").isNull(), F.col("room"))
                    .otherwise(F.least(F.col("final") * F.col("weight"), F.col("room"))).alias("target"))


def _permuted(k: Column, n: Column, seed: Column) -> Column:
    """``k`` in 0..n-1 under an affine permutation that the seed chooses, for up to 2**40 values."""
    pick = F.pmod(F.xxhash64(seed, F.lit(1)), F.lit(len(PRIMES))).cast("int")
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    first, other = F.get(primes, pick), F.get(primes, F.pmod(pick + 1, F.lit(len(PRIMES))))
    factor = F.pmod(F.when(F.pmod(n, first) == 0, other).otherwise(first), n)
    # the product is taken in two steps of 20 bits, so that it stays within a long
    high, low = F.shiftright(k, 20), k.bitwiseAND(F.lit((1 << 20) - 1))
    product = F.pmod(F.pmod(factor * high, n) * F.lit(1 << 20) + factor * low, n)
    return F.pmod(product + F.pmod(F.xxhash64(seed, F.lit(2)), n), n)


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 42, weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: float = MOST, identity: tuple[str, ...] = ("doc_id", "text")
        ) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id, source, text). Returns the documents with the targets of their sources, and what the mix takes of them.

    The first has source, cell, row_no, doc_id, row_hash (of the ``identity`` columns), size, source_size and
    target; the second source, cell, row_no, doc_start and length (a run of words of the document), round
    (0 or 1), out_shard and slot.

    A null text has no words and is never taken; a null source is a source of its own, the last; sizes of
    zero get a target of zero; repeated rows are documents of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "source", "text", n_words(F.col("text")).alias("size"),
                       F.xxhash64(*identity).alias("row_hash"))
    base = stored(slim.select("doc_id", "source", "size", "row_hash"), "sizes")
    rows = base.count()
    cells = max(1, rows // 2_000)
    base = base.withColumn("cell", F.pmod("row_hash", F.lit(cells)).cast("int"))
    order = [F.col("row_hash"), F.col("doc_id"), F.col("size")]
    placed = running(base, ["source"], ["cell"], order, F.col("size"), "begin")
    place = Window.partitionBy("source", "cell").orderBy(*order)
    placed = stored(placed.withColumn("row_no", F.row_number().over(place)), "placed")
    goals = stored(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most),
                   "targets")
    plan = goals.where("source_size > 0 AND target >= 1").select(
        "source", F.expr(f"cast(ceil(source_size / {block}) AS long)").alias("blocks"),
        F.floor("target").alias("want"), F.expr(f"cast(ceil(floor(target) / {block}) AS long)").alias("slots"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, total // SHARD_SLOTS)
    # slots are made in two steps, so that one source's slots come from many tasks
    runs = plan.withColumn("run", F.explode(F.expr("sequence(0L, (slots - 1) div 1024)"))).repartition("source", "run")
    slots = (runs.withColumn("k", F.explode(F.expr("sequence(run * 1024, least(run * 1024 + 1023, slots - 1))")))
             .withColumn("out_shard", F.pmod(F.xxhash64("source", "k", F.lit(seed)), F.lit(shards)))
             .withColumn("round", F.expr("k div blocks"))
             .withColumn("block", _permuted(F.expr("k % blocks"), F.col("blocks"),
                                            F.xxhash64("source", "round", F.lit(seed))))
             .withColumn("take", F.expr(f"if(k = slots - 1, want - k * {block}, {block})"))
             .select("source", "block", "round", "out_shard", "take", F.col("k").alias("slot")))
    pieces = (placed.where("size > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
              .withColumn("lo", F.expr(f"greatest(begin, block * {block})"))
              .withColumn("hi", F.expr(f"least(begin + size, block * {block} + {block})"))
              .select("source", "cell", "row_no", "begin", "block", "lo", "hi"))
    keys = [F.col("p.source").eqNullSafe(F.col("s.source")), F.col("p.block") == F.col("s.block")]
    end = F.expr(f"least(hi, p.block * {block} + take)")
    taken = (pieces.alias("p").join(slots.hint("merge").alias("s"), keys)  # slots come from few rows, but are many
             .select("p.source", "cell", "row_no", (F.col("lo") - F.col("begin")).alias("doc_start"),
                     (end - F.col("lo")).alias("length"), "round", "out_shard", "slot")
             .where("length > 0"))
    held = placed.join(goals, placed["source"].eqNullSafe(goals["source"])).select(
        placed["source"], "cell", "row_no", "doc_id", "row_hash", "size", "source_size", "target")
    return held, taken


def same_row(left: DataFrame, right: DataFrame) -> list[Column]:
    return [left["source"].eqNullSafe(right["source"]), left["cell"] == right["cell"],
            left["row_no"] == right["row_no"]]


def op9_mix_blocks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken."""
    held, taken = mix(docs)
    sums = taken.groupBy("source", "cell", "row_no").agg(F.sum("length").alias("taken"))
    return held.join(sums, same_row(held, sums), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
