"""Sharding by balanced label propagation: linked documents move to their neighbours' shards.

Two documents are linked if they share a link key (here: the text). Every document starts in a shard dealt
by hash. In each round a link key asks its documents to the shard that holds most of them; the counts of
documents are gathered per (key, shard) before anything is shuffled, so that a key with a third of all rows
costs a few rows. Requests to a shard are granted in the order of a hash up to its quota, the places
not held by linked documents that stay. Unlinked documents have no wish and fill up what remains; if leavers
are refused elsewhere, a shard may be too full for a round, which the next rounds and the law below mend.

At the end the law ``rows`` holds: all documents stand in the order (shard, link key) and are cut into equal
counts, so that shards differ by one row at most and at most one key is cut at each border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored
from seqloom.llm.ranking import running

SHARDS = 24
#: Rows that are placed side by side by one task; it has no part in which rows stay together.
PART = 2000
SALTS = 32
CELLS = 256
#: Quota of a shard during the rounds, as a multiple of an equal share; the law at the end is exact.
SLACK = 1.25


def _shares(cols: list[str], salts: int = SALTS) -> Column:
    """A salt from the row's own values: rows of one key are spread over several tasks."""
    return F.pmod(F.xxhash64(*cols, F.lit(7)), F.lit(salts)).cast("int")


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = 4) -> DataFrame:
    """``rows`` has row_key (long), link (long, null: linked to nothing). Adds ``label`` and ``part``.

    ``part`` numbers the parts of a link key that are moved as a whole, one unless the key has more rows than a
    shard's quota; it is null for unlinked rows. ``big`` is the part if it is placed in pieces, and 0 for all
    others; ``sub`` is the piece.
    """
    spark = rows.sparkSession
    total = rows.count()
    capacity = max(1, -(-int(total * SLACK) // shards))
    first = F.pmod(F.xxhash64("row_key", F.lit(11)), F.lit(shards)).cast("int")
    sizes = (rows.where("link IS NOT NULL").groupBy("link").agg(F.count("*").alias("members"))
             .where("members > 1")
             .select("link", F.expr(f"cast(ceil(members / {capacity}) AS long)").alias("parts"),
                     F.expr(f"cast(ceil(members / {PART}) AS long)").alias("pieces")))
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = rows.withColumn("salt", _shares(["row_key"])).join(spread, ["link", "salt"], "left").drop("salt")
    part = F.when(F.col("parts").isNotNull(),
                  F.xxhash64("link", F.pmod(F.xxhash64("row_key", F.lit(13)), F.col("parts"))))
    large = F.coalesce(F.col("pieces") > 1, F.lit(False))
    piece = F.pmod(F.xxhash64("row_key", F.lit(17)), F.col("pieces")).cast("int")
    state = stored(held.withColumn("part", part).withColumn("label", first)
                   .withColumn("big", F.when(large, F.col("part")).otherwise(F.lit(0).cast("long")))
                   .withColumn("sub", F.when(large, piece).otherwise(F.lit(0))).drop("parts", "pieces"), "labels")
    # counts of linked documents per part and shard: all that a round needs
    counts = stored(state.where("part IS NOT NULL").groupBy("part", "label").agg(F.count("*").alias("n")), "counts")
    for step in range(rounds):
        best = Window.partitionBy("part").orderBy(F.desc("n"), "label")
        aimed = counts.withColumn("target", F.first("label").over(best))
        want = (aimed.where("target <> label")
                .withColumn("cell", F.pmod(F.xxhash64("part", F.lit(step)), F.lit(CELLS)).cast("int")))
        load = aimed.where("target = label").groupBy("label").agg(F.sum("n").alias("linked"))
        quota = (spark.range(shards).select(F.col("id").cast("int").alias("label")).join(load, "label", "left")
                 .select(F.col("label").alias("target"), (F.lit(capacity) - F.coalesce("linked", F.lit(0))).alias("free")))
        asked = running(want, ["target"], ["cell"], [F.col("part"), F.col("label")], F.col("n"), "ahead")
        granted = (asked.join(quota, "target").where("ahead + n <= free")
                   .select("part", "label", F.col("target").alias("goes")))
        moved = counts.join(granted, ["part", "label"], "left")
        counts = stored(moved.groupBy("part", F.coalesce("goes", "label").alias("label"))
                        .agg(F.sum("n").alias("n")), "counts")
    # a part's documents are interchangeable: they take its shards by their place in the part
    upto = Window.partitionBy("part").orderBy(F.desc("n"), "label")
    ends = (counts.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
            .groupBy("part").agg(F.sort_array(F.collect_list(F.struct("hi", "label"))).alias("spans")))
    place = Window.partitionBy("part").orderBy("row_key")
    whole = state.where("part IS NOT NULL AND big = 0").withColumn("place", F.row_number().over(place).cast("long") - 1)
    pieces = running(state.where("part IS NOT NULL AND big <> 0"), ["part"], ["sub"], [F.col("row_key")], F.lit(1), "place")
    linked = (whole.unionByName(pieces).join(ends, "part")
              .withColumn("label", F.expr("filter(spans, s -> s.hi > place)[0].label")).drop("place", "spans"))
    # unlinked documents have no wish: they fill up what the linked ones leave of equal shares
    held = dict(counts.groupBy("label").agg(F.sum("n")).collect())  # one row per shard
    ends, left = [], 0
    for x in range(shards):
        left += max(0, -(-(x + 1) * total // shards) - -(-x * total // shards) - held.get(x, 0))
        ends.append(left)
    alone = state.where("part IS NULL").withColumn(
        "bucket", F.pmod(F.xxhash64("row_key", F.lit(19)), F.lit(max(1, total // PART))).cast("int"))
    alone = running(alone, [], ["bucket"], [F.col("row_key")], F.lit(1), "place")
    full = F.least(F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("place"))),
                   F.lit(shards - 1))
    return linked.unionByName(alone.withColumn("label", full).drop("bucket", "place")), total


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = 4) -> DataFrame:
    """Shard ``docs`` (doc_id, text) under the law ``rows``.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard (null:
    this law says nothing about a larger number of shards). Documents with equal texts are linked. A null
    text has size 8, checksum 0 and no links; an empty text links to other empty texts. Repeated rows
    each get a slot; a null doc_id is a value like any other; other columns are ignored; an empty input
    gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text", F.octet_length("text"))).alias("link"))
    labelled, total = propagate(rows, shards, rounds)
    near = max(1, total // (shards * PART))
    key = F.coalesce("part", "row_key")
    placed = labelled.withColumn("order_key", key).withColumn(
        "cell", F.pmod(F.xxhash64("order_key"), F.lit(near)).cast("int"))
    # place within the shard of the propagation, then in all of them: one row per shard
    placed = running(placed, ["label"], ["cell", "big", "sub"], [F.col("order_key"), F.col("row_key"), F.col("doc_id")],
                     F.lit(1), "inside")
    loads = labelled.groupBy("label").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    starts = loads.select("label", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    rank = F.col("begin") + F.col("inside")
    # shard s holds the ranks from ceil(s * total / shards) on
    shard = F.expr(f"cast((rank * {shards}) div {max(total, 1)} AS int)")
    return (placed.join(F.broadcast(starts), "label")  # one row per shard
            .withColumn("rank", rank).withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("rank") - F.expr(f"(cast(shard AS long) * {total} + {shards - 1}) div {shards}")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def cut_links(assigned: DataFrame) -> DataFrame:
    """Number of linked rows and, of these, those outside the shard that holds most of their link."""
    per = assigned.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    best = per.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.max("n").alias("kept"))
    return best.where("n > 1").agg(F.sum("n").alias("linked"), F.sum(F.col("n") - F.col("kept")).alias("cut"))


def op4_shard_propagation(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents in shards 0 to 23."""
    return assign(docs)
