"""The prefix trie of conversations, its subtree totals computed by time-forward processing.

A node is a distinct sequence of first turns; it is named by its depth and by sums of position-dependent hashes of its
turns (128 bits), so names come from running sums and not from walking a conversation. Positions and sums are taken in
stretches of turns with the totals of earlier stretches added, so one very long conversation is many groups.

Totals flow from children to parents. A node's own value is credited to one row, the one of its smallest member, whose
turns contain all its ancestors. Rows are dealt to shards by stretches of conversations; in a shard, Spark's external
sort puts them in reverse level order, and each node takes its messages from a priority queue that spills to disk,
adds them up and sends its total on to its parent. Across shards, totals of nodes that several shards hold are added,
and a conversation's lower stretches reach the upper ones as sums.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import partitions, stored

#: Turns of one conversation in a group, and levels of the trie in a shard.
STRETCH = 4096
#: Neighbouring conversations dealt to one shard, so that a shared beginning is often found there once.
TOGETHER = 64
#: Messages a queue holds in memory, ids in one piece of a list.
QUEUE_ROWS, PIECE_IDS = 500_000, 8192
#: A rebuilt conversation begins with turns of the conversation at the last multiple of this.
FAMILY, HEAD_CHOICES = 5, 9

_LANES = 4
_NODE = ["n1", "n2"]


class SpillingQueue:
    """A priority queue of tuples that holds at most ``most`` of them in memory.

    Beyond that, sorted runs go to Spark's own local folders (``SPARK_LOCAL_DIRS``, where its sorts spill as well).
    They live only as long as the task; a lost executor's task starts anew from its input.
    """

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.heap, self.heads, self.runs = most, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) >= self.most:
            self._spill()

    def _spill(self) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None
        if folder:
            os.makedirs(folder, exist_ok=True)
        run = tempfile.TemporaryFile(dir=folder)
        self.heap.sort()
        for lo in range(0, len(self.heap), 4096):
            pickle.dump(self.heap[lo:lo + 4096], run)
        run.seek(0)
        self.heap = []
        self.runs.append(self._read(run))
        self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(run):
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _advance(self, k: int) -> None:
        item = next(self.runs[k], None)
        if item is not None:
            heapq.heappush(self.heads, (item, k))

    def peek(self) -> tuple | None:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return self.heap[0]
        return self.heads[0][0] if self.heads else None

    def pop(self) -> tuple:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, k = heapq.heappop(self.heads)
        self._advance(k)
        return item


def _prefix_sums(df: DataFrame, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """Add, per (conv, part), the sums of ``amounts`` over this row and all earlier ones of the conversation.

    ``part`` has to be monotone in the order; rows of one part are summed in one group.
    """
    inside = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("conv", "part").agg(*[F.sum(a).alias(f"_{k}") for k, a in amounts.items()])
    before = totals.select("conv", "part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}")
                                             for k in amounts])
    held = df.select("*", *[F.sum(a).over(inside).alias(k) for k, a in amounts.items()])
    return (held.join(before, ["conv", "part"])
            .select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in amounts]))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos from 1, digest, n_bytes) of ``conversations`` (conv_id, turn, role, text).

    Order: turn (null first), then role, then the digest of role and text. A null role or text is an empty one.
    Rows without a conv_id belong to no conversation and are left out. Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    parted = slim.withColumn("part", F.floor(F.coalesce("turn", F.lit(-(2**63))) / F.lit(STRETCH)).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return (_prefix_sums(parted, order, {"pos": F.lit(1).cast("long")})
            .select("conv", "pos", "digest", "n_bytes"))


def rebuilt_turns(ordered: DataFrame) -> DataFrame:
    """(conv, depth, digest, n_bytes, turns): conversations that begin with turns of the first of their family.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % 5``, where ``h`` is the checksum of its id modulo 9,
    then its own after its first ``h``. Every conversation has a row of depth 0 as well; ``turns`` is its new length.
    """
    lengths = ordered.groupBy("conv").agg(F.max("pos").alias("own"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_CHOICES).cast("long")
    base = F.expr(f"conv - conv % {FAMILY}")
    first = lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = stored(lengths.withColumn("h", h).withColumn("base", base).join(first, "base", "left")
                   .withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
                   .withColumn("turns", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
                   .select("conv", "base", "h", "head", "turns"), "conversations")
    heads = (ordered.where(F.col("pos") < HEAD_CHOICES).withColumnRenamed("conv", "base").join(convs, "base")
             .where("pos <= h").select("conv", F.col("pos").alias("depth"), "digest", "n_bytes", "turns"))
    # a row's shift depends on its conversation; by parts, so that a long one is several groups
    part = F.floor((F.col("pos") - 1) / STRETCH)
    parts = (convs.where("turns > head")
             .select("conv", "h", "head", "turns", F.explode(F.sequence(
                 F.floor(F.col("h") / STRETCH), F.floor((F.col("turns") - F.col("head") + F.col("h") - 1) / STRETCH)))
                 .alias("part")))
    rest = (ordered.withColumn("part", part).join(parts, ["conv", "part"]).where("pos > h")
            .select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "digest", "n_bytes", "turns"))
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"),
                         F.lit(0).cast("long").alias("n_bytes"), "turns")
    return heads.unionByName(rest).unionByName(roots)


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, part, n_bytes, is_end, n1, n2, p1, p2) of ``turns``: the node that each turn leads to, its parent."""
    lanes = {f"s{k}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "digest").bitwiseAND(F.lit(0xFFFFFFFF)))
             .otherwise(F.lit(0).cast("long")) for k in range(_LANES)}
    terms = turns.withColumn("part", F.floor(F.col("depth") / STRETCH)).select(
        "*", *[c.alias(f"t{k}") for k, c in enumerate(lanes.values())])
    summed = _prefix_sums(terms, [F.col("depth")], {f"s{k}": F.col(f"t{k}") for k in range(_LANES)})
    here = [F.col(f"s{k}") for k in range(_LANES)]
    above = [F.col(f"s{k}") - F.col(f"t{k}") for k in range(_LANES)]
    up = lambda c: F.when(F.col("depth") > 0, c)
    return summed.select(
        "conv", "depth", "part", "n_bytes", (F.col("depth") == F.col("turns")).alias("is_end"),
        F.xxhash64("depth", *here).alias("n1"), F.xxhash64(F.lit("b"), "depth", *here).alias("n2"),
        up(F.xxhash64(F.col("depth") - 1, *above)).alias("p1"),
        up(F.xxhash64(F.lit("b"), F.col("depth") - 1, *above)).alias("p2"))


def time_forward(batches, stretch: int, queue_rows: int):
    """Subtree totals of one shard. Rows: depth, n1, n2, p1, p2, leaves, saved, in reverse level order.

    Equal rows of a node are adjacent. A node at the top of its stretch of levels sends nothing on: what its stretch
    holds was added to the one above as a sum.
    """
    import pyarrow as pa

    queue, out = SpillingQueue(queue_rows), [[], [], [], []]
    now, parent, leaves, saved = None, None, 0, 0

    def close():
        nonlocal leaves, saved
        while (message := queue.peek()) is not None and message[:3] == now:
            leaves, saved = leaves + message[3], saved + message[4]
            queue.pop()
        for column, value in zip(out, (now[1], now[2], leaves, saved)):
            column.append(value)
        if now[0] % stretch and (leaves or saved):
            queue.push((now[0] + 1, *parent, leaves, saved))

    def emit():
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                           names=["n1", "n2", "leaves", "saved"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for depth, n1, n2, p1, p2, more_leaves, more_saved in zip(*(c.to_pylist() for c in batch.columns)):
            node = (-depth, n1, n2)
            if node != now:
                if now is not None:
                    close()
                now, parent, leaves, saved = node, (p1, p2), 0, 0
            leaves, saved = leaves + more_leaves, saved + more_saved
        if len(out[0]) >= 8192:
            yield emit()
    if now is not None:
        close()
        yield emit()


def subtree_totals(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n1, n2, n_leaves, saved_tokens) per node of the trie."""
    own = nodes.select(F.col("conv_id").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    # a conversation passes one node per level, so this join is on unique keys
    valued = (path.select("conv", "depth", "part", "is_end", "n1", "n2", "p1", "p2").join(own, ["conv", "depth"], "left")
              .fillna(0, ["leaves", "saved"]))
    below = Window.partitionBy("conv").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lower = (valued.groupBy("conv", "part").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
             .select("conv", F.sum("l").over(below).alias("more_leaves"), F.sum("s").over(below).alias("more_saved"),
                     ((F.col("part") + 1) * STRETCH - 1).alias("depth"))
             .where("more_leaves > 0 OR more_saved > 0"))
    fed = (valued.join(lower, ["conv", "depth"], "left")
           .withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
           .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))))
    dealt = (fed.withColumn("near", F.floor(F.col("conv") / TOGETHER))
             .repartition(partitions(path.sparkSession), "near", "part")
             .sortWithinPartitions(F.col("depth").desc(), "n1", "n2")
             .select("depth", "n1", "n2", "p1", "p2", "leaves", "saved"))
    stretch, queue_rows = STRETCH, QUEUE_ROWS
    parts = dealt.mapInArrow(lambda b: time_forward(b, stretch, queue_rows), "n1 long, n2 long, leaves long, saved long")
    return parts.groupBy(*_NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _pieces(batches, most: int):
    """Sorted (n1, n2, conv) to pieces of each node's list: the joined ids and the first of them."""
    import pyarrow as pa

    def emit(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, [pa.int64(), pa.int64(), pa.int64(), pa.string()])], names=["n1", "n2", "first", "ids"])

    node, held = None, []
    for batch in batches:
        rows = []
        for n1, n2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (n1, n2) != node or len(held) >= most:
                if held:
                    rows.append((*node, held[0], ",".join(map(str, held))))
                node, held = (n1, n2), []
            held.append(conv)
        yield emit(rows)
    if held:
        yield emit([(*node, held[0], ",".join(map(str, held)))])


def _digest_lists(batches):
    """Sorted pieces to one digest per node; only the state of one digest is held."""
    import pyarrow as pa

    def emit(rows):
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, [pa.int64(), pa.int64(), pa.string()])], names=["n1", "n2", "ends_sha256"])

    node, state = None, None
    for batch in batches:
        rows = []
        for n1, n2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (n1, n2) == node:
                state.update(b",")
            else:
                if node is not None:
                    rows.append((*node, state.hexdigest()))
                node, state = (n1, n2), hashlib.sha256()
            state.update(ids.encode())
        yield emit(rows)
    if node is not None:
        yield emit([(*node, state.hexdigest())])


def list_digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256): digest of the ascending, comma-joined ids of ``ends`` (n1, n2, conv) per node.

    Lists are joined piece by piece in ranges of (node, id), so a node where very many conversations end is spread;
    only feeding its ready pieces to the digest, which has to go in order, is one task's work.
    """
    n, most = partitions(ends.sparkSession), PIECE_IDS
    pieces = (ends.repartitionByRange(n, "n1", "n2", "conv").sortWithinPartitions("n1", "n2", "conv")
              .mapInArrow(lambda b: _pieces(b, most), "n1 long, n2 long, first long, ids string"))
    return (pieces.repartition(n, *_NODE).sortWithinPartitions("n1", "n2", "first")
            .mapInArrow(_digest_lists, "n1 long, n2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (as `rebuilt_turns` gives them); no row if there is no conversation."""
    path = stored(paths(stored(turns, "turns")), "paths")
    nodes = stored(path.groupBy(*_NODE).agg(
        F.max("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "nodes")
    children = (nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
                .withColumnsRenamed({"p1": "n1", "p2": "n2"}))
    nodes = stored(nodes.join(children, _NODE, "left").fillna(0, ["n_children"]), "nodes")
    totals = subtree_totals(path, nodes)
    digests = list_digests(stored(path.where("is_end").select("n1", "n2", "conv"), "ends"))
    parents = nodes.where("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"),
                                                   F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, _NODE).join(digests, _NODE, "left").join(parents, ["p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt_turns(stored(ordered_turns(conversations), "ordered-turns")))


_BITS = ("list_transform(range(0, 8 * length(CAST(c AS VARCHAR))), "
         "lambda i: CAST((ascii(CAST(c AS VARCHAR)[CAST(i // 8 AS BIGINT) + 1]) >> CAST(i % 8 AS INTEGER)) & 1 AS BIGINT))")
SQL = f"""
WITH t AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, m) AS pos, m
  FROM (SELECT *, md5(concat(CAST(strlen(role) AS VARCHAR), ':', role, text)) AS m FROM (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL))),
cs AS (
  SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}),
                            lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % {HEAD_CHOICES} AS h
  FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, m, strlen(text) AS n_bytes
  FROM (SELECT k.c, 0 AS own, pos, m, text FROM cs k JOIN t ON t.c = k.c - k.c % {FAMILY} AND pos <= h
        UNION ALL SELECT k.c, 1, pos, m, text FROM cs k JOIN t ON t.c = k.c AND pos > h)),
path AS (
  SELECT c, d, n_bytes, string_agg(m, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM cs),
node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved,
         CASE WHEN d > 0 THEN p[1:32 * (d - 1)] END AS up
  FROM path GROUP BY p, d),
child AS (SELECT up AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
total AS (
  SELECT b.p, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM node a LEFT JOIN child USING (p) JOIN path b ON b.c = a.conv_id AND b.d <= a.d GROUP BY b.p),
ends AS (
  SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT c, max_by(p, d) AS p FROM path GROUP BY c) GROUP BY p)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM node a LEFT JOIN node b ON b.p = a.up LEFT JOIN child ON child.p = a.p JOIN total ON total.p = a.p
     LEFT JOIN ends ON ends.p = a.p
"""
