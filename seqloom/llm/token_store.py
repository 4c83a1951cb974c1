"""Token ids as canonical length-limited Huffman codes in a block file format.

A store is a folder with three Parquet data sets in the shared file system:

* ``codebook``: ``token_id, length``. Codes are canonical: ordered by (length, id), counted up.
* ``blocks``: one row per block of whole documents, ordered by (shard, block): the ids and
  lengths of its documents, the payload, and the bit offset of every ``STEP``-th id of a document.
  A document begins at a whole byte. A block needs nothing but the codebook to be decoded, and all
  its checkpoints are decoded side by side, one table look-up per id.
* ``tokens``: the fixed-width ids while the global counts are gathered.

Defined results: a null text is an empty one (only the end id is stored); null document ids come first;
repeated document ids are stored as often as they occur, equal ids ordered by text; other columns of the
input are ignored; an empty input gives an empty store.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import flat_binary, partitions, scratch_path, small
from seqloom.llm.tokens import default_tokenizer, encoder, vocabulary_size

STEP = 256
BLOCK_IDS = 1 << 18
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit into codes of {limit} bits")
    lengths = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lengths + 1
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, dtype=np.float64)[order]
    current, levels = weights, []
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        current = merged[rank]
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code of each id: ordered by (length, id), each the last one plus one, shifted to its length."""
    codes = np.zeros(len(ids), dtype=np.uint64)
    code, last = 0, 0
    for i in np.lexsort((ids, lengths)):
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


class Codebook:
    """Encoding and decoding tables of a canonical code."""

    def __init__(self, ids, lengths, limit: int = LIMIT):
        ids, lengths = np.asarray(ids, dtype=np.int64), np.asarray(lengths, dtype=np.int64)
        codes = canonical_codes(ids, lengths)
        top = int(ids.max(initial=0)) + 1
        self.limit = limit
        self.code, self.length = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        self.code[ids], self.length[ids] = codes, lengths
        self.symbol, self.width = np.zeros(1 << limit, dtype=np.uint32), np.zeros(1 << limit, dtype=np.int64)
        order = np.lexsort((ids, lengths))
        spans = (1 << (limit - lengths[order])).astype(np.int64)
        self.symbol[: spans.sum()] = np.repeat(ids[order], spans)
        self.width[: spans.sum()] = np.repeat(lengths[order], spans)

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Payload of several documents; where each begins, in bytes (and the end); bit offset of each id."""
        widths = self.length[ids]
        total = np.concatenate([[0], np.cumsum(widths)])
        bits = total[bounds[1:]] - total[bounds[:-1]]
        starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)]).astype(np.int64)
        at = total[:-1] + np.repeat(starts[:-1] * 8 - total[bounds[:-1]], np.diff(bounds))
        out = np.zeros(int(starts[-1]) // 8 + 2, dtype=np.uint64)
        if len(ids):
            word, free = at >> 6, 64 - (at & 63) - widths
            code = self.code[ids]
            left = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64),
                            code >> np.maximum(-free, 0).astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[first]] = np.bitwise_or.reduceat(left, first)
            over = np.flatnonzero(free < 0)
            out[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: int(starts[-1])], starts, at

    def decode(self, payload: bytes, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids behind bit offsets: ``counts[i]`` of them from offset ``at[i]``, all offsets side by side."""
        raw = np.frombuffer(payload + bytes(4), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        out = np.zeros(int(begin[-1]), dtype=np.uint32)
        order = np.argsort(-counts, kind="stable")
        pos, base, live = at[order].astype(np.int64), begin[:-1][order], counts[order]
        mask, drop = (1 << self.limit) - 1, 32 - self.limit
        for k in range(int(counts.max(initial=0))):
            n = int(np.searchsorted(-live, -k, side="left"))
            p = pos[:n]
            peek = (window[p >> 3] >> (drop - (p & 7)).astype(np.uint32)) & mask
            out[base[:n] + k] = self.symbol[peek]
            pos[:n] = p + self.width[peek]
        return out


def _checkpoints(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first id of each run of at most ``step`` ids that stays within a document; runs' lengths."""
    sizes = np.diff(bounds)
    runs = (sizes + step - 1) // step
    doc = np.repeat(np.arange(len(sizes)), runs)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    return bounds[doc] + k * step, np.minimum(step, sizes[doc] - k * step)


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write the store, in ascending order of document ids."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    kind = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype="<u4").tobytes()
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64() if kind_of_id == "bigint" else pa.int32() if kind_of_id == "int" else pa.string()
    ordered = (docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id")
               .sortWithinPartitions("doc_id", "text"))

    def tokenise(batches):
        # the last row of a task holds how often it met each id
        shard, use, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(0, dtype=np.int64)
        names = ["shard", "doc_id", "ids", "seen"]
        for b in small(batches):
            ids = [np.frombuffer(x, "<u4").astype(kind) for x in use.encode(b.column(1).to_pylist(), end)]
            got = np.bincount(np.concatenate(ids)) if ids else seen[:0]
            if len(got) > len(seen):
                got, seen = seen, got.astype(np.int64)
            seen[: len(got)] += got
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(ids), pa.int32()), b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()),
                 pa.nulls(len(ids), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())],
            names=names)

    (ordered.mapInArrow(tokenise, f"shard int, doc_id {kind_of_id}, ids binary, seen binary")
     .write.option("compression", "zstd").parquet(f"{path}/tokens"))
    tokens = spark.read.parquet(f"{path}/tokens")

    def count(batches):
        seen = np.zeros(0, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                got = np.frombuffer(x.as_buffer(), np.int64)
                if len(got) > len(seen):
                    got, seen = seen, got.copy()
                seen[: len(got)] += got
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["token_id", "n"])

    counts = (tokens.where("seen IS NOT NULL").select("seen").mapInArrow(count, "token_id long, n long")
              .groupBy("token_id").agg(F.sum("n").alias("n"))
              .orderBy("token_id").toPandas())  # no more rows than the vocabulary has ids
    ids = counts["token_id"].to_numpy(dtype=np.int64)
    lengths = code_lengths(counts["n"].to_numpy(dtype=np.int64)) if len(ids) else np.zeros(0, dtype=np.int64)
    (spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, lengths)], "token_id int, length int")
     .coalesce(1).write.parquet(f"{path}/codebook"))
    book = spark.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary

    def blocks(code: Codebook, shard: int, number: int, rows: list[tuple]) -> pa.RecordBatch:
        flat, bounds = flat_binary(pa.array([r[1] for r in rows], pa.binary()), kind)
        flat = flat.astype(np.int64)
        payload, starts, at = code.encode(flat, bounds)
        first, _ = _checkpoints(bounds, STEP)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(flat)], pa.int64()),
             pa.array([[r[0] for r in rows]], pa.list_(id_type)),
             pa.array([np.diff(bounds).tolist()], pa.list_(pa.int64())),
             pa.array([payload], pa.binary()), pa.array([at[first].astype("<u8").tobytes()], pa.binary())],
            names=["shard", "block", "n_ids", "doc_ids", "doc_n_ids", "payload", "checkpoints"])

    def encode(batches):
        width, task = np.dtype(kind).itemsize, TaskContext.get().partitionId()
        code, rows, held, shard, number = Codebook(*book.value), [], 0, None, 0
        for b in batches:
            for s, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if rows and (s != shard or held >= BLOCK_IDS):
                    yield blocks(code, shard, (task << 32) + number, rows)
                    rows, held, number = [], 0, number + 1
                shard = s
                rows.append((d, x))
                held += len(x) // width
        if rows:
            yield blocks(code, shard, (task << 32) + number, rows)

    # a file of tokens is one shard; parts of a file may be read by several tasks, each makes blocks of its own
    (tokens.where("seen IS NULL").select("shard", "doc_id", "ids").mapInArrow(encode, f"shard int, block long, n_ids long, doc_ids array<{kind_of_id}>, "
                       "doc_n_ids array<long>, payload binary, checkpoints binary")
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def read_store(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """The documents of a store: doc_id, start (ids before it), n_tokens and ``columns`` derived from ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers, and are returned if no columns are given.
    """
    columns = columns or (F.col("ids"),)
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # bounded by the vocabulary
    table = spark.sparkContext.broadcast((book["token_id"].to_numpy(), book["length"].to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind_of_id = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        code = Codebook(*table.value)
        for b in batches:
            for shard, block, ids, sizes, payload, marks in zip(*(b.column(i).to_pylist() for i in range(6))):
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                _, counts = _checkpoints(bounds, STEP)
                flat = code.decode(payload, np.frombuffer(marks, "<u8"), counts).astype("<u4").tobytes()
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int64()),
                     pa.array(bounds[:-1]), pa.array(ids, b.column(2).type.value_type), pa.array(sizes, pa.int64()),
                     pa.array([flat[4 * i: 4 * j] for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["shard", "block", "inside", "doc_id", "n_tokens", "ids"])

    found = (blocks.select("shard", "block", "doc_ids", "doc_n_ids", "payload", "checkpoints")
             .mapInArrow(decode, f"shard int, block long, inside long, doc_id {kind_of_id}, n_tokens long, ids binary")
             .select("shard", "block", "inside", "doc_id", "n_tokens", *columns))
    heads = blocks.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    shards = (heads.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
              .select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start")))
    # blocks of a shard in the order of their first document
    within = Window.partitionBy("shard").orderBy("first", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.select("shard", "block", "n_ids", F.col("doc_ids")[0].alias("first"))
               .select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start"))
               .join(shards, "shard"))
    return (found.join(offsets, ["shard", "block"])
            .select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"),
                    *[c for c in found.columns if c not in ("shard", "block", "inside", "doc_id")]))


def op1_token_huffman(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents as a store, read it back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "token-store")
    write_store(docs, path)
    return read_store(spark, path, F.crc32("ids").alias("ids_crc32"))
