"""Packing documents into windows of near-equal length by multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small
from seqloom.llm.tokens import default_tokenizer, encoder


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Partition items into ``windows`` sets of near-equal sums (Karmarkar-Karp, many-way).

    Each partial partition is a descending list of (sum, items). The two with the largest spread are
    merged, the largest sums of one with the smallest of the other. Sets that no item has reached yet are
    left out of the lists.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        alone = windows - len(b)  # so many of a's largest meet an empty set of b
        if len(a) <= alone:
            merged = a + b
        else:
            tail = a[alone:]
            paired = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(tail, reversed(b))]
            merged = a[:alone] + paired + b[: len(b) - len(paired)]
        merged.sort(key=_first, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, count, merged))
        count += 1
    sets = [_members(tree) for _, tree in heap[0][2]] if heap else []
    return sets + [[] for _ in range(windows - len(sets))]


def _first(part):
    return part[0]


def _members(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return sorted(out)


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """`differencing` into the fewest windows, one more each time a window exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, windows)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        windows += 1


def uneven(size: int, pieces: int, share: float = 0.75, least: int = 64) -> list[int]:
    """Cut into at most ``pieces`` pieces, each ``share`` of what is left: small ones even out the sums."""
    out = []
    while len(out) < pieces - 1 and size >= least:
        out.append(int(size * share))
        size -= out[-1]
    return [*out, size]


def pack(docs: DataFrame, capacity: int = 2048, pieces: int = 3, group: int = 1 << 18,
         tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Runs of ``capacity`` ids are windows of their own. What is left of a document is cut into at most
    ``pieces`` pieces (`uneven`); whenever a task holds ``group`` ids of them, they are dealt out by
    `near_equal`. A task packs what it reads, so nothing is shuffled, memory is bounded by ``group``, and a
    lost task is done again alone.

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, padded_to. A sequence is padded to ``capacity`` unless its length is a power of
    two. A null text counts as empty and has the end id only; repeated rows are packed each; other columns
    are ignored; an empty input gives no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()
    spark_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        use, serial = encoder(tokenizer), TaskContext.get().partitionId() << 40
        held, total = [], 0

        def emit(rows: list[tuple], like) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [like, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_to"])

        def settle(items: list[tuple]) -> list[tuple]:
            nonlocal serial
            rows = []
            for members in near_equal([x[2] for x in items], capacity):
                offset, filled = 0, sum(items[i][2] for i in members)
                padded = filled if filled & (filled - 1) == 0 else capacity
                for i in members:
                    rows.append((*items[i], serial, offset, padded))
                    offset += items[i][2]
                serial += 1
            return rows

        like = None
        for b in small(batches):
            like = b.column(0).type
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), use.encode(b.column(1).to_pylist(), end)):
                n = len(data) // 4
                full = n // capacity * capacity
                for s in range(0, full, capacity):
                    rows.append((doc, s, capacity, data[4 * s: 4 * (s + capacity)], n, serial, 0, capacity))
                    serial += 1
                rest = n - full
                if not rest:
                    continue
                at = full
                for size in uneven(rest, pieces):
                    held.append((doc, at, size, data[4 * at: 4 * (at + size)], n))
                    at += size
                total += rest
                if total >= group:
                    rows += settle(held)
                    held, total = [], 0
            if rows:
                yield emit(rows, like)
        if held:
            yield emit(settle(held), like)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {spark_id}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
             "offset long, padded_to long")


def op6_pack_differencing(spark, docs: DataFrame) -> DataFrame:
    """All documents packed: one row per piece with the checksum of its ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset", "padded_to")
