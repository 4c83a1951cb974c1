"""Near duplicates by SimHash fingerprints and a grid join on segment bit counts.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. The Manhattan
distance of two embeddings never exceeds the number of differing bits. So fingerprints that link (at most
two bits differ) have embeddings at most two apart: of five groups of coordinates, at most two groups
differ, and the fingerprints share the grid cell of the other three. Cells are joined for each of the ten
choices of three groups, pairs further apart than the bound are left out, the rest is verified exactly.

Counts are written in unary within the two bits of a segment (0, 1, 2 as 00, 01, 11), so a Manhattan
distance is the bit count of an exclusive or, and a cell is a masked integer.

A cell with more than ``FULL`` fingerprints (variants of one text) is not paired: each of its fingerprints
is written with all values that differ from it in at most one bit; two fingerprints link exactly if they
have such a value in common or a chain of links leads over it, as both are then at most two bits apart.
At most 65 fingerprints share a value. Components are the same, at a cost in proportion to the members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import stored
from seqloom.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 2
FULL = 64
_LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of a text, repeats included; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        some = np.array(hashes[lo: lo + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 32 segments of two bits, each in unary."""
    low = F.lit(_LOW)
    after = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(after).bitwiseAND(low), fp.bitwiseAND(after).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(groups: int = MOST_BITS + 3, same: int = 3) -> list[int]:
    """Masks of the segments that make up a cell, one for each choice of ``same`` groups."""
    bounds = [round(32 * i / groups) for i in range(groups + 1)]
    part = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(bounds, bounds[1:])]
    return [_signed(sum(part[i] for i in c)) for c in combinations(range(groups), same)]


def near_links(fps: DataFrame, full: int = FULL) -> DataFrame:
    """``fps`` (fp: distinct fingerprints): links (a, b) with the same components as all links."""
    masks = cell_masks()
    embedded = fps.select("fp", segment_counts(F.col("fp")).alias("seg"))
    cells = embedded.select("fp", "seg", F.posexplode(F.array(
        *[F.col("seg").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    shared = stored(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    held = stored(cells.join(shared, ["grid", "cell"]), "cell-members")
    few = held.where(F.col("n") <= full)
    a, b = few.alias("a"), few.select("grid", "cell", "fp", "seg").alias("b")
    pairs = (a.join(b, ["grid", "cell"]).where("a.fp < b.fp")
             .where(F.bit_count(F.col("a.seg").bitwiseXOR(F.col("b.seg"))) <= MOST_BITS)
             .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS)
             .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    around = (held.where(F.col("n") > full).select("fp").distinct()
              .select("fp", F.explode(flips).alias("flip"))
              .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")))
    stars = (around.groupBy("near").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most 65
             .where(F.size("fps") > 1)
             .select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Returns doc_id, fp, component_id (the smallest doc_id reachable over links) for every row of ``docs``.

    A null text counts as empty; texts without words have fingerprint zero and link like any other; equal
    fingerprints are one class, whatever their number; rows with a null doc_id take part and give their
    class no id; repeated rows are returned each; other columns are ignored.
    """
    held = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = stored(components(near_links(classes)), "components")
    joined = classes.join(roots, classes["fp"] == roots["v"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = stored(joined, "class-roots")
    heads = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(joined.join(heads, "root").select("fp", "component_id"), "class-components")
    return held.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_segments(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All documents with their fingerprint and component."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
