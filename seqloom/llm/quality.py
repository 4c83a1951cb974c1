"""Document quality by votes of the nearest labelled documents in a latent-semantic space.

A document is a row of a term matrix. Its terms are single bytes, hashed byte pairs and, because quality
shows in form more than in vocabulary, binned measures of the whole text: share of distinct words, share of
the commonest word, capitals, punctuation, digits, word and line lengths, repeated lines. Inverse document
frequencies and a truncated singular value decomposition of the labelled rows give the latent space. The
labelled vectors are broadcast: no more than ``MOST_LABELLED`` rows of ``DIMS`` numbers. Every document is
compared with all of them, in blocks; its ``NEIGHBOURS`` most similar ones vote with their similarity.

At most ``MOST_LABELLED`` labels are learned from, those with the smallest hash of their doc_id; all
documents are scored by their whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MOST_LABELLED = 8192
DIMS = 48
NEIGHBOURS = 15
PAIR_BINS = 512
MEASURE_BINS = 12
MEASURE_WEIGHT = 3.0
N_MEASURES = 10
TERMS = 256 + PAIR_BINS + N_MEASURES * MEASURE_BINS


def measures(data: bytes, counts: np.ndarray) -> list[float]:
    """Ten properties of a text, each between 0 and 1."""
    words = data.lower().split()
    n, size = max(1, len(words)), max(1, len(data))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    capitals, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    small = int(counts[97:123].sum())
    spaces = int(counts[9:14].sum() + counts[32])
    marks = int(counts[33:127].sum()) - capitals - digits - small
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    return [len(seen) / n, max(seen.values(), default=0) / n, repeated / n,
            capitals / max(1, capitals + small), marks / size * 3, digits / size * 3,
            min(1.0, (size - spaces) / n / 16), len(set(lines)) / max(1, len(lines)),
            min(1.0, np.log1p(n) / 12), min(1.0, np.log1p(n / max(1, len(lines))) / 8)]


def terms(text: str | None) -> np.ndarray:
    """Row of the term matrix, before weighting."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    single = np.bincount(raw, minlength=256)
    row = np.zeros(TERMS, dtype=np.float32)
    if len(raw):
        row[:256] = single * (1000 / len(raw))
    if len(raw) > 1:
        pairs = (raw[:-1].astype(np.uint32) * 31 + raw[1:] * np.uint32(7)) % PAIR_BINS
        row[256: 256 + PAIR_BINS] = np.bincount(pairs, minlength=PAIR_BINS) * (1000 / len(raw))
    row[: 256 + PAIR_BINS] = np.log1p(row[: 256 + PAIR_BINS]) * 0.2
    at = 256 + PAIR_BINS
    for value in measures(data, single):
        place = min(max(float(value), 0.0), 1.0) * (MEASURE_BINS - 1)
        low = int(place)
        row[at + low] += MEASURE_WEIGHT * (1 - (place - low))
        if low + 1 < MEASURE_BINS:
            row[at + low + 1] += MEASURE_WEIGHT * (place - low)
        at += MEASURE_BINS
    return row


class Space:
    """Latent space of the labelled rows, and the votes in it."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if not len(rows):
            self.vectors = None
            return
        share = (rows > 0).sum(axis=0)
        self.weights = np.log((1 + len(rows)) / (1 + share)).astype(np.float32) + 0.2
        weighted = rows * self.weights
        self.centre = weighted.mean(axis=0)
        weighted = weighted - self.centre
        values, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, : min(dims, len(values))].astype(np.float32))
        self.vectors = self._unit(weighted @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the votes; the share among all labelled rows if there are none."""
        if self.vectors is None or not len(rows):
            return np.full(len(rows), self.prior)
        near = self._unit((rows * self.weights - self.centre) @ self.axes) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** 4 + 1e-9
        return np.clip((vote * self.labels[at]).sum(axis=1) / vote.sum(axis=1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Space:
    """Learn from ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) names.

    Of the labels with an id and a value, the ``most`` with the smallest hash of the id are used.
    """
    picked = (labels.select(F.col("doc_id"), F.col("quality").cast("float").alias("label"))
              .where("doc_id IS NOT NULL AND label IS NOT NULL")
              .select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "label").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # no more than `most` ids

    def run(batches):
        for b in batches:
            for t, y, h in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([terms(t.as_py()).tobytes()]), pa.array([y], pa.float32()), pa.array([h])],
                    names=["row", "label", "h"])

    got = rows.select("text", "label", "h").mapInArrow(run, "row binary, label float, h long").toPandas()
    got = got.sort_values(["h", "label", "row"], kind="stable")
    return Space(np.frombuffer(b"".join(got["row"]), dtype=np.float32).reshape(-1, TERMS), got["label"].to_numpy())


def score(docs: DataFrame, space: Space, block: int = 256) -> DataFrame:
    """Add ``score`` to all columns of ``docs``, by its column text, a null text counting as empty."""
    model = docs.sparkSession.sparkContext.broadcast(space)  # bounded: MOST_LABELLED x DIMS and TERMS x DIMS
    at, schema = docs.columns.index("text"), StructType([*docs.schema.fields, StructField("_score", DoubleType())])

    def run(batches):
        for b in batches:
            texts = b.column(at)
            out = [model.value.score(np.stack([terms(texts[i].as_py()) for i in range(lo, min(lo + block, len(texts)))]))
                   for lo in range(0, len(texts), block)]
            found = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())],
                                             names=[*b.schema.names, "_score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id, parts: int = 3, part: int = 1):
    """Whether a document is kept from learning: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def op8_quality_neighbours(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels that are not held out.

    Repeated rows are scored each; a null doc_id has no label and is not held out; rows without a label are
    only scored; other columns are ignored; without any label the score is 0.5.
    """
    slim = docs.select("doc_id", "text")
    space = fit(slim, labels.select("doc_id", "quality").where(~held_out(F.col("doc_id"))))
    return score(slim, space).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
                                     (F.col("_score") >= 0.5).cast("int").alias("predicted"))
