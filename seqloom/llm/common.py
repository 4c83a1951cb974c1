"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 1024


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS):
    """What runs inside sends at most ``rows`` rows to Python at once.

    A batch of ten thousand texts is held several times: in the JVM outside of its heap, where the buffer grows by
    doubling, in the stream and in the worker, for each task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:  # zero or less: no limit
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of `words`, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def flat_binary(column, dtype):
    """The values of a column of byte strings, one after the other, and where each begins (in values)."""
    import numpy as np

    parts = [v or b"" for v in column.to_pylist()]
    size = np.dtype(dtype).itemsize
    bounds = np.concatenate([[0], np.cumsum([len(p) // size for p in parts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=dtype), bounds


def small(batches, rows: int = 512):
    """Arrow batches in slices of at most ``rows`` rows, so that what a task derives from one stays small."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)
