"""Progressions put together from segments of several tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ordered import Ordered, index_sequence, running, shifted


def stitched(segments: DataFrame, by: str, track: str) -> Ordered:
    """Segments (``by``, track, seg_ord, t0, t1) in the order of track and ordinal, one after the other per ``by``.

    Adds ``pos`` and ``begin``, the tick at which a segment begins in its progression.
    """
    parts = segments.withColumn("_n", F.col("t1") - F.col("t0"))
    seq = running(index_sequence(parts, (by,), (track, "seg_ord")), {"_end": ("sum", "_n")})
    return seq.with_df(seq.df.withColumn("begin", F.col("_end") - F.col("_n")).drop("_n", "_end"))


def concat_chords(segments: DataFrame, chords: DataFrame, by: str, track: str) -> DataFrame:
    """The chords of stitched segments with rebased times: (by, pos, chord, key, t_start, t_end, track, seg_ord).

    ``chords`` (track, seg_ord, chord_index, chord, key, start, duration) have the times of their tracks. If a segment
    begins with the chord and key that the one before ends with, the two are one chord, which counts for the earlier.
    """
    parts = stitched(segments, by, track).df.select(by, track, "seg_ord", "t0", "begin", F.col("pos").alias("_seg"))
    placed = chords.join(parts, [track, "seg_ord"]).withColumn("_at", F.col("begin") + F.col("start") - F.col("t0"))
    seq = shifted(index_sequence(placed, (by,), ("_seg", "chord_index")), {"_c": ("chord", 1), "_k": ("key", 1)})
    border = (F.col("pos") > 0) & (F.col("chord_index") == 0)
    goes_on = border & F.col("chord").eqNullSafe(F.col("_c")) & F.col("key").eqNullSafe(F.col("_k"))
    seq = running(seq.with_df(seq.df.withColumn("_new", (~goes_on).cast("long"))), {"_run": ("sum", "_new")})
    first = lambda c: F.min_by(c, "pos").alias(c)
    return (seq.df.groupBy(by, (F.col("_run") - 1).alias("_pos"))
            .agg(first("chord"), first("key"), F.min("_at").alias("t_start"),
                 (F.min("_at") + F.sum("duration")).alias("t_end"), first(track), first("seg_ord"))
            .withColumnRenamed("_pos", "pos"))


def concat_series(segments: DataFrame, ticks: DataFrame, by: str, track: str, value: str) -> DataFrame:
    """The series of stitched segments, one row per tick: (by, t, value). ``ticks`` is (track, seg_ord, t, value)."""
    parts = stitched(segments, by, track).df.select(by, track, "seg_ord", "t0", "begin")
    return (ticks.join(parts, [track, "seg_ord"])
            .select(by, (F.col("begin") + F.col("t") - F.col("t0")).alias("t"), value))
