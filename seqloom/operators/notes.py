"""Chords as note events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.chords import chord_pitches

VELOCITY = 80


def notes(events: DataFrame, track: str, program: int = 0) -> DataFrame:
    """One row per chord tone over ``[t0, t1)``; silent chords give none."""
    return (events.select(track, "pos", F.explode(chord_pitches("cm")).alias("pitch"), "t0", "t1")
            .select(track, "pos", "pitch", F.lit(VELOCITY).alias("velocity"),
                    F.lit(program).alias("program"), "t0", "t1"))


def shift_to_zero(events: DataFrame, track: str) -> DataFrame:
    """Remove the initial silence: times count from the first onset of the track."""
    origin = events.groupBy(track).agg(F.min("t0").alias("_o"))
    return (events.join(origin, track)
            .withColumns({"t0": F.col("t0") - F.col("_o"), "t1": F.col("t1") - F.col("_o")}).drop("_o"))
