"""Adapters that read the star-schema tables as annotated sequences."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.config import DEFAULT
from seqloom.operators.ordered import Ordered, index_sequence
from seqloom.operators.projection import align_keys, parse_labels, with_references
from seqloom.session import table

# Note names by pitch class, chord qualities by event type.
NOTE_NAMES = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
QUALITY = {"click": "maj", "view": "min", "purchase": "7", "signup": "min7"}

TRACK = "user_id"

#: The events of these tables are hours apart: one tick of their series is four hours long.
TABLES = replace(DEFAULT, sample_seconds=14_400)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def _note(n: str) -> str:
    names = ", ".join(f"'{x}'" for x in NOTE_NAMES)
    return f"get(array({names}), cast(pmod({n}, 12) AS int))"


def chord_label() -> Column:
    """Root from the value, quality from the type; ``error`` events are silence."""
    quality = " ".join(f"WHEN '{name}' THEN ':{q}'" for name, q in QUALITY.items())
    return F.expr(f"coalesce(concat({_note('floor(value)')}, CASE event_type {quality} END), 'N')")


def key_annotation() -> Column:
    """A ``signup`` event sets the key, from the number in its properties."""
    k = "cast(get_json_object(props, '$.k') AS int)"
    mode = f"CASE WHEN {k} % 2 = 0 THEN ':major' ELSE ':minor' END"
    return F.expr(f"CASE WHEN event_type = 'signup' THEN concat({_note(k)}, {mode}) END")


def event_sequence(spark: SparkSession, sf_dir: str, *extra: str) -> Ordered:
    """``events`` as one ordered sequence per user."""
    cols = dict.fromkeys((TRACK, "ts", "event_id", *extra))
    return index_sequence(table(spark, sf_dir, "events").select(*cols), (TRACK,), ("ts", "event_id"))


def chord_sequence(spark: SparkSession, sf_dir: str) -> Ordered:
    """``events`` as chord progressions with aligned keys and comparison chords."""
    labels = [chord_label().alias("chord"), key_annotation().alias("key_annotation")]
    seq = event_sequence(spark, sf_dir, "event_type", "value", "props")
    seq = seq.with_df(seq.df.select(TRACK, "pos", "event_id", micros(F.col("ts")).alias("micros"), *labels))
    return with_references(align_keys(parse_labels(seq)))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as track metadata: title, artist and genre by key."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(TRACK), F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"))
