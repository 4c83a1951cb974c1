"""From annotated events to numeric series: key alignment, distances, ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.config import DEFAULT, Config
from seqloom.functions.chords import chord_masks, key_info, tonic_chord, tonic_masks, tps_distance
from seqloom.operators.ordered import Ordered, first_non_null, per_key, running, shifted


def parse_labels(seq: Ordered) -> Ordered:
    """Add the parsed chord (``cm``) and key annotation (``ka``) of every event.

    Labels are parsed per row: a join with their vocabulary would shuffle all events by label, and few
    labels hold most of them.
    """
    return seq.with_df(seq.df.withColumns({"cm": chord_masks("chord"), "ka": key_info("key_annotation")}))


def align_keys(seq: Ordered) -> Ordered:
    """As-of alignment of sparse key annotations with the events of the same track.

    An event takes the latest key at or before it; events before the first key take the first
    one; a track without any key gets ``N``. The global key is the key of the first event.
    """
    seq = running(seq, {"_key": ("last", "ka")})
    seq = per_key(seq, {"gk": first_non_null("ka")})
    return seq.with_df(seq.df.withColumns({
        "km": F.expr("coalesce(_key, gk)"), "key": F.expr("coalesce(_key.label, gk.label, 'N')"),
        "global_key": F.expr("coalesce(gk.label, 'N')")}).drop("_key", "ka"))


def with_references(seq: Ordered) -> Ordered:
    """Add the chord and key each event is compared with, for both kinds of series.

    ``offset`` compares with the previous event, the first one with the tonic of its key;
    ``profile`` compares with the tonic of the global key.
    """
    seq = seq.with_df(seq.df.withColumns({
        "tonic": tonic_chord("gk"), "tm": tonic_masks("gk"), "_here": F.struct("chord", "cm", "key", "km")}))
    seq = shifted(seq, {"_prev": ("_here", 1)})
    return seq.with_df(seq.df.withColumns({
        "prev_chord": F.expr("CASE WHEN pos = 0 THEN tonic ELSE _prev.chord END"),
        "prev_key": F.expr("CASE WHEN pos = 0 THEN global_key ELSE _prev.key END"),
        "pm": F.expr("CASE WHEN pos = 0 THEN tm ELSE _prev.cm END"),
        "pk": F.expr("CASE WHEN pos = 0 THEN gk ELSE _prev.km END")}).drop("_prev", "_here"))


def offset_value() -> Column:
    return tps_distance("cm", "km", "pm", "pk")


def profile_value() -> Column:
    return tps_distance("cm", "km", "tm", "gk")


def series_value(kind: str) -> Column:
    if kind not in ("offset", "profile"):
        raise ValueError(f"unknown series {kind!r}")
    return offset_value() if kind == "offset" else profile_value()


def distance_table(events: DataFrame) -> DataFrame:
    """The distances of the pairs that occur, each pair computed once."""
    names = ["chord", "key", "prev_chord", "prev_key"]
    pairs = events.groupBy(*names).agg(*[F.first(c).alias(c) for c in ("cm", "km", "pm", "pk")])
    return pairs.select(*names, offset_value().alias("distance"))


def quantise(micros: Column, seconds: int) -> Column:
    """Round a time in microseconds half up to whole ticks."""
    width = seconds * 1_000_000
    return F.floor((micros + F.lit(width // 2)) / F.lit(width)).cast("long")


def spans(events: DataFrame, track: str, kinds: tuple[str, ...], cfg: Config = DEFAULT) -> DataFrame:
    """One row per event that lasts at least one tick: ``[t0, t1)`` and its series values.

    Events rounded to the same onset last zero ticks but for the latest of them, so the rows
    are reduced to one per (track, onset) before the next onset is looked up. What is left per
    track is bounded by the time range, however many events a track has. The last event lasts
    until its ``end_micros`` if the events have that column, and one tick at least. Times count
    from the first onset of the track.
    """
    known_end = "end_micros" in events.columns
    carried = ["chord", "key", "pos", *kinds, *(["end_micros"] if known_end else [])]
    latest = (events
              .withColumn("onset", quantise(F.col("micros"), cfg.sample_seconds))
              .groupBy(track, "onset")
              .agg(F.max_by(F.struct(*carried), F.col("pos")).alias("_e")))
    w = Window.partitionBy(track).orderBy("onset")
    origin = F.min("onset").over(Window.partitionBy(track))
    end = F.col("onset") + 1
    if known_end:
        end = F.greatest(end, quantise(F.col("_e.end_micros"), cfg.sample_seconds))
    return (latest
            .withColumn("_next", F.lead("onset").over(w))
            .withColumn("_origin", origin)
            .select(track, F.col("_e.pos").alias("event_pos"), "_e.chord", "_e.key",
                    *[F.col(f"_e.{k}") for k in kinds],
                    (F.col("onset") - F.col("_origin")).alias("t0"),
                    (F.coalesce("_next", end) - F.col("_origin")).alias("t1")))


def ticks(span_rows: DataFrame) -> DataFrame:
    """Repeat every span once per tick it lasts."""
    return (span_rows.filter(F.col("t1") > F.col("t0"))
            .withColumn("t", F.explode(F.sequence(F.col("t0"), F.col("t1") - 1)))
            .drop("t0", "t1"))
