"""The stages of the pipeline as DataFrames, from events to similarity edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.config import Config
from seqloom.operators import projection as P
from seqloom.operators import segmentation as G
from seqloom.operators.similarity import similarity_edges
from seqloom.session import ensure_checkpoint_dir
from seqloom.sources.tables import TABLES, TRACK, chord_sequence


def series_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with both series values."""
    return (chord_sequence(spark, sf_dir).df
            .withColumn("offset", P.offset_value()).withColumn("profile", P.profile_value()))


def tick_frame(spark: SparkSession, sf_dir: str, cfg: Config = TABLES) -> DataFrame:
    """One row per tick with the configured series as ``v``."""
    seq = chord_sequence(spark, sf_dir)
    events = seq.df.withColumn("v", P.series_value(cfg.series))
    return P.ticks(P.spans(events, TRACK, ("v",), cfg))


def numbered_ticks(spark: SparkSession, sf_dir: str, cfg: Config = TABLES) -> DataFrame:
    return G.novelty_split(tick_frame(spark, sf_dir, cfg), TRACK, "v", cfg)


def segment_frame(spark: SparkSession, sf_dir: str, cfg: Config = TABLES) -> DataFrame:
    return G.segments(numbered_ticks(spark, sf_dir, cfg), TRACK, "v")


def stored(df: DataFrame) -> DataFrame:
    """Keep a stage that several branches read; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def with_id(segments: DataFrame) -> DataFrame:
    return segments.withColumn("id", F.struct(TRACK, "seg_ord"))


def edge_frame(segments: DataFrame, cfg: Config = TABLES) -> DataFrame:
    """Similarity edges with their ends as (track, ordinal) columns."""
    e = similarity_edges(with_id(segments).select("id", "ts"), cfg)
    return e.select(F.col(f"source.{TRACK}").alias("source_track"), F.col("source.seg_ord").alias("source_ord"),
                    F.col(f"target.{TRACK}").alias("target_track"), F.col("target.seg_ord").alias("target_ord"),
                    "distance", "type")
