"""Segments and edges on disk, so that what one run writes another reads back whole.

A segment store is a folder of parquet files, one sub-folder per method and parameter set, with a manifest of how
each was made. A set is opened by its name and only its folder is read; a segment is looked up by track and ordinal,
by which the files are sorted. An edge list is a CSV file of pattern ids with the map from ids to segments beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("method", "params", "source")]
                        + [T.StructField("tick_seconds", T.LongType())])
EDGE_FILE = "source bigint, target bigint, distance double, type string"
ENDS = ("source_track", "source_ord", "target_track", "target_ord")


def write_segment_set(segments: DataFrame, path: str, method: str, params: str, source: str, track: str,
                      tick_seconds: int) -> None:
    """Add one set of ``segments`` to the store, and a row that says how it was made to its manifest.

    A set of that name must not exist.
    """
    spark = segments.sparkSession
    if _exists(spark, path) and not manifest(spark, path).where(
            (F.col("method") == method) & (F.col("params") == params)).isEmpty():
        raise ValueError(f"the store has segments of {method} {params}")
    (segments.drop("method", "params").repartitionByRange(F.col(track), F.col("seg_ord")).sortWithinPartitions(track, "seg_ord")
     .withColumns({"method": F.lit(method), "params": F.lit(params)})
     .write.mode("append").partitionBy("method", "params").parquet(f"{path}/segments"))
    spark.createDataFrame([(method, params, source, tick_seconds)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        manifest(spark, path)
    except AnalysisException:  # there is no such folder
        return False
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(method, params, source, tick_seconds): the sets of the store."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def open_segments(spark: SparkSession, path: str, method: str, params: str) -> DataFrame:
    """One set by its name; an unknown name is an error that lists the known ones."""
    named = (F.col("method") == method) & (F.col("params") == params)
    if manifest(spark, path).where(named).isEmpty():
        known = [f"{r.method} {r.params}" for r in manifest(spark, path).orderBy("method", "params").limit(20).collect()]
        raise KeyError(f"no segments of {method} {params}; there are {', '.join(known)}")
    return spark.read.parquet(f"{path}/segments").where(named).drop("method", "params")


def segment(spark: SparkSession, path: str, method: str, params: str, track: str, key, ordinal: int) -> DataFrame:
    """One segment of one set: a filter that reaches the sorted files."""
    return open_segments(spark, path, method, params).where((F.col(track) == key) & (F.col("seg_ord") == ordinal))


def write_edge_list(edges: DataFrame, ids: DataFrame, path: str, track: str, mode: str = "errorifexists") -> None:
    """``edges`` (source_track, source_ord, target_track, target_ord, distance, type) by the pattern ids of ``ids``.

    ``ids`` (pattern_id, track, seg_ord) is written beside them, so that the list can be read back.
    """
    end = lambda side: ids.select(F.col("pattern_id").alias(side), F.col(track).alias(f"{side}_track"),
                                  F.col("seg_ord").alias(f"{side}_ord"))
    named = (edges.join(end("source"), ["source_track", "source_ord"], "left")
             .join(end("target"), ["target_track", "target_ord"], "left"))
    known = F.when(F.col("source").isNull() | F.col("target").isNull(), F.raise_error(F.lit("an edge ends at no pattern")).cast("bigint"))
    (named.withColumn("source", F.coalesce(known, "source")).select("source", "target", "distance", "type")
     .write.mode(mode).option("header", True).csv(f"{path}/edges"))
    ids.select("pattern_id", track, "seg_ord").write.mode(mode).parquet(f"{path}/patterns")


def read_edge_list(spark: SparkSession, path: str, track: str) -> DataFrame:
    """The edges of `write_edge_list` with their ends as tracks and ordinals again."""
    ids = spark.read.parquet(f"{path}/patterns")
    end = lambda side: ids.select(F.col("pattern_id").alias(side), F.col(track).alias(f"{side}_track"),
                                  F.col("seg_ord").alias(f"{side}_ord"))
    rows = spark.read.schema(EDGE_FILE).option("header", True).csv(f"{path}/edges")
    return rows.join(end("source"), "source").join(end("target"), "target").select(*ENDS, "distance", "type")
