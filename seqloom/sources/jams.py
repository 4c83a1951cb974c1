"""Annotation documents (JSON, one per file) as tables."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators.ordered import Ordered, index_sequence
from seqloom.operators.projection import align_keys, parse_labels, with_references
from seqloom.session import ensure_checkpoint_dir, ship_package

OBSERVATION = "struct<time:double,duration:double,value:string,confidence:double>"
SCHEMA = (
    f"annotations array<struct<namespace:string,data:array<{OBSERVATION}>>>, "
    "file_metadata struct<title:string,artist:string,release:string,duration:double>, "
    "sandbox struct<type:string,genre:string,composers:array<string>,performers:array<string>>, "
    "_corrupt_record string")

CHORD_NAMESPACES = ("chord_harte", "chord")  # in order of preference
KEY_NAMESPACE = "key_mode"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``track, title, artists, genre, annotations``.

    The track is the file name without its extension. ``artist`` may be a string or a list.
    Unreadable files keep a row with ``_corrupt_record``.
    """
    ship_package(spark)
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    artist = F.col("file_metadata.artist")
    return raw.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("track"),
        F.trim("file_metadata.title").alias("title"),
        F.when(artist.startswith("["), F.from_json(artist, "array<string>"))
        .otherwise(F.when(artist != "", F.array(artist))).alias("artists"),
        F.nullif(F.col("sandbox.genre"), F.lit("")).alias("genre"), "annotations", "_corrupt_record")


def select_documents(docs: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the tracks listed (one file name per line, extension optional)."""
    ids = selection.select(F.regexp_replace(F.trim("value"), r"\.[^.]*$", "").alias("track"))
    return docs.join(ids, "track", "left_semi")


def _first_annotation(namespace: Column) -> Column:
    return F.get(F.filter("annotations", lambda a: a["namespace"] == namespace), F.lit(0))["data"]


def observations(docs: DataFrame, namespaces: tuple[str, ...]) -> DataFrame:
    """Observations of the first annotation in the preferred namespace that exists."""
    data = F.coalesce(*[_first_annotation(F.lit(n)) for n in namespaces])
    return (docs.select("track", F.posexplode(data).alias("ord", "_o"))
            .select("track", "ord", "_o.time", "_o.duration", "_o.value", "_o.confidence"))


def unwrap_annotations(docs: DataFrame) -> DataFrame:
    """One record per chord annotation of a document, each with its first key annotation."""
    key = _first_annotation(F.lit(KEY_NAMESPACE))
    return (docs.select("track", key.alias("keys"), F.posexplode("annotations").alias("annotation", "_a"))
            .filter(F.col("_a.namespace").isin(*CHORD_NAMESPACES))
            .select(F.concat_ws("_", "track", "annotation").alias("record"), "track", "annotation",
                    F.col("_a.data").alias("chords"), "keys"))


def spans_from_onsets(obs: DataFrame) -> DataFrame:
    """End each observation at the next onset; the last one by its duration.

    Corpora disagree on what ``duration`` means, so only the last observation uses it: as an
    end time if it lies beyond the onset, else as a length.
    """
    w = Window.partitionBy("track").orderBy("time", "ord")
    last_end = F.when(F.col("duration") > F.col("time"), F.col("duration")).otherwise(
        F.col("time") + F.greatest(F.col("duration"), F.lit(1.0)))
    return obs.withColumn("t_end", F.coalesce(F.lead("time").over(w), last_end))


def progressions(docs: DataFrame) -> Ordered:
    """Documents as ordered chord sequences with aligned keys and comparison chords.

    A key starting with a chord applies to it: at equal times keys sort first. ``micros`` is the
    onset of a chord and ``end_micros`` its end (`spans_from_onsets`). Documents are parsed once
    and stored. Unreadable ones are left out, and a warning tells how many there are.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    unread = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in docs.columns else F.lit(False)
    docs = docs.select("track", "annotations", unread.alias("_unread")).checkpoint()
    lost = docs.filter("_unread").count()
    if lost:
        warnings.warn(f"{lost} documents could not be read", stacklevel=2)
    chords = spans_from_onsets(observations(docs, CHORD_NAMESPACES)).select(
        "track", "time", F.lit(1).alias("_kind"), "ord", F.col("value").alias("chord"),
        F.lit(None).cast("string").alias("key_annotation"), "t_end")
    keys = observations(docs, (KEY_NAMESPACE,)).select(
        "track", "time", F.lit(0).alias("_kind"), "ord", F.lit(None).cast("string").alias("chord"),
        F.col("value").alias("key_annotation"), F.lit(None).cast("double").alias("t_end"))
    both = chords.unionByName(keys)
    seq = index_sequence(both, ("track",), ("time", "_kind", "ord"))
    seq = align_keys(parse_labels(seq))
    # back to chords only: number them again without the key rows
    only = seq.df.filter(F.col("_kind") == 1).drop("_kind", "pos")
    again = index_sequence(only, ("track",), ("time", "ord"))
    micros = {n: F.round(F.col(c) * 1_000_000).cast("long") for n, c in (("micros", "time"), ("end_micros", "t_end"))}
    return with_references(again.with_df(again.df.withColumns(micros).drop("t_end")))
