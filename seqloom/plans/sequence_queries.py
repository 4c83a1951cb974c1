"""Queries over single sequences: alignment, distances, series, runs, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import series as S
from seqloom.functions.chords import chord_masks, vocabulary
from seqloom.operators import ordered as O
from seqloom.operators import projection as P
from seqloom.operators.notes import notes
from seqloom.plans import sql_parts as Q
from seqloom.plans.pipeline import series_frame
from seqloom.plans.sql_parts import query
from seqloom.session import table
from seqloom.sources.tables import TABLES, TRACK, chord_label, chord_sequence, event_sequence, metadata

KINDS = ("offset", "profile")


def triple_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tracks contain which three-event pattern, and how often."""
    seq = event_sequence(spark, sf_dir, "event_type")
    seq = O.shifted(seq, {"n1": ("event_type", -1), "n2": ("event_type", -2)})
    return (seq.df.filter(F.col("n2").isNotNull())
            .groupBy(F.concat_ws("_", "event_type", "n1", "n2").alias("pattern"), TRACK)
            .agg(F.count(F.lit(1)).alias("n_occurrences")))


def asof_key_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = chord_sequence(spark, sf_dir)
    return seq.df.select(TRACK, "pos", "chord", "key", "global_key")


def offset_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_frame(spark, sf_dir).select(TRACK, "pos", "chord", "prev_chord", "offset")


def profile_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_frame(spark, sf_dir).select(TRACK, "pos", "chord", "tonic", "profile")


def tps_distance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distance_table(chord_sequence(spark, sf_dir).df)


def chord_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct chord labels with their masks."""
    m = vocabulary(table(spark, sf_dir, "events").select(chord_label().alias("chord")),
                   "chord", chord_masks, "m")
    return m.select("chord", "m.root", "m.root_mask", "m.fifth_mask", "m.chord_mask")


def span_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.spans(series_frame(spark, sf_dir), TRACK, KINDS, TABLES)


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and durations, in ticks, of the events that last at least one tick."""
    s = span_frame(spark, sf_dir)
    return s.select(TRACK, "event_pos", "t0", (F.col("t1") - F.col("t0")).alias("duration"))


def cumulative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets rebuilt as running sums of integer durations (the property number)."""
    seq = event_sequence(spark, sf_dir, "props")
    seq = seq.with_df(seq.df.withColumn("duration", F.get_json_object("props", "$.k").cast("bigint")))
    seq = O.running(seq, {"t_end": ("sum", "duration")})
    return seq.df.select(TRACK, "pos", "duration", (F.col("t_end") - F.col("duration")).alias("t_start"),
                         "t_end")


def tick_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ticks(span_frame(spark, sf_dir)).select(TRACK, "t", "chord", "offset", "profile")


def run_length_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.runs(event_sequence(spark, sf_dir, "event_type"), "event_type")


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sequences there are of each length; one-element sequences are left out."""
    lens = (table(spark, sf_dir, "conversations").groupBy("conv_id")
            .agg(F.count(F.lit(1)).alias("n_items")).filter(F.col("n_items") > 1))
    return lens.groupBy("n_items").agg(F.count(F.lit(1)).alias("n_sequences"))


def bundle_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence labelled with its length, the key of its bundle."""
    conv = table(spark, sf_dir, "conversations").select("conv_id")
    lens = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_items"))
    return lens.filter(F.col("n_items") > 1).select("n_items", "conv_id")


def relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("frequency", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def selection_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressions kept by a selection list: customers of the BUILDING segment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    picked = (table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
              .select(F.col("c_custkey").alias("o_custkey")))
    return orders.join(picked, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with title, artist and genre; missing metadata stay null."""
    tracks = table(spark, sf_dir, "events").select(TRACK).distinct()
    return tracks.join(metadata(spark, sf_dir), TRACK, "left").select(TRACK, "title", "artist", "genre")


def missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries that have no progression."""
    seen = table(spark, sf_dir, "events").select(TRACK)
    return metadata(spark, sf_dir).join(seen, TRACK, "left_anti").select(TRACK, "title")


def annotation_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per assistant turn, sharing the first user turn of its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = (turns.filter(F.col("role") == "user").groupBy("conv_id")
             .agg(F.min_by(F.col("text"), F.col("turn")).alias("key_text")))
    chords = turns.filter(F.col("role") == "assistant")
    return (chords.join(first, "conv_id", "left")
            .select("conv_id", F.col("turn").alias("annotation"),
                    F.length("text").alias("n_chars"), F.md5("key_text").alias("key_digest")))


def note_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords as notes with fixed unit spans."""
    seq = chord_sequence(spark, sf_dir)
    return notes(seq.df.withColumn("t0", F.col("pos")).withColumn("t1", F.col("pos") + 1), TRACK)


def embedding_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding read as a series and resampled to 30 points."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: F.round(x.cast("double"), 6)).alias("ts"))
    return e.select("vec_id", F.transform(S.resample(F.col("ts"), 30), lambda x: F.round(x, 6)).alias("ts"))


def embedding_znorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(
        "embedding", lambda x: F.round(x.cast("double"), 6)).alias("ts"))
    return e.select("vec_id", F.transform(S.znorm(F.col("ts")), lambda x: F.round(x, 6)).alias("ts"))


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained renames, title keys, the text after the last separator, stringified pairs."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_retailprice")
    title_key = F.concat_ws("$", F.col("p_partkey").cast("string"), F.trim("p_name"))
    return p.select(
        "p_partkey", title_key.alias("title_key"),
        F.element_at(F.split(title_key, r"\$"), -1).alias("title"),
        S.rename_all(F.col("p_name"), {"small": "sm", "ring": "rg", " ": "-"}).alias("renamed"),
        S.stringify_map(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"),
                                     F.col("p_size").cast("string"))).alias("params"),
        F.upper(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("label"),
        F.round(F.col("p_retailprice") / 7, 2).alias("score"))


QUERIES = {
    "triple_patterns": triple_patterns,
    "asof_key_fill": asof_key_fill,
    "offset_series": offset_series,
    "profile_series": profile_series,
    "tps_distance_table": tps_distance_table,
    "chord_vocabulary": chord_vocabulary,
    "durations": durations,
    "cumulative_time": cumulative_time,
    "tick_expand": tick_expand,
    "run_length_encode": run_length_encode,
    "length_histogram": length_histogram,
    "bundle_by_length": bundle_by_length,
    "relative_frequency": relative_frequency,
    "selection_semi": selection_semi,
    "metadata_scan": metadata_scan,
    "missing_metadata": missing_metadata,
    "annotation_explode": annotation_explode,
    "note_expand": note_expand,
    "embedding_resample": embedding_resample,
    "embedding_znorm": embedding_znorm,
    "scalar_text": scalar_text,
}

SQL = {
    "triple_patterns": query(Q.MACROS_FREE, """
        SELECT event_type || '_' || n1 || '_' || n2 AS pattern, user_id, count(*) AS n_occurrences
        FROM (SELECT user_id, event_type, lead(event_type, 1) OVER w AS n1, lead(event_type, 2) OVER w AS n2
              FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY pos))
        WHERE n2 IS NOT NULL GROUP BY ALL"""),
    "asof_key_fill": query(Q.CHORDS, "SELECT user_id, pos, chord, key, global_key FROM labelled"),
    "offset_series": query(
        Q.SERIES, 'SELECT user_id, pos, chord, prev_chord, offset_d AS "offset" FROM series'),
    "profile_series": query(
        Q.SERIES, "SELECT user_id, pos, chord, tonic, profile_d AS profile FROM series"),
    "tps_distance_table": query(Q.SERIES, """
        SELECT DISTINCT chord, key, prev_chord, prev_key, offset_d AS distance FROM series"""),
    "chord_vocabulary": query(Q.CHORDS, f"""
        SELECT DISTINCT chord, CAST(cr AS INTEGER) AS root,
          CAST({Q.rot('1', 'cr')} AS INTEGER) AS root_mask,
          CAST({Q.rot('129', 'cr')} AS INTEGER) AS fifth_mask,
          CAST({Q.rot(Q.TONES + '[ck + 1]', 'cr')} AS INTEGER) AS chord_mask
        FROM labelled"""),
    "durations": query(Q.SPANS, "SELECT user_id, event_pos, t0, t1 - t0 AS duration FROM spans"),
    "cumulative_time": query(Q.MACROS_FREE, """
        , d AS (SELECT user_id, pos, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS duration FROM seq),
        c AS (SELECT *, CAST(sum(duration) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS t_end FROM d)
        SELECT user_id, pos, duration, t_end - duration AS t_start, t_end FROM c"""),
    "tick_expand": query(
        Q.SPANS, 'SELECT user_id, t, chord, offset_d AS "offset", profile_d AS profile FROM ticks'),
    "run_length_encode": query(Q.MACROS_FREE, """
        , s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND pos > 0
                          THEN 0 ELSE 1 END AS st
                FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
        r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS BIGINT) AS run FROM s)
        SELECT user_id, run, any_value(event_type) AS event_type, min(pos) AS pos, count(*) AS run_length
        FROM r GROUP BY user_id, run"""),
    "length_histogram": """
        SELECT n_items, count(*) AS n_sequences
        FROM (SELECT conv_id, count(*) AS n_items FROM conversations GROUP BY conv_id)
        WHERE n_items > 1 GROUP BY n_items""",
    "bundle_by_length": """
        SELECT count(*) AS n_items, conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1""",
    "relative_frequency": """
        SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS frequency
        FROM events GROUP BY event_type""",
    "selection_semi": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "metadata_scan": """
        SELECT user_id, p_name AS title, p_brand AS artist, p_type AS genre
        FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN part ON p_partkey = user_id""",
    "missing_metadata": """
        SELECT p_partkey AS user_id, p_name AS title FROM part
        WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = p_partkey)""",
    "annotation_explode": """
        WITH k AS (SELECT conv_id, arg_min(text, turn) AS key_text FROM conversations
                   WHERE role = 'user' GROUP BY conv_id)
        SELECT conv_id, turn AS annotation, CAST(length(text) AS INTEGER) AS n_chars,
               md5(key_text) AS key_digest
        FROM conversations LEFT JOIN k USING (conv_id) WHERE role = 'assistant'""",
    "note_expand": query(Q.CHORDS, """
        SELECT user_id, pos, CAST(60 + cr + s AS INTEGER) AS pitch, 80 AS velocity, 0 AS program,
               pos AS t0, pos + 1 AS t1
        FROM labelled, LATERAL (SELECT unnest(
          [[0,4,7],[0,3,7],[0,4,7,10],[0,3,7,10]][ck + 1]) AS s)"""),
    "embedding_resample": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS ts FROM embeddings)
        SELECT vec_id, list_transform(range(0, 30), lambda i: round(
          ts[CAST(floor(i * (len(ts) - 1) / 29.0) AS BIGINT) + 1]
            * (1 - (i * (len(ts) - 1) % 29) / 29.0)
          + ts[least(CAST(floor(i * (len(ts) - 1) / 29.0) AS BIGINT) + 2, len(ts))]
            * ((i * (len(ts) - 1) % 29) / 29.0), 6)) AS ts
        FROM e""",
    "embedding_znorm": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS ts FROM embeddings),
        m AS (SELECT vec_id, ts, list_avg(ts) AS mu, list_stddev_pop(ts) AS sd FROM e)
        SELECT vec_id, list_transform(ts, lambda x: CASE WHEN sd > 1e-9 THEN round((x - mu) / sd, 6) ELSE 0.0 END) AS ts
        FROM m""",
    "scalar_text": """
        SELECT p_partkey, p_partkey || '$' || trim(p_name) AS title_key, trim(p_name) AS title,
          replace(replace(replace(p_name, 'small', 'sm'), 'ring', 'rg'), ' ', '-') AS renamed,
          '(brand: ' || p_brand || ');(size: ' || p_size || ')' AS params,
          upper(replace(p_brand, '#', ' ')) AS label, round(p_retailprice / 7, 2) AS score
        FROM part""",
}
