"""Queries over segmentations and the similarity of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.config import DEFAULT
from seqloom.functions import checks
from seqloom.functions import series as S
from seqloom.operators import segmentation as G
from seqloom.operators.evaluation import similarity_statistics as relation_statistics
from seqloom.operators.graph import dense_ids
from seqloom.operators.progressions import concat_chords, concat_series
from seqloom.operators.regimes import arc_curve as regime_curve
from seqloom.operators.regimes import matrix_profile
from seqloom.operators.similarity import find_similar, find_similar_fromidx, pair_distances
from seqloom.plans import pipeline as L
from seqloom.plans import sql_parts as Q
from seqloom.plans.sql_parts import query, recursive
from seqloom.session import table
from seqloom.sources import store
from seqloom.sources.tables import TABLES, TRACK, chord_sequence, event_sequence, metadata


def novelty_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The novelty curve with its smoothed form, threshold and peaks."""
    curve = G.peaks(G.novelty(L.tick_frame(spark, sf_dir), TRACK, "v"), TRACK)
    return curve.select(TRACK, "t", "novelty", "smooth", "threshold", "is_peak")


def novelty_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.segment_frame(spark, sf_dir)
    return s.select(TRACK, "seg_ord", "t0", "t1", S.pattern_string(F.col("ts")).alias("pattern"))


def _baseline(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = G.segment_by(method, L.tick_frame(spark, sf_dir), TRACK, "v")
        return s.select("params", TRACK, "seg_ord", "t0", "t1", S.pattern_string(F.col("ts")).alias("pattern"))
    return run


def fluss_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.fluss_split(L.tick_frame(spark, sf_dir), TRACK, "v")
    return f.select(G.paramset("fluss", n_regions=F.col("n_regions"), m=F.lit(DEFAULT.fluss_m)).alias("params"),
                    TRACK, "starts", "n_ticks")


def arc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected arc curve of every track, with the neighbour of each subsequence."""
    profile = L.stored(matrix_profile(L.tick_frame(spark, sf_dir), TRACK, "v", DEFAULT.fluss_m))
    curve = regime_curve(profile, TRACK, DEFAULT.fluss_m)
    return (profile.join(curve, [TRACK, "t"])
            .select(TRACK, "t", "nn", F.round("d2", 6).alias("d2"), "crossing", F.round("cac", 9).alias("cac")))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as ticks; a small error has no reading, so some users cannot be segmented."""
    seq = event_sequence(spark, sf_dir, "event_type", "value")
    lost = (F.col("event_type") == "error") & (F.col("value") < 2)
    return seq.df.select(TRACK, F.col("pos").alias("t"), F.when(~lost, F.floor("value") % 12).alias("v"))


def grid_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two baselines over the users whose readings are whole."""
    s, _ = G.grid_run(_readings(spark, sf_dir), TRACK, "v", methods=("uniform_split", "quasirandom_split"))
    return s.select("method", "params", TRACK, "seg_ord", "t0", "t1", S.pattern_string(F.col("ts")).alias("pattern"))


def grid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that the same run leaves out, and why."""
    return G.grid_run(_readings(spark, sf_dir), TRACK, "v", methods=("uniform_split",))[1]


def split_at_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit split times, unsorted and repeated: the quarters of every track."""
    ticks = L.tick_frame(spark, sf_dir)
    n = F.max("t").over(Window.partitionBy(TRACK)) + 1
    quarters = F.array(F.floor(n / 2), F.floor(n / 4), F.floor(n * 3 / 4), F.floor(n / 2))
    cut = G.segments(G.split_at(ticks, TRACK, quarters), TRACK, "v")
    return cut.select(TRACK, "seg_ord", "t0", "t1", S.pattern_string(F.col("ts")).alias("pattern"))


def resampled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.segment_frame(spark, sf_dir)
    x = S.resample(F.col("ts"), DEFAULT.resampling_size)
    return (s.withColumn("x", x).withColumn("class", S.run_collapse(F.col("x")))
            .select(TRACK, "seg_ord", F.transform("x", lambda v: F.round(v, 6)).alias("x"),
                    F.transform("class", lambda v: F.round(v, 6)).alias("class")))


def structure_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment counts and durations, overall and averaged per track."""
    s = L.segment_frame(spark, sf_dir).select(TRACK, (F.col("t1") - F.col("t0")).alias("dur"))
    over = s.agg(F.count(F.lit(1)).alias("glob_num_structures"), F.round(F.avg("dur"), 6).alias("glob_dur_mu"),
                 F.round(F.stddev_pop("dur"), 6).alias("glob_dur_std"))
    per = s.groupBy(TRACK).agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("d"))
    each = per.agg(
        F.round(F.avg("n"), 6).alias("num_structures_php_mu"),
        F.round(F.stddev_pop("n"), 6).alias("num_structures_php_std"),
        F.round(F.avg(F.col("d") / F.col("n")), 6).alias("dur_structures_php_mu"),
        F.round(F.stddev_pop(F.col("d") / F.col("n")), 6).alias("dur_structures_php_std"))
    # both sides are global aggregates of exactly one row
    return over.withColumn("_k", F.lit(1)).join(each.withColumn("_k", F.lit(1)), "_k").drop("_k")


def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edge_frame(L.segment_frame(spark, sf_dir))


def similarity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of relations and of pattern kinds, and mean distances."""
    segs = L.stored(L.segment_frame(spark, sf_dir))
    edges = L.stored(L.edge_frame(segs))
    ids = segs.select(F.struct(TRACK, "seg_ord").alias("id"))
    return relation_statistics(edges.select(F.struct(F.col("source_track").alias(TRACK), F.col("source_ord").alias("seg_ord")).alias("source"),
                              F.struct(F.col("target_track").alias(TRACK), F.col("target_ord").alias("seg_ord")).alias("target"),
                              "distance", "type"), ids)


def pattern_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pattern index of every segment, in (track, ordinal) order."""
    s = L.stored(L.segment_frame(spark, sf_dir).select(TRACK, "seg_ord"))
    return dense_ids(s, (TRACK, "seg_ord"), "pattern_id")


def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment with the next one of its track: a linear number of pairs."""
    s = L.segment_frame(spark, sf_dir)
    w = Window.partitionBy(TRACK).orderBy("seg_ord")
    return (s.select(TRACK, "seg_ord", F.col("ts").alias("a"), F.lead("ts").over(w).alias("b"))
            .filter(F.col("b").isNotNull()))


def _next_distance(metric: str, constraint: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pair_distances(adjacent_pairs(spark, sf_dir), metric, constraint)
    return run


def min_area_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adjacent_pairs(spark, sf_dir)
    return p.select(TRACK, "seg_ord", F.round(S.min_area(F.col("a"), F.col("b")), 6).alias("distance"))


def _artist_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The numbered ticks, and the segments of every artist."""
    numbered = L.stored(L.numbered_ticks(spark, sf_dir))
    segs = (numbered.groupBy(TRACK, "seg_ord").agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("t1"))
            .join(metadata(spark, sf_dir).select(TRACK, "artist"), TRACK))
    return numbered, segs


def progression_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of an artist's tracks stitched into one progression: chords, keys and rebased times."""
    numbered, segs = _artist_parts(spark, sf_dir)
    return concat_chords(segs, G.segment_chords(numbered, TRACK), "artist", TRACK)


def progression_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the same progressions, tick by tick."""
    numbered, segs = _artist_parts(spark, sf_dir)
    return concat_series(segs, numbered.select(TRACK, "seg_ord", "t", "v"), "artist", TRACK, "v")


def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity edges as an edge list by pattern ids would give them back: written to files and read again."""
    segs = L.stored(L.segment_frame(spark, sf_dir))
    path = L.scratch(spark, "edge-list")
    ids = dense_ids(segs.select(TRACK, "seg_ord"), (TRACK, "seg_ord"), "pattern_id")
    store.write_edge_list(L.edge_frame(segs), ids, path, TRACK)
    return store.read_edge_list(spark, path, TRACK)


def segment_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all splitters' segments, of which one set is opened by its name."""
    path = L.scratch(spark, "segment-store")
    ticks = L.stored(L.tick_frame(spark, sf_dir))
    for method in ("novelty", *G.BASELINES):
        found = L.stored(G.segment_by(method, ticks, TRACK, "v"))
        for r in found.select("params").distinct().collect():  # one row per parameter set
            store.write_segment_set(found.where(F.col("params") == r.params), path, method, r.params, "events", TRACK,
                                    TABLES.sample_seconds)
    s = store.open_segments(spark, path, "fluss", f"n_regions%12__m%{DEFAULT.fluss_m}")
    return s.select(TRACK, "seg_ord", "t0", "t1", S.pattern_string(F.col("ts")).alias("pattern"))


def track_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords, set keys and days of every track as arrays; a track has fewer keys than chords."""
    seq = chord_sequence(spark, sf_dir)
    row = F.struct("pos", "chord", "key_annotation", "micros")
    return (seq.df.groupBy(TRACK).agg(F.array_sort(F.collect_list(row)).alias("_r"))
            .select(TRACK, F.transform("_r", lambda r: r["chord"]).alias("chords"),
                    F.filter(F.transform("_r", lambda r: r["key_annotation"]), lambda k: k.isNotNull()).alias("keys"),
                    F.transform("_r", lambda r: F.floor(r["micros"] / F.lit(86_400_000_000))).alias("days")))


def truncated_progressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords and days cut to the number of keys, checked to be of one length, and as one flat list."""
    cut = checks.truncated(track_arrays(spark, sf_dir), "chords", "keys", "days")
    ok = checks.require(cut, {"equal lengths": checks.equal_lengths("chords", "keys", "days"),
                              "days in order": checks.ascending("days")}, TRACK)
    flat = S.flatten(F.array("keys", F.lit(None).cast("array<string>"), "chords"))
    return ok.select(TRACK, F.size("keys").cast("long").alias("n"), F.array_join(flat, ",").alias("flat"),
                     F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"))


def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tracks fail which of the declared checks."""
    return checks.report(track_arrays(spark, sf_dir), {
        "equal lengths": checks.equal_lengths("chords", "keys", "days"),
        "has a key": F.size("keys") > 0,
        "begins with a chord": F.get("chords", F.lit(0)) != "N",
        "days in order": checks.ascending("days")}, TRACK)


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("ts"))


def find_similar_series(metric: str):
    """The nearest embeddings to a given series, here a saw-tooth."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        saw = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 8 - F.lit(3.5)) / F.lit(20.0))
        return find_similar(saw, embedding_series(spark, sf_dir), DEFAULT.num_searches, DEFAULT.dist_threshold, metric)
    return run


def find_similar_to_member(metric: str):
    """The nearest embeddings to one of them."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return find_similar_fromidx(0, embedding_series(spark, sf_dir), DEFAULT.num_searches, DEFAULT.dist_threshold, metric)
    return run


QUERIES = {
    "novelty_curve": novelty_curve,
    "novelty_segments": novelty_segments,
    "uniform_split": _baseline("uniform_split"),
    "random_split": _baseline("random_split"),
    "quasirandom_split": _baseline("quasirandom_split"),
    "fluss_split": fluss_split,
    "fluss_segments": _baseline("fluss"),
    "arc_curve": arc_curve,
    "grid_run": grid_run,
    "grid_report": grid_report,
    "split_at_times": split_at_quarters,
    "resampled_segments": resampled_segments,
    "structure_statistics": structure_statistics,
    "similarity_edges": similarity_edges,
    "similarity_statistics": similarity_statistics,
    "pattern_ids": pattern_ids,
    "dtw_next": _next_distance("dtw"),
    "dtw_sakoe_chiba_next": _next_distance("dtw", "sakoe_chiba"),
    "dtw_itakura_next": _next_distance("dtw", "itakura"),
    "lcss_next": _next_distance("lcss"),
    "softdtw_next": _next_distance("softdtw"),
    "ctw_next": _next_distance("ctw"),
    "min_area_next": min_area_next,
    "progression_concat": progression_concat,
    "progression_series": progression_series,
    "edge_list_round_trip": edge_list_round_trip,
    "segment_store": segment_store,
    "truncated_progressions": truncated_progressions,
    "check_report": check_report,
    "find_similar": find_similar_series("dtw"),
    "find_similar_fromidx": find_similar_to_member("dtw"),
    "find_similar_euclidean": find_similar_series("euclidean"),
    "find_similar_fromidx_euclidean": find_similar_to_member("euclidean"),
    "lcss_sakoe_chiba_next": _next_distance("lcss", "sakoe_chiba"),
    "lcss_itakura_next": _next_distance("lcss", "itakura"),
}


BOUNDS = {
    "uniform_split": "list_transform(range(1, k), lambda r: CAST(ceil(r * n / CAST(k AS DOUBLE)) AS BIGINT))",
    "random_split": """list_transform(range(1, k), lambda r:
          CAST('0x' || substr(md5('0:' || user_id || ':' || r), 1, 8) AS BIGINT) % n)""",
    "quasirandom_split": """list_transform(range(1, k), lambda r: CAST(floor(
          (r * 0.6180339887498949::DOUBLE - floor(r * 0.6180339887498949::DOUBLE)) * n) AS BIGINT))""",
}


def _split_sql(bounds: str) -> str:
    return query(Q.SPANS, f"""
        , len AS (SELECT user_id, max(t) + 1 AS n FROM ticks GROUP BY user_id),
        b AS (SELECT user_id, k, n, list_distinct(list_filter({bounds}, lambda x: x > 0 AND x < n)) AS b
              FROM len, (SELECT unnest([10,11,12,13,14]) AS k)),
        g AS (SELECT ticks.user_id, k, t, profile_d,
                     CAST(len(list_filter(b.b, lambda x: x <= t)) AS BIGINT) AS seg_ord
              FROM ticks JOIN b USING (user_id))
        SELECT 'n_regions%' || k AS params, user_id, seg_ord, min(t) AS t0, max(t) + 1 AS t1,
               string_agg(profile_d, '_' ORDER BY t) AS pattern
        FROM g GROUP BY k, user_id, seg_ord""")


# matrix profile, arc curve and its deepest minima for m = 3: sums of whole numbers, one root per pair
FLUSS = Q.SPANS + """,
wn AS MATERIALIZED (
  SELECT user_id, t, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c,
         3.0 * (a * a + b * b + c * c) - (a + b + c) * (a + b + c) AS var
  FROM (SELECT user_id, t, profile_d AS a, lead(profile_d) OVER w AS b, lead(profile_d, 2) OVER w AS c
        FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE c IS NOT NULL),
ds AS (SELECT p.user_id, p.t, q.t AS nn,
              round(CASE WHEN p.var = 0 AND q.var = 0 THEN 0 WHEN p.var = 0 OR q.var = 0 THEN 3
                    ELSE 6 * (1 - (3.0 * (p.a * q.a + p.b * q.b + p.c * q.c) - (p.a + p.b + p.c) * (q.a + q.b + q.c))
                              / sqrt(p.var * q.var)) END, 9) AS d2
       FROM wn p JOIN wn q ON q.user_id = p.user_id AND abs(p.t - q.t) > 1),
mp AS MATERIALIZED (SELECT user_id, t, m.nn AS nn, m.d2 AS d2 FROM (
        SELECT wn.user_id, wn.t, min(struct_pack(d2 := d2, nn := nn)) AS m FROM wn LEFT JOIN ds
          ON ds.user_id = wn.user_id AND ds.t = wn.t GROUP BY ALL)),
st AS (SELECT user_id, t, 0 AS s FROM mp UNION ALL SELECT user_id, least(t, nn), 1 FROM mp WHERE nn IS NOT NULL
       UNION ALL SELECT user_id, greatest(t, nn), -1 FROM mp WHERE nn IS NOT NULL),
cr AS (SELECT user_id, t, CAST(sum(sum(s)) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS crossing,
              max(t) OVER (PARTITION BY user_id) + 1 AS n FROM st GROUP BY user_id, t),
cac AS MATERIALIZED (
  SELECT user_id, t, crossing, CASE WHEN t < 15 OR t >= n - 15 OR t = 0 THEN 1.0 ELSE
         least(crossing / (CAST(2 AS DOUBLE) * t * (n - t) / n), 1.0) END AS cac FROM cr)
"""
PICKS = """,
pk(user_id, k, picks) AS (
  SELECT DISTINCT user_id, 0, CAST([] AS BIGINT[]) FROM ticks
  UNION ALL
  SELECT pk.user_id, k + 1, list_append(any_value(picks), min(struct_pack(c := cac, t := t)).t)
  FROM pk JOIN cac ON cac.user_id = pk.user_id
  WHERE cac.cac < 1 AND k < 13 AND len(list_filter(picks, lambda q: abs(q - t) <= 15)) = 0 GROUP BY pk.user_id, k),
fl AS (
  SELECT n.user_id, r, n_ticks, list_sort(list_prepend(CAST(0 AS BIGINT), pk.picks[1:r - 1])) AS starts
  FROM (SELECT user_id, max(t) + 1 AS n_ticks FROM ticks GROUP BY user_id) n
  JOIN (SELECT user_id, max_by(picks, k) AS picks FROM pk GROUP BY user_id) pk USING (user_id),
       (SELECT unnest([10, 11, 12, 13, 14]) AS r))
"""

# pairs of consecutive segments, and the recurrence of an elastic distance over them:
# one row per anti-diagonal, the values of the two latest kept as lists over the first index
PAIRS = Q.SEGMENTS + """,
pr AS MATERIALIZED (
  SELECT * FROM (SELECT user_id, seg_ord, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY seg_ord) AS b
                 FROM segments) WHERE b IS NOT NULL),
pn AS MATERIALIZED (SELECT *, len(a) AS n, len(b) AS m FROM pr)
"""
INF = "CAST('inf' AS DOUBLE)"


def _diagonal_sql(cost: str, step: str, edge: str, final: str, inside: str = "true", parts: str = PAIRS,
                  keys: str = "user_id, seg_ord", tail: str | None = None) -> str:
    """``step`` combines ``c`` (cost) with the three predecessors ``dg``, ``up``, ``lf``."""
    def cell(d: str) -> str:
        dg = f"CASE WHEN i = 0 AND {d} - i = 0 THEN CAST(0 AS DOUBLE) ELSE coalesce(p2[i], {edge}) END"
        up = f"coalesce(p1[i], {edge})"
        lf = f"CASE WHEN {d} - i = 0 THEN {edge} ELSE p1[i + 1] END"
        c = cost.replace("$i", "(i + 1)").replace("$j", f"({d} - i + 1)")
        body = (step.replace("$c", f"({c})").replace("$dg", f"({dg})")
                .replace("$up", f"({up})").replace("$lf", f"({lf})"))
        ok = inside.replace("$i", "i").replace("$j", f"({d} - i)")
        return (f"list_transform(range(0, n), lambda i: CASE WHEN {d} - i BETWEEN 0 AND m - 1 "
                f"THEN CASE WHEN {ok} THEN CAST({body} AS DOUBLE) ELSE {edge} END ELSE {edge} END)")
    tail = tail or f"SELECT {keys}, round({final}, 9) AS distance FROM dp WHERE d = n + m - 2"
    return recursive(parts, f"""
        , dp AS (
          SELECT {keys}, a, b, n, m, CAST(-1 AS BIGINT) AS d,
                 list_transform(range(0, n), lambda i: {edge}) AS p1,
                 list_transform(range(0, n), lambda i: {edge}) AS p2 FROM pn
          UNION ALL
          SELECT {keys}, a, b, n, m, d + 1, {cell('(d + 1)')}, p1
          FROM dp WHERE d < n + m - 2)
        {tail}""")


SQUARE = "(a[$i] - b[$j]) * (a[$i] - b[$j])"
BAND = """CASE WHEN n > m THEN $i BETWEEN $j - 5 AND $j + (n - m) + 5
               ELSE $j BETWEEN $i - 5 AND $i + (m - n) + 5 END"""
ITAKURA = """$i >= ceil(greatest(round(n / (3.0 * m) * $j, 2), round(n - 1 - 3.0 * n / m * (m - 1 - $j), 2)))
         AND $i <= floor(least(round(3.0 * n / m * $j, 2), round(n - 1 - n / (3.0 * m) * (m - 1 - $j), 2)))"""
HARD = "$c + least($dg, $up, $lf)"
LOW = "least($dg, $up, $lf)"
SOFT = f"$c + {LOW} - ln(exp({LOW} - $dg) + exp({LOW} - $up) + exp({LOW} - $lf))"

LCSS = ("CASE WHEN abs(a[$i] - b[$j]) <= 1 THEN 1.0 ELSE 0.0 END",
        "CASE WHEN $c = 1 THEN $dg + 1 ELSE greatest($up, $lf) END", "CAST(0 AS DOUBLE)", "1 - p1[n] / least(n, m)")


def _search_sql(query: str, metric: str, besides: str = "true") -> str:
    """The nearest series to ``query``, a one-row relation with the list ``q``."""
    parts = f"""
        e AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS ts
                           FROM embeddings),
        pn AS MATERIALIZED (SELECT id, ts AS a, q AS b, len(ts) AS n, len(q) AS m FROM e, ({query}))"""
    top = f""", top AS (SELECT * FROM r ORDER BY distance, id LIMIT 10)
        SELECT id, round(distance, 6) AS distance FROM top WHERE distance <= 2.0 AND {besides}"""
    if metric == "euclidean":
        return recursive(parts, f", r AS (SELECT id, list_distance(a, b) AS distance FROM pn) {top}")
    return _diagonal_sql(SQUARE, HARD, INF, "", parts=parts, keys="id", tail=f"""
        , r AS (SELECT id, sqrt(p1[n]) AS distance FROM dp WHERE d = n + m - 2) {top}""")


SAW = "SELECT list_transform(range(0, 64), lambda i: (i % 8 - CAST(3.5 AS DOUBLE)) / CAST(20 AS DOUBLE)) AS q"
FIRST = "SELECT ts AS q FROM e WHERE id = 0"

READINGS = Q.MACROS_FREE + """,
rd AS (SELECT user_id, pos AS t, CASE WHEN NOT (event_type = 'error' AND value < 2)
                                      THEN CAST(floor(value) AS BIGINT) % 12 END AS v FROM seq)
"""
STITCHED = Q.SEGMENTS + """,
parts AS (SELECT p_brand AS artist, user_id, seg_ord, t0, row_number() OVER w AS pos,
                 CAST(sum(t1 - t0) OVER w AS BIGINT) - (t1 - t0) AS started
          FROM segments JOIN part ON p_partkey = user_id WINDOW w AS (PARTITION BY p_brand ORDER BY user_id, seg_ord))
"""
ARRAYS = Q.CHORDS + f""",
arrays AS (SELECT user_id, list(chord ORDER BY pos) AS chords, list(micros // 86400000000 ORDER BY pos) AS days,
                  coalesce(list({Q.NAMES}[kk % 12 + 1] || CASE WHEN kk % 2 = 0 THEN ':major' ELSE ':minor' END ORDER BY pos)
                           FILTER (WHERE kk IS NOT NULL), []) AS keys
           FROM labelled GROUP BY user_id)
"""

SQL = {
    "novelty_curve": query(Q.SEGMENTS, """
        SELECT user_id, t, novelty, smooth, threshold, is_peak FROM pk"""),
    "novelty_segments": query(Q.SEGMENTS, """
        SELECT user_id, seg_ord, t0, t1, array_to_string(ts, '_') AS pattern FROM segments"""),
    **{name: _split_sql(bounds) for name, bounds in BOUNDS.items()},
    "arc_curve": query(FLUSS, """
        SELECT user_id, t, nn, round(d2, 6) AS d2, crossing, round(cac, 9) AS cac FROM mp JOIN cac USING (user_id, t)"""),
    "grid_report": query(READINGS, """
        SELECT DISTINCT user_id, 'a value at every tick' AS "check" FROM rd WHERE v IS NULL"""),
    "grid_run": query(READINGS, f"""
        , len AS (SELECT user_id, count(*) AS n FROM rd GROUP BY user_id HAVING count(*) = count(v)),
        bd AS ({" UNION ALL ".join(
            f"SELECT '{m}' AS method, k, user_id, list_distinct(list_filter({BOUNDS[m]}, lambda x: x > 0 AND x < n)) AS b "
            "FROM len, (SELECT unnest([10, 11, 12, 13, 14]) AS k)" for m in ("uniform_split", "quasirandom_split"))}),
        g AS (SELECT method, k, user_id, t, v, CAST(len(list_filter(b, lambda x: x <= t)) AS BIGINT) AS seg_ord
              FROM rd JOIN bd USING (user_id))
        SELECT method, 'n_regions%' || k AS params, user_id, seg_ord, min(t) AS t0, max(t) + 1 AS t1,
               string_agg(v, '_' ORDER BY t) AS pattern FROM g GROUP BY method, k, user_id, seg_ord"""),
    "fluss_split": recursive(FLUSS + PICKS, """
        SELECT 'n_regions%' || r || '__m%3' AS params, user_id, starts, n_ticks FROM fl"""),
    "fluss_segments": recursive(FLUSS + PICKS, """
        , sg AS (SELECT user_id, r, n_ticks, starts, unnest(range(0, len(starts))) AS seg_ord FROM fl),
        se AS (SELECT *, starts[seg_ord + 1] AS t0, coalesce(starts[seg_ord + 2], n_ticks) AS t1 FROM sg)
        SELECT 'n_regions%' || r || '__m%3' AS params, se.user_id, seg_ord, t0, t1,
               string_agg(profile_d, '_' ORDER BY t) AS pattern
        FROM se JOIN ticks ON ticks.user_id = se.user_id AND t >= t0 AND t < t1 GROUP BY ALL"""),
    "split_at_times": query(Q.SPANS, """
        , len AS (SELECT user_id, max(t) + 1 AS n FROM ticks GROUP BY user_id),
        g AS (SELECT user_id, t, profile_d,
                CAST((SELECT count(DISTINCT q) FROM unnest([n // 2, n // 4, n * 3 // 4]) AS u(q)
                      WHERE q > 0 AND q <= t) AS BIGINT) AS seg_ord
              FROM ticks JOIN len USING (user_id))
        SELECT user_id, seg_ord, min(t) AS t0, max(t) + 1 AS t1, string_agg(profile_d, '_' ORDER BY t) AS pattern
        FROM g GROUP BY user_id, seg_ord"""),
    "resampled_segments": query(Q.RESAMPLED, """
        SELECT user_id, seg_ord, list_transform(x, lambda v: round(v, 6)) AS x,
               list_transform(cls, lambda v: round(v, 6)) AS class FROM r1"""),
    "structure_statistics": query(Q.SEGMENTS, """
        , d AS (SELECT user_id, t1 - t0 AS dur FROM segments),
        p AS (SELECT count(*) AS n, avg(dur) AS mu FROM d GROUP BY user_id)
        SELECT (SELECT count(*) FROM d) AS glob_num_structures,
               round((SELECT avg(dur) FROM d), 6) AS glob_dur_mu,
               round((SELECT stddev_pop(dur) FROM d), 6) AS glob_dur_std,
               round(avg(n), 6) AS num_structures_php_mu, round(stddev_pop(n), 6) AS num_structures_php_std,
               round(avg(mu), 6) AS dur_structures_php_mu, round(stddev_pop(mu), 6) AS dur_structures_php_std
        FROM p"""),
    "similarity_edges": recursive(Q.EDGES, "SELECT * FROM edges"),
    "similarity_statistics": recursive(Q.EDGES, """
        , und AS (SELECT source_track AS u, source_ord AS o, target_track AS u2, target_ord AS o2, distance, type FROM edges
                  UNION SELECT target_track, target_ord, source_track, source_ord, distance, type FROM edges),
        per AS (SELECT r1.user_id, r1.seg_ord, count(u) AS neigh,
                       count(u) FILTER (WHERE type = 'same') AS fam, count(u) FILTER (WHERE type = 'sim') AS sim,
                       avg(distance) AS d_all, avg(distance) FILTER (WHERE type = 'sim') AS d_sim
                FROM r1 LEFT JOIN und ON u = user_id AND o = seg_ord GROUP BY ALL)
        SELECT (SELECT count(*) FROM edges WHERE type = 'sim') AS no_simi_rels,
               (SELECT count(*) FROM edges WHERE type = 'same') AS no_same_rels,
               (SELECT round(avg(distance), 6) FROM edges WHERE type = 'sim') AS simi_rel_avg,
               (SELECT round(stddev_pop(distance), 6) FROM edges WHERE type = 'sim') AS simi_rel_std,
               count(*) FILTER (WHERE fam > 0) AS no_pattern_families,
               count(*) FILTER (WHERE fam = 0 AND sim > 0) AS no_pattern_friendly,
               count(*) FILTER (WHERE neigh = 0) AS no_pattern_unique,
               round(avg(neigh), 6) AS pattern_neigh_size_mu, round(avg(fam), 6) AS pattern_family_size_mu,
               round(avg(sim), 6) AS pattern_simila_size_mu,
               round(avg(d_all), 6) AS pattern_avg_distance_all,
               round(avg(d_sim), 6) AS pattern_avg_distance_nosame
        FROM per"""),
    "pattern_ids": query(Q.SEGMENTS, """
        SELECT row_number() OVER (ORDER BY user_id, seg_ord) - 1 AS pattern_id, user_id, seg_ord FROM segments"""),
    "dtw_next": _diagonal_sql(SQUARE, HARD, INF, "sqrt(p1[n])"),
    "dtw_sakoe_chiba_next": _diagonal_sql(SQUARE, HARD, INF, "sqrt(p1[n])", BAND),
    "dtw_itakura_next": _diagonal_sql(SQUARE, HARD, INF, "sqrt(p1[n])", ITAKURA),
    "lcss_next": _diagonal_sql(*LCSS),
    "lcss_sakoe_chiba_next": _diagonal_sql(*LCSS, BAND),
    "lcss_itakura_next": _diagonal_sql(*LCSS, ITAKURA),
    "softdtw_next": _diagonal_sql(SQUARE, SOFT, INF, "p1[n]"),
    "min_area_next": query(PAIRS, """
        , o AS (SELECT *, CASE WHEN n >= m THEN a ELSE b END AS l, CASE WHEN n >= m THEN b ELSE a END AS s FROM pn)
        SELECT user_id, seg_ord, round(list_min(list_transform(range(0, len(l) - len(s) + 1), lambda k:
          list_sum(list_transform(range(1, len(s) + 1), lambda q: abs(l[k + q] - s[q])))))
          / CAST(len(s) AS DOUBLE), 6) AS distance FROM o"""),
    "progression_concat": query(STITCHED, """
        , ch AS (SELECT user_id, seg_ord, min(t) AS start, count(*) AS duration, any_value(chord) AS chord, any_value(key) AS key
                 FROM numbered GROUP BY user_id, seg_ord, event_pos),
        pl AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg_ord ORDER BY start) AS i FROM ch),
        at_ AS (SELECT artist, user_id, seg_ord, chord, key, pos, i, started + start - t0 AS s, duration
                FROM pl JOIN parts USING (user_id, seg_ord)),
        mk AS (SELECT *, CASE WHEN i = 1 AND lag(chord) OVER w = chord AND lag(key) OVER w = key THEN 0 ELSE 1 END AS fresh
               FROM at_ WINDOW w AS (PARTITION BY artist ORDER BY pos, i)),
        rn AS (SELECT *, sum(fresh) OVER (PARTITION BY artist ORDER BY pos, i) - 1 AS run FROM mk)
        SELECT artist, CAST(run AS BIGINT) AS pos, first(chord ORDER BY pos, i) AS chord, first(key ORDER BY pos, i) AS key,
               min(s) AS t_start, CAST(min(s) + sum(duration) AS BIGINT) AS t_end,
               first(user_id ORDER BY pos, i) AS user_id, first(seg_ord ORDER BY pos, i) AS seg_ord
        FROM rn GROUP BY artist, run"""),
    "progression_series": query(STITCHED, """
        SELECT artist, started + t - t0 AS t, v FROM numbered JOIN parts USING (user_id, seg_ord)"""),
    "edge_list_round_trip": recursive(Q.EDGES, "SELECT * FROM edges"),
    "segment_store": recursive(FLUSS + PICKS, """
        , sg AS (SELECT user_id, n_ticks, starts, unnest(range(0, len(starts))) AS seg_ord FROM fl WHERE r = 12),
        se AS (SELECT *, starts[seg_ord + 1] AS t0, coalesce(starts[seg_ord + 2], n_ticks) AS t1 FROM sg)
        SELECT se.user_id, seg_ord, t0, t1, string_agg(profile_d, '_' ORDER BY t) AS pattern
        FROM se JOIN ticks ON ticks.user_id = se.user_id AND t >= t0 AND t < t1 GROUP BY ALL"""),
    "truncated_progressions": query(ARRAYS, """
        SELECT user_id, len(keys) AS n, array_to_string(list_concat(keys, chords[1:len(keys)]), ',') AS flat,
               array_to_string(days[1:len(keys)], ',') AS days FROM arrays"""),
    "check_report": query(ARRAYS, """
        SELECT user_id, 'equal lengths' AS "check" FROM arrays WHERE len(keys) <> len(chords)
        UNION ALL SELECT user_id, 'has a key' FROM arrays WHERE len(keys) = 0
        UNION ALL SELECT user_id, 'begins with a chord' FROM arrays WHERE chords[1] = 'N'"""),
    "find_similar": _search_sql(SAW, "dtw"),
    "find_similar_fromidx": _search_sql(FIRST, "dtw", "id <> 0"),
    "find_similar_euclidean": _search_sql(SAW, "euclidean"),
    "find_similar_fromidx_euclidean": _search_sql(FIRST, "euclidean", "id <> 0"),
}
