"""Property-graph tables of tracks, segments, chords, patterns and similarity."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.series import pattern_string
from seqloom.session import ensure_checkpoint_dir, parallelism


def dense_ids(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """Global 0-based index by a total order, without a single-partition sort.

    Range partitions are numbered locally; the counts of the partitions before are added. There
    are as many counts as partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cut = (df.repartitionByRange(parallelism(df.sparkSession), *order)
           .withColumn("_chunk", F.spark_partition_id()).checkpoint())
    counts = cut.groupBy("_chunk").count()
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_chunk").orderBy(*order)
    return (cut.withColumn("_rn", F.row_number().over(local)).join(offsets, "_chunk")
            .withColumn(name, F.col("_before") + F.col("_rn") - 1)
            .select(name, *df.columns))


class Graph(NamedTuple):
    """The graph as plain tables; every one is a set (no duplicate rows)."""

    tracks: DataFrame  # track, title, artist, genre
    segments: DataFrame  # track, seg_ord, pattern, uri
    chords: DataFrame  # track, seg_ord, chord_index, chord, key, start, duration
    similar: DataFrame | None  # pattern1, pattern2, value: both directions; None until it is computed


def segment_table(segments: DataFrame, chords: DataFrame) -> DataFrame:
    """Segments with their pattern string and their node name ``track$chord_chord...``."""
    named = (chords.groupBy("track", "seg_ord").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chord_index", "chord"))), lambda x: x["chord"]), "_").alias("_c")))
    return (segments.join(named, ["track", "seg_ord"])
            .select("track", "seg_ord", pattern_string(F.col("ts")).alias("pattern"),
                    F.concat_ws("$", F.col("track").cast("string"), "_c").alias("uri")))


def similarity_table(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Similarity situations between patterns, seen from both ends.

    ``edges(source_track, source_ord, target_track, target_ord, distance)``; an edge is looked
    up by each end with its own equi-join, and segments without a pattern drop out.
    """
    s = segments.select(F.col("track").alias("source_track"), F.col("seg_ord").alias("source_ord"),
                        F.col("pattern").alias("pattern1"))
    t = segments.select(F.col("track").alias("target_track"), F.col("seg_ord").alias("target_ord"),
                        F.col("pattern").alias("pattern2"))
    one = (edges.join(s, ["source_track", "source_ord"]).join(t, ["target_track", "target_ord"])
           .select("pattern1", "pattern2", F.col("distance").alias("value")))
    # unfolded from one row: a union of both directions would find the edges twice
    other = F.struct(F.col("pattern2").alias("pattern1"), F.col("pattern1").alias("pattern2"), "value")
    return one.select(F.inline(F.array(F.struct("pattern1", "pattern2", "value"), other))).distinct()


def next_segments(g: Graph) -> DataFrame:
    """Temporal links: each segment and its successor in the track."""
    w = Window.partitionBy("track").orderBy("seg_ord")
    return (g.segments.select("track", "seg_ord", "uri", F.lead("seg_ord").over(w).alias("next_ord"),
                              F.lead("uri").over(w).alias("next_uri"))
            .filter(F.col("next_ord").isNotNull()))


def _of(g: Graph, **equal: str) -> DataFrame:
    """Tracks whose attributes have the given values."""
    t = g.tracks
    for name, value in equal.items():
        t = t.filter(F.col(name) == value)
    return t


def top_pattern(g: Graph) -> DataFrame:
    """The pattern found in the most tracks (one row)."""
    return (g.segments.groupBy("pattern").agg(F.count_distinct("track").alias("_n"))
            .orderBy(F.desc("_n"), "pattern").limit(1).select("pattern"))


def tracks_of_pattern(g: Graph, pattern: DataFrame, limit: int = 30) -> DataFrame:
    """Artist, genre and title of the tracks in which the given patterns occur."""
    return (g.segments.join(pattern, "pattern", "left_semi").select("track").distinct()
            .join(g.tracks, "track").select("artist", "genre", "title").distinct()
            .orderBy("artist", "genre", "title").limit(limit))


def frequent_patterns(g: Graph, genre: str, limit: int = 30) -> DataFrame:
    """The patterns found in the most tracks of a genre."""
    return (g.segments.join(_of(g, genre=genre).select("track"), "track", "left_semi")
            .groupBy("pattern").agg(F.count_distinct("track").alias("pattern_count"))
            .orderBy(F.desc("pattern_count"), "pattern").limit(limit))


def patterns_in_both(g: Graph, artist: str, genre: str, limit: int = 30) -> DataFrame:
    """Patterns of an artist that also occur in a genre."""
    mine = g.segments.join(_of(g, artist=artist), "track", "left_semi").select("pattern").distinct()
    theirs = g.segments.join(_of(g, genre=genre).filter(F.col("artist") != artist), "track", "left_semi")
    return (mine.join(theirs.select("pattern"), "pattern", "left_semi").orderBy("pattern").limit(limit))


def patterns_only_in(g: Graph, title: str, not_title: str, chord: str, limit: int = 30) -> DataFrame:
    """Patterns of one title, absent from another, in a segment with a given chord."""
    mine = (g.segments.join(_of(g, title=title), "track", "left_semi")
            .join(g.chords.filter(F.col("chord") == chord), ["track", "seg_ord"], "left_semi"))
    other = g.segments.join(_of(g, title=not_title), "track", "left_semi")
    return (mine.select("pattern").distinct().join(other.select("pattern"), "pattern", "left_anti")
            .orderBy("pattern").limit(limit))


def segments_with_chords(g: Graph, chords: tuple[str, ...]) -> DataFrame:
    """Segments that contain the given chords one after the other."""
    w = Window.partitionBy("track", "seg_ord").orderBy("chord_index")
    c = g.chords.select("track", "seg_ord", "chord", *[
        F.lead("chord", i).over(w).alias(f"_c{i}") for i in range(1, len(chords))])
    match = F.col("chord") == chords[0]
    for i in range(1, len(chords)):
        match = match & (F.col(f"_c{i}") == chords[i])
    return c.filter(match).select("track", "seg_ord").distinct()


def variations(g: Graph, chords: tuple[str, ...], limit: int = 30) -> DataFrame:
    """Segments of other tracks with the pattern of a segment that contains the chords."""
    found = g.segments.join(segments_with_chords(g, chords), ["track", "seg_ord"], "left_semi")
    # a related segment qualifies if some match with its pattern lies in another track
    per = found.groupBy("pattern").agg(F.min("track").alias("_lo"), F.max("track").alias("_hi"))
    return (g.segments.join(per, "pattern")
            .filter((F.col("track") != F.col("_lo")) | (F.col("track") != F.col("_hi")))
            .join(g.tracks, "track").select("title", "track", "seg_ord").distinct()
            .orderBy("title", "track", "seg_ord").limit(limit))


def most_similar(g: Graph, chords: tuple[str, ...], limit: int = 30) -> DataFrame:
    """Segments similar to those that contain the chords, the closest first."""
    found = g.segments.join(segments_with_chords(g, chords), ["track", "seg_ord"], "left_semi")
    near = (found.select(F.col("pattern").alias("pattern1")).distinct().join(g.similar, "pattern1")
            .filter(F.col("pattern1") != F.col("pattern2"))
            .groupBy(F.col("pattern2").alias("pattern")).agg(F.min("value").alias("value")))
    return (g.segments.join(near, "pattern").join(g.tracks, "track")
            .select("title", "track", "seg_ord", "value")
            .orderBy("value", "title", "track", "seg_ord").limit(limit))


def composed_progression(g: Graph, title: str, genre: str, artist: str) -> DataFrame:
    """Three segments: the start of a title, one of a genre, one of an artist.

    Each hop goes to the next segment of the track and from there to a similar pattern. The
    intermediate results are sets of (first, current pattern), so they do not multiply.
    """
    seg = g.segments.select("track", "seg_ord", "pattern")
    sim = g.similar.filter(F.col("pattern1") != F.col("pattern2")).select("pattern1", "pattern2").distinct()
    w = Window.partitionBy("track").orderBy("seg_ord")
    step = seg.withColumn("next_pattern", F.lead("pattern").over(w)).filter(F.col("next_pattern").isNotNull())
    one = (step.filter(F.col("seg_ord") == 0).join(_of(g, title=title), "track", "left_semi")
           .select(F.col("track").alias("track1"), F.col("pattern").alias("start"),
                   F.col("next_pattern").alias("pattern1")))
    two = (one.join(sim, "pattern1").filter(F.col("pattern2") != F.col("start"))
           .select("track1", F.col("pattern2").alias("pattern")).distinct()
           .join(step.join(_of(g, genre=genre), "track", "left_semi"), "pattern")
           .filter(F.col("next_pattern") != F.col("pattern"))
           .select("track1", F.col("track").alias("track2"), F.col("seg_ord").alias("ord2"),
                   F.col("next_pattern").alias("pattern1")))
    third = seg.join(_of(g, artist=artist), "track", "left_semi").select(
        F.col("track").alias("track3"), F.col("seg_ord").alias("ord3"), F.col("pattern").alias("pattern2"))
    return (two.join(sim, "pattern1").join(third, "pattern2")
            .select("track1", "track2", "ord2", "track3", "ord3").distinct())


def close_tracks(g: Graph, title: str, below: float, same_order: bool, limit: int = 30) -> DataFrame:
    """Tracks with a pattern closer than ``below`` to one of the title's, optionally at the
    same place in the track."""
    place = ["seg_ord"] if same_order else []
    mine = (g.segments.join(_of(g, title=title), "track", "left_semi")
            .select(F.col("track").alias("track1"), F.col("pattern").alias("pattern1"), *place).distinct())
    theirs = g.segments.select(F.col("track").alias("track2"), F.col("pattern").alias("pattern2"), *place).distinct()
    near = g.similar.filter((F.col("value") < below) & (F.col("pattern1") != F.col("pattern2")))
    return (mine.join(near, "pattern1").join(theirs, ["pattern2", *place])
            .filter(F.col("track1") != F.col("track2"))
            .select("track1", "track2", "pattern1", "pattern2", "value").distinct()
            .orderBy("value", "track1", "track2", "pattern1", "pattern2").limit(limit))


def traverse(g: Graph, title: str, hops: int = 2) -> DataFrame:
    """Segments reachable from the first segments of a title over temporal and similarity
    links, with the least number of hops. Each level holds every segment at most once."""
    seg = g.segments.select("track", "seg_ord", "pattern")
    w = Window.partitionBy("track").orderBy("seg_ord")
    nxt = seg.select("track", "seg_ord", F.lead("seg_ord").over(w).alias("n_ord"))
    sim = g.similar.select("pattern1", "pattern2").distinct()
    level = (seg.filter(F.col("seg_ord") == 0).join(_of(g, title=title), "track", "left_semi")
             .select("track", "seg_ord").withColumn("hops", F.lit(0)))
    ensure_checkpoint_dir(seg.sparkSession)
    seen = level = level.checkpoint()
    for hop in range(1, hops + 1):
        temporal = (level.join(nxt, ["track", "seg_ord"]).filter(F.col("n_ord").isNotNull())
                    .select("track", F.col("n_ord").alias("seg_ord")))
        patterns = (level.join(seg, ["track", "seg_ord"]).select(F.col("pattern").alias("pattern1")).distinct()
                    .join(sim, "pattern1").select(F.col("pattern2").alias("pattern")).distinct())
        similar = seg.join(patterns, "pattern", "left_semi").select("track", "seg_ord")
        level = (temporal.unionByName(similar).distinct().join(seen, ["track", "seg_ord"], "left_anti")
                 .withColumn("hops", F.lit(hop)).checkpoint())
        seen = seen.unionByName(level)
    return seen


def shortest_chains(g: Graph, title: str, hops: int = 3) -> DataFrame:
    """New progressions: for every segment that `traverse` reaches one shortest chain of segments with its links.

    (track, seg_ord, hops, chain, links): ``chain`` goes from a first segment of the title to the segment, ``links``
    names its steps, ``next`` or ``similar``. Of several chains of the least length, each segment keeps the
    predecessor with the lowest (track, seg_ord), and ``next`` before ``similar``.
    """
    seg = g.segments.select("track", "seg_ord", "pattern")
    w = Window.partitionBy("track").orderBy("seg_ord")
    nxt = seg.select("track", "seg_ord", F.lead("seg_ord").over(w).alias("n_ord"))
    sim = g.similar.select("pattern1", "pattern2").distinct()
    here = F.struct("track", "seg_ord")
    level = (seg.filter(F.col("seg_ord") == 0).join(_of(g, title=title), "track", "left_semi")
             .select("track", "seg_ord", F.lit(0).alias("hops"), F.array(here).alias("chain"),
                     F.array().cast("array<string>").alias("links")))
    ensure_checkpoint_dir(seg.sparkSession)
    seen = level = level.checkpoint()
    for hop in range(1, hops + 1):
        step = lambda kind: F.struct(F.col("prev.track").alias("track"), F.col("prev.seg_ord").alias("seg_ord"),
                                     F.lit(kind).alias("link")).alias("prev")
        temporal = (level.join(nxt, ["track", "seg_ord"]).filter(F.col("n_ord").isNotNull()).withColumn("prev", here)
                    .select("track", F.col("n_ord").alias("seg_ord"), step("next")))
        # the lowest predecessor of a pattern is found before its segments are joined, so hot patterns add no rows
        by_pattern = (level.join(seg, ["track", "seg_ord"]).groupBy(F.col("pattern").alias("pattern1"))
                      .agg(F.min(here).alias("prev")).join(sim, "pattern1")
                      .groupBy(F.col("pattern2").alias("pattern")).agg(F.min("prev").alias("prev")))
        similar = seg.join(by_pattern, "pattern").select("track", "seg_ord", step("similar"))
        found = (temporal.unionByName(similar).groupBy("track", "seg_ord").agg(F.min("prev").alias("prev"))
                 .join(seen, ["track", "seg_ord"], "left_anti"))
        before = level.select(F.col("track").alias("_t"), F.col("seg_ord").alias("_o"), F.col("chain").alias("_c"),
                              F.col("links").alias("_l"))
        level = (found.join(before, (F.col("prev.track") == F.col("_t")) & (F.col("prev.seg_ord") == F.col("_o")))
                 .select("track", "seg_ord", F.lit(hop).alias("hops"), F.array_append("_c", here).alias("chain"),
                         F.array_append("_l", F.col("prev.link")).alias("links")).checkpoint())
        seen = seen.unionByName(level)
    return seen


BASE = "urn:seqloom:"


# The names of classes and properties in the export below.
def triples(g: Graph) -> DataFrame:
    """The graph as a set of (s, p, o, dtype) rows.

    Each table is read once and unfolds its triples from an array. Node names follow the set
    semantics of a graph: segments of a track with equal chords are one node, and so are equal
    chords at the same place of different segments.
    """
    def row(s, p: str, o, dtype: str):
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(dtype).alias("dtype"))

    def unfold(df: DataFrame, rows: list) -> DataFrame:
        return (df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter(F.col("o").isNotNull()))

    track = F.concat(F.lit(BASE + "track/"), F.col("track").cast("string"))
    seg = F.concat(F.lit(BASE + "segment/"), F.col("uri"))
    pat = F.concat(F.lit(BASE + "pattern/"), F.col("pattern"))
    of_tracks = unfold(g.tracks, [
        row(track, "type", F.lit("MusicalWork"), "uri"), row(track, "hasTitle", F.col("title"), "string"),
        row(track, "hasArtist", F.col("artist"), "string"), row(track, "hasGenre", F.col("genre"), "string")])
    of_segments = unfold(g.segments, [
        row(seg, "type", F.lit("Segment"), "uri"), row(seg, "belongsToMusicalWork", track, "uri"),
        row(seg, "hasOrder", F.col("seg_ord"), "integer"), row(track, "containsSegment", seg, "uri"),
        row(track, "containsSegmentPattern", pat, "uri"), row(pat, "type", F.lit("SegmentPattern"), "uri"),
        row(pat, "refersToSegment", seg, "uri"), row(pat, "hasPatternString", F.col("pattern"), "string"),
        row(pat, "label", F.col("pattern"), "string"), row(seg, "hasSegmentPattern", pat, "uri")])
    of_links = unfold(next_segments(g), [
        row(seg, "hasNextSegment", F.concat(F.lit(BASE + "segment/"), F.col("next_uri")), "uri")])
    chord = F.concat(F.lit(BASE + "chord/"), F.col("track").cast("string"), F.lit("$"), F.col("chord"),
                     F.lit("_"), F.col("chord_index").cast("string"))
    named = g.chords.join(g.segments.select("track", "seg_ord", "uri"), ["track", "seg_ord"])
    of_chords = unfold(named, [
        row(seg, "containsChordAnnotation", chord, "uri"), row(chord, "type", F.lit("ChordAnnotation"), "uri"),
        row(chord, "hasDuration", F.col("duration"), "float"), row(chord, "hasStartTime", F.col("start"), "float"),
        row(chord, "hasChord", F.col("chord"), "string"), row(chord, "hasIndex", F.col("chord_index"), "integer"),
        row(chord, "hasKey", F.col("key"), "string")])
    node = F.concat(F.lit(BASE + "similarity/"), F.col("pattern1"), F.lit("&"), F.col("pattern2"))
    end1 = F.concat(F.lit(BASE + "pattern/"), F.col("pattern1"))
    end2 = F.concat(F.lit(BASE + "pattern/"), F.col("pattern2"))
    of_similar = unfold(g.similar, [
        row(end1, "isInvolvedInSimilarity", node, "uri"),
        row(node, "type", F.lit("SegmentPatternSimilarity"), "uri"),
        row(node, "hasSimilarityValue", F.format_string("%.2f", "value"), "float"),
        row(node, "involvesSegmentPattern", end1, "uri"), row(node, "involvesSegmentPattern", end2, "uri")])
    out = of_tracks
    for part in (of_segments, of_links, of_chords, of_similar):
        out = out.unionByName(part)
    return out.distinct()
