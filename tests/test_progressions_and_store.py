"""Stitched progressions, chains of segments, declared checks, the segment store and the edge list."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from seqloom.functions import checks
from seqloom.functions.series import flatten
from seqloom.operators import graph as K
from seqloom.operators import ordered
from seqloom.operators.progressions import concat_chords, concat_series
from seqloom.sources import store

SEGS = [("a", "x", 0, 0, 3), ("a", "x", 1, 3, 5), ("a", "y", 0, 0, 2), ("b", "z", 0, 0, 1)]
CHORDS = [("x", 0, 0, "C", "k", 0, 2), ("x", 0, 1, "D", "k", 2, 1), ("x", 1, 0, "D", "k", 3, 1), ("x", 1, 1, "D", "m", 4, 1),
          ("y", 0, 0, "D", "k", 0, 2), ("z", 0, 0, None, None, 0, 1)]


@pytest.mark.parametrize("hot", [4_000_000, 2])
def test_concat(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered.index_sequence, "__defaults__", (hot,))
    segs = spark.createDataFrame(SEGS, "artist string, track string, seg_ord long, t0 long, t1 long")
    chords = spark.createDataFrame(CHORDS, "track string, seg_ord long, chord_index int, chord string, key string, start long, duration long")
    got = concat_chords(segs, chords, "artist", "track").select("artist", "pos", "chord", "key", "t_start", "t_end", "track", "seg_ord")
    assert sorted(map(tuple, got.collect())) == [
        ("a", 0, "C", "k", 0, 2, "x", 0), ("a", 1, "D", "k", 2, 4, "x", 0), ("a", 2, "D", "m", 4, 5, "x", 1),
        ("a", 3, "D", "k", 5, 7, "y", 0), ("b", 0, None, None, 0, 1, "z", 0)]
    ticks = spark.createDataFrame([(t, o, s + i, s + i + 10) for _, t, o, s, e in SEGS for i in range(e - s)],
                                  "track string, seg_ord long, t long, v long")
    series = concat_series(segs, ticks, "artist", "track", "v").where("artist = 'a'").orderBy("t").collect()
    assert [(r.t, r.v) for r in series] == list(enumerate([10, 11, 12, 13, 14, 10, 11]))


def graph_of(spark, seed):
    rnd = random.Random(seed)
    segs = [(f"t{t}", o, f"p{rnd.randrange(14)}", f"u{t}.{o}") for t in range(12) for o in range(rnd.randrange(1, 6))]
    pairs = {(f"p{rnd.randrange(14)}", f"p{rnd.randrange(14)}") for _ in range(9)}
    pairs |= {(b, a) for a, b in pairs}
    tracks = spark.createDataFrame([(f"t{t}", "T" if t in (3, 7) else f"o{t}", "a", "g") for t in range(12)],
                                   "track string, title string, artist string, genre string")
    g = K.Graph(tracks, spark.createDataFrame(segs, "track string, seg_ord long, pattern string, uri string"),
                spark.createDataFrame([], "track string, seg_ord long, chord_index int, chord string, key string, start long, duration long"),
                spark.createDataFrame([(a, b, 0.5) for a, b in pairs] or [("-", "-", 0.0)], "pattern1 string, pattern2 string, value double"))
    return g, segs, pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_chains_against_a_queue(spark, seed):
    g, segs, pairs = graph_of(spark, seed)
    pattern = {(t, o): p for t, o, p, _ in segs}
    def links(x):
        t, o = x
        out = [((t, o + 1), "next")] if (t, o + 1) in pattern else []
        return out + [(y, "similar") for y, p in pattern.items() if (pattern[x], p) in pairs]
    hops = {(t, 0): 0 for t in ("t3", "t7")}
    queue = deque(sorted(hops))
    while queue:
        x = queue.popleft()
        for y, _ in links(x):
            if y not in hops:
                hops[y] = hops[x] + 1
                queue.append(y)
    best = {}
    for y, h in sorted(hops.items(), key=lambda e: e[1]):
        if h:
            x, kind = min((x, kind) for x in hops if hops[x] == h - 1 for z, kind in links(x) if z == y)
            best[y] = (best[x][0] + [y], best[x][1] + [kind])
        else:
            best[y] = ([y], [])
    got = {(r.track, r.seg_ord): r for r in K.shortest_chains(g, "T", 4).collect()}
    assert set(got) == {y for y, h in hops.items() if h <= 4} and len(got) > 8
    for y, r in got.items():
        assert (r.hops, [tuple(c) for c in r.chain], r.links) == (hops[y], *best[y])
    assert {(r.track, r.seg_ord, r.hops) for r in K.traverse(g, "T", 4).collect()} == {(*y, r.hops) for y, r in got.items()}


def test_checks(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [3, 1], ["c", "d"]), (3, None, ["e"]), (4, [5], ["f"])],
                               "id int, x array<int>, y array<string>")
    rules = {"lengths": checks.equal_lengths("x", "y"), "order": checks.ascending("x")}
    assert sorted(map(tuple, checks.report(df, rules, "id").collect())) == [
        (1, "lengths"), (2, "order"), (3, "lengths"), (3, "order")]
    assert [r.id for r in checks.require(df.where("id = 4"), rules, "id").collect()] == [4]
    with pytest.raises(Exception, match="order fails for 2"):
        checks.require(df.where("id in (2, 4)"), rules, "id").collect()
    cut = {r.id: (r.x, r.y) for r in checks.truncated(df, "x", "y").collect()}
    assert cut == {1: ([1, 2], ["a", "b"]), 2: ([3, 1], ["c", "d"]), 3: (None, None), 4: ([5], ["f"])}
    nested = spark.createDataFrame([([[1], None, [], [2, 3]],)], "n array<array<int>>")
    assert nested.select(flatten(F.col("n"))).first()[0] == [1, 2, 3]
    assert df.select(checks.one_of("id", (1, 3)).alias("ok")).where("ok").count() == 2


def test_a_set_is_one_folder_and_a_segment_a_filter(spark, tmp_path):
    path = str(tmp_path / "store")
    segs = spark.createDataFrame([(f"t{i % 5}", i // 5, [i]) for i in range(50)], "track string, seg_ord long, ts array<int>")
    for params in ("n%1", "n%2"):
        store.write_segment_set(segs.withColumn("params", F.lit("x")), path, "uniform", params, "events", "track", 60)
    store.write_segment_set(segs.limit(3), path, "fluss", "n%1", "events", "track", 60)
    assert store.manifest(spark, path).count() == 3
    found = store.open_segments(spark, path, "uniform", "n%2")
    assert sorted(map(tuple, found.select(*segs.columns).collect())) == sorted(map(tuple, segs.collect()))
    one = store.segment(spark, path, "uniform", "n%2", "track", "t3", 4)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(method" in plan and "EqualTo(seg_ord,4)" in plan and "EqualTo(track,t3)" in plan
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("/segments/")[1].rsplit("/", 1)[0] for r in read}) == 1
    assert [tuple(r) for r in one.select(*segs.columns).collect()] == [("t3", 4, [23])]
    with pytest.raises(KeyError, match="fluss n%1, uniform n%1"):
        store.open_segments(spark, path, "random", "n%1")
    with pytest.raises(ValueError, match="has segments of uniform n%1"):
        store.write_segment_set(segs, path, "uniform", "n%1", "events", "track", 60)


def test_edge_list_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", 0, "b", 1, 0.25, "sim"), ("b", 1, "a", 0, 0.0, "same")],
                                  "source_track string, source_ord long, target_track string, target_ord long, distance double, type string")
    ids = spark.createDataFrame([(0, "a", 0), (1, "b", 0), (2, "b", 1)], "pattern_id long, track string, seg_ord long")
    store.write_edge_list(edges, ids, str(tmp_path / "e"), "track")
    got = store.read_edge_list(spark, str(tmp_path / "e"), "track")
    assert got.schema.simpleString() == edges.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(Exception, match="ends at no pattern"):
        store.write_edge_list(edges, ids.limit(1), str(tmp_path / "f"), "track")
