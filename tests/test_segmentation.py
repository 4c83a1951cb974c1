import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import segmentation as G

RNG = np.random.default_rng(3)
TRACKS = {k: np.repeat(RNG.integers(0, 12, 40), RNG.integers(1, 6, 40))[:n].tolist() for k, n in (("a", 90), ("b", 20), ("c", 1), ("d", 7))}


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.createDataFrame([(k, t, int(v)) for k, ts in TRACKS.items() for t, v in enumerate(ts)],
                                 "track string, t long, v int").cache()


def test_novelty_against_the_full_matrix(ticks):
    half = 8
    k = np.arange(-half, half + 1)
    g = np.exp(-(np.sqrt(0.5) / (half * 0.5) * k) ** 2) * np.sign(k)
    kernel = np.outer(g, g)
    kernel /= np.abs(kernel).sum()
    got = {(r.track, r.t): r.novelty for r in G.novelty(ticks, "track", "v").collect()}
    for name, ts in TRACKS.items():
        x = np.array(ts, float)
        ssm = np.pad(1 / (1 + np.abs(x[:, None] - x[None, :])), half)
        for t in range(len(x)):
            want = (kernel * ssm[t:t + 2 * half + 1, t:t + 2 * half + 1]).sum()
            assert got[name, t] == pytest.approx(want, abs=1e-8)


def test_segments_partition_the_ticks(ticks):
    segs = G.segments(G.novelty_split(ticks, "track", "v"), "track", "v").orderBy("track", "seg_ord").collect()
    for name, ts in TRACKS.items():
        mine = [s for s in segs if s.track == name]
        assert [s.seg_ord for s in mine] == list(range(len(mine)))
        assert sum([list(s.ts) for s in mine], []) == ts
        assert mine[0].t0 == 0 and all(a.t1 == b.t0 for a, b in zip(mine, mine[1:]))
    assert len([s for s in segs if s.track == "a"]) > 1


def test_split_at_given_times(ticks):
    only = ticks.filter("track = 'a'")
    cut = G.segments(G.split_at(only, "track", F.array(F.lit(40), F.lit(0), F.lit(70), F.lit(90))), "track", "v")
    assert [(r.t0, r.t1) for r in cut.orderBy("seg_ord").collect()] == [(0, 40), (40, 70), (70, 90)]
    whole = G.segments(G.split_at(only, "track", F.array().cast("array<bigint>")), "track", "v").collect()
    assert [(r.t0, r.t1) for r in whole] == [(0, 90)]
    with pytest.raises(Exception, match="outside the progression"):
        G.split_at(only, "track", F.array(F.lit(91))).collect()


@pytest.mark.parametrize("method", ["uniform_split", "random_split", "quasirandom_split"])
def test_baselines(ticks, method):
    rows = G.segments(G.baseline_split(ticks, "track", method, (3, 5)), "track", "v", "n_regions").collect()
    for n in (3, 5):
        for name, ts in TRACKS.items():
            mine = sorted((r for r in rows if r.n_regions == n and r.track == name), key=lambda r: r.seg_ord)
            assert sum([list(r.ts) for r in mine], []) == ts and 1 <= len(mine) <= n
            if method == "uniform_split" and len(ts) >= n:
                assert len(mine) == n


def test_chords_are_cut_at_segment_borders(spark):
    df = spark.createDataFrame([("a", t, t // 3, f"c{t // 3}", "C", 0 if t < 4 else 1) for t in range(9)],
                               "track string, t long, event_pos long, chord string, key string, seg_ord long")
    rows = G.segment_chords(df, "track").orderBy("seg_ord", "chord_index").collect()
    assert [(r.seg_ord, r.chord_index, r.chord, r.start, r.duration) for r in rows] == [
        (0, 0, "c0", 0, 3), (0, 1, "c1", 3, 1), (1, 0, "c1", 4, 2), (1, 1, "c2", 6, 3)]
