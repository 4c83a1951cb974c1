"""The arc curve in tiles against one computed whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.config import DEFAULT
from seqloom.functions.kernels import fluss_boundaries
from seqloom.operators import regimes as R
from seqloom.operators import segmentation as G

RNG = np.random.default_rng(7)


def regimes(n, parts):
    step = n // parts
    return np.concatenate([np.tile(RNG.integers(0, 12, 5 + k), step)[:step] for k in range(parts)]).tolist()


TRACKS = {"long": regimes(900, 5), "random": RNG.integers(0, 12, 400).tolist(), "flat": [3] * 150, "short": [1, 2, 3, 4],
          "tiny": [1, 2], "steps": np.repeat(RNG.integers(0, 12, 60), 4).tolist()}


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.createDataFrame([(k, t, int(v), "x") for k, ts in TRACKS.items() for t, v in enumerate(ts)],
                                 "track string, t long, v int, nn string").cache()


def plain_profile(x, m):
    sub = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), m)
    sd = sub.std(axis=1, keepdims=True)
    z = np.where(sd > 1e-9, (sub - sub.mean(axis=1, keepdims=True)) / np.where(sd > 1e-9, sd, 1), 0)
    d = np.round(((z[:, None] - z[None]) ** 2).sum(axis=2), 9)
    p = np.arange(len(z))
    d[np.abs(p[:, None] - p[None]) <= max(1, m // 2)] = np.inf
    return d.min(axis=1), d.argmin(axis=1)


@pytest.mark.parametrize("m,block", [(3, 4096), (3, 64), (8, 50), (10, 4)])
def test_profile_in_tiles(ticks, m, block):
    got = R.matrix_profile(ticks, "track", "v", m, block).collect()
    for name, ts in TRACKS.items():
        mine = sorted((r for r in got if r.track == name), key=lambda r: r.t)
        assert [r.t for r in mine] == list(range(max(len(ts) - m + 1, 0)))
        if mine:
            d, nn = plain_profile(ts, m)
            assert [r.nn for r in mine] == [int(q) if np.isfinite(v) else None for v, q in zip(d, nn)]
            assert [r.d2 for r in mine if r.nn is not None] == pytest.approx([v for v in d if np.isfinite(v)], abs=1e-8)


@pytest.mark.parametrize("block", [4096, 70])
def test_one_curve_for_every_number_of_regions(ticks, block, monkeypatch):
    monkeypatch.setattr(R.regime_changes, "__defaults__", (DEFAULT, block))
    got = {(r.track, r.n_regions): r for r in G.fluss_split(ticks, "track", "v").collect()}
    assert len(got) == len(TRACKS) * len(DEFAULT.n_regions)
    for (name, n), r in got.items():
        assert r.starts == [0, *fluss_boundaries(np.array(TRACKS[name], float), DEFAULT.fluss_m, n)]
        assert r.n_ticks == len(TRACKS[name])


def test_a_long_track_is_the_work_of_several_tasks(spark):
    ts = regimes(6000, 6)
    one = spark.createDataFrame([("a", t, int(v)) for t, v in enumerate(ts)], "track string, t long, v int")
    dealt = R.tiles(one, "track", "v", 3, 500).select("i", "j", F.spark_partition_id().alias("p")).collect()
    assert len(dealt) == 12 * 13 // 2 and len({r.p for r in dealt}) == 4
    _, nn = plain_profile(ts, 3)
    got = R.matrix_profile(one, "track", "v", 3, 500).collect()
    assert [r.nn for r in sorted(got, key=lambda r: r.t)] == nn.tolist()


@pytest.mark.parametrize("name", ["novelty", *G.BASELINES])
def test_splitters_by_name(ticks, name):
    rows = G.segment_by(name, ticks, "track", "v").collect()
    sets = {r.params for r in rows}
    assert len(sets) == (1 if name == "novelty" else len(DEFAULT.n_regions))
    for p in sets:
        for track, ts in TRACKS.items():
            mine = sorted((r for r in rows if r.params == p and r.track == track), key=lambda r: r.seg_ord)
            assert sum((list(r.ts) for r in mine), []) == ts
            assert mine[0].t0 == 0 and all(a.t1 == b.t0 and a.t0 < a.t1 for a, b in zip(mine, mine[1:]))


def test_unknown_splitter(ticks):
    with pytest.raises(ValueError, match="no splitter"):
        G.segment_by("by_ear", ticks, "track", "v")


def test_a_bad_track_is_reported_and_the_others_go_on(spark):
    rows = [("good", t, float(v)) for t, v in enumerate(TRACKS["steps"])]
    rows += [("hole", t, 1.0) for t in range(40) if t != 7] + [("twice", 0, 1.0), ("twice", 0, 2.0)]
    rows += [("null", t, None if t == 5 else 1.0) for t in range(40)] + [("nan", 0, float("nan")), ("both", 1, None)]
    df = spark.createDataFrame(rows, "track string, t long, v double")
    segs, errors = G.grid_run(df, "track", "v")
    assert sorted(map(tuple, errors.collect())) == sorted([
        ("hole", "every tick once"), ("twice", "every tick once"), ("null", "a value at every tick"),
        ("nan", "a value at every tick"), ("both", "every tick once"), ("both", "a value at every tick")])
    got = segs.collect()
    assert {r.track for r in got} == {"good"} and {r.method for r in got} == set(G.BASELINES)
    for method in G.BASELINES:
        for params in {r.params for r in got if r.method == method}:
            mine = sorted((r for r in got if r.method == method and r.params == params), key=lambda r: r.seg_ord)
            assert sum((list(r.ts) for r in mine), []) == [float(v) for v in TRACKS["steps"]]


def test_a_track_of_one_block_is_one_row(spark):
    """Short tracks get their picks without a row per position leaving the kernel; both ways give the same."""
    tracks = spark.createDataFrame([(k, [int(v) for v in ts]) for k, ts in TRACKS.items()] + [(None, [1, 2] * 60)],
                                   "track string, ts array<int>")
    whole = R.regime_changes(tracks, "track")
    assert "at_once" in whole._jdf.queryExecution().optimizedPlan().toString()
    got = {r.track: r.picks or [] for r in whole.collect()}
    assert got == {r.track: r.picks or [] for r in R.regime_changes(tracks, "track", DEFAULT, 30).collect()}
    assert len(got) == len(TRACKS) + 1 and got[None] == [] and len(got["long"]) == max(DEFAULT.n_regions) - 1


def test_the_profile_of_many_tracks_leaves_in_few_batches(spark, monkeypatch):
    sizes = []
    frame = spark.createDataFrame([(f"t{k}", t, (k * t) % 7) for k in range(40) for t in range(30)], "track string, t long, v int")
    tiles = R.tiles(frame, "track", "v", 3, 4096).coalesce(1)
    monkeypatch.setattr(R, "tiles", lambda *a: tiles)
    monkeypatch.setattr(type(tiles), "mapInArrow", lambda self, f, schema: sizes.extend(
        len(b) for b in f(self.toArrow().to_batches())) or spark.createDataFrame([], schema))
    R.matrix_profile(frame, "track", "v", 3)
    assert sum(sizes) == 40 * 28 and max(sizes) > 28 * 2
