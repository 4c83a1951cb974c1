"""Declarative edges against the sequential pool they replace."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.config import DEFAULT
from seqloom.functions import kernels
from seqloom.operators import similarity as S

from dataclasses import replace


def resampled(ts, size):
    out = []
    for i in range(size):
        num = i * (len(ts) - 1)
        lo, frac = num // (size - 1), (num % (size - 1)) / (size - 1)
        out.append(round(ts[lo] * (1 - frac) + ts[min(lo + 1, len(ts) - 1)] * frac, 9))
    return np.array(out)


def pool_edges(series, cfg):
    """Pop the highest id, emit its thresholded k nearest, remove its identical matches."""
    x = [resampled(s, cfg.resampling_size) for s in series]
    n = len(x)
    d = np.round([kernels.distances("dtw", [x[i]] * n, x) for i in range(n)], 9)
    pool, edges = list(range(n)), set()
    while pool:
        cur = pool.pop()
        near = sorted(range(n), key=lambda j: (d[cur][j], j))[:cfg.num_searches]
        for j in near:
            if d[cur][j] <= cfg.dist_threshold and j != cur:
                if d[cur][j] == 0 and j in pool:
                    pool.remove(j)
                edges.add((cur, j, round(float(d[cur][j]) + 1e-12, 2), "same" if d[cur][j] == 0 else "sim"))
    return edges


@pytest.mark.parametrize("seed,k,copies", [(1, 4, 0), (2, 3, 20), (3, 10, 6), (4, 2, 9)])
def test_edges_equal_the_pool(spark, seed, k, copies):
    rnd = random.Random(seed)
    series = [[rnd.randrange(5) for _ in range(rnd.randrange(2, 9))] for _ in range(50)]
    series += [[1, 2, 2, 4]] * copies + [[1, 1, 2, 4, 4]] * (copies // 2)
    rnd.shuffle(series)
    cfg = replace(DEFAULT, num_searches=k, resampling_size=8)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "id long, ts array<int>")
    got = {(r.source, r.target, r.distance, r.type) for r in S.similarity_edges(df, cfg).collect()}
    assert got == pool_edges(series, cfg)


def test_radii_and_hot_cells_do_not_change_the_result(spark, monkeypatch):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, [rnd.randrange(4) for _ in range(6)]) for i in range(120)], "id long, ts array<int>")
    cfg = replace(DEFAULT, num_searches=5, resampling_size=6)
    want = sorted(map(tuple, S.similarity_edges(df, cfg, radii=(2.0,)).collect()))
    monkeypatch.setattr(S, "BLOCK", 2)
    monkeypatch.setattr(S, "KEY_BLOCKS", 2)
    assert sorted(map(tuple, S.similarity_edges(df, cfg, radii=(0.25, 1.0, 2.0)).collect())) == want


def test_negative_values_and_wide_range(spark):
    rnd = random.Random(11)
    series = [[rnd.randrange(-40, 40) for _ in range(3)] for _ in range(60)]
    series += [[v + rnd.choice([-1, 0, 1]) for v in s] for s in series]
    cfg = replace(DEFAULT, num_searches=6, resampling_size=5)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "id long, ts array<int>")
    got = {(r.source, r.target, r.distance, r.type) for r in S.similarity_edges(df, cfg).collect()}
    assert got == pool_edges(series, cfg)


@pytest.mark.parametrize("metric", ["dtw", "lcss", "euclidean"])
def test_find_similar(spark, metric):
    rnd = random.Random(5)
    series = [[float(rnd.randrange(4)) for _ in range(4)] for _ in range(80)] + [[0.0, 0.0, 0.0, 1.0], [0.0, 1.0, 1.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(series)), "id long, ts array<double>").repartition(3)

    def want(q, k, limit):
        if metric == "euclidean":
            d = [float(np.linalg.norm(np.subtract(s, q))) for s in series]
        else:
            d = kernels.distances(metric, [np.array(s) for s in series], [np.array(q)] * len(series)).tolist()
        near = sorted((x, i) for i, x in enumerate(d))[:k]
        return [(i, round(x, 6)) for x, i in near if x <= limit]

    query = F.array(*[F.lit(v) for v in series[80]])
    assert [tuple(r) for r in S.find_similar(query, df, 9, 1.5, metric).collect()] == want(series[80], 9, 1.5)
    got = [tuple(r) for r in S.find_similar_fromidx(81, df, 9, 1.5, metric).collect()]
    assert got == [x for x in want(series[81], 9, 1.5) if x[0] != 81]
    if metric == "dtw":
        assert (80, 0.0) in got
    with pytest.raises(Exception, match="no series has the id 99"):
        S.find_similar_fromidx(99, df, 3, 1.0, metric).collect()


@pytest.mark.parametrize("ids", ["long", "struct<track: string, seg_ord: long>"])
def test_a_dense_cluster_leaves_the_kernel_cut_to_k(spark, monkeypatch, ids):
    """Hundreds of series within the radius of each other: of each source k hits leave per batch, not all."""
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "KEY_BLOCKS", 4)
    rnd = random.Random(17)
    x = [[rnd.choice([3.0, 3.25, 3.5]) for _ in range(6)] for _ in range(400)]
    name = (lambda i: i) if ids == "long" else (lambda i: (f"t{i % 7}", i))
    t = spark.createDataFrame([(name(i), s) for i, s in enumerate(x)], f"group {ids}, tx array<double>")
    s = spark.createDataFrame([(name(i), s) for i, s in enumerate(x)], f"source {ids}, sx array<double>")
    every = S.within_radius(s, t, 2.0).collect()
    cut = S.within_radius(s, t, 2.0, k=5).collect()
    assert len(every) > 100_000 and len(cut) < len(every) / 5
    best = lambda rows: {q: sorted((r.distance, r.group) for r in rows if r.source == q)[:5] for q in {r.source for r in rows}}
    assert best(cut) == best(every)


def test_a_series_reaches_the_kernel_once_per_cell_and_not_once_per_pair(spark):
    """300 series of one cell meet as two tables of 300 rows; no join makes rows of pairs or pairs of blocks."""
    x = [[3.0 + i / 1000, 3.5, 3.25] for i in range(300)]
    t = spark.createDataFrame(list(enumerate(x)), "group long, tx array<double>")
    s = spark.createDataFrame(list(enumerate(x)), "source long, sx array<double>")
    near = S.within_radius(s, t, 2.0, k=3)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
    got = near.collect()
    assert len(got) == 900 and all(r.distance <= 0.01 for r in got)
