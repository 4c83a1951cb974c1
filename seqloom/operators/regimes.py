"""Change of regime by the corrected arc curve (Gharghabi et al. 2017), for tracks of any length.

Every subsequence of ``m`` ticks points to its z-normalised nearest neighbour; few of these arcs cross a change of
regime. The neighbours are a matrix profile, whose work is the square of the track, so a track is cut into blocks of
positions and pairs of blocks are the tiles that tasks work on. A tile keeps the nearest neighbour of each of its
positions; across tiles a minimum that combines before the shuffle does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.config import DEFAULT, Config
from seqloom.session import parallelism

#: Positions of a block, and cells of a tile that are in memory at once.
BLOCK, CELLS = 4096, 262_144
#: Positions that leave a task at once.
ROWS = 65_536
#: Distances are rounded, so that neighbours tie alike whatever the order of summation.
DIGITS = 9


def unit_windows(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences of ``m`` values as vectors of length one around their mean, and their squared norms.

    A constant subsequence is the zero vector with norm 0; the others have norm ``m`` when z-normalised.
    """
    sub = np.lib.stride_tricks.sliding_window_view(x, m)
    sd = sub.std(axis=1, keepdims=True)
    varies = sd > 1e-9
    unit = np.where(varies, (sub - sub.mean(axis=1, keepdims=True)) / np.where(varies, sd * np.sqrt(m), 1.0), 0.0)
    return unit, np.where(varies[:, 0], float(m), 0.0)


def nearest_in_tile(a: np.ndarray, b: np.ndarray, first_a: int, first_b: int, m: int):
    """Nearest neighbours between the subsequences of two blocks: squared distance and position for both sides.

    Positions less than half a subsequence apart (at least one) do not count; ties go to the smaller position. A side
    without any neighbour has an infinite distance.
    """
    ua, na = unit_windows(a, m)
    ub, nb = unit_windows(b, m)
    pa_, pb = first_a + np.arange(len(ua)), first_b + np.arange(len(ub))
    best_a, at_a = np.full(len(ua), np.inf), np.zeros(len(ua), dtype=np.int64)
    best_b, at_b = np.full(len(ub), np.inf), np.zeros(len(ub), dtype=np.int64)
    zone = max(1, m // 2)
    close = pa_[-1] + zone >= pb[0] and pb[-1] + zone >= pa_[0]
    rows, wide = max(1, CELLS // len(ub)), len(ub)
    # a rounded distance and a position in one exact double: its minimum is the nearest with the smallest position
    unit = 10.0 ** DIGITS
    if 2.0 * m * unit * max(rows, wide) >= 2.0 ** 53:
        raise ValueError(f"subsequences of {m} ticks are too long")
    columns = np.arange(wide, dtype=float)
    # norm + norm - 2 products, scaled, as one product
    left = np.column_stack([ua * (-2.0 * m * unit), na * unit, np.ones(len(ua))])
    right = np.column_stack([ub, np.ones(wide), nb * unit]).T
    for lo in range(0, len(ua), rows):
        part = slice(lo, lo + rows)
        d = left[part] @ right
        np.rint(d, out=d)
        if close:
            d[np.abs(pa_[part, None] - pb[None, :]) <= zone] = np.inf
        high = len(d)
        across = (d * wide + columns).min(axis=1)
        some = np.isfinite(across)
        value = np.floor(across[some] / wide)
        best_a[part][some], at_a[part][some] = value / unit, pb[(across[some] - value * wide).astype(np.int64)]
        d *= high
        d += np.arange(high, dtype=float)[:, None]
        down = d.min(axis=0)
        value = np.floor(down / high)
        nearer = value / unit < best_b  # earlier rows win ties
        best_b[nearer] = value[nearer] / unit
        at_b[nearer] = pa_[lo + (down[nearer] - value[nearer] * high).astype(np.int64)]
    return best_a, at_a, best_b, at_b


def _blocks(ticks: DataFrame, track: str, value: str, m: int, size: int) -> DataFrame:
    """(track, block, vs): the values of a block and of the ``m - 1`` ticks behind it, and the track's last block."""
    block = F.floor(F.col("t") / size)
    halo = (block > 0) & (F.col("t") % size < m - 1)
    to = F.when(halo, F.array(block, block - 1)).otherwise(F.array(block))
    held = (ticks.select(track, "t", F.col(value).cast("double").alias("_v"), F.explode(to).alias("block"))
            .groupBy(track, "block").agg(F.transform(
                F.array_sort(F.collect_list(F.struct("t", "_v"))), lambda x: x["_v"]).alias("vs")))
    return (held.where(F.size("vs") >= m)
            .withColumn("last", F.max("block").over(Window.partitionBy(track))))


def tiles(ticks: DataFrame, track: str, value: str, m: int, block: int) -> DataFrame:
    """(track, i, j, a, b): pairs of blocks of a track with their values; ``b`` is null where ``i`` is ``j``.

    Both blocks of a pair meet on the key (track, i, j), so a long track is many groups. A tile has few bytes and much
    work, so the number of partitions is fixed and not merged by size.
    """
    blocks = _blocks(ticks, track, value, m, block)
    diagonal = blocks.select(track, F.col("block").alias("i"), F.col("block").alias("j"), F.col("vs").alias("a"),
                             F.lit(None).cast("array<double>").alias("b"))
    many = blocks.where("last > 0")
    left = many.where("block < last").select(track, F.col("block").alias("i"), F.explode(
        F.sequence(F.col("block") + 1, F.col("last"))).alias("j"), F.col("vs").alias("a"))
    right = many.where("block > 0").select(track, F.col("block").alias("j"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("i"), F.col("vs").alias("b"))
    return (diagonal.unionByName(left.join(right, [track, "i", "j"]).select(track, "i", "j", "a", "b"))
            .repartition(parallelism(ticks.sparkSession), track, "i", "j"))


def matrix_profile(ticks: DataFrame, track: str, value: str, m: int, block: int = BLOCK) -> DataFrame:
    """(track, t, d2, nn): the nearest neighbour of each subsequence of ``m`` ticks; null if it has none.

    ``ticks`` holds every tick ``0..n-1`` of a track once. Ties go to the smaller position.
    """
    size = max(block, m)
    pairs = tiles(ticks, track, value, m, size)
    key = pairs.schema[track]

    def nearest(batches):
        held, rows = [], 0
        for batch in batches:
            for r in range(len(batch)):
                i, j = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                a = batch.column(3)[r].values.to_numpy(zero_copy_only=False)
                same = i == j
                b = a if same else batch.column(4)[r].values.to_numpy(zero_copy_only=False)
                # the halo holds no subsequence that begins in the next block
                a, b = a[:size + m - 1], b[:size + m - 1]
                da, ta, db, tb = nearest_in_tile(a, b, i * size, j * size, m)
                t = i * size + np.arange(len(da))
                if not same:
                    da, ta = np.concatenate([da, db]), np.concatenate([ta, tb])
                    t = np.concatenate([t, j * size + np.arange(len(db))])
                found = np.isfinite(da)
                held.append(pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.full(len(t), r))), pa.array(t),
                    pa.array(da, mask=~found), pa.array(ta, mask=~found)], names=[track, "t", "d2", "nn"]))
                rows += len(t)
                if rows >= ROWS:  # many short tracks leave together
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    schema = T.StructType([key, T.StructField("t", T.LongType()), T.StructField("d2", T.DoubleType()),
                           T.StructField("nn", T.LongType())])
    best = F.min(F.when(F.col("nn").isNotNull(), F.struct("d2", "nn")))
    return (pairs.mapInArrow(nearest, schema).groupBy(track, "t").agg(best.alias("_b"))
            .select(track, "t", "_b.d2", "_b.nn"))


def arc_curve(profile: DataFrame, track: str, m: int) -> DataFrame:
    """(track, t, crossing, cac): arcs that cross each position, and their share of what chance would give.

    The first and last ``5 m`` positions of a track, and values above 1, are 1.
    """
    far, near = F.greatest("t", F.coalesce("nn", "t")), F.least("t", F.coalesce("nn", "t"))
    arcs = (profile.select(track, F.explode(F.array(
                F.struct(F.col("t").alias("t"), F.lit(0).alias("step")),
                F.struct(near.alias("t"), F.lit(1).alias("step")), F.struct(far.alias("t"), F.lit(-1).alias("step"))))
                .alias("_a")).groupBy(track, "_a.t").agg(F.sum("_a.step").alias("step")))
    order = Window.partitionBy(track).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    n = F.max("t").over(Window.partitionBy(track)) + 1
    curve = arcs.select(track, "t", F.sum("step").over(order).alias("crossing"), n.alias("_n"))
    ideal = F.lit(2.0) * F.col("t") * (F.col("_n") - F.col("t")) / F.col("_n")
    inside = (F.col("t") >= 5 * m) & (F.col("t") < F.col("_n") - 5 * m)
    return curve.select(track, "t", "crossing", F.when(
        inside & (ideal > 0), F.least(F.col("crossing") / ideal, F.lit(1.0))).otherwise(F.lit(1.0)).alias("cac"))


def deepest(positions: np.ndarray, values: np.ndarray, guard: int, most: int) -> list[int]:
    """Up to ``most`` positions of smallest value in the order of taking them, each blocking ``guard`` on both sides."""
    order = np.lexsort((positions, values))
    taken: list[int] = []
    for p in positions[order].tolist():
        if all(abs(p - q) > guard for q in taken):
            taken.append(p)
            if len(taken) == most:
                break
    return taken


def changes_of_one_block(ts: np.ndarray, m: int, most: int) -> list[int]:
    """The picks of `regime_changes` for a track whose subsequences are one tile: neighbours, arc curve and minima at once."""
    if len(ts) < m:
        return []
    d, nn, _, _ = nearest_in_tile(ts, ts, 0, 0, m)
    n = len(d)
    t = np.arange(n)
    nn = np.where(np.isfinite(d), nn, t)
    crossing = np.cumsum(np.bincount(np.minimum(t, nn), minlength=n) - np.bincount(np.maximum(t, nn), minlength=n))
    ideal = 2.0 * t * (n - t) / n
    inside = np.flatnonzero((t >= 5 * m) & (t < n - 5 * m) & (ideal > 0))
    cac = crossing[inside] / ideal[inside]
    return deepest(inside[cac < 1], cac[cac < 1], 5 * m, most)


def regime_changes(series: DataFrame, track: str, cfg: Config = DEFAULT, block: int = BLOCK) -> DataFrame:
    """``series`` (track, ts) with ``picks``: the deepest minima of the arc curve, the deepest first.

    There is one for each region but the first, and one curve serves every number of regions: ``k`` regions begin at the
    first ``k - 1`` picks. A track of one block stays one row and shuffles nothing; the positions of a longer one become
    rows, whose tiles several tasks work on. A null track has no picks.
    """
    m, most = cfg.fluss_m, max(cfg.n_regions) - 1
    picks = T.ArrayType(T.LongType())

    @F.arrow_udf(picks)
    def pick(points: pa.Array) -> pa.Array:
        out = []
        for part in points:
            v = part.values
            out.append(deepest(v.field("t").to_numpy(), v.field("cac").to_numpy(), 5 * m, most))
        return pa.array(out, pa.list_(pa.int64()))

    @F.arrow_udf(picks)
    def at_once(tracks: pa.Array) -> pa.Array:
        return pa.array([changes_of_one_block(x.values.to_numpy(zero_copy_only=False).astype(float), m, most)
                         if x.is_valid else None for x in tracks], pa.list_(pa.int64()))

    short = F.size("ts") <= max(block, m)
    ticks = (series.where(~short).select(track, F.posexplode("ts").alias("_t", "_v"))
             .select(track, F.col("_t").cast("long").alias("t"), "_v"))
    curve = arc_curve(matrix_profile(ticks, track, "_v", m, block), track, m).where("cac < 1")
    tiled = (curve.groupBy(track).agg(F.collect_list(F.struct("t", "cac")).alias("_p"))
             .select(track, pick("_p").alias("_long")))
    return (series.withColumn("_short", at_once(F.when(short & F.col(track).isNotNull(), F.col("ts"))))
            .join(tiled, track, "left").withColumn("picks", F.coalesce("_short", "_long")).drop("_short", "_long"))
