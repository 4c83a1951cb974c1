"""Change-point segmentation of tick series.

Rows of a track are its ticks, so their number is bounded by the covered time range over the
tick length, however many events the track has; windows per track are therefore safe. All of
them share the partitioning on the track: one shuffle serves novelty, smoothing, thresholds,
peaks, segment numbers and the grouping into segments.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.config import DEFAULT, Config
from seqloom.functions.checks import report
from seqloom.operators.regimes import regime_changes
from seqloom.session import ensure_checkpoint_dir

DIGITS = 9  # curves are rounded so that comparisons do not depend on summation order


def checkerboard_taper(half: int, variance: float) -> list[float]:
    """One side of the separable Gaussian checkerboard kernel: signed weights for -L..L."""
    taper = math.sqrt(0.5) / (half * variance)
    return [math.copysign(math.exp(-(taper * k) ** 2), k) if k else 0.0
            for k in range(-half, half + 1)]


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]


def _literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def novelty(ticks: DataFrame, track: str, value: str, cfg: Config = DEFAULT) -> DataFrame:
    """Slide the checkerboard kernel along the diagonal of the self-similarity matrix.

    Only the band of the matrix under the kernel is evaluated, from the frame of values around
    each tick. Similarity of two ticks is ``1 / (1 + |difference|)``; cells outside the matrix
    count as zero; the kernel is scaled to unit absolute sum.
    """
    half = cfg.l_kernel
    w = Window.partitionBy(track).orderBy("t").rowsBetween(-half, half)
    curve = _checkerboard(half, cfg.var_kernel)
    return (ticks.withColumn("_frame", F.collect_list(F.col(value).cast("double")).over(w))
            .withColumn("novelty", curve("_frame", F.least(F.col("t"), F.lit(half))))
            .drop("_frame"))


def _checkerboard(half: int, variance: float):
    """Kernel value of one frame: an Arrow expression, so the partitioning is kept.

    The 289 cells per tick are the one hot spot that array functions evaluate some ten times
    slower than vectorised arithmetic.
    """
    signed = np.array(checkerboard_taper(half, variance))
    scale = float(np.abs(signed).sum() ** 2)
    width = 2 * half + 1

    @F.arrow_udf(T.DoubleType())
    def curve(frame: pa.Array, before: pa.Array) -> pa.Array:
        values = frame.flatten().to_numpy(zero_copy_only=False)
        sizes = frame.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        shift = half - before.to_numpy(zero_copy_only=False)
        cols = np.arange(len(values)) - starts + shift[rows]
        x = np.zeros((len(sizes), width))
        c = np.zeros((len(sizes), width))
        x[rows, cols] = values
        c[rows, cols] = signed[cols]
        total = (c * c).sum(axis=1)
        for lag in range(1, width):
            total += 2.0 * (c[:, lag:] * c[:, :-lag] / (1.0 + np.abs(x[:, lag:] - x[:, :-lag]))).sum(axis=1)
        return pa.array(np.round(total / scale, DIGITS))

    return curve


def peaks(curve: DataFrame, track: str, cfg: Config = DEFAULT) -> DataFrame:
    """Smooth the novelty curve, add the adaptive threshold and mark the peaks.

    The Gaussian is renormalised where it leaves the track; the threshold is the median of the
    smoothed curve around the tick plus a share of its mean over the track.
    """
    weights = gaussian_weights(cfg.sigma)
    radius = len(weights) // 2
    order = Window.partitionBy(track).orderBy("t")
    lead_in = F.lit(radius) - F.least(F.col("t"), F.lit(radius))
    used = F.slice(_literal(weights), (lead_in + 1).cast("int"), F.size("_frame"))
    smooth = _sum(F.zip_with("_frame", used, lambda v, c: v * c)) / _sum(used)
    half = cfg.median_len // 2
    median = F.percentile("smooth", 0.5).over(order.rowsBetween(-half, cfg.median_len - half - 1))
    mean = F.avg("smooth").over(Window.partitionBy(track))
    before, after = F.lag("smooth").over(order), F.lead("smooth").over(order)
    return (curve
            .withColumn("_frame", F.collect_list("novelty").over(order.rowsBetween(-radius, radius)))
            .withColumn("smooth", F.round(smooth, DIGITS)).drop("_frame")
            .withColumn("threshold", F.round(median + F.lit(cfg.offset_rel) * mean, DIGITS))
            .withColumn("is_peak", F.coalesce(
                (F.col("smooth") > before) & (F.col("smooth") > after)
                & (F.col("smooth") > F.col("threshold")), F.lit(False))))


def novelty_split(ticks: DataFrame, track: str, value: str, cfg: Config = DEFAULT) -> DataFrame:
    """Number the segments between novelty peaks (``seg_ord``)."""
    marked = peaks(novelty(ticks, track, value, cfg), track, cfg)
    w = Window.partitionBy(track).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return (marked.withColumn("seg_ord", F.sum(F.col("is_peak").cast("long")).over(w))
            .drop("novelty", "smooth", "threshold", "is_peak"))


def split_at(ticks: DataFrame, track: str, boundaries: Column) -> DataFrame:
    """Split at explicit times; a segment starts at each boundary inside the track.

    ``boundaries`` is an array column. Times outside ``0..length`` are an error.
    """
    n = (F.max("t").over(Window.partitionBy(track)) + 1)
    checked = F.when(F.exists("_b", lambda b: (b < 0) | (b > F.col("_n"))),
                     F.raise_error(F.lit("split times are outside the progression"))
                     ).otherwise(F.col("_b"))
    inside = F.array_distinct(F.filter(checked, lambda b: (b > 0) & (b < F.col("_n"))))
    return (ticks.withColumn("_b", boundaries).withColumn("_n", n).withColumn("_in", inside)
            .withColumn("seg_ord", F.size(F.filter("_in", lambda b: b <= F.col("t"))).cast("long"))
            .drop("_b", "_n", "_in"))


GOLDEN = 0.6180339887498949


def uniform_boundaries(length: Column, n_regions: Column) -> Column:
    """Ceilings of equal shares, so that tick ``t`` lies in region ``floor(t * n / length)``."""
    return F.transform(F.sequence(F.lit(1), n_regions - 1),
                       lambda r: F.ceil(r * length / n_regions).cast("long"))


def random_boundaries(length: Column, n_regions: Column, track: Column, seed: int = 0) -> Column:
    """Reproducible draws: the digest of (seed, track, region) modulo the length."""
    def draw(r: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), track.cast("string"), r.cast("string")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % length
    return F.transform(F.sequence(F.lit(1), n_regions - 1), draw)


def quasirandom_boundaries(length: Column, n_regions: Column) -> Column:
    """Golden-ratio low-discrepancy sequence scaled to the length."""
    return F.transform(F.sequence(F.lit(1), n_regions - 1), lambda r: F.floor(
        (r * F.lit(GOLDEN) - F.floor(r * F.lit(GOLDEN))) * length).cast("long"))


def _drawn(method: str, length: Column, n: Column, track: Column) -> Column:
    return {"uniform_split": lambda: uniform_boundaries(length, n),
            "random_split": lambda: random_boundaries(length, n, track),
            "quasirandom_split": lambda: quasirandom_boundaries(length, n)}[method]()


def track_series(ticks: DataFrame, track: str, value: str) -> DataFrame:
    """One row per track with its whole series (bounded by the time range)."""
    return ticks.groupBy(track).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("t", value))), lambda x: x[value]).alias("ts"))


#: Splits that need no data but the length of a track, and the one by the arc curve.
BASELINES = ("uniform_split", "random_split", "quasirandom_split", "fluss")


def region_starts(series: DataFrame, track: str, method: str, cfg: Config = DEFAULT) -> DataFrame:
    """(track, n_regions, starts, n_ticks, ts): where the regions of each track begin, once per number of regions.

    ``series`` is `track_series`. ``starts`` is sorted, begins with 0 and repeats nothing, so there may be fewer
    regions than asked for.
    """
    n, length = F.col("n_regions"), F.size("ts").cast("long")
    each = F.explode(F.array(*[F.lit(v) for v in cfg.n_regions])).alias("n_regions")
    if method == "fluss":
        held = regime_changes(series, track, cfg).select(track, "ts", "picks", each)
        inside = F.slice(F.coalesce("picks", F.array().cast("array<bigint>")), F.lit(1), n - 1)
    else:
        held = series.select(track, "ts", each)
        inside = F.filter(_drawn(method, length, n, F.col(track)), lambda b: (b > 0) & (b < length))
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), inside)))
    return held.select(track, "n_regions", starts.alias("starts"), length.alias("n_ticks"), "ts")


def slices(starts: DataFrame, track: str, *by: str) -> DataFrame:
    """Segments of series that begin at ``starts``: one row each, like `segments` gives them."""
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n_ticks"))
    cut = starts.select(*by, track, "ts", F.posexplode(F.arrays_zip("starts", ends.alias("ends"))).alias("seg_ord", "_s"))
    t0, t1 = F.col("_s.starts"), F.col("_s.ends")
    return cut.select(*by, track, F.col("seg_ord").cast("long").alias("seg_ord"), t0.alias("t0"), t1.alias("t1"),
                      F.slice("ts", (t0 + 1).cast("int"), (t1 - t0).cast("int")).alias("ts"))


def baseline_segments(ticks: DataFrame, track: str, value: str, method: str, cfg: Config = DEFAULT) -> DataFrame:
    """Segments of one baseline for every number of regions: (n_regions, track, seg_ord, t0, t1, ts).

    One shuffle collects the series; boundaries are found once per track and number of regions.
    """
    return slices(region_starts(track_series(ticks, track, value), track, method, cfg), track, "n_regions")


def segment_by(name: str, ticks: DataFrame, track: str, value: str, cfg: Config = DEFAULT) -> DataFrame:
    """Segments by a splitter of the registry: ``novelty`` or one of `BASELINES`, with its parameter set as ``params``."""
    if name == "novelty":
        return (segments(novelty_split(ticks, track, value, cfg), track, value)
                .withColumn("params", paramset(name, l_kernel=F.lit(cfg.l_kernel))))
    if name not in BASELINES:
        raise ValueError(f"no splitter {name!r}: novelty, {', '.join(BASELINES)}")
    more = {"m": F.lit(cfg.fluss_m)} if name == "fluss" else {}
    return (baseline_segments(ticks, track, value, name, cfg)
            .withColumn("params", paramset(name, n_regions=F.col("n_regions"), **more)).drop("n_regions"))


def grid_run(ticks: DataFrame, track: str, value: str, cfg: Config = DEFAULT,
             methods: tuple[str, ...] = BASELINES) -> tuple[DataFrame, DataFrame]:
    """All parameter sets of the baselines over all tracks: (segments, report).

    ``segments`` has method, params, track, seg_ord, t0, t1, ts. A track that cannot be segmented does not stop the
    others: ``report`` (track, check) names what is wrong with it, and it has no segments. Both come from one pass
    over the ticks, which is stored. Ticks are 0..n-1, each once, and their values are not null and finite.
    """
    found = F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("_v"))))
    held = ticks.groupBy(track).agg(found.alias("_r")).select(
        track, F.transform("_r", lambda r: r["t"]).alias("_t"), F.transform("_r", lambda r: r["_v"]).alias("ts"))
    ensure_checkpoint_dir(ticks.sparkSession)
    held = held.checkpoint()
    number = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    rules = {"every tick once": F.forall(F.transform("_t", lambda t, i: t.eqNullSafe(i.cast("long"))), lambda ok: ok),
             "a value at every tick": F.forall("ts", number)}
    good = reduce(lambda x, y: x & y, rules.values())
    series = held.where(good).drop("_t")
    parts = []
    for method in methods:
        more = {"m": F.lit(cfg.fluss_m)} if method == "fluss" else {}
        cut = slices(region_starts(series, track, method, cfg), track, "n_regions")
        parts.append(cut.select(F.lit(method).alias("method"), paramset(method, n_regions=F.col("n_regions"), **more).alias("params"),
                                track, "seg_ord", "t0", "t1", "ts"))
    return reduce(DataFrame.unionByName, parts), report(held, rules, track)


def baseline_split(ticks: DataFrame, track: str, method: str, n_regions: tuple[int, ...]) -> DataFrame:
    """Number segments by a data-independent baseline, once per value of ``n_regions``; other columns are kept."""
    lengths = ticks.groupBy(track).agg((F.max("t") + 1).alias("_len"))
    n, length = F.col("n_regions"), F.col("_len")
    inside = F.array_distinct(F.filter(_drawn(method, length, n, F.col(track)), lambda b: (b > 0) & (b < length)))
    # boundaries are a property of the track: found once per track, then joined to its ticks
    bounds = (lengths.withColumn("n_regions", F.explode(F.array(*[F.lit(v) for v in n_regions])))
              .select(track, F.struct("n_regions", inside.alias("at")).alias("_b"))
              .groupBy(track).agg(F.collect_list("_b").alias("_bs")))
    return (ticks.join(bounds, track).withColumn("_b", F.explode("_bs"))
            .withColumn("n_regions", F.col("_b.n_regions"))
            .withColumn("seg_ord", F.size(F.filter("_b.at", lambda b: b <= F.col("t"))).cast("long"))
            .drop("_bs", "_b"))


def fluss_split(ticks: DataFrame, track: str, value: str, cfg: Config = DEFAULT) -> DataFrame:
    """Segment starts of every track by the corrected arc curve, per number of regions."""
    found = region_starts(track_series(ticks, track, value), track, "fluss", cfg)
    return found.select(track, "n_regions", "starts", "n_ticks")


def segments(numbered: DataFrame, track: str, value: str, *by: str) -> DataFrame:
    """One row per segment: its time span and its slice of the parent series."""
    return (numbered.groupBy(*by, track, "seg_ord").agg(
        F.min("t").alias("t0"), (F.max("t") + 1).alias("t1"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", value))), lambda x: x[value]).alias("ts")))


def segment_chords(numbered: DataFrame, track: str) -> DataFrame:
    """Chord annotations cut at segment borders, numbered inside each segment."""
    cut = (numbered.groupBy(track, "seg_ord", "event_pos")
           .agg(F.first("chord").alias("chord"), F.first("key").alias("key"),
                F.min("t").alias("start"), F.count(F.lit(1)).alias("duration")))
    w = Window.partitionBy(track, "seg_ord").orderBy("start")
    return cut.withColumn("chord_index", F.row_number().over(w) - 1).drop("event_pos")


def paramset(method: str, **params: Column) -> Column:
    """``name%value__name%value`` label of a parameter set."""
    return F.concat_ws("__", *[F.concat(F.lit(f"{k}%"), v.cast("string")) for k, v in params.items()])
