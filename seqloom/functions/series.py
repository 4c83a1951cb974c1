"""Native array expressions over numeric series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import kernels
from seqloom.functions.chords import let


DOUBLES = T.ArrayType(T.DoubleType())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of arrays of doubles, which of them are null, and where each array begins and how long it is."""
    values = column.flatten()
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = values.is_null().to_numpy(zero_copy_only=False)
    return values.to_numpy(zero_copy_only=False), null, np.cumsum(length) - length, length


def _arrays(values: np.ndarray, null: np.ndarray, length: np.ndarray, none: pa.Array | None = None) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(values, pa.float64(), mask=null), mask=none)


@F.arrow_udf(DOUBLES)
def _collapse(series: pa.Array) -> pa.Array:
    values, null, start, length = _flat(series)
    keep = np.zeros(len(values), dtype=bool)
    with np.errstate(invalid="ignore"):
        keep[1:] = (values[1:] != values[:-1]) & ~(np.isnan(values[1:]) & np.isnan(values[:-1])) & ~null[1:] & ~null[:-1]
    keep[start[length > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return _arrays(values[keep], null[keep], kept[start + length] - kept[start], series.is_null())


def run_collapse(ts: Column) -> Column:
    """Drop every element equal to its predecessor."""
    return F.filter(ts, lambda x, i: (i == 0) | (x != F.get(ts, i - 1)))


def collapsed(ts: Column) -> Column:
    """`run_collapse` of arrays of numbers, as doubles: an Arrow expression, as lambdas take some ten times as long."""
    return _collapse(ts.cast(DOUBLES))


def pattern_string(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda x: x.cast("string")), "_")


def resample_to(ts: Column, size: Column) -> Column:
    """Linear interpolation at ``size`` evenly spaced positions from the first to the last."""
    last = F.size(ts) - 1
    steps = F.greatest(size - 1, F.lit(1))

    def at(i: Column) -> Column:
        # i*(n-1)/(size-1) split into its integer part and an exact fraction
        num = i * last
        lo = F.floor(num / steps).cast("int")
        frac = (num - lo * steps) / steps.cast("double")
        a = F.get(ts, lo).cast("double")
        b = F.get(ts, F.least(lo + 1, last)).cast("double")
        return F.round(a * (1 - frac) + b * frac, 9)

    return F.transform(F.sequence(F.lit(0), size - 1), at)


def resample(ts: Column, size: int) -> Column:
    """`resample_to` of one size for all rows: an Arrow expression, as `collapsed`."""
    @F.arrow_udf(DOUBLES)
    def resampled(series: pa.Array) -> pa.Array:
        out, lost = kernels.resampled_rows(*_flat(series), size)
        return _arrays(out.ravel(), lost.ravel(), np.full(len(series), size))

    return resampled(ts.cast(DOUBLES))


def mean(ts: Column) -> Column:
    return F.aggregate(ts, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(ts)


def znorm(ts: Column) -> Column:
    """Zero mean, unit population deviation; a constant series becomes all zeros."""
    def spread(s: Column) -> Column:
        sq = F.aggregate(s["ts"], F.lit(0.0), lambda a, x: a + (x.cast("double") - s["mu"])
                         * (x.cast("double") - s["mu"])) / F.size(s["ts"])
        return F.struct(s["ts"].alias("ts"), s["mu"].alias("mu"), F.sqrt(sq).alias("sd"))

    def scale(s: Column) -> Column:
        return F.transform(s["ts"], lambda x: F.when(s["sd"] > 1e-9, (x.cast("double") - s["mu"]) / s["sd"])
                           .otherwise(F.lit(0.0)))

    return let(let(F.struct(ts.alias("ts"), mean(ts).alias("mu")), spread), scale)


def min_area(a: Column, b: Column) -> Column:
    """Smallest mean absolute difference over all placements of the shorter in the longer."""
    longer = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    shorter = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    m = F.size(shorter)

    def area(i: Column) -> Column:
        diffs = F.zip_with(F.slice(longer, i + 1, m), shorter, lambda x, y: F.abs(x - y).cast("double"))
        return F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(longer) - m), area)) / m


def insert_sorted(times: Column, t: Column) -> Column:
    """Insert a split time in a sorted array unless it is there already."""
    pos = F.size(F.filter(times, lambda x: x < t))
    return F.when(F.array_contains(times, t), times).otherwise(
        F.concat(F.slice(times, 1, pos), F.array(t), F.slice(times, pos + 1, F.size(times))))


def stringify_map(m: Column, sep: str = ";") -> Column:
    """``(k: v);(k: v)`` in key order."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(
        F.lit("("), e["key"].cast("string"), F.lit(": "), e["value"].cast("string"), F.lit(")"))), sep)


def rename_all(col: Column, mapping: dict[str, str]) -> Column:
    """Apply literal replacements one after the other."""
    for old, new in mapping.items():
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def flatten(nested: Column) -> Column:
    """The elements of an array of arrays one after the other; null parts have none."""
    return F.flatten(F.filter(nested, lambda part: part.isNotNull()))
