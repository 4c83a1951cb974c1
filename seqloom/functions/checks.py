"""Declared checks of rows: they raise, or end in a report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _failed(condition: Column) -> Column:
    """A check that is null has failed."""
    return ~F.coalesce(condition, F.lit(False))


def require(df: DataFrame, checks: Mapping[str, Column], key: str) -> DataFrame:
    """``df`` as it is; a row that fails a check raises with the check's name and the row's key when it is computed."""
    message = reduce(lambda rest, c: F.when(_failed(c[1]), F.concat(
        F.lit(f"{c[0]} fails for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).otherwise(rest),
        reversed(list(checks.items())), F.lit(None).cast("string"))
    ok = F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(ok)


def report(df: DataFrame, checks: Mapping[str, Column], key: str) -> DataFrame:
    """(key, check): one row for every check that a row fails, in one pass."""
    names = F.array(*[F.when(_failed(c), F.lit(name)) for name, c in checks.items()])
    return df.select(key, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("check"))


def equal_lengths(*arrays: str) -> Column:
    """Whether all arrays have the length of the first; null arrays have none."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in arrays]
    return reduce(lambda x, y: x & y, [s == sizes[0] for s in sizes[1:]], F.lit(True))


def truncated(df: DataFrame, *arrays: str) -> DataFrame:
    """``df`` with the arrays cut to the length of the shortest of them; a null array makes all of them null."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    missing = reduce(lambda x, y: x | y, [F.col(a).isNull() for a in arrays])
    # the length is kept in a column of its own while the arrays are replaced
    held = df.withColumn("_n", F.when(~missing, n))
    return held.withColumns({a: F.slice(a, F.lit(1), F.col("_n")) for a in arrays}).drop("_n")


def one_of(column: str, values) -> Column:
    return F.col(column).isin(list(values))


def ascending(array: str) -> Column:
    """Whether an array never falls."""
    x = F.col(array)
    before, after = F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.size(x))
    return F.forall(F.zip_with(before, after, lambda a, b: a <= b), lambda ok: ok)
