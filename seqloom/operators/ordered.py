"""Ordered-sequence operators that survive a key holding a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task. That is
the best plan as long as no key is large, and it is what these operators run then: one shuffle
on the key, reused by everything that follows. ``index_sequence`` counts rows per key first; if
one exceeds the limit, the sequence is cut instead:

* the dense position of a row comes from a range partitioning on (key, order) plus the row
  counts of the preceding chunks;
* frames of bounded width run on blocks of consecutive positions, each extended by a halo of
  copied neighbours;
* running aggregates run per block and add the combined totals of the earlier blocks.

Both ways give the same rows; the tests compare them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqloom.session import ensure_checkpoint_dir, parallelism

HOT_ROWS = 4_000_000  # a key above this many rows is cut into blocks


@dataclass(frozen=True)
class Ordered:
    """Rows with a dense 0-based ``pos`` inside each key."""

    df: DataFrame
    keys: tuple[str, ...]
    hot: bool = False
    block_rows: int = HOT_ROWS

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def block(self) -> Column:
        return F.floor(F.col("pos") / F.lit(self.block_rows)).cast("long")


def _same(left: DataFrame, right: DataFrame, cols: tuple[str, ...]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[f"_r_{c}"])
    return cond


def _join_back(left: DataFrame, right: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Null-safe equi-join that keeps the left column names."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    return left.join(right, _same(left, right, cols)).drop(*[f"_r_{c}" for c in cols])


def index_sequence(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...],
                   hot_rows: int = HOT_ROWS) -> Ordered:
    """Number the rows of each key by a total order (``pos`` = 0, 1, ...)."""
    sizes = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    biggest, total = sizes[0] or 0, sizes[1] or 0
    if biggest <= hot_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return Ordered(df.withColumn("pos", F.row_number().over(w).cast("long") - 1), keys,
                       block_rows=hot_rows)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    chunks = max(parallelism(spark), 2 * -(-total // hot_rows))
    # The range bounds are sampled, so the chunk numbers have to be stored before two
    # branches of one plan may rely on them.
    cut = (df.repartitionByRange(chunks, *keys, *order)
           .withColumn("_chunk", F.spark_partition_id()).checkpoint())
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys, "_chunk").count()
               .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
               .drop("count"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = cut.withColumn("_rn", F.row_number().over(local))
    out = (_join_back(numbered, offsets, (*keys, "_chunk"))
           .withColumn("pos", F.col("_before") + F.col("_rn") - 1)
           .drop("_before", "_rn", "_chunk"))
    return Ordered(out, keys, hot=True, block_rows=hot_rows)


def framed(seq: Ordered, before: int, after: int,
           cols: Mapping[str, Callable[[WindowSpec], Column]]) -> Ordered:
    """Add columns computed over at most ``before`` / ``after`` neighbouring rows."""
    if not seq.hot:
        w = Window.partitionBy(*seq.keys).orderBy("pos")
        return seq.with_df(seq.df.withColumns({n: f(w) for n, f in cols.items()}))
    size = seq.block_rows
    if max(before, after) > size:
        raise ValueError("frame wider than a block")
    offset = F.col("pos") % F.lit(size)
    own = seq.block()
    homes = F.concat(
        F.array(own),
        F.when((offset < after) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<bigint>")),
        F.when(offset >= size - before, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")))
    w = Window.partitionBy(*seq.keys, "_home").orderBy("pos")
    out = (seq.df.withColumn("_home", F.explode(homes))
           .withColumns({n: f(w) for n, f in cols.items()})
           .filter(F.col("_home") == own).drop("_home"))
    return seq.with_df(out)


def shifted(seq: Ordered, cols: Mapping[str, tuple[str, int]]) -> Ordered:
    """Add ``name: (column, offset)``; a positive offset looks back, a negative one ahead."""
    back = max([o for _, o in cols.values() if o > 0], default=0)
    ahead = max([-o for _, o in cols.values() if o < 0], default=0)
    return framed(seq, back, ahead,
                  {n: (lambda w, c=c, o=o: F.lag(c, o).over(w)) for n, (c, o) in cols.items()})


def running(seq: Ordered, cols: Mapping[str, tuple[str, str]]) -> Ordered:
    """Add running aggregates ``name: (kind, column)`` with kind ``sum`` or ``last``.

    ``last`` is the latest non-null value at or before the row.
    """
    upto = (Window.unboundedPreceding, 0)

    def local(kind: str, col: str, w: WindowSpec) -> Column:
        w = w.rowsBetween(*upto)
        return F.sum(col).over(w) if kind == "sum" else F.last(col, ignorenulls=True).over(w)

    if not seq.hot:
        w = Window.partitionBy(*seq.keys).orderBy("pos")
        return seq.with_df(seq.df.withColumns(
            {n: local(k, c, w) for n, (k, c) in cols.items()}))
    src = seq.df.withColumn("_block", seq.block())
    totals = src.groupBy(*seq.keys, "_block").agg(*[
        (F.sum(c) if k == "sum" else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
         ).alias(f"_t_{n}") for n, (k, c) in cols.items()])
    earlier = Window.partitionBy(*seq.keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = totals.select(*seq.keys, "_block", *[
        (F.sum(f"_t_{n}").over(earlier) if k == "sum"
         else F.last(f"_t_{n}", ignorenulls=True).over(earlier)).alias(f"_c_{n}")
        for n, (k, _) in cols.items()])
    w = Window.partitionBy(*seq.keys, "_block").orderBy("pos")
    own = src.withColumns({n: local(k, c, w) for n, (k, c) in cols.items()})
    out = _join_back(own, carry, (*seq.keys, "_block"))
    out = out.withColumns({
        n: (F.when(F.col(n).isNull() & F.col(f"_c_{n}").isNull(), F.lit(None))
            .otherwise(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
            if k == "sum" else F.coalesce(F.col(n), F.col(f"_c_{n}")))
        for n, (k, _) in cols.items()})
    return seq.with_df(out.drop("_block", *[f"_c_{n}" for n in cols]))


def per_key(seq: Ordered, cols: Mapping[str, Column]) -> Ordered:
    """Attach aggregates of the whole key to each of its rows."""
    if not seq.hot:
        w = Window.partitionBy(*seq.keys)
        return seq.with_df(seq.df.withColumns({n: a.over(w) for n, a in cols.items()}))
    agg = seq.df.groupBy(*seq.keys).agg(*[a.alias(n) for n, a in cols.items()])
    return seq.with_df(_join_back(seq.df, agg, seq.keys))


def first_non_null(col: str) -> Column:
    """Aggregate: the earliest non-null value by ``pos``."""
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("pos")))


def runs(seq: Ordered, col: str) -> DataFrame:
    """Run-length encoding: one row per maximal run of equal values (null equals null)."""
    seq = shifted(seq, {"_prev": (col, 1)})
    start = (F.col("pos") == 0) | ~F.col(col).eqNullSafe(F.col("_prev"))
    seq = running(seq.with_df(seq.df.withColumn("_start", start.cast("long"))),
                  {"run": ("sum", "_start")})
    return (seq.df.groupBy(*seq.keys, (F.col("run") - 1).alias("run"))
            .agg(F.first(col).alias(col), F.min("pos").alias("pos"),
                 F.count(F.lit(1)).alias("run_length")))
