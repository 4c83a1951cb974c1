"""What the rounds of a search read is made once, however many of them there are."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import series as N
from seqloom.operators import graph as K
from seqloom.operators import patterns as P
from seqloom.operators import similarity as S


@pytest.fixture
def counted(spark):
    """A column that counts how many of its rows are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf(T.LongType())
    def through(i):
        made.add(1)
        return i

    return through.asNondeterministic(), made


def series(n):
    rnd = random.Random(5)
    return [[float(rnd.randrange(6)) for _ in range(6)] for _ in range(n)]


def test_rounds_read_stored_rows(spark, counted):
    through, made = counted
    x = series(80)
    df = spark.createDataFrame(list(enumerate(x)), "id long, x array<double>").withColumn("id", through("id"))
    other = spark.createDataFrame(list(enumerate(x)), "source long, sx array<double>")
    got = S.nearest_within(other, df.select(F.col("x").alias("tx"), F.array("id").alias("ids")), 3, 4.0, (0.5, 1.0, 4.0))
    assert {r.source for r in got.collect()} == set(range(80))
    assert made.value == 80


def test_both_directions_of_an_edge_come_from_one_row(spark, counted):
    through, made = counted
    edges = spark.createDataFrame([(1, 0, 2, 0, 0.5), (2, 0, 1, 0, 0.5), (1, 0, 1, 0, 0.0), (1, 0, 9, 9, 0.5)],
                                  "source_track long, source_ord long, target_track long, target_ord long, distance double")
    segs = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "track long, seg_ord long, pattern string")
    found = K.similarity_table(edges.withColumn("source_track", through("source_track")), segs)
    assert {tuple(r) for r in found.collect()} == {("a", "b", 0.5), ("b", "a", 0.5), ("a", "a", 0.0)}
    assert found.columns == ["pattern1", "pattern2", "value"] and made.value == 4


def test_coverage_makes_the_segments_once(spark, counted):
    through, made = counted
    segs = spark.createDataFrame([(("a", "b")[i % 2], i, x) for i, x in enumerate(series(60))], "method string, id long, ts array<double>")
    known = spark.createDataFrame([(m, i, 3, x) for m in "ab" for i, x in enumerate(series(5))],
                                  "method string, label long, n_chords int, ts array<double>")
    got = P.coverage(segs.withColumn("id", through("id")), known, by=("method",)).collect()
    # the first five series are dealt to both methods in turn
    assert {(r["method"], r.n_patterns) for r in got} == {("a", 5), ("b", 5)} and all(r.n_covered >= 2 for r in got)
    assert made.value == 60


def test_vectorised_series_functions_equal_the_array_functions(spark):
    rnd = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [None], [1.0], [None, 1.0, None], [nan, nan, 1.0, 1.0], [nan, 1.0], [inf, 1.0, 2.0], [-0.0, 0.0, -1.0],
            [5e-10, 1.5e-9, 2.5e-9, -2.5e-9, 2.0000000005], [4194304.1234567895, 5e6, 1e6], [1e300, -1e300],
            [None, None, 2.0, 2.0, None, 2.0]]
    rows += [[rnd.choice([None, float(rnd.randrange(9)), rnd.uniform(-1e3, 1e3), 5.0]) for _ in range(rnd.randrange(1, 40))]
             for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, ts array<double>").repartition(3)
    for n in (30, 2, 1):
        for r in df.select("ts", N.resample_to(F.col("ts"), F.lit(n)).alias("a"), N.resample(F.col("ts"), n).alias("b")).collect():
            assert repr(r.a) == repr(r.b), r.ts
    for r in df.select("ts", N.run_collapse(F.col("ts")).alias("a"), N.collapsed(F.col("ts")).alias("b")).collect():
        assert repr(r.a) == repr(r.b), r.ts
