import pytest
from pyspark.sql import functions as F

from seqloom.functions import series as S


def one(spark, expr, **arrays):
    cols = ", ".join(f"{k} array<double>" for k in arrays)
    return spark.createDataFrame([tuple([float(x) for x in v] for v in arrays.values())], cols).select(expr.alias("r")).first().r


def test_min_area(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, S.min_area(a, b), a=[1, 2, 5, 2], b=[2, 4]) == 0.5
    assert one(spark, S.min_area(a, b), a=[2, 4], b=[1, 2, 5, 2]) == 0.5
    assert one(spark, S.min_area(a, b), a=[3], b=[3, 9]) == 0.0


def test_run_collapse(spark):
    assert one(spark, S.run_collapse(F.col("a")), a=[1, 1, 2, 2, 1]) == [1, 2, 1]


def test_resample(spark):
    assert one(spark, S.resample(F.col("a"), 5), a=[0, 10, 20]) == [0, 5, 10, 15, 20]
    assert one(spark, S.resample(F.col("a"), 3), a=[7]) == [7, 7, 7]
    assert one(spark, S.resample(F.col("a"), 2), a=[1, 5, 9]) == [1, 9]


def test_znorm(spark):
    assert one(spark, S.znorm(F.col("a")), a=[1, 3]) == [-1, 1]
    assert one(spark, S.znorm(F.col("a")), a=[4, 4, 4]) == [0, 0, 0]


def test_insert_sorted(spark):
    assert one(spark, S.insert_sorted(F.col("a"), F.lit(5.0)), a=[0, 4, 9]) == [0, 4, 5, 9]
    assert one(spark, S.insert_sorted(F.col("a"), F.lit(4.0)), a=[0, 4, 9]) == [0, 4, 9]


@pytest.mark.parametrize("sep", [";", ","])
def test_stringify(spark, sep):
    df = spark.createDataFrame([({"m": 3, "k": 8},)], "p map<string,int>")
    assert df.select(S.stringify_map(F.col("p"), sep).alias("r")).first().r == sep.join(["(k: 8)", "(m: 3)"])
