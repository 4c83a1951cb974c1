"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

DATA = os.environ.get("SEQLOOM_TEST_DATA", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not available")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, DATA)
    assert ok, text


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chord_series_take_one_scan_and_one_shuffle(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["offset_series"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
