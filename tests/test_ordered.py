"""The cut sequences give the same rows as plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import ordered as O


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(12)}"
        rows.append((key, rnd.randrange(50), i, rnd.choice("abc"), rnd.choice([None, 1, 2, 5])))
    rows.append((None, 3, 601, "a", 1))
    return spark.createDataFrame(rows, "key string, ts long, id long, sym string, v long").cache()


def both(events, op):
    out = []
    for limit in (10_000, 20):
        seq = O.index_sequence(events, ("key",), ("ts", "id"), hot_rows=limit)
        assert seq.hot == (limit == 20)
        df = op(seq)
        df = df.df if isinstance(df, O.Ordered) else df
        out.append(sorted(map(repr, df.select(sorted(df.columns)).collect())))
    assert out[0] == out[1]
    return out[0]


def test_positions(events):
    assert len(both(events, lambda s: s)) == 601


def test_shifted(events):
    both(events, lambda s: O.shifted(s, {"p": ("sym", 1), "n": ("sym", -2), "q": ("v", 7)}))


def test_running(events):
    both(events, lambda s: O.running(s, {"total": ("sum", "v"), "latest": ("last", "v")}))


def test_frames(events):
    both(events, lambda s: O.framed(s, 3, 4, {
        "m": lambda w: F.max("v").over(w.rowsBetween(-3, 4)), "c": lambda w: F.count("v").over(w.rowsBetween(-3, 0))}))


def test_per_key(events):
    both(events, lambda s: O.per_key(s, {"f": O.first_non_null("v"), "n": F.count(F.lit(1))}))


def test_runs(events):
    rows = both(events, lambda s: O.runs(s, "sym"))
    assert rows


def test_frame_wider_than_block(events):
    seq = O.index_sequence(events, ("key",), ("ts", "id"), hot_rows=20)
    with pytest.raises(ValueError):
        O.shifted(seq, {"p": ("sym", 21)})
