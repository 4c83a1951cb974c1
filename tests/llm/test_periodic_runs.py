"""Periodic runs against a check of every period at every position."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm.periodic_runs import find_runs, kept_words, looped_words, op13_periodic_runs


def plain_runs(w):
    found = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                    found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
         .replace("\r", " ").split(" ") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4))
def test_runs_of_few_letters(texts):
    assert find_runs(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6))
def test_runs_of_planted_loops(parts):
    text = [x for loop, times in parts for x in loop * times]
    assert find_runs([text]) == [plain_runs(text)]


def test_a_single_word_repeated():
    assert find_runs([["a"] * 5000]) == [[(0, 5000, 1)]]
    assert find_runs([["a"] * 5, ["a"] * 6, []]) == [[], [(0, 6, 1)], []]
    assert kept_words(8, [(1, 6, 1)]).tolist() == [True, True] + [False] * 5 + [True]


def test_looped_tail():
    doc = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = looped_words([str(i) for i in range(50)], doc)
    assert len(got) == 50 and len(set(got)) < 50
    assert looped_words(["x"], None) == ["x"] and looped_words([], doc) == []


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a a a a a a", "a\x0ba\x0ca\ra\ta\na", "é ü é ü é ü é ü 日 日",
             "a b a b " * 6, " ".join("xyz"[i % 3] for i in range(400)),
             " ".join(rng.choice("ab") for _ in range(300)), " ".join(f"w{i}" for i in range(3000))]
    out = [(i, t) for i, t in enumerate(texts * 8)]
    return out + [(3, "p q " * 9), (3, "p q " * 9), (None, "p q " * 9), (None, None), (-7, "a a b " * 5)]


def test_query_against_the_plain_version(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, start string, period int")
    got = [tuple(r) for r in op13_periodic_runs(spark, docs.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert op13_periodic_runs(spark, docs.limit(0)).collect() == []
