"""Benchmark passages against a search for every window."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import winnowing
from seqloom.llm.winnowing import contamination, fingerprints, op12_winnowed_passages, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_rows(docs, items):
    windows = []
    for item, text in items:
        w = plain_words(text)
        m = min(len(w), 10)
        windows += [(item, tuple(w[i:i + m])) for i in range(len(w) - m + 1) if m]
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@given(st.text(max_size=80))
def test_words_are_those_of_the_pattern(text):
    assert [w.decode() for w in split_words(text.encode())] == plain_words(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12),
       st.lists(st.integers(0, 3), min_size=10, max_size=20))
def test_ten_shared_words_share_a_fingerprint(before, after, shared):
    a = fingerprints(np.array(shared, dtype=np.uint64))
    b = fingerprints(np.array(before + shared + after, dtype=np.uint64))
    assert set(a.tolist()) <= set(b.tolist())
    assert b[len(before):len(before) + len(a)].tolist() == a.tolist()


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([12, 25, 40]))) for i in range(12)]
    items += [(3, text(15)), (20, items[0][1]), (21, "Short, One!"), (22, "ünï é"), (23, "..."), (24, None), (25, ""),
              (None, "no id has this item at all but it hits words in the text"), (100, items[1][1]), (9, text(9))]
    docs = [(0, None), (1, ""), (2, "..."), (3, "short one"), (4, "SHORT; one two short one"), (5, "x ünï é y ünï")]
    for k in range(40):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            lo = rng.randrange(max(len(w) - 9, 1))
            parts += [",  ".join(w[lo:lo + rng.choice([9, 10, 11, 30])]).upper(), text(rng.randrange(20))]
        docs.append((10 + k, "\n".join(parts)))
    docs += docs[-3:] + [(None, docs[-1][1]), (99, docs[-1][1]), (98, items[2][1] + " " + text(8000) + " " + items[2][1])]
    docs += [(97, "No id has this item at ALL but it hits words in the text.")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_hit int, item_id string"),
            spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int"))


def test_query_against_the_plain_version(spark, tables):
    docs, items = frames(spark, *tables)
    got = [tuple(r) for r in op12_winnowed_passages(spark, docs.repartition(3), items.repartition(2)).collect()]
    assert sorted(got, key=repr) == sorted(plain_rows(*tables), key=repr)
    assert sum(r[5] for r in got) > 15 and not all(r[5] for r in got)


def test_a_full_filter_only_lets_more_through(spark, tables, monkeypatch):
    monkeypatch.setattr(winnowing, "print_filter", lambda w: np.full(1 << (winnowing.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    docs, items = frames(spark, *tables)
    got = [tuple(r) for r in op12_winnowed_passages(spark, docs, items).collect()]
    assert sorted(got, key=repr) == sorted(plain_rows(*tables), key=repr)


def test_empty_tables_and_spans(spark, tables):
    docs, items = frames(spark, *tables)
    assert op12_winnowed_passages(spark, docs.limit(0), items).collect() == []
    none = op12_winnowed_passages(spark, docs, items.limit(0)).collect()
    assert len(none) == len(tables[0]) and not any(r.contaminated for r in none)
    one = contamination(docs.where("doc_id = 4"), items).collect()[0]
    assert [tuple(s) for s in one.spans] == [(0, 2), (3, 2)] and one.item_ids == ["21"] and one.n_hit == 4
