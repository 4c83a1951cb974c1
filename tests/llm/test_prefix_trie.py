"""The trie of rebuilt conversations against one made of Python tuples."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import prefix_trie
from seqloom.llm.prefix_trie import SpillingQueue, op11_prefix_trie


def plain_rows(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(
        v, key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()))]
        for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, turns_of in rebuilt.items():
        for d in range(len(turns_of) + 1):
            members.setdefault(turns_of[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, who in members.items():
        worth = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += node not in children
    return [(min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children.get(n, 0), leaves[n], saved[n],
             hashlib.sha256(",".join(str(c) for c in sorted(who) if rebuilt[c] == n).encode()).hexdigest())
            for n, who in members.items()]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(3)
    out = []
    for c in range(60):
        if c in (10, 25, 26):
            continue
        shared = rng.randrange(4)
        for t in range(rng.randrange(1, 14)):
            kind = shared if t < 3 else rng.randrange(3)
            out.append((c, t, rng.choice(["user", "user", None]), ["", None, "höi", f"text {kind}", "same"][kind + (t > 5)]))
    out += [(70, None, "user", "null turn"), (70, 0, "user", "x"), (70, 0, "user", "x"), (70, 0, None, "y"),
            (71, 1, "user", "z" * 50000), (None, 0, "user", "nobody"), (82, 4, "user", "one")]
    out += [(3000 + k, t, "user", f"deep {min(t, 30 + k // 2)}") for k in range(6) for t in range(45)]
    return out


def frame(spark, turns):
    return spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, depth int")


@pytest.mark.parametrize("stretch,queue,pieces", [(4096, 500_000, 8192), (7, 2, 3)])
def test_query_against_the_plain_version(spark, turns, monkeypatch, stretch, queue, pieces):
    """Also with stretches of seven turns, queues that spill after two messages and lists in pieces of three."""
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", pieces)
    monkeypatch.setattr(prefix_trie, "QUEUE_ROWS", queue)
    got = [tuple(r) for r in op11_prefix_trie(spark, frame(spark, turns).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(plain_rows(turns), key=repr)


def test_turnless_and_empty(spark):
    # 12 gets its first turns from 10, which does not exist, and has no turn of its own after them
    h = zlib.crc32(b"12") % 9
    assert h > 0
    got = [tuple(r) for r in op11_prefix_trie(spark, frame(spark, [(12, 0, "user", "x")])).collect()]
    assert got == [(12, 0, None, 1, 0, 1, 0, hashlib.sha256(b"12").hexdigest())]
    assert op11_prefix_trie(spark, frame(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.tuples(st.integers(0, 5), st.integers(0, 3)))), st.integers(1, 4))
def test_queue_is_a_priority_queue(steps, most):
    queue, held = SpillingQueue(most), []
    for item in steps:
        if item is not None:
            queue.push(item)
            held.append(item)
        elif held:
            assert queue.peek() == min(held)
            held.remove(queue.pop())
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None
