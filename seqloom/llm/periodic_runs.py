"""Periodic runs of words, found by uniting suffix classes in the order of falling common prefixes.

Suffixes of a text that share a prefix of ``l`` words form a class. Adjacent suffixes of the sorted order are united
by falling length of their common prefix (Kruskal's order), with the positions of a class kept sorted. Two positions
``i < j`` that become neighbours in a class at level ``l`` share exactly ``l`` words; if ``j - i <= l``, the stretch
from ``i`` to ``j + l`` has the period ``j - i``, and no smaller one, since a smaller period would have put a position
between them at a higher level. All seeds of one run have its period and its end, and the earliest is its start.

Runs of interest are at least six words and four periods long, so their first position shares five or more words
with another: only positions with a repeated four-word prefix are sorted, and levels below five are left alone.
Texts are independent rows; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: A run has at least this many words and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Common words from which on a seed can lie in such a run (period 1: six words less one).
MIN_COMMON = MIN_WORDS - 1
#: Texts are sorted together until they have this many words.
WORDS_AT_ONCE = 200_000

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def looped_words(words: list, doc_id: int | None) -> list:
    """The words of a document; of every tenth id (by its checksum) the tail is replaced by a loop of its beginning.

    A document without an id keeps its words.
    """
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a:a + p]
    return words[:a] + (loop * ((n - a) // p + 1))[:n - a]


def _refine(rank, ends, step, active):
    """Ranks by twice as many words. A rank is the number of smaller suffixes, equal within a class.

    ``active`` are the positions whose class has several members; returned are the new ranks and those still active.
    """
    after = active + step
    inside = after < ends[active]
    second = np.where(inside, rank[np.minimum(after, len(rank) - 1)], -1).astype(np.int64)
    first = rank[active].astype(np.int64)
    order = np.argsort(first * (len(rank) + 1) + second + 1, kind="stable")
    at, first, second = active[order], first[order], second[order]
    new_class = np.ones(len(at), dtype=bool)
    new_class[1:] = first[1:] != first[:-1]
    new_part = new_class.copy()
    new_part[1:] |= second[1:] != second[:-1]
    index = np.arange(len(at))
    part_start = np.maximum.accumulate(np.where(new_part, index, 0))
    class_start = np.maximum.accumulate(np.where(new_class, index, 0))
    out = rank.copy()
    out[at] = first + part_start - class_start
    last = np.ones(len(at), dtype=bool)
    last[:-1] = new_part[1:]
    return out, np.sort(at[~(new_part & last)])


def common_prefixes(ids: np.ndarray, bounds: np.ndarray):
    """Neighbours in the sorted order of all suffixes that share ``MIN_COMMON`` words or more.

    ``ids`` are the words of several texts, one text after the other, and ``bounds`` where each begins and ends.
    Suffixes of different texts share nothing. Returns three arrays: one position, the next one, words in common.
    """
    n = len(ids)
    none = np.zeros(0, dtype=np.int64)
    if n == 0:
        return none, none, none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][text]
    # ranks by one word, apart for every text
    _, inverse, counts = np.unique(text * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    rank, active = starts[inverse].astype(np.int32), np.flatnonzero(counts[inverse] > 1)
    levels, step, repeated = [rank], 1, active
    while len(active):
        rank, active = _refine(rank, ends, step, active)
        levels.append(rank)
        step *= 2
        if step <= 4:
            repeated = active  # share `step` words with another position
    if len(repeated) < 2:
        return none, none, none
    order = repeated[np.argsort(rank[repeated], kind="stable")]
    left, right = order[:-1], order[1:]
    same = text[left] == text[right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        level = levels[k]
        equal = inside & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        common += equal.astype(np.int64) << k
    keep = common >= MIN_COMMON
    return left[keep], right[keep], common[keep]


def runs_of(left, right, common) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and period, from neighbouring suffixes of one text."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    earliest: dict[tuple[int, int], int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def seed(i, j, shared):
        d = j - i
        if d <= shared and shared + d >= MIN_WORDS and shared + d >= MIN_PERIODS * d:
            key = (d, j + shared)
            if i < earliest.get(key, i + 1):
                earliest[key] = i

    order = np.argsort(-common, kind="stable")
    for x, y, shared in zip(left[order].tolist(), right[order].tolist(), common[order].tolist()):
        a, b = root(x), root(y)
        some, many = members.pop(a, [a]), members.pop(b, [b])
        if len(some) > len(many):
            some, many, a, b = many, some, b, a
        parent[a] = b
        last = len(some) - 1
        for k, v in enumerate(some):
            at = bisect_left(many, v)
            if at and (k == 0 or some[k - 1] < many[at - 1]):
                seed(many[at - 1], v, shared)
            if at < len(many) and (k == last or some[k + 1] > many[at]):
                seed(v, many[at], shared)
        if last == 0:
            many.insert(at, v)
        else:
            many.extend(some)
            many.sort()  # two sorted stretches: merged in one pass
        members[b] = many
    return sorted((start, end - start, d) for (d, end), start in earliest.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties go to the smaller start, then to the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay if every run is cut to its first period."""
    kept = np.ones(n, dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return kept


def find_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words)."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts], dtype=np.int64)]).astype(np.int64)
    left, right, common = common_prefixes(ids, bounds)
    text = np.searchsorted(bounds, left, side="right") - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        t = int(text[part[0]])
        found[t] = runs_of(left[part] - bounds[t], right[part] - bounds[t], common[part])
    return found


def _digests(doc_id, words, runs):
    best = strongest(runs)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = words if not runs else [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _rows(batches):
    import pyarrow as pa

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def flush(held):
        rows = [_digests(i, words, runs) for (i, words), runs in zip(held, find_runs([w for _, w in held]))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        held, size = [], 0
        for i, text in zip(batch.column(0), batch.column(1)):
            # ASCII white space is what splits bytes
            words = looped_words((text.as_py() or b"").split(), i.as_py())
            held.append((i.as_py(), words))
            size += len(words)
            if size >= WORDS_AT_ONCE or len(held) >= 2048:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): number of runs, the strongest one, digests of runs and of the rest.

    A null or empty text has no words and no runs. Repeated rows give repeated results; other columns are ignored.
    """
    return (docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS binary) AS text")
            .mapInArrow(_rows, SCHEMA))


def op13_periodic_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return periodic_runs(docs)
