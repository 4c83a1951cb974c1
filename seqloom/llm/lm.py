"""Language-model scores by an n-gram trie in Elias-Fano levels.

Training documents are those whose CRC-32 of the id is not 1 modulo 5. Tokens are the words of the text with
A-Z in lower case, then one end token. The model interpolates bigrams, with absolute discounting, and the
smoothed unigrams of the base score:

    p(w | u) = max(c(u w) - D, 0) / c(u)  +  D t(u) / c(u) * (c(w) + 0.5) / (N + 0.5 (V + 1))

where t(u) is the number of different successors of u; a context never seen leaves the unigram alone. The
first token follows a begin mark.

The trie has two levels, each cut into shards of bounded size by hash ranges, written as files into the
shared folder and memory-mapped by the tasks that score:

* words: an Elias-Fano sequence of 64-bit hashes with counts and quantised back-off weights;
* bigrams: an Elias-Fano sequence of context hashes, monotone pointers in unary to the successors of a
  context, and for each successor 32 bits of its hash and the quantised discounted probability. A bigram
  is found by a successor search among those of its context alone.

Counts are gathered per task, summed per shard, and only then shuffled. A context that makes up more than a
share of 1 / (4 shards) of all tokens is spread over shards by its successors; there can be no more than
4 shards such contexts, and this list is all that is broadcast.

Within a context, different words may share their 32 bits: a word not seen there is then taken for a seen one
with a probability of t(u) / 2**32. Quantisation keeps probabilities to 0.0001 in log10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import partitions, scratch_path, stored
from seqloom.llm.elias_fano import Pointers, Sequence, load, save, successor

DISCOUNT = 0.75
SHARD_BYTES = 24 << 20
FLUSH = 1 << 20
FLOOR = -12.0
_STEPS = 65535


class _Hashes(dict):
    """64-bit hashes of words, kept up to a number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_SEEN = _Hashes()
#: No word is empty or holds a space.
END, BEGIN = (_Hashes().__missing__(x) for x in (b"", b" "))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of the end token."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    if len(_SEEN) > 500_000:
        _SEEN.clear()
    return np.fromiter(map(_SEEN.__getitem__, words), dtype=np.uint64, count=len(words))


def quantised(p: np.ndarray) -> np.ndarray:
    return np.rint((np.log10(np.maximum(p, 10.0 ** FLOOR)) - FLOOR) * (_STEPS / -FLOOR)).astype("<u2")


def unquantised(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) * (-FLOOR / _STEPS) + FLOOR)


def word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shard(context: np.ndarray, low: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the context, for hot contexts also by the successor."""
    key = context >> np.uint64(32)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        spread = (low.astype(np.uint64) >> np.uint64(20)) * np.uint64(0x9E3779B1)
        key = np.where(hot[at] == context, (key + spread) & np.uint64(0xFFFFFFFF), key)
    return (key * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype="<u4").tobytes(), *(a.tobytes() for a in arrays)])


def _unblob(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u4", len(kinds)).tolist()
    out, at = [], 4 * len(kinds)
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order (the last key array first) and the sums of their counts."""
    order = np.lexsort(keys)
    keys, counts = [k[order] for k in keys], counts[order]
    new = np.ones(len(counts), dtype=bool)
    if len(counts):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(counts, first) if len(first) else counts
    return [k[first] for k in keys], sums


def _shard_rows(shard: np.ndarray, pack) -> pa.RecordBatch:
    """One row per shard; ``pack`` makes the bytes of the rows of a shard, given in their order."""
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    blobs = [pack(order[i:j]) for i, j in zip(first, [*first[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())],
                                      names=["shard", "data"])


def _runs(batches):
    """Token hashes of many documents at a time."""
    held, size = [], 0
    for b in batches:
        for t in b.column(0):
            held.append(token_hashes(t.as_py()))
            size += len(held[-1])
            if size >= FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


class Model:
    """A trained model: where its files are, and the numbers that all shards share."""

    def __init__(self, uri: str, shards: int, tokens: int, distinct: int, hot: np.ndarray):
        self.uri, self.shards, self.tokens, self.distinct, self.hot = uri, shards, tokens, distinct, hot

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _level(self, level: str, shard: int):
        cache = self.__dict__.setdefault("_files", {})
        if (level, shard) not in cache:
            try:
                cache[level, shard] = load(f"{self.uri}/{level}/{shard}")
            except FileNotFoundError:  # no training token falls into this shard
                cache[level, shard] = None
        return cache[level, shard]

    def _by_shard(self, shard: np.ndarray):
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for s, i, j in zip(names.tolist(), first, [*first[1:], len(order)]):
            yield s, order[i:j]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and back-off weights (1 for a context without successors)."""
        counts, backoff = np.zeros(len(h), dtype=np.int64), np.ones(len(h))
        for s, rows in self._by_shard(word_shard(h, self.shards)):
            if (a := self._level("words", s)) is not None:
                at = Sequence(a, "word").index(h[rows])
                hit = at >= 0
                counts[rows[hit]] = a["count"][at[hit]]
                backoff[rows[hit]] = unquantised(a["backoff"][at[hit]])
        return counts, backoff

    def bigrams(self, context: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Discounted probabilities, 0 for a bigram that was not seen."""
        low, out = (h >> np.uint64(32)).astype(np.uint32), np.zeros(len(h))
        for s, rows in self._by_shard(pair_shard(context, low, self.hot, self.shards)):
            if (a := self._level("bigrams", s)) is not None:
                node = Sequence(a, "context").index(context[rows])
                rows, node = rows[node >= 0], node[node >= 0]
                lo, hi = Pointers(a, "pointer").span(node)
                at = successor([a["successor"]], lo, hi, low[rows].astype(np.uint64))
                out[rows[at >= 0]] = unquantised(a["p"][at[at >= 0]])
        return out

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each document."""
        sizes = np.array([len(d) for d in docs])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        h = np.concatenate(docs)
        before = np.concatenate([[np.uint64(BEGIN)], h[:-1]])
        before[first] = BEGIN
        vocabulary, place = np.unique(np.concatenate([h, np.array([BEGIN], dtype=np.uint64)]), return_inverse=True)
        counts, backoff = self.words(vocabulary)
        own = place[:-1]
        earlier = np.concatenate([place[-1:], own[:-1]])
        earlier[first] = place[-1]
        c = counts[own]
        base = (c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))
        pair, where = np.unique(earlier.astype(np.int64) * len(vocabulary) + own, return_inverse=True)
        seen = self.bigrams(vocabulary[pair // len(vocabulary)], vocabulary[pair % len(vocabulary)])
        p = seen[where] + backoff[earlier] * base
        return (sizes, np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(base), first),
                np.add.reduceat(np.log10(p), first))


def train(docs: DataFrame, uri: str | None = None, discount: float = DISCOUNT) -> Model:
    """Count the texts of ``docs`` and write the two levels of the trie."""
    spark = docs.sparkSession
    uri = uri or scratch_path(spark, "ngram-trie")
    texts = docs.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * partitions(spark), -(-size // SHARD_BYTES))

    def count_words(batches):
        for held in _runs(batches):
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield _shard_rows(word_shard(keys, shards), lambda i: _blob(keys[i], counts[i].astype("<u4")))

    def sum_words(key, group):
        parts = [_unblob(x.as_py(), "<u8", "<u4") for x in group.column("data")]
        (keys,), counts = _summed([np.concatenate([p[0] for p in parts])],
                                  np.concatenate([p[1] for p in parts]).astype(np.int64))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([int(counts.sum())]),
                         "v": pa.array([len(keys)]), "most": pa.array([int(counts.max(initial=0))]),
                         "data": pa.array([_blob(keys, counts.astype("<u8"))], pa.binary())})

    words = stored(texts.mapInArrow(count_words, "shard int, data binary").groupBy("shard").applyInArrow(
        sum_words, "shard int, n long, v long, most long, data binary"), "word-counts")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    limit = n // (4 * shards) + 1

    def frequent(batches):
        for b in batches:
            for x in b.column(0):
                keys, counts = _unblob(x.as_py(), "<u8", "<u8")
                most = counts >= limit
                yield pa.RecordBatch.from_arrays([pa.array(keys[most].view("<i8")), pa.array(counts[most].view("<i8"))],
                                                 names=["h", "n"])

    # no more than 4 x shards words make up so large a share each; the begin mark counts documents
    common = words.where(F.col("most") >= limit).select("data").mapInArrow(frequent, "h long, n long").toPandas()
    hot = np.append(common["h"].to_numpy(dtype=np.int64).view(np.uint64), np.uint64(BEGIN))
    totals = np.append(common["n"].to_numpy(dtype=np.int64), docs.count())
    order = np.argsort(hot)
    hot, totals = hot[order], totals[order]

    def count_pairs(batches):
        for held in _runs(batches):
            h = np.concatenate(held)
            before = np.concatenate([h[:1], h[:-1]])
            before[np.concatenate([[0], np.cumsum([len(d) for d in held])[:-1]]).astype(np.int64)] = BEGIN
            low = (h >> np.uint64(32)).astype("<u4")
            (low, context), counts = _summed([low, before], np.ones(len(h), dtype=np.int64))

            def pack(i):
                own, sizes = np.unique(context[i], return_counts=True)  # in order already
                return _blob(own, sizes.astype("<u4"), low[i], counts[i].astype("<u4"))

            yield _shard_rows(pair_shard(context, low, hot, shards), pack)

    def write_pairs(key, group):
        parts = [_unblob(x.as_py(), "<u8", "<u4", "<u4", "<u4") for x in group.column("data")]
        (low, context), counts = _summed(
            [np.concatenate([p[2] for p in parts]), np.concatenate([np.repeat(p[0], p[1]) for p in parts])],
            np.concatenate([p[3] for p in parts]).astype(np.int64))
        own, first, sizes = np.unique(context, return_index=True, return_counts=True)
        total = np.add.reduceat(counts, first)
        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
        total = np.where(hot[at] == own, totals[at], total)
        p = np.maximum(counts - discount, 0) / np.repeat(total, sizes)
        save(f"{uri}/bigrams/{key[0].as_py()}",
             Sequence.build("context", own) | Pointers.build("pointer", sizes) | {"successor": low, "p": quantised(p)},
             f"{TaskContext.get().taskAttemptId()}")
        rows = _shard_rows(word_shard(own, shards),
                           lambda i: _blob(own[i], total[i].astype("<u8"), sizes[i].astype("<u8")))
        return pa.Table.from_batches([rows])

    nodes = stored(texts.mapInArrow(count_pairs, "shard int, data binary").groupBy("shard").applyInArrow(
        write_pairs, "shard int, data binary"), "contexts")

    def write_words(key, left, right):
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        counted = [_unblob(x.as_py(), "<u8", "<u8") for x in left.column("data")]
        stats = [_unblob(x.as_py(), "<u8", "<u8", "<u8") for x in right.column("data")]
        empty = [np.zeros(0, dtype="<u8")]
        context = np.concatenate([s[0] for s in stats] or empty)
        (context,), kinds = _summed([context], np.concatenate([s[2] for s in stats] or empty).astype(np.int64))
        total = np.zeros(len(context))
        for s in stats:
            total[np.searchsorted(context, s[0])] = s[1]
        keys, counts = (np.concatenate([c[i] for c in counted] or empty) for i in (0, 1))
        both = np.union1d(keys, context)
        out, backoff = np.zeros(len(both), dtype="<u8"), np.ones(len(both))
        out[np.searchsorted(both, keys)] = counts
        backoff[np.searchsorted(both, context)] = discount * kinds / total if len(context) else 1.0
        if out.max(initial=0) < 1 << 32:
            out = out.astype("<u4")
        save(f"{uri}/words/{shard}", Sequence.build("word", both) | {"count": out, "backoff": quantised(backoff)},
             f"{TaskContext.get().taskAttemptId()}")
        return pa.table({"shard": pa.array([shard], pa.int32())})

    (words.select("shard", "data").groupBy("shard").cogroup(nodes.groupBy("shard"))
     .applyInArrow(write_words, "shard int").count())
    return Model(uri, shards, int(n), int(v), hot)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths and at most 4 x shards hashes

    def run(batches):
        use = shared.value
        for b in batches:
            lo, held, size = 0, [], 0
            for i, t in enumerate(b.column(1)):
                held.append(token_hashes(t.as_py()))
                size += len(held[-1])
                if size >= FLUSH or i + 1 == len(b):
                    n, known, base, own = use.score(held)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0)[lo: i + 1], pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                         pa.array(np.full(len(n), use.tokens, dtype=np.int64)), pa.array(base), pa.array(own)],
                        names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    lo, held, size = i + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op7_elias_fano_ngrams(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those that are not held out.

    A null text counts as empty and has the end token only; a null doc_id is not held out; repeated rows
    count and are scored each; other columns are ignored; with nothing to learn from, both scores are those
    of the smoothed unigrams without counts.
    """
    slim = docs.select("doc_id", "text")
    model = train(slim.where(~held_out(F.col("doc_id"))))
    return score(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                                     "train_tokens", "base_score", "score")
