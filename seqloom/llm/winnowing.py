"""Passages of a benchmark in documents, found by winnowed fingerprints.

A text is a sequence of words; every five words have a hash, and of each six neighbouring hashes the smallest is
kept. Six hashes span ten words, so whatever ten words two texts share, both keep the same fingerprint for them: no
shared passage of ten words or more is missed. Kept fingerprints of documents are joined with those of the benchmark,
and each is extended to the ten words that it stands for, whose digests have to agree. Items of fewer words than ten
are one window and one fingerprint of their own length.

Windows join with the *different* windows of the benchmark, and results are found once per different text, so neither
a passage in many documents nor a group of copies multiplies rows. Before anything is shuffled, a Bloom filter of the
benchmark's fingerprints, of fixed size whatever the size of the benchmark, drops windows that cannot match; if the
benchmark is too large for it, it only lets more through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER, UPPER, stored

#: Words of a window, words of a hashed gram; as many grams as a window holds compete for one fingerprint.
SPAN, GRAM = 10, 5
#: Bits of the Bloom filter, as a power of two, and hash functions.
FILTER_BITS, FILTER_HASHES = 24, 3
WORDS_AT_ONCE = 200_000

#: A-Z in lower case; what is neither a letter, a digit nor part of a longer character separates.
_SEPARATED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                   for b in range(256))

_WINDOWS = "array<struct<print: long, start: int, length: int, window: binary>>"


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SEPARATED).split()


class _WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten together when there are too many."""

    most = 1_000_000

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbouring words, from the words' hashes."""
    count = max(len(words) - n + 1, 0)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = (out + words[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(out)


def fingerprints(words: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The kept fingerprint of every window of ``span`` words: the smallest hash of the grams in it."""
    grams = gram_hashes(words, gram)
    count = max(len(words) - span + 1, 0)
    kept = grams[:count].copy()
    for k in range(1, span - gram + 1):
        np.minimum(kept, grams[k:k + count], out=kept)
    return kept


def filter_bits(prints: np.ndarray) -> np.ndarray:
    """Places of the fingerprints in the Bloom filter, one row per hash function."""
    mask, step = np.uint64((1 << FILTER_BITS) - 1), prints >> np.uint64(32) | np.uint64(1)
    return np.stack([(prints + np.uint64(k) * step) & mask for k in range(FILTER_HASHES)])


def in_filter(words: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which of the fingerprints the filter (as 64-bit words) may hold."""
    ok = np.ones(len(prints), dtype=bool)
    for at in filter_bits(prints):
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return ok


def _windows(words, hashes, bounds, length, passes):
    """(text number, fingerprint, start in the text, digest) of the windows of ``length`` words that ``passes`` lets."""
    import xxhash

    prints = fingerprints(hashes) if length == SPAN else gram_hashes(hashes, length)
    at = np.arange(len(prints))
    text = np.searchsorted(bounds, at, side="right") - 1
    ok = at + length <= bounds[text + 1]
    if passes is not None:
        ok &= passes(prints)
    for s, t, p in zip(np.flatnonzero(ok).tolist(), text[ok].tolist(), prints[ok].view(np.int64).tolist()):
        yield t, p, s - int(bounds[t]), xxhash.xxh3_128_digest(b" ".join(words[s:s + length]))


def _batched(batches, identity: int, rows_of):
    """Call ``rows_of`` with the leading columns and the words of bounded groups of rows."""
    for batch in batches:
        held, size = [], 0
        for i in range(len(batch)):
            text = batch.column(identity)[i].as_py()
            held.append((tuple(batch.column(c)[i].as_py() for c in range(identity)), text, split_words(text)))
            size += len(held[-1][2])
            if size >= WORDS_AT_ONCE or len(held) >= 2048:
                yield rows_of(held)
                held, size = [], 0
        if held:
            yield rows_of(held)


def _flat(held, cache):
    words = [w for _, _, part in held for w in part]
    hashes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    bounds = np.concatenate([[0], np.cumsum([len(part) for _, _, part in held])]).astype(np.int64)
    return words, hashes, bounds


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, print, start, length, window) of ``benchmark`` (item_id, text).

    ``item`` is the digest of all words of the item, so items of equal words share it. An item of fewer words than
    ten has one window, an item without words (or text) none.
    """
    def rows(batches):
        import pyarrow as pa
        import xxhash

        cache = _WordHashes()

        def rows_of(held):
            words, hashes, bounds = _flat(held, cache)
            sizes = np.diff(bounds)
            names = [xxhash.xxh3_128_digest(b" ".join(part)) for _, _, part in held]
            out = []
            for length in sorted({min(int(n), SPAN) for n in sizes} - {0}):
                for t, p, s, w in _windows(words, hashes, bounds, length, None):
                    if min(int(sizes[t]), SPAN) == length:
                        out.append((held[t][0][0], names[t], p, s, length, w))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["item_id", "item", "print", "start", "length", "window"])

        yield from _batched(batches, 1, rows_of)

    return (benchmark.selectExpr("cast(item_id AS string) AS item_id", "cast(text AS binary) AS text")
            .mapInArrow(rows, "item_id string, item binary, print long, start int, length int, window binary"))


def print_filter(windows: DataFrame) -> np.ndarray:
    """Bloom filter of the fingerprints: 2**24 bits as 64-bit words, at most 2**18 rows to the driver."""
    p = F.col("print")
    step = F.shiftrightunsigned(p, 32).bitwiseOR(F.lit(1))
    mask = (1 << FILTER_BITS) - 1
    # both parts are cut to the filter's bits first, so that no sum leaves a long
    places = [(p.bitwiseAND(F.lit(mask)) + F.lit(k) * step).bitwiseAND(F.lit(mask)) for k in range(FILTER_HASHES)]
    bits = windows.select(F.explode(F.array(*places)).alias("bit"))
    found = (bits.groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def document_windows(docs: DataFrame, lengths: list[int], bloom: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n_words, windows) of every row of ``docs``: windows whose fingerprint the filter knows."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def rows(batches):
        import pyarrow as pa
        import xxhash

        cache, words_of_filter = _WordHashes(), shared.value

        def passes(prints):
            return in_filter(words_of_filter, prints)

        def rows_of(held):
            words, hashes, bounds = _flat(held, cache)
            found = [[] for _ in held]
            for length in lengths:
                for t, p, s, w in _windows(words, hashes, bounds, length, passes):
                    found[t].append({"print": p, "start": s, "length": length, "window": w})
            kind = pa.list_(pa.struct([("print", pa.int64()), ("start", pa.int32()), ("length", pa.int32()),
                                       ("window", pa.binary())]))
            return pa.RecordBatch.from_arrays([
                pa.array([i[0] for i, _, _ in held], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(text or b"") for _, text, _ in held], pa.binary()),
                pa.array(np.diff(bounds), pa.int64()), pa.array(found, kind)],
                names=["doc_id", "text_key", "n_words", "windows"])

        yield from _batched(batches, 1, rows_of)

    return (docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS binary) AS text")
            .mapInArrow(rows, f"doc_id long, text_key binary, n_words long, windows {_WINDOWS}"))


def covered(spans) -> F.Column:
    """Number of positions in the union of sorted (start, length) structs."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        end = s["start"] + s["length"]
        new = F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, begin, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, item_ids (sorted), spans (start, length; sorted).

    A word is hit if it lies in an occurrence of a window of an item. A null text has no words. An item without an id
    hits words, but is neither counted nor listed; rows of ``benchmark`` with one id are one item, each with its own
    windows. Equal rows give equal results; other columns are ignored; without items nothing is hit.
    """
    items = stored(item_windows(benchmark), "item-windows")
    lengths = [r.length for r in items.select("length").distinct().collect()]  # at most SPAN values
    scanned = stored(document_windows(docs, sorted(lengths), print_filter(items)), "document-windows")
    different = items.select("print", "window").distinct()
    candidates = (scanned.where(F.size("windows") > 0).select("text_key", F.inline("windows")).distinct())
    hits = stored(candidates.join(different, ["print", "window"]), "hits")
    spans = (hits.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans")))
    # first the different items of a text, then the ids that share an item's words
    of_text = (hits.select("text_key", "window").distinct()
               .join(items.select("window", "item").distinct(), "window").select("text_key", "item").distinct())
    named = (of_text.join(items.where("item_id IS NOT NULL").select("item", "item_id").distinct(), "item")
             .groupBy("text_key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    found = spans.join(named, "text_key", "left")
    plain = scanned.select("doc_id", "text_key", "n_words", (F.size("windows") > 0).alias("maybe"))
    results = (plain.where("maybe").join(found, "text_key", "left")
               .unionByName(plain.where("NOT maybe"), allowMissingColumns=True))
    spans, ids = F.col("spans"), F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return results.select("doc_id", "n_words", F.when(spans.isNull(), F.lit(0)).otherwise(covered(spans))
                          .cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                          ids.alias("item_ids"), spans)


def op12_winnowed_passages(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS m,
               unnest(list_transform(range(1, greatest(len(w) - {SPAN}, 0) + 2),
                                     lambda i: array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' '))) AS g
        FROM b WHERE len(w) > 0),
placed AS (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT r, i, a.m, a.g FROM (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM placed) a
        SEMI JOIN win ON win.m = a.m AND win.g = a.g),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM hit JOIN win USING (m, g) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
