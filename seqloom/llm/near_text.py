"""Near duplicates by exact shingle similarity: texts that share four fifths of their five-word shingles.

A text is the set of the 64-bit hashes of its shingles; two texts link if the Jaccard similarity of their sets is
0.8 or more. All shingles stand in one order, the frequent ones last. Sets that similar have a shingle in common
among the first ``n - ceil(0.8 n) + 1`` of each, its prefix, so only texts that share a prefix shingle are compared.
The shingles of all texts are counted; the counts come back as a table of fixed size, by bucket of hashes. Two
shingles of one bucket stand where the more frequent does, which is safe: any order gives the same links.

Most prefix shingles occur in one text only. One shuffle brings equal ones together and drops these; shingles of
buckets known to be very frequent are kept and do not take part in it.

SimHash comes first: texts with fingerprints of the same value or at most two bits apart, found by the grid join of
`simhash`, are checked by their sets and unite most copies at a cost in proportion to the texts. Fingerprints of texts
at a similarity of 0.8 differ in some ten bits, so what they leave apart is found by shared shingles.

The texts of a shingle are not paired with each other at once. First every text is compared with one hub, the one it
shares most shingles with; then, as long as that unites components, with some of a crowded shingle's texts. Pairs
within a component add nothing, so what is compared at the end are the texts outside of the largest component of a
shingle with its other texts. Components are the same as with all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm import simhash
from seqloom.llm.common import WORD, partitions, small, stored, text_batches
from seqloom.llm.components import components
from seqloom.llm.winnowing import in_filter, print_filter

SHINGLE = 5
FULL = 1
#: Texts of a shingle that make it a crowded one, and partners drawn for each of them in a round.
CROWDED, NEIGHBOURS = 64, 32
#: Hashes of a sketch, and the share of them in common below which two sets are not compared.
SKETCH, LIKELY = 96, 0.5
#: Texts that a task remembers to have worked on, and words that a worker keeps the hashes of.
SEEN, WORDS_KEPT = 100_000, 100_000
#: Texts that make a shingle a frequent one, and the level from which one is shared for sure (64 texts).
FREQUENT, KNOWN = 3, 48
#: Bits of a shingle that name its bucket, the first of them its part; shingles that are packed and sent at once.
BUCKET_BITS, PART_BITS, PACKED = 23, 10, 500_000


class _WordHashes(dict):
    """64-bit hashes of words; forgotten together when there are ``WORDS_KEPT``, as workers live long."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; all words are one shingle if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(h))
    out = np.zeros(len(h) - k + 1 if k else 0, dtype=np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i: i + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB))


def _lengths_allow(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _seen_before():
    """Tells whether a value was asked for before in this task, as far as it remembers: copies are worked on once."""
    seen: set = set()

    def ask(v) -> bool:
        if v in seen:
            return True
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(v)
        return False

    return ask


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """How frequent the most frequent shingle of each bucket of hashes is: 8 log2 of its count, 0 below ``FREQUENT``.

    The shingles of all texts are counted. They are dealt by their first bits, and 32 bits more tell those of a part
    apart; as any order gives the same links, two that agree in all of them may be counted together.
    """
    width = 1 << BUCKET_BITS - PART_BITS

    def packed(found: list[np.ndarray]):
        keys = np.sort(np.concatenate(found) >> np.uint64(32 - PART_BITS))
        part, data = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        ends = pa.array(np.append(begin, len(data)).astype(np.int32) * 4)
        held = pa.Array.from_buffers(pa.binary(), len(begin), [None, ends.buffers()[1], pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(part[begin]), held], names=["part", "data"])

    def tokens(batches):
        again, found, n = _seen_before(), [], 0
        for b in small(batches):
            for v, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not again(v):
                    found.append(shingles(t.as_py()))
                    n += len(found[-1])
                    if n >= PACKED:
                        yield packed(found)
                        found, n = [], 0
        if n:
            yield packed(found)

    def levels(data: list[bytes]) -> bytes:
        keys = np.sort(np.frombuffer(b"".join(data), np.uint32))
        begin = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
        n = np.diff(np.append(begin, len(keys)))
        often = n >= FREQUENT
        out = np.zeros(width, np.uint8)
        at = keys[begin[often]] >> np.uint32(32 - (BUCKET_BITS - PART_BITS))
        np.maximum.at(out, at, np.minimum(8 * np.log2(n[often]), 255).astype(np.uint8))
        return out.tobytes()

    def count(batches):
        # sorted by part, which may go on in the next batch
        held, data = None, []
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != held and data:
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([levels(data)], pa.binary())],
                                                     names=["part", "levels"])
                    data = []
                held = part
                data.append(x)
        if data:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([levels(data)], pa.binary())],
                                             names=["part", "levels"])

    found = (texts.select("v", "text").mapInArrow(tokens, "part long, data binary")
             .repartition(partitions(texts.sparkSession), "part").sortWithinPartitions("part")
             .mapInArrow(count, "part long, levels binary").toArrow())
    out = np.zeros((1 << PART_BITS, width), np.uint8)
    for part, x in zip(found.column("part").to_pylist(), found.column("levels").to_pylist()):
        out[part] = np.frombuffer(x, np.uint8)
    return out.ravel()


def prefixes(texts: DataFrame) -> DataFrame:
    """token, v, n, known: the prefix of each set, its size, and whether the shingle is a very frequent one.

    Copies of a text (rows of one ``v``) may repeat its entries, once per task.
    """
    levels = frequent_shingles(texts)

    def run(batches):
        again = _seen_before()
        for b in small(batches):
            found = []
            for v, t in zip(b.column(0).to_pylist(), b.column(1)):
                if again(v):
                    continue
                s = shingles(t.as_py())
                n = len(s)
                if not n:
                    continue
                level = levels[s >> np.uint64(64 - BUCKET_BITS)]
                first = np.argsort(level, kind="stable")[: n - (4 * n + 4) // 5 + 1]
                found.append((s[first].view(np.int64), np.full(len(first), v), np.full(len(first), n), level[first] >= KNOWN))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 names=["token", "v", "n", "known"])

    return texts.select("v", "text").mapInArrow(run, "token long, v long, n long, known boolean")


def shared_entries(texts: DataFrame) -> DataFrame:
    """token, v, n: the prefix shingles that several texts have, each text once."""
    entries = prefixes(texts)

    def shared(batches):
        # sorted by (known, token, v): keep known tokens and those of several texts; a token may go on in the next batch
        held, several = None, False
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            if held is not None:
                rows = [np.concatenate([[x], c]) for x, c in zip(held, rows)]
            if not len(rows[0]):
                continue
            token, v = rows[:2]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (v[1:] != v[:-1])
            rows = [c[new] for c in rows]
            token, known = rows[0], rows[3].astype(bool)
            same = np.zeros(len(token) + 1, dtype=bool)
            same[1:-1] = token[1:] == token[:-1]
            keep = same[:-1] | same[1:] | known
            keep[0] |= several
            # the last entry waits for what follows; whether it is shared already is remembered
            held, several, keep[-1] = [c[-1] for c in rows], bool(keep[-1]), False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows[:3]], names=["token", "v", "n"])
        if held is not None and several:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:3]], names=["token", "v", "n"])

    # entries of frequent shingles are only rid of repetitions, and dealt by text
    return (entries.withColumn("key", F.when(F.col("known"), F.col("v")).otherwise(F.col("token")))
            .repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("known", "token", "v")
            .select("token", "v", "n", "known").mapInArrow(shared, "token long, v long, n long"))


def packed_sets(texts: DataFrame, members: DataFrame, most: int | None = None) -> DataFrame:
    """v, data: the sets of the texts in ``members`` (v), each once; with ``most`` only the smallest hashes, packed.

    A Bloom filter of fixed size keeps most of the others from being worked on and shuffled; the join is exact.
    """
    bloom = texts.sparkSession.sparkContext.broadcast(print_filter(members.select(F.col("v").alias("print"))))

    def sets(batches):
        again = _seen_before()
        for b in small(batches):
            v = b.column(0).to_numpy()
            rows = [i for i in np.flatnonzero(in_filter(bloom.value, v.view(np.uint64))).tolist() if not again(int(v[i]))]
            data = [shingles(b.column(1)[i].as_py())[:most] for i in rows]
            if most:  # 32 bits are enough for an estimate
                held = pa.array([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in data], pa.binary())
            else:
                held = pa.array([x.view(np.int64) for x in data], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v[rows]), held], names=["v", "data"])

    found = texts.select("v", "text").mapInArrow(sets, f"v long, data {'binary' if most else 'array<long>'}")
    return found.join(members, "v", "left_semi").groupBy("v").agg(F.first("data").alias("data"))


def _with_data(pairs: DataFrame, data: DataFrame) -> DataFrame:
    return (pairs.select("a", "b").join(data.select(F.col("v").alias("a"), F.col("data").alias("x")), "a")
            .join(data.select(F.col("v").alias("b"), F.col("data").alias("y")), "b").select("a", "b", "x", "y"))


def _may_be_similar(x, y) -> bool:
    """Of the smallest hashes of both sets together, a share of ``LIKELY`` is in both."""
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    every = np.sort(np.concatenate([x, y]))
    both = np.flatnonzero(every[1:] == every[:-1])
    different = len(every) - len(both)
    if different > SKETCH:  # cut to the smallest ones of the union
        union = np.unique(every)
        both, different = both[every[both] <= union[SKETCH - 1]], SKETCH
    return len(both) >= LIKELY * different


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more.

    Most candidates share a passage and little else. Their sketches, the ``SKETCH`` smallest hashes of each set, tell
    them apart before whole sets are moved: at a similarity of 0.8 an estimate below ``LIKELY`` is seven standard
    deviations off. What remains is compared exactly.
    """
    def run(batches):
        for b in batches:
            keep = [_may_be_similar(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    likely = stored(_with_data(pairs, sketches).mapInArrow(run, "a long, b long"), "likely")
    need = likely.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    both = F.size(F.array_intersect("x", "y"))
    # row by row in the JVM: a batch of whole sets would be large
    return (_with_data(likely, stored(packed_sets(texts, need), "sets"))
            .where(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select("a", "b"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def unsettled(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``entries`` (token, v, n) of shingles whose texts are not all in one component: with root, top, members.

    ``top`` is the component with most texts of the shingle.
    """
    live = entries.join(roots, "v", "left").select("token", "v", "n", F.coalesce("root", "v").alias("root"))
    per = live.groupBy("token", "root").agg(F.count("*").alias("size"))
    top = (per.groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("top"), F.sum("size").alias("members"),
                                    F.count("*").alias("roots")).where("roots > 1").drop("roots"))
    return stored(live.join(top, "token"), "live")


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``texts`` (v, text) whose SimHash fingerprints are equal or linked by `simhash.near_links`.

    Each fingerprint stands for its smallest text, which the others of that fingerprint are paired with.
    """
    held = stored(simhash.fingerprints(texts.select(F.col("v").alias("doc_id"), "text"))
                  .select("fp", F.col("doc_id").alias("v")).distinct(), "fingerprints")
    heads = stored(held.groupBy("fp").agg(F.min("v").alias("head")), "fingerprint-heads")
    equal = held.join(heads, "fp").where("v <> head").select(F.col("head").alias("a"), F.col("v").alias("b"))
    x, y = (heads.select(F.col("fp").alias(c), F.col("head").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    linked = simhash.near_links(heads).join(x, "a").join(y, "b").select(*_ordered("x", "y"))
    return equal.unionByName(linked).distinct()


def hub_pairs(live: DataFrame) -> DataFrame:
    """Every text with one other of another component: of the hubs of its shingles, the one it shares most of them with.

    The hub of a shingle is the text with the smallest hash, so that a group of copies mostly has one.
    """
    hubs = live.groupBy("token").agg(F.min_by(F.struct("v", "n", "root"), F.xxhash64("v")).alias("hub"))
    seen = (live.join(hubs, "token").where("hub.root <> root").where(_lengths_allow(F.col("n"), F.col("hub.n")))
            .groupBy("v", F.col("hub.v").alias("hub")).agg(F.count("*").alias("c")))
    return (seen.groupBy("v").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
            .select(*_ordered("v", "hub")).distinct())


def crowd_pairs(live: DataFrame, step: int) -> DataFrame:
    """Every text with ``NEIGHBOURS`` others of other components, drawn from two of its crowded shingles.

    In a crowd of variants, few of which are close to any one hub, some of many are close to each other.
    """
    some = Window.partitionBy("v").orderBy(F.xxhash64("token", F.lit(step)))
    own = live.withColumn("k", F.row_number().over(some)).where("k <= 2")
    drawn = Window.partitionBy("token").orderBy(F.xxhash64("v", "token", F.lit(step)))
    others = own.withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= NEIGHBOURS // 2)
    x, y = own.alias("x"), others.alias("y")
    return (x.join(y, "token").where("x.root <> y.root").where(_lengths_allow(F.col("x.n"), F.col("y.n")))
            .select(*_ordered("x.v", "y.v")).distinct())


def near_links(texts: DataFrame, full: int = FULL, crowded: int = CROWDED) -> DataFrame:
    """``texts`` (v, text; equal texts have one v): links (a, b) with the same components as all links.

    The last comparisons begin when they are at most ``full`` per entry that is left, or when drawing partners in
    shingles of more than ``crowded`` texts no longer helps.
    """
    entries = stored(shared_entries(texts), "shared-prefixes")
    sketches = stored(packed_sets(texts, entries.select("v").distinct(), SKETCH), "sketches")
    links = stored(verified(stored(fingerprint_pairs(texts), "fingerprint-pairs"), sketches, texts), "near-links")
    pairs = hub_pairs(unsettled(entries, components(links)))
    links = stored(links.unionByName(verified(pairs, sketches, texts)), "near-links")
    step, before = 0, None
    while True:
        live = unsettled(entries, components(links))
        rows, rest = live.agg(F.count("*"), F.sum(F.when(F.col("root") != F.col("top"), F.col("members")))).first()
        if not rows:
            return links
        if rest <= full * rows or before is not None and 10 * rest > 9 * before:
            break
        step, before = step + 1, rest
        pairs = stored(crowd_pairs(live.where(F.col("members") > crowded), step), "drawn")
        links = stored(links.unionByName(verified(pairs, sketches, texts)), "near-links")
    x, y = live.where("root <> top").alias("x"), live.alias("y")
    pairs = (x.join(y, "token").where("x.root <> y.root AND (y.root = y.top OR x.v < y.v)")
             .where(_lengths_allow(F.col("x.n"), F.col("y.n"))).select(*_ordered("x.v", "y.v")).distinct())
    return links.unionByName(stored(verified(pairs, sketches, texts), "near-links"))


def text_class(text: Column) -> Column:
    """Equal for equal texts; 0 for all texts without words, null included."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(WORD), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def class_components(docs: DataFrame) -> DataFrame:
    """v, component: for every `text_class` of ``docs`` (text) the smallest class reachable over links."""
    rows = docs.select(text_class(F.col("text")).alias("v"), "text")
    with text_batches(docs.sparkSession):
        roots = components(near_links(rows.where("v <> 0")))
        return stored(rows.select("v").distinct().join(roots, "v", "left")
                      .select("v", F.coalesce("root", "v").alias("component")), "class-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Returns doc_id, component_id (the smallest doc_id reachable over links) for every row of ``docs``.

    A null text counts as empty; texts without words are one class; rows with a null doc_id take part and give
    their class no id; repeated rows are returned each; other columns are ignored.
    """
    rows = docs.select("doc_id", text_class(F.col("text")).alias("v"))
    of = class_components(docs)
    least = rows.groupBy("v").agg(F.min("doc_id").alias("least"))
    heads = of.join(least, "v").groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(of.join(heads, "component").select("v", "component_id"), "class-heads")
    return rows.join(named, "v").select("doc_id", "component_id")
