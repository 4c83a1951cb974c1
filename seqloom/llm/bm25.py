"""Exact top-k search: an inverted index with block-max pruning for BM25, per shard, merged exactly.

The index is built in one pass without a shuffle. A task gathers documents up to a bounded size into a
shard, in which they are numbered. A shard has, for each of 64 ranges of term hashes, one row with its terms
and their postings (document number, term frequency), and one row with the ids and lengths of its documents.
In each block of ``BLOCK`` document numbers, a term's largest frequency and smallest length bound its weight.

A search first adds up the global statistics: number of documents, average length, document frequencies of
the query terms. Each shard then answers all queries of a block. Summing the block maxima of a query's
terms bounds every block of documents; blocks are taken by falling bound, and none that cannot reach the
k-th best score so far is opened. In an open block a document is a candidate (a pivot) only if the block
maxima of the terms it holds reach that score; only candidates are scored. Scores are sums in the order of
terms, in double precision; the k best of all shards are merged.

Terms are words with A-Z in lower case, told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER, UPPER, stored
from seqloom.llm.lm import _blob, _unblob, token_hashes

K1, B = 1.2, 0.75
BLOCK = 64
SHARD_DOCS = 16_384
SHARD_WORDS = 4 << 20
RANGES = 64
QUERY_BLOCK = 256
DIGITS = 9


def _shard_rows(shard: int, ids: list[int], docs: list[np.ndarray]) -> pa.RecordBatch:
    lengths = np.array([len(d) for d in docs], dtype="<u4")
    own = [np.unique(d, return_counts=True) for d in docs]
    sizes = [len(u) for u, _ in own]
    term = np.concatenate([u for u, _ in own])
    tf = np.concatenate([c for _, c in own]).astype("<u4")
    doc = np.repeat(np.arange(len(docs), dtype="<u4"), sizes)
    order = np.argsort(term, kind="stable")
    term, tf, doc = term[order], tf[order], doc[order]
    terms, first, df = np.unique(term, return_index=True, return_counts=True)
    part = (terms >> np.uint64(58)).astype(np.int64)
    rows, names = [_blob(np.array(ids, dtype="<i8"), lengths)], [-1]
    for r in np.unique(part):
        i, j = np.searchsorted(part, [r, r + 1])
        lo, hi = first[i], first[j - 1] + df[j - 1]
        rows.append(_blob(terms[i:j], df[i:j].astype("<u4"), doc[lo:hi], tf[lo:hi]))
        names.append(int(r))
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * n, pa.int64()), pa.array(names, pa.int32()), pa.array([len(docs)] * n, pa.int64()),
         pa.array([int(lengths.sum())] * n, pa.int64()), pa.array(rows, pa.binary())],
        names=["shard", "part", "n_docs", "n_words", "data"])


def build_index(docs: DataFrame) -> DataFrame:
    """Index the whole texts of ``docs`` (doc_id, text) and store the index in the shared folder.

    Rows without an id take no part; a null text counts as empty; repeated rows are documents of their own.
    """
    def run(batches):
        shard, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                held.append(token_hashes(t.as_py())[:-1])
                size += len(held[-1])
                if len(ids) >= SHARD_DOCS or size >= SHARD_WORDS:
                    yield _shard_rows(shard, ids, held)
                    shard, ids, held, size = shard + 1, [], [], 0
        if ids:
            yield _shard_rows(shard, ids, held)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return stored(rows.mapInArrow(run, "shard long, part int, n_docs long, n_words long, data binary"), "inverted-index")


def impact(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class Postings:
    """A term's postings in a shard, with the bounds of its blocks."""

    def __init__(self, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray, average: float):
        self.doc, self.tf = doc.astype(np.int64), tf.astype(np.float64)
        block = self.doc // BLOCK
        self.blocks, self.first = np.unique(block, return_index=True)
        self.end = np.append(self.first[1:], len(block))
        self.most = impact(np.maximum.reduceat(self.tf, self.first),
                           np.minimum.reduceat(lengths[self.doc].astype(np.float64), self.first), average)


def top_k(terms: list[tuple[float, Postings]], ids: np.ndarray, lengths: np.ndarray, average: float,
          k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Document numbers and scores of the k best (ties to smaller ids), and how many documents were scored."""
    bound = np.zeros(-(-len(ids) // BLOCK))
    for weight, p in terms:
        bound[p.blocks] += weight * p.most
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    docs, scores, least, scored, at, step = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf, 0, 0, 4
    while at < len(order):
        some = order[at: at + step]
        some = some[bound[some] >= least - 1e-7]
        if not len(some):
            break
        at, step = at + step, min(step * 2, 64)
        slot = np.full(len(bound), -1, dtype=np.int64)
        slot[some] = np.arange(len(some))
        reach, parts = np.zeros(len(some) * BLOCK), []
        for weight, p in terms:
            own = np.flatnonzero(slot[p.blocks] >= 0)
            if not len(own):
                continue
            sizes = p.end[own] - p.first[own]
            i = np.repeat(p.first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            local = slot[p.doc[i] // BLOCK] * BLOCK + p.doc[i] % BLOCK
            reach[local] += np.repeat(weight * p.most[own], sizes)
            parts.append((weight, p, i, local))
        pivot = (reach > 0) & (reach >= least - 1e-7)
        total = np.zeros(len(reach))
        for weight, p, i, local in parts:
            keep = pivot[local]
            i, local = i[keep], local[keep]
            total[local] += weight * impact(p.tf[i], lengths[p.doc[i]].astype(np.float64), average)
        found = np.flatnonzero(pivot)
        scored += len(found)
        docs = np.concatenate([docs, some[found // BLOCK] * BLOCK + found % BLOCK])
        scores = np.concatenate([scores, total[found]])
        best = np.lexsort((ids[docs], -np.round(scores, DIGITS)))[:k]
        docs, scores = docs[best], scores[best]
        if len(docs) == k:
            least = scores.min()
    return docs, scores, scored


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``queries`` (query_id, text): query_id, rank, doc_id, score (rounded to 9 digits).

    Repeated terms of a query count each time. Only documents that hold a term of the query are found;
    queries without such documents, empty or null, have no rows. Queries with an equal id and text are
    answered once; those with an equal id and different texts are answered each. Ties go to the smaller id.
    """
    spark = index.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", "text").where("query_id IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks)))
    n, words = index.where("part = -1").agg(F.coalesce(F.sum("n_docs"), F.lit(0)),
                                            F.coalesce(F.sum("n_words"), F.lit(0))).first()
    average = max(1.0, float(words)) / max(1, n)
    found = [_search_block(index, [(r["query_id"], r["text"]) for r in asked.where(F.col("block") == b)
                                   .orderBy("query_id", "text").collect()], int(n), average, k, kind)
             for b in range(blocks)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "doc_id")
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def _search_block(index: DataFrame, rows: list[tuple], n: int, average: float, k: int, kind: str) -> DataFrame:
    asked = [np.unique(token_hashes(text)[:-1], return_counts=True) for _, text in rows]
    terms = np.unique(np.concatenate([a[0] for a in asked] or [np.zeros(0, dtype=np.uint64)]))
    parts = sorted({int(x) for x in terms >> np.uint64(58)})
    numbers = [r[0] for r in rows]

    def pick(batches):
        for b in batches:
            for shard, part, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
                                                      pa.array([data], pa.binary())], names=["shard", "term", "df", "data"])
                    continue
                own, df, doc, tf = _unblob(data, "<u8", "<u4", "<u4", "<u4")
                ends = np.cumsum(df, dtype=np.int64)
                at = np.flatnonzero(np.isin(own, terms, assume_unique=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(at), pa.int64()), pa.array(np.searchsorted(terms, own[at])),
                     pa.array(df[at].astype(np.int64)),
                     pa.array([_blob(doc[ends[i] - df[i]: ends[i]], tf[ends[i] - df[i]: ends[i]]) for i in at], pa.binary())],
                    names=["shard", "term", "df", "data"])

    picked = stored(index.where(F.col("part").isin([-1, *parts])).select("shard", "part", "data")
                    .mapInArrow(pick, "shard long, term long, df long, data binary"), "query-postings")
    df = np.zeros(len(terms))
    for r in picked.where("term >= 0").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of the block
        df[r["term"]] = r["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = [[(int(i), float(idf[i] * c)) for i, c in zip(np.searchsorted(terms, t), counts)] for t, counts in asked]

    def answer(key, group):
        ids, lengths, lists = np.zeros(0, dtype=np.int64), np.zeros(0), {}
        heads = group.column("term").to_pylist()
        data = group.column("data")
        at = heads.index(-1)
        ids, lengths = _unblob(data[at].as_py(), "<i8", "<u4")
        for i, t in enumerate(heads):
            if t >= 0:
                lists[t] = Postings(*_unblob(data[i].as_py(), "<u4", "<u4"), lengths, average)
        out = [], [], [], []
        for number, weighted in enumerate(weights):
            docs, scores, _ = top_k([(w, lists[t]) for t, w in weighted if t in lists], ids, lengths, average, k)
            out[0].extend([numbers[number]] * len(docs))
            out[1].extend([number] * len(docs))
            out[2].extend(ids[docs].tolist())
            out[3].extend(np.round(scores, DIGITS).tolist())
        return pa.table({"query_id": pa.array(out[0], query_type), "query_no": pa.array(out[1], pa.int32()),
                         "doc_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    query_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return picked.groupBy("shard").applyInArrow(answer, f"query_id {kind}, query_no int, doc_id long, score double")


def op3_bm25_block_max(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten documents most relevant to each text of ``benchmark``: item_id, rank, doc_id, score."""
    found = search(build_index(docs), items.select(F.col("item_id").alias("query_id"), "text"), 10)
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, greatest(1, sum(len(w))) / count(*) AS average FROM d),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d),
f AS (SELECT doc_id, dl, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, s GROUP BY term, n),
r AS (SELECT item_id, doc_id,
             round(sum(qtf * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / average))), {DIGITS}) AS score
      FROM q JOIN f USING (term) JOIN i USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10
"""
