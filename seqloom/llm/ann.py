"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is linked to its exact nearest neighbours, and this graph is cut into
balanced parts: parts start from a balanced recursive split along principal axes, then vectors move to the
part that holds most of their neighbours as long as it has room. A small network learns which parts the
neighbours of a vector lie in. Every vector of the table is put into its most probable part; a query goes to
its most probable parts, and all vectors there are compared with it exactly.

Parts are compared in blocks of bounded size, so that a part with any share of all vectors, for instance
copies of one, is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import stored

SAMPLE = 8192
GRAPH = 20
HIDDEN = 64
COVER = 0.96
ROW_BLOCK = 4096
QUERY_BLOCK = 1024


def neighbour_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Indexes of the ``k`` largest inner products of each row with the others."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), dtype=np.int64)
    for lo in range(0, len(x) if k > 0 else 0, 1024):
        s = x[lo: lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo: lo + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Part of each vector: recursive halving along the main axis, then moves towards neighbours with room."""
    part = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        part[rows] = first
        if n < 2 or len(rows) < 2:
            continue
        y = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        half = len(rows) * (n // 2) // n
        order = np.argsort(y @ axis, kind="stable")
        todo += [(rows[order[:half]], first, n // 2), (rows[order[half:]], first + n // 2, n - n // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds if graph.shape[1] else 0):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        wish = votes.argmax(axis=1)
        load, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if load[wish[i]] < room:
                load[part[i]] -= 1
                load[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer that gives the probability of each part for a vector."""

    def __init__(self, x: np.ndarray, goal: np.ndarray, hidden: int = HIDDEN, epochs: int = 30, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(axis=0), x.std() + 1e-9
        self.p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, (1 / hidden) ** 0.5, (hidden, goal.shape[1])), np.zeros(goal.shape[1])]
        m, v, t = [0 * w for w in self.p], [0 * w for w in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                z = (x[order[lo: lo + 256]] - self.shift) / self.scale
                y = goal[order[lo: lo + 256]]
                h = np.maximum(z @ self.p[0] + self.p[1], 0)
                err = (self._soft(h @ self.p[2] + self.p[3]) - y) / len(z)
                back = (err @ self.p[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((z.T @ back, back.sum(0), h.T @ err, err.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] -= 0.003 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)

    @staticmethod
    def _soft(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum((x - self.shift) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part, all of one length."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (rows.select("vec_id", e.alias("embedding"))
            .where(F.col("embedding").isNotNull() & F.expr("exists(embedding, v -> v <> 0)") & fine
                   & F.col("vec_id").isNotNull()))


def fit(rows: DataFrame, parts: int | None = None, sample: int = SAMPLE) -> Router | None:
    """Learn from the ``sample`` vectors with the smallest hash of their id; None without vectors."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # bounded by `sample`
    if got.empty:
        return None
    x = np.array(got["embedding"].tolist())
    parts = parts or max(2, min(64, len(x) // 64))
    graph = neighbour_graph(x)
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x)), part), 1.0)
    if graph.shape[1]:
        np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    return Router(x, goal / goal.sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """The ``k`` best rows of each query but itself: (query index, row index, score), ties to smaller ids."""
    near = q @ x.T
    near[q_ids[:, None] == x_ids[None, :]] = -np.inf
    kth = -np.partition(-near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(q), -np.inf)
    kth = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)
    qi, xi = np.nonzero((near >= kth[:, None]) & (near > -np.inf))
    exact = np.concatenate([(q[qi[i: i + 8192]] * x[xi[i: i + 8192]]).sum(axis=1) for i in range(0, len(qi), 8192)]
                           or [np.zeros(0)])
    order = np.lexsort((x_ids[xi], -exact, qi))
    qi, xi, exact = qi[order], xi[order], exact[order]
    first = np.searchsorted(qi, np.arange(len(q)))
    keep = np.arange(len(qi)) - first[qi] < k
    return qi[keep], xi[keep], exact[keep]


def search(rows: DataFrame, queries: DataFrame, router: Router, k: int = 20, cover: float = COVER,
           row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``rows`` and ``queries`` as `usable` gives them: query_id, rank, vec_id, score.

    A query goes to its most probable parts until their probabilities sum up to ``cover``, and to further
    ones until the parts hold ``k`` vectors besides itself.
    """
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast(router)

    def place(batches):
        for b in batches:
            if len(b):
                part = model.value.probabilities(_matrix(b.column(1))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))],
                                                 names=["vec_id", "embedding", "part"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = stored(rows.mapInArrow(place, f"vec_id {kind}, embedding array<double>, part int"), "placed")
    loads = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # as many as parts
    n_queries = queries.count()
    query_blocks = max(1, -(-n_queries // query_block))
    row_blocks = {p: max(1, -(-n // row_block)) for p, n in loads.items()}

    def route(batches):
        for b in batches:
            if not len(b):
                continue
            likely = model.value.probabilities(_matrix(b.column(1)))
            order = np.argsort(-likely, axis=1, kind="stable")
            qi, parts, blocks = [], [], []
            for i, row in enumerate(order):
                seen, sure = 0, 0.0
                for p in row.tolist():
                    if sure >= cover and seen > k:
                        break
                    seen += loads.get(p, 0)
                    sure += likely[i, p]
                    for c in range(row_blocks.get(p, 0)):
                        qi.append(i)
                        parts.append(p)
                        blocks.append(c)
            at = pa.array(qi)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(parts, pa.int32()), pa.array(blocks, pa.int32())],
                names=["query_id", "query", "part", "block"])

    routed = (queries.mapInArrow(route, f"query_id {kind}, query array<double>, part int, block int")
              .withColumn("query_block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(query_blocks)).cast("int")))
    sizes = F.create_map(*[F.lit(int(x)) for kv in row_blocks.items() for x in kv]) if row_blocks else None
    cells = placed if sizes is None else placed.withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.lit(5)), sizes[F.col("part")]).cast("int"))
    cells = cells.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, x_ids = (t.column(0).combine_chunks() for t in (left, right))
        if not len(q_ids) or not len(x_ids):
            qi = xi = np.zeros(0, dtype=np.int64)
            s = np.zeros(0)
        else:
            qi, xi, s = best(_matrix(left.column(1)), q_ids.to_numpy(), _matrix(right.column(1)), x_ids.to_numpy(), k)
        return pa.table({"query_id": q_ids.take(pa.array(qi)), "vec_id": x_ids.take(pa.array(xi)), "score": pa.array(s)})

    key = ["part", "block", "query_block"]
    found = (routed.select("query_id", "query", *key).groupBy(*key)
             .cogroup(cells.select("vec_id", "embedding", *key).groupBy(*key))
             .applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_learned_partitions(spark: SparkSession, rows: DataFrame, k: int = 20) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no
    part. Equal scores go to the smaller id. A repeated id is a candidate for each of its rows, but not for
    itself. An empty table gives no rows.
    """
    fine = usable(rows)
    router = fit(fine)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = fine.where(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"])
    return search(fine, queries, router, k)
