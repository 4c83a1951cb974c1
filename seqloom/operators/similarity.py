"""Similarity edges between segments: exact thresholded k-nearest-neighbour search under DTW.

Result of the search for a source: its ``k`` nearest series (itself included, ties by lowest
id), those within the threshold, minus itself; ``same`` for distance 0, otherwise ``sim``.
Sources are all segments but those that an identical pattern with a higher id already answered.

How it stays exact without comparing everything with everything:

* DTW is 0 exactly if the run-collapsed series are equal. Classes of equal patterns are counted
  and cut to their ``k`` lowest ids before any pair is formed, so a class with a third of all
  rows costs a linear number of edges;
* a class of at most ``k`` members has one source; larger classes need no distance at all;
* targets with bit-identical series are one row with its ``k`` lowest ids;
* first, last, largest and smallest value of two series differ by at most their DTW. These four
  numbers form a grid, and the join on grid cells is a plain equi-join; hot cells are split;
* radii grow: sources with ``k`` hits within a small radius are finished, and only the others,
  those in sparse regions, are searched with the full threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.config import DEFAULT, Config
from seqloom.functions import kernels
from seqloom.functions.series import collapsed, resample
from seqloom.session import ensure_checkpoint_dir, parallelism

FEATURES = ("f_first", "f_last", "f_max", "f_min")
BLOCK = 64  # series of one block: the sources that the kernel compares with a table of targets at once
KEY_BLOCKS = 64  # target (or source) blocks of one grid cell that share a join key
BUCKET_ROWS = 32_768  # rows of the cells that meet in one call of the kernel


def features(df: DataFrame, series: str) -> DataFrame:
    x = F.col(series)
    return df.withColumns({"f_first": F.get(x, F.lit(0)), "f_last": F.element_at(x, -1),
                           "f_max": F.array_max(x), "f_min": F.array_min(x)})


def lowest_ids(rows: DataFrame, group: str, k: int, *carry: str) -> DataFrame:
    """The ``k`` lowest ids of each group, in order.

    The rank filter is applied per partition before the shuffle, so large groups shrink first. Groups are sorted by
    their hash: a sort of arrays compares them element by element.
    """
    rows = rows.select(F.xxhash64(group).alias("_h"), group, "id", *carry)
    w = Window.partitionBy("_h", group).orderBy("id")
    few = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return few.groupBy("_h", group).agg(F.array_sort(F.collect_list("id")).alias("ids"),
                                        *[F.first(c).alias(c) for c in carry]).drop("_h")


def source_cells(sources: DataFrame, cells: list[str], feats: tuple[str, ...]) -> DataFrame:
    """One row per grid cell within a source's ``radius``: at most two cells per feature."""
    for c, f in zip(cells, feats):
        low, high = F.col(f) - F.col("radius") - 1e-9, F.col(f) + F.col("radius") + 1e-9
        sources = sources.withColumn(
            c, F.explode(F.sequence(F.floor(low / F.col("width")), F.floor(high / F.col("width")))))
    return sources


@F.arrow_udf(T.BinaryType())
def packed(series: pa.Array) -> pa.Array:
    """A series as the bytes of its doubles.

    Pairs outnumber series by far, and bytes cross to the kernel as they are, while arrays are
    converted element by element.
    """
    values = np.ascontiguousarray(series.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    ends = np.concatenate([[0], np.cumsum(series.value_lengths().to_numpy(zero_copy_only=False))])
    return pa.Array.from_buffers(pa.binary(), len(series), [
        None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array) -> np.ndarray:
    """Equally long packed series as rows of a matrix, without a copy."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.float64)[ends[0] // 8:ends[-1] // 8]
    return flat.reshape(len(column), -1)


def _leaves(column: pa.Array) -> list[pa.Array]:
    """The plain columns of a column of ids, which may be structs."""
    if pa.types.is_struct(column.type):
        return [x for part in column.flatten() for x in _leaves(part)]
    return [column]


def k_best(source: np.ndarray, distance: np.ndarray, group: pa.Array, k: int) -> np.ndarray:
    """Which hits are among the ``k`` of smallest (distance, group) of their source, in any order."""
    keys = {f"g{i}": c for i, c in enumerate(_leaves(group))}
    table = pa.table({"s": pa.array(source), "d": pa.array(distance), **keys})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names]).to_numpy()
    sorted_source = source[order]
    first = np.maximum.accumulate(np.where(np.diff(sorted_source, prepend=-1) != 0, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def within_radius(sources: DataFrame, targets: DataFrame, radius: float,
                  by: tuple[str, ...] = (), k: int | None = None) -> DataFrame:
    """``(source, group, distance)`` with a DTW of at most the radius; with ``k``, all that may be among the k nearest.

    ``sources(source, sx)`` and ``targets(group, tx)`` have series of one common length. The sources and the targets of a
    grid cell meet as two tables: each series is sent once per cell and not once per pair, all pairs are tested against
    the bounds in the kernel, and only hits leave it; of the hits of a source among the targets of a table only the ``k``
    nearest (ties to the lower group), however dense its surroundings are. A cell with more than ``KEY_BLOCKS`` blocks of
    targets or sources is spread over several keys by hashed ids. Columns ``by`` of both sides have to be equal, too.
    """
    return _within_radius(searchable(sources, "source", "sx", by), searchable(targets, "group", "tx", by), radius, by, k)


def searchable(rows: DataFrame, name: str, series: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The packed series with the features that no radius changes."""
    return features(rows, series).select(name, packed(series).alias(series), *by, *FEATURES)


def _within_radius(sources: DataFrame, targets: DataFrame, radius: float, by: tuple[str, ...], k: int | None) -> DataFrame:
    """`within_radius` of rows that are `searchable`."""
    grid = [f"_c{i}" for i in range(len(FEATURES))]
    cells = [*by, *grid]
    t = targets.select("group", "tx", *by, *[F.floor(F.col(f) / F.lit(2.0 * radius)).alias(c) for c, f in zip(grid, FEATURES)])
    s = sources.withColumns({"radius": F.lit(float(radius)), "width": F.lit(2.0 * radius)})
    s = source_cells(s, grid, FEATURES).select("source", "sx", *cells)

    def keys(rows: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return rows.groupBy(*cells).agg(n.alias(name), F.ceil(n / (BLOCK * KEY_BLOCKS)).cast("int").alias(f"{name}_keys"))

    # cells that only one side has rows in are left out; the others are numbered, once
    ensure_checkpoint_dir(sources.sparkSession)
    counts = (keys(t, "_t").join(keys(s, "_s"), cells).withColumn("cell", F.monotonically_increasing_id()).checkpoint())
    rows = counts.agg(F.sum(F.col("_t") * F.col("_s_keys") + F.col("_s") * F.col("_t_keys"))).first()[0] or 0
    parts = parallelism(sources.sparkSession)
    buckets = max(parts, -(-rows // BUCKET_ROWS))
    counts = counts.select(*cells, "cell", "_t_keys", "_s_keys")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    bucket = F.pmod(F.xxhash64("cell", "_skey", "_tkey"), F.lit(buckets)).alias("bucket")
    t = (t.join(counts, cells).withColumn("_tkey", own("group", "_t_keys")).withColumn("_skey", each("_s_keys"))
         .select(bucket, "cell", "_skey", "_tkey", "group", "tx"))
    s = (s.join(counts, cells).withColumn("_skey", own("source", "_s_keys")).withColumn("_tkey", each("_t_keys"))
         .select(bucket, "cell", "_skey", "_tkey", "source", "sx"))
    schema = T.StructType([T.StructField("source", s.schema["source"].dataType),
                           T.StructField("group", t.schema["group"].dataType),
                           T.StructField("distance", T.DoubleType())])

    block = BLOCK

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sids, gids = (x.column(c).combine_chunks() for x, c in ((left, "source"), (right, "group")))
        ia, ic, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(sids) and len(gids):
            key = [np.concatenate([x.column(c).to_numpy() for x in (left, right)]) for c in ("cell", "_skey", "_tkey")]
            _, cell = np.unique(np.column_stack(key), axis=0, return_inverse=True)
            cell = cell.reshape(-1)
            ia, ic, d = kernels.near_pairs(unpacked(left.column("sx").combine_chunks()),
                                           unpacked(right.column("tx").combine_chunks()), radius, k,
                                           cell[:len(sids)], cell[len(sids):], block)
            if k is not None and len(ia):
                keep = k_best(ia, d, gids.take(pa.array(ic)), k)
                ia, ic, d = ia[keep], ic[keep], d[keep]
        return pa.table([sids.take(pa.array(ia)), gids.take(pa.array(ic)), pa.array(d)], names=["source", "group", "distance"])

    # few bytes and much work: the number of partitions is not merged by size
    return (s.repartition(parts, "bucket").groupBy("bucket").cogroup(t.repartition(parts, "bucket").groupBy("bucket"))
            .applyInArrow(run, schema))


def _nearest(hits: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ids per source.

    Groups of equal targets are ranked by (distance, lowest id) before their ids are unfolded:
    a group after the k-th has k better ids before it.
    """
    w = Window.partitionBy("source").orderBy("distance", "group")
    few = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    ids = few.join(groups, "group").select("source", "distance", F.explode("ids").alias("target"))
    w = Window.partitionBy("source").orderBy("distance", "target")
    return ids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_within(sources: DataFrame, targets: DataFrame, k: int, threshold: float,
                   radii: tuple[float, ...] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``k`` nearest targets of each source within the threshold, by growing radii.

    ``sources(source, sx)``, ``targets(tx, ids)``; sources and ids are unique. Everything within a radius is found before
    the next one, so a source with ``k`` hits is complete.
    """
    radii = radii or (threshold / 4, threshold / 2, threshold)
    ensure_checkpoint_dir(sources.sparkSession)
    # every round reads both sides twice; what they are made from is not made again
    sources = searchable(sources.select("source", "sx", *by), "source", "sx", by).checkpoint()
    targets = targets.withColumn("group", F.get("ids", F.lit(0))).checkpoint()
    # pairs carry the lowest id of a group of equal targets; the other ids are joined at the end
    groups = targets.select("group", "ids")
    targets = searchable(targets.select("group", "tx", *by), "group", "tx", by).checkpoint()
    done = None
    for radius in radii:
        last = radius == radii[-1]
        found = _nearest(_within_radius(sources, targets, radius, by, k), groups, k)
        if last:
            return found if done is None else done.unionByName(found)
        # read by both branches below; storing it also cuts the lineage of the next round
        found = found.checkpoint()
        full = found.groupBy("source").count().filter(F.col("count") >= k).select("source")
        finished = found.join(full, "source", "left_semi")
        sources = sources.join(full, "source", "left_anti").checkpoint()
        done = finished if done is None else done.unionByName(finished)
    return done


def similarity_edges(segments: DataFrame, cfg: Config = DEFAULT,
                     radii: tuple[float, ...] | None = None) -> DataFrame:
    """``source, target, distance, type`` from ``segments(id, ts)``; ids are any sortable type."""
    k = cfg.num_searches
    # the searchable data set: read by every branch below, so it is stored once
    ensure_checkpoint_dir(segments.sparkSession)
    rows = (segments.select("id", resample(F.col("ts"), cfg.resampling_size).alias("tx"))
            .withColumn("class", collapsed(F.col("tx"))).withColumn("hash", F.xxhash64("class")).checkpoint())
    # arrays are grouped and joined by their hash first: a sort of arrays compares them element by element
    classes = rows.groupBy("hash", "class").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("source"),
                                                F.max_by("tx", "id").alias("sx")).checkpoint()
    targets = lowest_ids(rows, "tx", k, "class").checkpoint()
    small = classes.filter(F.col("size") <= k).select("source", "sx")
    near = nearest_within(small, targets.drop("class"), k, cfg.dist_threshold, radii)
    sim = near.filter(F.col("source") != F.col("target")).select("source", "target", "distance")
    # large classes: the members beyond the first k find exactly those k
    heads = lowest_ids(targets.select("class", F.explode("ids").alias("id")), "class", k)
    big = classes.filter(F.col("size") > k).select("hash", "class").join(heads.withColumn("hash", F.xxhash64("class")), ["hash", "class"])
    same = (rows.select("id", "hash", "class").join(big, ["hash", "class"])
            .filter(F.col("id") > F.element_at("ids", -1))
            .select(F.col("id").alias("source"), F.explode("ids").alias("target"),
                    F.lit(0.0).alias("distance")))
    return (sim.unionByName(same)
            .withColumn("type", F.when(F.col("distance") == 0, F.lit("same")).otherwise(F.lit("sim")))
            .withColumn("distance", F.round("distance", 2)))


def series_of(column: pa.Array) -> list[np.ndarray]:
    """The series of a column of arrays, cut out of its values; a null series is empty."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(column) else []


def pair_distances(pairs: DataFrame, metric: str, constraint: str | None = None,
                   cfg: Config = DEFAULT, left: str = "a", right: str = "b") -> DataFrame:
    """Distance of the two series of each row; replaces the series by ``distance``.

    ``metric``: ``dtw``, ``ctw``, ``lcss`` or ``softdtw`` (which has no constraint).
    """
    keep = [c for c in pairs.columns if c not in (left, right)]
    schema = pairs.select(*keep).schema.add("distance", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = kernels.distances(metric, series_of(b.column(left)), series_of(b.column(right)),
                                  constraint, cfg.sakoe_chiba_radius,
                                  cfg.itakura_max_slope, cfg.lcss_eps, cfg.soft_gamma)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(np.round(d, 9))],
                                             names=[*keep, "distance"])

    return pairs.mapInArrow(run, schema)


def find_similar(query: Column, dataset: DataFrame, k: int, threshold: float, metric: str = "dtw",
                 constraint: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The ``k`` nearest rows of ``dataset(id, ts)`` to one given series, then the threshold.

    ``metric``: ``euclidean``, for series of one length, or one of `pair_distances`. Ranked by the
    distance before it is rounded, ties to the smaller id. One scan: every batch keeps the rows no
    farther than its k-th, and the ranking of these is a top-k without a full sort.
    """
    rows = dataset.select("id", F.col("ts").alias("a"), query.alias("b"))
    if metric == "euclidean":
        squares = F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))
        near = rows.select("id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d)).alias("distance"))
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = kernels.distances(metric, series_of(b.column("a")), series_of(b.column("b")), constraint,
                                      cfg.sakoe_chiba_radius, cfg.itakura_max_slope, cfg.lcss_eps, cfg.soft_gamma)
                keep = np.arange(len(d)) if len(d) <= k else np.flatnonzero(~(d > np.partition(d, k - 1)[k - 1]))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep)), pa.array(d[keep])],
                                                 names=["id", "distance"])

        near = rows.mapInArrow(run, rows.select("id").schema.add("distance", "double"))
    top = near.orderBy("distance", "id").limit(k)
    return top.filter(F.col("distance") <= threshold).withColumn("distance", F.round("distance", 6))


def find_similar_fromidx(idx, dataset: DataFrame, k: int, threshold: float, metric: str = "dtw",
                         constraint: str | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The same for a member of the dataset: it counts among the ``k`` and is then left out."""
    own = dataset.filter(F.col("id") == F.lit(idx)).select("ts").scalar()
    query = F.coalesce(own, F.raise_error(F.lit(f"no series has the id {idx!r}")))
    return find_similar(query, dataset, k, threshold, metric, constraint, cfg).filter(F.col("id") != F.lit(idx))
