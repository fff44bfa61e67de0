"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

Trees are fitted on a bounded sample; their depth follows the number of rows,
so leaves stay small. Every different vector is indexed by the leaf it falls
into in each tree. A query takes branches of all trees from one queue, those
first whose splits it crosses by the least sum of squares, until that sum
exceeds a share of its squared radius: the distance, told by the sample,
within which its neighbours lie. So a query among near rows reads few leaves,
and one that has all rows at like distances reads many. The queries are sent
to the leaves they take, where the rows are compared exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, cut, lookup

#: Vectors that fit the trees and tell the radius; trees; rows a leaf aims at; sample rows a leaf has at least; rows of a leaf that one task compares.
SAMPLE, TREES, LEAF, LEAST, ROWS = 16_384, 8, 24, 8, 20_000
#: Share of the squared radius, as projected on a path of splits, at which the queue stops.
REACH = 0.08
#: Distances computed at a time.
BLOCK = 1 << 20


@lru_cache(maxsize=16)
def normals(tree: int, depth: int, width: int, seed: int = 11) -> np.ndarray:
    """Unit normals of a tree's inner nodes in heap order, alike in every process."""
    out = np.random.default_rng([seed, tree, width]).normal(size=((1 << depth) - 1, width))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit(sample: np.ndarray, trees: int, depth: int) -> list[np.ndarray]:
    """For each tree the thresholds of its inner nodes: medians of the sample."""
    forest = []
    for t in range(trees):
        own_normals = normals(t, depth, sample.shape[1])
        cuts, held = np.zeros((1 << depth) - 1), {0: np.arange(len(sample))}
        for node in range((1 << depth) - 1):
            own = held.pop(node)
            side = sample[own] @ own_normals[node]
            cuts[node] = np.median(side) if len(own) else 0.0
            held[2 * node + 1], held[2 * node + 2] = own[side <= cuts[node]], own[side > cuts[node]]
        forest.append(cuts)
    return forest


def leaves(rows: np.ndarray, tree: int, cuts: np.ndarray, depth: int) -> np.ndarray:
    node, own_normals = np.zeros(len(rows), np.int64), normals(tree, depth, rows.shape[1])
    for _ in range(depth):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", rows, own_normals[node]) > cuts[node])
    return node - ((1 << depth) - 1)


def route(query: np.ndarray, forest: list[np.ndarray], depth: int, reach: float) -> list[tuple[int, int]]:
    """(tree, leaf) that the shared queue gives up to ``reach``; the query's own leaves always."""
    inner = (1 << depth) - 1
    margins = [normals(t, depth, len(query)) @ query - cuts for t, cuts in enumerate(forest)]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found: list[tuple[int, int]] = []
    while queue:
        far, t, node = heapq.heappop(queue)
        if far > reach:
            break
        while node < inner:
            m = float(margins[t][node])
            near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            if not far + m * m > reach:
                heapq.heappush(queue, (far + m * m, t, other))
            node = near
        found.append((t, node - inner))
    return found


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences too large or small to be squared are scaled."""
    away = np.abs(rows - query)
    most = away.max(axis=1, initial=0.0)
    if ((most > 1e150) | ((most < 1e-150) & (most > 0))).any():
        scale = np.where((most > 0) & np.isfinite(most), most, 1.0)
        return scale * np.sqrt(((away / scale[:, None]) ** 2).sum(axis=1))
    return np.sqrt((away**2).sum(axis=1))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


_FOUND = "query long, point long, score double"


def _found(queries: list, points: list, scores: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0) for x in (queries, points, scores)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query", "point", "score"])


def compare(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int) -> pa.RecordBatch:
    """For each query the k nearest of the rows within its radius."""
    out: tuple[list, list, list] = ([], [], [])
    with np.errstate(over="ignore", invalid="ignore"):
        squares, own = (x**2).sum(axis=1), (q**2).sum(axis=1)
        step = max(1, BLOCK // max(1, len(x)))
        for at in range(0, len(q), step):
            size = own[at : at + step, None] + squares
            near = ~(size - 2 * q[at : at + step] @ x.T > radius[at : at + step, None] ** 2 * (1 + 1e-9) + size * 1e-12)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                some = np.flatnonzero(near[i])
                score = distances(x[some], q[at + i])
                some = some[score <= radius[at + i]] if np.isfinite(radius[at + i]) else some
                score = score[score <= radius[at + i]] if np.isfinite(radius[at + i]) else score
                order = np.lexsort((ids[some], score))[:k]
                out[0].append(np.full(len(order), asked[at + i]))
                out[1].append(ids[some[order]])
                out[2].append(score[order])
    return _found(*out)


def _rank(k: int):
    """Rows of a leaf, then its queries, leaf after leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            ids, radius, vectors = batch.column(4).to_numpy(), batch.column(5).to_numpy(), _matrix(batch.column(6))
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)]):
                place, asks = tuple(keys[a, :3].tolist()), keys[a, 3]
                if place != current:
                    current, held = place, []
                if not asks:
                    held.append((ids[a:b], vectors[a:b]))
                elif held:
                    if len(held) > 1:
                        held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                    yield compare(*held[0], ids[a:b], vectors[a:b], radius[a:b], k)

    return run


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part, one for each id."""
    x = F.col("embedding")
    number = embeddings.schema["embedding"].dataType.elementType.typeName()
    x = x if number in ("float", "double") else x.cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0))
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    return rows.join(F.broadcast(width.select("width")), F.size("vector") == F.col("width"), "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))


def candidates(points: DataFrame, asked: DataFrame, n: int, k: int, trees: int, leaf: int, reach: float) -> DataFrame:
    """query, point, score: points compared with each query that may be among its k nearest, some of them several times."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).toArrow()
    ids, seen = sample["point"].to_numpy(), _matrix(sample["vector"])
    width = seen.shape[1]
    depth = max(0, min(round(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(seen) / LEAST)))))
    with np.errstate(over="ignore", invalid="ignore"):
        forest = fit(seen, trees, depth)
    expected, vector = max(1, round(k * len(seen) / n)), points.schema["vector"].dataType.simpleString()
    own_type = pa.list_(pa.float32() if "float" in vector else pa.float64())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            own = np.concatenate([leaves(rows, t, cuts, depth) for t, cuts in enumerate(forest)])
            which = pa.array(np.tile(np.arange(len(rows)), trees))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees), len(rows)).astype(np.int32)), pa.array(own.astype(np.int32)), batch.column(0).take(which), batch.column(1).take(which)], names=["tree", "leaf", "id", "vector"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (one, query) in enumerate(zip(batch.column(0).to_pylist(), _matrix(batch.column(1)))):
                with np.errstate(over="ignore", invalid="ignore"):
                    far = distances(seen, query)
                order = np.lexsort((ids, far))
                order = order[ids[order] != one][:k]
                # The sample's nearest are found already; with k of them nothing farther is wanted.
                radius = float(far[order[-1]]) if len(order) == k else float("inf")
                near = float(far[order[min(expected, len(order)) - 1]]) if len(order) else 0.0
                taken = route(query, forest, depth, reach * near * near * depth / width)
                m = len(taken)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in taken], pa.int32()), pa.array([f for _, f in taken], pa.int32()), pa.array([one] * m, pa.int64()), pa.array([radius] * m, pa.float64()), batch.column(1).take(pa.array([i] * m, pa.int32()))], schema=pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("id", pa.int64()), ("radius", pa.float64()), ("vector", own_type)]))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, query in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
                with np.errstate(over="ignore", invalid="ignore"):
                    far = distances(seen, query)
                order = np.lexsort((ids, far))
                order = order[ids[order] != one][:k]
                yield _found([np.full(len(order), one)], [ids[order]], [far[order]])

    placed = points.select("point", "vector").mapInArrow(index, f"tree int, leaf int, id long, vector {vector}")
    sizes = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > ROWS).collect()  # at most trees * n / ROWS, and no more than there are leaves
    split = F.broadcast(spark.createDataFrame([(s.tree, s.leaf, 1 + s.n // ROWS) for s in sizes], "tree int, leaf int, parts int"))
    parts = F.coalesce("parts", F.lit(1))
    rows = placed.join(split, ["tree", "leaf"], "left").select("tree", "leaf", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("asks"), "id", F.lit(0.0).alias("radius"), "vector")
    taken = asked.select("point", "vector").mapInArrow(search, f"tree int, leaf int, id long, radius double, vector {vector}")
    taken = taken.join(split, ["tree", "leaf"], "left").select("tree", "leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("asks"), "id", "radius", "vector")
    key = ["tree", "leaf", "part"]
    compared = rows.unionByName(taken).repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(_rank(k), _FOUND)
    return compared.where("query <> point").unionByName(asked.select("point", "vector").mapInArrow(known, _FOUND))


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, trees: int = TREES, leaf: int = LEAF, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance, ties to the smaller id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates
    all rows but the query's own. Vectors that are null, zero, or hold null or
    non-finite components, and rows without id, take no part; nor do those of
    another length than most have (of equally frequent lengths the greatest
    counts). Of rows that repeat an id the least vector counts. Equal vectors
    are indexed once, with their k + 1 smallest ids, so that copies cost
    nothing. With at most ``leaf`` vectors the search is exact. An empty table
    gives no rows. Other columns are not read.
    """
    bounded(embeddings.sparkSession)
    usable = cut(usable_vectors(embeddings).withColumns({"a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(1), "vector")}))
    groups = cut(usable.groupBy("a", "b").agg(F.min("vec_id").alias("point"), F.count("*").alias("n")))
    n = groups.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = cut(usable.join(groups.select("point"), F.col("vec_id") == F.col("point"), "left_semi").select(F.col("vec_id").alias("point"), "vector"))
    of_row = cut(lookup(usable.select("vec_id", "a", "b"), groups, ["a", "b"], "n").select("vec_id", "point"))
    place = F.row_number().over(Window.partitionBy("point").orderBy("vec_id"))
    members = of_row.withColumn("place", place).where(F.col("place") <= k + 1).select("point", F.col("vec_id").alias("member"))
    queries = of_row.where(F.col("vec_id") % every == 0)
    sizes = cut(queries.groupBy("point").agg(F.count("*").alias("n")))
    found = candidates(points, points.join(sizes.select("point"), "point", "left_semi"), n, k, trees, leaf, reach)
    own = sizes.select(F.col("point").alias("query"), "point", F.lit(0.0).alias("score"))
    found = found.unionByName(own).dropDuplicates(["query", "point"])
    # A row among a query's nearest belongs to one of as many nearest points.
    by_point = F.row_number().over(Window.partitionBy("query").orderBy("score", "point"))
    best = found.withColumn("place", by_point).where(F.col("place") <= k + 1).join(members, "point")
    by_row = F.row_number().over(Window.partitionBy("query").orderBy("score", "member"))
    best = best.withColumn("place", by_row).where(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "member"))).alias("near")).withColumnRenamed("query", "point")
    lists = cut(lists.join(sizes, "point"))
    ranked = lookup(queries, lists, ["point"], "n")
    others = F.slice(F.filter("near", lambda x: x["member"] != F.col("vec_id")), 1, k)
    return ranked.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "o")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("o.member").alias("vec_id"), F.col("o.score").alias("score"))
