"""Exact Lloyd iterations by kd-tree filtering, in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import ship, stash
from lodestone.llm.vectors import matrix, scaled

#: Points of a tree, and of a leaf, at most.
TREE, LEAF = 4096, 8

TREES = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sums", pa.binary())])
SUMS = pa.schema([("cluster", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.int64())), ("distance", pa.int64())])


def edges(n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Start and end of each node of the tree over n points, and the number of inner nodes; children of i are 2i+1, 2i+2."""
    start, end, inner = [0], [n], 0
    while max(e - s for s, e in zip(start[inner:], end[inner:], strict=True)) > LEAF:
        for i in range(inner, len(start)):
            half = (start[i] + end[i]) // 2
            start += [start[i], half]
            end += [half, end[i]]
        inner = 2 * inner + 1
    return np.array(start), np.array(end), inner


@dataclass
class Tree:
    """Points in the order of the leaves; box and component sums of each node (its count is end - start)."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def __post_init__(self):
        self.start, self.end, self.inner = edges(len(self.points))


def build(points: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order of the points and their tree: each node is halved at the median of its widest component."""
    start, end, inner = edges(len(points))
    order = np.arange(len(points))
    for i in range(inner):
        own = order[start[i] : end[i]]
        x = points[own]
        order[start[i] : end[i]] = own[np.argpartition(x[:, np.argmax(x.max(0) - x.min(0))], len(own) // 2)]
    points = points[order]
    low, high, sums = (np.zeros((len(start), points.shape[1]), np.int64) for _ in range(3))
    for i in range(len(start) - 1, -1, -1):
        if i >= inner:
            own = points[start[i] : end[i]]
            low[i], high[i], sums[i] = own.min(0), own.max(0), own.sum(0)
        else:
            pair = slice(2 * i + 1, 2 * i + 3)
            low[i], high[i], sums[i] = low[pair].min(0), high[pair].max(0), sums[pair].sum(0)
    return order, Tree(points, low, high, sums)


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, cluster of each, True) for whole nodes, and (points, cluster of each, False) for the points of mixed leaves.

    Goes down the tree level by level. Of a node's centroids, one is taken that is nearest to the middle of its box; another is
    dropped where the corner of the box that lies farthest towards it is still strictly nearer to the first. Ties are
    never dropped, so that among equally near centroids the smaller number gets the point.
    """
    nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    far = np.iinfo(np.int64).max
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        middle = ((2 * centroids - (low + high)[:, None]) ** 2).sum(2)
        star = centroids[np.where(left, middle, far).argmin(1)][:, None]
        corner = np.where(centroids > star, high[:, None], low[:, None])
        left = left & (((centroids - star) * (centroids + star - 2 * corner)).sum(2) <= 0)
        whole = left.sum(1) == 1
        yield nodes[whole], left[whole].argmax(1), True
        nodes, left = nodes[~whole], left[~whole]
        leaf = nodes >= tree.inner
        size = (tree.end - tree.start)[nodes[leaf]]
        at = np.repeat(tree.start[nodes[leaf]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        distance = squared(tree.points[at], centroids)
        yield at, np.where(np.repeat(left[leaf], size, 0), distance, far).argmin(1), False
        nodes, left = nodes[~leaf], left[~leaf]
        nodes, left = np.concatenate([2 * nodes + 1, 2 * nodes + 2]), np.concatenate([left, left])


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, points by centroids, exact."""
    return (points**2).sum(1)[:, None] - 2 * (points @ centroids.T) + (centroids**2).sum(1)


def moved(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and component sums of each cluster's points."""
    count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for at, cluster, whole in filtered(tree, centroids):
        np.add.at(count, cluster, (tree.end - tree.start)[at] if whole else 1)
        np.add.at(sums, cluster, (tree.sums if whole else tree.points)[at])
    return count, sums


def labelled(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each point."""
    label = np.zeros(len(tree.points), np.int64)
    for at, cluster, whole in filtered(tree, centroids):
        if whole:
            for i, c in zip(at, cluster, strict=True):
                label[tree.start[i] : tree.end[i]] = c
        else:
            label[at] = cluster
    return label, ((tree.points - centroids[label]) ** 2).sum(1)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows as trees of at most TREE points, one row each."""
    ids: list = []
    rows: list[np.ndarray] = []

    def tree(n: int) -> pa.RecordBatch:
        nonlocal ids, rows
        x = np.vstack(rows)
        order, t = build(x[:n])
        own, ids, rows = [ids[i] for i in order], ids[n:], [x[n:]]
        return pa.RecordBatch.from_pylist([{"ids": own, "points": t.points.astype(np.int32).tobytes(), "low": t.low.astype(np.int32).tobytes(), "high": t.high.astype(np.int32).tobytes(), "sums": t.sums.tobytes()}], schema=TREES)

    for batch in batches:
        ids += batch.column("id").to_pylist()
        rows.append(matrix(batch.column("x")))
        while len(ids) >= TREE:
            yield tree(TREE)
    if ids:
        yield tree(len(ids))


def unpack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            small, exact = ([np.frombuffer(batch.column(c)[i].as_py(), kind).astype(np.int64).reshape(-1, width) for c in names] for kind, names in ((np.int32, ("points", "low", "high")), (np.int64, ("sums",))))
            yield batch.column("ids")[i].values, Tree(*small, *exact)


def start_hash(seed: int, vec_id):
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def k_means(rows: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with `width` usable components.

    Components count as floor(scale * component); every figure is an exact integer. Centroids start as the k vectors with the
    least sha256 of `seed:id`. Each partition's vectors are packed into kd-trees once, as a table in the shared folder; a
    round goes over the trees (`filtered`) and returns a count and a sum per cluster and component, k * (width + 1) numbers
    whatever the table's size. Rounds end early once no centroid moves, as nothing changes after that. No vector is
    exchanged between tasks.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Ties go to the smaller
    cluster; an empty cluster keeps its centroid. Fewer than k vectors: that many clusters. An empty table: no rows.
    Repeated rows and ids count each; of equal start hashes (repeated ids) the smaller vector comes first, rows without an id
    come last. Scaled components of 2 ** 23 or more raise an error. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    ints = scaled(rows.where(F.size(vector_col) == width), scale, id_col, vector_col)
    first = ints.orderBy(F.asc_nulls_last(start_hash(seed, F.col("id"))), "x").limit(k).collect()
    kinds = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], np.int64)
    trees = stash(ints.mapInArrow(pack, "ids array<long>, points binary, low binary, high binary, sums binary"), "trees")

    def totals(final: bool) -> dict:
        now = centroids

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, sums, far = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for _, tree in unpack(batches, width):
                if final:
                    np.add.at(far, labelled(tree, now)[0], labelled(tree, now)[1])
                else:
                    n, s = moved(tree, now)
                    count, sums = count + n, sums + s
            yield pa.RecordBatch.from_pylist([{"cluster": i, "rows": int(count[i]), "sums": sums[i].tolist(), "distance": int(far[i])} for i in range(len(now))], schema=SUMS)

        part = trees.mapInArrow(of, "cluster int, rows long, sums array<long>, distance long")
        if final:
            return {r["cluster"]: int(r["d"]) for r in part.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
        each = part.select("cluster", F.posexplode(F.concat("sums", F.array("rows"))).alias("at", "value"))
        return {(r["cluster"], r["at"]): int(r["v"]) for r in each.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()}

    for _ in range(rounds):
        at = totals(False)
        last = centroids
        centroids = np.array([[at[i, j] // at[i, width] for j in range(width)] if at[i, width] else last[i] for i in range(len(last))], np.int64)
        if (centroids == last).all():
            break
    inertia, now = totals(True), centroids

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in unpack(batches, width):
            label, far = labelled(tree, now)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(label, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    about = [(i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(now)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return trees.mapInArrow(final, kinds).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
