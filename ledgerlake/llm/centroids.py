"""Centroid clustering: exact integer k-means by filtering kd-trees of each partition (operator 11).

Vectors are rounded to integers and put into kd-trees where they are read; a node holds its count,
integer sums and box. Each round walks the trees with the centroids: those strictly farther than
another one from a whole box are dropped, a node with one left is assigned whole, a leaf is resolved
point by point. Only sums by cluster leave a task.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialised

COMPONENTS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
#: Vectors of a leaf and of a tree, at most; a partition has as many trees as it needs.
LEAF = 48
TREE = 8_192


def bound(components: int) -> int:
    """Integers are cut off at this much on both sides of zero, so that all arithmetic on them is exact in 64 bits."""
    return math.isqrt((1 << 60) // components)


def kept_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id and v, floor(scale * x) of each component, of the vectors with exactly so many components, none null or not finite."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    most = float(bound(components))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))).cast("int")
    given = df.select(F.col(f"`{key}`").alias("id"), x.alias("x"))
    return given.where(F.coalesce((F.size("x") == components) & F.forall("x", finite), F.lit(False))).select("id", F.transform("x", whole).alias("v"))


def first_centroids(kept: DataFrame, clusters: int) -> list[list[int]]:
    """Vectors with the smallest SHA-256 of "2:<id>", in the order of the hash; of equal ids the smaller vector first, and a null id counts as empty text."""
    mark = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in kept.orderBy(mark, "v").limit(clusters).select("v").collect()]


class Tree:
    """A kd-tree over integer points, in arrays; node 0 is the root, and points stand in the order of the leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        order, spans, low, high, sums, below = np.arange(n), [], [], [], [], []
        open_nodes = [(0, n, -1)]
        while open_nodes:
            start, end, above = open_nodes.pop()
            node, own = len(spans), points[order[start:end]]
            if above >= 0:
                below[above].append(node)
            spans.append((start, end))
            below.append([])
            low.append(own.min(0))
            high.append(own.max(0))
            sums.append(own.sum(0, dtype=np.int64))
            wide = int(np.argmax(high[-1].astype(np.int64) - low[-1]))
            if end - start > leaf and high[-1][wide] > low[-1][wide]:
                middle = (end - start) // 2
                order[start:end] = order[start:end][np.argpartition(own[:, wide], middle)]
                open_nodes += [(start + middle, end, node), (start, start + middle, node)]
        self.order, self.points = order, points[order]
        self.spans, self.below = spans, below
        self.low, self.high, self.sums = np.array(low), np.array(high), np.array(sums)

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster of each point, and count and sums of each cluster. Equal distances go to the smaller number."""
        k, d = centroids.shape
        largest = max(int(np.abs(self.low).max()), int(np.abs(self.high).max()), int(np.abs(centroids).max()))
        kind = np.float64 if d * (4 * largest) ** 2 < 1 << 53 else np.int64  # both exact
        c, low, high, points = (x.astype(kind) for x in (centroids, self.low, self.high, self.points))
        norms = (c * c).sum(1)
        labels, counts, sums = np.empty(len(points), np.int64), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        todo = [(0, np.arange(k))]
        while todo:
            node, near = todo.pop()
            start, end = self.spans[node]
            if len(near) > 1:
                star = near[np.argmin(norms[near] - c[near] @ (low[node] + high[node]))]
                away = c[near] - c[star]
                # the corner of the box that is farthest in each centroid's direction: even there the star is strictly nearer
                corner = np.maximum(away * low[node], away * high[node]).sum(1)
                near = near[norms[near] - norms[star] - 2 * corner <= 0]
            if len(near) == 1:
                labels[start:end] = near[0]
                counts[near[0]] += end - start
                sums[near[0]] += self.sums[node]
            elif self.below[node]:
                todo += [(x, near) for x in self.below[node]]
            else:
                own = near[np.argmin(norms[near] - 2 * (points[start:end] @ c[near].T), axis=1)]
                labels[start:end] = own
                counts += np.bincount(own, minlength=k)
                np.add.at(sums, own, self.points[start:end].astype(np.int64))
        return labels, counts, sums


def grow_trees(kept: DataFrame, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """ids and tree of up to ``tree`` vectors of one partition, in the order of the leaves."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)), T.StructField("tree", T.BinaryType())])

    def grown(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        t = Tree(np.concatenate(points), leaf)
        ordered = pa.concat_arrays(ids).take(pa.array(t.order))
        t.order = None
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ordered)], ordered), pa.array([pickle.dumps(t)], pa.binary())], ["ids", "tree"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for b in batches:
            for part in (b.slice(i, tree) for i in range(0, b.num_rows, tree)):
                if n + part.num_rows > tree:
                    yield grown(ids, points)
                    ids, points, n = [], [], 0
                ids.append(part.column(0))
                points.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                n += part.num_rows
        if n:
            yield grown(ids, points)

    return kept.mapInArrow(work, kind)


def sums_of_clusters(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Counts and sums of each cluster; a task gives one row for each cluster and component, and so does the driver get."""
    k, d = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)
        for b in batches:
            for data in b.column("tree"):
                _, counts, sums = pickle.loads(data.as_py()).filtered(centroids)
                total += np.column_stack([sums, counts])
        place = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(place[0]), pa.array(place[1]), pa.array(total.ravel())], ["cluster", "component", "total"])

    found = trees.select("tree").mapInArrow(work, "cluster bigint, component bigint, total bigint").groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()
    out = [[0] * (d + 1) for _ in range(k)]
    for r in found:
        out[r["cluster"]][r["component"]] = r["total"]
    return np.array([x[d] for x in out]), [x[:d] for x in out]


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector."""
    kind = T.StructType([T.StructField("id", trees.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data in zip(b.column("ids"), b.column("tree"), strict=True):
                tree = pickle.loads(data.as_py())
                labels = tree.filtered(centroids)[0]
                away = tree.points.astype(np.int64) - centroids[labels]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(labels.astype(np.int32)), pa.array((away * away).sum(1))], ["id", "cluster", "distance"])

    return trees.mapInArrow(work, kind)


def fit_centroids(trees: DataFrame, start: Sequence[Sequence[int]], rounds: int) -> np.ndarray:
    """Centroids after so many rounds: exact floors of the means, and an empty cluster's centroid stays."""
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        counts, sums = sums_of_clusters(trees, centroids)
        centroids = np.array([[s // int(n) for s in row] if n else old for n, row, old in zip(counts, sums, centroids.tolist(), strict=True)], np.int64)
    return centroids


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _by_cluster(values: Sequence, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)


def cluster_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, tree: int = TREE, leaf: int = LEAF
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors with exactly ``components`` components, none null or not finite; components beyond
    ``bound`` once scaled are cut off there. The first ``clusters`` kept vectors in the order of a hash of
    their ids start; with fewer vectors there are as many clusters. Null and repeated ids are rows of their
    own. Sums of distances beyond 64 bits are null. No kept vector, no row. Other columns aren't read.
    """
    if components > 1 << 16 or clusters < 1:
        raise ValueError("at least one cluster and at most 65,536 components")
    kept = kept_vectors(df, key, vector, components, scale)
    start = first_centroids(kept, clusters)
    columns = ["id", "cluster", "distance"]
    if start:
        trees = materialised(grow_trees(kept, tree, leaf))
        centroids = fit_centroids(trees, start, rounds)
        rows = materialised(assigned(trees, centroids))
        spread = {r["cluster"]: r["inertia"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # a row for each cluster
    else:
        centroids, spread, rows = np.zeros((1, components), np.int64), {}, kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0)
    fits = lambda n: int(n) if n < 1 << 63 else None
    each = [fits(spread.get(k, 0)) for k in range(len(centroids))]
    return rows.select(
        F.col(columns[0]).alias("vec_id"), *columns[1:], _by_cluster(each, "bigint").alias("cluster_inertia"), F.lit(fits(sum(spread.values()))).cast("bigint").alias("inertia"),
        _by_cluster([digest(c) for c in centroids.tolist()], "string").alias("centroid_sha256"),
    )
