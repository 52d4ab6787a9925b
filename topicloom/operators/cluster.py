"""Reducing vectors and clustering them, with outliers.

``Reducer`` is a fitted projection (principal components), so centroids, words and
keywords can be placed later. ``density_clusters`` finds clusters of any number by
hierarchical density clustering and leaves outliers at -1; with a wanted number of
topics, Ward's method cuts all points into so many clusters and the density outliers
stay outliers.

Scale: both methods compare points pairwise, on the driver, so they get at most
``MOST_POINTS`` points. Larger tables are first cut into that many small groups by
k-means in the executors; the groups' centres, weighted by their sizes, are the
points, and a document takes its group's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.vectors import doubles, normalised

MOST_POINTS = 2000
DIMS, MIN_SIZE, SEED = 5, 30, 42


@dataclass
class Reducer:
    """A fitted projection to a few dimensions."""

    model: object

    @staticmethod
    def fit(docs: DataFrame, dims: int = DIMS, vec: str = "emb_hd") -> Reducer:
        rows = docs.select(array_to_vector(doubles(F.col(vec))).alias("v"))
        return Reducer(PCA(k=dims, inputCol="v", outputCol="p").fit(rows))

    def transform(self, df: DataFrame, vec: str, out: str, unit: bool = False) -> DataFrame:
        """``df`` with the projected column ``out``; vectors of length 1 with ``unit``."""
        placed = self.model.transform(df.withColumn("v", array_to_vector(doubles(F.col(vec)))))
        low = vector_to_array("p")
        return placed.withColumn(out, normalised(low) if unit else low).drop("v", "p")


def reduced(docs: DataFrame, dims: int = DIMS, vec: str = "emb_hd", out: str = "emb_ld") -> tuple[DataFrame, Reducer]:
    """Documents with projected vectors of length 1, and the projection."""
    reducer = Reducer.fit(docs, dims, vec)
    return reducer.transform(docs, vec, out, unit=True), reducer


def _points(docs: DataFrame, vec: str, most: int, seed: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, point), the points' coordinates, and how many documents each stands for."""
    rows = docs.select("doc_id", doubles(F.col(vec)).alias("x"))
    total = rows.count()
    if total <= most:
        own = sorted(rows.collect(), key=lambda r: r.doc_id)
        ids = docs.sparkSession.createDataFrame([(r.doc_id, k) for k, r in enumerate(own)], "doc_id long, point int")
        return ids, np.array([r.x for r in own], float).reshape(len(own), -1), np.ones(len(own), np.int64)
    model = KMeans(k=most, seed=seed, featuresCol="v", predictionCol="point", maxIter=10).fit(rows.select(array_to_vector("x").alias("v")))
    ids = model.transform(rows.withColumn("v", array_to_vector("x"))).select("doc_id", "point")
    sizes = {r["point"]: r["count"] for r in ids.groupBy("point").count().collect()}  # at most `most` rows
    centres = np.array(model.clusterCenters())
    return ids, centres, np.array([sizes.get(k, 0) for k in range(len(centres))], np.int64)


def _distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))


def _spanning_tree(dist: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of the least spanning tree (Prim), shortest first."""
    n = len(dist)
    best, near = dist[0].copy(), np.zeros(n, np.int64)
    out, inside = [], np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        k = int(np.argmin(np.where(inside, np.inf, best)))
        out.append((float(best[k]), int(near[k]), k))
        inside[k] = True
        closer = dist[k] < best
        best[closer], near[closer] = dist[k][closer], k
    return sorted(out)


def density_labels(x: np.ndarray, min_size: int = MIN_SIZE, weight: np.ndarray | None = None) -> np.ndarray:
    """Hierarchical density clustering: mutual reachability, least spanning tree, condensed tree, clusters of most excess of mass; -1 for outliers."""
    n = len(x)
    weight = np.ones(n, np.int64) if weight is None else weight
    if weight.sum() < min_size or n < 2:
        return np.full(n, -1)
    dist = _distances(x)
    order = np.argsort(dist, axis=1, kind="stable")
    enough = (np.cumsum(weight[order], axis=1) >= min_size).argmax(axis=1)
    core = np.take_along_axis(dist, order, axis=1)[np.arange(n), enough]
    tree = _spanning_tree(np.maximum(dist, np.maximum(core[:, None], core[None])))
    # merges, as a binary tree: node n + k joins two nodes at a distance
    top, sons, size = list(range(n)), {}, {k: int(weight[k]) for k in range(n)}

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for k, (d, a, b) in enumerate(tree):
        p, q = root(a), root(b)
        top.append(n + k)
        top[p] = top[q] = n + k
        sons[n + k] = (p, q, d)
        size[n + k] = size[p] + size[q]
    # condensed: a cluster lives until it splits into two of at least min_size
    rate = lambda d: 1 / d if d > 0 else 1e12
    clusters, held = [{"birth": 0.0, "mass": 0.0, "parts": [], "points": []}], []
    stack = [(2 * n - 2, 0)]

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo.extend(sons[k][:2])
        return out

    while stack:
        node, c = stack.pop()
        own = clusters[c]
        if node < n:
            held.append((c, node))
            continue
        p, q, d = sons[node]
        big = [s for s in (p, q) if size[s] >= min_size]
        if len(big) == 2:
            own["mass"] += size[node] * (rate(d) - own["birth"])
            for s in big:
                clusters.append({"birth": rate(d), "mass": 0.0, "parts": [], "points": []})
                own["parts"].append(len(clusters) - 1)
                stack.append((s, len(clusters) - 1))
            continue
        for s in (p, q):
            if s in big:
                stack.append((s, c))
            else:  # falls out of the cluster here
                own["mass"] += size[s] * (rate(d) - own["birth"])
                held.extend((c, k) for k in leaves(s))
    for c, k in held:
        clusters[c]["points"].append(k)
    chosen, worth = set(), {}
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(worth[p] for p in clusters[c]["parts"])
        if clusters[c]["mass"] >= below:
            chosen.add(c)
        worth[c] = max(clusters[c]["mass"], below)
    labels = np.full(n, -1)
    todo, found = [(p, -1) for p in clusters[0]["parts"]], 0
    while todo:
        c, label = todo.pop(0)
        if label < 0 and c in chosen:
            label, found = found, found + 1
        if label >= 0:
            labels[clusters[c]["points"]] = label
        todo.extend((p, label) for p in clusters[c]["parts"])
    return labels


def ward_labels(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Ward's agglomeration of all points to k clusters, by merging chains of nearest neighbours."""
    n = len(x)
    size = np.ones(n) if weight is None else np.maximum(weight, 1).astype(float)
    cost = _distances(x) ** 2 * (size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(cost, np.inf)
    alive, merges, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(cost[a]))
            if len(chain) > 1 and cost[a, chain[-2]] <= cost[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        d = cost[a, b]
        merges.append((d, min(a, b), max(a, b)))
        a, b = min(a, b), max(a, b)
        total = size[a] + size[b] + size
        cost[a] = np.where(alive, ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * d) / total, np.inf)
        alive[b] = False
        size[a] += size[b]
        cost[b], cost[:, b] = np.inf, np.inf
        cost[a, a] = cost[a, ~alive] = np.inf
        cost[:, a] = cost[a]
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges)[: max(n - k, 0)]:
        parent[root(b)] = root(a)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def compacted(labels: np.ndarray) -> np.ndarray:
    """Labels made consecutive from 0; outliers stay -1."""
    own = np.unique(labels[labels >= 0])
    return np.where(labels >= 0, np.searchsorted(own, labels), -1)


def density_clusters(docs: DataFrame, k: int | None = None, min_size: int = MIN_SIZE, vec: str = "emb_ld", most: int = MOST_POINTS, seed: int = SEED) -> DataFrame:
    """(doc_id, topic_idx), -1 for outliers; k: how many topics to cut all points into before outliers are taken out."""
    ids, x, weight = _points(docs, vec, most, seed)
    spark = docs.sparkSession
    if not len(x):
        return spark.createDataFrame([], "doc_id long, topic_idx int")
    labels = density_labels(x, min_size, weight)
    if k is not None:
        labels = np.where(labels < 0, -1, ward_labels(x, k, weight))
    table = spark.createDataFrame([(p, int(label)) for p, label in enumerate(compacted(labels))], "point int, topic_idx int")
    return ids.join(F.broadcast(table), "point").select("doc_id", "topic_idx")  # at most `most` rows are broadcast


def cluster_and_reduce(docs: DataFrame, k: int | None = None, dims: int = DIMS, min_size: int = MIN_SIZE) -> tuple[DataFrame, Reducer]:
    """Documents with emb_ld and topic_idx, and the projection."""
    low, reducer = reduced(docs, dims)
    return low.join(density_clusters(low, k, min_size), "doc_id"), reducer


def kmeans_parts(docs: DataFrame, parts: int, vec: str = "emb_ld", seed: int = SEED) -> DataFrame:
    """(doc_id, part) by k-means."""
    rows = docs.select("doc_id", array_to_vector(doubles(F.col(vec))).alias("v"))
    return KMeans(k=parts, seed=seed, featuresCol="v", predictionCol="part").fit(rows).transform(rows).select("doc_id", "part")


def clustered(docs: DataFrame, k: int, seed: int = SEED, vec: str = "emb_hd") -> DataFrame:
    """(doc_id, cluster): L2-normalise, then bisecting k-means, which needs no pairwise distances at any size."""
    from pyspark.ml.clustering import BisectingKMeans

    rows = docs.select("doc_id", array_to_vector(normalised(F.col(vec))).alias("v"))
    return BisectingKMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows).transform(rows).select("doc_id", "cluster")


def plot_coordinates(docs: DataFrame, vec: str = "emb_hd", hover: int = 200) -> DataFrame:
    """(doc_id, x, y, topic_idx, hover): a plane to draw, with the start of each text; outliers have topic -1."""
    low = Reducer.fit(docs, 2, vec).transform(docs, vec, "_p")
    return low.select("doc_id", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"), "topic_idx", F.substring("text", 1, hover).alias("hover"))


def reduction_diagnostics(docs: DataFrame, dims: int = DIMS, vec: str = "emb_hd") -> DataFrame:
    """(dim, share): variance that each dimension of the projection explains."""
    shares = Reducer.fit(docs, dims, vec).model.explainedVariance.toArray()
    return docs.sparkSession.createDataFrame([(k, float(s)) for k, s in enumerate(shares)], "dim int, share double")
