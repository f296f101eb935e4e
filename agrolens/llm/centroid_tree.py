"""Centroid clustering (k-means on integer vectors) with a vantage-point tree over the centroids.

Each round builds the tree on the driver from the ``k`` centroids, broadcasts
its arrays, and every vector searches it best first: the open node with the
least possible distance is looked at next, and the search of a vector ends when
that lower bound exceeds its best distance.  The vectors of a batch search
together, a node's vectors in one array operation.

* An inner node holds a vantage centroid and, for each child, the least and the
  greatest distance of the child's centroids to it.  By the triangle inequality a
  child is no nearer than ``max(least - d, d - greatest)``.
* The pruning radius is inclusive: a node whose bound equals the best distance
  is opened, as a tie goes to the smaller centroid number.  Bounds are
  doubles; they are lowered, and the radius raised, by more than their rounding.
* The distances that decide are exact sums of squared integers (int64).

A task sends at most one row of sums a centroid; the totals are exact decimals,
and a new centroid is the floor of sum / count.  What reaches the driver is k
centroids, whatever the number of vectors.

Defined results: a vector that is null, has another number of components, or a
null or non-finite one, is left out; so is one with a component of 2^27 / scale or
more in size, whose squared distance a long cannot hold for sure.  Repeated
rows each count and may both become centroids (the later number then stays empty).  With fewer than k vectors, each is a
centroid.  A null id sorts last among the starting vectors and stays null; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import query, stored

#: Components are below this, so that a squared distance of 64 of them is below 2^63.
LIMIT = 1 << 27
#: More than what a bound's few operations on doubles can round away, relative to its terms.
SLACK = 1e-12
#: Vectors that search together.
TOGETHER = 4096


def build(centroids: np.ndarray, leaf: int = 2) -> dict[str, np.ndarray]:
    """The tree's arrays.  Centroids are split by their rank of distance, so equal ones cannot unbalance it."""
    vantage, children, near_far, members = [], [], [], []

    def node(ids: np.ndarray) -> int:
        me = len(vantage)
        vantage.append(-1)
        children.append((-1, -1))
        near_far.append((0.0, 0.0, 0.0, 0.0))
        members.append(ids)
        if len(ids) <= leaf:
            return me
        # The vantage point is the centroid farthest from the first: it spreads the others.
        d = ((centroids[ids] - centroids[ids[0]]) ** 2).sum(1)
        v = ids[int(d.argmax())]
        rest = ids[ids != v]
        far = np.sqrt(((centroids[rest] - centroids[v]) ** 2).sum(1).astype(np.float64))
        order = np.argsort(far, kind="stable")
        half = (len(rest) + 1) // 2
        sides = [order[:half], order[half:]]
        vantage[me], members[me] = int(v), ids[:0]
        near_far[me] = tuple(x for s in sides for x in ((far[s].min(), far[s].max()) if len(s) else (0.0, 0.0)))
        children[me] = tuple(node(np.sort(rest[s])) if len(s) else -1 for s in sides)
        return me

    node(np.arange(len(centroids)))
    width = max(1, max(len(m) for m in members))
    padded = np.full((len(members), width), -1, np.int64)
    for i, m in enumerate(members):
        padded[i, :len(m)] = m
    return {"centroids": centroids, "vantage": np.array(vantage), "children": np.array(children).reshape(-1, 2), "near_far": np.array(near_far).reshape(-1, 4), "members": padded}


def search(tree: dict[str, np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances were computed."""
    centroids, n = tree["centroids"], len(vectors)
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids))
    radius = np.full(n, np.inf)
    bound = np.full((n, len(tree["vantage"])), np.inf)
    bound[:, 0] = 0.0
    rows, looked = np.arange(n), 0

    def offer(who: np.ndarray, c: int) -> np.ndarray:
        nonlocal looked
        looked += len(who)
        diff = vectors[who] - centroids[c]
        d = np.einsum("ij,ij->i", diff, diff)
        better = (d < best[who]) | ((d == best[who]) & (c < at[who]))
        w = who[better]
        best[w], at[w] = d[better], c
        radius[w] = np.sqrt(d[better].astype(np.float64)) * (1 + SLACK)
        return d

    while len(rows):
        node = bound[rows].argmin(1)
        low = bound[rows, node]
        go = (low <= radius[rows]) & np.isfinite(low)
        rows, node, low = rows[go], node[go], low[go]
        bound[rows, node] = np.inf
        for i in np.unique(node).tolist():
            mine = node == i
            who, floor = rows[mine], low[mine]
            v = int(tree["vantage"][i])
            if v < 0:
                for c in tree["members"][i].tolist():
                    if c >= 0:
                        offer(who, c)
                continue
            d = np.sqrt(offer(who, v).astype(np.float64))
            for side, child in enumerate(tree["children"][i].tolist()):
                if child >= 0:
                    least, most = tree["near_far"][i][2 * side:2 * side + 2]
                    gap = np.maximum(least - d, d - most) - SLACK * (d + most)
                    bound[who, child] = np.maximum(floor, gap)
    return at, best, looked


def integers(batch: pa.RecordBatch, column: int, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and their integers."""
    col = batch.column(column)
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(col), dims), False))
    place = np.flatnonzero(right)
    flat = col.take(pa.array(place)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls come as NaN
    with np.errstate(all="ignore"):
        x = np.floor(x * scale)
        fits = (np.abs(x) < LIMIT).all(1)  # false for NaN and infinities
    return place[fits], x[fits].astype(np.int64)


def usable(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that count, as integers."""
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("v", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, x = integers(b, 1, dims, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place)), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def starting(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> np.ndarray:
    """The k usable vectors with the least sha256 of ``seed:vec_id`` (then the least components), in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = usable(vectors, dims, scale).select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64).reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round."""
    spark, (k, dims) = vectors.sparkSession, centroids.shape
    tree = spark.sparkContext.broadcast(build(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            _, x = integers(b, 0, dims, scale)
            for i in range(0, len(x), TOGETHER):
                part = x[i:i + TOGETHER]
                at = search(tree.value, part)[0]
                order = np.argsort(at, kind="stable")
                here, first = np.unique(at[order], return_index=True)
                count[here] += np.diff(np.append(first, len(part)))
                total[here] += np.add.reduceat(part[order], first, axis=0)
        some = np.flatnonzero(count)
        sums = np.concatenate([count[some, None], total[some]], axis=1)  # the count first
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("dim", "x"))
    totals = parts.groupBy("cluster", "dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * (dims + 1) numbers
    tree.unpersist()
    got = {(r.cluster, r.dim): int(r.x) for r in totals}
    out = centroids.copy()
    for c in {c for c, _ in got}:
        out[c] = [got[c, j + 1] // got[c, 0] for j in range(dims)]
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) after ``rounds`` rounds and a last assignment, and the final centroids."""
    if dims * 4 * LIMIT ** 2 >= 1 << 63:
        raise ValueError(f"{dims} components may overflow a squared distance")
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    spark = vectors.sparkSession
    centroids = starting(vectors, k, seed, dims, scale)
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = _moved(vectors, centroids, scale)
    tree = spark.sparkContext.broadcast(build(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, x = integers(b, 1, dims, scale)
            for i in range(0, len(x), TOGETHER):
                at, d, _ = search(tree.value, x[i:i + TOGETHER])
                ids = b.column(0).take(pa.array(place[i:i + TOGETHER]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(d)], names=schema.fieldNames())

    return vectors.select("vec_id", "embedding").mapInArrow(run, schema), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's summed distance, the sum over all and the centroid's digest; the small side has a row a centroid."""
    spark = assigned.sparkSession
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    total = sum(int(r.s) for r in each)
    held = {r.cluster: int(r.s) for r in each}
    fits = lambda x: x if x < 1 << 63 else None  # noqa: E731  (a sum beyond a long is null)
    rows = [(c, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in held.items()]
    side = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op11_centroid_clusters")
def op11_centroid_clusters(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    assigned, centroids = clusters(vectors)
    return with_inertia(stored(assigned, "clusters"), centroids)

