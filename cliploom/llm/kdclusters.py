"""Centroid clustering by filtering kd-trees.

Each partition packs its vectors into kd-trees of bounded size, once: every node holds the count, the sum and the
bounding box of its vectors, all integers. In a round the centroids go down each tree. At a node the one nearest to the box's middle,
z*, is compared with each other candidate z: over the box, d(x, z)^2 - d(x, z*)^2 is linear in x and so has its least value in a
corner. Where even that is above zero z is farther than z* from every vector of the node and is dropped; a tie
drops nothing. A node with one candidate left is assigned whole, by its count and sum; what is left at a leaf is
resolved vector by vector. Trees are filtered level by level, all nodes of a level at once.

A task returns a row for each centroid, so a round moves (tasks * centroids) rows and never a vector. The trees lie in the shared
folder: a lost executor's part of a round is read there again.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, worker
from .vectors import integers, kept, limbs_of, long_or_null, matrix, rebatched, split, squares, summed, total

CLUSTERS, ROUNDS, DIM, SEED = 8, 10, 64, 3
#: Vectors of a tree, and of a leaf, at most.
TREE, LEAF = 2048, 16
#: Bytes of a row group of the table of trees: what a reader holds at once.
GROUP_BYTES = 16 << 20


def build(x: np.ndarray) -> dict:
    """A kd-tree over the rows of x: ``order`` of the rows, and for each level its nodes' edges in that order, sums and boxes."""
    order, edges, levels = np.arange(len(x)), np.array([0, len(x)]), []
    while True:
        at = edges[:-1]
        y = x[order]
        lo, hi = np.minimum.reduceat(y, at, axis=0), np.maximum.reduceat(y, at, axis=0)
        levels.append({"edges": edges, "sums": np.add.reduceat(y, at, axis=0), "lo": lo, "hi": hi})
        if np.diff(edges).max() <= LEAF:
            break
        widest = (hi - lo).argmax(axis=1)
        middle = at + np.diff(edges) // 2
        for a, m, b, axis in zip(at, middle, edges[1:], widest, strict=True):
            own = order[a:b]
            order[a:b] = own[np.argsort(x[own, axis], kind="stable")] if x.dtype == object else own[np.argpartition(x[own, axis], m - a)]
        edges = np.sort(np.concatenate([edges, middle]))
    return {"order": order, "levels": levels, "x": x[order]}


def assign(tree: dict, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector in tree order, ties to the lower number; counts and sums of the centroids."""
    x, k = tree["x"], len(z)
    owner, count, sums = np.full(len(x), -1), np.zeros(k, np.int64), np.zeros(z.shape, z.dtype)
    norm = (z * z).sum(axis=1)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    for depth, level in enumerate(tree["levels"]):
        lo, hi, edges = level["lo"][nodes].astype(z.dtype), level["hi"][nodes].astype(z.dtype), level["edges"]
        middle = squares(lo + hi, 2 * z)
        star = np.where(open_, middle, middle.max() + 1).argmin(axis=1)
        away = z[None, :, :] - z[star][:, None, :]
        most = np.maximum(lo[:, None, :] * away, hi[:, None, :] * away).sum(axis=2)
        open_ &= (norm[None, :] - norm[star][:, None] - 2 * most <= 0).astype(bool)
        whole = open_.sum(axis=1) == 1
        done = nodes[whole]
        count += np.bincount(star[whole], edges[done + 1] - edges[done], minlength=k).astype(np.int64)
        np.add.at(sums, star[whole], level["sums"][done])
        for c, a, b in zip(star[whole].tolist(), edges[done].tolist(), edges[done + 1].tolist(), strict=True):
            owner[a:b] = c
        nodes, open_ = nodes[~whole], open_[~whole]
        if depth + 1 < len(tree["levels"]):
            # Splitting put a node's two halves at twice its place.
            nodes, open_ = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(open_, 2, axis=0)
    rest = np.flatnonzero(owner < 0)
    if len(rest):
        owner[rest] = squares(x[rest].astype(z.dtype), z).argmin(axis=1)
        count += np.bincount(owner[rest], minlength=k)
        np.add.at(sums, owner[rest], x[rest])
    return owner, count, sums


def _trees(rows: DataFrame, dim: int, wide: bool) -> DataFrame:
    """Rows (ids, tree): the ids in the order of the tree, and the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rebatched(batches, TREE):
            x = integers(t.column("v").combine_chunks(), dim, wide)
            tree = build(x if wide else x.astype(np.int32))
            if not wide:
                for level in tree["levels"]:
                    level["sums"] = np.add.reduceat(tree["x"].astype(np.int64), level["edges"][:-1], axis=0)
            ids = t.column("id").combine_chunks().take(pa.array(tree.pop("order")))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([lists, pa.array([pickle.dumps(tree, protocol=5)], pa.binary())], ["ids", "tree"])

    return rows.mapInArrow(worker(run), "ids array<long>, tree binary")


def _sums(trees: DataFrame, z: np.ndarray, limbs: int) -> DataFrame:
    """Each task's counts and sums (cluster, n, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(z), np.int64), np.zeros(z.shape, z.dtype)
        for batch in batches:
            for tree in batch.column("tree"):
                _, n, s = assign(pickle.loads(tree.as_buffer()), z)
                count += n
                sums += s
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array([split(sums[c], limbs) for c in at], pa.list_(pa.list_(pa.int64())))], ["cluster", "n", "s"])

    return trees.select("tree").mapInArrow(worker(run), "cluster int, n long, s array<array<long>>")


def _members(trees: DataFrame, z: np.ndarray) -> DataFrame:
    """Rows (id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch.column("ids"), batch.column("tree"), strict=True):
                tree = pickle.loads(packed.as_buffer())
                owner, _, _ = assign(tree, z)
                apart = tree["x"].astype(z.dtype) - z[owner]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(owner, pa.int32()), long_or_null((apart * apart).sum(axis=1))], ["id", "cluster", "distance"])

    return trees.mapInArrow(worker(run), "id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row that is kept.

    Kept are vectors of ``dim`` components, none null or not finite. Centroids start as the kept rows whose
    ``seed:id`` has the least sha256, in that order; rows of one id go by their vectors, rows without an id come last. With fewer rows there are
    fewer clusters; equal centroids may occur, of which the lowest number wins, and an empty cluster's centroid stays. Repeated rows count one by
    one. Components may have any finite size; a distance or sum beyond long is null. A table without a kept row gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.where(kept(vectors, vector_col, dim)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    limbs = limbs_of(rows)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).collect()
    wide = limbs > 1
    z = integers(pa.array([r.v for r in first], pa.list_(pa.float64())), dim, wide)
    trees = materialize(_trees(rows, dim, wide), "trees", **{"parquet.block.size": GROUP_BYTES})
    for _ in range(rounds if len(z) else 0):
        means = summed(_sums(trees, z, limbs), ["cluster"], dim, limbs)
        z = matrix([[s // means[c,][0] for s in means[c,][1]] if (c,) in means else [int(n) for n in z[c]] for c in range(len(z))], dim, wide)
    found = materialize(_members(trees, z), "members") if len(z) else spark.createDataFrame([], "id long, cluster int, distance long")
    drop(trees)
    sums = found.groupBy("cluster").agg(total("distance").alias("cluster_inertia"), F.count("*").alias("n")).collect()  # a row a cluster
    every = None if any(r.cluster_inertia is None for r in sums) else sum(r.cluster_inertia for r in sums)
    every = every if every is None or every < 1 << 63 else None
    named = [(r.cluster, r.cluster_inertia, every, hashlib.sha256(",".join(str(int(n)) for n in z[r.cluster]).encode()).hexdigest()) for r in sums]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
