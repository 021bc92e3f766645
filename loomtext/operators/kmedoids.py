"""K-Medoids by alternation: seeding by squared distance, nearest-medoid assignment, per-cluster updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import written
from .knn import matrix, units

#: Rows up to which a fit runs on one distance matrix in one process.
LOCAL_ROWS = 5_000
#: Numbers of the vectors of a block, at most; a block is two binary values, which pass to Python as they are.
PACKED = 250_000


@dataclass
class Fit:
    assignments: DataFrame  # (id, cluster_id): cluster_id is the medoid's place in ``medoids``
    medoids: list[int]  # ids
    inertia: float  # sum of distances, not squared
    iterations: int


def distances(a: np.ndarray, b: np.ndarray, metric: str = "cosine") -> np.ndarray:
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
        ua, ub = np.divide(a, na, out=np.zeros_like(a), where=na > 0), np.divide(b, nb, out=np.zeros_like(b), where=nb > 0)
        return np.maximum(np.round(1 - ua @ ub.T, 12), 0)  # so that ties are ties
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def seed_medoids(column, n: int, k: int, rng: np.random.RandomState) -> list[int]:
    """k-medoids++: the first at random, each next with probability proportional to the squared distance to the chosen.

    ``column(i)`` gives all distances to row i.  If every distance is zero, the rest is drawn evenly.
    """
    chosen = [int(rng.randint(n))]
    near = column(chosen[0]).copy()
    while len(chosen) < k:
        p = near**2
        p[chosen] = 0
        if p.sum() > 0:
            nxt = int(rng.choice(n, p=p / p.sum()))
        else:
            nxt = int(rng.choice(np.setdiff1d(np.arange(n), chosen)))
        chosen.append(nxt)
        near = np.minimum(near, column(nxt))
    return chosen


def fit_arrays(x: np.ndarray, k: int, metric: str = "cosine", seed: int = 42, max_iter: int = 300) -> tuple[np.ndarray, list[int], float, int]:
    """(labels, medoid rows, inertia, iterations) of a small matrix."""
    n = len(x)
    if k >= n:
        return np.arange(n), list(range(n)), 0.0, 0
    d = distances(x, x, metric)
    np.fill_diagonal(d, 0)
    medoids = seed_medoids(lambda i: d[i], n, k, np.random.RandomState(seed))
    for it in range(1, max_iter + 1):
        labels = np.argmin(d[:, medoids], axis=1)
        new = list(medoids)
        for c in range(k):
            members = np.flatnonzero(labels == c)
            if len(members):
                new[c] = int(members[np.argmin(d[np.ix_(members, members)].sum(axis=1))])
        if set(new) == set(medoids):
            break
        medoids = new
    labels = np.argmin(d[:, medoids], axis=1)
    return labels, medoids, float(d[np.arange(n), np.array(medoids)[labels]].sum()), it


def nearest_medoid(points: DataFrame, medoids: DataFrame, metric: str = "cosine") -> DataFrame:
    """(id, cluster_id, distance): the nearest of the ``medoids`` (cluster_id, m), ties to the lowest cluster_id.

    The medoid table has k rows; it is broadcast.
    """
    gap = V.cosine_distance if metric == "cosine" else V.euclidean
    pairs = points.select("id", "v").crossJoin(F.broadcast(medoids.select("cluster_id", "m"))).withColumn("distance", F.round(gap(F.col("v"), F.col("m")), 12))
    best = pairs.groupBy("id").agg(F.min(F.struct("distance", "cluster_id")).alias("b"))
    return best.select("id", F.col("b.cluster_id").alias("cluster_id"), F.col("b.distance").alias("distance"))


def _assign(medoids: np.ndarray, metric: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                d = distances(np.stack(p["v"].to_numpy()).astype(float), medoids, metric)
                at = np.argmin(d, axis=1)
                yield pd.DataFrame({"id": p["id"], "v": p["v"], "cluster_id": at.astype(np.int32), "distance": d[np.arange(len(p)), at]})

    return run


def medoid_update(members: DataFrame, metric: str = "cosine") -> DataFrame:
    """(cluster_id, id, cost): in each cluster the member of the least summed distance, ties to the smallest id.

    ``members``: (id, v, cluster_id).  All members are tried.  A cosine cost comes from the cluster's sum of unit vectors,
    n - u . sum(u), in one pass; Euclidean costs are summed over all pairs of a cluster.
    """
    if metric == "cosine":
        first = members.first()
        unit = members.select("cluster_id", "id", V.l2_normalise(F.col("v")).alias("u"))
        centre = unit.groupBy("cluster_id").agg(V.mean_vector(F.col("u"), len(first["v"]) if first else 1).alias("m"), F.count("*").alias("n"))
        cost = unit.join(F.broadcast(centre), "cluster_id").select("cluster_id", "id", F.round(F.col("n") * (1 - V.dot(F.col("u"), F.col("m"))), 10).alias("cost"))
    else:
        pairs = members.select("cluster_id", "id", F.col("v").alias("m")).join(members.select("cluster_id", "v"), "cluster_id")
        cost = pairs.groupBy("cluster_id", "id").agg(F.round(F.sum(V.euclidean(F.col("v"), F.col("m"))), 10).alias("cost"))
    return cost.groupBy("cluster_id").agg(F.min(F.struct("cost", "id")).alias("b")).select("cluster_id", F.col("b.id").alias("id"), F.col("b.cost").alias("cost"))


def packed(data: DataFrame) -> DataFrame:
    """(id, v) as a written table of blocks: ids and vectors as bytes.  Its many readers turn no number into another form."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            step = max(1, PACKED // max(1, len(b.column("v")[0]))) if b.num_rows else 1
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                ids, x = part.column("id").to_numpy(), matrix([part])
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["ids", "vs"])

    return written(data.select("id", "v").mapInArrow(run, "ids binary, vs binary"), "packed")


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in parts:
        for ids, vs in zip(b.column("ids"), b.column("vs")):
            found = np.frombuffer(ids.as_buffer(), np.int64)
            yield found, np.frombuffer(vs.as_buffer()).reshape(len(found), -1)


def _vectors_of(data: DataFrame, ids: list[int]) -> dict[int, np.ndarray]:
    """The vectors of a few ids, from a ``packed`` table."""
    wanted = np.array(ids, np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, x in _blocks(parts):
            for i in np.flatnonzero(np.isin(found, wanted)):
                yield pa.RecordBatch.from_arrays([pa.array([found[i]]), pa.array([x[i].tobytes()], pa.binary())], ["id", "v"])

    return {r["id"]: np.frombuffer(r["v"]) for r in data.mapInArrow(run, "id long, v binary").collect()}


def _hashes(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """Spark's ``xxhash64(id, seed, number)`` of a long and two ints."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def end(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = (turn(turn(ids.view(np.uint64) * p2, 31) * p1 ^ np.uint64(42) + p5 + np.uint64(8), 27)) * p1 + p4
    h = end(h)
    for x in (seed, number):
        h = h + p5 + np.uint64(4)
        h = h ^ np.full(1, x & 0xFFFFFFFF, np.uint64) * p1
        h = end(turn(h, 23) * p2 + p3)
    return h


def _draw(chosen: np.ndarray, metric: str, ids: list[int], seed: int):
    """mapInArrow body: of each block the row drawn with probability proportional to its squared distance to the chosen.
    A seeded hash is the chance; the least -log(u) / weight wins, here and then over all blocks.  Rows of no weight come
    last (``none``), drawn evenly.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, x in _blocks(parts):
            rest = np.flatnonzero(~np.isin(found, np.array(ids, np.int64)))
            if len(rest):
                w = distances(x, chosen, metric).min(axis=1)[rest] ** 2 if len(chosen) else np.ones(len(rest))
                key = -np.log(((_hashes(found[rest], seed, len(ids)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
                none = w <= 0
                key = np.where(none, key, key / np.where(none, 1, w))
                i = int(np.lexsort((found[rest], key, none))[0])
                yield pa.RecordBatch.from_arrays([pa.array(found[rest[i : i + 1]]), pa.array([x[rest[i]].tobytes()], pa.binary()), pa.array([bool(none[i])]), pa.array([key[i]])], ["id", "v", "none", "key"])

    return run


def seed_distributed(data: DataFrame, k: int, metric: str, seed: int) -> list[int]:
    """k-medoids++ as in ``seed_medoids``, a pass over the ``packed`` table (made of (id, v) if need be) for each medoid."""
    data = data if "vs" in data.columns else packed(data)
    ids: list[int] = []
    at: list[np.ndarray] = []
    while len(ids) < k:
        drawn = data.mapInArrow(_draw(np.array(at, float), metric, ids, seed), "id long, v binary, none boolean, key double")
        row = drawn.orderBy("none", "key", "id").first()
        if row is None:
            break
        ids.append(row["id"])
        at.append(np.frombuffer(row["v"]))
    return ids


def _sums(medoids: np.ndarray):
    """mapInArrow body: of a ``packed`` table's part the sum of distances, the rows and the sum of unit vectors of each cluster."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, cost = np.zeros_like(medoids), np.zeros(len(medoids)), 0.0
        for _, x in _blocks(parts):
            d = distances(x, medoids)
            at = d.argmin(axis=1)
            member = np.zeros_like(d)
            member[np.arange(len(x)), at] = 1
            total, n, cost = total + member.T @ units(x), n + member.sum(axis=0), cost + float(d.min(axis=1).sum())
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n.tobytes()]), pa.array([cost])], ["total", "n", "cost"])

    return run


def _cheapest(medoids: np.ndarray, total: np.ndarray, n: np.ndarray):
    """mapInArrow body: of each block the member of each cluster with the least cost, n - u . sum(u), as in ``medoid_update``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = total / np.maximum(n, 1)[:, None]
        for ids, x in _blocks(parts):
            at = distances(x, medoids).argmin(axis=1)
            cost = np.round(n[at] * (1 - np.einsum("ij,ij->i", units(x), mean[at])), 10)
            o = np.lexsort((ids, cost, at))
            o = o[np.concatenate([[True], np.diff(at[o]) > 0])]
            yield pa.RecordBatch.from_arrays([pa.array(at[o].astype(np.int32)), pa.array(cost[o]), pa.array(ids[o]), pa.array([v.tobytes() for v in x[o]], pa.binary())], ["cluster_id", "cost", "id", "v"])

    return run


def _placed(medoids: np.ndarray):
    """mapInArrow body: (id, cluster_id) of a ``packed`` table."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(parts):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(distances(x, medoids).argmin(axis=1).astype(np.int32))], ["id", "cluster_id"])

    return run


def _fit_cosine(data: DataFrame, ids: list[int], max_iter: int) -> Fit:
    """Alternation in two passes over the ``packed`` table a round; a partition sends fixed sums and then a row a cluster."""
    at = _vectors_of(data, ids)
    ids = [i for i in ids if i in at]
    medoids = np.array([at[i] for i in ids], float)
    for it in range(1, max_iter + 1):
        parts = data.mapInArrow(_sums(medoids), "total binary, n binary, cost double").collect()
        total = np.sum([np.frombuffer(r["total"]) for r in parts], axis=0).reshape(medoids.shape)
        n, inertia = np.sum([np.frombuffer(r["n"]) for r in parts], axis=0), float(sum(r["cost"] for r in parts))
        best = data.mapInArrow(_cheapest(medoids, total, n), "cluster_id int, cost double, id long, v binary")
        new, x = list(ids), medoids.copy()
        for r in best.groupBy("cluster_id").agg(F.min(F.struct("cost", "id", "v")).alias("b")).collect():  # k rows
            new[r["cluster_id"]], x[r["cluster_id"]] = r["b"]["id"], np.frombuffer(r["b"]["v"])
        if set(new) == set(ids):
            break
        ids, medoids = new, x
    return Fit(written(data.mapInArrow(_placed(medoids), "id long, cluster_id int"), "placed"), ids, inertia, it)


def fit(points: DataFrame, k: int, metric: str = "cosine", seed: int = 42, max_iter: int = 300, local_rows: int = LOCAL_ROWS) -> Fit:
    """K-Medoids of (id, v); k at or above the rows makes each its own cluster."""
    spark = points.sparkSession
    data = points.filter("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    n = data.count()
    if n == 0:
        return Fit(spark.createDataFrame([], "id long, cluster_id int"), [], 0.0, 0)
    if n <= local_rows:
        rows = data.orderBy("id").toPandas()
        labels, medoids, inertia, it = fit_arrays(np.stack(rows["v"].to_numpy()).astype(float), k, metric, seed, max_iter)
        found = spark.createDataFrame(pd.DataFrame({"id": rows["id"], "cluster_id": labels.astype(np.int32)}), "id long, cluster_id int")
        return Fit(found, rows["id"].to_numpy()[medoids].tolist(), inertia, it)
    blocks = packed(data)
    ids = seed_distributed(blocks, k, metric, seed)
    if metric == "cosine":
        return _fit_cosine(blocks, ids, max_iter)
    data = data.cache()
    for it in range(1, max_iter + 1):
        at = {r["id"]: r["v"] for r in data.filter(F.col("id").isin(ids)).collect()}
        ids = [i for i in ids if i in at]
        placed = data.mapInPandas(_assign(np.array([at[i] for i in ids], float), metric), "id long, v array<double>, cluster_id int, distance double").cache()
        new = list(ids)
        for r in medoid_update(placed, metric).collect():  # k rows
            new[r["cluster_id"]] = r["id"]
        if set(new) == set(ids):
            break
        placed.unpersist()
        ids = new
    inertia = placed.agg(F.sum("distance")).first()[0]
    return Fit(placed.select("id", "cluster_id"), ids, float(inertia), it)


def cluster_map(assignments: DataFrame) -> DataFrame:
    """(cluster_id, members): the ids of each cluster, ascending."""
    return assignments.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("members"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count("*").alias("n"))
