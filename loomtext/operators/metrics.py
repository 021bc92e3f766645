"""Clustering metrics.  Data-sized work is joins and aggregates; only label-sized tables reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .knn import TILE, grid, matrix, numbers


def contingency(pairs: DataFrame, true: str = "truth", pred: str = "pred") -> DataFrame:
    """(pred, truth, n)."""
    return pairs.groupBy(F.col(pred).alias("pred"), F.col(true).alias("truth")).agg(F.count("*").alias("n"))


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def ari(table: DataFrame) -> DataFrame:
    """One row ``ari``: the adjusted Rand index of a contingency table; 1 where there is nothing to adjust."""
    rows = table.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("a"))
    cols = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("b"))
    cells = table.agg(F.sum(_choose2(F.col("n"))).alias("c"), _choose2(F.sum("n")).alias("t"))
    expected = F.when(F.col("t") > 0, F.col("a") * F.col("b") / F.col("t")).otherwise(0.0)
    spread = (F.col("a") + F.col("b")) / 2 - expected
    return cells.crossJoin(rows).crossJoin(cols).select(F.when(spread == 0, 1.0).otherwise((F.col("c") - expected) / spread).alias("ari"))


def nmi(table: DataFrame) -> DataFrame:
    """One row ``nmi``: mutual information over the mean of the two entropies; 1 if both are constant."""
    total = table.agg(F.sum("n").cast("double").alias("t"))
    rows = table.groupBy("pred").agg(F.sum("n").alias("np"))
    cols = table.groupBy("truth").agg(F.sum("n").alias("nt"))
    entropy = lambda side, c: side.crossJoin(F.broadcast(total)).agg(-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))))
    mutual = table.join(rows, "pred").join(cols, "truth").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("np") * F.col("nt")))).alias("mi"))
    joined = mutual.crossJoin(entropy(rows, "np").toDF("hp")).crossJoin(entropy(cols, "nt").toDF("ht"))
    mean = (F.col("hp") + F.col("ht")) / 2
    return joined.select(F.when(mean <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi") / mean)).alias("nmi"))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a square matrix (shortest augmenting paths)."""
    n = cost.shape[0]
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0] = i
        j0, low, way, used = 0, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def matching(table: DataFrame) -> tuple[dict, int, int]:
    """({pred: truth} of the best one-to-one matching, rows it agrees on, all rows).  The table is label-sized.

    Of equally good matchings the one that best keeps the order of both sides is taken: the greatest sum of products of ranks.
    """
    cells = table.toPandas()
    if cells.empty:
        return {}, 0, 0
    preds, truths = sorted(cells["pred"].unique().tolist()), sorted(cells["truth"].unique().tolist())
    d = max(len(preds), len(truths))
    w = np.zeros((d, d))
    p, t = {x: i for i, x in enumerate(preds)}, {x: i for i, x in enumerate(truths)}
    for r in cells.itertuples():
        w[p[r.pred], t[r.truth]] = r.n
    order = np.zeros((d, d))
    order[: len(preds), : len(truths)] = np.outer(np.arange(1, len(preds) + 1), np.arange(1, len(truths) + 1))
    ranked = w * (d**3 + 1) + order if w.max() * (d**3 + 1) < 2**50 else w
    to = hungarian(ranked.max() - ranked)
    agree = int(w[np.arange(d), to].sum())
    return {preds[i]: truths[j] for i, j in enumerate(to) if i < len(preds) and j < len(truths)}, agree, int(w.sum())


def accuracy(table: DataFrame) -> float:
    _, agree, n = matching(table)
    return agree / n if n else math.nan


def scores(pairs: DataFrame, true: str = "truth", pred: str = "pred") -> dict[str, float]:
    """ACC, NMI and ARI of (truth, pred) rows, to six places."""
    table = contingency(pairs, true, pred).cache()
    try:
        both = ari(table).crossJoin(nmi(table)).first()
        acc = accuracy(table)
    finally:
        table.unpersist()
    return {"ACC": round(acc, 6), "NMI": round(both["nmi"], 6), "ARI": round(both["ari"], 6)}


#: Numbers that every task may hold for the pairwise silhouette; beyond it, the pairs are joined.
HELD = 1_000_000


def _value(a: Column, b: Column) -> Column:
    """A singleton has no own distance and counts 0, as do points of a clustering with one cluster."""
    return F.when(a.isNull() | b.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))


def _held(points: DataFrame, metric: str) -> DataFrame:
    """(id, a, b) by matrix products: each task meets its rows with all rows."""
    everything = points.toPandas()
    codes, at = np.unique(everything["cluster_id"].to_numpy(), return_inverse=True)
    x = np.stack(everything["v"].to_numpy()).astype(float)
    member = np.zeros((len(x), len(codes)))
    member[np.arange(len(x)), at] = 1
    shared = points.sparkSession.sparkContext.broadcast((x, member, codes))

    def run(parts):
        from .kmedoids import distances

        for p in parts:
            if p.empty:
                continue
            x, member, codes = shared.value
            own = np.searchsorted(codes, p["cluster_id"].to_numpy())
            for lo in range(0, len(p), 256):
                q = p.iloc[lo : lo + 256]
                v = np.stack(q["v"].to_numpy()).astype(float)
                r, mine = np.arange(len(q)), own[lo : lo + 256]
                self_distance = distances(v, v, metric)[r, r]
                total = distances(v, x, metric) @ member
                n = np.repeat(member.sum(axis=0)[None], len(q), axis=0)
                total[r, mine] -= self_distance
                n[r, mine] -= 1
                mean = np.divide(total, n, out=np.full_like(total, np.nan), where=n > 0)
                a = mean[r, mine].copy()
                mean[r, mine] = np.inf
                b = mean.min(axis=1)
                yield q[["id"]].assign(a=a, b=np.where(np.isinf(b), np.nan, b))

    rows = points.repartition(points.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "id long, a double, b double")
    return rows.select("id", F.nullif("a", F.lit(float("nan"))).alias("a"), F.nullif("b", F.lit(float("nan"))).alias("b"))


def _by_blocks(points: DataFrame, n: int, d: int, metric: str) -> DataFrame:
    """(id, cluster_id, cluster2, d): each row's mean distance to the others of each cluster, from all pairs, two blocks a task."""
    kind = points.schema["cluster_id"].dataType.simpleString()

    def work(one: list[pa.RecordBatch], other: list[pa.RecordBatch] | None) -> Iterator[pa.RecordBatch]:
        from .kmedoids import distances

        form = one[0].schema.field("cluster_id").type
        sides = [(numbers(s, "id"), matrix(s), numbers(s, "cluster_id")) for s in (one, other or one)]
        for (ids, x, own), (ids2, y, theirs) in ((sides[0], sides[1]), (sides[1], sides[0]))[: 2 if other else 1]:
            codes, at = np.unique(theirs, return_inverse=True)
            order = np.argsort(at, kind="stable")
            ids2, y, at = ids2[order], y[order], at[order]
            for i in range(0, len(x), TILE[0]):
                total = np.zeros((len(x[i : i + TILE[0]]), len(codes)))
                for j in range(0, len(y), TILE[1]):
                    gaps = distances(x[i : i + TILE[0]], y[j : j + TILE[1]], metric)
                    if other is None:
                        gaps[ids[i : i + TILE[0], None] == ids2[None, j : j + TILE[1]]] = 0
                    part = at[j : j + TILE[1]]
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    total[:, part[first]] += np.add.reduceat(gaps, first, axis=1)
                k = len(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + TILE[0]], k)), pa.array(np.repeat(own[i : i + TILE[0]], k), form), pa.array(np.tile(codes, len(total)), form), pa.array(total.ravel())], ["id", "cluster_id", "cluster2", "s"])

    sums = grid(points, n, d, work, f"id long, cluster_id {kind}, cluster2 {kind}, s double").groupBy("id", "cluster_id", "cluster2").agg(F.sum("s").alias("s"))
    sizes = points.groupBy(F.col("cluster_id").alias("cluster2")).agg(F.count("*").alias("n2"))
    others = F.col("n2") - (F.col("cluster_id") == F.col("cluster2")).cast("long")
    return sums.join(sizes, "cluster2").select("id", "cluster_id", "cluster2", F.when(others > 0, F.col("s") / others).alias("d"))


def _silhouette(points: DataFrame, metric: str, held: int) -> DataFrame:
    """Mean silhouette from all pairs."""
    points = points.select(F.col("id").cast("long").alias("id"), "cluster_id", F.col("v").cast("array<double>").alias("v"))
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if size["n"] and size["n"] * size["d"] <= held:
        s = _held(points, metric)
    else:
        per = _by_blocks(points, size["n"], size["d"] or 1, metric)
        own = F.min(F.when(F.col("cluster_id") == F.col("cluster2"), F.col("d")))
        near = F.min(F.when(F.col("cluster_id") != F.col("cluster2"), F.col("d")))
        s = per.groupBy("id").agg(own.alias("a"), near.alias("b"))
    clusters = points.agg(F.countDistinct("cluster_id").alias("k"))
    return s.agg(F.avg(_value(F.col("a"), F.col("b"))).alias("s")).crossJoin(clusters).select(F.when(F.col("k") < 2, -1.0).otherwise(F.col("s")).alias("silhouette"))


def silhouette_euclidean(points: DataFrame, held: int = HELD) -> DataFrame:
    """One row ``silhouette`` of (id, cluster_id, v array<double>): exact, from all pairs.

    Pairs grow with the square of the rows, memory doesn't: beyond ``held`` numbers a task holds two blocks.  The cosine form below
    needs one pass.
    """
    return _silhouette(points, "euclidean", held)


def silhouette_cosine_pairs(points: DataFrame, held: int = HELD) -> DataFrame:
    return _silhouette(points, "cosine", held)


def silhouette_cosine(points: DataFrame, dim: int) -> DataFrame:
    """One row ``silhouette`` by cosine distance in linear time.

    The mean cosine distance of a unit vector to a cluster is 1 minus its product with the cluster's mean unit vector, so
    no pair is formed: points meet K cluster sums.
    """
    unit = points.select("id", "cluster_id", V.l2_normalise(F.col("v")).alias("u")).cache()
    sums = unit.groupBy("cluster_id").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(dim)]).alias("s"), F.count("*").alias("n"))
    pair = unit.crossJoin(F.broadcast(sums.select(F.col("cluster_id").alias("c2"), "s", "n")))
    product = V.dot(F.col("u"), F.col("s"))
    own = F.when(F.col("n") > 1, ((F.col("n") - 1) - (product - V.dot(F.col("u"), F.col("u")))) / (F.col("n") - 1))
    d = F.when(F.col("cluster_id") == F.col("c2"), own).otherwise(1 - product / F.col("n"))
    per = pair.withColumn("d", d).groupBy("id").agg(F.min(F.when(F.col("cluster_id") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("cluster_id") != F.col("c2"), F.col("d"))).alias("b"))
    value = _value(F.col("a"), F.col("b"))
    clusters = unit.agg(F.countDistinct("cluster_id").alias("k"))
    return per.agg(F.avg(value).alias("s")).crossJoin(clusters).select(F.when(F.col("k") < 2, -1.0).otherwise(F.col("s")).alias("silhouette"))


def sample_rows(points: DataFrame, most: int = 5000, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, those of the least seeded hash of the id; all rows if there are no more."""
    return points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def calinski_harabasz(points: DataFrame, dim: int) -> DataFrame:
    """One row ``ch`` of (id, cluster_id, v): between over within dispersion, each by its degrees of freedom.

    From sums of squares: within = sum |v|^2 - sum n_c |m_c|^2, between = sum n_c |m_c|^2 - n |m|^2; one aggregate pass.
    """
    per = points.groupBy("cluster_id").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(dim)]).alias("s"), F.sum(V.dot(F.col("v"), F.col("v"))).alias("q"))
    total = per.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(V.dot(F.col("s"), F.col("s")) / F.col("n")).alias("c"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("g"))
    grand = V.dot(F.col("g"), F.col("g")) / F.col("t")
    between, within = F.col("c") - grand, F.col("q") - F.col("c")
    return total.select(F.when((F.col("k") < 2) | (F.col("t") <= F.col("k")), F.lit(None).cast("double")).when(within <= 0, 1.0).otherwise(between * (F.col("t") - F.col("k")) / (within * (F.col("k") - 1))).alias("ch"))


def purity(table: DataFrame) -> DataFrame:
    """One row ``purity``: the share of rows in their cluster's most frequent class."""
    top = table.groupBy("pred").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return top.agg((F.sum("m") / F.sum("n")).alias("purity"))


def aligned_confusion(table: DataFrame) -> DataFrame:
    """(truth, pred, truth_pos, pred_pos, n): the confusion matrix with each prediction on its match's diagonal."""
    to, _, _ = matching(table)
    spark = table.sparkSession
    rank = F.dense_rank().over(Window.orderBy("truth")) - 1  # label-sized
    truths = table.select("truth").distinct().withColumn("truth_pos", rank)
    pairs = spark.createDataFrame([(p, t) for p, t in to.items()] or [(None, None)], table.select("pred", F.col("truth").alias("match")).schema)
    after = truths.select(F.col("truth").alias("match"), F.col("truth_pos").alias("pred_pos"))
    preds = table.select("pred").distinct().join(pairs, "pred", "left").join(after, "match", "left")
    rest = preds.crossJoin(F.broadcast(truths.agg(F.count("*").alias("n_truth"))))
    free = F.row_number().over(Window.partitionBy(F.col("pred_pos").isNull()).orderBy("pred")) - 1
    placed = rest.withColumn("pred_pos", F.coalesce("pred_pos", F.col("n_truth") + free)).select("pred", F.col("pred_pos").cast("int"))
    return table.join(truths, "truth").join(placed, "pred").select("truth", "pred", "truth_pos", "pred_pos", "n")
