"""Exact nearest neighbours by cosine, and the similarity graph built from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of the vectors that every task may hold (float64): beyond it, blocks meet in a grid.
HELD = 1_000_000
#: Elements of the vectors of a grid block, at most.
BLOCK = 4_000_000
#: Rows of the two sides of one matrix product; its memory doesn't grow with the table.
TILE = (512, 2048)


def units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class Tops:
    """The nearest of each row of one side so far: the ``k`` greatest similarities of at least ``least``, ties to the smaller id.

    Similarities are compared after rounding to ``places``.  Others are named by their places in id order and must come in it, so that a
    later one of equal similarity never displaces an earlier one and a comparison with the k-th so far leaves few to look at.
    """

    def __init__(self, n: int, k: int, least: float, places: int = 12):
        self.k, self.least, self.places = k, least, places
        self.at, self.sim = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)
        self.waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def add(self, lo: int, sim: np.ndarray, first: int) -> None:
        """``sim``: of the rows from ``lo`` on with the others from ``first`` on; -inf where there is no pair."""
        k, old = self.k, self.sim[lo : lo + len(sim)]
        step = 10.0**-self.places
        low = np.where(np.isinf(old[:, -1]), self.least - 0.6 * step, old[:, -1] + 0.4 * step)
        near = sim >= low[:, None]
        if np.count_nonzero(near) > 4 * k * len(sim) and sim.shape[1] > k:
            kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
            low = np.maximum(low, np.where(np.isinf(kth), low, kth - 1.1 * step))
            near = sim >= low[:, None]
        r, c = np.nonzero(near)
        self._put(lo, len(sim), r, c, sim[r, c], first)
        self.settle(lo)

    def offer(self, lo: int, sim: np.ndarray, first: int, x: np.ndarray, y: np.ndarray) -> bool:
        """``add`` of the product of unit vectors ``x`` and ``y``, of which ``sim`` is one in single precision: only pairs that may be
        among the nearest, whatever its rounding, are multiplied in double.  False, and nothing is done, where these are too many.
        """
        k, n, kth = self.k, sim.shape[1], self.sim[lo : lo + len(sim), -1]
        off, most, new = (x.shape[1] + 4) * 2.0**-23 + 10.0**-self.places, 4 * k * len(sim), np.isinf(kth)
        low = np.where(new, self.least, kth) - off
        near = sim >= _single(low)[:, None]
        if np.count_nonzero(near) > most and new.any() and n > k:
            here = np.partition(sim, n - k, axis=1)[:, n - k].astype(float)
            near = sim >= _single(np.maximum(low, here - 2 * off))[:, None]
        if np.count_nonzero(near) > most:
            return False
        if near.flags.c_contiguous:
            r, c = np.divmod(_set(near), n)
        else:
            c, r = np.divmod(_set(near.T), len(sim))
        parts = (slice(i, i + 16_384) for i in range(0, len(r), 16_384))
        self._put(lo, len(sim), r, c, np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[r[p]], y[c[p]]) for p in parts]]), first)
        return True

    def _put(self, lo: int, rows: int, r: np.ndarray, c: np.ndarray, sim: np.ndarray, first: int) -> None:
        """Keeps candidates, and sorts them in once they are as many as what is there: then there are few sorts."""
        r, s = r + lo, np.round(sim, self.places)
        ok = (s >= self.least) & (s > self.sim[r, -1])
        if ok.any():
            wait = self.waiting.setdefault(lo, [])
            wait.append((r[ok].astype(np.int32), c[ok] + first, s[ok]))
            if sum(len(w[0]) for w in wait) >= self.k * rows:
                self.settle(lo)

    def settle(self, lo: int) -> None:
        """Sorts in what waits of the rows from ``lo`` on."""
        if lo not in self.waiting:
            return
        k, (r, c, s) = self.k, (np.concatenate(x) for x in zip(*self.waiting.pop(lo)))
        hit = np.unique(r)
        # what is there comes first among equals: its ids are smaller; so do candidates that came before
        rr, ss, dd = np.concatenate([np.repeat(hit, k), r]), np.concatenate([self.sim[hit].ravel(), s]), np.concatenate([self.at[hit].ravel(), c])
        o = np.lexsort((-ss, rr))
        rr, ss, dd = rr[o], ss[o], dd[o]
        place = np.arange(len(rr)) - np.searchsorted(rr, rr)
        keep = place < k
        self.sim[rr[keep], place[keep]], self.at[rr[keep], place[keep]] = ss[keep], dd[keep]

    def edges(self, src: np.ndarray, dst: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> pa.RecordBatch:
        """(src, dst, weight, gap) with the Euclidean distances; ``x`` and ``y`` are the vectors as they were given.  Without them no gap."""
        for lo in list(self.waiting):
            self.settle(lo)
        r, c = np.nonzero(np.isfinite(self.sim))
        at = self.at[r, c]
        if x is None:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (src[r], dst[at], self.sim[r, c])], ["src", "dst", "weight"])
        gap = np.concatenate([np.zeros(0), *[np.linalg.norm(x[r[i : i + 50_000]] - y[at[i : i + 50_000]], axis=1) for i in range(0, len(r), 50_000)]])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (src[r], dst[at], self.sim[r, c], gap)], ["src", "dst", "weight", "gap"])


def tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, column, rows of a, rows of b) of the parts of a product of bounded size; columns ascend for each row."""
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            yield i, j, a[i : i + TILE[0]], b[j : j + TILE[1]]


def _single(low: np.ndarray) -> np.ndarray:
    """In single precision, and smaller."""
    return np.nextafter(low.astype(np.float32), np.float32(-np.inf))


def _set(near: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of flags of which few are set: eight are looked at at once."""
    flat = near.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64))
    return (eight[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[eight]]


def _meet(src: np.ndarray, u: np.ndarray, dst: np.ndarray, w: np.ndarray, mine: Tops, theirs: Tops | None, later: bool) -> None:
    """Unit vectors ``u`` for ``mine`` among ``w``, both by ascending ids, and with ``theirs`` also the other way round.

    Products are in single precision, and in double where that leaves too many pairs open.
    """
    thin, wide = u.astype(np.float32), w.astype(np.float32)
    for i, j, x, y in tiles(u, w):
        left, right = src[i : i + len(x)], dst[j : j + len(y)]
        if later and theirs is None and right[-1] <= left[0]:
            continue
        sim = thin[i : i + len(x)] @ wide[j : j + len(y)].T
        back = sim.T.copy() if later and theirs is not None else sim.T
        if not mine.offer(i, _masked(sim, left, right, later), j, x, y):
            _exactly(mine, i, x, left, j, y, right, later)
        if theirs is not None and not theirs.offer(j, _masked(back, right, left, later), i, y, x):
            _exactly(theirs, j, y, right, i, x, left, later)


def _exactly(best: Tops, lo: int, x: np.ndarray, src: np.ndarray, first: int, y: np.ndarray, dst: np.ndarray, later: bool) -> None:
    """Some rows at once: all pairs may be candidates."""
    best.settle(lo)
    for r in range(0, len(x), 64):
        best.add(lo + r, _masked(x[r : r + 64] @ y.T, src[r : r + 64], dst, later), first)


def nearest(src: np.ndarray, a: np.ndarray, dst: np.ndarray, b: np.ndarray, k: int, least: float, places: int = 12, later: bool = False) -> pa.RecordBatch:
    """The tops of rows ``a`` among ``b``, both by ascending ids; a row doesn't meet its own id, with ``later`` only greater ones."""
    best = Tops(len(a), k, least, places)
    _meet(src, units(a), dst, units(b), best, None, later)
    return best.edges(src, dst, a, b)


def _masked(sim: np.ndarray, src: np.ndarray, dst: np.ndarray, later: bool) -> np.ndarray:
    """-inf where there is no pair.  Ids ascend, so that most tiles are not looked through."""
    if later and dst[0] <= src[-1]:
        sim[dst[None] <= src[:, None]] = -np.inf
    elif not later and dst[0] <= src[-1] and src[0] <= dst[-1]:
        sim[dst[None] == src[:, None]] = -np.inf
    return sim


def matrix(batches: list[pa.RecordBatch], column: str = "v") -> np.ndarray:
    """The vectors of (.., column, ..) batches as one matrix of doubles."""
    parts = [b.column(column) for b in batches]
    flat = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts])
    return flat.reshape(sum(len(p) for p in parts), -1).astype(np.float64, copy=False)


def numbers(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([b.column(column).to_numpy(zero_copy_only=False) for b in batches])


def grid(points: DataFrame, n: int, d: int, work: Callable[[list[pa.RecordBatch], list[pa.RecordBatch] | None], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK) -> DataFrame:
    """``work(one, other)`` of each two blocks of rows of (id, v, ..) and, with None as the other, of each block with itself.

    A block has about ``block`` numbers, or less where there would be too few pairs for all cores.  Each pair of blocks is a task, which
    holds these two blocks alone; a row goes to as many tasks as there are blocks.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    m = max(-(-n * max(1, d) // block), min(int((4 * cores) ** 0.5) + 1, -(-n // 500)))
    cells = m * (m + 1) // 2
    low, high = F.least("own", "other").cast("int"), F.greatest("own", "other").cast("int")
    placed = points.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    placed = placed.withColumn("cell", (high * (high + 1) / 2 + low).cast("int")).withColumn("first", F.col("own") == low).drop("own", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other, cell = [], [], 0
        for b in batches:
            if b.num_rows:
                cell, own = b.column("cell")[0].as_py(), b.column("first")
                for to, mine in ((one, own), (other, pa.compute.invert(own))):
                    part = b.filter(mine)
                    if part.num_rows:
                        to.append(part)
        high = int(((8 * cell + 1) ** 0.5 - 1) / 2)
        if one and cell - high * (high + 1) // 2 == high:
            yield from work(one, None)
        elif one and other:
            yield from work(one, other)

    return placed.repartitionById(cells, "cell").mapInArrow(run, schema)


def _usable(points: DataFrame) -> DataFrame:
    return points.filter("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))


def _by_id(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    ids, x = numbers(batches, "id"), matrix(batches)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def tops(points: DataFrame, k: int, least: float, places: int = 12, later: bool = False, held: int = HELD, block: int = BLOCK, gap: bool = True) -> DataFrame:
    """(src, dst, weight, gap) of (id, v): each id's ``k`` most similar others by cosine, ties to the smaller id; with ``later``, of
    greater ids only.  ``gap`` is the Euclidean distance, and is left out if false.

    Exact, so the work is quadratic; memory is not: up to ``held`` numbers each task holds all vectors, beyond it two blocks.
    """
    schema, points = "src long, dst long, weight double" + ", gap double" * gap, _usable(points)
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return points.sparkSession.createDataFrame([], schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield nearest(*_by_id([b]), *shared.value, k, least, places, later).select(["src", "dst", "weight", "gap"][: 3 + gap])

    def work(one: list[pa.RecordBatch], other: list[pa.RecordBatch] | None) -> Iterator[pa.RecordBatch]:
        src, a = _by_id(one)
        one.clear()  # the matrices are all that is kept of a block
        mine, u = Tops(len(a), k, least, places), units(a)
        a = a if gap else None
        if other is None:
            _meet(src, u, src, u, mine, None, later)
            yield mine.edges(src, src, a, a)
            return
        dst, b = _by_id(other)
        other.clear()
        theirs, w = Tops(len(b), k, least, places), units(b)
        b = b if gap else None
        _meet(src, u, dst, w, mine, theirs, later)
        yield mine.edges(src, dst, a, b)
        yield theirs.edges(dst, src, b, a)

    if size["n"] * size["d"] <= held:
        shared = points.sparkSession.sparkContext.broadcast(_by_id(points.toArrow().to_batches()))
        found = points.repartition(points.sparkSession.sparkContext.defaultParallelism).mapInArrow(rows, schema)
    else:
        found = grid(points, size["n"], size["d"], work, schema, block)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return found.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def knn_graph(points: DataFrame, k: int = 15, min_similarity: float = 0.3, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """(src, dst, weight): each vector's ``k`` nearest others by cosine, of at least ``min_similarity`` (inclusive).

    ``points``: (id long, v array).  Every vector is a query and every other a candidate; ties go to the smaller id.  The threshold
    before the top-k or after it gives the same edges.
    """
    return tops(points, k, min_similarity, held=held, block=block, gap=False)


def symmetrise(edges: DataFrame) -> DataFrame:
    """Undirected adjacency in both directions; a mutual pair's weights add up."""
    there, back = F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = edges.select(F.explode(F.array(there, back)).alias("e")).select("e.*")  # one pass: a union would find the edges twice
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy("src").agg(F.sum("weight").alias("degree"))


def graph_stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges (directed), n_connected, n_isolated, avg_degree = 2 E / n."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().agg(F.count("*").alias("n_connected"))
    whole = points.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(ends)
    return whole.select("n_nodes", "n_edges", "n_connected", (F.col("n_nodes") - F.col("n_connected")).alias("n_isolated"), F.when(F.col("n_nodes") == 0, 0.0).otherwise(2.0 * F.col("n_edges") / F.col("n_nodes")).alias("avg_degree"))
