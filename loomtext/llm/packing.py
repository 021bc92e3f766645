"""Best-fit packing of documents into context windows by patterns.

A document of n words takes n + 1 places (one for the end mark); longer ones are cut into whole windows and a rest.
Lengths are rounded up to one of 128 size classes.  Patterns of one to four pieces that fill a window exactly are
enumerated, and non-negative least squares fits how often each is to be repeated to the histogram of
classes.  The counts are rounded down to what the histogram has, and what is left is packed best fit
first, largest class first, on counts of like bins rather than on single pieces.

Only the histogram (128 counts) and the plan come to the driver.  A piece finds its bin by its rank
in its class; ranks are counted in salted groups, so no class is sorted in one task.

Cases: null and empty texts, and those without a letter or digit ("!!! ???"), have no words and aren't packed (a tokenizer
counts what it finds there); texts of any length are cut into as many pieces as they need; a null id is packed like any other; repeated rows
are pieces of their own; equal lengths are ranked by id and chunk; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import Scratch, maybe_broadcast

CAPACITY, CLASSES = 2048, 128
#: Pieces of one (class, salt) group, on average.
GROUP_ROWS = 2_000


def _pieces(capacity: int, tokenizer: str | None):
    """mapInArrow body: (doc_id, text) to (doc_id, chunk_no, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if tokenizer:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            model.encode_special_tokens = True
        for b in batches:
            for lo, hi, raw, off in K.chunks(b.column(1)):
                if model:
                    texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                    n = np.array([len(e) for e in model.encode_batch(texts, add_special_tokens=False)], np.int64)
                else:
                    n = K.Words(raw, off).count
                rows = np.flatnonzero(n)
                n = n[rows] + 1
                m = -(-n // capacity)
                at = np.repeat(rows, m)
                no = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
                length = np.minimum(np.repeat(n, m) - no * capacity, capacity)
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + lo)), pa.array(no, pa.int32()), pa.array(length, pa.int32())], ["doc_id", "chunk_no", "n_tokens"])

    return run


@lru_cache(4)
def patterns(classes: int, most: int = 4) -> np.ndarray:
    """All multisets of up to ``most`` sizes that add up to ``classes``, a column each."""
    found: list[list[int]] = []

    def grow(have: list[int], left: int, least: int) -> None:
        if left >= least:
            found.append([*have, left])
        if len(have) < most - 1:
            for x in range(least, left // 2 + 1):
                grow([*have, x], left - x, x)

    grow([], classes, 1)
    a = np.zeros((classes, len(found)))
    for j, p in enumerate(found):
        for x in p:
            a[x - 1, j] += 1
    return a


def nnls(a: np.ndarray, y: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - y| (Lawson and Hanson's active sets)."""
    x = np.zeros(a.shape[1])
    on = np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(y).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (y - a @ x)
        w[on] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        on[j] = True
        while True:
            s = np.zeros_like(x)
            s[on] = np.linalg.lstsq(a[:, on], y, rcond=None)[0]
            if s[on].min() > 0:
                x = s
                break
            low = on & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            on &= x > tol * 1e-3
            x[~on] = 0
            if not on.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, pieces of each class in such a bin) that together hold the histogram exactly."""
    classes = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    if left.sum() == 0:
        return out
    a = patterns(classes)
    x = nnls(a, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1 - 1e-6:
            break
        use = {int(c) + 1: int(a[c, j]) for c in np.flatnonzero(a[:, j])}
        n = min([int(x[j] + 1e-6), *(int(left[c - 1]) // m for c, m in use.items())])
        if n:
            out.append((n, use))
            for c, m in use.items():
                left[c - 1] -= n * m
    open_: list[list] = []  # [room, bins, content]
    for c in range(classes, 0, -1):
        todo = int(left[c - 1])
        while todo:
            fits = [b for b in open_ if b[0] >= c]
            if fits:
                best = min(fits, key=lambda b: b[0])
            else:
                best = [classes, -(-todo // (classes // c)), {}]
                open_.append(best)
            m = min(best[0] // c, todo)
            bins = min(best[1], todo // m)
            if bins < best[1]:
                open_.append([best[0], best[1] - bins, dict(best[2])])
                best[1] = bins
            best[0] -= m * c
            best[2] = best[2] | {c: best[2].get(c, 0) + m}
            todo -= m * bins
    return out + [(b[1], b[2]) for b in open_ if b[1]]


def slots(bins: list[tuple[int, dict[int, int]]], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per class and run of ranks: key (class and first rank), first rank, first bin, pieces a bin, first slot."""
    used, base = np.zeros(classes + 1, np.int64), 0
    rows = []
    for n, use in bins:
        before = 0
        for c in sorted(use, reverse=True):
            rows.append(((c << 48) + used[c], used[c], base, use[c], before))
            used[c] += n * use[c]
            before += use[c]
        base += n
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return t[:, 0], t[:, 1], t[:, 2], t[:, 3], t[:, 4]


def _place(table: tuple[np.ndarray, ...]):
    key, first, base, each, before = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rank = b.column(4).to_numpy()
                at = np.searchsorted(key, (b.column(3).to_numpy().astype(np.int64) << 48) + rank, "right") - 1
                r = rank - first[at]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(base[at] + r // each[at]), pa.array((before[at] + r % each[at]).astype(np.int32))], ["doc_id", "chunk_no", "n_tokens", "bin_id", "slot"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, chunk_no, n_tokens, bin_id, slot): every piece of every document in one bin of ``capacity``.

    ``tokenizer``: path of a tokenizer file, to count its tokens in place of words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    unit = -(-capacity // classes)
    classes = capacity // unit
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(classes * unit, tokenizer), "doc_id long, chunk_no int, n_tokens int")
    pieces = scratch.table(counted.withColumn("cls", F.ceil(F.col("n_tokens") / unit).cast("int")), "pieces")
    groups = max(1, pieces.count() // (GROUP_ROWS * classes))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(groups)).cast("int"))
    count = scratch.table(salted.groupBy("cls", "salt").agg(F.count("*").alias("n")), "count")
    histogram = np.zeros(classes, np.int64)
    for row in count.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most one row per class
        histogram[row["cls"] - 1] = row["n"]
    before = count.select("cls", "salt", (F.sum("n").over(Window.partitionBy("cls").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "chunk_no", "n_tokens")) - 1
    ranked = salted.withColumn("r", rank).join(maybe_broadcast(before), ["cls", "salt"]).select("doc_id", "chunk_no", "n_tokens", "cls", (F.col("r") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(slots(plan(histogram), classes)), "doc_id long, chunk_no int, n_tokens int, bin_id long, slot int")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the corpus in context windows of 2,048 words."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
