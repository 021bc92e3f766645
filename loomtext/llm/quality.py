"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Sixteen statistics describe a document: size, make-up by kinds of characters, word lengths, and repetition.
Standardised, they go through random Fourier features (cosines of random projections, whose inner products
approximate a Gaussian kernel).  The normal equations of ridge regression on the 0/1 label are summed in the
partitions, for each of five folds apart; a fold's score comes from the sums of the other four.  Isotonic
regression (pool adjacent violators, over a histogram of these out-of-fold scores) turns scores into
probabilities.  At most ``FIT_LABELS`` labelled ids, chosen by a hash, are fitted on, so that their list can be broadcast and only
their texts are described for it; only sums of fixed size come to the driver.  All documents are scored.

Cases: a null text counts as empty; an empty text has statistics (zeros) and a score like any other; texts of any length are
described whole; rows with a null id are scored, but can't be labelled; several labels of one document are averaged, null labels
ignored; of an id of several texts each has its label; without any label, or with one kind only, every document scores that share (1 if
there is none); repeated rows are scored alike; other columns are carried by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import Scratch

FEATURES, FOURIER, RIDGE, FOLDS, BINS, KEEP = 16, 255, 1e-3, 5, 2000, 0.5
#: Labelled ids that the model is fitted on, at most.
FIT_LABELS = 400_000
#: Labelled rows for which one task sums the normal equations.
FIT_ROWS = 50_000
_KIND = np.full(256, 11, np.int64)
for _c, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "!?", "|<>{}[]\\/=_^~`", "#$%&*@+", ".,;:", "'\"()-")):
    _KIND[[ord(x) for x in _chars]] = _c
_KIND[128:] = 10


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, 16) statistics of a chunk."""
    n = len(off) - 1
    size = np.diff(off)
    kinds = np.bincount(np.repeat(np.arange(n) * 12, size) + _KIND[raw], minlength=n * 12).reshape(n, 12).astype(float)
    words = K.Words(raw, off)
    h, owner = words.hashes(), K.owners(words.off)
    length = words.end - words.start
    some = np.maximum(words.count, 1)
    total = np.maximum(size, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 10], 1)
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    unlike = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    mean = np.bincount(owner, length, n) / some
    out = np.empty((n, FEATURES))
    out[:, 0] = np.log1p(size)
    out[:, 1] = kinds[:, 1] / letters
    for i, k in enumerate((2, 3, 4, 5, 6, 7, 8, 9, 10, 11)):
        out[:, 2 + i] = np.sqrt(kinds[:, k] / total)
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / some - mean**2, 0))
    out[:, 14] = unlike / np.sqrt(some)
    out[:, 15] = np.sqrt(np.bincount(owner, again, n) / some)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the Fourier features and a constant
    knots: np.ndarray  # scores, ascending
    values: np.ndarray  # calibrated probabilities at the knots

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(fourier((x - self.mean) / self.scale) @ self.weights, self.knots, self.values)


def fourier(z: np.ndarray) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(5))
    w = rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, FOURIER))
    shift = rng.uniform(0, 2 * np.pi, FOURIER)
    out = np.ones((len(z), FOURIER + 1))
    np.cos(np.clip(z, -6, 6) @ w + shift, out=out[:, :FOURIER])
    out[:, :FOURIER] *= np.sqrt(2 / FOURIER)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, FEATURES)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (text, y, fold) to (x, y, fold)."""
    for b in batches:
        for lo, hi, raw, off in K.chunks(b.column(0)):
            yield pa.RecordBatch.from_arrays([K.lists(statistics(raw, off).ravel(), np.full(hi - lo, FEATURES), pa.float64()), *[c.slice(lo, hi - lo) for c in b.columns[1:]]], ["x", "y", "fold"])


def _sums(mean: np.ndarray, scale: np.ndarray):
    """mapInArrow body: (x, y, fold) to rows (fold, i, the i-th row of this partition's normal equations)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FOURIER + 1
        total = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            if b.num_rows:
                z, y, fold = fourier((_matrix(b.column(0)) - mean) / scale), b.column(1).to_numpy(), b.column(2).to_numpy()
                for f in np.unique(fold):
                    a = z[fold == f]
                    total[f] += a.T @ np.column_stack([a, y[fold == f]])
        used = np.flatnonzero(total.any(axis=(1, 2)))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, d), pa.int32()), pa.array(np.tile(np.arange(d), len(used)), pa.int32()), pa.array([r.tobytes() for r in total[used].reshape(-1, d + 1)], pa.binary())], ["fold", "i", "row"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [np.sum([np.frombuffer(x.as_py()) for x in r.values], axis=0).tobytes() for r in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["fold", "i", "row"])


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ``y`` (pool adjacent violators); ``score`` is ascending."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _scored(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
    """mapInArrow body: (x, y, fold) to (bin, y), the score being that of the fold's own weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = fourier((_matrix(b.column(0)) - mean) / scale)
                s = np.einsum("ij,ij->i", z, weights[b.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array(np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), b.column(1)], ["bin", "y"])

    return run


def _labelled(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled ids: those of the smallest hashes, if there are more."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = known.count()
    if n <= most:
        return known
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("quality")), 1)
    below = min(int(1.1 * most / n * (2**63 - 1)), 2**63 - 1)  # so that few are sorted
    return known.filter(h <= F.lit(below)).orderBy(h, "doc_id").limit(most)


def fit(train: DataFrame, labels: DataFrame, scratch: Scratch, fit_labels: int = FIT_LABELS) -> Model:
    """The model of the labelled documents of ``train``; ``labels``: (doc_id, quality 0/1)."""
    known = scratch.table(_labelled(labels, fit_labels), "known").withColumnRenamed("doc_id", "_known")
    met = train.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("_known"))  # at most ``fit_labels`` rows
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = scratch.table(met.select("text", "y", fold).mapInArrow(_describe, "x array<double>, y double, fold int"), "labelled")
    moments = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(FEATURES) for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"] or not 0 < moments["y"] < 1:
        share = 1.0 if not moments["n"] else float(moments["y"])
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FOURIER + 1), np.zeros(1), np.full(1, share))
    mean = np.array([moments[f"avg{i}"] for i in range(FEATURES)])
    scale = np.maximum([moments[f"stddev_pop{i}"] for i in range(FEATURES)], 1e-6)
    fitted = rows.repartition(max(1, -(-moments["n"] // FIT_ROWS))).mapInArrow(_sums(mean, scale), "fold int, i int, row binary")
    summed = fitted.groupBy("fold", "i").agg(F.collect_list("row").alias("rows")).mapInArrow(_add, "fold int, i int, row binary")
    d = FOURIER + 1
    total = np.zeros((FOLDS, d, d + 1))
    for r in summed.collect():  # FOLDS x 256 rows, whatever the input
        total[r["fold"], r["i"]] = np.frombuffer(r["row"])

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :d] + RIDGE * max(s[d - 1, d - 1], 1.0) * np.eye(d), s[:, d])

    weights = np.array([solve(total.sum(axis=0) - total[f]) for f in range(FOLDS)])
    bins = rows.mapInArrow(_scored(mean, scale, weights), "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS rows
    at = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    return Model(mean, scale, solve(total.sum(axis=0)), at, isotonic(at, np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins])))


def _apply(model: Model, keep: float):
    """mapInArrow body: (doc_id, text) to (doc_id, quality_score, keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, off in K.chunks(b.column(1)):
                p = model.probability(statistics(raw, off))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array(p >= keep)], ["doc_id", "quality_score", "keep"])

    return run


def _filter(model: Model, keep: float, at: int):
    """mapInArrow body: the rows whose text, in column ``at``, is good enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = [model.probability(statistics(raw, off)) for _, _, raw, off in K.chunks(b.column(at))]
                yield b.filter(pa.array(np.concatenate(p) >= keep))

    return run


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, fit_labels: int = FIT_LABELS) -> DataFrame:
    """(doc_id, quality_score, keep) of every document: its probability of being good, learnt from ``labels``."""
    model = fit(docs, labels, Scratch(docs.sparkSession, "quality"), fit_labels)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_apply(model, keep), "doc_id long, quality_score double, keep boolean")


def keep_good(docs: DataFrame, train: DataFrame, labels: DataFrame, keep: float = KEEP, fit_labels: int = FIT_LABELS) -> DataFrame:
    """The rows of ``docs`` that a model learnt from ``train`` and its ``labels`` accepts.  No row is moved."""
    model = fit(train, labels, Scratch(docs.sparkSession, "quality"), fit_labels)
    return docs.mapInArrow(_filter(model, keep, docs.columns.index("text")), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, and whether it is kept."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
