"""Language identification by a byte-level convolutional network.

Text becomes bytes, lower-cased where they are ASCII, in 64 classes; whole texts are cut into windows of 256 bytes,
overlapping by the widest filter less one so that no n-gram falls between two.  In a window, embeddings go
through filters of widths two to five, each filter's maximum over the window through tanh, and these through a
softmax.  A document's language is that of the greatest sum of window log-probabilities.

The network is trained here, in numpy on the driver, by Adam on windows of at most ``train_rows`` labelled
documents (spread over the table by a hash of the id).  Applying it uses that the alphabet is small: a
filter's response is a sum of table rows indexed by pairs of byte classes.

Cases: a null text counts as empty; an empty text has one window of padding, whose verdict is the
network's; rows with a null id get a language too; labels that are null aren't trained on; with no label at all
the language is null; ties go to the alphabetically first; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

CLASSES, DIM, FILTERS, WIDTHS, WINDOW = 64, 8, 16, (2, 3, 4, 5), 256
STEP = WINDOW - max(WIDTHS) + 1
TRAIN_ROWS, EPOCHS, BATCH, RATE = 1_200, 4, 64, 0.01


def _alphabet() -> np.ndarray:
    """Class of each byte: 0 padding, 1-26 letters, 27 blank, 28 digits, 29 other ASCII, 30-63 non-ASCII."""
    t = np.full(256, 29, np.uint8)
    for i in range(26):
        t[[ord("a") + i, ord("A") + i]] = 1 + i
    t[[9, 10, 13, 32]] = 27
    t[48:58] = 28
    for b in range(128, 192):
        t[b] = 30 + (b & 31)  # continuation bytes, upper and lower case of Latin letters alike
    t[192:224], t[224:] = 62, 63
    return t


ALPHABET = _alphabet()


def windows(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of byte classes, the number of each document's windows)."""
    size = np.diff(off)
    n = np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP))
    start = np.repeat(off[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STEP
    end = np.repeat(off[1:], n)
    codes = np.append(ALPHABET[raw], np.zeros(WINDOW, np.uint8))
    at = start[:, None] + np.arange(WINDOW)
    x = codes[np.minimum(at, len(codes) - 1)]
    short = np.flatnonzero(start + WINDOW > end)
    x[short] *= at[short] < end[short, None]
    return x, n


@dataclass
class Network:
    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS) each
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[int, int, np.ndarray]]:
        """(offset in a filter, first column, responses) for the pairs of classes at each even offset, and a single class at the end.

        Filters of several widths have their responses to one pair side by side, so that one look-up serves them all.
        """
        one = [[self.embed @ f[j * DIM : (j + 1) * DIM] for j in range(w)] for w, f in zip(WIDTHS, self.filters)]
        found = []
        for o in range(0, max(WIDTHS) - 1, 2):
            use = [t for t, w in zip(one, WIDTHS) if w >= o + 2]  # the widest
            found.append((o, (len(WIDTHS) - len(use)) * FILTERS, np.concatenate([(t[o][:, None] + t[o + 1][None]).reshape(-1, FILTERS) for t in use], axis=1).astype(np.float32)))
        return found + [(w - 1, i * FILTERS, t[-1].astype(np.float32)) for i, (t, w) in enumerate(zip(one, WIDTHS)) if w % 2]

    def logits(self, x: np.ndarray, tables: list[tuple[int, int, np.ndarray]] | None = None) -> np.ndarray:
        """Log-probabilities (windows, languages)."""
        tables = tables or self.tables()
        pooled = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        full = WINDOW - max(WIDTHS) + 1
        for lo in range(0, len(x), 16):  # small enough for the cache
            part = x[lo : lo + 16].astype(np.intp)
            pair = part[:, :-1] * CLASSES + part[:, 1:]
            a = tables[0][2].take(pair, axis=0, mode="clip")
            for o, c, t in tables[1:]:
                at = (pair if len(t) > CLASSES else part)[:, o:]
                a[:, : at.shape[1], c : c + t.shape[1]] += t.take(at, axis=0, mode="clip")
            best = pooled[lo : lo + 16]
            a[:, :full].max(axis=1, out=best)
            for i, w in enumerate(WIDTHS[:-1]):  # where only narrower filters fit
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                np.maximum(best[:, own], a[:, full : WINDOW - w + 1, own].max(axis=1), out=best[:, own])
        z = np.tanh(pooled + self.bias) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 3, epochs: int = EPOCHS) -> Network:
    """Adam on the cross-entropy of windows ``x`` (byte classes) with languages ``y``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.5, (CLASSES, DIM)), *[rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)) for w in WIDTHS], np.zeros(total), rng.normal(0, total**-0.5, (total, len(names))), np.zeros(len(names))]
    p = [q.astype(np.float32) for q in p]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            b = order[lo : lo + BATCH]
            xb, n = x[b], len(b)
            e = p[0][xb]
            pooled, best = np.empty((n, total), np.float32), []
            for i, w in enumerate(WIDTHS):
                r = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * DIM) @ p[1 + i]
                best.append(r.argmax(axis=1))
                pooled[:, i * FILTERS : (i + 1) * FILTERS] = np.take_along_axis(r, best[i][:, None], 1)[:, 0]
            h = np.tanh(pooled + p[-3])
            z = h @ p[-2] + p[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(n), y[b]] -= 1
            dz /= n
            dh = dz @ p[-2].T * (1 - h * h)
            g = [np.zeros_like(p[0])]
            for i, w in enumerate(WIDTHS):
                at = best[i][:, :, None] + np.arange(w)  # (n, filters, width)
                c = xb[np.arange(n)[:, None, None], at]
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                g.append((p[0][c].reshape(n, FILTERS, w * DIM) * d[:, :, None]).sum(axis=0).T.astype(np.float32))
                np.add.at(g[0], c.ravel(), (p[1 + i].T.reshape(FILTERS, w, DIM)[None] * d[:, :, None, None]).reshape(-1, DIM))
            g += [dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            step += 1
            for q, grad, a, s in zip(p, g, m, v):
                a += 0.1 * (grad - a)
                s += 0.001 * (grad * grad - s)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(names, p[0], p[1:-3], p[-3], p[-2], p[-1])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Network | None:
    """A network for the values of ``lang``, from at most ``train_rows`` documents and four windows of each.

    The rows are those whose hashed id falls under a threshold, so that a scan sends on no more than it needs.
    """
    known = docs.filter("lang IS NOT NULL").select("lang", "doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 1).alias("h"), "text")
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # reads no text
    names, total = sorted(count), sum(count.values())
    if not names:
        return None
    below = min(1.0, 1.5 * train_rows / total) * (2**63 - 1)
    rows = known.filter((F.col("h") <= F.lit(min(int(below), 2**63 - 1))) & F.col("text").isNotNull()).orderBy("h", "text").limit(train_rows).toPandas()
    if not len(rows):
        return None
    data = [t.encode() for t in rows["text"]]
    off = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    x, n = windows(np.frombuffer(b"".join(data), np.uint8), off)
    nth = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    some = (nth * 4) % np.repeat(n, n) < 4
    y = np.repeat([names.index(v) for v in rows["lang"]], n)
    return train(x[some], y[some], names)


def _identify(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for b in batches:
            if b.num_rows == 0:
                continue
            if net is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.float64())], ["doc_id", "language", "confidence"])
                continue
            best, sure = [], []
            for _, _, raw, off in K.chunks(b.column(1)):
                x, n = windows(raw, off)
                s = np.add.reduceat(net.logits(x, tables).astype(float), np.cumsum(n) - n, axis=0) / n[:, None]
                best.append(s.argmax(axis=1))
                q = np.exp(s - s.max(axis=1, keepdims=True))
                sure.append((q / q.sum(axis=1, keepdims=True)).max(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.names, pa.string()).take(pa.array(np.concatenate(best))), pa.array(np.concatenate(sure))], ["doc_id", "language", "confidence"])

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, language, confidence) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_identify(net), "doc_id long, language string, confidence double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a network trained on the table's own ``lang`` labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
