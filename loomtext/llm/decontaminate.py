"""Benchmark decontamination by winnowing.

Both sides are cut into words (lower-cased; see ``kernels``).  Of every window of ``w`` successive k-gram
hashes the smallest is kept; a passage of at least ``w + k - 1`` words that a document shares with a
benchmark item therefore leaves a common fingerprint.  Fingerprints are joined, and each hit is extended
word by word to the whole shared passage.

Cases: a null or empty text has no words and no hits, whichever side it is on; rows with a null id are left
alone (they are never reported, and the filter keeps them); repeated rows, of either table, give one result per distinct
(document, item, position); several texts of one id, in either table, are matched apart, and the filter drops those that share a passage
and no other; documents of any length are read whole; other columns of either table are
carried by the filter and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import Scratch, maybe_broadcast, text_key, with_ids, within, without

GRAM, WINDOW = 5, 4
#: Benchmark fingerprints up to this number are handed to the scan as a sorted array; more are joined.
FILTER_HASHES = 2_000_000


def _prints(raw: np.ndarray, off: np.ndarray, k: int, w: int):
    """(document number, word position, hash) of a chunk's fingerprints."""
    words = K.Words(raw, off)
    g = K.grams(words.hashes(), k)
    at = K.window_minima(g, K.starts_with_room(words.off, k + w - 1), w)
    doc = np.searchsorted(words.off, at, "right") - 1
    return doc, at - words.off[doc], g[at]


def _fingerprints(k: int, w: int, only: np.ndarray | None = None):
    """mapInArrow body: (id, x, text) to (id, x, text, pos[], hash[]) for rows that have fingerprints (in ``only``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, off in K.chunks(b.column(2)):
                doc, pos, h = _prints(raw, off, k, w)
                if only is not None:
                    if not len(only):
                        continue
                    hit = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
                    doc, pos, h = doc[hit], pos[hit], h[hit]
                if len(doc):
                    rows, counts = np.unique(doc, return_counts=True)
                    take = pa.array(rows + lo)
                    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns], K.lists(pos.astype(np.int32), counts, pa.int32()), K.lists(h.view(np.int64), counts, pa.int64())], ["id", "x", "text", "pos", "hash"])

    return run


_FP = "id long, x long, text string, pos array<int>, hash array<long>"


def _words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    x = K.Words(raw, np.array([0, len(raw)]))
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(x.start.tolist(), x.end.tolist())]


def _extend(least: int):
    """mapInArrow body: (doc_id, x, text, item_id, item, at[] of struct(pos, item_pos)) to whole passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            seen: tuple = (None, None)
            for row in b.to_pylist():
                if seen[0] != (row["doc_id"], row["x"]):
                    seen = ((row["doc_id"], row["x"]), _words(row["text"]))
                d, t = seen[1], _words(row["item"])
                reach: dict[int, int] = {}
                for i, j in sorted((x["pos"], x["item_pos"]) for x in row["at"]):
                    if reach.get(i - j, -1) > i or d[i] != t[j]:
                        continue
                    a = 0
                    while i - a > 0 and j - a > 0 and d[i - a - 1] == t[j - a - 1]:
                        a += 1
                    z = 1
                    while i + z < len(d) and j + z < len(t) and d[i + z] == t[j + z]:
                        z += 1
                    reach[i - j] = i + z
                    if a + z >= least:
                        out.append((row["doc_id"], row["x"], row["item_id"], i - a, j - a, a + z))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3)], ["doc_id", "x", "item_id", "doc_start", "item_start", "n_words"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return with_ids(docs).select(F.col("doc_id").cast("long").alias("id"), text_key().alias("x"), F.lower("text").alias("text"))


def _passages(docs: DataFrame, items: DataFrame, k: int, w: int, filter_hashes: int) -> DataFrame:
    """``shared_passages``, with the hash ``x`` of the document's text beside its id."""
    scratch = Scratch(docs.sparkSession, "passages")
    test = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("id"), text_key().alias("x"), F.lower("text").alias("text")).distinct()
    prints = scratch.table(test.mapInArrow(_fingerprints(k, w), _FP), "items")
    entries = lambda t: t.select("id", "x", F.explode(F.arrays_zip("pos", "hash")).alias("p")).select("id", "x", "p.pos", "p.hash")
    keys = entries(prints).toDF("item_id", "item_x", "item_pos", "hash")
    n = prints.agg(F.coalesce(F.sum(F.size("hash")), F.lit(0)).alias("n")).first()["n"]
    only = None
    if n <= filter_hashes:
        found = keys.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)
        only = np.sort(found.view(np.uint64))
    # Positions are joined without texts, which then come to the pairs that have met
    prints_of = _keyed(docs).mapInArrow(_fingerprints(k, w, only), _FP)
    hits = scratch.table(prints_of, "hits") if only is not None else prints_of
    met = entries(hits).join(maybe_broadcast(keys), "hash")
    pairs = scratch.table(met.groupBy("id", "x", "item_id", "item_x").agg(F.collect_set(F.struct("pos", "item_pos")).alias("at")), "pairs")
    whole = hits if only is not None else _keyed(within(docs, pairs.select(F.col("id").alias("doc_id"), "x")))
    pairs = pairs.join(whole.select("id", "x", "text"), ["id", "x"])
    texts = prints.select(F.col("id").alias("item_id"), F.col("x").alias("item_x"), F.col("text").alias("item"))
    pairs = pairs.join(maybe_broadcast(texts), ["item_id", "item_x"])
    found = pairs.select(F.col("id").alias("doc_id"), "x", "text", "item_id", "item", "at").mapInArrow(_extend(w + k - 1), "doc_id long, x long, item_id long, doc_start int, item_start int, n_words int")
    return found.distinct()


def shared_passages(docs: DataFrame, items: DataFrame, k: int = GRAM, w: int = WINDOW, filter_hashes: int = FILTER_HASHES) -> DataFrame:
    """Every passage of at least ``w + k - 1`` words that a document shares with a benchmark item.

    Columns: doc_id, item_id, doc_start, item_start (word positions), n_words; a passage is maximal: it can't be
    extended at either end.  The documents are read once and only those with a hit move on.  Up to
    ``filter_hashes`` benchmark fingerprints the scan drops what cannot join; beyond, all fingerprints are
    shuffled to the join, with the same result.
    """
    return _passages(docs, items, k, w, filter_hashes).drop("x").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, k: int = GRAM, w: int = WINDOW, filter_hashes: int = FILTER_HASHES) -> DataFrame:
    """``docs`` without the documents that share a passage with a benchmark item; rows and columns as they were."""
    scratch = Scratch(docs.sparkSession, "tainted")
    tainted = scratch.table(_passages(docs, items, k, w, filter_hashes).select("doc_id", "x").distinct(), "ids")
    return without(docs, tainted)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share with the benchmark."""
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
 tw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
 dp AS (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM dw WHERE len(w) >= 8),
 tp AS (SELECT item_id, w, unnest(range(len(w) - 7)) AS j FROM tw WHERE len(w) >= 8),
 dg AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM dp),
 tg AS (SELECT item_id, j, array_to_string(w[j + 1 : j + 8], ' ') AS g FROM tp),
 m AS (SELECT DISTINCT doc_id, item_id, i, j FROM dg JOIN tg USING (g)),
 r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM m)
SELECT doc_id, item_id, CAST(min(i) AS INTEGER) AS doc_start, CAST(min(j) AS INTEGER) AS item_start,
 CAST(count(*) + 7 AS INTEGER) AS n_words
FROM r GROUP BY doc_id, item_id, i - j, island
"""
