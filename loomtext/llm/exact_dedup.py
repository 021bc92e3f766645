"""Exact deduplication by a tree merge of sorted digest runs.

Each partition of documents becomes sorted runs of (SHA-256 digest, doc_id), one for each range of digests.
In rounds, 32 neighbouring runs of a range meet (five binomial rounds at once), are merged, and of each
digest only the smallest id goes on; the ids that lost are set down with the id that beat them.  Ranges are
merged independently, so no task ever holds more than one range, and their number grows with the input up to ``RANGES``.
After the last round the chains loser -> winner -> ... are as long as the tree is high and are followed by joins.
A link of a chain is an id together with the hash of its text, so that an id of several texts links no two of them.

A retained id is verified at each level: the whole 32-byte digest decides equality (the range and sort
use its head), the runs must arrive in order, and the kept id must be the least of its equals.

Cases: a null text equals nothing and stays; empty texts equal each other; rows with a null id stay and never
win; rows of one id with one text are one document and stand or fall together, each row being reported; several texts of one id are
several documents, each with copies of its own; an empty table gives an empty result; other columns are carried by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import Scratch, maybe_broadcast, text_key, with_ids, without

FAN_BITS = 5
#: Documents of a digest range at the root of its tree, on average.
RANGE_ROWS = 250_000
#: Most ranges: more would leave a task's runs a document or two each.  With more documents, ranges grow.
RANGES = 1 << 14
#: x: hash of the text; n: rows of the document.
_SCHEMA = "range int, run long, digests binary, ids array<long>, xs array<long>, ns array<int>, lost array<struct<doc_id:long,x:long,n:int,keep_id:long>>"
_LOST = pa.list_(pa.struct([("doc_id", pa.int64()), ("x", pa.int64()), ("n", pa.int32()), ("keep_id", pa.int64())]))
Part = tuple[np.ndarray, ...]


def _merge(d: np.ndarray, ids: np.ndarray, xs: np.ndarray, ns: np.ndarray) -> tuple[Part, Part]:
    """Sorted (digests, ids, xs, ns) without repeated digests, and the losers (ids, xs, ns, winners).  ``d`` is (n, 4) words."""
    order = np.lexsort((ids, d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    d, ids, xs, ns = d[order], ids[order], xs[order], ns[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1)
    document = new.copy()
    document[1:] |= ids[1:] != ids[:-1]
    winner = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    if not (winner <= ids).all():
        raise AssertionError("a retained id is not the smallest of its equals")
    first = np.flatnonzero(document)
    ns = np.add.reduceat(ns, first) if len(first) else ns
    d, ids, xs, new, winner = d[first], ids[first], xs[first], new[first], winner[first]
    return (d[new], ids[new], xs[new], ns[new]), (ids[~new], xs[~new], ns[~new], winner[~new])


def _rows(keys: list, parts: list[tuple[Part, Part]]) -> pa.RecordBatch:
    kept, lost = [[p[0][i] for p in parts] for i in range(4)], [[p[1][i] for p in parts] for i in range(4)]
    count, off = np.array([len(x) for x in kept[1]]), np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in lost[0]], out=off[1:])
    out = pa.StructArray.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(lost, _LOST.value_type)], fields=list(_LOST.value_type))
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([d.tobytes() for d in kept[0]], pa.binary()), *[K.lists(np.concatenate(c), count, t) for c, t in zip(kept[1:], (pa.int64(), pa.int64(), pa.int32()))], pa.ListArray.from_arrays(pa.array(off), out)],
        ["range", "run", "digests", "ids", "xs", "ns", "lost"],
    )


def _runs(ranges: int):
    """mapInArrow body: a partition's (run, doc_id, x, digest) rows to one sorted run per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, ids, xs, no = [], [], [], 0
        for b in batches:
            if b.num_rows:
                no = b.column(0)[0].as_py()
                ids.append(b.column(1).to_numpy())
                xs.append(b.column(2).to_numpy())
                d.append(np.frombuffer(b"".join(b.column(3).to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64))
        if not ids:
            return
        kept, lost = _merge(np.concatenate(d), np.concatenate(ids), np.concatenate(xs), np.ones(sum(map(len, ids)), np.int32))
        place = ((kept[0][:, 0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cut = np.searchsorted(place, np.arange(ranges + 1))
        none = tuple(x[:0] for x in lost)
        keys, parts = [], []
        for r in np.flatnonzero(np.diff(cut)).tolist():
            keys.append((r, no))
            parts.append((tuple(x[cut[r] : cut[r + 1]] for x in kept), none))
        parts[0] = (parts[0][0], lost)
        yield _rows(keys, parts)

    return run


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (range, run, list of runs) to the merged run of each row."""
    for b in batches:
        keys, parts = [], []
        for r, no, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            d = [np.frombuffer(x["digests"].as_py(), np.uint64).reshape(-1, 4) for x in runs]
            rest = [np.concatenate([x[c].values.to_numpy() for x in runs]) for c in ("ids", "xs", "ns")]
            keys.append((r, no))
            parts.append(_merge(np.concatenate(d), *rest))
        if keys:
            yield _rows(keys, parts)


def copies(docs: DataFrame, fan_bits: int = FAN_BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, x, n, keep_id) of each document whose text a document of a smaller id has too; keep_id is the least.

    ``n`` is the number of the document's rows, ``x`` the hash of its text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "copies")
    rows = with_ids(docs).filter(F.col("text").isNotNull())
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // range_rows)))
    flat = rows.select(F.spark_partition_id().cast("long").alias("run"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("x"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    levels = [scratch.table(flat.mapInArrow(_runs(ranges), _SCHEMA), "run")]
    runs = (levels[0].agg(F.max("run").alias("m")).first()["m"] or 0) + 1
    while runs > 1:
        runs = -(-runs // (1 << fan_bits))
        met = levels[-1].groupBy("range", F.shiftright("run", fan_bits).alias("run")).agg(F.collect_list(F.struct("digests", "ids", "xs", "ns")).alias("runs"))
        levels.append(scratch.table(met.mapInArrow(_level, _SCHEMA), "run"))
    found = None
    for level in reversed(levels):
        lost = level.select(F.explode("lost").alias("l")).select("l.*")
        if found is not None:
            above = found.select(F.col("doc_id").alias("keep_id"), "x", F.col("keep_id").alias("over")).distinct()  # rows of a document may lose in several runs
            lost = found.unionByName(lost.join(maybe_broadcast(above), ["keep_id", "x"], "left").select("doc_id", "x", "n", F.coalesce("over", "keep_id").alias("keep_id")))
        found = scratch.table(lost, "lost")
    return found


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, that of the smallest id, for each text."""
    return without(docs, copies(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document whose text occurs under a smaller id, with the smallest such id."""
    found = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", F.explode(F.sequence(F.lit(1), "n")).alias("row")).drop("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


ORACLE = """
SELECT doc_id, keep_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> keep_id
"""
