"""Substring deduplication by a compacted de Bruijn graph.

A word position is *repeated* if it lies in a run of ``least`` words that occurs at two or more places of the corpus,
in whichever documents.  The result is every document's maximal runs of repeated positions.

1. Edges.  Of each window of ``w`` successive word k-grams the one of the smallest hash is a node; the words from one
   node of a document to its next, both included, are a token k-mer of varying k: an edge.  As
   ``k + 2 w - 1 <= least``, every common run of ``least`` words holds a whole edge in common (two windows that agree choose
   the same k-gram), so this sparse graph misses nothing; it is a tenth the size of one with an edge a word.
2. Edges that occur once can't be part of a repeat.  A run to be found can't hold one (but at its margins, where an edge
   may hang on words outside), so a document is left with regions between them, and regions shorter than ``least`` go.
3. Compaction.  Successive repeated edges of one multiplicity are a path; where a join of the paths' contents finds as many
   equal paths as each of its edges has occurrences, the path does not branch: all occurrences of its edges are in it.
4. Coordinates.  The words of such a path are the same at all its coordinates, so every run inside is repeated, and
   nothing more need be read.  The rest of the regions (the ends of paths, and paths that branch) is verified: the
   texts at the coordinates are read again, every run of ``least`` words that isn't inside one such path is hashed, and
   those that occur twice count.  Equal runs hold equal edges, so both are found on the same side of this division.

Only counts travel.  Edges (and runs) stay in written blocks of whole documents; of each block the distinct ones go, with their
number there, to the task that adds them up, and what occurs twice in the corpus comes back to the blocks that have it, as files that the
scan of a block reads for itself.  An edge that every document has is one entry for each block, and no document is ever shuffled.

Cases: texts of fewer than ``least`` words (null and empty ones, too) have no repeats; rows with a null id are left
out; repeated rows (one id, one text) are one document; several texts of one id are several; a run repeated
inside one document counts; overlapping repeats become one span; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import GROUPS, PARTITIONS, Scratch, attach, by_part, maybe_broadcast, read_group, text_key, with_ids, within, without

LEAST, GRAM, WINDOW = 50, 10, 20
#: Documents whose edges (or runs) are added up together, on average.
PART_DOCS = 8_000
#: Entries of a block, about.
BLOCK = 1 << 18
#: Tasks (2^n of them) whose blocks share a folder of counts.
FOLDER_BITS = 2
LONG, INT, SHORT = pa.int64(), pa.int32(), pa.int16()


def hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the items from ``start`` to ``end`` (both arrays) of the hashed sequence ``h``, by prefix sums."""
    up, down = K.powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return K.mix(K.mix((total[end] - total[start]) * down[start]) + (end - start).astype(np.uint64))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Mask of sorted entries that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _blocks(parts: Iterator[tuple[np.ndarray, ...]], kinds: list[pa.DataType], block: int) -> Iterator[pa.RecordBatch]:
    """Columns of entries, in pieces of whole documents, as rows of about ``block`` entries, a list a column."""
    held: list[tuple[np.ndarray, ...]] = []

    def row() -> pa.RecordBatch:
        c = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([K.lists(x, np.array([len(x)]), t) for x, t in zip(c, kinds)], [f"c{i}" for i in range(len(kinds))])

    for piece in parts:
        held.append(piece)
        if sum(len(p[0]) for p in held) >= block:
            yield row()
            held = []
    if held:
        yield row()


def _edges(k: int, w: int, block: int):
    """mapInArrow body: (doc_id, row, text) to blocks of edges, document by document.

    Columns: edge, doc_id, row, at (first word), gap (to the next node), back and ahead: a run of words that begins more
    than ``back`` before ``at`` surely holds the edge before this one in all its copies, and one that ends more
    than ``ahead`` after this edge's end the next one.  (An edge at the margin of a run may owe its nodes to words outside; it is
    the windows inside the run, from the one that first chooses the second node and the one before it, that make it sure.)
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            ids, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, _, raw, off in K.chunks(b.column(2)):
                words = K.Words(raw, off)
                h = words.hashes()
                at, since = K.chosen_minima(K.grams(h, k), K.starts_with_room(words.off, k + w - 1), w)
                if len(at) < 2:
                    continue
                doc = np.searchsorted(words.off, at, "right") - 1
                i = np.flatnonzero(doc[1:] == doc[:-1])
                if not len(i):
                    continue
                first, last = _fresh(doc[i]), np.append(_fresh(doc[i])[1:], True)
                pos, gap = at[i] - words.off[doc[i]], at[i + 1] - at[i]
                end = at[i + 1] + k
                back = np.where(first, pos, at[i] - since[i])
                ahead = np.where(last, words.off[doc[i] + 1] - end, since[np.minimum(i + 2, len(at) - 1)] + w + k - 2 - end)
                yield (hashes(h, at[i], end).view(np.int64), ids[doc[i] + lo], rows[doc[i] + lo], pos.astype(np.int32), *[x.astype(np.int16) for x in (gap, back, ahead)])

    return lambda batches: _blocks(pieces(batches), [LONG, LONG, INT, INT, SHORT, SHORT, SHORT], block)


_EDGES = "c0 array<long>, c1 array<long>, c2 array<int>, c3 array<int>, c4 array<short>, c5 array<short>, c6 array<short>"


def _distinct(parts: int):
    """mapInArrow body: (block, keys) to a block's distinct keys and their numbers, scattered by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys in zip(b.column(0).to_pylist(), b.column(1)):
                key, n = np.unique(keys.values.to_numpy(), return_counts=True)
                sent = K.scatter(key.view(np.uint64), parts, [(key, LONG), (n.astype(np.int32), INT)])
                yield sent.append_column("block", pa.array(np.full(sent.num_rows, block)))

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: scattered keys to (block, keys that occur twice or more in all blocks, how often)."""
    for rows in K.groups(batches):
        key, n = K.gather(rows, [np.int64, np.int32])
        block = np.concatenate([np.repeat(r.column(3).to_numpy(), r.column(1).value_lengths().to_numpy()) for r in rows])
        order = np.argsort(key, kind="stable")
        key, block = key[order], block[order]
        first = np.flatnonzero(_fresh(key))
        total = np.repeat(np.add.reduceat(n[order].astype(np.int64), first), np.diff(np.append(first, len(key))))
        many = np.flatnonzero(total > 1)
        many = many[np.argsort(block[many], kind="stable")]
        if len(many):
            own, size = np.unique(block[many], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), K.lists(key[many], size, LONG), K.lists(total[many], size, LONG)], ["block", "keys", "n"])


def _repeated(blocks: DataFrame, parts: int, scratch: Scratch) -> str:
    """The folder of what ``known`` gives for each block: its keys (column c0) that occur twice or more in all blocks."""
    sent = blocks.select("block", "c0").mapInArrow(_distinct(parts), "part int, c0 array<long>, c1 array<int>, block long")
    found = by_part(sent, parts).mapInArrow(_add, "block long, keys array<long>, n array<long>")
    folder = F.shiftright("block", 33 + FOLDER_BITS).cast("int").alias("g")
    scratch.table(found.select("*", folder).repartition(min(parts, PARTITIONS), "g"), "repeated", by="g")
    return scratch.kept[-1]


@lru_cache(1)
def _folder(root: str, group: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    t, found = read_group(root, group), {}
    if t is not None:
        block, keys, n = t["block"].to_numpy(), t["keys"].combine_chunks(), t["n"].combine_chunks()
        for b in np.unique(block).tolist():
            rows = pa.array(np.flatnonzero(block == b))
            key, count = keys.take(rows).flatten().to_numpy(), n.take(rows).flatten().to_numpy()
            order = np.argsort(key, kind="stable")
            found[b] = key[order], count[order]
    return found


def known(root: str, block: int, key: np.ndarray) -> np.ndarray:
    """How often each key of a block occurs in all blocks; 0 if once."""
    have, n = _folder(root, block >> (33 + FOLDER_BITS)).get(block, (key[:0], key[:0]))
    if not len(have):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(have, key), len(have) - 1)
    return np.where(have[at] == key, n[at], 0)


def _rows_of(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[list[np.ndarray]]:
    """Of each block (its number, then columns) the entries whose key occurs twice or more, with their numbers as the last column."""
    for b in batches:
        for i, block in enumerate(b.column(0).to_pylist()):
            c = [x[i].values.to_numpy() for x in b.columns[1:]]
            n = known(root, block, c[0])
            many = n > 1
            if many.any():
                yield [x[many] for x in [*c, n]]


def _paths(k: int, least: int, root: str):
    """mapInArrow body: blocks of edges to their documents' regions (hash null) and paths of ``least`` words or more.

    Out: (hash, n, doc_id, row, a, z), where a and z bound words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _rows_of(batches, root):
            edge, doc, row, at, gap, back, ahead, n = (x.astype(np.int64) for x in c)
            apart = _fresh(doc, row)
            apart[1:] |= at[1:] != at[:-1] + gap[:-1]
            end = at + gap + k
            s = np.flatnonzero(apart)
            e = np.append(s[1:], len(at)) - 1
            lo, hi = np.maximum(at[s] - back[s], np.maximum(end[s] - least, 0)), np.minimum(end[e] + ahead[e], at[e] + least)
            room = hi - lo >= least
            step = apart.copy()
            step[1:] |= n[1:] != n[:-1]
            p = np.flatnonzero(step)
            q = np.append(p[1:], len(at))
            long = end[q - 1] - at[p] >= least
            p, q = p[long], q[long]
            h = hashes(K.mix(edge.view(np.uint64)), p, q).view(np.int64)
            r = s[room]
            null = np.concatenate([np.ones(len(r), bool), np.zeros(len(p), bool)])
            join = lambda x, y, t: pa.array(np.concatenate([x, y]), t)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(r), np.int64), h]), mask=null), join(n[r], n[p], LONG), join(doc[r], doc[p], LONG), join(row[r].astype(np.int32), row[p].astype(np.int32), INT), join(lo[room], at[p], INT), join(hi[room], end[q - 1], INT)], ["hash", "n", "doc_id", "row", "a", "z"])

    return run


def _reach(n: int, base: np.ndarray, spans: pa.Array) -> np.ndarray:
    """For each of ``n`` positions, the farthest end of a span that begins there or before."""
    count = spans.value_lengths().to_numpy()
    off, flat = np.repeat(base, count), spans.flatten()
    reach = np.zeros(n + 1, np.int64)
    np.maximum.at(reach, off + flat.field(0).to_numpy(), off + flat.field(1).to_numpy())
    return np.maximum.accumulate(reach)


def _runs(least: int, block: int):
    """mapInArrow body: (doc_id, row, text, regions, sure) to blocks of the runs of ``least`` words to be counted: hash, doc_id, row, at."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            ids, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, raw, off in K.chunks(b.column(2)):
                words = K.Words(raw, off)
                h, n = words.hashes(), int(words.off[-1])
                at = np.flatnonzero(K.starts_with_room(words.off, least))
                at = at[_reach(n, words.off[:-1], b.column(3).slice(lo, hi - lo))[at] >= at + least]
                at = at[_reach(n, words.off[:-1], b.column(4).slice(lo, hi - lo))[at] < at + least]
                if len(at):
                    doc = np.searchsorted(words.off, at, "right") - 1
                    yield hashes(h, at, at + least).view(np.int64), ids[doc + lo], rows[doc + lo], (at - words.off[doc]).astype(np.int32)

    return lambda batches: _blocks(pieces(batches), [LONG, LONG, INT, INT], block)


def _join_runs(least: int, root: str):
    """mapInArrow body: blocks of runs to the spans (doc_id, row, a, z) that their repeated ones cover together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc, row, at, _ in _rows_of(batches, root):
            new = _fresh(doc, row)
            new[1:] |= at[1:] > at[:-1] + least
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(row[s]), pa.array(at[s]), pa.array(at[e] + np.int32(least))], ["doc_id", "row", "a", "z"])

    return run


def _once(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text) of the documents with an id, each once; texts are only looked at where an id is repeated."""
    docs = with_ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = scratch.table(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return docs
    rows = docs.join(maybe_broadcast(again), "doc_id").groupBy("doc_id", text_key().alias("x")).agg(F.count("*").alias("n"))
    twice = scratch.table(rows.filter("n > 1").select("doc_id", "x"), "twice")
    return without(docs, twice).unionByName(within(docs, twice).dropDuplicates(["doc_id", "text"]))


def repeated_spans(docs: DataFrame, least: int = LEAST, k: int = GRAM, w: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): each maximal run of repeated words; ``end_word`` is exclusive."""
    if k + 2 * w - 1 > least:
        raise ValueError("k + 2 w - 1 must not exceed the least length")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    parts = min(GROUPS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_DOCS)))
    docs = _once(docs, scratch)
    numbered = lambda blocks, name: scratch.table(blocks.withColumn("block", F.monotonically_increasing_id()), name)  # noqa: E731  written, so that a block's number stays
    row = F.hash("text").alias("row")
    edges = numbered(docs.select("doc_id", row, F.lower("text").alias("text")).mapInArrow(_edges(k, w, block), _EDGES), "edges")
    root = _repeated(edges, parts, scratch)
    found = scratch.table(edges.select("block", *[f"c{i}" for i in range(7)]).mapInArrow(_paths(k, least, root), "hash long, n long, doc_id long, row int, a int, z int"), "paths")
    key = ["doc_id", "row"]
    paths = found.filter("hash IS NOT NULL")
    whole = paths.groupBy("hash", "n").agg(F.count("*").alias("equal")).filter("equal = n").select("hash")
    sure = scratch.table(paths.join(maybe_broadcast(whole), "hash").select(*key, "a", "z"), "sure")
    # Spans of a document, ascending; only documents with a region need be read
    regions = found.filter("hash IS NULL").groupBy(*key).agg(F.collect_list(F.struct("a", "z")).alias("regions"))
    certain = sure.groupBy(*key).agg(F.collect_list(F.struct("a", "z")).alias("sure"))
    spans = scratch.table(regions.join(certain, key, "left").select(*key, "regions", F.coalesce("sure", F.array().cast("array<struct<a:int,z:int>>")).alias("sure")), "spans")
    reread = attach(docs, spans.withColumnRenamed("row", "x"), F.hash("text")).select("doc_id", row, F.lower("text").alias("text"), "regions", "sure")
    runs = numbered(reread.mapInArrow(_runs(least, block), "c0 array<long>, c1 array<long>, c2 array<int>, c3 array<int>"), "runs")
    root = _repeated(runs, parts, scratch)
    read = runs.select("block", *[f"c{i}" for i in range(4)]).mapInArrow(_join_runs(least, root), "doc_id long, row int, a int, z int")
    order = Window.partitionBy(*key).orderBy("a", "z")
    reached = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = read.unionByName(sure).withColumn("new", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    return islands.groupBy(*key, "island").agg(F.min("a").alias("start_word"), F.max("z").alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words")).distinct()


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of 50 words or more that the corpus repeats, in each document that has it."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
 p AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM dw WHERE len(w) >= 50),
 g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM p),
 t AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
 m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM g JOIN t USING (h)),
 s AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word, CAST(max(i) + 50 - min(i) AS INTEGER) AS n_words
FROM s GROUP BY doc_id, island
"""
