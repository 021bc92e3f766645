"""Near-duplicate groups by b-bit MinHash.

A document is the set of its word 3-grams (words lower-cased).  128 hash minima are taken over the whole text.
42 bands of three full minima give candidate buckets (a pair of J = 0.5 shares one with probability 0.996); of each
minimum only the low b = 4 bits are kept, packed into a 64-byte signature.  In a bucket, the share of equal b-bit slots,
counted on the packed words, gives the similarity corrected for chance collisions: J = (p - 2^-b) / (1 - 2^-b), with a
standard error of 0.05 at J = 0.5.  Pairs at ``MARGIN`` above ``threshold`` are linked; those within ``MARGIN`` of it,
unless other links join them already, are decided by the exact Jaccard similarity of their shingles.  The smallest id of each connected group stays.

Nothing is capped.  Texts of equal minima (their J is 1) are collapsed to the least before any bucket is made; small buckets are
compared in full; in large ones a search from member to member visits what it has not linked yet, which
finds the same groups as all pairs at a cost that is linear where members are alike.  A bucket of more than ``BLOCK`` members is
searched as pairs of blocks, each a row of its own, so that no task or row holds a whole one.

Cases: a text without words (null, empty, punctuation) has no signature and is never a duplicate; a text of one
or two words is one shingle; rows with a null id stay; equal rows are one document and stand or fall together; several texts of one id
are several documents: of a group that holds two of them the one of the smaller text hash counts as the smaller; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .runtime import GROUPS, Scratch, by_part, maybe_broadcast, text_key, with_ids, within, without

SHINGLE, HASHES, BANDS, BITS, THRESHOLD = 3, 128, 42, 4, 0.5
#: Three standard errors of an estimate: how far from the threshold it decides by itself.
MARGIN = 0.15
#: (hash, id) entries that are sorted at once.
BUCKET_ROWS = 1_500_000
#: Members of a bucket that are searched at once; larger buckets are searched by pairs of blocks.
BLOCK = 4_000
_rng = np.random.Generator(np.random.PCG64(77))
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(raw: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingle hashes, each document's slice of them)."""
    words = K.Words(raw, off)
    h = words.hashes()
    g = np.zeros(len(h), np.uint64)
    full = K.grams(h, n)
    g[: len(full)] = full
    ok = K.starts_with_room(words.off, n)
    for few in range(1, n):
        first = words.off[:-1][words.count == few]
        g[first] = K.mix(sum((h[first + j] * np.uint64(2 * j + 3) for j in range(few)), np.zeros(len(first), np.uint64)))
        ok[first] = True
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(ok, out=total[1:])
    return (g[ok] >> np.uint64(32)).astype(np.uint32), total[words.off]


def minima(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have shingles, their 128 minima)."""
    rows = np.flatnonzero(np.diff(off))
    out = np.empty((len(rows), HASHES), np.uint32)
    if len(rows):
        at = off[rows]
        v = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, _A[i], out=v)
            np.add(v, _B[i], out=v)
            out[:, i] = np.minimum.reduceat(v, at)
    return rows, out


def _finish(m: np.ndarray) -> np.ndarray:
    """A bijection that brings all 32 bits into the low ones."""
    m = (m ^ (m >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    m = (m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return m ^ (m >> np.uint32(16))


def signatures(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed b-bit signatures as (n, 64) bytes, band hashes as (n, 42) words) of full minima."""
    low = (_finish(m) & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    packed = low[:, 0::2] | (low[:, 1::2] << np.uint8(4))
    r = HASHES // BANDS
    band = np.zeros((len(m), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(r):
        band = K.mix(band * np.uint64(0x9E3779B97F4A7C15) + m[:, j : r * BANDS : r])
    return packed, band


def twins(m: np.ndarray) -> np.ndarray:
    """16 bytes that are the same for texts of the same minima."""
    h = np.zeros((len(m), 2), np.uint64) + np.array([1, 2], np.uint64)
    for i in range(0, HASHES, 2):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + (m[:, i].astype(np.uint64) << np.uint64(32) | m[:, i + 1])[:, None])
    return h


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, row by row (broadcast); eight words of 64 bits each."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)
    p = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / HASHES
    c = 2.0**-BITS
    return (p - c) / (1 - c)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, off in K.chunks(b.column(2)):
            rows, m = minima(*shingles(raw, off))
            if len(rows):
                sig, band = signatures(m)
                take = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), K.fixed(sig), K.fixed(twins(m)), K.lists(band.ravel().view(np.int64), np.full(len(rows), BANDS), pa.int64())], ["doc_id", "x", "sig", "twin", "bands"])


def _scatter(parts: int):
    """mapInArrow body: (doc_id, bands) to one row per part with the bucket hashes that belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(1).flatten().to_numpy().view(np.uint64)
            ids = np.repeat(b.column(0).to_numpy(), BANDS)
            place = (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            at, n = np.unique(place, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), K.lists(h[order].view(np.int64), n, pa.int64()), K.lists(ids[order], n, pa.int64())], ["part", "hash", "ids"])

    return run


def _blocks(members: np.ndarray, block: int) -> list[np.ndarray]:
    """A bucket's members; those of a large one as all pairs of its blocks, so that any two members meet in one."""
    if len(members) <= block:
        return [members]
    part = np.array_split(members, -(-len(members) // (block // 2)))
    return [np.concatenate([part[i], part[j]]) for j in range(len(part)) for i in range(j)]


def _buckets(block: int):
    """mapInArrow body: the entries of some parts to the member lists of buckets with two members or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in K.groups(batches):
            h, ids = K.gather(rows, [np.int64, np.int64])
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(new, len(h)))
            few = (n > 1) & (n <= block)
            if few.any():
                yield pa.RecordBatch.from_arrays([K.lists(ids[np.repeat(few, n)], n[few], pa.int64())], ["members"])
            for at, size in zip(new[n > block].tolist(), n[n > block].tolist()):
                for pair in _blocks(ids[at : at + size], block):
                    yield pa.RecordBatch.from_arrays([K.lists(pair, np.array([len(pair)]), pa.int64())], ["members"])

    return run


def _link(ids: np.ndarray, sig: np.ndarray, threshold: float, low: float | None = None, unsure: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that span each group of similar members.  Exact: the groups are those of all pairs.

    ``unsure`` gets the pairs between groups whose estimate is from ``low`` up to the threshold: each member of a group is
    compared with all members of the groups after it.
    """
    first = np.lexsort((ids, *sig.T))
    s, d = sig[first], ids[first]
    new = np.ones(len(d), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    lead = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    edges = [(lead[~new], d[~new])]
    rest, s = d[new], s[new]
    while len(rest) > 1:
        front, front_s, rest, s = rest[:1], s[:1], rest[1:], s[1:]
        while len(front) and len(rest):
            j = estimate(s, front_s[0])
            hit = j >= threshold
            edges.append((np.full(hit.sum(), front[0]), rest[hit]))
            if unsure is not None:
                near = rest[(j >= low) & ~hit]
                unsure.append((np.full(len(near), front[0]), near))
            front, front_s = np.concatenate([front[1:], rest[hit]]), np.concatenate([front_s[1:], s[hit]])
            rest, s = rest[~hit], s[~hit]
    return edges


def _verify(threshold: float, margin: float = MARGIN):
    """mapInArrow body: (list of (doc_id, sig)) to pairs (a, b, sure): linked, or to be decided exactly."""
    low, high = threshold - margin, threshold + margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            n = col.value_lengths().to_numpy()
            flat = col.flatten()
            ids = flat.field(0).to_numpy()
            sig = np.frombuffer(b"".join(flat.field(1).to_pylist()), np.uint64).reshape(-1, 8)
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            edges, unsure = [], []
            for size in range(2, 9):  # small buckets: every pair, all buckets of a size at once
                at = start[n == size]
                for i in range(size):
                    for j in range(i):
                        e = estimate(sig[at + i], sig[at + j])
                        for out, ok in ((edges, e >= high), (unsure, (e >= low) & (e < high))):
                            out.append((ids[at + i][ok], ids[at + j][ok]))
            for i in np.flatnonzero(n > 8):
                edges += _link(ids[start[i] : start[i] + n[i]], sig[start[i] : start[i] + n[i]], high, low, unsure)
            for pairs, sure in ((edges, True), (unsure, False)):
                if pairs:
                    a, c = np.concatenate([e[0] for e in pairs]), np.concatenate([e[1] for e in pairs])
                    least, most = np.minimum(a, c), np.maximum(a, c)
                    order = np.lexsort((most, least))
                    least, most = least[order], most[order]
                    fresh = least != most
                    fresh[1:] &= (least[1:] != least[:-1]) | (most[1:] != most[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(least[fresh]), pa.array(most[fresh]), pa.array(np.full(fresh.sum(), sure))], ["a", "b", "sure"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (doc_id, x, text) to (doc_id, x, sorted distinct shingle hashes)."""
    for b in batches:
        for lo, hi, raw, off in K.chunks(b.column(2)):
            s, at = shingles(raw, off)
            own = np.repeat(np.arange(hi - lo), np.diff(at))
            order = np.lexsort((s, own))
            s, own = s[order], own[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), K.lists(s[fresh].view(np.int32), np.bincount(own[fresh], minlength=hi - lo), pa.int32())], ["doc_id", "x", "s"])


def _similar(threshold: float):
    """mapInArrow body: (a, b, shingles of a, of b) to the pairs (a, b) whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own, x = [], []
            for c in (b.column(2), b.column(3)):
                own.append(np.repeat(np.arange(b.num_rows), c.value_lengths().to_numpy()))
                x.append(c.flatten().to_numpy().view(np.uint32))
            key = np.sort(np.concatenate(own).astype(np.uint64) << np.uint64(32) | np.concatenate(x))
            pair = (key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64)
            both = np.bincount(pair, minlength=b.num_rows)
            total = sum(np.bincount(o, minlength=b.num_rows) for o in own) - both
            ok = pa.array(both >= threshold * total)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("x"), F.lower("text").alias("text"))


def _decided(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Those of the ``pairs`` (a, b) of nodes whose texts' shingles have a Jaccard similarity of at least ``threshold``."""
    asked = scratch.table(nodes.join(maybe_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node"), "asked")
    sets = _keyed(within(docs, asked)).mapInArrow(_sets, "doc_id long, x long, s array<int>").dropDuplicates(["doc_id", "x"])
    sets = scratch.table(asked.join(sets, ["doc_id", "x"]).select("node", "s"), "sets")
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(_similar(threshold), "a long, b long")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, x, keep_id) of each document that is in a group of near duplicates and isn't its smallest.

    ``x`` is the hash of the document's text; ``keep_id`` is the id of the smallest, which may be another text of the same id.
    """
    scratch = Scratch(docs.sparkSession, "near")
    signs = _keyed(with_ids(docs)).mapInArrow(_sign, "doc_id long, x long, sig binary, twin binary, bands array<long>")
    signed = scratch.table(signs.withColumn("node", F.monotonically_increasing_id()), "signed")  # written, so that a row's node stays
    lead = scratch.table(signed.groupBy("twin").agg(F.min(F.struct("doc_id", "x", "node")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("twin", "lead"), "lead")
    twin = scratch.table(signed.select("twin", "doc_id", "x", "node").join(maybe_broadcast(lead), "twin").filter("node <> lead.node").select("doc_id", "x", "node", "lead"), "twins")
    firsts = without(signed.select(F.col("node").alias("doc_id"), "x", "bands"), twin.select(F.col("node").alias("doc_id"), "x"), F.col("x"))
    parts = min(GROUPS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-signed.count() * BANDS // BUCKET_ROWS)))
    packed = firsts.select("doc_id", "bands").mapInArrow(_scatter(parts), "part int, hash array<long>, ids array<long>")
    buckets = scratch.table(by_part(packed, parts).mapInArrow(_buckets(block), "members array<long>").distinct().withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    members = buckets.select("bucket", F.explode("members").alias("node"))
    gathered = members.join(signed.select("node", "sig"), "node").groupBy("bucket").agg(F.collect_list(F.struct("node", "sig")).alias("m"))
    pairs = scratch.table(gathered.select("m").mapInArrow(_verify(threshold), "a long, b long, sure boolean").distinct(), "pairs")
    sure, unsure = pairs.filter("sure").select("a", "b"), pairs.filter("NOT sure").select("a", "b")
    group = components(sure, scratch)
    if unsure.limit(1).count():
        for c in ("a", "b"):  # pairs that other links join need no decision
            unsure = unsure.join(group.select(F.col("v").alias(c), F.col("label").alias(f"g{c}")), c, "left").withColumn(f"g{c}", F.coalesce(f"g{c}", c))
        open_ = scratch.table(unsure.filter("ga <> gb"), "open")
        linked = _decided(docs, signed.select("node", "doc_id", "x"), open_.select("a", "b"), threshold, scratch).distinct().join(open_, ["a", "b"])
        # What was decided joins whole groups: their labels are the vertices of a second, small graph
        top = components(scratch.table(linked.select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct(), "linked"), scratch)
        joined = group.join(top.toDF("label", "over"), "label", "left").select("v", F.coalesce("over", "label").alias("label"))
        group = scratch.table(joined.unionByName(top.join(group.select("v"), "v", "left_anti")), "groups")
    # Nodes become documents again; the smallest of a group stays, and twins follow the first of them
    own = F.struct("doc_id", "x")
    grouped = scratch.table(signed.select("node", "doc_id", "x").join(maybe_broadcast(group.select(F.col("v").alias("node"), "label")), "node"), "grouped")
    best = grouped.groupBy("label").agg(F.min(own).alias("best")).select("label", "best.doc_id", "best.x").toDF("label", "keep_id", "keep_x")
    placed = scratch.table(grouped.join(best, "label").select("node", "doc_id", "x", "keep_id", "keep_x"), "placed")
    over = placed.select(F.col("node").alias("first"), "keep_id", "keep_x")
    follow = twin.select("doc_id", "x", F.col("lead.node").alias("first"), F.col("lead.doc_id").alias("lead_id"), F.col("lead.x").alias("lead_x"))
    follow = follow.join(over, "first", "left").select("doc_id", "x", F.coalesce("keep_id", "lead_id").alias("keep_id"), F.coalesce("keep_x", "lead_x").alias("keep_x"))
    found = placed.drop("node").unionByName(follow).filter("doc_id <> keep_id OR x <> keep_x")
    return scratch.table(found.select("doc_id", "x", "keep_id").distinct(), "found")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the smallest, by id and then by the hash of its text."""
    return without(docs, near_copies(docs, threshold))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that nearly repeats one of a smaller id, with the smallest id of its group."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id").filter("doc_id <> keep_id").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


#: The groups of all pairs with J >= 0.5, by brute force over whole shingle sets.  What the bands miss of them (4 pairs of 1,000
#: at J = 0.5 exactly) would differ here; an id of several texts is one vertex.
ORACLE = r"""
WITH RECURSIVE dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
 p AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM dw WHERE len(w) > 0),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM p),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared >= 0.5 * (x.n + y.n - shared)),
 u AS (SELECT a AS v, b AS w FROM e UNION SELECT b, a FROM e),
 r AS (SELECT v, v AS label FROM u UNION SELECT u.w, r.label FROM r JOIN u ON u.v = r.v WHERE r.label < u.w)
SELECT v AS doc_id, min(label) AS keep_id FROM r GROUP BY v HAVING min(label) <> v
"""
