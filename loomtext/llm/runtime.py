"""Session plumbing shared by the training-data operators: the shared scratch folder, size-checked
broadcasts, and filters by lists of documents that never move a text.

Intermediate tables are written as Parquet under the folder that the cluster names in
``spark.checkpoint.dir``.  They cut the lineage (a lost executor costs a re-read, not a re-computation)
and, unlike cached blocks, survive the executor that produced them.

A document is a (doc_id, text): several texts under one id are several documents, and equal rows are one.  Where operators list documents,
``x``, a 64-bit hash of the text, stands beside the id.  Ids are read as longs; a table whose ids aren't integers fails
with Spark's cast error.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A side is broadcast only when its rows take at most this many bytes; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20
#: Bytes of listed documents that a scan task looks up at once.
ROUTE_BYTES = 16 << 20
#: Most shuffle partitions of a step; more groups than that share partitions, in order.
PARTITIONS = 8192
#: Most groups that a step scatters its entries to; with more entries the groups grow.
GROUPS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Unset in a local session (tests): a temporary folder is set once."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Written intermediate tables of one operator call."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[str] = []
        Scratch.live.append(self)

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written to the shared folder (in folders ``by`` a column) and read back."""
        path = f"{self.root}/{name}-{len(self.kept)}"
        self.kept.append(path)
        schema = df.schema
        write = df.write.mode("overwrite")
        (write.partitionBy(by) if by else write).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Deletes all its tables, which nothing may read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in Scratch.live:
            Scratch.live.remove(self)


def _width(kind: T.DataType) -> int:
    return sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take: 8 for a number, the measured length of strings and lists."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(f.name), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType):
            total += F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0)) * _width(f.dataType.elementType) + 16
        else:
            total += _width(f.dataType)
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("n")).first()["n"]


def maybe_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` as a join side: broadcast if its rows were measured to be small, else hashed after a shuffle.

    The big side is then streamed past it, so that long texts are never sorted.
    """
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if limit is None else limit) else df.hint("shuffle_hash")


def by_part(df: DataFrame, parts: int) -> DataFrame:
    """Scattered rows, shuffled so that those of one ``part`` lie together, in at most ``PARTITIONS`` partitions."""
    return df.repartition(min(parts, PARTITIONS), "part").sortWithinPartitions("part")


def with_ids(docs: DataFrame) -> DataFrame:
    """Rows that can be decided on: those with a document id.  A null id identifies nothing."""
    return docs.filter(F.col("doc_id").isNotNull())


def text_key() -> F.Column:
    """``x`` of a document."""
    return F.xxhash64("text")


def read_group(root: str, group: int) -> pa.Table | None:
    """The rows of one group of a table written ``by="g"``, read from the shared folder by the executor's Python."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("/") else (fs.LocalFileSystem(), root)
    folder = f"{path}/g={group}"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    return pq.read_table(folder, filesystem=system, partitioning=None).combine_chunks()


@lru_cache(2)
def _listed(root: str, group: int) -> pa.Table | None:
    """A group's listed documents, by id."""
    t = read_group(root, group)
    return None if t is None else t.take(pa.array(np.lexsort((t["x"].to_numpy(), t["doc_id"].to_numpy()))))


def _places(t: pa.Table, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where in ``t`` each document (id, x) is listed, or -1."""
    have, have_x, place = t["doc_id"].to_numpy(), t["x"].to_numpy(), np.full(len(ids), -1)
    at, end = np.searchsorted(have, ids, "left"), np.searchsorted(have, ids, "right")
    while (open_ := at < end).any():  # one turn, but for ids of several texts
        hit = open_ & (have_x[np.minimum(at, len(have) - 1)] == x)
        place[hit] = at[hit]
        at += 1
    return place


def _look_up(root: str, payload: pa.DataType | None):
    """Body of a UDF: whether a document is listed or, with a ``payload``, what stands beside it."""

    def run(group: pa.Array, doc_id: pa.Array, x: pa.Array) -> pa.Array:
        group, ids, x, known = group.to_numpy(), doc_id.fill_null(0).to_numpy(), x.to_numpy(), np.asarray(doc_id.is_valid())
        found, parts, base = np.full(len(ids), -1), [], 0
        for g in np.unique(group):
            t = _listed(root, int(g))
            if t is not None and len(t):
                mine = np.flatnonzero(known & (group == g))
                place = _places(t, ids[mine], x[mine])
                found[mine] = np.where(place < 0, -1, place + base)
                if payload is not None:
                    used = np.unique(place[place >= 0])
                    found[mine] = np.where(place < 0, -1, np.searchsorted(used, place) + base)
                    parts.append(t.select([f.name for f in payload]).take(pa.array(used)).to_struct_array().combine_chunks().cast(payload))
                    base += len(used)
        if payload is None:
            return pa.array(found >= 0)
        return (pa.concat_arrays(parts) if parts else pa.nulls(0, payload)).take(pa.array(found, mask=found < 0))

    return run


def _routed(docs: DataFrame, listed: DataFrame, x: F.Column, size: int) -> F.Column | None:
    """What is ``listed`` for a row (true, or its other columns); None if ``docs`` isn't read from files.

    The list goes, by ids alone, to groups of the files that hold its documents; a scan task reads what is listed of its own.
    """
    own, rest = F.col("doc_id").cast("long"), [f for f in listed.schema if f.name not in ("doc_id", "x")]
    groups = max(1, -(-size // max(1, ROUTE_BYTES)))
    where = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(groups)).cast("int")
    try:
        placed = docs.select(own.alias("doc_id"), where.alias("g"))
    except AnalysisException:
        return None
    scratch = Scratch(docs.sparkSession, "routed")
    sent = placed.join(listed.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id", "x", "g"]).repartition(min(groups, PARTITIONS), "g")
    scratch.table(sent.select("doc_id", "x", *[f.name for f in rest], "g"), "listed", by="g")
    if not rest:
        return F.arrow_udf(_look_up(scratch.kept[-1], None), "boolean")(where, own, x)
    kind = T.StructType(rest)
    return F.arrow_udf(_look_up(scratch.kept[-1], to_arrow_type(kind)), kind).asNondeterministic()(where, own, x)


def _joined(docs: DataFrame, listed: DataFrame, x: F.Column, size: int, how: str) -> DataFrame:
    other = listed.withColumnsRenamed({"doc_id": "_listed_id", "x": "_listed_x"})
    other = F.broadcast(other) if size <= BROADCAST_BYTES else other.hint("shuffle_hash")
    return docs.join(other, (F.col("doc_id").cast("long") == F.col("_listed_id")) & (x == F.col("_listed_x")), how).drop("_listed_id", "_listed_x")


def _pick(docs: DataFrame, listed: DataFrame, x: F.Column | None, inside: bool) -> DataFrame:
    listed, x = listed.select(F.col("doc_id").cast("long").alias("doc_id"), "x").distinct(), text_key() if x is None else x
    size = bytes_of(listed)
    hit = _routed(docs, listed, x, size) if size > BROADCAST_BYTES else None
    if hit is None:
        return _joined(docs, listed, x, size, "left_semi" if inside else "left_anti")
    return docs.filter(hit if inside else ~hit)


def without(docs: DataFrame, listed: DataFrame, x: F.Column | None = None) -> DataFrame:
    """``docs`` without the documents (doc_id, x) listed.  Rows whose id is null stay.

    A small list is broadcast.  A large one is shuffled, without texts, to the files that hold its documents, and each scan
    task looks its own up; only a table that isn't read from files is shuffled itself.  The result is the same.
    """
    return _pick(docs, listed, x, False)


def within(docs: DataFrame, listed: DataFrame, x: F.Column | None = None) -> DataFrame:
    """The documents of ``docs`` that are listed; see ``without``."""
    return _pick(docs, listed, x, True)


def attach(docs: DataFrame, listed: DataFrame, x: F.Column | None = None) -> DataFrame:
    """The documents of ``docs`` that are listed, with the other columns of the list, which holds each once; see ``without``."""
    x, size = text_key() if x is None else x, bytes_of(listed)
    found = _routed(docs, listed, x, size) if size > BROADCAST_BYTES else None
    if found is None:
        return _joined(docs, listed, x, size, "inner")
    return docs.withColumn("_found", found).filter("_found IS NOT NULL").select(*docs.columns, "_found.*")
