"""Label sets, ordered distinct values, batches and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

PLACEHOLDERS = ("unknown_topic", "new_label")


def ordered_unique(rows: DataFrame, value: str = "label", pos: str = "doc_id") -> DataFrame:
    """(pos, value): each value once, at its first appearance."""
    return rows.groupBy(value).agg(F.min(pos).alias("pos")).select("pos", value)


def drop_placeholders(labels: DataFrame) -> DataFrame:
    """Without labels that contain a placeholder's name (case-sensitive)."""
    keep: Column = F.lit(True)
    for p in PLACEHOLDERS:
        keep = keep & ~F.col("label").contains(p)
    return labels.filter(keep)


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, side) with side ``both``, ``left`` or ``right`` for two label columns."""
    x = a.select("label").distinct().withColumn("l", F.lit(1))
    y = b.select("label").distinct().withColumn("r", F.lit(1))
    return x.join(y, "label", "full").select("label", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``identical``: equal and not empty."""
    sides = compare_sets(a, b)
    return sides.agg(F.coalesce((F.sum(F.when(F.col("side") != "both", 1).otherwise(0)) == 0) & (F.count("*") > 0), F.lit(False)).alias("identical"))


def append_missing(found: DataFrame, cached: DataFrame) -> DataFrame:
    """(pos, label): ``found`` and then what only ``cached`` has, each in its own order."""
    last = found.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("base"))
    extra = cached.join(found, "label", "left_anti").crossJoin(F.broadcast(last)).select((F.col("pos") + F.col("base")).alias("pos"), "label")
    return ordered_unique(found.select("pos", "label").unionByName(extra), "label", "pos")


def label_ids(rows: DataFrame, value: str = "label") -> DataFrame:
    """(label, label_id): dense numbers from 0 in label order."""
    return rows.select(F.col(value).alias("label")).distinct().withColumn("label_id", F.dense_rank().over(Window.orderBy("label")) - 1)  # label-sized


def hash_order(*columns: str, seed: int = 42) -> list[Column]:
    """A repeatable shuffle: order by a seeded digest (which SQL has, too), then by the columns themselves."""
    return [F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))).cast("binary")), *[F.col(c) for c in columns]]


def chunks(rows: DataFrame, size: int, value: str = "input", pos: str = "doc_id", order: list[Column] | None = None) -> DataFrame:
    """(chunk_id, ids, items): successive rows by ``size``, in ``order`` (by ``pos`` if none).

    Ranks come from a range-partitioned sort and per-partition counts; the whole table is never in one task.  The sorted
    table is written once, so that a row keeps its number between the two uses.
    """
    order = order or [F.col(pos)]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    spread = written(spread.select("_m", pos, value), "chunks")
    counts = spread.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # a row a partition
    at = spread.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("_r", F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1))
    grouped = at.groupBy(F.floor(F.col("_r") / size).alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(pos).alias("id"), F.col(value).alias("item")))).alias("x"))
    return grouped.select("chunk_id", F.col("x.id").alias("ids"), F.col("x.item").alias("items"))


def sample_per_group(rows: DataFrame, group: str, m: int, id_: str = "id", seed: int | None = 42) -> DataFrame:
    """At most ``m`` rows of each group: in seeded hash order, or in id order with no seed."""
    order = hash_order(id_, seed=seed) if seed is not None else [F.col(id_)]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= m).drop("_r")


def seed_labels(labels: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """int(share * K) of K labels, without replacement, in seeded hash order."""
    k = labels.select("label").distinct()
    return k.orderBy(*hash_order("label", seed=seed)).limit(int(share * k.count()))
