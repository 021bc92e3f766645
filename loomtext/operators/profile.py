"""Profiles of labelled text collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import safe_div
from ..sources import readers

IMBALANCED = 10.0


def label_counts(documents: DataFrame) -> DataFrame:
    """(label, n, pct): most frequent first, then by name."""
    total = documents.agg(F.count("*").alias("t"))
    n = documents.groupBy(F.coalesce("label", F.lit(readers.MISSING_LABEL)).alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.bround(100.0 * F.col("n") / F.col("t"), 2).alias("pct")).orderBy(F.desc("n"), "label")


def text_length(documents: DataFrame) -> DataFrame:
    """One row of the lengths in code points: min, max, mean, median, stdev (sample), total."""
    n = F.length(F.coalesce("input", F.lit(readers.MISSING_TEXT)))
    return documents.select(n.alias("n")).agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.bround(F.avg("n"), 2).alias("mean_len"), F.bround(F.percentile("n", 0.5), 2).alias("median_len"), F.bround(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 2).alias("stdev_len"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chars"))


def entropy_bits(p: Column) -> Column:
    """Aggregate: Shannon entropy in bits of shares."""
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def diversity(counts: DataFrame) -> DataFrame:
    """One row ``entropy`` (bits) and ``gini`` of (label, n), to four places."""
    total = counts.agg(F.sum("n").alias("t"))
    p = safe_div(F.col("n").cast("double"), F.col("t"))
    return counts.crossJoin(F.broadcast(total)).agg(F.bround(F.coalesce(entropy_bits(p), F.lit(0.0)), 4).alias("entropy"), F.bround(F.coalesce(1 - F.sum(p * p), F.lit(0.0)), 4).alias("gini"))


def imbalance(counts: DataFrame) -> DataFrame:
    """One row: max_label_n, min_label_n, ratio, is_imbalanced, n_singletons, singletons (five), avg_per_label."""
    one = F.when(F.col("n") == 1, F.col("label"))
    five = counts.filter("n = 1").orderBy("label").limit(5).agg(F.array_sort(F.collect_list("label")).alias("singletons"))
    row = counts.agg(F.max("n").alias("max_label_n"), F.min("n").alias("min_label_n"), F.count(one).alias("n_singletons"), F.bround(F.avg("n"), 2).alias("avg_per_label")).crossJoin(F.broadcast(five))
    ratio = F.bround(safe_div(F.col("max_label_n").cast("double"), F.col("min_label_n")), 2)
    return row.select("max_label_n", "min_label_n", ratio.alias("ratio"), (ratio >= IMBALANCED).alias("is_imbalanced"), "n_singletons", "singletons", "avg_per_label")


def analyze_split(documents: DataFrame) -> dict:
    """The whole profile of a split as one object; an empty split has only its zeros."""
    counts = label_counts(documents).cache()
    try:
        rows = counts.collect()  # label-sized
        if not rows:
            return {"n_samples": 0, "n_labels": 0}
        lengths = text_length(documents).first().asDict()
        return {
            "n_samples": sum(r["n"] for r in rows),
            "n_labels": len(rows),
            "labels": sorted(r["label"] for r in rows),
            "label_counts": {r["label"]: r["n"] for r in rows},
            "label_pct": {r["label"]: r["pct"] for r in rows},
            "text_length": {k.removesuffix("_len"): v for k, v in lengths.items()},
            "imbalance": imbalance(counts).first().asDict() | diversity(counts).first().asDict(),
        }
    finally:
        counts.unpersist()


def summary(name: str, splits: dict[str, dict]) -> dict:
    """What two splits share, from their profiles."""
    small, large = (splits.get(s, {}) for s in ("small", "large"))
    n_small, n_large = small.get("n_samples", 0), large.get("n_samples", 0)
    a, b = set(small.get("labels", [])), set(large.get("labels", []))
    return {
        "dataset": name, "total_samples": n_small + n_large, "small_samples": n_small, "large_samples": n_large,
        "size_ratio_large_to_small": round(n_large / n_small, 2) if n_small else 0.0,
        "small_n_labels": len(a), "large_n_labels": len(b), "labels_shared": len(a & b),
        "labels_only_in_small": sorted(a - b), "labels_only_in_large": sorted(b - a), "label_sets_identical": bool(a) and a == b,
    }


def analyze_dataset(spark: SparkSession, root: str, name: str) -> dict:
    there = readers.available_splits(spark, root, name)
    splits = {s: analyze_split(readers.load_tolerant(spark, readers.split_path(root, name, s))) if s in there else {"error": "missing"} for s in readers.SPLITS}
    return {"dataset": name, "splits": splits, "summary": summary(name, splits)}


def analyze_all(spark: SparkSession, root: str, out: str, only: str | None = None) -> list[dict]:
    """Profiles of every dataset under ``root``, each also written as ``<out>/<name>_stats.json``."""
    from ..sources.sinks import write_object

    found = [analyze_dataset(spark, root, n) for n in readers.find_datasets(spark, root, only)]
    for r in found:
        write_object(spark, f"{out}/{r['dataset']}_stats.json", r)
    return found
