"""Scoring of new documents against frozen clusters, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmedoids import nearest_medoid
from ..operators.representatives import UNSUCCESSFUL


def score_batch(points: DataFrame, medoids: DataFrame, labels: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(id, cluster_id, distance, label): nearest frozen medoid and its label; farther than ``max_distance``: unsuccessful."""
    near = nearest_medoid(points, medoids)
    named = near.join(F.broadcast(labels.select("cluster_id", "label")), "cluster_id", "left")
    label = F.coalesce("label", F.lit(UNSUCCESSFUL))
    if max_distance is not None:
        label = F.when(F.col("distance") > max_distance, UNSUCCESSFUL).otherwise(label)
    return named.select("id", "cluster_id", "distance", label.alias("label"))


def score_stream(points: DataFrame, medoids: DataFrame, labels: DataFrame, out: str, checkpoint: str, max_distance: float | None = None) -> StreamingQuery:
    """A query that writes scores of a stream of (id, v) to ``out``, a folder for each batch: repeated batches overwrite."""

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch, medoids, labels, max_distance).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
