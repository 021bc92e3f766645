"""Readers of text collections and run artefacts.

A collection is a folder with one folder per dataset, each holding ``small.jsonl`` and/or ``large.jsonl`` with the
fields ``input`` and ``label``.  Identity is an explicit ``doc_id``, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("input", T.StringType()), T.StructField("label", T.StringType())])
MISSING_LABEL, MISSING_TEXT = "<MISSING>", ""
SPLITS = ("small", "large")

#: What the texts of well-known collections are about; shown to the labelling provider.
DOMAINS = {
    "massive_scenario": "requests to a voice assistant, by scenario",
    "massive_intent": "requests to a voice assistant, by intent",
    "mtop_domain": "commands to a task assistant, by domain",
    "mtop_intent": "commands to a task assistant, by intent",
    "arxiv_fine": "abstracts and titles of research papers, by subject class",
    "go_emotion": "short comments, by the emotion they express",
    "banking77": "questions of bank customers, by intent",
    "clinc": "utterances to a dialogue system, by intent",
    "clinc_domain": "utterances to a dialogue system, by domain",
    "stackexchange": "question titles, by the site they were asked on",
    "reddit": "post titles, by the community they were posted in",
    "few_event": "sentences that report an event, by event type",
    "few_rel_nat": "sentences that state a relation, by relation type",
    "few_nerd_nat": "sentences with a marked entity, by entity type",
}
GENERIC_DOMAIN = "short texts of one collection"


def split_path(root: str, dataset: str, split: str) -> str:
    return f"{root}/{dataset}/{split}.jsonl"


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds ``doc_id``, the line's place in its file, without sorting all lines in one task.

    A line's byte order within a file partition is that of monotonically_increasing_id; the number of lines before a
    partition comes from a window over one row per partition.
    """
    ids = lines.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = ids.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return ids.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("doc_id", F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_b", "_n")


def load_strict(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, input, label); a malformed line or a missing field fails the job."""
    rows = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a document lacks {c}")).cast("string")).alias(c)
    return _numbered(rows.select(need("input"), need("label"))).select("doc_id", "input", "label")


def load_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, input, label, line_no) of the well-formed lines; blank and malformed ones are left out."""
    lines = _numbered(spark.read.text(path)).withColumnRenamed("doc_id", "line_no")
    parsed = lines.filter(F.trim("value") != "").withColumn("d", F.from_json("value", T.StructType([*DOCUMENT, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.filter("d._corrupt IS NULL")
    return good.select(F.col("line_no").alias("doc_id"), F.coalesce("d.input", F.lit(MISSING_TEXT)).alias("input"), F.coalesce("d.label", F.lit(MISSING_LABEL)).alias("label"), (F.col("line_no") + 1).alias("line_no"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the lines that the tolerant reader leaves out, blank ones excepted; for the log."""
    lines = _numbered(spark.read.text(path)).filter(F.trim("value") != "")
    bad = F.from_json("value", T.StructType([*DOCUMENT, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()
    return lines.filter(bad).select((F.col("doc_id") + 1).alias("line_no"), "value")


def load_split(spark: SparkSession, root: str, dataset: str, split: str = "small") -> DataFrame:
    """One split of a dataset, strictly read, with its names as columns."""
    return load_strict(spark, split_path(root, dataset, split)).withColumns({"dataset": F.lit(dataset), "split": F.lit(split)})


def _listing(spark: SparkSession, root: str) -> list[tuple[str, list[str]]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    folders = sorted((s.getPath() for s in fs.listStatus(path) if s.isDirectory()), key=lambda p: p.getName())
    return [(p.getName(), sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isFile())) for p in folders]


def find_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root``, sorted."""
    return [name for name, _ in _listing(spark, root)]


def find_datasets(spark: SparkSession, root: str, only: str | None = None) -> list[str]:
    """Names of the folders that hold a ``*.jsonl`` file, sorted; ``only`` picks one by name."""
    return [name for name, files in _listing(spark, root) if any(f.endswith(".jsonl") for f in files) and only in (None, name)]


def available_splits(spark: SparkSession, root: str, dataset: str) -> list[str]:
    return [s for s in SPLITS for name, files in _listing(spark, root) if name == dataset and f"{s}.jsonl" in files]


def dataset_description(name: str) -> str:
    """What a collection is about; a generic phrase for unknown ones."""
    return DOMAINS.get(name, GENERIC_DOMAIN)


def with_description(df: DataFrame, column: str = "dataset") -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return df.withColumn("description", F.coalesce(table[F.col(column)], F.lit(GENERIC_DOMAIN)))


def load_subset(documents: DataFrame, representatives: DataFrame) -> DataFrame:
    """The documents that are representatives, in id order."""
    return documents.join(representatives.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label): a JSON array of labels, without repetition, each at its first place."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "label"))
    return raw.groupBy("label").agg(F.min("pos").alias("pos")).select("pos", "label")


def load_predictions(spark: SparkSession, run_dir: str) -> DataFrame:
    """(bucket, label, input) rows of a run's label -> texts map; the full result is preferred to the partial one.

    A map is one JSON object, as the runs of other tools leave it, and is parsed as one.  The results of this library (a folder
    ``classifications`` of {label, texts} lines) are read in parallel; their buckets are numbered by label.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("classifications_full.json", "classifications.json"):
        p = jpath(f"{run_dir}/{name}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            whole = spark.read.text(f"{run_dir}/{name}", wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
            entries = whole.select(F.posexplode(F.map_entries("m")).alias("bucket", "e"))
            return entries.select("bucket", F.col("e.key").alias("label"), F.explode("e.value").alias("input"))
    p = jpath(f"{run_dir}/classifications")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        lines = spark.read.schema("label string, texts array<string>").json(f"{run_dir}/classifications")
        number = lines.select("label").distinct().withColumn("bucket", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))  # label-sized
        return lines.join(number, "label").select("bucket", "label", F.explode("texts").alias("input"))
    raise FileNotFoundError(f"no classifications in {run_dir}")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_run(documents: DataFrame, predictions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, input, label, predicted, embedding): documents, predictions and vectors joined by id."""
    return documents.join(predictions.select("doc_id", F.col("label").alias("predicted")), "doc_id").join(vectors, "doc_id")


def infer_dataset_name(run_dir: str, metadata: dict | None = None) -> str:
    """The dataset of a run: from its metadata, else from ``<dataset>_<split>...`` in the folder's name."""
    if metadata and metadata.get("dataset"):
        return metadata["dataset"]
    name = run_dir.rstrip("/").rsplit("/", 1)[-1]
    for split in SPLITS:
        if f"_{split}" in name:
            return name.split(f"_{split}")[0]
    return name
