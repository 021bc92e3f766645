"""Whole runs and single steps from the command line: ``python -m loomtext.cli MODE --data DIR --dataset NAME [...]``.

Results go to ``<runs>/<dataset>_<split>_<mode>_<time>``: the labelled documents, the labels, ``results.json``, the stages and the
answers of the provider.  ``--run DIR`` goes on in such a folder: stages that are there aren't computed again, and prompts that
were answered aren't asked again.  ``--step NAME`` ends a run after that stage (see ``plans.pipelines``).

Step by step: ``seed-labels``, then ``label-gen``, ``classify``, ``evaluate`` and ``visualize`` with the same ``--run``; ``remerge``
merges a run's labels down to ``--k``.  Settings (endpoint, model, batch sizes) are those of ``sources.config``; the key of an
endpoint is read from the environment variable LLM_API_KEY.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import embedding, labelling, labelsets, profile, providers
from .plans import cache, checks, pipelines, plots
from .sources import config, readers, sinks

RUNS = ("baseline", "paper", "kmedoids", "gmm", "nine-stage", "hybrid", "graph")
STEPS = ("seed-labels", "label-gen", "classify", "evaluate", "visualize", "remerge")
MODES = (*RUNS, *STEPS, "analyze", "labels", "probe", "preflight")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=MODES)
    p.add_argument("--data", default="data")
    p.add_argument("--runs", default="runs")
    p.add_argument("--run", help="folder of a run to go on with")
    p.add_argument("--step", help="the stage after which the run ends")
    p.add_argument("--dataset", default="")
    p.add_argument("--split", choices=readers.SPLITS, default="small")
    p.add_argument("--vectors", help="Parquet table (doc_id, v) in place of the embedder's vectors")
    p.add_argument("--method", help="baseline: kmeans or gmm; nine-stage: kmedoids, gmm or kmeans; visualize: pca or tsne")
    p.add_argument("--k", type=int, help="number of clusters or labels; estimated if not given")
    p.add_argument("--k0", type=int)
    p.add_argument("--k-method")
    p.add_argument("--threshold", type=float, help="gmm: least posterior of a row that gets its cluster's label")
    p.add_argument("--reduction", choices=("none", "pca", "tsne"))
    p.add_argument("--version", type=int, choices=(2, 3, 4), default=4)
    p.add_argument("--label-cache", help="folder of cached label lists; the closest to --k is used")
    p.add_argument("--seed", type=int)
    return p


def _object(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _labelled(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.parquet(f"{run}/labelled")


def _store(spark: SparkSession, run: str, docs: DataFrame, found: pipelines.Result, more: dict) -> dict:
    """Writes a result's table, texts, labels and scores; returns what ``results.json`` holds."""
    sinks.write_table(found.labelled.select("doc_id", "label"), f"{run}/labelled")
    sinks.write_classifications(_labelled(spark, run).join(docs.select("doc_id", "input"), "doc_id"), f"{run}/classifications")
    sinks.write_object(spark, f"{run}/labels.json", found.labels)
    results = {**more, "k": found.k, **found.info, **found.scores, "run_dir": run}
    if cache.exists(spark, f"{run}/answers"):
        results["usage"] = providers.kept_usage(spark, f"{run}/answers").first().asDict()
    sinks.write_object(spark, f"{run}/results.json", results)
    return results


def _draw(docs: DataFrame, labelled: DataFrame, vectors: DataFrame, run: str, title: str, method: str, seed: int) -> list[str]:
    tables = pipelines.plot_tables(docs, pipelines.Result(labelled, [], 0), vectors, method, seed)
    return plots.draw(tables, f"{run}/plots", title)


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    """The mode's results as one object."""
    s = config.load(spark)
    seed, key = s.seed if args.seed is None else args.seed, os.environ.get("LLM_API_KEY", "")
    if args.mode == "analyze":
        return {"datasets": profile.analyze_all(spark, args.data, args.runs, args.dataset or None)}
    if args.mode == "labels":
        return {"cache": cache.LabelCache(spark, args.label_cache or f"{args.runs}/labels").describe()}
    if args.mode == "probe":
        found = checks.probe(lambda: providers.make_provider(s, key))
        return found | {"verdict": checks.verdict(found)}
    seeds = f"{args.runs}/{args.dataset or 'all'}_seed_labels.json"
    if args.mode == "preflight":
        return checks.preflight(s, spark, args.data, [args.dataset] if args.dataset else [], lambda: providers.make_provider(s, key), key, seeds)

    docs = readers.load_split(spark, args.data, args.dataset, args.split).select("doc_id", "input", "label").persist()
    if args.mode == "seed-labels":
        chosen = sorted(r["label"] for r in labelsets.seed_labels(docs, seed=seed).collect())
        sinks.write_object(spark, seeds, chosen)
        return {"seed_labels": chosen, "path": seeds}
    out = args.run or sinks.run_dir(args.runs, args.dataset, args.split, args.mode)
    folder = out if "://" in out else os.path.abspath(out)
    factory = lambda: providers.make_provider(s, key, f"{folder}/answers")
    stages = cache.Stages(spark, f"{out}/stages", args.step)
    about = {"dataset": args.dataset, "split": args.split, "mode": args.mode}
    embedder = embedding.make_embedder(s.embedding_model)
    make = lambda: spark.read.parquet(args.vectors).select(F.col("doc_id").cast("long").alias("doc_id"), "v") if args.vectors else embedding.embed(docs, embedder, s.embedding_batch)
    vectors = lambda: stages.get("vectors", make, model=s.embedding_model, path=args.vectors, **about)
    given = _object(spark, seeds) if cache.exists(spark, seeds) else []
    labels = None
    if args.label_cache:
        known = cache.LabelCache(spark, args.label_cache)
        if k := known.best(args.dataset, args.split, args.k or s.k_max):
            labels = known.load(args.dataset, args.split, k)
    method, reduction = args.method, args.reduction or s.reduction
    try:
        if args.mode == "label-gen":
            made = stages.value("generated", lambda: labelling.generate_labels(docs, factory, s.label_chunk, given, seed), size=s.label_chunk, given=given, seed=seed)
            merged = stages.value("labels", lambda: pipelines.clean_labels(labelling.merge_labels(made, factory(), args.k)), found=made, k=args.k)
            sinks.write_object(spark, f"{out}/labels.json", merged)
            return {**about, "labels": merged, "run_dir": out}
        if args.mode == "remerge":
            merged = labelling.iterative_merge(_object(spark, f"{out}/labels.json"), args.k or s.k_max, factory())
            sinks.write_object(spark, f"{out}/labels.json", merged)
            return {**about, "labels": merged, "run_dir": out}
        if args.mode == "evaluate":
            scores = pipelines.evaluate(docs, _labelled(spark, out))
            old = _object(spark, f"{out}/results.json") if cache.exists(spark, f"{out}/results.json") else about
            sinks.write_object(spark, f"{out}/results.json", old | scores)
            try:  # scores stand without drawings
                drawn = _draw(docs, _labelled(spark, out), vectors(), out, args.dataset, "pca", seed)
            except Exception as e:  # noqa: BLE001
                drawn = [f"not drawn: {e}"[:300]]
            return old | scores | {"plots": drawn, "run_dir": out}
        if args.mode == "visualize":
            return {**about, "plots": _draw(docs, _labelled(spark, out), vectors(), out, args.dataset, method or "pca", seed), "run_dir": out}
        found = {
            "classify": lambda: pipelines.Result(stages.get("classified", lambda: labelling.classify(docs, _object(spark, f"{out}/labels.json"), factory, s.classify_batch), labels=_object(spark, f"{out}/labels.json"), batch=s.classify_batch), _object(spark, f"{out}/labels.json"), 0),
            "baseline": lambda: pipelines.baseline(docs, vectors(), method or "kmeans", args.k, s.k_max, s.pca_dims if reduction == "pca" else 0, seed, stages=stages),
            "paper": lambda: pipelines.paper(docs, factory, given, args.k, s.label_chunk, s.classify_batch, seed, stages),
            "kmedoids": lambda: pipelines.preclustered(docs, vectors(), factory, "kmedoids", args.k0 or s.kmedoids_k, args.k, seed, stages=stages),
            "gmm": lambda: pipelines.preclustered(docs, vectors(), factory, "gmm", args.k0 or s.gmm_k, args.k, seed, args.threshold, s.gmm_covariance_type, stages),
            "nine-stage": lambda: pipelines.nine_stage(docs, vectors(), factory, args.version, args.k0 or s.k0, args.k, s.k_min, s.k_max, args.k_method or s.k_method, method or s.cluster_method, reduction, s.pca_dims, description=readers.dataset_description(args.dataset), seed=seed, cached_labels=labels, embedder=embedder, stages=stages),
            "hybrid": lambda: pipelines.hybrid(docs, vectors(), factory, args.k, s.hybrid_k_max, s.hybrid_p, seed, stages=stages),
            "graph": lambda: pipelines.graph_communities(docs, vectors(), factory, s.graph_knn, s.graph_min_similarity, s.graph_resolution, args.k or 0, seed=seed, stages=stages),
        }[args.mode]()
    except cache.Stopped as at:
        return {**about, "step": args.step, "path": str(at), "run_dir": out}
    if args.mode == "classify":
        found.k = len(found.labels)
    if found.labels and args.label_cache and labels is None:
        cache.LabelCache(spark, args.label_cache).save(args.dataset, args.split, found.labels)
    return _store(spark, out, docs, found, about)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"loomtext {args.mode}").getOrCreate()
    sinks.setup_logging().info(json.dumps(run(args, spark), indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
