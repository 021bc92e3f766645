"""Named queries over the test tables, and for each that SQL can express, the SQL it must agree with.

Vectors come from ``embeddings``; the fixed assignment is its ``label`` column and the fixed medoid of a cluster its smallest
id, so that no comparison hangs on a fit.  Documents are labelled by their language.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, responses
from ..functions import vectors as V
from ..operators import embedding, gmm, graph, kmeans, kmedoids, knn, kselect, labelling, labelsets, metrics, profile
from ..operators import providers as P
from ..operators import representatives as R
from ..sources import readers, scratch, sinks
from . import cache, pipelines

DIM = 64
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("v"), F.col("label").alias("cluster_id"))


def documents(spark: SparkSession, sf: str, label: str = "lang") -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("input"), F.col(label).alias("label"))


def medoids(p: DataFrame) -> DataFrame:
    return p.groupBy("cluster_id").agg(F.min(F.struct("id", "v")).alias("m")).select("cluster_id", F.col("m.id").alias("id"), F.col("m.v").alias("m"))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return kmedoids.nearest_medoid(p, medoids(p)).join(p.select("id", F.col("cluster_id").alias("truth")), "id")


def six(c: str | F.Column) -> F.Column:
    return F.round(c, 6)


PTS = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS cluster_id FROM embeddings)"
MED = "m AS (SELECT cluster_id, min(id) AS id, arg_min(v, id) AS m FROM p GROUP BY cluster_id)"
NEAR = """a AS (SELECT p.id, p.cluster_id AS truth, m.cluster_id, 1 - list_cosine_similarity(p.v, m.m) AS d,
 row_number() OVER (PARTITION BY p.id ORDER BY 1 - list_cosine_similarity(p.v, m.m), m.cluster_id) AS r FROM p CROSS JOIN m),
 n AS (SELECT id, truth, cluster_id, d FROM a WHERE r = 1)"""
CON = "c AS (SELECT cluster_id AS pred, truth, count(*) AS n FROM n GROUP BY ALL)"
ARI = """(SELECT sum(n * (n - 1) / 2.0) FROM c) AS cc, (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM c GROUP BY pred)) AS aa,
 (SELECT sum(s * (s - 1) / 2.0) FROM (SELECT sum(n) AS s FROM c GROUP BY truth)) AS bb, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM c) AS tt"""
NMI = """(SELECT sum(c.n / t.t * ln(c.n * t.t / (x.s * y.s))) FROM c JOIN (SELECT pred, sum(n) AS s FROM c GROUP BY pred) x USING (pred)
 JOIN (SELECT truth, sum(n) AS s FROM c GROUP BY truth) y USING (truth) CROSS JOIN t) AS mi,
 (SELECT -sum(s / t * ln(s / t)) FROM (SELECT sum(n) AS s FROM c GROUP BY pred) CROSS JOIN t) AS hp,
 (SELECT -sum(s / t * ln(s / t)) FROM (SELECT sum(n) AS s FROM c GROUP BY truth) CROSS JOIN t) AS ht"""
TOT = "t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c)"
KNN = """s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS w FROM p a JOIN p b ON a.id <> b.id),
 k AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM s) WHERE r <= 15 AND w >= 0.3),
 adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM k UNION ALL SELECT dst, src, w FROM k) GROUP BY src, dst)"""


# --- the slice from vectors to scores


@query(f"WITH {PTS}, {MED}, {NEAR}, {CON}, {TOT}, z AS (SELECT {ARI}, {NMI}) SELECT round((cc - aa * bb / tt) / ((aa + bb) / 2 - aa * bb / tt), 6) AS ari, round(mi / ((hp + ht) / 2), 6) AS nmi FROM z")
def nearest_medoid_scores(spark, sf):
    c = metrics.contingency(_assigned(spark, sf), "truth", "cluster_id")
    return metrics.ari(c).crossJoin(metrics.nmi(c)).select(six("ari").alias("ari"), six("nmi").alias("nmi"))


@query(f"WITH {PTS}, {MED}, {NEAR} SELECT id, cluster_id, round(d, 6) AS distance FROM n")
def nearest_medoid_assign(spark, sf):
    return _assigned(spark, sf).select("id", "cluster_id", six("distance").alias("distance"))


@query(f"""WITH {PTS}, d AS (SELECT a.cluster_id, a.id, round(sum(1 - list_cosine_similarity(a.v, b.v)), 8) AS cost FROM p a JOIN p b USING (cluster_id) GROUP BY ALL)
SELECT cluster_id, id, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cost, id) AS r FROM d) WHERE r = 1""")
def medoid_update_step(spark, sf):
    return kmedoids.medoid_update(points(spark, sf)).select("cluster_id", "id", six("cost").alias("cost"))


@query(f"WITH {PTS}, {MED}, {NEAR} SELECT cluster_id, count(*) AS n FROM n GROUP BY 1")
def cluster_sizes(spark, sf):
    return kmedoids.cluster_sizes(_assigned(spark, sf))


@query(f"WITH {PTS} SELECT cluster_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM p GROUP BY 1")
def cluster_map(spark, sf):
    return kmedoids.cluster_map(points(spark, sf)).select("cluster_id", F.array_join("members", ",").alias("members"))


@query(f"WITH {PTS}, {MED}, {NEAR}, {CON} SELECT pred, truth, n FROM c")
def contingency(spark, sf):
    return metrics.contingency(_assigned(spark, sf), "truth", "cluster_id")


@query(f"WITH {PTS}, {MED}, {NEAR}, {CON}, z AS (SELECT {ARI}) SELECT round((cc - aa * bb / tt) / ((aa + bb) / 2 - aa * bb / tt), 6) AS ari FROM z")
def metric_ari(spark, sf):
    return metrics.ari(contingency(spark, sf)).select(six("ari").alias("ari"))


@query(f"WITH {PTS}, {MED}, {NEAR}, {CON}, {TOT}, z AS (SELECT {NMI}) SELECT round(mi / ((hp + ht) / 2), 6) AS nmi FROM z")
def metric_nmi(spark, sf):
    return metrics.nmi(contingency(spark, sf)).select(six("nmi").alias("nmi"))


@query(f"WITH {PTS}, {MED}, {NEAR}, {CON}, g AS (SELECT max(n) AS m, sum(n) AS n FROM c GROUP BY pred) SELECT round(sum(m) / sum(n), 6) AS purity FROM g")
def metric_purity(spark, sf):
    return metrics.purity(contingency(spark, sf)).select(six("purity").alias("purity"))


#: The best one-to-one matching of predictions (i) and classes (j) by dynamic programming over the sets of classes used; of
#: equal ones the one of the greatest sum of products of ranks.
_MATCH = f"""{PTS}, {MED}, {NEAR}, {CON}, ps AS (SELECT pred, row_number() OVER (ORDER BY pred) - 1 AS i FROM (SELECT DISTINCT pred FROM c)),
 ts AS (SELECT truth, row_number() OVER (ORDER BY truth) - 1 AS j FROM (SELECT DISTINCT truth FROM c)), w AS (SELECT i, j, n FROM c JOIN ps USING (pred) JOIN ts USING (truth)),
 js AS (SELECT j, CASE WHEN j < (SELECT count(*) FROM ts) THEN j + 1 ELSE 0 END AS r FROM (SELECT unnest(range(greatest((SELECT count(*) FROM ps), (SELECT count(*) FROM ts)))) AS j)),
 dp AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS took UNION ALL
  SELECT dp.i + 1, dp.mask | (CAST(1 AS BIGINT) << CAST(js.j AS INTEGER)), CAST(max(dp.total + 1000000 * coalesce(w.n, 0) + js.r * (dp.i + 1)) AS BIGINT), arg_max(list_append(dp.took, js.j), dp.total + 1000000 * coalesce(w.n, 0) + js.r * (dp.i + 1))
  FROM dp CROSS JOIN js LEFT JOIN w ON w.i = dp.i AND w.j = js.j
  WHERE dp.mask & (CAST(1 AS BIGINT) << CAST(js.j AS INTEGER)) = 0 AND dp.i < (SELECT count(*) FROM ps) GROUP BY 1, 2),
 best AS (SELECT max(total) AS total, arg_max(took, total) AS took FROM dp WHERE i = (SELECT count(*) FROM ps))"""


@query(f"WITH RECURSIVE {_MATCH} SELECT round((total // 1000000) / (SELECT CAST(sum(n) AS DOUBLE) FROM c), 6) AS acc FROM best")
def metric_acc(spark, sf):
    return spark.createDataFrame([(round(metrics.accuracy(contingency(spark, sf)), 6),)], "acc double")


@query(f"WITH RECURSIVE {_MATCH} SELECT truth, pred, CAST(j AS INTEGER) AS truth_pos, CAST(took[i + 1] AS INTEGER) AS pred_pos, n FROM c JOIN ps USING (pred) JOIN ts USING (truth) CROSS JOIN best")
def confusion_aligned(spark, sf):
    return metrics.aligned_confusion(contingency(spark, sf))


_SIL = """q AS (SELECT a.id, a.cluster_id, b.cluster_id AS c2, avg({d}) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
 s AS (SELECT id, min(CASE WHEN cluster_id = c2 THEN d END) AS x, min(CASE WHEN cluster_id <> c2 THEN d END) AS y FROM q GROUP BY id)
SELECT round(avg(coalesce((y - x) / greatest(x, y), 0)), 6) AS silhouette FROM s"""


@query(f"WITH {PTS}, " + _SIL.format(d="list_distance(a.v, b.v)"))
def silhouette_euclidean(spark, sf):
    return metrics.silhouette_euclidean(points(spark, sf)).select(six("silhouette").alias("silhouette"))


@query(f"WITH {PTS}, " + _SIL.format(d="1 - list_cosine_similarity(a.v, b.v)"))
def silhouette_cosine(spark, sf):
    return metrics.silhouette_cosine(points(spark, sf), DIM).select(six("silhouette").alias("silhouette"))


@query(f"""WITH {PTS}, e AS (SELECT id, cluster_id, unnest(v) AS x, unnest(range({DIM})) AS i FROM p),
 g AS (SELECT i, avg(x) AS g FROM e GROUP BY i), c AS (SELECT cluster_id, i, avg(x) AS c, count(*) AS n FROM e GROUP BY 1, 2),
 w AS (SELECT sum((x - c) * (x - c)) AS w FROM e JOIN c USING (cluster_id, i)), b AS (SELECT sum(n * (c - g) * (c - g)) AS b FROM c JOIN g USING (i)),
 k AS (SELECT count(DISTINCT cluster_id) AS k, count(*) AS n FROM p)
SELECT round(b * (n - k) / (w * (k - 1)), 6) AS ch FROM w CROSS JOIN b CROSS JOIN k""")
def calinski_harabasz(spark, sf):
    return metrics.calinski_harabasz(points(spark, sf), DIM).select(six("ch").alias("ch"))


# --- vectors and the graph


@query(f"WITH {PTS} SELECT id, round(sqrt(list_dot_product(v, v) / list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM p")
def l2_normalise_check(spark, sf):
    u = points(spark, sf).select("id", V.l2_normalise(F.col("v")).alias("u"))
    return u.select("id", six(V.norm(F.col("u"))).alias("norm"), six(F.col("u")[0]).alias("first"))


@query(f"WITH {PTS} SELECT id, CAST(unnest(range({DIM})) AS INTEGER) AS pos, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x FROM p")
def l2_components(spark, sf):
    """Every component of every unit vector."""
    return points(spark, sf).select("id", F.posexplode(V.l2_normalise(F.col("v"))).alias("pos", "x")).withColumn("x", six("x"))


@query(f"""WITH {PTS}, s AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS euclidean FROM p a JOIN p b ON a.id < b.id AND b.id < 200)
SELECT src, dst, cosine, euclidean FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS r FROM s) WHERE r <= 3""")
def cosine_pairs_topk(spark, sf):
    return _pairs_topk(points(spark, sf).filter("id < 200"))


def _pairs_topk(p: DataFrame) -> DataFrame:
    """By blocks of vectors; only rows without a vector, whose pairs have no similarity and come last, meet all others in a join."""
    from pyspark.sql import Window

    s = knn.tops(p, 3, -2.0, 6, later=True).select("src", "dst", F.col("weight").alias("cosine"), six("gap").alias("euclidean"))
    if not p.filter("v IS NULL AND id IS NOT NULL").limit(1).count():
        return s
    no, rest = F.lit(None).cast("double"), p.select(F.col("id").alias("o"), F.col("v").isNull().alias("also"))
    odd = F.broadcast(p.filter("v IS NULL").select("id")).join(rest, F.col("id") != F.col("o")).filter("NOT also OR id < o")
    s = s.unionByName(odd.select(F.least("id", "o").alias("src"), F.greatest("id", "o").alias("dst"), no.alias("cosine"), no.alias("euclidean")))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), "dst"))).filter("r <= 3").drop("r")


@query(ORACLES["cosine_pairs_topk"].replace(" AND b.id < 200", ""))
def cosine_pairs_topk_all(spark, sf):
    """``cosine_pairs_topk``, whose SQL stops at id 200, over the whole table."""
    return _pairs_topk(points(spark, sf))


def _edges(spark, sf):
    return scratch.written(knn.knn_graph(points(spark, sf), 15, 0.3), "edges")  # found once, whatever reads them


@query(f"WITH {PTS}, {KNN} SELECT src, dst, round(w, 6) AS weight FROM k")
def knn_graph(spark, sf):
    return _edges(spark, sf).select("src", "dst", six("weight").alias("weight"))


@query(f"WITH {PTS}, {KNN} SELECT src, dst, round(w, 6) AS weight FROM adj")
def adjacency(spark, sf):
    return knn.symmetrise(_edges(spark, sf)).select("src", "dst", six("weight").alias("weight"))


@query(f"WITH {PTS}, {KNN} SELECT src, round(sum(w), 6) AS degree FROM adj GROUP BY 1")
def graph_degree(spark, sf):
    return knn.degrees(knn.symmetrise(_edges(spark, sf))).select("src", six("degree").alias("degree"))


@query(f"""WITH {PTS}, {KNN}, e AS (SELECT count(*) AS n FROM k), c AS (SELECT count(*) AS n FROM (SELECT src FROM k UNION SELECT dst FROM k)), v AS (SELECT count(*) AS n FROM p)
SELECT v.n AS n_nodes, e.n AS n_edges, c.n AS n_connected, v.n - c.n AS n_isolated, round(2.0 * e.n / v.n, 6) AS avg_degree FROM v CROSS JOIN e CROSS JOIN c""")
def graph_stats(spark, sf):
    return knn.graph_stats(points(spark, sf), _edges(spark, sf)).withColumn("avg_degree", six("avg_degree"))


@query(f"""WITH {PTS}, {KNN}, j AS (SELECT adj.w, x.cluster_id AS a, y.cluster_id AS b FROM adj JOIN p x ON x.id = src JOIN p y ON y.id = dst), m AS (SELECT sum(w) AS m2 FROM j)
SELECT round((SELECT sum(w) FROM j WHERE a = b) / m2 - (SELECT sum(t * t) FROM (SELECT sum(w) AS t FROM j GROUP BY a)) / (m2 * m2), 6) AS modularity FROM m""")
def partition_modularity(spark, sf):
    part = points(spark, sf).select("id", F.col("cluster_id").alias("community"))
    return graph.modularity(knn.symmetrise(_edges(spark, sf)), part).select(six("modularity").alias("modularity"))


@query()
def louvain_communities(spark, sf):
    return graph.local_moving(points(spark, sf).select("id"), _edges(spark, sf))


def _gainful(spark, sf, local_edges: int) -> DataFrame:
    """(n_nodes, n_gainful): nodes that would gain by a move to a neighbour's community, in the partition that is found."""
    edges = _edges(spark, sf)
    found = graph.local_moving(points(spark, sf).select("id"), edges, local_edges=local_edges)
    a, at = knn.symmetrise(edges).filter("src <> dst"), found.select("id", F.col("community").alias("own"))
    k = a.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    total = at.join(k, "id").groupBy("own").agg(F.sum("k").alias("t"))
    to = a.join(at.select(F.col("id").alias("dst"), F.col("own").alias("target")), "dst").groupBy(F.col("src").alias("id"), "target").agg(F.sum("weight").alias("w"))
    own = to.withColumnsRenamed({"target": "own", "w": "w_own"})
    moves = to.join(at, "id").filter("target <> own").join(own, ["id", "own"], "left").fillna(0.0, ["w_own"]).join(k, "id").join(total.toDF("own", "t_own"), "own").join(total.toDF("target", "t_new"), "target")
    m2 = a.agg(F.sum("weight").alias("m2"))
    g = graph.gain(F.col("w"), F.col("w_own"), F.col("k"), F.col("t_new"), F.col("t_own"), F.col("m2"))
    gainful = moves.crossJoin(F.broadcast(m2)).filter(g > 1e-9).agg(F.countDistinct("id").alias("n_gainful"))
    return found.agg(F.count("*").alias("n_nodes")).crossJoin(gainful)


_NO_GAIN = "SELECT count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_gainful FROM embeddings"


@query(_NO_GAIN)
def louvain_no_gain(spark, sf):
    """What local moving ends at: no node gains by a move, by the gain formula over the found partition."""
    return _gainful(spark, sf, graph.LOCAL_EDGES)


@query(_NO_GAIN)
def louvain_no_gain_parallel(spark, sf):
    """The same of the moves by hashed halves, which large graphs take."""
    return _gainful(spark, sf, 0)


@query()
def community_search(spark, sf):
    found, gamma = graph.communities(points(spark, sf).select("id"), _edges(spark, sf), target_k=40)
    return graph.community_sizes(found).withColumn("resolution", F.lit(gamma))


# --- representatives and propagation


_CEN = f"""e AS (SELECT id, cluster_id, unnest(v) AS x, unnest(range({DIM})) AS i FROM p),
 c AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(x) AS x FROM e GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {PTS}, {_CEN}, d AS (SELECT cluster_id, id, round(list_distance(v, c), 12) AS distance FROM p JOIN c USING (cluster_id))
SELECT cluster_id, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, id) AS r FROM d) WHERE r = 1""")
def closest_to_centroid(spark, sf):
    p = points(spark, sf)
    return R.closest_to_centre(p, R.centroids(p, DIM)).select("cluster_id", "id", six("distance").alias("distance"))


@query(f"""WITH {PTS}, {_CEN}, d AS (SELECT cluster_id, id, round(sqrt(list_dot_product(v, v) + 1 - 2 * list_dot_product(v, c) / sqrt(list_dot_product(c, c))), 10) AS distance FROM p JOIN c USING (cluster_id))
SELECT CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS INTEGER) AS rep_order, cluster_id, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, id) AS r FROM d) WHERE r = 1""")
def closest_to_unit_centroid(spark, sf):
    p = points(spark, sf)
    return R.in_cluster_order(R.closest_to_centre(p, R.centroids(p, DIM, unit=True))).select("rep_order", "cluster_id", "id")


@query(f"WITH {PTS}, {MED} SELECT doc_id, text AS input, lang AS label FROM documents WHERE doc_id IN (SELECT id FROM m)")
def medoid_documents(spark, sf):
    return R.medoid_documents(documents(spark, sf), medoids(points(spark, sf)))


def _names(p: DataFrame) -> DataFrame:
    return p.select("cluster_id").distinct().filter("cluster_id % 3 <> 0").withColumn("label", F.concat(F.lit("topic"), F.col("cluster_id").cast("string")))


@query(f"WITH {PTS} SELECT id, cluster_id, CASE WHEN cluster_id % 3 <> 0 THEN 'topic' || cluster_id ELSE 'Unsuccessful' END AS label FROM p")
def propagate_hard(spark, sf):
    p = points(spark, sf)
    return R.propagate(p, _names(p))


def _posteriors(p: DataFrame) -> DataFrame:
    """Posteriors of equal spherical components of variance 0.1 at the medoids, in cluster order."""
    joint = p.select("id", "v").crossJoin(F.broadcast(medoids(p).select("cluster_id", "m"))).withColumn("l", -V.squared_euclidean(F.col("v"), F.col("m")) / 0.2)
    per = joint.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "l"))).alias("a"))
    e = F.transform("a", lambda x: F.exp(x["l"] - F.array_max(F.col("a.l"))))
    per = per.withColumn("e", e)
    probs = per.withColumn("probs", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)))
    return probs.select("id", F.get("a.cluster_id", F.array_position("probs", F.array_max("probs")).cast("int") - 1).alias("cluster_id"), "probs")


_SOFT = f"""{PTS}, {MED}, l AS (SELECT p.id, m.cluster_id, -list_distance(v, m) * list_distance(v, m) / 0.2 AS l FROM p CROSS JOIN m),
 e AS (SELECT id, cluster_id, exp(l - max(l) OVER (PARTITION BY id)) AS e FROM l), q AS (SELECT id, cluster_id, e / sum(e) OVER (PARTITION BY id) AS q FROM e),
 b AS (SELECT id, cluster_id, q FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q DESC, cluster_id) AS r FROM q) WHERE r = 1)"""


@query(f"WITH {_SOFT} SELECT id, cluster_id, round(q, 6) AS posterior FROM b")
def gmm_estep_fixed(spark, sf):
    return _posteriors(points(spark, sf)).select("id", "cluster_id", six(F.array_max("probs")).alias("posterior"))


@query(f"WITH {_SOFT} SELECT id, cluster_id, CASE WHEN q >= 0.4 AND cluster_id % 3 <> 0 THEN 'topic' || cluster_id ELSE 'Unsuccessful' END AS label FROM b")
def propagate_soft(spark, sf):
    p = points(spark, sf)
    return R.propagate_soft(_posteriors(p), _names(p), 0.4)


@query(f"""WITH {PTS}, {MED}, o AS (SELECT cluster_id, row_number() OVER (ORDER BY id) - 1 AS o FROM m)
SELECT p.id, p.cluster_id, CASE WHEN o % 2 = 0 THEN 'rep' || o ELSE 'Unsuccessful' END AS label FROM p JOIN o USING (cluster_id)""")
def propagate_ordered(spark, sf):
    p = points(spark, sf)
    reps = R.in_id_order(medoids(p).select("cluster_id", "id"))
    named = reps.filter("rep_order % 2 = 0").select("rep_order", F.concat(F.lit("rep"), F.col("rep_order").cast("string")).alias("label"))
    return R.propagate_ordered(p, reps, named)


_TEXT = """WITH b AS (SELECT doc_id AS bucket, text, lang FROM documents WHERE doc_id % 3 = 0),
 o AS (SELECT text, arg_{f}(lang, bucket) AS label FROM b GROUP BY text) SELECT doc_id, label FROM documents JOIN o USING (text)"""


def _stored(spark, sf):
    return documents(spark, sf).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("bucket"), "label", "input")


@query(_TEXT.format(f="min"))
def predictions_first_bucket(spark, sf):
    return R.predictions_by_text(documents(spark, sf), _stored(spark, sf))


@query(_TEXT.format(f="max"))
def predictions_last_bucket(spark, sf):
    return R.predictions_by_text(documents(spark, sf), _stored(spark, sf), last=True)


@query(f"WITH {PTS} SELECT CASE WHEN cluster_id % 3 <> 0 THEN 'topic' || cluster_id ELSE 'Topic_' || cluster_id END AS label, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM p GROUP BY 1")
def groups_by_label(spark, sf):
    p = points(spark, sf).withColumnRenamed("cluster_id", "community")
    named = _names(points(spark, sf)).toDF("community", "name")
    return R.groups_by_label(named, p).select("label", F.array_join("ids", ",").alias("ids"))


@query("SELECT lang AS label, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY doc_id) AS lengths FROM documents GROUP BY 1")
def classifications_sink(spark, sf):
    """The sink's grouping and order over the lengths of the texts, which are taken before rows are brought together."""
    lengths = documents(spark, sf).withColumn("input", F.length("input").cast("string"))
    return sinks.classifications(lengths).select("label", F.array_join("texts", ",").alias("lengths"))


# --- profiles, sets, batches


@query("SELECT source AS label, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 2) AS pct FROM documents GROUP BY 1")
def profile_label_counts(spark, sf):
    return profile.label_counts(documents(spark, sf, "source"))


@query("""SELECT CAST(min(length(text)) AS INTEGER) AS min_len, CAST(max(length(text)) AS INTEGER) AS max_len, round_even(avg(length(text)), 2) AS mean_len,
 round_even(quantile_cont(length(text), 0.5), 2) AS median_len, round_even(stddev_samp(length(text)), 2) AS stdev_len, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM documents""")
def profile_text_length(spark, sf):
    return profile.text_length(documents(spark, sf))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n / (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS p FROM c) SELECT round_even(-sum(p * log2(p)), 4) AS entropy, round_even(1 - sum(p * p), 4) AS gini FROM p")
def profile_entropy_gini(spark, sf):
    return profile.diversity(profile.label_counts(documents(spark, sf)))


@query("""WITH c AS (SELECT event_type || '/' || user_id AS label, count(*) AS n FROM events GROUP BY 1), s AS (SELECT label FROM c WHERE n = 1 ORDER BY label LIMIT 5)
SELECT max(n) AS max_label_n, min(n) AS min_label_n, round_even(max(n) / min(n), 2) AS ratio, max(n) / min(n) >= 10 AS is_imbalanced, count(*) FILTER (n = 1) AS n_singletons,
 coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM s), '') AS singletons, round_even(avg(n), 2) AS avg_per_label FROM c""")
def profile_imbalance(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("input"), F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("label"))
    return profile.imbalance(profile.label_counts(rows)).withColumn("singletons", F.array_join("singletons", ","))


@query("SELECT min(doc_id) AS pos, lang AS label FROM documents GROUP BY lang")
def ordered_unique_labels(spark, sf):
    return labelsets.ordered_unique(documents(spark, sf))


@query("""WITH a AS (SELECT DISTINCT source AS label FROM documents WHERE doc_id < 12), b AS (SELECT DISTINCT source AS label FROM documents WHERE doc_id BETWEEN 8 AND 18)
SELECT coalesce(a.label, b.label) AS label, CASE WHEN a.label IS NULL THEN 'right' WHEN b.label IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.label = b.label""")
def label_set_diff(spark, sf):
    d = documents(spark, sf, "source")
    return labelsets.compare_sets(d.filter("doc_id < 12"), d.filter("doc_id BETWEEN 8 AND 18"))


@query("SELECT (SELECT count(DISTINCT lang) FROM documents WHERE doc_id % 2 = 0) = (SELECT count(DISTINCT lang) FROM documents) AND (SELECT count(DISTINCT lang) FROM documents WHERE doc_id % 2 = 1) = (SELECT count(DISTINCT lang) FROM documents) AS identical")
def label_sets_identical(spark, sf):
    d = documents(spark, sf)
    return labelsets.identical(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"))


@query("""WITH a AS (SELECT source AS label, min(doc_id) AS pos FROM documents WHERE doc_id < 12 GROUP BY 1), b AS (SELECT source AS label, min(doc_id) AS pos FROM documents WHERE doc_id BETWEEN 8 AND 18 GROUP BY 1)
SELECT pos, label FROM a UNION ALL SELECT pos + (SELECT max(pos) + 1 FROM a), label FROM b WHERE label NOT IN (SELECT label FROM a)""")
def append_cached_labels(spark, sf):
    d = documents(spark, sf, "source")
    return labelsets.append_missing(labelsets.ordered_unique(d.filter("doc_id < 12")), labelsets.ordered_unique(d.filter("doc_id BETWEEN 8 AND 18")))


@query("SELECT source AS label, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT source FROM documents)")
def label_ids(spark, sf):
    return labelsets.label_ids(documents(spark, sf, "source"))


@query("SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN 'new_label' ELSE source END AS label FROM documents WHERE doc_id % 7 <> 0")
def drop_placeholder_labels(spark, sf):
    d = documents(spark, sf, "source").withColumn("label", F.when(F.col("doc_id") % 7 == 0, "new_label").otherwise(F.col("label")))
    return labelsets.drop_placeholders(d).select("label").distinct()


@query("""WITH r AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 30 AS BIGINT) AS chunk_id FROM documents)
SELECT chunk_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n FROM r GROUP BY 1""")
def chunk_batches(spark, sf):
    return labelsets.chunks(documents(spark, sf), 30).select("chunk_id", F.array_join("ids", ",").alias("ids"), F.size("items").cast("long").alias("n"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 8")
def sample_per_group(spark, sf):
    return labelsets.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", 8, "doc_id", None)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '/42'), doc_id) AS r FROM documents) WHERE r <= 8")
def sample_members_hashed(spark, sf):
    return labelsets.sample_per_group(table(spark, sf, "documents").select("doc_id", "source"), "source", 8, "doc_id")


@query("WITH k AS (SELECT DISTINCT source AS label FROM documents) SELECT label FROM (SELECT label, row_number() OVER (ORDER BY md5(label || '/42'), label) AS r FROM k) WHERE r <= (SELECT CAST(floor(0.2::DOUBLE * count(*)) AS BIGINT) FROM k)")
def seed_label_sample(spark, sf):
    return labelsets.seed_labels(documents(spark, sf, "source"))


@query("SELECT event_id, json_valid(props) AS ok FROM events WHERE json_valid(props)")
def malformed_json_filter(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull().alias("ok"))
    return e.filter("ok")


#: The line that ``tolerant_reader`` has for each document: every fifth is broken, every seventh blank, every third lacks a field.
_LINES = """l AS (SELECT row_number() OVER (ORDER BY doc_id) AS line_no, doc_id, lang FROM documents WHERE doc_id IS NOT NULL)
SELECT line_no, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'text ' || doc_id END AS input, CASE WHEN doc_id % 3 = 2 THEN '<MISSING>' ELSE lang END AS label FROM l WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0"""


@query(f"WITH {_LINES}")
def tolerant_reader(spark, sf):
    """The tolerant reader over a JSONL file with broken and blank lines and lines without a field."""
    d, i = table(spark, sf, "documents").filter("doc_id IS NOT NULL"), F.col("doc_id")
    whole = F.to_json(F.struct(F.when(i % 3 != 1, F.concat(F.lit("text "), i.cast("string"))).alias("input"), F.when(i % 3 != 2, F.col("lang")).alias("label")))
    line = F.when(i % 5 == 0, F.concat(F.lit('{"input": '), i.cast("string"))).when(i % 7 == 0, F.lit("  ")).otherwise(whole)
    path = f"{scratch.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    d.select("doc_id", line.alias("value")).coalesce(1).sortWithinPartitions("doc_id").select("value").write.text(path)
    return readers.load_tolerant(spark, path).select("line_no", "input", "label")


_NAMES = [*readers.DOMAINS, "of_no_list"]


@query(f"SELECT doc_id, CASE doc_id % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN '{readers.DOMAINS.get(n, readers.GENERIC_DOMAIN)}'" for i, n in enumerate(_NAMES)) + " END AS description FROM documents")
def described_collections(spark, sf):
    """Every known collection's description, and the generic one, by the collection's name."""
    named = table(spark, sf, "documents").select("doc_id", F.array(*[F.lit(n) for n in _NAMES])[(F.col("doc_id") % len(_NAMES)).cast("int")].alias("dataset"))
    return readers.with_description(named).select("doc_id", "description")


@query("SELECT doc_id, 'short texts of one collection' AS description FROM documents")
def described_documents(spark, sf):
    return readers.with_description(table(spark, sf, "documents"), "source").select("doc_id", "description")


# --- choosing k


_CURVE = "c AS (SELECT p_size AS k, round(avg(p_retailprice), 6) AS value FROM part GROUP BY 1)"


def _curve(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_size").alias("k")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))


@query(f"""WITH {_CURVE}, s AS (SELECT k, (k - min(k) OVER ()) / CAST(max(k) OVER () - min(k) OVER () AS DOUBLE) AS x, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS y FROM c),
 e AS (SELECT arg_min(x, k) AS xa, arg_min(y, k) AS ya, arg_max(x, k) AS xb, arg_max(y, k) AS yb FROM s)
SELECT k FROM s CROSS JOIN e ORDER BY round(abs((yb - ya) * (x - xa) - (xb - xa) * (y - ya)) / sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)), 12) DESC, k LIMIT 1""")
def elbow_select(spark, sf):
    return kselect.elbow(_curve(spark, sf))


@query(f"WITH {_CURVE} SELECT k, value FROM c ORDER BY value, k LIMIT 1")
def argbest_k(spark, sf):
    return kselect.best_k(_curve(spark, sf))


@query(f"WITH {_CURVE} SELECT k, value FROM c ORDER BY abs(k - 23), k LIMIT 1")
def nearest_cached_k(spark, sf):
    return cache.nearest(_curve(spark, sf), 23)


# --- answers of providers


@query("SELECT doc_id, lang || ',' || source AS labels FROM documents")
def parse_label_response(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.format_string('```json\n{"labels": ["%s", " %s "]}\n```', "lang", "source")).otherwise(F.format_string("['%s', '%s']", "lang", "source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(responses.parse_labels_col(raw), ",").alias("labels"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS label FROM documents")
def batch_answer_match(spark, sf):
    answer = F.when(F.col("doc_id") % 5 == 0, F.lit("??")).when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.concat(F.lit("<"), F.col("lang"), F.lit(">")))
    return table(spark, sf, "documents").select("doc_id", responses.match_label_col(answer, F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])).alias("label"))


_AMONG = ("the", "les", "der", "los")


@query(r"""WITH t AS (SELECT doc_id, coalesce(lower(text), '') AS low FROM documents), f AS (SELECT doc_id, low, regexp_extract_all(low, '\pL{3,}') AS w FROM t),
 s AS (SELECT doc_id, l.label, l.pos, CAST(l.label <> 'the' AND list_contains(w, l.label) AS INTEGER) + CAST(contains(low, l.label) AS INTEGER) / CAST(1 + greatest(length(low) - 2, 1) AS DOUBLE) AS score
  FROM f CROSS JOIN (VALUES ('the', 0), ('les', 1), ('der', 2), ('los', 3)) l(label, pos))
SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM s) WHERE r = 1""")
def classify_batched(spark, sf):
    return labelling.classify(documents(spark, sf), list(_AMONG), size=10)


@query()
def discover_and_consolidate(spark, sf):
    found = labelling.discover_labels(documents(spark, sf), sequential=False)
    return spark.createDataFrame(list(enumerate(labelling.consolidate(found, 10, P.OfflineProvider()))), "pos int, label string")


def _usage_sql() -> str:
    """Calls and characters of one prompt a document, whose answer names the most frequent (longest, last) of its telling words."""
    frame = len(prompts.one_word_labels([""]))
    stop = ", ".join(f"'{w}'" for w in sorted(P.STOP_WORDS))
    escaped = " + ".join(f"(length(t) - length(replace(t, chr({c}), '')))" for c in (8, 9, 10, 12, 13, 34, 92))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '\\pL{{3,}}')) AS w FROM d),
 c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w NOT IN ({stop}) GROUP BY 1, 2), b AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(w) DESC, w DESC) AS r FROM c) WHERE r = 1)
SELECT count(*) AS calls, CAST(0 AS BIGINT) AS failures, CAST(sum({frame} + length(t) + {escaped}) AS BIGINT) AS n_in, CAST(sum(length('{{"1": ""}}') + length(coalesce(w, 'other'))) AS BIGINT) AS n_out,
 CAST(0 AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_out FROM d LEFT JOIN b USING (doc_id)"""


@query(_usage_sql())
def provider_usage(spark, sf):
    """One prompt a document, with the whole text however long it is."""
    make = F.pandas_udf(lambda t: t.map(lambda x: prompts.one_word_labels([x or ""])), "string")
    return P.usage(P.ask(documents(spark, sf).select(F.xxhash64("doc_id").alias("request_id"), make("input").alias("prompt"))))


# --- fits


@query()
def kmeans_baseline(spark, sf):
    return kmeans.fit(points(spark, sf), 10, n_init=2, max_iter=50).assignments


@query()
def kmedoids_fit(spark, sf):
    return kmedoids.fit(points(spark, sf), 10).assignments


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_not_nearest, CAST(0 AS BIGINT) AS n_better_medoids FROM embeddings")
def kmedoids_fixed_point(spark, sf):
    """What the fit ends at: each row is with its nearest medoid, and no member of a cluster costs less than its medoid.

    A member's distances to all n of its cluster add up to n - u . sum(u) of the unit vectors, so that no pairs are formed.
    """
    p = points(spark, sf).select("id", "v")
    f = kmedoids.fit(p, 10)
    m = spark.createDataFrame(list(enumerate(f.medoids)), "cluster_id int, id long")
    assigned = p.join(f.assignments.select("id", F.col("cluster_id").alias("own")), "id")
    d = assigned.crossJoin(F.broadcast(m.join(p, "id").select("cluster_id", F.col("v").alias("m")))).select("id", "own", "cluster_id", V.cosine_distance(F.col("v"), F.col("m")).alias("d"))
    near = d.groupBy("id").agg(F.min("d").alias("least"), F.min(F.when(F.col("own") == F.col("cluster_id"), F.col("d"))).alias("mine"))
    unit = assigned.select(F.col("own").alias("cluster_id"), "id", V.l2_normalise(F.col("v")).alias("u"))
    sums = unit.groupBy("cluster_id").agg(F.count("*").alias("n"), V.mean_vector(F.col("u"), DIM).alias("mean"))
    costs = unit.join(F.broadcast(sums), "cluster_id").select("cluster_id", "id", (F.col("n") * (1 - V.dot(F.col("u"), F.col("mean")))).alias("cost"))
    at = costs.join(F.broadcast(m.select("cluster_id", F.col("id").alias("medoid"))), "cluster_id").groupBy("cluster_id").agg(F.min("cost").alias("least"), F.min(F.when(F.col("id") == F.col("medoid"), F.col("cost"))).alias("mine"))
    worse = (F.col("mine").isNull() | (F.col("mine") > F.col("least") + 1e-6)).cast("long")
    return near.agg(F.count("*").alias("n_rows"), F.sum(worse).alias("n_not_nearest")).crossJoin(at.agg(F.sum(worse).alias("n_better_medoids")))


@query()
def gmm_fit(spark, sf):
    p = points(spark, sf)
    return gmm.predict(p, gmm.fit(p, 5, n_init=1, max_iter=10)).select("id", "cluster_id", six(F.array_max("probs")).alias("posterior"))


@query()
def bic_curve(spark, sf):
    return spark.createDataFrame(gmm.bic_curve(points(spark, sf), 2, 3, "diag", max_iter=5), "k int, bic double")


@query()
def pca_scores(spark, sf):
    return embedding.pca(points(spark, sf), 5)[0].select("id", *[six(F.col("v")[i]).alias(f"s{i}") for i in range(5)])


@query(f"""WITH {PTS}, e AS (SELECT unnest(v) AS x, unnest(range({DIM})) AS i FROM p) SELECT CAST(count(DISTINCT i) AS INTEGER) AS components, round(sum(v), 4) AS total FROM (SELECT i, var_samp(x) AS v FROM e GROUP BY i)""")
def pca_total_variance(spark, sf):
    """All components together have the variance of the vectors."""
    scores = embedding.pca(points(spark, sf), DIM)[0]
    return scores.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v")).agg(F.count("*").cast("int").alias("components"), F.round(F.sum("v"), 4).alias("total"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\pL\pN]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def tfidf_vectors(spark, sf):
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
    return embedding.tfidf(documents(spark, sf), 256).select("doc_id", six(norm).alias("norm"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\pL\pN_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def embed_texts(spark, sf):
    return embedding.embed(documents(spark, sf)).select("doc_id", six(V.norm(F.col("v"))).alias("norm"))


@query()
def tsne_projection(spark, sf):
    return embedding.tsne(points(spark, sf), n_iter=100).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


# --- whole runs (offline labels)


def _texts_and_vectors(spark, sf):
    d = documents(spark, sf)
    return d, embedding.embed(d).persist()


def _summary(spark, r: pipelines.Result) -> DataFrame:
    return spark.createDataFrame([(r.k, len(r.labels), r.scores["n_samples"], r.scores["ACC"], r.scores["NMI"], r.scores["ARI"])], "k int, n_labels int, n_samples long, acc double, nmi double, ari double")


@query()
def pipeline_baseline(spark, sf):
    return _summary(spark, pipelines.baseline(*_texts_and_vectors(spark, sf), k=4, n_init=2))


@query()
def pipeline_paper(spark, sf):
    return _summary(spark, pipelines.paper(_texts_and_vectors(spark, sf)[0], target_k=8, batch=10, sequential=False))


@query()
def pipeline_kmedoids(spark, sf):
    return _summary(spark, pipelines.preclustered(*_texts_and_vectors(spark, sf), k=20, target_k=8))


@query()
def pipeline_graph(spark, sf):
    return _summary(spark, pipelines.graph_communities(*_texts_and_vectors(spark, sf)))


@query()
def pipeline_hybrid(spark, sf):
    return _summary(spark, pipelines.hybrid(*_texts_and_vectors(spark, sf), target_k=6, p=0.05))


@query()
def pipeline_nine_stage(spark, sf):
    return _summary(spark, pipelines.nine_stage(*_texts_and_vectors(spark, sf), k0=30, k_star=6, sequential=False))
