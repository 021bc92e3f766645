"""What larger or odd tables showed: results that must not depend on the size of a table or a text."""

import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest import rows

from loomtext.operators import embedding, gmm, graph, kmedoids, knn, labelling, metrics, providers
from loomtext.plans import catalog


def against_sql(spark, name, folder, **tables):
    """(rows of the query, rows of its SQL) over pandas tables written to ``folder``."""
    con = duckdb.connect()
    for t, frame in tables.items():
        frame.to_parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return rows(catalog.QUERIES[name](spark, str(folder)).toPandas()), rows(con.sql(catalog.ORACLES[name]).df())


def texts(*given):
    return pd.DataFrame({"doc_id": range(len(given)), "text": given, "lang": "en", "source": "s"})


def test_usage_counts_one_prompt_a_document(spark, tmp_path):
    got, want = against_sql(spark, "provider_usage", tmp_path, documents=texts("alpha beta " * 12_000, "gamma", None))
    assert got == want


def vectors(n, seed=0, d=64, same=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (10, d))[rng.integers(0, 10, n)] + rng.normal(0, 0.8, (n, d))).astype(np.float32)
    x[n - same :] = x[0]  # equal vectors, whose similarities tie
    return pd.DataFrame({"vec_id": rng.permutation(n), "embedding": list(x), "label": rng.integers(0, 4, n).astype(np.int32)})


@pytest.mark.parametrize("name", ["cosine_pairs_topk_all", "knn_graph"])
def test_neighbours_by_blocks_agree_with_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(knn, "TILE", (70, 90))
    made = knn.tops
    monkeypatch.setattr(knn, "tops", lambda *a, **kw: made(*a, **kw | {"held": 1, "block": 64 * 150}))
    table = vectors(700, same=40)
    table.at[5, "embedding"] = None if name == "cosine_pairs_topk_all" else table.at[5, "embedding"]
    got, want = against_sql(spark, name, tmp_path, embeddings=table)
    assert got == want


def test_neighbours_take_memory_of_a_tile(monkeypatch):
    """No array of a row for each query and a column for each candidate; equal vectors don't make all pairs candidates."""
    x, ids = np.ones((6_000, 4)), np.arange(6_000)
    import tracemalloc

    tracemalloc.start()
    found = knn.nearest(ids, x, ids, x, 3, 0.3)
    assert tracemalloc.get_traced_memory()[1] < 150e6  # the product with all rows took several arrays of this size and more
    tracemalloc.stop()
    assert found.column("dst").to_pylist()[:6] == [1, 2, 3, 0, 2, 3] and found.num_rows == 18_000


def test_neighbours_by_products_in_single_precision(monkeypatch):
    """Pairs that single precision can't tell apart are multiplied in double, and no other: the whole product in double isn't formed."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[300:420] = x[300] + 1e-9 * rng.normal(size=(120, 16))  # similarities of 1 - 1e-17 up to rounding
    x[420:700] = x[420] + 1e-3 * rng.normal(size=(280, 16))  # ... that differ by 1e-7
    ids, u = np.arange(900) * 3, knn.units(x)
    sim = np.round(u @ u.T, 10)
    np.fill_diagonal(sim, -np.inf)
    want = [ids[np.lexsort((ids, -row))[:5]].tolist() for row in sim]
    monkeypatch.setattr(knn, "TILE", (100, 150))
    found = knn.nearest(ids, x, ids, x, 5, -1.0, 10)
    assert found.num_rows == 4_500 and np.array(found.column("dst")).reshape(-1, 5).tolist() == want
    half, one, other = 300, knn.Tops(300, 5, -1.0, 10), knn.Tops(300, 5, -1.0, 10)
    monkeypatch.setattr(knn.Tops, "add", lambda *a: 1 / 0)
    knn._meet(ids[:half], u[:half], ids[:half] + 9_000, far := knn.units(rng.normal(size=(half, 16))), one, other, False)
    for best, sim in ((one, u[:half] @ far.T), (other, far @ u[:half].T)):
        got = np.array(best.edges(np.arange(half), np.arange(half)).column("dst")).reshape(-1, 5)
        assert got.tolist() == [np.lexsort((np.arange(half), -row))[:5].tolist() for row in np.round(sim, 10)]


def test_a_graph_that_comes_sorted_is_not_copied(monkeypatch):
    import tracemalloc

    n, near = 60_000, 20
    src = np.repeat(np.arange(n, dtype=np.int32), near)
    dst = ((src + np.tile(np.arange(1, near + 1, dtype=np.int32), n)) % n).reshape(n, near)
    dst.sort(axis=1)
    w = np.ones(n * near)
    monkeypatch.setattr(np, "lexsort", lambda *a: 1 / 0)
    tracemalloc.start()
    g = graph._Graph(src, dst.ravel(), w, n)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # an order and sorted copies of three arrays took 60 MB
    tracemalloc.stop()
    assert g.w is w and g.first[:3] == [0, 20, 40] and g.degree[0] == 20.0


def test_the_search_for_communities_is_whole(spark, tmp_path, monkeypatch):
    """All steps are taken, over a graph that is never collected."""
    vectors(300).to_parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    made = graph.communities
    monkeypatch.setattr(graph, "communities", lambda *a, **kw: seen.append(kw.get("steps", 30)) or made(*a, **kw))
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", lambda self: 1 / 0)
    found = catalog.community_search(spark, str(tmp_path))
    assert seen == [30] and found.agg(F.sum("n")).first()[0] <= 300 and 0.1 < found.first()["resolution"] < 10


def test_local_moving_by_hand():
    """Against the plain form: each node in seeded order to the community of its greatest gain, the smallest number of equal ones."""
    rng = np.random.default_rng(3)
    n = 60
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.15), 1)
    w = w + w.T
    at, order = np.arange(n), np.random.RandomState(5)
    degree, two_m = w.sum(axis=1), w.sum()
    for _ in range(50):
        before = at.copy()
        for i in order.permutation(n):
            if not w[i].any():
                continue
            own, near = at[i], np.unique(at[w[i] > 0])
            to = lambda c: w[i][at == c].sum()
            gains = [0.0 if c == own else to(c) - to(own) - degree[i] * (degree[at == c].sum() - degree[at == own].sum() + degree[i]) / two_m for c in near]
            if max(gains) > 1e-12:
                at[i] = near[int(np.argmax(gains))]
        if (at == before).all():
            break
    r, c = np.nonzero(w)
    assert graph._Graph(r, c, w[r, c], n).moved(1.0, 5).tolist() == np.unique(at, return_inverse=True)[1].tolist()


def test_medoids_are_checked_without_pairs(spark, tmp_path):
    vectors(300).to_parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.kmedoids_fixed_point(spark, str(tmp_path))
    assert not re.search(r"\(own#\d+ = own#\d+\)", found._jdf.queryExecution().optimizedPlan().toString())
    assert tuple(found.first()) == (300, 0, 0)


def test_medoids_of_many_rows_take_no_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kmedoids, "medoid_update", lambda *a: 1 / 0)
    table = vectors(400)
    p = spark.createDataFrame(pd.DataFrame({"id": table["vec_id"], "v": [x.tolist() for x in table["embedding"]]}))
    f = kmedoids.fit(p, 5, local_rows=1)
    at = f.assignments.toPandas().set_index("id")["cluster_id"]
    order = table.set_index("vec_id").loc[at.index]
    d = kmedoids.distances(x := np.stack(order["embedding"]).astype(float), x)
    for c, m in enumerate(f.medoids):
        own = np.flatnonzero(at.to_numpy() == c)
        costs = d[np.ix_(own, own)].sum(axis=1)
        assert costs[list(at.index[own]).index(m)] <= costs.min() + 1e-8
    assert f.inertia == pytest.approx(d[:, [list(at.index).index(m) for m in f.medoids]].min(axis=1).sum(), abs=1e-6)


def test_medoids_are_found_over_blocks_of_bytes(spark, monkeypatch):
    """Passes read vectors as bytes, a few numbers a block, and draw by the hash that Spark gives."""
    ids = [0, 1, -5, 2**62, 51_281]
    for seed, number in ((42, 0), (42, 19), (-3, 2)):
        want = spark.createDataFrame([(i,) for i in ids], "id long").select(F.xxhash64("id", F.lit(seed), F.lit(number))).collect()
        assert kmedoids._hashes(np.array(ids), seed, number).view(np.int64).tolist() == [r[0] for r in want]
    monkeypatch.setattr(kmedoids, "PACKED", 30)
    p = spark.createDataFrame([(i, [float(i), 1.0, 0.5]) for i in range(57)], "id long, v array<double>")
    blocks = kmedoids.packed(p)
    assert blocks.dtypes == [("ids", "binary"), ("vs", "binary")]
    found = [(i, v) for r in blocks.collect() for i, v in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["vs"]).reshape(-1, 3).tolist())]
    assert sorted(found) == [(i, [float(i), 1.0, 0.5]) for i in range(57)]
    assert {i: v.tolist() for i, v in kmedoids._vectors_of(blocks, [3, 56]).items()} == {3: [3.0, 1.0, 0.5], 56: [56.0, 1.0, 0.5]}


def test_the_sink_s_query_brings_lengths_together(spark, tmp_path, monkeypatch):
    seen, made = [], catalog.sinks.classifications
    monkeypatch.setattr(catalog.sinks, "classifications", lambda d: seen.append(d) or made(d))
    got, want = against_sql(spark, "classifications_sink", tmp_path, documents=texts("a" * 500, None, "", "b"))
    assert got == want and max(len(r["input"] or "") for r in seen[0].collect()) == 3


def test_discovery_sends_labels_alone(spark, monkeypatch):
    seen, made = [], type(spark.range(1)).toLocalIterator
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda self, *a: seen.append(self.columns) or made(self, *a))
    docs = spark.createDataFrame([(i, f"{'apple' if i < 9 else 'berry'} text{i % 3}") for i in range(20)], "doc_id long, input string")
    at_once = labelling.discover_labels(docs, size=4, sequential=False)
    assert seen == [["label"]] and at_once == labelling.discover_labels(docs, size=4)


def test_calls_of_an_embedder_are_bounded():
    b = pa.RecordBatch.from_pydict({"doc_id": range(6), "input": ["a" * 300_000, "b" * 300_000, None, "c" * 900_000, "d", "e"]})
    got = [c.column(0).to_pylist() for c in embedding._calls(b, 64)]
    assert got == [[0], [1, 2], [3], [4, 5]] and [c.num_rows for c in embedding._calls(b.slice(4), 1)] == [1, 1]


def test_tied_mixtures_by_components():
    rng = np.random.default_rng(1)
    x, m, a = rng.normal(size=(50, 4)), rng.normal(size=(7, 4)), rng.normal(size=(4, 4))
    cov = a @ a.T + np.eye(4)
    want = [[-0.5 * (r - c) @ np.linalg.inv(cov) @ (r - c) - 0.5 * np.linalg.slogdet(2 * np.pi * cov)[1] - np.log(7) for c in m] for r in x]
    assert np.allclose(gmm.Mixture("tied", np.full(7, 1 / 7), m, cov).log_joint(x), want)


def test_hard_assignments_have_no_number_a_component(spark):
    p = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)], "id long, v array<double>")
    model = gmm.fit(p, 2, n_init=1, max_iter=3)
    soft, hard = gmm.predict(p, model), gmm.predict(p, model, probs=False)
    assert hard.columns == ["id", "cluster_id"] and rows(hard.toPandas()) == rows(soft.select("id", "cluster_id").toPandas())


def test_silhouette_by_blocks_agrees_with_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metrics, "TILE", (40, 60))
    made = metrics._silhouette
    monkeypatch.setattr(metrics, "_silhouette", lambda p, metric, held: made(p, metric, 0))
    monkeypatch.setattr(metrics, "grid", lambda *a: knn.grid(*a, block=64 * 100))
    got, want = against_sql(spark, "silhouette_euclidean", tmp_path, embeddings=vectors(400))
    assert got == want


@pytest.mark.parametrize("seed", range(8))
def test_merging_by_all_pairs(seed, monkeypatch):
    """Against a sorted list of all pairs; ties are many."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(providers, "NEAREST", int(rng.integers(1, 5)))
    n, k = 60, int(rng.integers(1, 30))
    labels = list(dict.fromkeys("".join(rng.choice(list("abcd"), rng.integers(1, 8))) + " " + rng.choice(["red", "blue", ""]) for _ in range(n)))
    monkeypatch.setattr(providers, "_overlaps", lambda x: 1 / 0)  # the list of all pairs
    pairs = sorted((-providers._overlap(labels[i], labels[j]), i, j) for i in range(len(labels)) for j in range(i + 1, len(labels)))
    alive = set(range(len(labels)))
    for _, i, j in pairs:
        if i in alive and j in alive:
            alive.discard(j if providers.survivor(labels[i], labels[j]) == labels[i] else i)
            if len(alive) <= k:
                break
    assert providers.merge_closest(labels, k) == [labels[i] for i in sorted(alive)]
