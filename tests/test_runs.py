"""Whole runs: providers over HTTP, answers and stages that are kept, single steps, drawings, embedders, lists that grow."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext import cli
from loomtext.functions import prompts, responses
from loomtext.operators import embedding, labelling, labelsets, profile
from loomtext.operators import providers as P
from loomtext.plans import cache, checks, pipelines, plots
from loomtext.sources import config, readers, scratch, sinks


class Endpoint(ThreadingHTTPServer):
    """A chat-completions and responses endpoint that answers with the offline provider; ``refusals`` calls get 429 first."""

    def __init__(self, refusals: int = 0, dies_after: int | None = None):
        self.asked, self.refusals, self.dies_after, self.lock = [], refusals, dies_after, threading.Lock()
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_address[1]}/v1/chat"


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body, s = json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.server
        prompt = body["input"] if "input" in body else body["messages"][0]["content"]
        with s.lock:
            refused = s.refusals > 0
            s.refusals -= refused
            dead = not refused and s.dies_after is not None and len(s.asked) >= s.dies_after
            if not (refused or dead):
                s.asked.append((prompt, body, self.headers["Authorization"]))
        if refused or dead:
            self.send_response(429 if refused else 500)
            self.send_header("Content-Length", "0")
            self.end_headers()
            return
        said = P.OfflineProvider().chat(prompt)
        if "input" in body:
            answer = {"output": [{"type": "reasoning"}, {"content": [{"type": "output_text", "text": said}]}], "usage": {"input_tokens": 7, "output_tokens": 3, "output_tokens_details": {"reasoning_tokens": 2}}}
        else:
            answer = {"choices": [{"message": {"content": said}}], "usage": {"prompt_tokens": 10, "completion_tokens": 4}}
        raw = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


@pytest.fixture()
def endpoint():
    made = []

    def start(**kw):
        made.append(Endpoint(**kw))
        return made[-1]

    yield start
    for e in made:
        e.shutdown()


def settings_of(e: Endpoint, **kw) -> config.Settings:
    return config.Settings(llm_base_url=e.url, llm_model="m", llm_request_delay=0.0, llm_retry_wait=0.01, **kw)


def texts(spark, n=24):
    rows = [(i, f"{('apple pie', 'fast car', 'green tree')[i % 3]} number{i}", "abc"[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, input string, label string")


def test_endpoint_waits_counts_and_fails(endpoint):
    e = endpoint(refusals=2)
    p = P.make_provider(settings_of(e), "secret")
    said = p.chat(prompts.classify("a fast car", ["car", "tree"]))
    assert responses.single_answer(said, ["car", "tree"]) == "car" and p.last == (10, 4, 0)
    assert e.asked[0][1]["model"] == "m" and e.asked[0][1]["max_tokens"] == 4096 and e.asked[0][2] == "Bearer secret"
    p.chat(prompts.classify("a tree", ["car", "tree"]), max_tokens=64)
    assert e.asked[1][1]["max_tokens"] == 64 and dict(p.usage) == {"calls": 2, "tokens_in": 20, "tokens_out": 8}
    p.reset()
    assert not p.usage and p.last == (0, 0, 0)
    e.dies_after = 2
    assert p.chat("TASK name\nx\nINPUT {}") is None and p.last == (0, 0, 0)
    assert P.make_provider(settings_of(endpoint(refusals=9), llm_attempts=2)).chat("x") is None


def test_responses_style_and_detection(endpoint):
    e = endpoint()
    s = config.Settings(llm_base_url=e.url + "/responses", llm_model="m", llm_request_delay=0.0)
    assert P.style_of(s) == "responses" and P.style_of(config.Settings()) == "offline" and P.style_of(settings_of(e)) == "chat"
    p = P.make_provider(s)
    assert responses.parse_labels(p.chat(prompts.generate_labels(["green tree"]))) and p.last == (7, 3, 2)
    assert not checks.probe(lambda: P.make_provider(s))["within_tokens"]  # it reasons
    assert checks.verdict(checks.probe(lambda: P.make_provider(settings_of(e)))) == "good"
    dead = endpoint(dies_after=0)
    assert checks.verdict(checks.probe(lambda: P.make_provider(settings_of(dead)))) == "unusable"


def test_asking_from_the_executors_counts_tokens(spark, endpoint):
    s = settings_of(endpoint(refusals=1))
    q = spark.createDataFrame([(i, prompts.name_group([f"text {i}"])) for i in range(6)], "request_id long, prompt string")
    used = P.usage(P.ask(q, lambda: P.make_provider(s))).first()
    assert (used["calls"], used["failures"], used["tokens_in"], used["tokens_out"]) == (6, 0, 60, 24)
    assert P.usage(P.ask(q.filter("false"))).first().asDict() == dict.fromkeys(("calls", "failures", "n_in", "n_out", "tokens_in", "tokens_out"), 0)


def test_an_interrupted_run_asks_only_the_rest(spark, endpoint, tmp_path):
    e, folder = endpoint(dies_after=5), str(tmp_path / "answers")
    s = settings_of(e)
    classify = lambda: {r["doc_id"]: r["label"] for r in labelling.classify(texts(spark), ["car", "pie", "tree"], lambda: P.make_provider(s, "", folder), size=2, retry_single=False).collect()}
    first = classify()
    assert len(e.asked) == 5 and sum(v == "Unsuccessful" for v in first.values()) == 14
    e.dies_after = None
    assert classify() == {i: ("pie", "car", "tree")[i % 3] for i in range(24)}
    assert len(e.asked) == len({p for p, _, _ in e.asked}) == 12
    assert P.kept_usage(spark, folder).first().asDict() == {"calls": 12, "n_in": sum(len(p) for p, _, _ in e.asked), "n_out": P.kept_usage(spark, folder).first()["n_out"], "tokens_in": 120, "tokens_out": 48, "reasoning": 0}
    again = P.Remembering(P.OfflineProvider(), folder)
    a, b = again.chat("TASK name\n\nINPUT {\"texts\": [\"x y z word\"]}"), again.chat("TASK name\n\nINPUT {\"texts\": [\"x y z word\"]}")
    assert a == b and again.times.most_common(1)[0][1] == 2


@pytest.fixture()
def toy(tmp_path, monkeypatch):
    d = tmp_path / "data" / "toy"
    d.mkdir(parents=True)
    rows = [{"input": f"{a} {b}", "label": a} for a in ("apple pie", "fast car") for b in "one two three four five six".split()]
    (d / "small.jsonl").write_text("\n".join(map(json.dumps, rows)))
    monkeypatch.chdir(tmp_path)

    def go(spark, mode, *extra):
        return cli.run(cli.parser().parse_args([mode, "--data", str(tmp_path / "data"), "--runs", str(tmp_path / "runs"), "--dataset", "toy", *extra]), spark)

    return go


def test_the_steps_of_a_run(spark, toy, endpoint, monkeypatch):
    e = endpoint()
    for k, v in {"LLM_BASE_URL": e.url, "LLM_MODEL": "m", "LLM_REQUEST_DELAY": "0", "LLM_API_KEY": "k"}.items():
        monkeypatch.setenv(k, v)
    assert len(toy(spark, "seed-labels")["seed_labels"]) == 0  # a fifth of two
    made = toy(spark, "label-gen", "--k", "2")
    run, calls = made["run_dir"], len(e.asked)
    assert len(made["labels"]) == 2 and calls > 0
    assert toy(spark, "label-gen", "--k", "2", "--run", run)["labels"] == made["labels"] and len(e.asked) == calls
    done = toy(spark, "classify", "--run", run)
    assert done["n_samples"] if "n_samples" in done else done["k"] == 2
    assert done["usage"]["calls"] == len(e.asked) and done["usage"]["tokens_in"] == 10 * len(e.asked)
    scored = toy(spark, "evaluate", "--run", run)
    assert scored["n_samples"] == 12 and 0 <= scored["ACC"] <= 1 and len(scored["plots"]) == 7
    for f in toy(spark, "visualize", "--run", run)["plots"]:
        assert ElementTree.parse(f).getroot().tag.endswith("svg")
    assert len(toy(spark, "remerge", "--run", run, "--k", "1")["labels"]) == 1
    pre = toy(spark, "preflight")
    assert pre["key"] and pre["data"] and pre["reachable"] and pre["seed_labels"] is False and pre["echo"]["llm_model"] == "m"
    assert toy(spark, "probe")["verdict"] == "good"


@pytest.mark.parametrize("mode,step,extra", [("kmedoids", "clusters", ["--k0", "4"]), ("gmm", "representatives", ["--k0", "3", "--threshold", "0.4"]), ("nine-stage", "discovered", ["--k0", "4", "--k", "2"]), ("nine-stage", "labels", ["--k0", "4", "--k", "2", "--version", "2"]), ("nine-stage", "classified", ["--k0", "4", "--k", "2", "--version", "3", "--reduction", "pca"]), ("hybrid", "k1_labels", ["--k", "2"]), ("graph", "communities", []), ("paper", "generated", ["--k", "2"]), ("baseline", "clusters", ["--k", "2", "--method", "gmm"])])
def test_runs_stop_and_go_on(spark, toy, tmp_path, monkeypatch, mode, step, extra):
    """After a step the run goes on: what is there isn't computed again, and it ends as if it had never stopped."""
    stopped = toy(spark, mode, "--step", step, "--run", str(tmp_path / "a"), *extra)
    assert stopped["step"] == step and not (tmp_path / "a" / "results.json").exists()
    made, init = [], cache.Stages.__init__
    monkeypatch.setattr(cache.Stages, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    got = toy(spark, mode, "--run", str(tmp_path / "a"), *extra)
    assert step not in made[0].made and "vectors" not in made[0].made
    want = toy(spark, mode, "--run", str(tmp_path / "b"), *extra)
    same = lambda r: {k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items() if k not in ("run_dir", "usage", "bic", "inertia")}
    assert {k: v for k, v in got.items() if k in same(want)} == same(want) and got["n_samples"] == 12


def test_own_vectors_and_embedders(spark, toy, tmp_path):
    x = [(i, [float(i < 6), float(i >= 6)]) for i in range(12)]
    spark.createDataFrame(x, "doc_id int, v array<double>").write.parquet(str(tmp_path / "v"))
    assert toy(spark, "baseline", "--k", "2", "--vectors", str(tmp_path / "v"))["ACC"] == 1.0
    got = embedding.embed(texts(spark, 3), embedding.make_embedder("loomtext.operators.embedding:HashEmbedder"))
    assert got.count() == 3


def test_hash_embedder_by_brute_force():
    """Words and their trigrams with a blank at either end, counted with signs: equal bags give equal vectors, texts don't mix."""
    e = embedding.HashEmbedder(64)
    some = ["Red apples", "apples, RED", "", None, "   ", "naïve ünïcödé 日本語 _x9", "a\0b", "a b", "red apple"]
    v = e.encode(some)
    assert np.allclose(v[0], v[1]) and np.allclose(v[6], v[7]) and not v[2].any() and not v[3].any() and not v[4].any()
    assert np.allclose(np.linalg.norm(v[[0, 5, 8]], axis=1), 1) and 0.4 < v[0] @ v[8] < 1
    assert np.allclose(np.concatenate([e.encode([t]) for t in some]), v)
    big = embedding.HashEmbedder(1 << 20)
    row = big.encode(["abc abd"])[0]
    grams = ["abc", "abd", " ab", "abc", "bc ", " ab", "abd", "bd "]
    assert sorted(np.abs(row[row != 0]) / np.abs(row[row != 0]).min()) == pytest.approx(sorted([1, 1, 2, 1, 1, 1, 1])) and len(grams) == 8
    assert e.encode([]).shape == (0, 64)


def test_tfidf_by_brute_force(spark):
    docs = spark.createDataFrame([(1, "red red car"), (2, "red tree"), (3, "tree, car!"), (4, ""), (5, None), (6, "-- ??")], "doc_id long, input string")
    dim = 1 << 12
    sparse = embedding.tfidf(docs, dim)
    got = {r["doc_id"]: np.array(r["v"]) for r in embedding.dense(sparse, dim).collect()}
    idf = {w: np.log(7 / (d + 1)) for w, d in {"red": 2, "car": 2, "tree": 2}.items()}
    bags = {1: {"red": 2, "car": 1}, 2: {"red": 1, "tree": 1}, 3: {"tree": 1, "car": 1}}
    for a in bags:
        for b in bags:
            dot = sum(bags[a].get(w, 0) * bags[b].get(w, 0) * idf[w] ** 2 for w in idf)
            norm = [np.sqrt(sum((n * idf[w]) ** 2 for w, n in bags[i].items())) for i in (a, b)]
            assert got[a] @ got[b] == pytest.approx(dot / norm[0] / norm[1])
    assert not any(got[i].any() for i in (4, 5, 6))


def test_trim_by_embeddings():
    assert labelling.trim_labels(["car", "cars", "apple"], 2) == ["car", "apple"]

    class Axes:
        def encode(self, labels):
            return np.array([{"big": (1, 0), "large": (0.99, 0.1), "red": (0, 1)}[x] for x in labels])

    assert labelling.trim_labels(["large", "red", "big"], 2, Axes) == ["red", "big"]
    assert labelling.consolidate(["large", "red", "big"], 2, type("Mute", (), {"chat": lambda *a: None})(), embedder=Axes) == ["red", "big"]


def test_labels_are_generated_in_a_seeded_shuffle(spark):
    seen = []

    class Note:
        def chat(self, prompt, max_tokens=None):
            seen.append(prompts.inputs_of(prompt)[1]["texts"])
            return '{"labels": ["x"]}'

    for seed in (1, 1, 2):
        labelling.generate_labels(texts(spark), Note, 8, seed=seed)
    assert seen[:3] == seen[3:6] != seen[6:] and sorted(sum(seen[:3], [])) == sorted(sum(seen[6:], []))
    assert seen[0] != [r["input"] for r in texts(spark).orderBy("doc_id").limit(8).collect()]


def test_results_of_many_texts_have_rows_of_bounded_size(spark, tmp_path):
    labelled = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("input"), F.when(F.col("id") < 990, "big").otherwise("small").alias("label"))
    sinks.write_classifications(labelled, f"{tmp_path}/run/classifications", most=100)
    lines = spark.read.json(f"{tmp_path}/run/classifications")
    assert lines.agg(F.max(F.size("texts"))).first()[0] < 200 and lines.filter("label = 'small'").count() == 1
    back = readers.load_predictions(spark, f"{tmp_path}/run")
    assert back.count() == 1000 and {(r["bucket"], r["label"]) for r in back.select("bucket", "label").distinct().collect()} == {(0, "big"), (1, "small")}


def test_sides_are_broadcast_only_if_small(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 5)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(scratch.small(spark.range(5))) and not hinted(scratch.small(spark.range(6)))


def test_imbalance_of_many_singletons(spark):
    counts = spark.createDataFrame([(f"l{i:02}", 1) for i in range(20, 0, -1)] + [("big", 30)], "label string, n long")
    got = profile.imbalance(counts).first()
    assert list(got["singletons"]) == [f"l{i:02}" for i in range(1, 6)] and got["n_singletons"] == 20 and got["is_imbalanced"]
    none = profile.imbalance(counts.filter("n > 1")).first()
    assert list(none["singletons"]) == [] and none["n_singletons"] == 0


def test_chunks_of_shuffled_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 40, f"t{i}") for i in range(100)], "doc_id long, input string")
    got = labelsets.chunks(docs, 7, order=labelsets.hash_order("doc_id", "input", seed=3)).orderBy("chunk_id").collect()
    assert sorted(x for r in got for x in r["items"]) == sorted(f"t{i}" for i in range(100)) and [len(r["ids"]) for r in got] == [7] * 14 + [2]


def test_drawings_of_odd_tables(spark, tmp_path):
    docs = texts(spark, 6).withColumn("label", F.when(F.col("doc_id") > 0, F.col("label")))
    labelled = docs.select("doc_id", F.when(F.col("doc_id") < 4, F.lit("<a & b>")).alias("label"))
    tables = pipelines.plot_tables(docs, pipelines.Result(labelled, [], 0), embedding.embed(docs))
    for t in (tables, {k: v.filter("false") for k, v in tables.items()}):
        for f in plots.draw(t, str(tmp_path / "p"), "odd & <even>"):
            ElementTree.parse(f)
