"""The store's life, its index, searches and activation on small graphs, against plain versions."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.porter import porter
from quillgraph.operators import fold, graph, lifecycle, matrix, retrieval, statistics
from quillgraph.operators.store import GraphStore
from quillgraph.plans.lineage import Scratch, cut, exists
from quillgraph.sources import files, markdown, mentions, models

NODES = "id string, type string, name string, content string, weight double, created_at long"
EDGES = "source string, target string, type string, weight double"


def test_store_from_nothing(spark, tmp_path):
    path = str(tmp_path / "graph")
    store = GraphStore.create(spark, path)
    assert store.nodes.count() == 0 and store.edges.count() == 0
    new = spark.createDataFrame([("a", "concept", "Green tea", "leaves", 1.0, 1), ("b", "lesson", "Tea water", "not too hot", 0.5, 2)], NODES)
    store, bad = store.add_nodes(new, 5)
    store, _ = store.add_edges(spark.createDataFrame([("a", "b", "relates_to", 0.7)], EDGES), 5)
    assert bad.count() == 0
    assert store.save(path).version == 2
    again = GraphStore.create(spark, path)
    assert {r["id"] for r in again.nodes.collect()} == {"a", "b"} and again.edges.count() == 1
    row = again.index_in_step().first()
    assert (row["nodes"], row["indexed"], row["in_step"]) == (2, 0, False)
    indexed = again.indexed()
    assert indexed.index_in_step().first()["in_step"]
    q = spark.createDataFrame([(1, "tea leaves")], "query_id long, query string")
    plain = lambda s: sorted((r["id"], round(r["bm25"], 9)) for r in s.keyword_search(q).collect())
    assert plain(indexed) == plain(again) and len(plain(again)) == 2
    assert len(indexed.add_nodes(new, 6)[0].index.segments) == 1  # the same texts


def test_two_vectors_of_a_node_and_rows_of_a_key(spark):
    nodes = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None)], "id string, embedding array<float>")
    out = {r["id"]: r["embedding"] for r in lifecycle.store_embeddings(nodes, spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.5, 9.0]), ("b", None)], "id string, embedding array<float>")).collect()}
    assert out == {"a": [1.0, 0.0], "b": None}
    new = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("c", "x", 1)], "id string, name string, updated_at long")
    got = {r["id"]: r["name"] for r in lifecycle.upsert_nodes(spark.createDataFrame([("a", "first", 0)], new.schema), new).collect()}
    assert got == {"a": "new", "c": "x"}


def bm25_plain(docs, words, matches):
    sizes = {i: len(n.split()) + len(c.split()) for i, (n, c) in docs.items()}
    mean, out = sum(sizes.values()) / len(sizes), defaultdict(float)
    for q in words:
        tf = {i: 10.0 * sum(matches(t, q) for t in n.split()) + sum(matches(t, q) for t in c.split()) for i, (n, c) in docs.items()}
        tf = {i: v for i, v in tf.items() if v}
        idf = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
        for i, v in tf.items():
            out[i] += idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
    return {i: round(v, 9) for i, v in out.items()}


@pytest.mark.parametrize("prefix", [False, True])
def test_keyword_scores_match_a_plain_version(spark, prefix):
    rng = random.Random(3)
    words = ["a1", "ab", "abc", "abcd", "b", "bridge", "bridges", "c3po", "cat", "z"]
    docs = {f"d{i}": (" ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randrange(2, 20)))) for i in range(30)}
    nodes = spark.createDataFrame([(i, "concept", n, c, 1.0, 1) for i, (n, c) in docs.items()], NODES)
    asked = {1: "ab bridge", 2: "a-b cat", 3: "z-z zz"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    got = defaultdict(dict)
    for r in retrieval.keyword_search(nodes, queries, limit=50, prefix=prefix).collect():
        got[r["query_id"]][r["id"]] = r["bm25"]
    match = (lambda t, q: t.startswith(q)) if prefix else (lambda t, q: t == q)
    split = {1: ["ab", "bridge"], 2: ["a", "b", "cat"], 3: ["z", "zz"]}  # one-letter words are words
    assert dict(got) == {k: v for k, v in ((k, bm25_plain(docs, w, match)) for k, w in split.items()) if v}


def test_stems_meet(spark):
    nodes = spark.createDataFrame([("a", "concept", "running bridges", "", 1.0, 1), ("b", "concept", "other", "words", 1.0, 1)], NODES)
    q = spark.createDataFrame([(1, "bridge runs")], "query_id long, query string")
    assert {r["id"] for r in retrieval.keyword_search(nodes, q, stem=porter).collect()} == {"a"}


def activation_plain(nodes, edges, seeds, hops=2, least=0.01):
    """Breadth first in the order of seeds and edges; a node passes on what reached it first in its hop."""
    around, degree, weight = defaultdict(dict), defaultdict(int), {}
    for s, t, _, w, _ in edges:
        for x, y in ((s, t), (t, s)):
            degree[x] += 1
            if x != y:
                around[x].setdefault(y, 1.0)
                around[x][y] = max(around[x][y], w or 1.0)
    front, scores, visited = [(s, nodes[s] or 1.0) for s in seeds if s in nodes], {}, set()
    for _ in range(hops):
        following = []
        for i, score in front:
            if i in visited:
                continue
            visited.add(i)
            damp = math.log(degree[i] + 1) if degree[i] > 1 else 1
            for j, w in around[i].items():
                value = score / damp * 0.5 * w * (nodes.get(j) or 0.5) if j in nodes else 0
                if j in seeds or j not in nodes or value < least:
                    continue
                scores[j] = max(scores.get(j, 0), value)
                following.append((j, value))
        front = following
    return scores


def test_activation_in_order(spark):
    """Of two ways into a node in one hop, the first one is passed on, and the larger one kept."""
    rng, differs = random.Random(9), 0
    for _ in range(6):
        nodes = {f"n{i}": round(rng.uniform(0.3, 1), 2) for i in range(12)}
        ends = [tuple(rng.sample(sorted(nodes), 2)) for _ in range(24)]
        edges = [(s, t, "relates_to", round(rng.uniform(0.5, 3), 2), k) for k, (s, t) in enumerate(ends)]
        seeds = ["n3", "n1"]
        n = spark.createDataFrame([(i, w) for i, w in nodes.items()], "id string, weight double")
        e = spark.createDataFrame(edges, "source string, target string, type string, weight double, ord long")
        s = spark.createDataFrame([(1, i, k) for k, i in enumerate(seeds)], "query_id long, id string, ord long")
        run = lambda **o: {r["id"]: round(r["score"], 9) for r in graph.spreading_activation(n, e, s, max_results=99, **o).collect()}  # noqa: E731,B023
        exact, largest = run(order="ord"), run()
        assert exact == {k: round(v, 9) for k, v in activation_plain(nodes, edges, seeds).items()}
        assert exact.keys() <= largest.keys() and all(exact[k] <= largest[k] + 1e-9 for k in exact)
        differs += exact != largest
    assert differs


def test_hits_carry_weight_and_degree(spark):
    nodes = models.embed(spark.createDataFrame([("a", "concept", "green tea", "x", 0.7, 10), ("b", "concept", "green grass", "y", 0.4, 20)], NODES), "name")
    edges = spark.createDataFrame([("b", "a", "relates_to", 1.0), ("b", "b", "relates_to", 1.0)], EDGES)
    q = models.embed(spark.createDataFrame([(1, "green tea")], "query_id long, query string"), "query")
    got = {r["id"]: (r["weight"], r["degree"]) for r in retrieval.hybrid_search(nodes, edges, q).collect()}
    assert got == {"a": (0.7, 1), "b": (0.4, 3)}
    late = retrieval.hybrid_search(nodes, edges, q, since=15, until=20).collect()
    assert {r["id"] for r in late} == {"b"} and late[0]["rank"] == 1
    assert retrieval.presented(retrieval.hybrid_search(nodes, edges, q)).columns == ["query_id", "rank", "id", "score", "near_miss"]


def test_average_ranks(spark):
    rng = random.Random(5)
    values = [rng.choice([1.0, 2.5, 3.0]) if i % 3 else rng.random() for i in range(300)]
    got = statistics.average_ranks(spark.createDataFrame(list(enumerate(values)), "k long, v double"), "v").collect()
    order = sorted(values)
    for r in got:
        places = [i + 1 for i, v in enumerate(order) if v == r["v"]]
        assert r["avg_rank"] == sum(places) / len(places) and r["tied"] == len(places)


def test_names_anywhere_in_a_text(spark):
    texts = spark.createDataFrame([(1, "Über-Brücken und Tee"), (2, "cat"), (3, None), (4, "a")], "id long, content string")
    names = spark.createDataFrame([(1, "brück"), (2, "AT"), (3, "a"), (4, ""), (5, "tee x")], "name_id long, name string")
    got = {(r["id"], r["name_id"]) for r in mentions.mentions(texts, names).collect()}
    assert got == {(1, 1), (2, 2), (2, 3), (4, 3)}


def test_daily_logs_read_recent_files_only(spark, tmp_path):
    for day, text in (("2024-01-01", "- old entry that is long\n"), ("2024-03-09", "- new entry that is long\n- short\n- another entry here\n"), ("2024-03-12", "- an entry to come later\n")):
        (tmp_path / f"{day}.md").write_text(text)
    got = markdown.daily_logs(spark, str(tmp_path), "2024-03-10").orderBy("id").collect()
    assert [r["id"] for r in got] == ["event-2024-03-09-00", "event-2024-03-09-02", "event-2024-03-12-00"]


def test_details_of_many_lines_and_summaries(spark, tmp_path):
    folder = str(tmp_path / "d")
    files.write_details(spark.createDataFrame([("a", "one\n\ntwo\nthree"), ("b", "x")], "id string, detail string"), folder)
    got = files.read_details(spark, folder, spark.createDataFrame([("a",)], "id string")).collect()
    assert [(r["id"], r["detail"]) for r in got] == [("a", "one\n\ntwo\nthree")]
    (tmp_path / "x.json").write_text('[1, {"a": 2}, 3]')
    (tmp_path / "y.json").write_text('{"k": 1, "l": [2]}')
    assert {r["file"]: r["entries"] for r in files.json_lengths(spark, str(tmp_path)).collect()} == {"x.json": 3, "y.json": 2}
    matrix.write_phase(spark.createDataFrame([("r1", 1.0), ("r2", 3.0)], "run_id string, score double"), str(tmp_path), "phase1")
    assert spark.read.json(str(tmp_path / "phase1-summary")).first()["mean_score"] == 2.0
    assert spark.read.json(str(tmp_path / "phase1-results")).count() == 2


def test_scratch_tables_go(spark):
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(5))
        assert exists(spark, scratch.path)
        total = cut(kept.agg(F.sum("id").alias("n")))
    assert not exists(spark, scratch.path) and total.first()["n"] == 10


def test_replay_tells_the_summary_before():
    told = []

    def model(system, user):
        told.append(user)
        return fold.extractive_model(system, user)

    rows = [{"role": "user" if i % 2 == 0 else "assistant", "content": f"Message {i} about bridges and tea. " * 6, "tokens": 60} for i in range(30)]
    points = list(fold.replay_session(rows, 600, fold.topic_bounded, model, carry=True, keep_recent=1))
    assert len(points) > 1 and "Previous summary" not in told[0] and all("Previous summary: [" in t for t in told[1:])
