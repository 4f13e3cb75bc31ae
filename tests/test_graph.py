"""Graph and lifecycle operators on tiny hand-made graphs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import components, graph, lifecycle, schema
from quillgraph.operators.store import GraphStore

NODES = "id string, type string, name string, content string, weight double, created_at long, last_accessed long, pinned boolean, status string, access_count long"
EDGES = "source string, target string, type string, weight double"
HOUR, DAY = 3600000, 86400000


def nodes(spark, *ids, **over):
    row = {"type": "concept", "name": "n", "content": "", "weight": 1.0, "created_at": 0, "last_accessed": None, "pinned": False, "status": None, "access_count": 0} | over
    return spark.createDataFrame([(i, *row.values()) for i in ids], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, float(w)) for a, b, t, w in rows], EDGES)


def test_dangling_self_loops_and_parallel_edges(spark):
    n, e = nodes(spark, "a", "b", "c"), edges(spark, ("a", "b", "x", 1), ("a", "b", "y", 1), ("c", "c", "x", 1), ("a", "z", "x", 1))
    assert graph.valid_edges(e, n).count() == 3
    assert graph.dangling_edges(e, n).first()["missing"] == "target"
    ok = graph.valid_edges(e, n)
    assert {r["id"]: r["degree"] for r in graph.degree(n, ok).collect()} == {"a": 2, "b": 2, "c": 2}
    assert {r["id"]: r["degree"] for r in graph.degree(n, ok, True).collect()} == {"a": 2, "b": 2, "c": 1}
    assert graph.neighbors(n, ok, n.select("id").where("id = 'a'")).count() == 1


def test_components_match_union_find(spark):
    rng = random.Random(3)
    for size, n_edges in ((1, 0), (30, 20), (60, 70)):
        pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(n_edges)]
        parent = list(range(size))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = components.connected_components(spark.createDataFrame(pairs or [(0, 0)], "a long, b long"), "a", "b").collect()
        linked = {x for p in pairs if p[0] != p[1] for x in p}
        assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in linked}
        assert len(got) == len(linked)


def test_long_chain_settles(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.connected_components(chain, "a", "b")
    assert got.count() == 201 and got.select("component").distinct().count() == 1


def activation_model(node_weights, edge_rows, seed, hops=2, decay=0.5, least=0.01):
    """Plain activation in max mode."""
    adjacent = {}
    degree = dict.fromkeys(node_weights, 0)
    for a, b, _, w in edge_rows:
        degree[a] += 1
        degree[b] += 1
        for x, y in ((a, b), (b, a)):
            if x != y:
                adjacent.setdefault(x, {})[y] = max(1.0, w or 1.0, adjacent.get(x, {}).get(y, 0))
    best, visited, frontier = {}, {seed}, {seed: node_weights[seed] or 1.0}
    for _ in range(hops):
        sent = {}
        for x, s in frontier.items():
            damp = math.log(degree[x] + 1) if degree[x] > 1 else 1
            for y, w in adjacent.get(x, {}).items():
                v = s / damp * decay * w * (node_weights[y] or 0.5)
                if y != seed and v >= least:
                    sent[y] = max(sent.get(y, 0), v)
        for y, v in sent.items():
            best[y] = max(best.get(y, 0), v)
        frontier = {y: v for y, v in sent.items() if y not in visited}
        visited |= set(sent)
    return best


def test_activation_matches_model(spark):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(14)]
    weights = {i: rng.choice([0.0, 0.3, 0.9, 1.0]) for i in ids}
    rows = [(a, b, "relates_to", rng.choice([0.0, 0.5, 1.0, 1.5])) for a, b in itertools.combinations(ids, 2) if rng.random() < 0.25]
    n = spark.createDataFrame([(i, "concept", w) for i, w in weights.items()], "id string, type string, weight double")
    got = graph.spreading_activation(n, edges(spark, *rows), spark.createDataFrame([("q", "n0")], "query_id string, id string"), max_results=100).collect()
    want = activation_model(weights, rows, "n0")
    assert {r["id"]: round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert all(r["path"][0] == "n0" and r["path"][-1] == r["id"] and len(r["path"]) == r["hops"] + 1 for r in got)


def test_decay_rules(spark):
    n = nodes(spark, "plain", "old", created_at=0).unionAll(nodes(spark, "pin", pinned=True, weight=0.7)).unionAll(nodes(spark, "done", type="task", status="done", created_at=20 * DAY))
    e = edges(spark, ("plain", "old", "supersedes", 1), ("pin", "plain", "x", 1))
    got = {r["id"]: r for r in lifecycle.decay(n, e, 20 * DAY).collect()}
    assert got["plain"]["new_weight"] == pytest.approx(0.995**480)
    assert got["old"]["new_weight"] == pytest.approx(0.995 ** (480 * 4))  # superseded and isolated
    assert got["pin"]["fate"] == "pinned" and got["pin"]["new_weight"] == 0.7
    assert got["done"]["fate"] == "pruned"
    kept, archive, left = lifecycle.prune(lifecycle.decay(n, e, 20 * DAY), e, 20 * DAY)
    assert {r["id"] for r in archive.collect()} == {"old", "done"} and left.count() == 1 and kept.count() == 2


def test_decay_never_rises_with_time(spark):
    n, e = nodes(spark, "a", type="entity"), edges(spark)
    weights = [lifecycle.decay(n, e, h * HOUR).first()["new_weight"] for h in (1, 10, 100)]
    assert weights == sorted(weights, reverse=True)


def test_boost_suppress_touch_and_marks(spark):
    n = nodes(spark, "a", weight=0.9).unionAll(nodes(spark, "p", weight=0.5, pinned=True))
    ids = spark.createDataFrame([("a",), ("p",)], "id string")
    assert {r["id"]: r["weight"] for r in lifecycle.boost(n, ids, 5).collect()} == {"a": 1.0, "p": 0.7}
    assert {r["id"]: round(r["weight"], 3) for r in lifecycle.suppress(n, ids).collect()} == {"a": 0.88, "p": 0.5}
    assert {r["access_count"] for r in lifecycle.touch(n, ids, 5).collect()} == {1}


def test_admit_guards(spark):
    rows = [("ok", "task", "word " * 40, "short"), ("long", "concept", "n", "x" * 151), ("bad", "widget", "n", ""), ("", "concept", "n", "")]
    good, bad = schema.admit(spark.createDataFrame(rows, "id string, type string, name string, content string"), 7)
    row = good.collect()
    assert len(row) == 1 and row[0]["name"].endswith("word…") and len(row[0]["name"]) <= 151
    assert row[0]["status"] == "active" and row[0]["created_at"] == 7 and row[0]["weight"] == 1.0
    assert {r["id"] for r in bad.collect()} == {"long", "bad", ""}


def test_store_round_trip(spark, tmp_path):
    new = spark.createDataFrame([("a", "concept", "A"), ("b", "lesson", "B")], "id string, type string, name string")
    store, bad = GraphStore(spark.createDataFrame([], schema_of(schema.NODE_COLUMNS)), spark.createDataFrame([], schema_of(schema.EDGE_COLUMNS))).add_nodes(new, 1)
    assert bad.count() == 0
    store, bad = store.add_edges(spark.createDataFrame([("a", "b", "led_to"), ("a", "zz", "led_to")], "source string, target string, type string"), 1)
    assert bad.count() == 1
    store.save(str(tmp_path))
    again = GraphStore.load(spark, str(tmp_path))
    assert again.stats().first().asDict() == {"nodes": 2, "edges": 1}
    boosted = again.suppress(spark.createDataFrame([("a",)], "id string"), 0.5)
    boosted.save(str(tmp_path))
    assert GraphStore.load(spark, str(tmp_path)).get_node("a").first()["weight"] == 0.5
    left, archive = again.remove(spark.createDataFrame([("b",)], "id string"), 2)
    assert left.all_edges().count() == 0 and archive.count() == 1


def schema_of(columns):
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def test_upsert_keeps_vectors(spark):
    old = spark.createDataFrame([("a", 1.0, [1.0, 2.0])], "id string, weight double, embedding array<float>")
    new = spark.createDataFrame([("a", 0.5, None), ("b", 0.1, None)], "id string, weight double, embedding array<float>")
    got = {r["id"]: r for r in lifecycle.upsert_nodes(old, new).collect()}
    assert got["a"]["embedding"] == [1.0, 2.0] and got["a"]["weight"] == 0.5 and got["b"]["embedding"] is None
