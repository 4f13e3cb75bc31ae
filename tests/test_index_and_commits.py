"""The index after changes against a fresh one, early stops, and two writers."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import inverted, retrieval
from quillgraph.operators.inverted import InvertedIndex
from quillgraph.operators.store import GraphStore
from quillgraph.plans import commits
from quillgraph.plans.lineage import exists

NODES = "id string, type string, name string, content string, weight double, created_at long"
EDGES = "source string, target string, type string, weight double"
WORDS = ["tea", "green", "water", "hot", "leaf", "cup", "pot", "steam", "rare", "black"]


def nodes(spark, rows):
    return spark.createDataFrame([(i, "concept", n, c, 1.0, 1) for i, n, c in rows], NODES)


def texts(seed, n, first=0):
    r = random.Random(seed)
    pick = lambda k: " ".join(r.choices(WORDS, weights=[9, 7, 5, 5, 3, 3, 2, 2, 0.3, 1], k=k))
    return [(f"d{first + i}", pick(r.randrange(1, 4)), pick(r.randrange(0, 60))) for i in range(n)]


QUERIES = [(1, "green tea"), (2, "rare"), (3, "steam pot black"), (4, "nothing here"), (5, "tea water hot leaf cup")]


def hits(df):
    return sorted((r["query_id"], r["id"], r["bm25"], round(r["score"], 9)) for r in df.collect())


def plain(spark, n, limit=5, **options):
    return hits(retrieval.keyword_search(n, spark.createDataFrame(QUERIES, "query_id long, query string"), limit, **options))


def test_search_after_changes_equals_a_fresh_index(spark, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE_ROWS", 8)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    live = {i: (n, c) for i, n, c in texts(1, 150)}
    index, r = InvertedIndex.of(nodes(spark, [(i, *x) for i, x in live.items()])), random.Random(2)
    assert hits(index.search(asked, 5)) == plain(spark, nodes(spark, [(i, *x) for i, x in live.items()]))
    for step in range(2):
        new = texts(step + 5, 12, first=130 + 10 * step)
        gone = r.sample(sorted(live), 9)
        live.update({i: (n, c) for i, n, c in new})
        index = index.changed(nodes(spark, new))
        index = index.changed(removed=spark.createDataFrame([(g,) for g in gone] + [("unknown",)], "id string"))
        live = {i: x for i, x in live.items() if i not in gone}
        now = nodes(spark, [(i, *x) for i, x in live.items()])
        assert hits(index.search(asked, 5)) == plain(spark, now)
    assert len(index.segments) == 5
    assert index.docs().count() == len(live) and index.segments[1].docs.count() == 12  # only what changed was split
    fresh = InvertedIndex.of(now)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.dfs()) == rows(fresh.dfs()) and rows(index.tables()[0].select("id", "col", "term", "tf")) == rows(fresh.tables()[0].select("id", "col", "term", "tf"))
    one = index.merged()
    assert len(one.segments) == 1 and hits(one.search(asked, 5)) == plain(spark, now)
    assert plain(spark, now, prefix=True, index=index) == plain(spark, now, prefix=True)


def test_segments_merge_and_find_what_differs(spark, monkeypatch):
    monkeypatch.setattr(inverted, "SEGMENTS", 2)
    rows = texts(3, 30)
    index = InvertedIndex.of(nodes(spark, rows))
    for k in range(3):
        index = index.changed(nodes(spark, [(f"d{k}", "black", "tea")]))
    assert len(index.segments) <= 2
    other = nodes(spark, [("d0", "black", "tea"), ("x", "rare", "leaf"), *rows[5:]])
    behind = index.in_step_with(other)
    assert plain(spark, other, index=behind) == plain(spark, other)
    assert behind.in_step_with(other) is behind


def test_fewer_postings_are_read(spark, monkeypatch):
    monkeypatch.setattr(inverted, "RANGE_ROWS", 16)
    r = random.Random(4)
    common, rare = [f"w{i}" for i in range(40)], [f"x{i}" for i in range(400)]
    pick = lambda k: " ".join(r.choices(common, weights=[1 / (i + 3) for i in range(40)], k=k) + r.choices(rare, k=k // 8))
    n = nodes(spark, [(f"d{i}", pick(r.randrange(1, 3)), pick(r.randrange(5, 80))) for i in range(1500)])
    asked = spark.createDataFrame([(i, f"x{i * 9} w{i} w{i + 20}") for i in range(12)], "query_id long, query string")
    index = InvertedIndex.of(n)
    want = hits(retrieval.keyword_search(n, asked, 5))
    assert hits(index.search(asked, 5)) == want
    cost = [r for r in index.search_costs(asked, 5).collect()]
    assert len(cost) == 12 and all(r["read"] <= r["postings"] for r in cost)
    assert sum(r["read"] for r in cost) < 0.6 * sum(r["postings"] for r in cost)
    few = n.withColumn("type", F.when(F.col("id") < "d2", "concept").otherwise("lesson"))
    assert hits(index.search(asked, 5, ["lesson"], few)) == hits(retrieval.keyword_search(few, asked, 5, types=["lesson"]))


def test_the_store_keeps_its_index(spark, tmp_path):
    path = str(tmp_path / "g")
    store, _ = GraphStore.create(spark, path).add_nodes(nodes(spark, [(i, n, c[:140]) for i, n, c in texts(6, 40)]), 5)
    store = store.indexed().save(path)
    names = [s.name for s in store.index.segments]
    loaded = GraphStore.load(spark, path)
    assert [s.name for s in loaded.index.segments] == names and loaded.index_in_step().first()["in_step"]
    later, _ = loaded.add_nodes(nodes(spark, [("d1", "rare", "rare words"), ("new", "rare", "")]), 9)
    later, _ = later.remove(spark.createDataFrame([("d2",)], "id string"), 9)
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert hits(later.keyword_search(asked, limit=5)) == plain(spark, later.nodes)
    later = later.save(path)
    assert [s.name for s in later.index.segments][:1] == names and len(later.index.segments) == 3
    assert hits(GraphStore.load(spark, path).keyword_search(asked, limit=5)) == plain(spark, later.nodes)
    assert GraphStore.vacuum(spark, path, 1) == [3] and GraphStore.load(spark, path).index_in_step().first()["in_step"]
    with pytest.raises(commits.Conflict):
        loaded.save(path)


def test_the_second_of_two_writers_sees_a_conflict(spark, tmp_path):
    path = str(tmp_path / "g")
    GraphStore.create(spark, path)
    one, two = GraphStore.load(spark, path), GraphStore.load(spark, path)
    one.add_nodes(nodes(spark, [("a", "tea", "")]), 1)[0].save(path)
    mine, _ = two.add_nodes(nodes(spark, [("b", "pot", "")]), 1)
    with pytest.raises(commits.Conflict):
        mine.save(path)
    assert [r["id"] for r in GraphStore.load(spark, path).nodes.collect()] == ["a"]
    add = lambda i, store: store.add_nodes(nodes(spark, [(i, "pot", "")]), 1)[0]
    assert GraphStore.update(spark, path, partial(add, "b")).version == 3
    calls = []

    def raced(store):  # another writer comes in between, once
        calls.append(store.version)
        if len(calls) == 1:
            GraphStore.update(spark, path, partial(add, "c"))
        return add("d", store)

    assert GraphStore.update(spark, path, raced, base_delay_ms=1).version == 5 and calls == [3, 4]
    assert {r["id"] for r in GraphStore.load(spark, path).nodes.collect()} == {"a", "b", "c", "d"}


def test_only_one_can_put_a_file(spark, tmp_path):
    path = f"{tmp_path}/log/1.json"
    assert [commits.put_if_absent(spark, path, t) for t in ("first", "second")] == [True, False]
    assert open(path).read() == "first" and not [x for x in (tmp_path / "log").iterdir() if x.name.startswith("_")]
    assert not exists(spark, f"{tmp_path}/none") and commits.versions(spark, f"{tmp_path}/none") == []


def test_retries_end(spark):
    tried = []

    def never():
        tried.append(1)
        raise commits.Conflict

    with pytest.raises(commits.Conflict):
        commits.retried(never, 2, 1)
    assert len(tried) == 3
