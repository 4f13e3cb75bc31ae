"""Similar pairs that are counted, connected or sought at some nodes only, against the table of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, retrieval
from quillgraph.operators import similarity as S
from tests.test_similarity import brute, frame


def even(n=600, size=8, seed=7):
    return np.random.default_rng(seed).normal(size=(n, size))


def edges_of(spark, v, threshold):
    near = np.argwhere(np.triu(brute(v, v, threshold), 1))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    return spark.createDataFrame([(int(a), int(b), "relates_to", float(unit[a] @ unit[b])) for a, b in near], "source long, target long, type string, weight double")


@pytest.mark.parametrize("block", [40, 4096])
def test_best_counts_and_links(spark, block):
    v = even()
    df, near = frame(spark, v), brute(v, v, 0.8)
    np.fill_diagonal(near, False)
    assert {r["id"]: r["n"] for r in S.similar_counts(df, 0.8, block_rows=block).collect()} == {i: int(n) for i, n in enumerate(near.sum(axis=1)) if n}
    part = near[:, ::3].sum(axis=1)
    assert {r["id"]: r["n"] for r in S.similar_counts(df, 0.8, df.where("id % 3 = 0"), block_rows=block).collect()} == {i: int(n) for i, n in enumerate(part) if n}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosines = np.where(near, unit @ unit.T, -1)
    got = S.best_between(df, df, 0.8, 2, block_rows=block).collect()
    assert {(r["a"], r["b"]) for r in got} == {(i, int(j)) for i in range(len(v)) for j in np.argsort(-cosines[i])[:2] if near[i, j]}
    links = S.similar_links(df, 0.95, block_rows=block)
    assert links.count() < 16 * len(v)
    parts = lambda e: {r["id"]: r["component"] for r in graph.communities(df, e.select(F.col("a").alias("source"), F.col("b").alias("target"))).collect()}
    assert parts(links) == parts(S.similar_pairs(df, 0.95))


def test_even_vectors_are_compared_once(spark):
    v = even(900, 32)
    cost = S.pair_costs(frame(spark, v), 0.35, block_rows=60).first()
    assert cost["rows"] <= 900 * S.BLOCKS and cost["compared"] <= 1.1 * 900 * 900 / 2 + 900 * 60  # cells would compare most pairs in many of them


def test_alike_rows_send_no_pairs(spark):
    df = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    sent = S._compared(S._side(df, 1, "id", "embedding").unionAll(S._side(df, 2, "id", "embedding")), 0.9, 50, "best")
    assert sent.count() <= 300 * 6  # a row a task and key, where there are 89,700 pairs
    assert {(r["a"], r["b"]) for r in S.best_between(df, df, 0.9, block_rows=50).collect()} == {(0, 1), *((i, 0) for i in range(1, 300))}
    assert S.similar_links(df, 0.9, block_rows=50).count() <= 300 * 6 * 2


def test_suggestions_need_no_table_of_pairs(spark):
    v = even(400)
    df, strong, weak = frame(spark, v), edges_of(spark, v, 0.8), edges_of(spark, v, 0.7)
    both = weak.select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("weight").alias("score"))
    both = both.unionAll(weak.select(F.col("target").alias("id"), F.col("source").alias("other"), F.col("weight").alias("score")))
    rows = lambda out: sorted((r["id"], r["other"], round(r["score"], 9)) for r in out.collect())
    want = rows(graph.low_degree_suggestions(both, df, strong, hub=3, least=0.7))
    assert want and rows(graph.near_suggestions(df, 0.8, hub=3, least=0.7)) == want


@pytest.mark.parametrize("part", [50, 1 << 14])
def test_hybrid_search_by_near_edges(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    v = even(500, 6)
    nodes = frame(spark, v).withColumns({"name": F.concat(F.lit("node "), F.col("id") % 9), "content": F.concat(F.lit("text "), F.col("id") % 31), "type": F.lit("x"), "weight": 0.5 + F.col("id") % 50 / 100, "created_at": F.col("id")})
    queries = nodes.where("id % 100 = 3").select(F.col("id").alias("query_id"), F.lit("node 4 text 7").alias("query"), "embedding")
    order = spark.range(499).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.when(F.col("id") % 5 == 0, "supersedes").otherwise("precedes").alias("type"), F.lit(1.0).alias("weight"))
    full, near = edges_of(spark, v, 0.8).unionAll(order), graph.NearEdges(nodes.select("id", "embedding"), 0.8, order)
    rows = lambda e: sorted(tuple(r) for r in retrieval.hybrid_search(nodes, e, queries, limit=8).select("query_id", "rank", "id", F.round("score", 7), F.round("graph", 7), "degree").collect())
    assert rows(near) == rows(full)
    seeds = queries.select("query_id", F.col("query_id").alias("id"))
    spread = lambda e: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in graph.spreading_activation(nodes, e, seeds, max_results=400).collect())
    assert spread(near) == spread(full)
    hits = queries.select("query_id", (F.col("query_id") + 3).alias("id"), F.lit(1.0).alias("score"))
    assert sorted(graph.demote_superseded(hits, near).collect()) == sorted(graph.demote_superseded(hits, full).collect())


def test_rows_that_can_send_are_kept_and_most_others_not(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 100)
    v = even(500, 4)
    nodes = frame(spark, v).withColumn("weight", F.lit(0.9))
    near = graph.NearEdges(nodes, 0.5, edges_of(spark, v[:0], 0.5))
    frontier = nodes.select(F.lit(0).alias("query_id"), "id", F.lit(0.05).alias("score"))
    degree = (brute(v, v, 0.5).sum(axis=1) - 1).clip(0)
    can = {i for i, n in enumerate(degree) if 0.05 * 0.5 * 0.9 / (np.log(n + 1) if n > 1 else 1) >= 0.01}
    kept = {r["id"] for r in near.may_pass(nodes, frontier, 0.5, 0.01).collect()}
    assert can <= kept and len(kept) < 50


def test_a_common_name_is_matched_without_all_its_pairs(spark):
    known = spark.range(2000).select("id", F.lit("Same Name").alias("name"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    new = known.select((F.col("id") + 1).alias("id"), "name", F.array(F.lit(0.0)).alias("embedding")).where("id in (1, 2000)").unionAll(spark.sql("select 0L id, '' name, array(0d) embedding"))
    got = {r["id"]: (r["decision"], r["matched"]) for r in retrieval.dedup_decisions(new, known).collect()}
    assert got == {1: ("exact", 1), 2000: ("name", 0), 0: ("exact", 0)}


def test_ends_read_the_edges_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2, "x", 1.0), (2, 2, "x", 1.0), (3, 1, "y", 1.0)], "source long, target long, type string, weight double")
    edges, nodes = edges.mapInArrow(seen, edges.schema), spark.range(1, 5)
    assert {r["id"]: r["degree"] for r in graph.degree(nodes, edges).collect()} == {1: 2, 2: 3, 3: 1, 4: 0} and reads.value == 3
    assert [r["id"] for r in graph.orphans(nodes, edges).collect()] == [4] and reads.value == 6
