"""Permutations, the Vendi score and ranking quality against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.vector import top_k
from quillgraph.operators import retrieval, statistics


def groups(spark, shift, na=37, nb=52):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(shift, 1, na), rng.normal(0, 1, nb)]).round(3)
    rows = [(f"k{i}", float(x), "a" if i < na else "b") for i, x in enumerate(v)] + [("n", None, "a"), ("o", 5.0, "other")]
    return v, spark.createDataFrame(rows, "k string, v double, g string")


@pytest.mark.parametrize("edge_rows,shift", [(1 << 16, 0.3), (3, 0.3), (1 << 16, 3.0)])
def test_permutations_have_fixed_sizes(spark, monkeypatch, edge_rows, shift):
    import hashlib

    monkeypatch.setattr(statistics, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(statistics, "STEP_BITS", 4)
    v, df = groups(spark, shift)
    got = statistics.permutation_test(df, "v", "g", "a", "b", "k", reps=60).first()
    seen, extreme = v[:37].mean() - v[37:].mean(), 0
    for rep in range(1, 61):
        order = sorted(range(len(v)), key=lambda i: int(hashlib.md5(f"k{i}:{rep}:42".encode()).hexdigest()[:15], 16))
        a, b = v[order[:37]], v[order[37:]]
        assert (len(a), len(b)) == (37, 52)
        extreme += abs(a.mean() - b.mean()) >= abs(seen) - 1e-12
    assert got["difference"] == pytest.approx(seen) and got["reps"] == 60
    assert got["p"] == pytest.approx((extreme + 1) / 61)


def test_p_is_near_that_of_many_permutations(spark):
    v, df = groups(spark, 0.45)
    rng, seen = np.random.default_rng(4), abs(v[:37].mean() - v[37:].mean())
    draws = np.array([rng.permutation(v) for _ in range(20000)])
    p = (np.abs(draws[:, :37].mean(1) - draws[:, 37:].mean(1)) >= seen).mean()
    assert statistics.permutation_test(df, "v", "g", "a", "b", "k", reps=2000).first()["p"] == pytest.approx(p, abs=0.025)


def test_vendi_by_group(spark):
    rng = np.random.default_rng(5)
    sets = {"mixed": rng.normal(size=(40, 6)), "alike": np.ones((30, 6)), "two": np.repeat(np.eye(6)[:2], 10, axis=0)}
    rows = [(g, [float(y) for y in x]) for g, m in sets.items() for x in m] + [("alike", None), ("alike", [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "g string, embedding array<double>").repartition(5)
    got = {r["g"]: (r["n"], r["vendi"]) for r in statistics.vendi_score(df, "g").collect()}
    assert set(got) == set(sets)
    for g, m in sets.items():
        u = m / np.linalg.norm(m, axis=1)[:, None]
        w = np.linalg.eigvalsh(u @ u.T / len(m))
        w = w[w > 1e-12]
        assert got[g][0] == len(m) and got[g][1] == pytest.approx(np.exp(-(w * np.log(w)).sum()), rel=1e-6)
    assert got["alike"][1] == pytest.approx(1) and got["two"][1] == pytest.approx(2)
    assert statistics.vendi_score(df.limit(0), "g").count() == 0


def test_ranking_quality_by_a_predicate(spark):
    rows = [("s", 1, 1, "x", "y"), ("s", 1, 2, "x", "x"), ("s", 2, 1, "y", "y"), ("s", 2, 2, "y", "y"), ("s", 3, 1, "x", "y"), ("s", 4, 7, "z", "z"), ("t", 1, 1, "x", None)]
    df = spark.createDataFrame(rows, "setting string, query_id long, rank int, asked string, found string")
    got = {r["setting"]: r for r in statistics.ranking_quality(df, F.col("asked") == F.col("found"), ["setting"]).collect()}
    assert got["s"]["mrr"] == pytest.approx((1 / 2 + 1 + 0 + 1 / 7) / 4) and got["s"]["mrr_at_k"] == pytest.approx(1.5 / 4)
    assert (got["s"]["top_k"], got["s"]["queries"], got["t"]["mrr"], got["t"]["top_k"]) == (2, 4, 0.0, 0)


def test_a_node_of_many_aliases_is_one_hit(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5))
    nodes = spark.createDataFrame([(i, "t", [float(x) for x in r], 1) for i, r in enumerate(v)], "id long, type string, embedding array<double>, created_at long")
    many = [(7, [float(x) for x in v[0] + rng.normal(size=5) * 0.01]) for _ in range(500)] + [(3, [float(x) for x in v[0]]), (99, [1.0] * 5)]
    aliases = spark.createDataFrame(many, "node_id long, embedding array<double>")
    got = retrieval.vector_search(nodes, nodes.where("id = 0").select(F.col("id").alias("query_id"), "embedding"), limit=6, min_score=-1.0, aliases=aliases).collect()
    best = {i: max(float(np.dot(v[0], a) / np.linalg.norm(v[0]) / np.linalg.norm(a)) for a in [v[i], *(np.array(x) for n, x in many if n == i)]) for i in range(40)}
    want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:6]
    assert [r["id"] for r in sorted(got, key=lambda r: (-round(r["score"], 9), r["id"]))] == want and len(got) == 6
    rows = nodes.select("id", "embedding").unionAll(aliases.where("node_id < 40").select(F.col("node_id").alias("id"), "embedding"))
    assert top_k(rows, nodes.select(F.col("id").alias("query_id"), "embedding"), 3, -1.0, repeated=True).groupBy("query_id", "id").count().where("count > 1").isEmpty()
