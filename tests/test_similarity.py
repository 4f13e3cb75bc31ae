"""Metric partitioning against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import similarity as S


def clustered(seed, n=700, size=24, clusters=25, spread=0.06):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    share = np.minimum(rng.zipf(1.5, n) - 1, clusters - 1)  # one cluster holds over a third
    return centres[share] * rng.uniform(0.5, 2, (n, 1)) + rng.normal(size=(n, size)) * spread * rng.uniform(0.2, 1, (n, 1))


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")


def brute(a, b, threshold):
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    return a @ b.T >= threshold


@pytest.mark.parametrize("threshold", [0.92, 0.6, 0.2])
def test_pairs_are_those_of_brute_force(spark, threshold):
    v = clustered(1)
    near = brute(v, v, threshold)
    got = S.similar_pairs(frame(spark, v), threshold, block_rows=32).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if near[i, j]}


def test_even_vectors_and_one_block(spark):
    v = np.random.default_rng(2).normal(size=(300, 16))
    near = brute(v, v, 0.5)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j]}
    for rows in (32, 2048):
        assert {(r["a"], r["b"]) for r in S.similar_pairs(frame(spark, v), 0.5, block_rows=rows).collect()} == want


def test_most_pairs_are_ruled_out(spark):
    v = clustered(3, n=1200, clusters=60, spread=0.03)
    cost = S.pair_costs(frame(spark, v), 0.92, block_rows=100).first()
    near = int(np.triu(brute(v, v, 0.92), 1).sum())
    assert cost["nodes"] == 1200 and cost["all_pairs"] == 1200 * 1199 // 2
    assert near <= cost["compared"] < 2.5 * near + 0.15 * cost["all_pairs"]
    assert cost["pairs"] < 0.8 * cost["all_pairs"]  # what meets in tasks at all, both orders counted


def test_two_sides(spark):
    v = clustered(4, 400)
    new, known = v[:150], v[100:]
    near = brute(new, known, 0.9)
    got = S.similar_between(frame(spark, new), frame(spark, known, 100), 0.9, block_rows=24).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted((i, 100 + j) for i in range(150) for j in range(300) if near[i, j])
    assert all(abs(r["score"] - 1) < 1e-9 for r in got if r["a"] == r["b"])


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [0.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for block in (1, 100):
        assert {(r["a"], r["b"]) for r in S.similar_pairs(df, 0.9, block_rows=block).collect()} == {(1, 2), (3, 4)}
    assert S.similar_pairs(df.limit(0), 0.9).count() == 0 and S.similar_between(df.limit(0), df, 0.9).count() == 0
    assert S.pair_costs(df.limit(0), 0.9).first()["compared"] == 0


def test_all_alike_stay_in_blocks(spark):
    df = spark.range(90).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert S.similar_pairs(df, 0.99, block_rows=9).count() == 90 * 89 // 2


def test_farthest_first_takes_equal_rows_once():
    unit = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    assert len(S.farthest_first(unit, 10)) == 3
