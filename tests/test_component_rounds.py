"""Rounds of components are tables: many shuffle partitions don't make many parts, and settled edges take no round."""

from quillgraph.operators import components


def test_parts_follow_the_size_and_not_the_shuffle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 10], "a long, b long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.connected_components(chain, "a", "b")
        parts = got.where("node <> component").rdd.getNumPartitions()
        found = {r["node"]: r["component"] for r in got.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {i: max(1, (i - 1) // 10 * 10 + 1) for i in range(1, 301)}
    assert parts < 97


def test_settled_edges_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_round", None)
    stars = spark.createDataFrame([(1, 2), (3, 1), (7, 8), (8, 7), (9, 9), (None, 4)], "a long, b long")
    got = {(r["node"], r["component"]) for r in components.connected_components(stars, "a", "b").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
