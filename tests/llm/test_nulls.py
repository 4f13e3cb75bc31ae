"""Rows with nothing in them, and rows that repeat, through every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fingerprints, hamming, mixing, neardup, packing, passages, pii, sharding, simhash, toxicity, urls

ROWS = [(None, None, None), (None, "some words here", "a"), (1, None, None), (1, None, None), (2, "some words here", None), (2, "some words here", None), (3, "", "")]
MODEL = toxicity.Crf({"w:vile": 3.0}, -1.0, __import__("numpy").zeros((2, 2)), __import__("numpy").zeros(2))
ALL = {
    "shard": lambda d: sharding.shard(d, 10), "mix": mixing.mix, "pack": packing.pack, "next": fingerprints.compare_with_next, "groups": fingerprints.groups,
    "pii": pii.scan, "tox": lambda d: toxicity.judge(d, MODEL), "simhash": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_every_row_comes_out(make, name):
    got = ALL[name](make(ROWS, extra=True)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in ROWS)


def test_operators_that_leave_out_rows_without_a_key(make):
    docs = make(ROWS, extra=True)
    assert Counter(r["doc_id"] for r in passages.shared_passages(docs).collect()) == Counter([1, 2, 3])
    assert Counter(r["doc_id"] for r in neardup.near_duplicates(docs).collect()) == Counter([1, 1, 2, 2, 3])


def test_vectors_and_urls(spark):
    v = spark.createDataFrame([(None, [1.0, -1.0]), (50, None), (100, [None, 1.0]), (100, [None, 1.0]), (7, [])], "vec_id long, embedding array<float>")
    got = hamming.search(v, F.col("vec_id") % 50 == 0, 2).collect()
    assert {r["query_id"] for r in got} == {100} and all(r["distance"] == 0 for r in got)
    u = spark.createDataFrame([(None, None), (1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string")
    assert urls.judge(u, [("org/", "allow")]).count() == 3
