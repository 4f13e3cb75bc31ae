"""Keyword search by prefix: sums of documents and queries are made where a document's words are."""

import re

from quillgraph.operators import retrieval


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    nodes = spark.createDataFrame([(i, f"name {i % 7}", " ".join(f"word{(i * k) % 31}" for k in range(1, 12))) for i in range(200)], "id long, name string, content string")
    queries = spark.createDataFrame([(q, f"word{q} wor name") for q in range(20)], "query_id long, query string")
    out = retrieval.keyword_search(nodes, queries, limit=3, prefix=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\w+, id#", plan), plan
    rows = out.collect()
    assert len(rows) == 60 and len({(r.query_id, r.id) for r in rows}) == 60
