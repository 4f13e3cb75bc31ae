"""Files around a store, and the end-to-end search."""

from pyspark.sql import functions as F

from quillgraph.operators import fold, retrieval
from quillgraph.sources import files, models, sessions


def test_details_and_reports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    folder = str(tmp_path / "details")
    assert {r["has_detail"] for r in files.with_detail_flag(nodes, folder).collect()} == {False}
    files.write_details(spark.createDataFrame([("a", "long text"), ("b", None)], "id string, detail string"), folder)
    assert {r["id"]: r["has_detail"] for r in files.with_detail_flag(nodes, folder).collect()} == {"a": True, "b": False}
    assert files.read_details(spark, folder, nodes).first()["detail"] == "long text"
    (tmp_path / "staged.jsonl").write_text('{"id": "x", "reviewed": true}\n{"id": "y"}\n')
    assert files.unreviewed(spark, str(tmp_path / "staged.jsonl")).first().asDict() == {"unreviewed": 1, "staged": 2}
    assert files.workspace_stats(spark, str(tmp_path / "staged.jsonl")).first()["extension"] == "jsonl"
    files.write_report(spark.createDataFrame([("# T\nx",)], "text string"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 2
    files.write_batch_summary(spark.createDataFrame([("r1", 0.5), ("r2", 0.25)], "run_id string, cost_usd double"), str(tmp_path), "2024")
    assert spark.read.json(str(tmp_path / "batch-summary-2024")).first()["total_cost"] == 0.75


def test_search_finds_demotes_and_filters(spark):
    rows = [("a", "concept", "green tea ceremony", 1), ("b", "concept", "green tea ceremony notes", 1), ("c", "lesson", "engine repair", 1)]
    nodes = models.embed(spark.createDataFrame([(i, t, n, n, 1.0, at) for i, t, n, at in rows], "id string, type string, name string, content string, weight double, created_at long"), "name")
    edges = spark.createDataFrame([("b", "a", "supersedes", 1.0)], "source string, target string, type string, weight double")
    queries = spark.createDataFrame([(1, "the green tea ceremony"), (2, "engine repair")], "query_id long, query string")
    got = retrieval.search(nodes, edges, queries, lambda df: models.embed(df, "query")).collect()
    assert {r["id"] for r in got if r["query_id"] == 2 and r["rank"] == 1} == {"c"}
    assert {r["id"] for r in got if r["query_id"] == 1} == {"a", "b"}
    assert all(r["score"] <= 0.1 for r in got if r["id"] == "a")
    assert all(r["superseded"] == (r["id"] == "a") for r in got)
    only = retrieval.search(nodes, edges, queries, lambda df: models.embed(df, "query"), types=["lesson"]).collect()
    assert {r["id"] for r in only} == {"c"}


def test_serialize_and_evaluate(spark):
    raw = '[{"type":"text","text":"hi"},{"type":"toolCall","name":"run","arguments":{"k":1}},{"type":"toolResult","content":"out"},{"type":"thinking","thinking":"x"}]'
    row = spark.createDataFrame([(raw,)], "raw string").select(sessions.serialize(F.from_json("raw", f"array<{sessions.BLOCK}>")).alias("x")).first()
    assert row["x"] == 'hi\n[tool: run] {"k":1}\n[result] out'
    s = fold.evaluate([{"role": "user", "content": "about bridges everywhere"}], "bridges please", "bridges everywhere")
    assert s["retention"] == 1.0 and 0 <= s["relevance"] <= 1 and 1 <= s["normalised"] <= 5
