"""Text functions, sources and folding on small fixtures."""

import json

import numpy as np
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.porter import stem
from quillgraph.functions.vector import cosine, top_k
from quillgraph.operators import fold, transcript
from quillgraph.operators.similarity import similar_pairs
from quillgraph.sources import markdown, models, sessions


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_strings(spark):
    assert one(spark, T.slugify(F.col("t")), t="--Hello, World! " + "x" * 80) == "hello-world-" + "x" * 48
    assert one(spark, T.normalise_name(F.col("t")), t="  It's   A-Test ") == "its atest"
    assert one(spark, T.first_sentence(F.col("t")), t="One. Two.") == "One."
    assert one(spark, T.first_sentence(F.col("t")), t="x" * 200) == "x" * 149 + "…"
    assert one(spark, T.truncate_at_word(F.col("t")), t="word " * 40) == ("word " * 30).strip() + "…"
    assert one(spark, T.js_round(F.col("t").cast("double")), t="-2.5") == -2
    assert one(spark, T.parse_edge_spec(F.col("t")), t="n:led_to:a:b").asDict() == {"target": "n", "type": "led_to", "context": "a:b"}
    assert one(spark, T.phrasings(F.col("t")), t="What is the best graph database engine") == ["What is the best graph database engine", "best graph database engine", "engine database graph best"]
    assert one(spark, T.run_id(F.col("t"), F.lit("s9"), F.lit("10"), F.lit("65"), F.lit(None), F.lit("1")), t="abcdefghij") == "abcdefgh-s9-R10-T65-r1"
    assert T.parse_time("2d", 10 * 86400000) == 8 * 86400000 and T.parse_time(None, 1) is None


def test_extract_json(spark):
    for raw, want in (('```json\n{"a": 1}\n```', 1), ('text {"a": 2} more', 2), ("none", None), ('{"a": ', None)):
        assert one(spark, F.try_variant_get(T.extract_json(F.col("t")), "$.a", "int"), t=raw) == want
        found = fold.extract_json(raw)
        assert (found["a"] if found else None) == want


def test_porter():
    want = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "happy": "happi", "sky": "sky", "adjustment": "adjust", "controlling": "control", "rate": "rate", "agreed": "agre"}
    assert {w: stem(w) for w in want} == want


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(r["x"] == r["want"] for r in df.select("want", cosine(F.col("a"), F.col("b")).alias("x")).collect())


def test_blocked_search_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "id long, embedding array<float>")
    u = v.astype("f4").astype("f8")
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    got = {(r["a"], r["b"]) for r in similar_pairs(df, 0.6, block_rows=16).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.6}
    hits = top_k(df, df.where("id < 5").select(F.col("id").alias("query_id"), "embedding"), 7, -1.0).collect()
    for q in range(5):
        assert {r["id"] for r in hits if r["query_id"] == q} == set(np.argsort(-s[q])[:7].tolist())


def test_session_lines(spark, tmp_path):
    lines = [
        json.dumps({"type": "session", "id": "x"}), "", "{broken",
        json.dumps({"type": "message", "timestamp": "t1", "message": {"role": "user", "content": "hello world!"}}),
        json.dumps({"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "12345678"}, {"type": "toolCall", "name": "run", "arguments": {"k": 1}}]}}),
        json.dumps({"type": "message", "message": {"role": "toolResult", "toolName": "run", "content": []}}),
        json.dumps({"type": "compaction"}),
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(lines))
    got = sessions.read(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["idx"], r["role"], r["content"], r["tool_name"]) for r in got] == [(0, "user", "hello world!", None), (1, "assistant", "a", "run"), (2, "toolResult", "", "run")]
    assert [r["tokens"] for r in got] == [13, 1 + 2 + 2 + 10, 10]
    assert got[0]["session_id"] == "s1" and got[0]["ts"] == "t1"
    (tmp_path / "corpus.json").write_text(json.dumps({"sessions": [{"id": "a", "type": "mixed", "notes": ""}]}))
    assert sessions.read_corpus(spark, str(tmp_path / "corpus.json")).first()["type"] == "mixed"


def test_markdown(spark, tmp_path):
    (tmp_path / "lessons.md").write_text("intro\n## Tools\n- **Check first.** Then run it (notes)\n- plain\n")
    row = markdown.lessons(spark, str(tmp_path / "lessons.md")).collect()
    assert len(row) == 1 and row[0]["name"] == "Check first" and row[0]["content"] == "Then run it" and row[0]["source"] == "notes"
    (tmp_path / "tasks.md").write_text("## One\n- [x] ~~done~~\n- [ ] open\n## Two\n- [x] all\n")
    assert {r["name"]: (r["status"], r["content"]) for r in markdown.tasks(spark, str(tmp_path / "tasks.md")).collect()} == {"One": ("active", "done; open"), "Two": ("done", "all")}
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "2024-01-30.md").write_text("# day\n- short\n- a longer entry here\n")
    (logs / "2023-01-01.md").write_text("- too old an entry\n")
    got = markdown.daily_logs(spark, str(logs), "2024-01-31").collect()
    assert [r["id"] for r in got] == ["event-2024-01-30-01"]
    rows, errors = markdown.import_all(spark, {"good": lambda: markdown.lessons(spark, str(tmp_path / "lessons.md")), "bad": lambda: markdown.lessons(spark, str(tmp_path / "none.md"))})
    assert rows.count() == 1 and errors.first()["source"] == "bad"


def test_embeddings_and_blobs(spark):
    df = models.embed(spark.createDataFrame([("a b",), (None,), ("a b",)], "text string"), "text").collect()
    assert df[0]["embedding"] == df[2]["embedding"] and df[1]["embedding"] is None
    v = spark.createDataFrame([(1, [0.5, -2.0]), (2, None)], "id int, embedding array<float>")
    back = models.unpack_float32(models.pack_float32(v).select("id", "blob"), "blob").orderBy("id").collect()
    assert back[0]["embedding"] == [0.5, -2.0] and back[1]["embedding"] is None


def messages(spark, rows):
    return spark.createDataFrame([("s", i, r, c, t) for i, (r, c, t) in enumerate(rows)], fold.MESSAGE_SCHEMA)


def test_windows_on_edges(spark):
    m = messages(spark, [("user", "a", 5), ("assistant", "b", 500), ("user", "c", 5)])
    assert transcript.tail_budget(m, 4).count() == 0
    assert [r["idx"] for r in transcript.tail_budget(m, 505).orderBy("idx").collect()] == [1, 2]
    assert transcript.snapshots(m, [0.1, 0.2], 1000).count() == 2
    assert transcript.exchange_boundary(m, 9).first()["keep_from"] == 0


def test_strategies_and_replay(spark):
    rows = [("user" if i % 2 == 0 else "assistant", f"Message number {i}. It goes on.", 20) for i in range(12)]
    m = messages(spark, rows)
    for name in fold.STRATEGIES:
        out = fold.fold_sessions(m, name, keep_recent=1).orderBy("idx").collect()
        assert out[0]["role"] == "compactionSummary" and out[-1]["content"] == rows[-1][1]
        assert [r["idx"] for r in out] == list(range(len(out)))
    assert fold.fold_sessions(m.limit(3), "s5", keep_recent=1).count() == 3
    noop = fold.fold_sessions(m, "s9", model="dry-run", keep_recent=1)
    assert noop.count() == 12 and '"parse-error"' in noop.first()["plan"]
    points = fold.replay(m, 100, "s5", keep_recent=1).orderBy("turn").collect()
    held, want = [], []
    for turn, (role, content, tokens) in enumerate(rows):
        held.append({"role": role, "content": content, "tokens": tokens})
        before = sum(x["tokens"] for x in held)
        if before >= 100:
            held, _ = fold.unified(held, fold.extractive_model, keep_recent=1)
            want.append((turn, before, sum(x["tokens"] for x in held)))
    assert [(p["turn"], p["before"], p["after"]) for p in points] == want
