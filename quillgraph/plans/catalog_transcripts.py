"""Transcript, text and folding queries over the test tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import fold
from quillgraph.operators import transcript as X
from quillgraph.plans import views as V
from quillgraph.sources import mentions, sessions

R = lambda c, n=6: F.round(c, n)
M = f"WITH {V.MESSAGES_SQL}"


def token_estimate(s, d):
    t = V.table(s, d, "conversations")
    return t.select("conv_id", "turn", T.tokens_ceil(F.col("text")).alias("with_cost"), T.tokens_round(F.col("text")).alias("text_only"))


def session_totals(s, d):
    return X.totals(V.messages(s, d))


def snapshots(s, d):
    return X.snapshots(V.messages(s, d), [0.3, 0.5, 0.8], 1000)


def threshold_cut(s, d):
    return X.threshold_cut(V.messages(s, d), 500).select("session_id", "idx", "tokens")


def tail_budget(s, d):
    return X.tail_budget(V.messages(s, d), 200).select("session_id", "idx", "tokens")


def exchange_boundary(s, d):
    return X.exchange_boundary(V.messages(s, d), 2)


def exchange_capped(s, d):
    return X.exchange_boundary_capped(V.messages(s, d), 2, 300)


def next_user_assistant(s, d):
    return X.next_user_assistant(V.messages(s, d))


def tool_pair_collapse(s, d):
    """Every second assistant turn stands for a call and every user turn after it for its result."""
    m = V.messages(s, d).withColumn("tool_name", F.when((F.col("role") == "assistant") & (F.col("idx") % 4 == 1), "tool"))
    m = m.withColumn("role", F.when((F.col("role") == "user") & (F.col("idx") % 4 == 2), "toolResult").otherwise(F.col("role")))
    return X.collapse_tool_pairs(m).select("session_id", "idx", "role", F.md5("content").alias("content"))


def joined_text(s, d):
    return X.joined_text(V.messages(s, d)).select("session_id", F.md5("text").alias("text"))


def range_expansion(s, d):
    m = V.messages(s, d)
    ends = X.exchange_boundary(m, 2).select("session_id", F.lit("tail").alias("label"), F.col("keep_from").alias("start"), (F.col("keep_from") + 2).alias("end"))
    return X.expand_ranges(ends, m).select("session_id", "label", "idx")


def compression_ratio(s, d):
    m = V.messages(s, d)
    return X.compression(m, X.tail_budget(m, 300)).select("session_id", "before", "after", R("ratio").alias("ratio"))


def slugify(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", T.slugify(F.col("text")).alias("slug"), T.slugify(F.col("text"), 40, trim=False).alias("raw_slug"))


def normalise_name(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", T.normalise_name(F.col("text")).alias("name"))


def first_sentence(s, d):
    return V.table(s, d, "conversations").select("conv_id", "turn", T.first_sentence(F.col("text")).alias("sentence"))


def truncate_at_word(s, d):
    return V.table(s, d, "documents").select("doc_id", F.md5(T.truncate_at_word(F.col("text"))).alias("cut"))


def previews(s, d):
    c = F.col("text")
    tool = F.col("doc_id") % 2 == 0
    return V.table(s, d, "documents").select("doc_id", F.md5(T.preview_short(c)).alias("short"), F.md5(T.preview_head_tail(c, tool)).alias("head_tail"), F.md5(T.preview_truncated(c)).alias("truncated"))


def extract_json(s, d):
    reply = F.concat(F.when(F.col("event_id") % 3 == 0, "```json\n").when(F.col("event_id") % 3 == 1, "Here: ").otherwise(""), "props", F.when(F.col("event_id") % 3 == 0, "\n```").otherwise(""))
    e = V.table(s, d, "events").withColumn("reply", F.when(F.col("event_id") % 10 == 9, "no json {").otherwise(reply))
    return e.select("event_id", F.try_variant_get(T.extract_json(F.col("reply")), "$.k", "int").alias("k"), (T.brace_match(F.col("reply")) != "").alias("braces"))


def parse_edge_spec(s, d):
    e = V.table(s, d, "orders").withColumn("spec", F.concat_ws(":", F.concat(F.lit("o"), "o_orderkey"), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit(":x")))))
    p = T.parse_edge_spec(F.col("spec"))
    return e.select("o_orderkey", p["target"].alias("target"), p["type"].alias("type"), p["context"].alias("context"))


def event_ids(s, d):
    at = F.unix_millis("ts")
    return V.table(s, d, "events").select("event_id", T.event_id(T.iso_date(at), at).alias("name"), R(T.hours_since(F.lit(V.AS_OF_MS), F.lit(None).cast("long"), at), 10).alias("hours"))


def content_words(s, d):
    return V.table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.content_words(F.col("text"))), " ").alias("words"))


def name_mentions(s, d):
    names = s.createDataFrame([(1, "the"), (2, "que"), (3, "und die"), (4, "ea")], "name_id long, name string")
    return mentions.mentions(V.table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("content")), names)


def _dictionary(s, d):
    """The benchmark's words of eight letters or more; a word's id is its first five letters, so ids have several names."""
    words = V.table(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).where("length(name) >= 8").distinct()
    return words.select(F.substring("name", 1, 5).alias("name_id"), "name")


def dictionary_mentions(s, d):
    """Words of the benchmark in whole documents, at any place in other words."""
    return mentions.mentions(V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), _dictionary(s, d))


def mention_edges(s, d):
    """How many texts each name of the benchmark's dictionary is in, over the edges that mentions make."""
    found = mentions.mentions(V.table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("content")), _dictionary(s, d))
    return mentions.mention_edges(found).groupBy("target", "type", "context").agg(F.count("*").alias("n"), F.min("source").alias("first"))


def session_entries(s, d):
    """Conversations written as session lines and read back: text blocks, tool calls, blank and broken lines."""
    c = V.table(s, d, "conversations")
    block = F.concat(F.lit('[{"type":"text","text":'), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit('},{"type":"toolCall","name":"t","arguments":{"a":1}}]'))
    text = F.when(F.col("turn") % 2 == 1, block).otherwise(F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))
    line = F.concat(F.lit('{"type":"message","message":{"role":"'), "role", F.lit('","content":'), text, F.lit("}}"))
    line = F.when(F.col("turn") == 4, "{broken").otherwise(line)
    rows = c.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") * 2).alias("line_no"), line.alias("line"))
    blank = c.select(F.col("conv_id").cast("string"), F.col("turn") * 2 + 1, F.lit(" "))
    return sessions.parse(rows.unionAll(blank)).select("session_id", "idx", "role", F.md5("content").alias("content"), "tool_name", "tokens")


def fold_topics(s, d):
    return fold.fold_sessions(V.messages(s, d), "s3")


def fold_unified(s, d):
    return fold.fold_sessions(V.messages(s, d), "s5", keep_recent=1)


def fold_constrained(s, d):
    return fold.fold_sessions(V.messages(s, d), "s9", keep_recent=1)


def fold_bounded(s, d):
    return fold.fold_sessions(V.messages(s, d), "s9-v3", keep_recent=1, previous="earlier work")


def replay_fold(s, d):
    return fold.replay(V.messages(s, d), 600, "s5", keep_recent=1)


def fold_evaluation(s, d):
    return fold.evaluate_folds(V.messages(s, d), 300, "s5", keep_recent=1)


def replay_bounded(s, d):
    """Topic summaries of bounded size, each fold told the summary of the one before."""
    return fold.replay(V.messages(s, d), 400, "s9-v3", keep_recent=1, carry=True)


def replay_points(s, d):
    return fold.replay_summary(replay_fold(s, d))


def replay_summary(s, d):
    """The roll-up of fold points, here events as points of their user's session."""
    points = V.table(s, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("turn"), (F.length("props") * 100).cast("long").alias("before"), (F.col("event_id") % 90).alias("after"),
        (F.length("props") * 10).cast("long").alias("tokens_in"), (F.col("event_id") % 7).alias("tokens_out"),
    )
    return fold.replay_summary(points).select("session_id", "folds", R("mean_compression").alias("mean_compression"), "steady_tokens", R("cost_usd", 9).alias("cost_usd"))


def serialised_blocks(s, d):
    """Turns as blocks of text, a call and its result, told in one text."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    raw = F.concat(F.lit('[{"type":"text","text":'), quoted("text"), F.lit('},{"type":"toolCall","name":"n"},{"type":"toolResult","content":'), quoted("text"), F.lit('},{"type":"thinking","thinking":"x"}]'))
    return V.table(s, d, "conversations").select("conv_id", "turn", F.md5(sessions.serialize(F.from_json(raw, f"array<{sessions.BLOCK}>"))).alias("shown"))


_SNAP = "r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY idx) AS upto FROM messages)"
_BACK = "b AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY idx DESC) AS back, count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY idx DESC) AS u FROM messages)"
_MD5_CUT = "substr(text, 1, 150)"
DICTIONARY_SQL = """words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS name FROM benchmark),
    names AS MATERIALIZED (SELECT substr(name, 1, 5) AS name_id, name FROM words WHERE length(name) >= 8)"""

QUERIES = {
    "token_estimate": (token_estimate, "SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) + 10 AS with_cost, CAST(floor(length(coalesce(text, '')) / 4.0 + 0.5) AS BIGINT) AS text_only FROM conversations"),
    "session_totals": (session_totals, f"{M} SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM messages GROUP BY session_id"),
    "snapshots": (snapshots, f"{M}, {_SNAP} SELECT session_id, CAST(share AS DOUBLE) AS share, min(idx) AS idx, CAST(min(upto) AS BIGINT) AS tokens FROM r, (SELECT unnest([0.3, 0.5, 0.8]) AS share) WHERE upto >= share * 1000 GROUP BY session_id, share"),
    "threshold_cut": (threshold_cut, f"{M}, {_SNAP} SELECT session_id, idx, tokens FROM r WHERE upto < 500"),
    "tail_budget": (tail_budget, f"{M}, {_BACK} SELECT session_id, idx, tokens FROM b WHERE back <= 200"),
    "exchange_boundary": (exchange_boundary, f"{M}, {_BACK} SELECT session_id, coalesce(max(idx) FILTER (role = 'user' AND u = 2), 0) AS keep_from FROM b GROUP BY session_id"),
    "exchange_capped": (exchange_capped, f"{M}, {_BACK} SELECT session_id, greatest(coalesce(max(idx) FILTER (role = 'user' AND u = 2), 0), coalesce(max(idx) FILTER (back > 300) + 1, 0)) AS keep_from FROM b GROUP BY session_id"),
    "next_user_assistant": (next_user_assistant, f"""{M}, u AS (SELECT a.session_id, a.idx, min(b.idx) AS user_idx FROM messages a LEFT JOIN messages b ON a.session_id = b.session_id AND b.idx > a.idx AND b.role = 'user' GROUP BY 1, 2)
        SELECT u.session_id, u.idx, user_idx, min(b.idx) AS assistant_idx FROM u LEFT JOIN messages b ON u.session_id = b.session_id AND b.idx > user_idx AND b.role = 'assistant' GROUP BY 1, 2, 3"""),
    "tool_pair_collapse": (tool_pair_collapse, f"""{M}, m AS (SELECT session_id, idx, CASE WHEN role = 'user' AND idx % 4 = 2 THEN 'toolResult' ELSE role END AS role, role = 'assistant' AND idx % 4 = 1 AS call, content FROM messages),
        l AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc, lag(call) OVER w AS pc FROM m WINDOW w AS (PARTITION BY session_id ORDER BY idx))
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS idx, role, md5(CASE WHEN call AND nr = 'toolResult' THEN content || chr(10) || '[result] ' || substr(nc, 1, 500) ELSE content END) AS content
        FROM l WHERE NOT (role = 'toolResult' AND coalesce(pc, false))"""),
    "joined_text": (joined_text, f"{M} SELECT session_id, md5(string_agg('[' || role || ']: ' || content, chr(10) || chr(10) ORDER BY idx)) AS text FROM messages GROUP BY session_id"),
    "range_expansion": (range_expansion, f"{M}, {_BACK}, k AS (SELECT session_id, coalesce(max(idx) FILTER (role = 'user' AND u = 2), 0) AS f FROM b GROUP BY session_id) SELECT m.session_id, 'tail' AS label, idx FROM messages m JOIN k ON m.session_id = k.session_id WHERE idx BETWEEN f AND f + 2"),
    "compression_ratio": (compression_ratio, f"""{M}, {_BACK}, a AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS after FROM b WHERE back <= 300 GROUP BY session_id)
        SELECT m.session_id, CAST(sum(tokens) AS BIGINT) AS before, after, round(sum(tokens) / greatest(after, 1), 6) AS ratio FROM messages m JOIN a ON m.session_id = a.session_id GROUP BY m.session_id, after"""),
    "slugify": (slugify, """WITH s AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g') AS s FROM conversations)
        SELECT conv_id, turn, substr(regexp_replace(s, '^-|-$', '', 'g'), 1, 60) AS slug, substr(s, 1, 40) AS raw_slug FROM s"""),
    "normalise_name": (normalise_name, "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS name FROM conversations"),
    "first_sentence": (first_sentence, """WITH f AS (SELECT conv_id, turn, text, trim(regexp_extract(text, '^[^\\n]*?[.!?](\\s|$)'), ' ') AS s FROM conversations)
        SELECT conv_id, turn, CASE WHEN rtrim(s, chr(10) || ' ') <> '' THEN s WHEN length(text) <= 150 THEN text ELSE substr(text, 1, 149) || '…' END AS sentence FROM f"""),
    "truncate_at_word": (truncate_at_word, "SELECT doc_id, md5(CASE WHEN length(text) > 150 THEN regexp_replace(substr(text, 1, 150), '\\s+\\S*$', '') || '…' ELSE text END) AS cut FROM documents"),
    "previews": (previews, """SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 150) || '...' ELSE text END) AS short,
        md5(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(text) > 2000 THEN substr(text, 1, 1400) || chr(10) || '...[' || length(text) || ' chars]...' || chr(10) || right(text, 400) ELSE text END
            ELSE CASE WHEN length(text) > 300 THEN substr(text, 1, 210) || chr(10) || '...[' || length(text) || ' chars]...' || chr(10) || right(text, 60) ELSE text END END) AS head_tail,
        md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 1500) || '...[truncated]' ELSE text END) AS truncated FROM documents"""),
    "extract_json": (extract_json, "SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN CAST(json_extract(props, '$.k') AS INT) END AS k, event_id % 10 <> 9 AS braces FROM events"),
    "parse_edge_spec": (parse_edge_spec, "SELECT o_orderkey, 'o' || o_orderkey AS target, o_orderstatus AS type, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ':x' ELSE '' END AS context FROM orders"),
    "event_ids": (event_ids, f"SELECT event_id, 'event-' || strftime(ts, '%Y-%m-%d') || '-' || right(CAST(epoch_us(ts) // 1000 AS VARCHAR), 4) AS name, round(({V.AS_OF_MS} - epoch_us(ts) // 1000) / 3600000.0, 10) AS hours FROM events"),
    "content_words": (content_words, "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 4))), ' ') AS words FROM benchmark"),
    "name_mentions": (name_mentions, """WITH n AS (SELECT * FROM (VALUES (1, 'the'), (2, 'que'), (3, 'und die'), (4, 'ea')) v(name_id, name))
        SELECT conv_id || ':' || turn AS id, CAST(name_id AS BIGINT) AS name_id FROM conversations, n WHERE contains(lower(text), name)"""),
    "dictionary_mentions": (dictionary_mentions, f"""WITH {DICTIONARY_SQL} SELECT DISTINCT doc_id AS id, name_id FROM documents, names WHERE contains(lower(text), name)"""),
    "mention_edges": (mention_edges, f"""WITH {DICTIONARY_SQL}, found AS (SELECT DISTINCT conv_id || ':' || turn AS id, name_id FROM conversations, names WHERE contains(lower(text), name))
        SELECT name_id AS target, 'derived_from' AS type, 'Lesson derived from ' || name_id AS context, count(*) AS n, min(id) AS first FROM found GROUP BY name_id"""),
    "session_entries": (session_entries, """WITH m AS (SELECT * FROM conversations WHERE turn <> 4) SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, md5(text) AS content,
        CASE WHEN turn % 2 = 1 THEN 't' END AS tool_name, CAST(ceil(length(text) / 4.0) AS BIGINT) + CASE WHEN turn % 2 = 1 THEN 2 ELSE 0 END + 10 AS tokens FROM m"""),
    "fold_topics": (fold_topics, None),
    "fold_unified": (fold_unified, None),
    "fold_constrained": (fold_constrained, None),
    "fold_bounded": (fold_bounded, None),
    "replay_fold": (replay_fold, None),
    "replay_bounded": (replay_bounded, None),
    "replay_points": (replay_points, None),
    "replay_summary": (replay_summary, """SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS folds, round(avg(length(props) * 100 / greatest(event_id % 90, 1)), 6) AS mean_compression, arg_max(event_id % 90, event_id) AS steady_tokens,
        round(sum(length(props) * 10 * 0.00001 + event_id % 7 * 0.00003), 9) AS cost_usd FROM events GROUP BY user_id"""),
    "serialised_blocks": (serialised_blocks, """SELECT conv_id, turn, md5(text || chr(10) || '[tool: n] {}' || chr(10) || '[result] ' || substr(text, 1, 300)) AS shown FROM conversations"""),
    "fold_evaluation": (fold_evaluation, None),
}
