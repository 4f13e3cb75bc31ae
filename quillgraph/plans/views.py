"""The library's table shapes over the driver's test tables, each with the same view in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import tokens_ceil
from quillgraph.operators.graph import NearEdges
from quillgraph.operators.similarity import similar_pairs
from quillgraph.plans.lineage import cut

#: 1995-01-01, for rows without a time of their own; 2024-01-31, the time that decay queries run at.
EPOCH_MS, AS_OF_MS = 788918400000, 1706659200000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; times without a zone count as UTC, the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _share(column: str, whole: float):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) / whole))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as concepts, customers and suppliers as entities, parts as principles, orders as events or done tasks."""
    made, no_status = F.lit(EPOCH_MS), F.lit(None).cast("string")

    def part(name: str, kind: str, key: str, type_, label: str, weight, created=made, status=no_status) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), type_.alias("type"), F.col(label).alias("name"), weight.alias("weight"), created.alias("created_at"), status.alias("status")
        )

    done = F.col("o_orderstatus") == "F"
    parts = [
        part("region", "region", "r_regionkey", F.lit("concept"), "r_name", F.lit(0.5)),
        part("nation", "nation", "n_nationkey", F.lit("concept"), "n_name", F.lit(0.5)),
        part("customer", "customer", "c_custkey", F.lit("entity"), "c_name", _share("c_acctbal", 10000.0)),
        part("supplier", "supplier", "s_suppkey", F.lit("entity"), "s_name", _share("s_acctbal", 10000.0)),
        part("part", "part", "p_partkey", F.lit("topical-principle"), "p_name", _share("p_retailprice", 2500.0)),
        part("orders", "order", "o_orderkey", F.when(done, "task").otherwise("event"), "o_orderpriority", _share("o_totalprice", 500000.0), F.unix_millis("o_orderdate"), F.when(done, "done")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


NODES_SQL = f"""nodes AS (
    SELECT 'region:' || r_regionkey AS id, 'concept' AS type, r_name AS name, CAST(0.5 AS DOUBLE) AS weight, CAST({EPOCH_MS} AS BIGINT) AS created_at, CAST(NULL AS VARCHAR) AS status FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'concept', n_name, 0.5, {EPOCH_MS}, NULL FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'entity', c_name, greatest(0.0, least(1.0, c_acctbal / 10000)), {EPOCH_MS}, NULL FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'entity', s_name, greatest(0.0, least(1.0, s_acctbal / 10000)), {EPOCH_MS}, NULL FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'topical-principle', p_name, greatest(0.0, least(1.0, p_retailprice / 2500)), {EPOCH_MS}, NULL FROM part
    UNION ALL SELECT 'order:' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'task' ELSE 'event' END, o_orderpriority,
        greatest(0.0, least(1.0, o_totalprice / 500000)), epoch_ms(o_orderdate), CASE WHEN o_orderstatus = 'F' THEN 'done' END FROM orders
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part_of`` up the geography, orders ``involve`` their customer and ``relate to`` their parts."""

    def link(name: str, source: str, s: str, target: str, t: str, type_: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{source}:"), F.col(s)).alias("source"), F.concat(F.lit(f"{target}:"), F.col(t)).alias("target"), F.lit(type_).alias("type"), F.lit(1.0).alias("weight"))

    out = link("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of")
    out = out.unionAll(link("customer", "customer", "c_custkey", "nation", "c_nationkey", "part_of"))
    out = out.unionAll(link("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "part_of"))
    out = out.unionAll(link("orders", "order", "o_orderkey", "customer", "o_custkey", "involves"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("weight"))
    return out.unionAll(
        lines.select(F.concat(F.lit("order:"), "l_orderkey").alias("source"), F.concat(F.lit("part:"), "l_partkey").alias("target"), F.lit("relates_to").alias("type"), "weight")
    )


EDGES_SQL = """edges AS (
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'part_of' AS type, CAST(1.0 AS DOUBLE) AS weight FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'part_of', 1.0 FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'part_of', 1.0 FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'involves', 1.0 FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'relates_to', max(1 - l_discount) FROM lineitem GROUP BY l_orderkey, l_partkey
)"""


def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order supersedes the one before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("prev", F.lag("o_orderkey").over(w)).where("prev is not null")
    return rows.select(F.concat(F.lit("order:"), "o_orderkey").alias("source"), F.concat(F.lit("order:"), "prev").alias("target"), F.lit("supersedes").alias("type"), F.lit(1.0).alias("weight"))


SUPERSEDES_SQL = """supersedes AS (
    SELECT 'order:' || o_orderkey AS source, 'order:' || prev AS target, 'supersedes' AS type, CAST(1.0 AS DOUBLE) AS weight
    FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), "embedding", F.col("vec_id").alias("created_at"))


VECTORS_SQL = "vectors AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS type, CAST(embedding AS DOUBLE[]) AS v, vec_id AS created_at FROM embeddings)"


def vector_edges(spark: SparkSession, sf_dir: str, threshold: float = 0.4) -> DataFrame:
    pairs = similar_pairs(vectors(spark, sf_dir), threshold)
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("relates_to").alias("type"), F.col("score").alias("weight"))


def vector_edges_sql(threshold: float = 0.4) -> str:
    return f"""{VECTORS_SQL}, vector_edges AS (
    SELECT a.id AS source, b.id AS target, 'relates_to' AS type, list_cosine_similarity(a.v, b.v) AS weight
    FROM vectors a JOIN vectors b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= {threshold}
)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is another name of the next id."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("node_id"), "embedding")


def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.substring("text", 1, 60).alias("name"), F.col("text").alias("content"), "source", "embedding",
        (0.5 + (F.col("doc_id") % 50) / 100.0).alias("weight"), F.col("doc_id").alias("created_at"),
    )


TEXT_NODES_SQL = """text_nodes AS (
    SELECT doc_id AS id, lang AS type, substr(text, 1, 60) AS name, text AS content, source, CAST(embedding AS DOUBLE[]) AS v,
           0.5 + (doc_id % 50) / 100.0 AS weight, doc_id AS created_at
    FROM documents JOIN embeddings ON doc_id = vec_id
)"""


def text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs relate; a document precedes the next of its source."""
    near = similar_pairs(text_nodes(spark, sf_dir).select("id", "embedding"), 0.3)
    return near.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("relates_to").alias("type"), F.col("score").alias("weight")).unionAll(text_order(spark, sf_dir))


def near_text_edges(spark: SparkSession, sf_dir: str) -> NearEdges:
    """``text_edges``, whose similar pairs are sought where they are asked for."""
    return NearEdges(cut(text_nodes(spark, sf_dir).select("id", "embedding")), 0.3, cut(text_order(spark, sf_dir)))


def text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document precedes the next of its source."""
    n = text_nodes(spark, sf_dir)
    before = n.withColumn("prev", F.lag("id").over(Window.partitionBy("source").orderBy("id"))).where("prev is not null")
    return before.select(F.col("prev").alias("source"), F.col("id").alias("target"), F.lit("precedes").alias("type"), F.lit(1.0).alias("weight"))


TEXT_EDGES_SQL = """text_edges AS (
    SELECT a.id AS source, b.id AS target, 'relates_to' AS type, list_cosine_similarity(a.v, b.v) AS weight
    FROM text_nodes a JOIN text_nodes b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.3
    UNION ALL SELECT prev, id, 'precedes', 1.0 FROM (SELECT id, lag(id) OVER (PARTITION BY source ORDER BY id) AS prev FROM text_nodes) WHERE prev IS NOT NULL
)"""


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries, with the vector of their number."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")


TEXT_QUERIES_SQL = "text_queries AS (SELECT item_id AS query_id, text AS query, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON item_id = vec_id)"

# Which node type stands for which event type.
EVENT_TYPES = {"error": "problem", "signup": "event", "click": "task", "view": "impression", "purchase": "decision"}


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair)), F.col("event_type"))
    at = F.unix_millis("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), kind.alias("type"), at.alias("created_at"), at.alias("last_accessed"), F.lit(1.0).alias("weight"),
        (F.col("event_id") % 97 == 0).alias("pinned"), F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "done").alias("status"), F.col("user_id"),
    )


_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items())
EVENT_NODES_SQL = f"""event_nodes AS (
    SELECT event_id AS id, CASE event_type {_KINDS} END AS type, (epoch_us(ts) // 1000) AS created_at, (epoch_us(ts) // 1000) AS last_accessed, CAST(1.0 AS DOUBLE) AS weight,
           event_id % 97 = 0 AS pinned, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'done' END AS status, user_id, ts, event_type
    FROM events
)"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event points to the one before; it supersedes it if the type is the same."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumns({"prev": F.lag("event_id").over(w), "before": F.lag("event_type").over(w)}).where("prev is not null")
    return rows.select(F.col("event_id").alias("source"), F.col("prev").alias("target"), F.when(F.col("event_type") == F.col("before"), "supersedes").otherwise("precedes").alias("type"), F.lit(1.0).alias("weight"))


EVENT_EDGES_SQL = """event_edges AS (
    SELECT event_id AS source, prev AS target, CASE WHEN event_type = before THEN 'supersedes' ELSE 'precedes' END AS type, CAST(1.0 AS DOUBLE) AS weight
    FROM (SELECT event_id, event_type, lag(event_id) OVER w AS prev, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE prev IS NOT NULL
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"), tokens_ceil(F.col("text")).alias("tokens"))


MESSAGES_SQL = """messages AS (
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS idx, role, text AS content, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) + 10 AS tokens FROM conversations
)"""

STRATEGIES, RETAINED, THRESHOLDS, REPS = ["s3", "s5", "s9", "s9-v3"], [10000, 20000, 30000], [65000, 80000, 100000], 3


def run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a session of the experiment."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up results: events dealt to strategies and models, their value as the score."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return e.select(
        "event_id", "user_id", pick(STRATEGIES, F.col("event_id")).alias("strategy"), pick(["sonnet", "haiku", "gemini-flash", "unknown"], F.col("user_id")).alias("model"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("judge_score"), (F.col("user_id") % 7 + 1.0).alias("human_score"),
        (F.length("props") + 100).cast("long").alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"),
    )


RUNS_SQL = """runs AS (
    SELECT event_id, user_id, (['s3', 's5', 's9', 's9-v3'])[event_id % 4 + 1] AS strategy, (['sonnet', 'haiku', 'gemini-flash', 'unknown'])[user_id % 4 + 1] AS model,
           CASE WHEN event_type <> 'error' THEN value END AS judge_score, CAST(user_id % 7 + 1.0 AS DOUBLE) AS human_score,
           length(props) + 100 AS tokens_in, event_id % 50 AS tokens_out
    FROM events
)"""
