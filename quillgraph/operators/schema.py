"""Node and edge tables: fixed value sets, defaults and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import truncate_at_word

# The type system.
NODE_TYPES = (
    "entity concept event lesson task decision preference behavioral-principle topical-principle problem impression held-contradiction"
).split()
EDGE_TYPES = (
    "relates_to derived_from contradicts supersedes led_to involves part_of extends requires enables precedes exemplifies inspired_by "
    "critiques resonates_with tension_with persists_against supports resolved_from"
).split()
TRUST_LEVELS = "direct derived external unverified".split()

NODE_COLUMNS = {
    "id": "string", "type": "string", "name": "string", "content": "string", "source": "string", "trust": "string",
    "created_at": "long", "updated_at": "long", "last_accessed": "long", "access_count": "long", "weight": "double",
    "pinned": "boolean", "tags": "array<string>", "status": "string", "schedule": "string", "embedding": "array<float>",
    "helpful_count": "long", "harmful_count": "long",
}
EDGE_COLUMNS = {
    "source": "string", "target": "string", "type": "string", "subtype": "string", "context": "string", "weight": "double",
    "created_at": "long", "valid_from": "long", "valid_until": "long",
}


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All of ``columns`` in order and type; missing ones are null, so older tables read like new ones."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def _or(name: str, value) -> Column:
    """The column unless null or, for times and texts, empty."""
    return F.coalesce(F.nullif(F.col(name), F.lit("" if isinstance(value, str) else 0)), F.lit(value))


def with_defaults(nodes: DataFrame, now_ms: int) -> DataFrame:
    """Fill what a new node may leave out; weight 0 stays 0, and only tasks have a status and schedule."""
    n = conform(nodes, NODE_COLUMNS)
    task = F.col("type") == "task"
    return n.withColumns(
        {
            "content": F.coalesce("content", F.lit("")),
            "source": _or("source", "unknown"),
            "trust": F.when(F.col("trust").isin(*TRUST_LEVELS), F.col("trust")).otherwise("direct"),
            "created_at": _or("created_at", now_ms),
            "updated_at": _or("updated_at", now_ms),
            "last_accessed": _or("last_accessed", now_ms),
            "access_count": F.coalesce("access_count", F.lit(0)),
            "weight": F.coalesce("weight", F.lit(1.0)),
            "pinned": F.coalesce("pinned", F.lit(False)),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "status": F.when(task, _or("status", "active")),
            "schedule": F.when(task, F.coalesce("schedule", F.lit(""))),
            "helpful_count": F.coalesce("helpful_count", F.lit(0)),
            "harmful_count": F.coalesce("harmful_count", F.lit(0)),
        }
    )


def edge_defaults(edges: DataFrame, now_ms: int) -> DataFrame:
    e = conform(edges, EDGE_COLUMNS)
    return e.withColumns(
        {
            "context": F.coalesce("context", F.lit("")),
            "weight": F.coalesce("weight", F.lit(1.0)),
            "created_at": _or("created_at", now_ms),
            "subtype": F.nullif("subtype", F.lit("")),
            "valid_from": F.nullif("valid_from", F.lit(0)),
            "valid_until": F.nullif("valid_until", F.lit(0)),
        }
    )


def problems() -> Column:
    """What is wrong with a node, as an array of messages; null if nothing is."""
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id"),
            F.when(F.coalesce(F.col("name"), F.lit("")) == "", "missing name"),
            F.when(~F.coalesce(F.col("type"), F.lit("")).isin(*NODE_TYPES), F.concat(F.lit("invalid type: "), F.coalesce(F.col("type"), F.lit("")))),
            F.when((F.col("weight") < 0) | (F.col("weight") > 1), "weight must be in [0, 1]"),
        )
    )
    return F.when(F.size(found) > 0, found)


def admit(nodes: DataFrame, now_ms: int, longest: int = 150) -> tuple[DataFrame, DataFrame]:
    """Accepted nodes with defaults and shortened names, and rejected ones with a ``reason``."""
    filled = with_defaults(nodes, now_ms).withColumn("_reason", F.when(F.length("content") > longest, F.lit("content too long")).otherwise(F.array_join(problems(), "; ")))
    good = filled.where(F.coalesce("_reason", F.lit("")) == "").withColumn("name", truncate_at_word(F.col("name"), longest)).drop("_reason")
    return good, filled.where(F.coalesce("_reason", F.lit("")) != "").withColumnRenamed("_reason", "reason")
