"""Weights over time, feedback and changes to the store.

Reads are pure: every change takes tables and returns new ones. Times are passed in as ``as_of_ms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import content_words, first_sentence, hours_since
from quillgraph.functions.vector import cosine
from quillgraph.operators.graph import isolated_since, superseded, valid_edges

# What an hour leaves of a weight, by type.
DECAY_BASE = {
    "event": 0.98, "task": 0.98, "concept": 0.995, "lesson": 0.995, "impression": 0.995, "problem": 0.995, "decision": 0.997,
    "entity": 0.998, "behavioral-principle": 0.999, "topical-principle": 0.999, "held-contradiction": 0.999, "preference": 1.0,
}
DECAY_OTHER = 0.98


def decay_base() -> Column:
    rates = F.create_map(*(x for t, b in DECAY_BASE.items() for x in (F.lit(t), F.lit(b))))
    return F.coalesce(F.try_element_at(rates, F.col("type")), F.lit(DECAY_OTHER))


def decay(nodes: DataFrame, edges: DataFrame, as_of_ms: int) -> DataFrame:
    """Adds ``new_weight`` and ``fate`` (``pinned``, ``pruned``, ``faded``, ``kept``).

    The new weight is the type's base to the hours since the last access, whatever the weight was;
    the base is squared if the node is superseded, and again if it has long had no outgoing edge.
    Two left joins against id sets and one projection.
    """
    gone = superseded(edges).withColumn("_superseded", F.lit(2))
    alone = isolated_since(nodes, edges, as_of_ms).withColumn("_alone", F.lit(2))
    power = F.coalesce("_superseded", F.lit(1)) * F.coalesce("_alone", F.lit(1))
    last = F.col("last_accessed") if "last_accessed" in nodes.columns else F.lit(None).cast("long")
    pinned = F.coalesce("pinned", F.lit(False)) if "pinned" in nodes.columns else F.lit(False)
    done = (F.col("type") == "task") & (F.coalesce("status", F.lit("")) == "done") if "status" in nodes.columns else F.lit(False)
    floor = F.when(F.col("type").isin("event", "task"), 0.1).otherwise(0.01)
    out = nodes.join(gone, "id", "left").join(alone, "id", "left")
    weight = F.pow(decay_base(), hours_since(F.lit(as_of_ms), last, F.col("created_at")) * power)
    out = out.withColumn("new_weight", F.when(pinned, F.col("weight")).otherwise(weight))
    fate = F.when(pinned, "pinned").when(done | (F.col("new_weight") < floor), "pruned").when(F.col("new_weight") < 0.1, "faded").otherwise("kept")
    return out.withColumn("fate", fate).drop("_superseded", "_alone")


def prune(decayed: DataFrame, edges: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept nodes with their new weights, the archive ``(id, data, pruned_at)`` and the edges that are left."""
    plain = [c for c in decayed.columns if c not in ("new_weight", "fate")]
    kept = decayed.where("fate <> 'pruned'").withColumn("weight", F.col("new_weight")).select(*plain)
    archived = decayed.where("fate = 'pruned'").select("id", F.to_json(F.struct(*plain)).alias("data"), F.lit(as_of_ms).alias("pruned_at"))
    return kept, archived, valid_edges(edges, kept)


def remove(nodes: DataFrame, edges: DataFrame, ids: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``prune`` for the given ``ids``."""
    flags = ids.select("id").distinct().withColumn("fate", F.lit("pruned"))
    marked = nodes.join(flags, "id", "left").withColumns({"fate": F.coalesce("fate", F.lit("kept")), "new_weight": F.col("weight")})
    return prune(marked, edges, as_of_ms)


def _times(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """How often each node is named in ``ids``, as ``_n``."""
    return nodes.join(ids.groupBy("id").agg(F.count("*").alias("_n")), "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))


def boost(nodes: DataFrame, ids: DataFrame, as_of_ms: int, by: float = 0.2) -> DataFrame:
    """Weight up to 1 at most, access time and count."""
    n = F.col("_n")
    out = _times(nodes, ids).withColumns(
        {
            "weight": F.when(n > 0, F.least(F.lit(1.0), F.col("weight") + n * by)).otherwise(F.col("weight")),
            "last_accessed": F.when(n > 0, F.lit(as_of_ms)).otherwise(F.col("last_accessed")),
            "access_count": F.coalesce("access_count", F.lit(0)) + n,
        }
    )
    return out.drop("_n")


def suppress(nodes: DataFrame, ids: DataFrame, by: float = 0.02) -> DataFrame:
    """Weight down to 0 at least; pinned nodes and access fields stay."""
    n = F.when(F.coalesce("pinned", F.lit(False)), 0).otherwise(F.col("_n"))
    return _times(nodes, ids).withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") - n * by)).drop("_n")


def touch(nodes: DataFrame, ids: DataFrame, as_of_ms: int) -> DataFrame:
    n = F.col("_n")
    return _times(nodes, ids).withColumns(
        {"last_accessed": F.when(n > 0, F.lit(as_of_ms)).otherwise(F.col("last_accessed")), "access_count": F.coalesce("access_count", F.lit(0)) + n}
    ).drop("_n")


def mark(nodes: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Counts up ``helpful_count`` or ``harmful_count``."""
    return _times(nodes, ids).withColumn(column, F.coalesce(column, F.lit(0)) + F.col("_n")).drop("_n")


def competition_penalties(hits: DataFrame, nodes: DataFrame, flat: float = 0.02) -> DataFrame:
    """``(query_id, id, similarity, penalty)`` for near misses by their likeness to the query's first hit.

    ``hits`` has ``(query_id, id, rank, near_miss)``. The penalty is ``0.05 * (similarity - 0.3) / 0.7``;
    under 0.3, or 0.001 and less, there is none; without an embedding it is ``flat``.
    """
    vectors = nodes.select("id", "embedding")
    first = hits.where("rank = 1").join(vectors, "id").select("query_id", F.col("embedding").alias("best"))
    near = hits.where("near_miss").join(vectors, "id").join(first, "query_id")
    near = near.withColumn("similarity", F.when(F.col("embedding").isNull() | F.col("best").isNull(), F.lit(None)).otherwise(cosine(F.col("embedding"), F.col("best"))))
    penalty = F.when(F.col("similarity").isNull(), flat).when(F.col("similarity") < 0.3, 0.0).otherwise(0.05 * (F.col("similarity") - 0.3) / 0.7)
    return near.select("query_id", "id", "similarity", penalty.alias("penalty")).where("penalty > 0.001")


def apply_penalties(nodes: DataFrame, penalties: DataFrame) -> DataFrame:
    total = penalties.groupBy("id").agg(F.sum("penalty").alias("_p"))
    cut = F.when(F.coalesce("pinned", F.lit(False)), 0.0).otherwise(F.coalesce("_p", F.lit(0.0)))
    return nodes.join(total, "id", "left").withColumn("weight", F.greatest(F.lit(0.0), F.col("weight") - cut)).drop("_p")


def _one_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the same one in every run: updated or else created last, then by a hash of the row."""
    times = [F.desc_nulls_last(c) for c in ("updated_at", "created_at") if c in rows.columns]
    order = Window.partitionBy(*key).orderBy(*times, F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of their id; a new row without an embedding keeps the old one.

    Of several new rows of an id the one updated last counts, of those the one of least hash.
    """
    latest = _one_each(new, ["id"])
    if "embedding" in nodes.columns:
        old = nodes.select("id", F.col("embedding").alias("_old"))
        latest = latest.join(old, "id", "left").withColumn("embedding", F.coalesce("embedding", "_old")).drop("_old")
    return nodes.join(latest.select("id"), "id", "left_anti").unionByName(latest, allowMissingColumns=True)


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with new ones in place of those of their key, and new ones rejected for a missing end."""
    good = _one_each(valid_edges(new, nodes), ["source", "target", "type"])
    key = ["source", "target", "type"]
    rejected = new.join(good.select(*key), key, "left_anti")
    return edges.join(good.select(*key), key, "left_anti").unionByName(good, allowMissingColumns=True), rejected


def invalidate(edges: DataFrame, keys: DataFrame, at_ms: int) -> DataFrame:
    """Close edges ``(source, target, type)`` at a time."""
    marks = keys.select("source", "target", "type").distinct().withColumn("_close", F.lit(at_ms))
    out = edges.join(marks, ["source", "target", "type"], "left")
    return out.withColumn("valid_until", F.coalesce("_close", "valid_until")).drop("_close")


def store_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors ``(id, embedding)`` on their nodes; of several for an id the greatest counts, and null keeps the old one."""
    new = vectors.groupBy("id").agg(F.max("embedding").alias("_new"))
    return nodes.join(new, "id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def remainders(pairs: DataFrame) -> DataFrame:
    """What a superseding text loses: ``(id, lost, n_old, keep)`` for rows ``(id, old, new)``.

    ``keep`` says that a remainder node is due: over 30 % of more than five long old words are gone.
    """
    words = pairs.select("id", content_words(F.col("old")).alias("o"), content_words(F.col("new")).alias("n"))
    lost = words.select("id", F.array_sort(F.array_except("o", "n")).alias("lost"), F.size("o").alias("n_old"))
    return lost.withColumn("keep", (F.col("n_old") > 5) & (F.size("lost") > 0.3 * F.col("n_old")))


def supersede(nodes: DataFrame, pairs: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``new supersedes old`` for ``(old_id, new_id)``, and remainder nodes for what is lost."""
    text = nodes.select("id", "name", "content")
    both = pairs.join(text.select(F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("content").alias("old")), "old_id")
    both = both.join(text.select(F.col("id").alias("new_id"), F.col("content").alias("new")), "new_id").withColumn("id", F.col("old_id"))
    edges = both.select(F.col("new_id").alias("source"), F.col("old_id").alias("target"), F.lit("supersedes").alias("type"), F.lit(1.0).alias("weight"), F.lit(now_ms).alias("created_at"))
    due = remainders(both).where("keep").join(both.select("id", "old_name"), "id")
    nodes_out = due.select(
        F.concat("id", F.lit("-remainder")).alias("id"), F.lit("concept").alias("type"), F.concat(F.lit("Remainder of "), "old_name").alias("name"),
        F.array_join("lost", " ").alias("content"), F.lit(now_ms).alias("created_at"),
    )
    return edges, nodes_out


def boot_selection(nodes: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """``(ord, id, name, line)``: all behavioral principles by weight, then topical ones (pinned first) up to ``most``.

    A line ends with the names that ``resolved_from`` edges point to. Only principles are ranked.
    """
    p = nodes.where(F.col("type").isin("behavioral-principle", "topical-principle")).withColumn("_topical", (F.col("type") == "topical-principle").cast("int"))
    pinned = F.when(F.col("_topical") == 1, F.coalesce("pinned", F.lit(False)).cast("int")).otherwise(0) if "pinned" in nodes.columns else F.lit(0)
    order = Window.orderBy("_topical", F.desc("_pinned"), F.desc("weight"), "id")
    top = p.withColumn("_pinned", pinned)
    always = top.where("_topical = 0")
    rest = top.where("_topical = 1").orderBy(F.desc("_pinned"), F.desc("weight"), "id").limit(most)
    chosen = always.unionByName(rest).withColumn("ord", F.row_number().over(order)).where((F.col("ord") <= most) | (F.col("_topical") == 0))
    sources = edges.where("type = 'resolved_from'").join(nodes.select(F.col("id").alias("target"), F.col("name").alias("_from")), "target")
    sources = sources.groupBy(F.col("source").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("_from")), ", ").alias("_from"))
    out = chosen.join(sources, "id", "left")
    line = F.concat(F.lit("- **"), "name", F.lit("**: "), first_sentence(F.col("content")), F.when(F.col("_from").isNotNull(), F.concat(F.lit(" ← "), "_from")).otherwise(""))
    return out.select("ord", "id", "name", line.alias("line"))


def boot_text(selected: DataFrame) -> DataFrame:
    """The selected lines as one text; a fixed notice if there are none."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n")
    return selected.agg(F.when(F.count("*") > 0, F.concat(F.lit("# Memory\n\n## Principles\n"), body)).otherwise("# Memory\n\n(empty)").alias("text"))
