"""Vector, keyword and hybrid retrieval. Queries are tables, so many run in one job."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import normalise_name, phrasings, query_tokens
from quillgraph.functions.vector import top_k
from quillgraph.operators.graph import NearEdges, demote_superseded, endpoints, spreading_activation, touching
from quillgraph.operators.similarity import best_between
from quillgraph.plans.lineage import cut, kept

if TYPE_CHECKING:
    from quillgraph.operators.inverted import InvertedIndex

#: BM25's usual constants; a name counts ten times as much as content.
K1, B, NAME_WEIGHT = 1.2, 0.75, 10.0


def top(df: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def vector_search(
    nodes: DataFrame, queries: DataFrame, limit: int = 10, min_score: float = 0.3, types: list | None = None,
    since: int | None = None, until: int | None = None, aliases: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, id, score)``: the best ``limit`` nodes by cosine; an alias may stand in for its node, the better score counts.

    Type and time filters hold for alias hits as well. ``aliases`` has ``(node_id, embedding)``; None does without.
    """
    kept = nodes
    if types:
        kept = kept.where(F.col("type").isin(*types))
    if since is not None:
        kept = kept.where(F.col("created_at") >= since)
    if until is not None:
        kept = kept.where(F.col("created_at") <= until)
    if aliases is None:
        return top_k(kept, queries, limit, min_score)
    owned = aliases.join(kept.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    rows = kept.select("id", "embedding").unionAll(owned.select(F.col("node_id").alias("id"), "embedding"))
    return top_k(rows, queries, limit, min_score, repeated=True)


def tokens(text: Column) -> Column:
    """Words for the inverted index: runs of ASCII letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def occurrences_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, col, term, tf)``, a row with ``tf`` 1 for each occurrence, and ``(id, n_name, n_content)``."""
    split = nodes.select("id", tokens(F.col("name")).alias("name"), tokens(F.col("content")).alias("content"))
    part = lambda c: F.transform(c, lambda t: F.struct(F.lit(c).alias("col"), t.alias("term")))
    terms = split.select("id", F.explode(F.concat(part("name"), part("content"))).alias("t"))
    return terms.select("id", "t.col", "t.term", F.lit(1).cast("long").alias("tf")), split.select("id", F.size("name").alias("n_name"), F.size("content").alias("n_content"))


def postings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index, derived from the nodes: ``(id, col, term, tf)`` and ``(id, n_name, n_content)``."""
    terms, sizes = occurrences_of(nodes)
    return terms.groupBy("id", "col", "term").agg(F.sum("tf").alias("tf")), sizes


def in_step(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(nodes, indexed, in_step)``: whether an index has every node, by their counts; a stale one is to be derived anew."""
    counts = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(sizes.agg(F.count("*").alias("indexed"))))
    return counts.withColumn("in_step", F.col("nodes") == F.col("indexed"))


def matching_terms(terms: DataFrame, words: DataFrame, prefix: bool = False, stem=None) -> DataFrame:
    """``(q, term)``: which index terms (column ``term``, distinct) each query word ``q`` stands for.

    With ``prefix``, a term meets the words among its own prefixes, so the join is on equality and
    no first letter is a hot key. With ``stem``, terms and words meet by their stems.
    """
    if prefix:
        parts = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))
        return terms.select("term", F.explode(parts).alias("q")).join(words, "q").select("q", "term")
    if stem is not None:
        return terms.select("term", stem(F.col("term")).alias("q")).join(words, "q").select("q", "term")
    return words.select("q", F.col("q").alias("term"))


def keyword_search(
    nodes: DataFrame, queries: DataFrame, limit: int = 10, prefix: bool = False, types: list | None = None, stem=None, index: InvertedIndex | None = None
) -> DataFrame:
    """``(query_id, id, bm25, score)`` for queries ``(query_id, query)``.

    A document matches if it has any of a query's words (or words that start with one, if
    ``prefix``). Document frequencies are of phrases over all nodes; name and content share one length.
    ``score`` maps the ``limit`` best of a query to 0.3 to 0.9, 0.9 if they are all equal. ``stem``
    is a column function applied to both sides. ``types`` filters results, not statistics. With an
    ``index`` of the nodes only the ranges of postings are read that can bring a hit (``prefix`` and
    ``stem`` read all of a word's); without it the texts are, and only the queries' words are shuffled
    (for ``prefix`` and ``stem`` the texts, once), then their counts by document.
    """
    if index is not None and not prefix and stem is None:
        return index.search(queries, limit, types, nodes)
    asked = queries.select("query_id", F.explode(F.array_distinct(query_tokens(F.col("query")))).alias("q"))
    asked = asked.withColumn("q", F.explode(F.filter(F.split("q", "[^a-z0-9]+"), lambda t: t != ""))).distinct()
    if stem is not None:
        asked = asked.withColumn("q", stem(F.col("q"))).distinct()
    asked = kept(asked)
    occurrences, sizes = index.tables() if index is not None else occurrences_of(nodes)
    sizes = kept(sizes)  # read twice below
    found = matching_terms(occurrences.select("term").distinct(), asked.select("q").distinct(), prefix, stem)
    if prefix or stem is not None:
        found = kept(found)  # so that the join below knows how few words there are before it shuffles all
        if index is None:
            occurrences, _ = occurrences_of(nodes.repartition("id"))  # most words match, so texts are dealt and words counted where they are
    matched = occurrences.join(found, "term")
    tf = matched.groupBy("id", "q").agg(F.sum(F.when(F.col("col") == "name", NAME_WEIGHT).otherwise(1.0) * F.col("tf")).alias("tf"))
    tf = kept(tf.join(sizes, "id"))  # what the words occur in, read twice below
    df = kept(tf.groupBy("q").agg(F.count("*").alias("df")))
    total = sizes.agg(F.count("*").alias("n"), F.avg(F.col("n_name") + F.col("n_content")).alias("avg"))  # one row
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * (F.col("n_name") + F.col("n_content")) / F.col("avg")))
    # dealt by document, so that a document's sums for all queries are made where its words are
    parts = tf.repartition("id").join(df, "q").join(F.broadcast(total)).select("id", "q", weight.alias("w"))
    # rounded, so that the order of a distributed sum never decides between equal documents
    found = asked.join(parts, "q").groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("bm25"))
    if types:
        found = found.join(nodes.where(F.col("type").isin(*types)).select("id"), "id", "left_semi")
    best = top(found, limit, score="bm25")
    return rescaled(best)


def rescaled(best: DataFrame, score: str = "bm25") -> DataFrame:
    """Adds ``score``: a query's results from 0.3 for its worst to 0.9 for its best, 0.9 if they are equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return best.withColumn("score", F.when(hi > lo, 0.3 + 0.6 * (F.col(score) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.9))


def min_max(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each query to [0, 1]; all 1 if they are equal."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(hi > lo, (F.col(score) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(1.0))


def fuse(signals: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """``(query_id, id, score, <name>...)``: min-max scaled signals, weighted and summed, absent ones 0.

    A full outer join of all signals, as one union and one conditional aggregate.
    """
    rows = None
    for name, df, _ in signals:
        part = min_max(df.select("query_id", "id", "score")).withColumn("signal", F.lit(name))
        rows = part if rows is None else rows.unionAll(part)
    sums = [F.coalesce(F.max(F.when(F.col("signal") == name, F.col("score"))), F.lit(0.0)).alias(name) for name, _, _ in signals]
    wide = rows.groupBy("query_id", "id").agg(*sums)
    total = F.lit(0.0)
    for name, _, weight in signals:
        total = total + F.col(name) * weight
    return wide.withColumn("score", F.round(total, 9))


def hybrid_search(
    nodes: DataFrame, edges: DataFrame | NearEdges, queries: DataFrame, vector_weight: float = 0.5, keyword_weight: float = 0.3, graph_weight: float = 0.2,
    limit: int = 15, min_score: float = 0.2, seed_limit: int = 5, seed_score: float = 0.3, since: int | None = None, until: int | None = None,
    index: InvertedIndex | None = None,
) -> DataFrame:
    """``(query_id, id, score, vector, keyword, graph, rank, near_miss, weight, degree)`` for queries ``(query_id, query, embedding)``.

    Each signal brings twice ``limit``; the graph signal spreads from the query's best vector hits.
    Ranks over ``limit``, half as many again, are near misses. Times filter after the merge. Every
    hit comes with its node's weight and number of edges. ``index`` is as in ``keyword_search``. Of
    ``NearEdges`` only those at seeds, at what they reach and at hits are sought.
    """
    vectors = cut(vector_search(nodes, queries, 2 * limit, min_score))
    seeds = top(vectors.where(F.col("score") >= seed_score), seed_limit)
    signals = [
        ("vector", vectors, vector_weight),
        ("keyword", keyword_search(nodes, queries, 2 * limit, index=index), keyword_weight),
        ("graph", spreading_activation(nodes, edges, seeds, max_results=2 * limit), graph_weight),
    ]
    out = fuse(signals)
    if since is not None or until is not None:
        times = nodes.where(F.col("created_at").between(since if since is not None else -(1 << 62), until if until is not None else 1 << 62))
        out = out.join(times.select("id"), "id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + -(-limit // 2))
    return enriched(out.withColumn("near_miss", F.col("rank") > limit), nodes, edges)


def enriched(hits: DataFrame, nodes: DataFrame, edges: DataFrame | NearEdges) -> DataFrame:
    """Adds the nodes' ``weight`` and ``degree``; only the edges of hits are counted."""
    hits = cut(hits)
    ids = hits.select("id").distinct()
    counts = endpoints(touching(edges, ids)).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    known = nodes.select("id", "weight").join(ids, "id", "left_semi").join(counts, "id", "left")
    return hits.join(known.select("id", "weight", F.coalesce("degree", F.lit(0)).alias("degree")), "id", "left")


def presented(hits: DataFrame, verbose: bool = False, helpful: bool = False) -> DataFrame:
    """The columns that a reader asked for, settled when the plan is built, so that others are never read.

    ``verbose`` adds the signals, weight and degree, ``helpful`` the feedback counts, as far as there are any.
    """
    wanted = ["query_id", "rank", "id", "score", "near_miss"]
    wanted += ["vector", "keyword", "graph", "weight", "degree"] if verbose else []
    wanted += ["helpful_count", "harmful_count"] if helpful else []
    return hits.select(*(c for c in wanted if c in hits.columns))


def best_phrasing(results: DataFrame) -> DataFrame:
    """Results of several phrasings ``(query_id, phrasing, id, score)``: each node's best; the first phrasing wins ties."""
    return results.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min_by("phrasing", F.struct(-F.col("score"), "phrasing")).alias("phrasing"))


def relevance_note() -> Column:
    """Over one query's scores: none found, or the best under 0.3."""
    return F.when(F.max("score").isNull(), "none").when(F.max("score") < 0.3, "weak").otherwise("ok")


def exact_duplicates(nodes: DataFrame, text: str) -> DataFrame:
    """``(id, duplicate_of)``: nodes whose text an earlier id has; only digests are compared and shuffled."""
    c = nodes.select("id", F.md5(text).alias("_digest"))
    least = c.groupBy("_digest").agg(F.min("id").alias("duplicate_of"))
    return c.join(least, "_digest").where("id <> duplicate_of").select("id", "duplicate_of")


def name_duplicates(nodes: DataFrame) -> DataFrame:
    """``(id, duplicate_of)``: nodes whose normalised name an earlier id has."""
    named = nodes.select("id", normalise_name(F.col("name")).alias("norm")).where("norm <> ''")
    first = named.groupBy("norm").agg(F.min("id").alias("duplicate_of"))
    return named.join(first, "norm").where("id <> duplicate_of").select("id", "duplicate_of")


def dedup_decisions(new: DataFrame, known: DataFrame, skip: float = 0.97, warn: float = 0.92) -> DataFrame:
    """``(id, decision, matched, score)`` for each new node: the first of exact id, normalised name, near vector.

    Decisions are ``exact``, ``name``, ``skip`` and ``warn`` (by the best cosine), else ``add``.
    """
    exact = new.select("id").join(known.select("id"), "id").select("id", F.lit(0).alias("level"), F.lit("exact").alias("decision"), F.col("id").alias("matched"), F.lit(1.0).alias("score"))
    n = new.select("id", normalise_name(F.col("name")).alias("norm")).where("norm <> ''")
    k = known.select(F.col("id").alias("other"), normalise_name(F.col("name")).alias("norm")).where("norm <> ''")
    first = k.groupBy("norm").agg(F.min("other").alias("first"))  # the two least ids of a name are enough
    second = k.join(first, "norm").where("other <> first").groupBy("norm").agg(F.min("other").alias("second"))
    name = n.join(first, "norm").join(second, "norm", "left").select("id", F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second")).alias("matched"))
    name = name.where("matched is not null").groupBy("id").agg(F.min("matched").alias("matched")).select("id", F.lit(1).alias("level"), F.lit("name").alias("decision"), "matched", F.lit(1.0).alias("score"))
    sooner = cut(exact.unionAll(name))
    near = best_between(new.join(sooner.select("id"), "id", "left_anti"), known, warn).groupBy(F.col("a").alias("id")).agg(F.min_by(F.struct("b", "score"), F.struct(-F.col("score"), "b")).alias("m"))
    near = near.select("id", F.lit(2).alias("level"), F.when(F.col("m.score") >= skip, "skip").otherwise("warn").alias("decision"), F.col("m.b").alias("matched"), "m.score")
    found = sooner.unionAll(near).groupBy("id").agg(F.min_by(F.struct("decision", "matched", "score"), "level").alias("d"))
    return new.select("id").join(found, "id", "left").select("id", F.coalesce("d.decision", F.lit("add")).alias("decision"), "d.matched", "d.score")


def search(
    nodes: DataFrame, edges: DataFrame | NearEdges, queries: DataFrame, embed, limit: int = 10, multi: bool = True, types: list | None = None,
    since: int | None = None, until: int | None = None, **weights,
) -> DataFrame:
    """End to end for ``(query_id, query)``: phrasings, hybrid search of each, best of them, demotion, filter, ranks.

    ``embed`` adds ``embedding`` for a ``query`` column. Returns ``(query_id, id, score, phrasing, superseded,
    rank, near_miss)``; scores of superseded nodes count a tenth. Nothing is changed: feedback is the store's.
    """
    each = F.posexplode(phrasings(F.col("query"))) if multi else F.posexplode(F.array("query"))
    asked = queries.select("query_id", each.alias("phrasing", "query")).withColumn("query_id", F.struct("query_id", "phrasing"))
    found = hybrid_search(nodes, edges, embed(asked.select("query_id", "query")), limit=limit, since=since, until=until, **weights)
    found = found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.phrasing").alias("phrasing"), "id", "score")
    best = demote_superseded(best_phrasing(found), edges)
    if types:
        best = best.join(nodes.where(F.col("type").isin(*types)).select("id"), "id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + -(-limit // 2))
    return best.select("query_id", "id", "score", "phrasing", "superseded", "rank", (F.col("rank") > limit).alias("near_miss"))
