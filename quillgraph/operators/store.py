"""One object over the node and edge tables, with the operations that applications call."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph, lifecycle, retrieval
from quillgraph.operators.inverted import InvertedIndex, Segment
from quillgraph.operators.schema import EDGE_COLUMNS, NODE_COLUMNS, admit, conform, edge_defaults
from quillgraph.plans import commits
from quillgraph.plans.lineage import remove


@dataclass(frozen=True)
class GraphStore:
    """Immutable: every change returns a new store; ``save`` writes the version that follows the one it was loaded from.

    ``index`` is the inverted index of the nodes, once ``indexed`` has made it; changes of nodes keep it in
    step by a segment of what changed.
    """

    nodes: DataFrame
    edges: DataFrame
    index: InvertedIndex | None = None
    version: int = 0

    @staticmethod
    def create(spark: SparkSession, path: str) -> GraphStore:
        """An empty store of the full schema, saved under ``path`` unless there is one already, which is then loaded."""
        if commits.versions(spark, f"{path}/log"):
            return GraphStore.load(spark, path)
        columns = lambda of: ", ".join(f"{c} {t}" for c, t in of.items())
        store = GraphStore(spark.createDataFrame([], columns(NODE_COLUMNS)), spark.createDataFrame([], columns(EDGE_COLUMNS)))
        try:
            return store.save(path)
        except commits.Conflict:  # somebody else made it meanwhile
            return GraphStore.load(spark, path)

    def indexed(self) -> GraphStore:
        """The store with its inverted index, so that searches don't read all texts again."""
        return replace(self, index=InvertedIndex.of(self.nodes))

    def index_in_step(self) -> DataFrame:
        """Whether the index has every node; without an index none is there."""
        return retrieval.in_step(self.nodes, self.index.docs() if self.index else self.nodes.select("id").limit(0))

    def _indexed_with(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> InvertedIndex | None:
        return self.index.changed(changed, removed) if self.index else None

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> GraphStore:
        """A version under ``path``, the latest if none is named, with its index if it has one.

        Edges whose ends are missing are left out; older tables' missing columns are null.
        """
        version = commits.versions(spark, f"{path}/log")[-1] if version is None else version
        what = commits.entry(spark, f"{path}/log", version)
        nodes = conform(spark.read.parquet(f"{path}/{what['name']}/nodes"), NODE_COLUMNS)
        edges = conform(spark.read.parquet(f"{path}/{what['name']}/edges"), EDGE_COLUMNS)
        index = InvertedIndex(tuple(Segment.read(spark, f"{path}/index", s) for s in what["segments"])) if what["segments"] else None
        return GraphStore(nodes, graph.valid_edges(edges, nodes).select(*EDGE_COLUMNS), index, version)

    def save(self, path: str) -> GraphStore:
        """Write the next version, whole or not at all, and return it.

        Tables go to folders of their own; the version counts once its log entry is there, which only one
        writer can add. ``commits.Conflict`` says that another one has saved since this store was
        loaded. Index segments that are there already are not written again.
        """
        spark = self.nodes.sparkSession
        if commits.versions(spark, f"{path}/log")[-1:] not in ([], [self.version]):
            raise commits.Conflict(f"{path} has a later version than {self.version}")
        name = f"v-{uuid.uuid4().hex}"
        self.nodes.write.parquet(f"{path}/{name}/nodes")
        self.edges.write.parquet(f"{path}/{name}/edges")
        index = self.index.save(f"{path}/index", lambda: f"s-{uuid.uuid4().hex}") if self.index else None
        try:
            version = commits.commit(spark, f"{path}/log", self.version, {"name": name, "segments": [s.name for s in index.segments] if index else []})
        except commits.Conflict:
            remove(spark, f"{path}/{name}")
            raise
        return GraphStore(conform(spark.read.parquet(f"{path}/{name}/nodes"), NODE_COLUMNS), conform(spark.read.parquet(f"{path}/{name}/edges"), EDGE_COLUMNS), index, version)

    @staticmethod
    def update(spark: SparkSession, path: str, change: Callable[[GraphStore], GraphStore], retries: int = 3, base_delay_ms: float = 100) -> GraphStore:
        """Load, change and save; after a conflict again from the version that was saved meanwhile, a few times, waiting longer each time."""
        return commits.retried(lambda: change(GraphStore.load(spark, path)).save(path), retries, base_delay_ms)

    @staticmethod
    def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
        """Remove the tables of all versions but the last ``keep``, and segments that none of these has; which versions are left."""
        every = commits.versions(spark, f"{path}/log")
        left, old = every[-keep:], every[:-keep]
        needed = {s for v in left for s in commits.entry(spark, f"{path}/log", v)["segments"]}
        for v in old:
            what = commits.entry(spark, f"{path}/log", v)
            for s in set(what["segments"]) - needed:
                remove(spark, f"{path}/index/{s}")
            remove(spark, f"{path}/{what['name']}")
            remove(spark, f"{path}/log/{v:020d}.json")
        return left

    def add_nodes(self, new: DataFrame, now_ms: int) -> tuple[GraphStore, DataFrame]:
        good, bad = admit(new, now_ms)
        nodes = lifecycle.upsert_nodes(self.nodes, good)
        index = self._indexed_with(nodes.join(good.select("id").distinct(), "id", "left_semi")) if self.index else None
        return replace(self, nodes=nodes, index=index), bad

    def add_edges(self, new: DataFrame, now_ms: int) -> tuple[GraphStore, DataFrame]:
        edges, bad = lifecycle.upsert_edges(self.edges, edge_defaults(new, now_ms), self.nodes)
        return replace(self, edges=edges), bad

    def touch(self, ids: DataFrame, now_ms: int) -> GraphStore:
        return replace(self, nodes=lifecycle.touch(self.nodes, ids, now_ms))

    def remove(self, ids: DataFrame, now_ms: int) -> tuple[GraphStore, DataFrame]:
        nodes, archive, edges = lifecycle.remove(self.nodes, self.edges, ids, now_ms)
        return replace(self, nodes=nodes, edges=edges, index=self._indexed_with(removed=ids)), archive

    def boost(self, ids: DataFrame, now_ms: int, by: float = 0.2) -> GraphStore:
        return replace(self, nodes=lifecycle.boost(self.nodes, ids, now_ms, by))

    def suppress(self, ids: DataFrame, by: float = 0.02) -> GraphStore:
        return replace(self, nodes=lifecycle.suppress(self.nodes, ids, by))

    def mark_helpful(self, ids: DataFrame) -> GraphStore:
        return replace(self, nodes=lifecycle.mark(self.nodes, ids, "helpful_count"))

    def mark_harmful(self, ids: DataFrame) -> GraphStore:
        return replace(self, nodes=lifecycle.mark(self.nodes, ids, "harmful_count"))

    def invalidate(self, keys: DataFrame, now_ms: int) -> GraphStore:
        return replace(self, edges=lifecycle.invalidate(self.edges, keys, now_ms))

    def get_node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def has_nodes(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.nodes.select("id"), "id", "left_semi")

    def find(self, query: str, limit: int = 10, type_: str | None = None) -> DataFrame:
        return graph.find_nodes(self.nodes, query, limit, type_)

    def neighbors(self, ids: DataFrame) -> DataFrame:
        return graph.neighbors(self.nodes, self.edges, ids)

    def edges_of(self, node_id: str) -> DataFrame:
        return graph.edges_of(self.edges, node_id)

    def activate(self, seeds: DataFrame, **options) -> DataFrame:
        return graph.spreading_activation(self.nodes, self.edges, seeds, **options)

    def store_embeddings(self, vectors: DataFrame) -> GraphStore:
        return replace(self, nodes=lifecycle.store_embeddings(self.nodes, vectors))

    def get_embedding(self, node_id: str) -> DataFrame:
        return self.get_node(node_id).select("embedding")

    def semantic_search(self, queries: DataFrame, **options) -> DataFrame:
        return retrieval.vector_search(self.nodes, queries, **options)

    def keyword_search(self, queries: DataFrame, **options) -> DataFrame:
        return retrieval.keyword_search(self.nodes, queries, index=self.index, **options)

    def hybrid_search(self, queries: DataFrame, **options) -> DataFrame:
        return retrieval.hybrid_search(self.nodes, self.edges, queries, index=self.index, **options)

    def apply_feedback(self, results: DataFrame, now_ms: int, boost: float = 0.05, competition: bool = True) -> GraphStore:
        """Hits gain weight, near misses lose it, by their likeness to the best hit or by a flat amount."""
        nodes = lifecycle.boost(self.nodes, results.where("not near_miss").select("id"), now_ms, boost)
        misses = results.where("near_miss")
        nodes = lifecycle.apply_penalties(nodes, lifecycle.competition_penalties(results, self.nodes)) if competition else lifecycle.suppress(nodes, misses.select("id"))
        return replace(self, nodes=nodes)

    def boot_context(self, most: int = 15) -> DataFrame:
        return lifecycle.boot_text(lifecycle.boot_selection(self.nodes, self.edges, most))

    def decay(self, as_of_ms: int) -> tuple[GraphStore, DataFrame, DataFrame]:
        """The store after decay and pruning, the archive and counts by fate."""
        decayed = lifecycle.decay(self.nodes, self.edges, as_of_ms)
        nodes, archive, edges = lifecycle.prune(decayed, self.edges, as_of_ms)
        return replace(self, nodes=nodes, edges=edges, index=self._indexed_with(removed=archive)), archive, decayed.groupBy("fate").agg(F.count("*").alias("n"))

    def centrality(self) -> DataFrame:
        return graph.degree(self.nodes, self.edges).orderBy(F.desc("degree"), "id")

    def communities(self) -> DataFrame:
        return graph.communities(self.nodes, self.edges)

    def orphans(self) -> DataFrame:
        return graph.orphans(self.nodes, self.edges)

    def decay_report(self) -> DataFrame:
        return graph.decay_report(self.nodes)

    def report(self) -> DataFrame:
        return graph.report(self.nodes, self.edges)

    def stats(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(self.edges.agg(F.count("*").alias("edges"))))

    def all_nodes(self) -> DataFrame:
        return self.nodes

    def all_edges(self) -> DataFrame:
        return self.edges
