"""All queries of the library by name, and their DuckDB twins."""

from __future__ import annotations

from quillgraph.plans import catalog_experiments, catalog_graph, catalog_retrieval, catalog_transcripts

_ALL = {**catalog_retrieval.QUERIES, **catalog_graph.QUERIES, **catalog_transcripts.QUERIES, **catalog_experiments.QUERIES}
QUERIES = {name: fn for name, (fn, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
