"""Vectors as arrays of floats: similarity as an expression, and blocked exact search with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to every task at once; more are searched in several passes.
QUERY_BLOCK = 4096
#: Rows scored together in a task.
ROW_BLOCK = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if lengths differ, a norm is 0 or a side is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def _matrix(vectors: list, size: int) -> np.ndarray:
    """Unit rows; rows of another length, or of norm 0, become zeros and so score 0."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[i] = v
    norms = np.linalg.norm(out, axis=1)
    return out / np.where(norms > 0, norms, 1)[:, None]


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows of an Arrow list column, as ``_matrix`` makes them; lists of one length are taken as they lie."""
    starts = column.offsets.to_numpy()
    if not column.null_count and not column.values.null_count and len(starts) > 1 and (np.diff(starts) == size).all():
        out = column.values.to_numpy()[starts[0] : starts[-1]].reshape(-1, size).astype(np.float64)
        norms = np.linalg.norm(out, axis=1)
        return out / np.where(norms > 0, norms, 1)[:, None]
    return _matrix(column.to_pylist(), size)


def top_k(nodes: DataFrame, queries: DataFrame, k: int, min_score: float, key: str = "id", vector: str = "embedding", query: str = "query_id", repeated: bool = False) -> DataFrame:
    """``(query, key, score)``: the exact ``k`` best of ``nodes`` for each query, cosine at least ``min_score``; ties by key.

    Queries travel to the rows in blocks of fixed size; a task sends on its own ``k`` best for each
    query, so the shuffle does not grow with the nodes that a task holds. With ``repeated``, a key may
    have any number of vectors, of which the best counts; a task sends each key once for a query.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    q_type, k_type = queries.schema[query].dataType, nodes.schema[key].dataType
    schema = f"{query} {q_type.simpleString()}, {key} {k_type.simpleString()}, score double"
    numbered = queries.select(query, vector).withColumn("_block", F.pmod(F.xxhash64(query), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in (numbered.where(F.col("_block") == b) if blocks > 1 else numbered).select(query, vector).collect()]  # about QUERY_BLOCK rows
        if not rows:
            continue

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, list[int]] = {}
            for i, (_, v) in enumerate(rows):
                by_size.setdefault(len(v or ()), []).append(i)
            asked = {n: (at, _matrix([rows[i][1] for i in at], n)) for n, at in by_size.items() if n}
            best: dict[int, list[tuple[float, object]]] = {}

            def first(held: list[tuple[float, object]]) -> list[tuple[float, object]]:
                held = sorted(held)
                if repeated:
                    seen = set()
                    held = [h for h in held if not (h[1] in seen or seen.add(h[1]))]
                return held[:k]

            for batch in batches:
                for lo in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(lo, ROW_BLOCK)
                    keys = part.column(0).to_pylist()
                    if repeated:
                        coded = part.column(0).dictionary_encode()
                        keys, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                    for n, (at, m) in asked.items():
                        scores = m @ unit_rows(part.column(1), n).T
                        for j, i in enumerate(at):
                            row = scores[j]
                            if repeated:
                                row = np.full(len(keys), -np.inf)
                                np.maximum.at(row, codes, scores[j])
                            hit = np.flatnonzero(row >= min_score)
                            if len(hit) > k:
                                edge = np.partition(row[hit], -k)[-k]
                                hit = hit[row[hit] >= edge - 1e-12]
                            if len(hit):
                                held = best.setdefault(i, [])
                                held += [(-float(row[h]), keys[h]) for h in hit]
                                if len(held) > 4 * k:
                                    held[:] = first(held)
            out = [(rows[i][0], key_, -s) for i, held in best.items() for s, key_ in first(held)]
            a, c, d = zip(*out, strict=True) if out else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(a, to_arrow_type(q_type)), pa.array(c, to_arrow_type(k_type)), pa.array(d, pa.float64())], [query, key, "score"])

        parts.append(nodes.select(key, vector).mapInArrow(run, schema))
    if not parts:
        return nodes.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    if repeated:
        found = found.groupBy(query, key).agg(F.max("score").alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
