"""All pairs of vectors over a cosine, exactly, by metric partitioning.

Angles between vectors obey the triangle inequality. Each vector belongs to the cell of its nearest
pivot; a pair within the threshold's angle either shares a cell, or one of the two reaches into the
other's. Which cells a vector can reach follows from its angles to the pivots alone, so most rows
never meet; inside a cell, groups of near vectors with a centre and a radius rule out each other the
same way before any product is taken. Where a sample shows that cells would rule out little, all rows
are one cell, which costs one comparison a pair and not one for each cell that both reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vector import unit_rows
from quillgraph.plans.lineage import cut

#: Vectors that pivots are picked from, pivots at most, rows of a group in a task, blocks that are not worth pivots.
SAMPLE, PIVOTS, LEAF, FEW_BLOCKS = 4096, 256, 64, 4
#: What angles may be off by in double precision, as vectors are compared by their cosine.
SLACK = 1e-6
#: Blocks of a cell before blocks grow, the rows that a block has at most then, and the share of a plain comparison that cells must cost less than.
BLOCKS, MOST_ROWS, WORTH = 16, 1 << 15, 1.0


def farthest_first(unit: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows, each the one farthest from all before it; equal rows are picked once."""
    if not len(unit):
        return unit
    picked, nearest = [0], unit @ unit[0]
    while len(picked) < k:
        at = int(np.argmin(nearest))
        if nearest[at] > 1 - 1e-9:
            break
        picked.append(at)
        nearest = np.maximum(nearest, unit @ unit[at])
    return unit[picked]


def angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def leaves(unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Rows in groups of ``LEAF`` at most, each with its centre and the largest angle to it: halves along the line of two far rows."""
    out, todo = [], [np.arange(len(unit))] if len(unit) else []
    while todo:
        rows = todo.pop()
        part = unit[rows]
        if len(rows) > LEAF:
            a = part[int(np.argmin(part @ part[0]))]
            b = part[int(np.argmin(part @ a))]
            order = np.argsort(part @ (a - b), kind="stable")
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            continue
        centre = part.sum(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-9 else part[0]
        out.append((rows, centre, float(angles(part, centre[None]).max())))
    return out


def near_rows(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of unit vectors whose cosine is ``threshold`` or more, it, and how many pairs were compared; each row of ``left`` in one part.

    Products in single precision, off by no more than a slack, tell which cosines are taken in double precision.
    """
    a, b = leaves(left), leaves(right)
    if not a or not b:
        return
    slack = 1e-6 + 1.2e-7 * left.shape[1]
    apart = angles(np.array([x[1] for x in a]), np.array([x[1] for x in b]))
    reach = np.array([x[2] for x in a])[:, None] + np.array([x[2] for x in b])[None] + np.arccos(np.clip(threshold, -1, 1)) + SLACK
    whole = np.concatenate([x[0] for x in b])
    few, all_few = left.astype(np.float32), right[whole].astype(np.float32)
    ends = np.cumsum([len(x[0]) for x in b])
    for i, (rows, _, _) in enumerate(a):
        meet = np.flatnonzero(apart[i] <= reach[i])
        if not len(meet):
            continue
        at = slice(None) if len(meet) == len(b) else np.concatenate([np.arange(ends[j] - len(b[j][0]), ends[j]) for j in meet])
        others = whole[at]
        x, y = np.nonzero(few[rows] @ all_few[at].T >= threshold - slack)
        x, y = rows[x], others[y]
        s = np.einsum("ij,ij->i", left[x], right[y])
        hit = s >= threshold
        yield x[hit], y[hit], s[hit], len(rows) * len(others)


def _cells(rows: DataFrame, threshold: float, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` ``(k, v, side)`` with ``cell`` and ``home``: their own cell and each other one of a lower number that they reach.

    A vector's pair in another cell is no farther from that cell's pivot than the cell's radius, and no
    farther than its own pivot, so the vector itself is within the radius and the threshold's angle, and
    within twice that angle of its nearest pivot's distance.
    """
    theta = float(np.arccos(np.clip(threshold, -1, 1)))
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors of each length at most
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def homes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        sizes = batch.column("v").value_lengths().to_numpy()
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            if n in sent.value:
                yield n, at, angles(unit_rows(batch.column("v").take(pa.array(at)), n), sent.value[n])
            else:  # a length that the sample lacks is one cell
                yield n, at, np.zeros((len(at), 1))

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple[int, int], float] = {}
        for batch in batches:
            for n, _, far in homes(batch):
                home = far.argmin(axis=1)
                for c in np.unique(home).tolist():
                    most[n, c] = max(most.get((n, c), 0.0), float(far[home == c, c].max()))
        keys = list(most)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(most.values()), pa.float64())], ["n", "c", "r"])

    wide = rows.mapInArrow(radii, "n int, c int, r double").groupBy("n", "c").agg(F.max("r").alias("r")).collect()  # a row a cell
    radius = {n: np.full(len(p), -10.0) for n, p in pivots.items()}
    for r in wide:
        if r["n"] in radius:
            radius[r["n"]][r["c"]] = r["r"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, far in homes(batch):
                home = far.argmin(axis=1)
                near = far[np.arange(len(at)), home]
                visits = (far <= radius[n][None] + theta + SLACK) & (far <= near[:, None] + 2 * theta + SLACK) if n in radius else np.zeros(far.shape, bool)
                visits &= np.arange(far.shape[1])[None] < home[:, None]
                visits[np.arange(len(at)), home] = True
                x, c = np.nonzero(visits)
                part = batch.take(pa.array(at[x]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), n, np.int32)), pa.array(c.astype(np.int32)), pa.array(home[x] == c)], [*batch.schema.names, "n", "cell", "home"])

    return rows.mapInArrow(spread, f"{schema}, n int, cell int, home boolean")


def _pivots(rows: DataFrame, count: int, block_rows: int, threshold: float) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors in a sample of ``SAMPLE`` rows, as many as blocks, ``PIVOTS`` at most; for lengths where cells pay."""
    sample = rows.select("k", "v").orderBy(F.xxhash64("k")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sizes = sample.value_lengths().to_numpy()
    wanted = min(PIVOTS, -(-count // block_rows))
    out = {}
    for n in np.unique(sizes).tolist():
        unit = unit_rows(sample.take(pa.array(np.flatnonzero(sizes == n))), n)
        picked = farthest_first(unit, wanted)
        if _worth(unit, picked, threshold):
            out[n] = picked
    return out


def _worth(unit: np.ndarray, pivots: np.ndarray, threshold: float) -> bool:
    """Whether cells about the pivots save enough of a plain comparison, by the cells that the sample's rows reach."""
    theta, far = float(np.arccos(np.clip(threshold, -1, 1))), angles(unit, pivots)
    home = far.argmin(axis=1)
    near = far[np.arange(len(far)), home]
    radius = np.full(len(pivots), -10.0)
    np.maximum.at(radius, home, near)
    visits = (far <= radius[None] + theta) & (far <= near[:, None] + 2 * theta) & (np.arange(len(pivots))[None] <= home[:, None])
    return float((visits.sum(axis=0) / len(far)) @ (visits.sum(axis=0) / len(far))) < WORTH


def _blocks(rows: Column, block_rows: int) -> Column:
    """Blocks for so many rows: of ``block_rows`` up to ``BLOCKS``, which then grow to ``MOST_ROWS``, so a row is sent to few tasks."""
    size = F.least(F.greatest(F.lit(block_rows), F.ceil(rows / BLOCKS)), F.lit(max(block_rows, MOST_ROWS)))
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each row is joined to, after pairs of rows were joined as well."""
    while True:
        p, q = label[x], label[y]
        new = p != q
        if not new.any():
            return label
        x, y, p, q = x[new], y[new], p[new], q[new]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def _compared(rows: DataFrame, threshold: float, block_rows: int, what: str, limit: int = 1, skip: float | None = None) -> DataFrame:
    """What is found of ``rows`` ``(k, v, side)``: rows of side 0 meet each other, rows of side 1 those of side 2.

    ``what`` is ``pairs`` ``(a, b, score)``; ``best``, of these the ``limit`` best of each ``a`` in a
    task; ``degrees`` ``(a, n)``, how many others a key has in a task; ``links`` ``(a, b)``, which
    connect what all pairs connect; or ``costs`` ``(rows, pairs, compared)``. The last four send on no
    more than the rows that a task has. ``skip`` leaves out pairs of that score whose ``a`` is less.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["k"].dataType
    key_type = to_arrow_type(kind)
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0))
    count = rows.count()
    pivots = {} if count <= FEW_BLOCKS * block_rows or threshold <= 0 else _pivots(rows, count, block_rows, threshold)  # at a right angle or more nothing can be ruled out
    if pivots:
        placed = cut(_cells(rows, threshold, pivots))
    else:
        placed = rows.withColumns({"n": F.size("v") if threshold > 0 else F.lit(0), "cell": F.lit(0), "home": F.lit(True)})
    sizes = placed.groupBy("n", "cell").agg(*(_blocks(F.count_if(side), block_rows).alias(c) for c, side in (("across", F.col("side") <= 1), ("down", F.col("side") != 1))))
    dealt = placed.join(F.broadcast(sizes), ["n", "cell"])  # a row a cell
    own = lambda c: F.pmod(F.xxhash64("k"), F.col(c)).cast("int")
    each = lambda c, i, j: F.transform(F.sequence(F.lit(0), F.col(c) - 1), lambda o: F.struct(i(o).alias("i"), j(o).alias("j")))
    meets = (
        F.when(F.col("side") == 0, each("across", lambda o: F.least(own("across"), o), lambda o: F.greatest(own("across"), o)))
        .when(F.col("side") == 1, each("down", lambda o: own("across"), lambda o: o)).otherwise(each("across", lambda o: o, lambda o: own("down")))
    )
    spread = dealt.select("n", "cell", F.explode(meets).alias("p"), own("across").alias("own"), "home", "side", "k", "v").select("n", "cell", "p.i", "p.j", "own", "home", "side", "k", "v")
    name = kind.simpleString()
    schema = {"pairs": f"a {name}, b {name}, score double", "best": f"a {name}, b {name}, score double", "degrees": f"a {name}, n bigint", "links": f"a {name}, b {name}", "costs": "rows long, pairs long, compared long"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        i, j, n = (table.column(c)[0].as_py() for c in ("i", "j", "n"))
        keys, vectors = table.column("k").combine_chunks(), table.column("v").combine_chunks()
        own, home, side = (table.column(c).to_numpy() for c in ("own", "home", "side"))
        m = unit_rows(vectors, n or int(vectors.value_lengths().to_numpy().max(initial=0)))
        rank = pc.rank(keys, tiebreaker="dense").to_numpy().astype(np.int64)
        at = np.arange(len(rank))
        if len(np.unique(rank * 3 + side)) < len(rank):  # repeated rows of a key count once
            at = np.unique(np.column_stack((rank, side, (m + 0.0).view(np.int64))), axis=0, return_index=True)[1]
        two = bool(side[0])
        left, right = (at[side[at] == 1], at[side[at] == 2]) if two else (at[own[at] == i], at[own[at] == j])
        compared, degrees, label = 0, np.zeros(len(rank), np.int64), np.arange(len(rank))
        for x, y, s, tried in near_rows(m[left], m[right], threshold):
            compared += tried
            if what == "costs":
                continue
            x, y = left[x], right[y]
            fits = home[x] | home[y]
            if not two:
                fits &= rank[x] < rank[y] if i == j else rank[x] != rank[y]
            elif what == "degrees":
                fits &= rank[x] != rank[y]
            elif what == "best":
                fits &= (rank[x] > rank[y]) | ((rank[x] < rank[y]) & (s < (2.0 if skip is None else skip)))
            x, y, s = x[fits], y[fits], s[fits]
            if what == "links":
                label = _joined(label, x, y)
            elif what == "degrees":
                degrees += np.bincount(x, minlength=len(rank)) + (0 if two else np.bincount(y, minlength=len(rank)))
            elif len(x):
                if what == "best":
                    order = np.lexsort((rank[y], -s, x))
                    x, y, s = x[order], y[order], s[order]
                    first = np.searchsorted(x, x)
                    x, y, s = (c[np.arange(len(x)) - first < limit] for c in (x, y, s))
                elif not two:
                    x, y = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)).cast(key_type), keys.take(pa.array(y)).cast(key_type), pa.array(s)], ["a", "b", "score"])
        if what == "costs":
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (table.num_rows, len(left) * len(right), compared)], ["rows", "pairs", "compared"])
        elif what == "degrees":
            x = np.flatnonzero(degrees)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)).cast(key_type), pa.array(degrees[x])], ["a", "n"])
        elif what == "links":
            x = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)).cast(key_type), keys.take(pa.array(label[x])).cast(key_type)], ["a", "b"])

    return spread.groupBy("n", "cell", "i", "j").applyInArrow(run, schema)


def _side(df: DataFrame, side: int, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(side).alias("side"))


def similar_pairs(nodes: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(a, b, score)`` with ``a < b`` for all pairs of cosine at least ``threshold``, exactly.

    Vectors of different lengths are no pair, and no vector of norm 0 is one at a threshold above 0.
    Cells of more than ``block_rows`` rows are dealt to blocks, each pair of which is a task. How much
    is ruled out depends on the data: vectors in clusters meet few others, vectors spread evenly over
    many dimensions all of them; ``pair_costs`` tells.
    """
    return _compared(_side(nodes, 0, key, vector), threshold, block_rows, "pairs")


def similar_between(new: DataFrame, known: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(a, b, score)``: a row of ``new`` and one of ``known`` of cosine at least ``threshold``, whatever their keys; exactly."""
    return _compared(_side(new, 1, key, vector).unionAll(_side(known, 2, key, vector)), threshold, block_rows, "pairs")


def best_between(
    new: DataFrame, known: DataFrame, threshold: float, limit: int = 1, key: str = "id", vector: str = "embedding", block_rows: int = 2048, skip: float | None = None
) -> DataFrame:
    """``(a, b, score)``: for each row of ``new`` the ``limit`` best of ``known`` under other keys, ties by key; exactly.

    A task sends on its own best only. Rows of ``known`` that are ``skip`` or more alike don't count for a lesser key.
    """
    found = _compared(_side(new, 1, key, vector).unionAll(_side(known, 2, key, vector)), threshold, block_rows, "best", limit, skip)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def similar_counts(nodes: DataFrame, threshold: float, known: DataFrame | None = None, key: str = "id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(id, n)``: with how many others a row is a pair of ``similar_pairs``, if with any; with ``known``, how many of these are like it."""
    rows = _side(nodes, 0, key, vector) if known is None else _side(nodes, 1, key, vector).unionAll(_side(known, 2, key, vector))
    return _compared(rows, threshold, block_rows, "degrees").groupBy(F.col("a").alias(key)).agg(F.sum("n").alias("n"))


def similar_links(nodes: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """``(a, b)`` that connect the nodes as all pairs of ``similar_pairs`` do: a task sends on a star for each part of its own graph."""
    return _compared(_side(nodes, 0, key, vector), threshold, block_rows, "links")


def pair_costs(nodes: DataFrame, threshold: float, key: str = "id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """One row ``(nodes, all_pairs, rows, pairs, compared)``: rows sent to tasks, pairs that meet there, and pairs whose product is taken.

    Of pairs that meet, those of one block count twice, as they are compared in both orders.
    """
    n = F.col("nodes")
    total = nodes.agg(F.count(vector).alias("nodes")).withColumn("all_pairs", (n * (n - 1) / 2).cast("long"))
    costs = _compared(_side(nodes, 0, key, vector), threshold, block_rows, "costs")
    return total.join(F.broadcast(costs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "pairs", "compared")))))
