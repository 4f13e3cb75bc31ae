"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by its weight, but no more than ``max_epochs`` times its own
size; what a clamped source can't take goes to the others by weight until no share is above its
cap. Whole repetitions are taken of every document, and the fraction left over of documents in a
seeded order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD
from quillgraph.plans.lineage import cut

#: A source's seeded order is cut by leading bits of a hash, as many as its rows ask for and so many at a time, until the part
#: where its target is passed has no more rows than this; that part alone is looked at row by row, and a source of no more rows
#: as a whole. Rows alike in all bits are one unit.
STEP, BITS, PART_ROWS = 8, 56, 4096
#: Documents of that part that are put in another's place at most.
SWAPS = 64


def water_fill(sizes: list[float], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Targets that sum to ``budget`` where the caps allow: the largest scale s with min(s * weight, cap) feasible."""
    caps = [max_epochs * s for s in sizes]
    targets, free, left = [0.0] * len(sizes), [i for i, c in enumerate(caps) if c > 0 and weights[i] > 0], float(budget)
    while free:
        scale = left / sum(weights[i] for i in free)
        over = [i for i in free if scale * weights[i] >= caps[i]]
        if not over:
            for i in free:
                targets[i] = scale * weights[i]
            break
        for i in over:
            targets[i] = float(caps[i])
            left -= caps[i]
        gone = set(over)
        free = [i for i in free if i not in gone]
    return targets


def cycle_weights(sources: list, cycle: tuple = (5.0, 2.0, 1.0)) -> list[float]:
    return [float(cycle[i % len(cycle)]) for i in range(len(sources))]


def seeded_order(seed: int, key: str, text: str) -> Column:
    """A hash of the key and the text, by which a source's rows are drawn; repeated rows have the same."""
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def _top(depth: str, h: str = "h") -> Column:
    """The first ``depth`` bits of a hash as a number."""
    return F.expr(f"if({depth} = 0, 0L, shiftrightunsigned({h}, 64 - {depth}))")


def _step(rows: int) -> int:
    """Bits by which a part of so many rows is cut next, so that about half of ``PART_ROWS`` are left or ``STEP`` bits are used."""
    return max(1, min(STEP, (2 * rows // PART_ROWS).bit_length()))


def chosen(sizes: np.ndarray, room: int) -> np.ndarray:
    """Which of the sizes are taken: in order each that still fits; then one is put in another's place while that fills more."""
    taken = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes.tolist()):
        if 0 < n <= room:
            taken[i] = True
            room -= n
    for _ in range(SWAPS):
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken & (sizes > 0))
        if not room or not len(inside) or not len(outside):
            break
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        at = np.searchsorted(sizes[outside], sizes[inside] + room, "right") - 1  # the largest that fits in each one's place
        gain = np.where(at >= 0, sizes[outside[np.maximum(at, 0)]] - sizes[inside], 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        taken[inside[best]], taken[outside[at[best]]] = False, True
        room -= int(gain[best])
    return taken


def _draw(rows: DataFrame, share: float, max_epochs: float, weights: Callable[[list], list[float]]) -> tuple[DataFrame, DataFrame]:
    """One row a source, ``(source, source_size, target, whole, depth, part)``, and what its part gives, ``(source, h)``.

    Of a source's rows, those whose first ``depth`` bits are below ``part`` are drawn once more, and
    in the part those that are listed. ``rows`` has ``(source, size, h)``.
    """
    spark = rows.sparkSession
    sums = [(r["source"], r["size"], r["rows"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()]
    sums.sort(key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n, _ in sums]
    targets = water_fill(sizes, weights([s for s, _, _ in sums]), share * sum(sizes), max_epochs)
    whole, found, open_parts, done = [], {}, {}, []
    # for each source the part that its target falls into: bits, their value, and the words that are left for it
    for (s, n, count), t in zip(sums, targets, strict=True):
        times = min(int(t // n), int(max_epochs)) if n else 0
        room = int(round(t - times * n))
        if n and room >= n:  # the target is, but for rounding, one more copy of everything
            times, room = times + 1, 0
        whole.append(times)
        found[s] = (0, 0) if room > 0 and count <= PART_ROWS else (STEP, 0)
        if room > 0 and count <= PART_ROWS:
            done.append((s, 0, 0, room))
        elif room > 0:
            open_parts[s] = (0, 0, _step(count), room)
    small: list[DataFrame] = []
    same = F.col("r.source").eqNullSafe(F.col("q.source"))
    fields = "source string, depth int, part long, room long"

    def listed_part(parts: list[tuple]) -> DataFrame:
        state = spark.createDataFrame(parts, fields)
        return rows.alias("r").join(F.broadcast(state.alias("q")), same & (_top("q.depth", "r.h") == F.col("q.part"))).select("r.source", "r.size", "r.h", "q.room")

    while done or open_parts:
        if done:
            small.append(listed_part(done))
        if not open_parts:
            break
        state = spark.createDataFrame([(s, d, p, r, step) for s, (d, p, step, r) in open_parts.items()], fields + ", step int")
        inside = rows.alias("r").join(F.broadcast(state.alias("q")), same & (_top("q.depth", "r.h") == F.col("q.part")))
        deeper = inside.select("r.source", "r.size", "q.room", (F.col("q.depth") + F.col("q.step")).alias("depth"), _top("(q.depth + q.step)", "r.h").alias("part"))
        by_part = deeper.groupBy("source", "room", "depth", "part").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        edge = by_part.withColumn("upto", upto).where("upto > room").groupBy("source").agg(F.min_by(F.struct("depth", "part", "rows", (F.col("room") - F.col("upto") + F.col("n")).alias("left")), "part").alias("e"))
        edges = {r["source"]: r["e"] for r in edge.collect()}
        found |= {s: (e["depth"], e["part"]) for s, e in edges.items()}
        done = [(s, e["depth"], e["part"], e["left"]) for s, e in edges.items() if e["rows"] <= PART_ROWS and e["left"] > 0]
        open_parts = {s: (e["depth"], e["part"], min(_step(e["rows"]), BITS - e["depth"]), e["left"]) for s, e in edges.items() if e["rows"] > PART_ROWS and e["depth"] < BITS and e["left"] > 0}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        units = group.assign(order=group["h"].astype("uint64")).groupby("order").agg(h=("h", "first"), size=("size", "sum")).sort_index()
        taken = chosen(units["size"].to_numpy(), int(group["room"].iloc[0]))
        name = None if pd.isna(group["source"].iloc[0]) else str(group["source"].iloc[0])
        return pd.DataFrame({"source": pd.Series([name] * int(taken.sum()), dtype=object), "h": units["h"].to_numpy()[taken].astype("int64")})

    listed = spark.createDataFrame([], "source string, h long")
    if small:
        listed = cut(reduce(DataFrame.unionAll, small).groupBy("source").applyInPandas(fit, listed.schema))
    plan = [(s, n, float(t), w, *found[s]) for (s, n, _), t, w in zip(sums, targets, whole, strict=True)]
    return spark.createDataFrame(plan, "source string, source_size long, target double, whole int, depth int, part long"), listed


def _drawn(rows: DataFrame, plan: DataFrame, listed: DataFrame, more: str) -> DataFrame:
    """``rows`` with the plan's columns and ``more``, 1 if a row is drawn once more; only rows of the parts are shuffled."""
    spare = [c for c in ("source_size", "target", "whole") if c in plan.columns]
    known = rows.alias("r").join(F.broadcast(plan.alias("q")), F.col("r.source").eqNullSafe(F.col("q.source")))
    known = known.select("r.*", *(f"q.{c}" for c in spare), (_top("q.depth", "r.h") - F.col("q.part")).alias("off"))
    rest = known.where("off <> 0").withColumn(more, ((F.col("off") < 0) & (F.col("size") > 0)).cast("int"))
    at = known.where("off = 0").alias("k").join(listed.withColumn("hit", F.lit(1)).alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")) & (F.col("k.h") == F.col("t.h")), "left")
    return rest.unionByName(at.select("k.*", F.coalesce("t.hit", F.lit(0)).alias(more))).drop("off")


def mix(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: Callable[[list], list[float]] = cycle_weights,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``(key, source, size, source_size, target, copies, taken)`` for every row.

    ``weights`` gets the sources by code point, null last. A document's ``copies`` are the whole
    repetitions of its source plus one if the fraction takes it. The fraction takes documents in the
    order of a seeded hash up to the part where the target is passed, and in that part each one that
    still fits; then some give way to others that fill more. So a source misses its target (in whole
    words) by less than its smallest filled document left out there. For a source of up to ``PART_ROWS`` rows that part is the whole source, else some
    thousand rows. A target within half a word of a whole number of copies is that number of copies.
    Which ones depends on nothing but the source's own rows and its target. Sizes are words; a null
    or blank text has 0 and comes with whole repetitions only. Rows that repeat are drawn together,
    different texts of one key apart, rows without a key like any other. An empty table gives no
    rows. Other columns are ignored. One row a source is collected; no other size depends on the data.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(key), F.col(source).alias("source"), size.alias("size"), seeded_order(seed, key, text).alias("h")))
    out = _drawn(rows, *_draw(rows, share, max_epochs, weights), "more")
    copies = F.col("whole") + F.col("more")
    return out.select(key, "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(
    docs: DataFrame,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: Callable[[list], list[float]] = cycle_weights,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, all columns kept.

    A row's copies follow from its own source, key and text, so rows without a key, repeated rows and
    columns of any name do no harm, and no text is shuffled but those of the parts where targets are
    passed. Blank texts come with whole repetitions only; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(source).alias("source"), size.alias("size"), seeded_order(seed, key, text).alias("h")))
    plan, listed = _draw(rows, share, max_epochs, weights)
    filled = F.coalesce(F.col(text).rlike(WORD), F.lit(False)).cast("int")
    held = docs.select(F.col(source).alias("source"), seeded_order(seed, key, text).alias("h"), filled.alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = _drawn(held, plan, listed, "more").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("whole") + F.col("more"))))
    return out.select("row.*")
