"""Connected components of an undirected edge list, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.lineage import Scratch, cut, remove


def _settled(star: DataFrame) -> bool:
    """Whether each upper end has one lower end that is no upper end itself, so all edges lead to the least node."""
    ends = star.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(star.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _round(star: DataFrame, scratch: Scratch) -> DataFrame:
    """A large-star and a small-star step: the next edges; the ones before go."""
    both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = (
        large.join(lowest, "hi")
        .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        .unionAll(lowest.select("hi", F.col("m").alias("lo")))
        .distinct()
    )
    found, last = scratch.keep(small), scratch.tables - 1
    remove(star.sparkSession, f"{scratch.path}/{last}")
    return found


def connected_components(edges: DataFrame, source: str, target: str, max_rounds: int = 100) -> DataFrame:
    """Return ``(node, component)`` for every node that has an edge; the component is its least node.

    Large-star and small-star steps alternate (Kiveris et al., 2014), which takes a number of rounds
    that grows with the logarithm of a component's size and keeps the number of edges from growing.
    Minima are map-side combined, and each join's other side has one row a node, so a hub splits as
    any skewed join does. Null ends and self-loops are ignored. Each round is a table in the shared
    folder, read in as few parts as its size asks for, and goes once the next one is written.
    """
    ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    with Scratch(edges.sparkSession) as scratch:
        star = scratch.keep(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
        for _ in range(max_rounds):
            if _settled(star):
                break
            star = _round(star, scratch)
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        star = cut(star)
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        star.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
