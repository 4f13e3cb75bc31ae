"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits, or as many times 64 as vectors ask for, are cut into m segments of about log2(N) bits, each with a table. A query probes
its segments at growing radii. Once radius r is done for a segments and r - 1 for the others, every
code within m * r + a - 1 bits has been met (Norouzi et al., 2012), so a query whose k-th verified
distance is no more than that is finished and drops out. Until then it only takes what its k-th
distance so far allows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.simhash import segments_of
from quillgraph.plans.lineage import cut

#: Up to this radius all segments are probed at once, from then on one at a time.
TOGETHER = 2


def sign_code(vector: str, words: int = 1) -> Column:
    """Bit i is set if component i is above 0; null if the vector is. A struct of ``words`` longs of 64 bits, ``c0`` first."""

    def word(n: int) -> Column:
        part = F.slice(F.col(vector), 64 * n + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(F.col(vector).isNotNull(), F.struct(*(word(n).alias(f"c{n}") for n in range(words))))


def _flipped(active: DataFrame, own: Column, width: int, radius: int) -> DataFrame:
    """``(q, bound, val)``: ``own`` with each choice of ``radius`` of its ``width`` bits flipped, one bit after the other."""
    out = active.select("q", "bound", own.alias("val"), F.lit(0).alias("next"))
    for left in range(radius, 0, -1):
        bit = F.explode(F.sequence(F.col("next"), F.lit(width - left)))
        out = out.select("q", "bound", "val", bit.alias("bit"))
        out = out.select("q", "bound", F.expr("val ^ shiftleft(1L, bit)").alias("val"), (F.col("bit") + 1).alias("next"))
    return out.drop("next")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest codes of each query code; ties by the least key that has the code."""
    order = Window.partitionBy("q").orderBy("distance", "least")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, key, distance)``: for each row that ``queries`` holds for, its ``k`` nearest of all rows.

    Distances are Hamming distances of sign codes; ties go to the lesser key; a row is also among
    its own answers. Equal codes are searched once and hold at most ``k`` keys, so copies cost
    nothing. Rows without a vector are neither asked nor found; fewer than ``k`` rows give fewer
    answers; rows that repeat are found each time; a vector shorter than others has no bits where it ends;
    other columns are ignored.
    """
    words = max(1, -(-(rows.agg(F.max(F.size(vector))).first()[0] or 1) // 64))
    coded = cut(rows.select(F.col(key).alias("key"), sign_code(vector, words).alias("code"), F.coalesce(queries, F.lit(False)).alias("asks")).where("code is not null"))
    keys = cut(coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("key"))).where(F.col("n") <= k).select("code", "key", "n"))
    codes = keys.where("n = 1").select("code", F.col("key").alias("least"))
    size = codes.count()
    each = max(1, min(32, math.ceil(64 / max(2, math.floor(math.log2(max(size, 2)))))))
    cuts = [(n, at, width) for n in range(words) for at, width, _ in segments_of(0, each)]
    segments, most = len(cuts), 64 * words

    def value(code: str, n: int, at: int, width: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{code}.c{n}"), at).bitwiseAND(F.lit((1 << width) - 1))

    asked = coded.where("asks").select(F.col("code").alias("q")).distinct()
    active, best = cut(asked.withColumn("bound", F.lit(most))), None
    steps = [[(s, r) for s in range(segments)] for r in range(TOGETHER + 1)]
    steps += [[(s, r)] for r in range(TOGETHER + 1, max(w for _, _, w in cuts) + 1) for s in range(segments)]
    for step in steps:
        found = None
        for s in sorted({s for s, _ in step}):
            n, at, width = cuts[s]
            radii = [r for t, r in step if t == s and r <= width]
            if not radii:
                continue
            probes = reduce(DataFrame.unionAll, (_flipped(active, value("q", n, at, width), width, r) for r in radii))
            index = codes.select("code", "least", value("code", n, at, width).alias("val"))
            distance = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"q.c{w}").bitwiseXOR(F.col(f"code.c{w}"))) for w in range(words)))
            met = probes.join(index, "val").where(distance <= F.col("bound")).select("q", "code", "least", distance.alias("distance"))
            found = met if found is None else found.unionAll(met)
        if found is not None:
            found = _best(found.distinct(), k).drop("rank")
            best = cut(_best(found if best is None else found.unionAll(best.drop("rank")).distinct(), k))
        last_segment, radius = step[-1]
        covered = segments * radius + last_segment  # m * r + a - 1 with a = last_segment + 1
        kth = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        kth = kth.withColumn("bound", F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(most))).select("q", "bound")
        active = cut(active.select("q").join(kth, "q", "left").select("q", F.coalesce("bound", F.lit(most)).alias("bound")).where((F.col("bound") > covered)))
        if covered >= most or active.isEmpty():
            break
    near = best.select("q", "code", "distance").join(keys, "code")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "key"))).where(F.col("rank") <= k)
    asking = coded.where("asks").select(F.col("key").alias("query_id"), F.col("code").alias("q"))
    return asking.join(ranked.select("q", "rank", "key", "distance"), "q").select("query_id", "rank", F.col("key").alias(key), "distance")
