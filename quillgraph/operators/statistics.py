"""Statistics over scores and ratings. All are aggregates or windows; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vector import unit_rows
from quillgraph.plans.lineage import cut

#: Bits of a hash by which a permutation's last row is looked for at a time, and rows among which it is then found by rank.
STEP_BITS, EDGE_ROWS = 12, 1 << 16


def pearson(x: str, y: str) -> Column:
    """Correlation over rows where both are there; 0 if either does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    n, sa, sb = F.count(a), F.sum(a), F.sum(b)
    cov = F.sum(a * b) - sa * sb / F.nullif(n, F.lit(0))
    va, vb = F.sum(a * a) - sa * sa / F.nullif(n, F.lit(0)), F.sum(b * b) - sb * sb / F.nullif(n, F.lit(0))
    flat = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(flat, cov / F.sqrt(F.nullif(va * vb, F.lit(0.0)))).otherwise(0.0)


def spearman(df: DataFrame, x: str, y: str, order: str, method: str = "min", by: list[str] | None = None) -> DataFrame:
    """Rank correlation as ``rho`` by group; ``min`` gives ties the least rank, ``ordinal`` their input order."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> Column:
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) if method == "min" else F.row_number().over(w.orderBy(c, order))

    ranked = rows.withColumns({"_x": ranks(x).cast("double"), "_y": ranks(y).cast("double")})
    return ranked.groupBy(*by).agg(pearson("_x", "_y").alias("rho"), F.count("*").alias("n"))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"))


def mean_abs_delta(x: str, y: str) -> Column:
    return F.avg(F.abs(F.col(x) - F.col(y)))


def dimension_means(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """``(dimension, mean, n)`` over non-null scores."""
    long = df.unpivot([], [F.col(d).cast("double").alias(d) for d in dimensions], "dimension", "value")
    return long.where("value is not null").groupBy("dimension").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def row_mean(*columns: str) -> Column:
    """Mean of a row's non-null numbers; null without any."""
    kept = F.array_compact(F.array(*(F.col(c).cast("double") for c in columns)))
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(kept), F.lit(0))


def slope(y: str, x: str) -> Column:
    """Least-squares slope; null under two rows, 0 if x does not vary."""
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return F.when(n < 2, F.lit(None)).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(0.0)))


def attractor(y: str, x: str) -> Column:
    """``(strength, position)`` of a map's fixed point: 1 - slope, intercept / (1 - slope)."""
    s = F.regr_slope(y, x)
    return F.struct((1 - s).alias("strength"), F.try_divide(F.regr_intercept(y, x), 1 - s).alias("position"))


def at_least(n: int, value: Column) -> Column:
    """An aggregate only for groups of ``n`` rows or more."""
    return F.when(F.count("*") >= n, value)


def cohens_d(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Effect size of group ``a`` against ``b`` with the pooled sample deviation."""
    g = lambda x, f: f(F.when(F.col(group) == x, F.col(value)))
    s = df.agg(
        g(a, F.count).alias("na"), g(b, F.count).alias("nb"), g(a, F.avg).alias("ma"), g(b, F.avg).alias("mb"), g(a, F.var_samp).alias("va"), g(b, F.var_samp).alias("vb")
    )
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.nullif(F.col("na") + F.col("nb") - 2, F.lit(0)))
    return s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "na", "nb", F.try_divide(F.col("ma") - F.col("mb"), pooled).alias("d"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Adds ``avg_rank`` (ties share their mean) and ``tied``.

    Distinct values are counted and sorted in ranges; running sums go within a range, and the sums of
    the ranges before, one row a range, are added.
    """
    ranges = df.groupBy(value).agg(F.count("*").alias("_n")).repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    ranges = cut(ranges)
    within = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.groupBy("_part").agg(F.sum("_n").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", before.alias("_before"))
    counts = ranges.withColumn("_upto", F.sum("_n").over(within)).join(F.broadcast(starts), "_part")
    counts = counts.select(value, F.col("_n").alias("tied"), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("avg_rank"))
    return df.join(counts, value)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(h, df)``: the rank test over groups, corrected for ties."""
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value)
    groups = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("avg_rank").alias("r"))
    h = groups.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("total"), (F.count("*") - 1).alias("df"))
    ties = ranked.select(value, "tied").distinct().agg(F.sum(F.pow("tied", F.lit(3)) - F.col("tied")).alias("t"))
    n = F.col("total")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.join(F.broadcast(ties)).select((raw / (1 - F.col("t") / (F.pow(n, F.lit(3)) - n))).alias("h"), "df")


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adds ``p_holm``: step-down adjusted p-values, running maximum, at most 1. A family of tests is small."""
    order = Window.orderBy(p, key)
    out = df.withColumns({"_i": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy())})
    scaled = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_i") + 1))
    return out.withColumn("p_holm", F.max(scaled).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m")


def uniform(*keys: Column) -> Column:
    """A number from 0 to below 1 that any engine makes of the same keys: eight digits of an MD5."""
    text = F.concat_ws(":", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def bootstrap_ci(df: DataFrame, value: str, by: list[str], key: str, reps: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of the mean by resampling: each row weighs Poisson(1) in each replicate, by a hash, so reruns agree.

    Replicates are aggregated map-side; a group sends ``reps`` rows a task whatever its size.
    """
    u = uniform(F.col(key), F.col("rep"), F.lit(seed))
    cumulative, p, weight = 0.0, 0.36787944117144233, F.lit(7)
    steps = []
    for k in range(7):
        cumulative += p
        steps.append((cumulative, k))
        p /= k + 1
    for c, k in reversed(steps):
        weight = F.when(F.col("_u") < c, k).otherwise(weight)
    each = df.where(F.col(value).isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_u", u).withColumn("_w", weight)
    means = each.groupBy(*by, "rep").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("m"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("m", lo).alias("lo"), F.percentile("m", hi).alias("hi"), F.count("m").alias("reps"))


def permutation_test(df: DataFrame, value: str, group: str, a, b, key: str, reps: int = 200, seed: int = 42) -> DataFrame:
    """``(difference, p, reps)``: two-sided test of the means of ``a`` and ``b`` by permutations.

    In each replicate as many rows as ``a`` has, those of the least hashes of their key, stand for ``a``.
    Where that many end is found by the hash's leading bits, ``STEP_BITS`` at a time: counts and sums by
    part, a few thousand rows a replicate, tell which part the last row lies in, and only that part is
    looked at closer, row by row once it has ``EDGE_ROWS`` rows at most. Nothing is sorted as a whole.
    Null values are left out; rows of one key and replicate are in order of their value.
    """
    rows = cut(df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), (F.col(group) == a).alias("in_a")))
    seen = rows.agg(F.count_if("in_a").alias("na"), F.count_if(~F.col("in_a")).alias("nb"), F.sum("v").alias("total"), F.avg(F.when(F.col("in_a"), F.col("v"))).alias("ma"), F.avg(F.when(~F.col("in_a"), F.col("v"))).alias("mb"))
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).select("k", "v", "rep", _hash60("k", "rep", seed).alias("h"))
    edge = rows.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep")).join(F.broadcast(seen)).select("rep", F.lit(0).cast("long").alias("part"), F.col("na").alias("need"), F.lit(0.0).alias("got"), (F.col("na") + F.col("nb")).alias("rows"))
    bits, edge = 0, cut(edge)
    top = lambda n: F.shiftright("h", 60 - n) if n else F.lit(0).cast("long")
    while bits < 60 and edge.agg(F.max("rows")).first()[0] > EDGE_ROWS:
        inside = each.join(F.broadcast(edge.select("rep", "part", "need", "got")), "rep").where(top(bits) == F.col("part"))
        bits += STEP_BITS
        parts = inside.groupBy("rep", "need", "got", top(bits).alias("part")).agg(F.count("*").alias("rows"), F.sum("v").alias("s"))
        before = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        upto = parts.withColumns({"n": F.coalesce(F.sum("rows").over(before), F.lit(0)), "sb": F.coalesce(F.sum("s").over(before), F.lit(0.0))})
        last = upto.where((F.col("n") < F.col("need")) & (F.col("n") + F.col("rows") >= F.col("need")))
        edge = cut(last.select("rep", "part", (F.col("need") - F.col("n")).alias("need"), (F.col("got") + F.col("sb")).alias("got"), "rows"))
    inside = each.join(F.broadcast(edge.select("rep", "part", "need")), "rep").where(top(bits) == F.col("part"))
    first = inside.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("h", "k", "v"))).where(F.col("_n") <= F.col("need"))
    sums = edge.select("rep", "got").join(first.groupBy("rep").agg(F.sum("v").alias("s")), "rep", "left").select((F.col("got") + F.coalesce("s", F.lit(0.0))).alias("sa"))
    drawn = sums.join(F.broadcast(seen))
    d = F.abs(F.try_divide("sa", "na") - F.try_divide(F.col("total") - F.col("sa"), F.col("nb")))
    difference = F.col("ma") - F.col("mb")
    return drawn.agg(F.first(difference).alias("difference"), ((F.count_if(d >= F.abs(difference) - 1e-12) + 1) / (F.count("*") + 1)).alias("p"), F.count("*").alias("reps"))


def _hash60(key: str, rep: str, seed: int) -> Column:
    """Fifteen digits of an MD5 of the key, the replicate and the seed."""
    text = F.concat_ws(":", F.col(key), F.col(rep).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def ranking_quality(results: DataFrame, hit: Column, by: list[str], k: int = 5) -> DataFrame:
    """Mean reciprocal rank, at any depth and within ``k``, and queries with a hit in the first ``k``.

    ``results`` has ``(query_id, rank)`` and the columns of ``by``; ``hit`` says of a row that it is relevant.
    So relevance is looked at where a result is, and no table of all relevant pairs is made. A query
    without results isn't there.
    """
    best = results.groupBy(*by, "query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("best"))
    inside = F.coalesce(F.col("best") <= k, F.lit(False))
    return best.groupBy(*by).agg(
        F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("best")), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(inside, 1.0 / F.col("best")).otherwise(0.0)).alias("mrr_at_k"), F.count_if(inside).alias("top_k"), F.count("*").alias("queries"),
    )


def some_and_every(test: Column) -> list[Column]:
    """Aggregates: whether ``test`` holds for some row and for every row of a group."""
    return [F.bool_or(test).alias("some"), F.bool_and(test).alias("every")]


def near_miss_table(log: DataFrame) -> DataFrame:
    """By node over a search log ``(query_id, id, near_miss)``: appearances, selections, near misses and their share."""
    miss = F.count_if("near_miss")
    return log.groupBy("id").agg(F.count("*").alias("appearances"), F.count_if(~F.col("near_miss")).alias("selected"), miss.alias("near_misses"), (miss / F.count("*")).alias("miss_ratio"))


def failure_gate(df: DataFrame, by: list[str], failed: Column, most: float = 0.25) -> DataFrame:
    """Failure share by group and whether it is over ``most``."""
    share = F.avg(failed.cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), share.alias("failure_rate"), (share > most).alias("stopped"))


def coverage_gate(planned: DataFrame, done: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    marks = done.select(key).distinct().withColumn("_done", F.lit(1))
    share = F.sum(F.coalesce("_done", F.lit(0))) / F.count("*")
    return planned.join(marks, key, "left").agg(F.count("*").alias("planned"), F.sum(F.coalesce("_done", F.lit(0))).alias("done"), share.alias("coverage"), (share >= least).alias("passed"))


def mean_pairwise_distance(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine distance of a group's pairs, from the sum of its unit vectors and without making pairs."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    unit = vectors.withColumn("_norm", norm).where("_norm > 0").select(by, F.posexplode(F.col(vector)).alias("i", "x"), "_norm")
    sums = unit.groupBy(by, "i").agg(F.sum(F.col("x").cast("double") / F.col("_norm")).alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    n = F.col("n")
    return total.select(by, "n", F.when(n > 1, 1 - (F.col("ss") - n) / (n * (n - 1))).alias("mean_distance"))


def vendi_score(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """``(by, n, vendi)``: how many different vectors a group has in effect, from 1 (all alike) to ``n``.

    The exponential of the entropy of the eigenvalues of the group's cosine matrix over ``n``. That
    matrix shares them with the one of components by components, whose sums each task makes for its
    rows; so what meets for a group are as many numbers as its vectors' length squared, however many
    there are. Vectors of norm 0 and null ones are left out; the vectors of a group have one length.
    """
    kind = vectors.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = batch.column(1).value_lengths().to_numpy(), batch.column(0).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            for c in np.unique(codes).tolist():
                at = np.flatnonzero(codes == c)
                unit = unit_rows(batch.column(1).take(pa.array(at)), int(sizes[at].max()))
                unit = unit[np.linalg.norm(unit, axis=1) > 0]
                x, y = np.triu_indices(unit.shape[1])
                gram = (unit.T @ unit)[x, y]
                yield pa.RecordBatch.from_arrays(
                    [keys.dictionary.take(pa.array(np.full(len(x), c))), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(gram), pa.array(np.full(len(x), len(unit)))], [by, "i", "j", "s", "n"]
                )

    def spectrum(group: pd.DataFrame) -> pd.DataFrame:
        size, n = int(group["i"].max()) + 1, int(group["n"].iloc[0])
        gram = np.zeros((size, size))
        gram[group["i"], group["j"]] = group["s"]
        values = np.linalg.eigvalsh(gram + np.triu(gram, 1).T) / max(n, 1)
        values = values[values > 1e-15]
        return pd.DataFrame({by: group[by].iloc[:1], "n": [n], "vendi": [float(np.exp(-(values * np.log(values)).sum())) if n else None]})

    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(by).isNotNull()).select(by, vector)
    sums = rows.mapInArrow(partial, f"{by} {kind}, i int, j int, s double, n long").groupBy(by, "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.groupBy(by).applyInPandas(spectrum, f"{by} {kind}, n long, vendi double")
