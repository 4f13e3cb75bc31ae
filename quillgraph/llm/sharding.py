"""Sharding by extendible hashing, with DataFrame operations only.

The directory is indexed by the leading bits of a key's hash. A shard splits on its next bit only
while its rows exceed the byte limit, so shards have different depths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.lineage import cut

#: Leading bits of MD5 that a shard can be split by.
BITS = 60


def key_hash(*keys: str) -> Column:
    """The first 60 bits of the MD5 of the keys as text, null as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(bits_of: str, depth: Column | int, width: int = BITS) -> Column:
    """The first ``depth`` bits of a number of ``width`` bits."""
    return F.expr(f"shiftright({bits_of}, cast({width} - ({depth if isinstance(depth, int) else depth}) as int))")


def shard(docs: DataFrame, limit: int, keys: tuple = ("doc_id",), text: str = "text", spare_bits: int = 3) -> DataFrame:
    """``(keys, n_bytes, shard_depth, shard_prefix, shard_bytes, shard_rows)`` for every row.

    A shard is the rows whose hash starts with ``shard_prefix`` (``shard_depth`` bits), the shortest
    prefix whose rows' texts are at most ``limit`` bytes. Rows of one key stay together: a key whose
    rows alone exceed the limit is a shard of its own at the depth where it is alone. Null and empty
    texts have 0 bytes; null keys count as empty ones; rows that repeat are counted each time; an
    empty table gives no rows; other columns are ignored.

    Byte counts by prefix are map-side combined, so a hot prefix sends one row a task. The directory
    stays a table; it has about as many rows as there are shards and is never collected.
    """
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = cut(docs.select(*keys, n_bytes.alias("n_bytes"), key_hash(*keys).alias("h")))
    total = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(total, 1) / limit)) + spare_bits)) if total > limit else 1
    done, parts, todo = 0, [], rows
    while True:
        fine = cut(
            todo.groupBy(prefix("h", depth).alias("fine"))
            .agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        each = fine.withColumn("d", F.explode(F.sequence(F.lit(done), F.lit(depth)))).withColumn("p", prefix("fine", "d", depth))
        fits = (
            each.groupBy("d", "p")
            .agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .where((F.col("b") <= limit) | (F.col("lo") == F.col("hi")))
        )
        leaf = (
            each.select("fine", "d", "p").join(fits.select("d", "p", "b", "n"), ["d", "p"])
            .groupBy("fine").agg(F.min_by(F.struct("d", "p", "b", "n"), "d").alias("leaf"))
        )
        leaf = cut(leaf)
        parts.append(
            todo.withColumn("fine", prefix("h", depth)).join(leaf, "fine").select(
                *keys, "n_bytes", F.col("leaf.d").alias("shard_depth"), F.col("leaf.p").alias("shard_prefix"),
                F.col("leaf.b").alias("shard_bytes"), F.col("leaf.n").alias("shard_rows"),
            )
        )
        rest = fine.join(leaf, "fine", "left_anti").select("fine")
        if depth == BITS or rest.isEmpty():
            break
        todo = cut(todo.withColumn("fine", prefix("h", depth)).join(rest, "fine", "left_semi").drop("fine"))
        done, depth = depth + 1, min(BITS, depth + 8)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int, keys: tuple = ("doc_id",), text: str = "text") -> None:
    """Write ``docs`` with one folder a shard, ``shard_depth=d/shard_prefix=p``.

    Every row is written once: null keys and repeated rows are in the shard of their key. Columns of
    the folders' names are replaced. A shard is dealt to tasks in parts by its texts, so a key that is
    a shard of its own and over the limit has several files.
    """
    docs = docs.drop("shard_depth", "shard_prefix")
    found = shard(docs, limit, keys, text).select(*keys, "shard_depth", "shard_prefix", "shard_bytes").distinct()
    same = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"w.`{k}`")) for k in keys]
    joined = docs.alias("d").join(found.alias("w"), same)
    part = F.when(F.col("w.shard_bytes") > limit, F.pmod(F.xxhash64(f"d.`{text}`"), F.ceil(F.col("w.shard_bytes") / limit))).otherwise(F.lit(0))
    joined.repartition("w.shard_depth", "w.shard_prefix", part).select("d.*", "w.shard_depth", "w.shard_prefix").write.partitionBy("shard_depth", "shard_prefix").parquet(path)
