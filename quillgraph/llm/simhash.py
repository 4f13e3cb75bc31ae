"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprints of 64 bits are cut into segments. Two fingerprints that differ in at most ``bits``
places differ in some segment by no more than that segment's radius when the radii sum to
``bits - segments + 1`` (the general pigeonhole principle), so enumerating each segment's small
Hamming ball and fetching the table rows finds every link; whole distances are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import apart, raw_text, slices
from quillgraph.operators.components import connected_components
from quillgraph.plans.lineage import Scratch, cut

#: Shingles whose bits are counted at once.
BLOCK = 1 << 17
#: Members of one cluster in a table bucket from which that cluster is not compared with itself.
BIG = 32


def fingerprint(raw: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: bit b is set if over half of the shingles' XXH64 have it set."""
    words = raw.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` for every row, ``fp`` as a signed long. Null, empty and blank texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, raw_text(text).alias("raw")).mapInArrow(run, f"{key} {kind}, fp bigint")


def segments_of(bits: int, segments: int) -> list[tuple[int, int, int]]:
    """``(first bit, width, radius)`` of each segment; the radii sum to ``bits - segments + 1``."""
    left, out, at = max(bits - segments + 1, 0), [], 0
    for i in range(segments):
        width = (64 - at) // (segments - i)
        radius = -(-left // (segments - i))
        out.append((at, width, radius))
        left, at = left - radius, at + width
    return out


def _flips(width: int, radius: int) -> list[int]:
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(width)} | set(masks))
    return masks


def links(distinct: DataFrame, bits: int = 4, segments: int = 3) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints (column ``fp``, distinct) as links of ``bits`` or fewer do.

    First each fingerprint is compared with the least one in each of its own segment buckets, which
    joins most of a dense group by a star. Pairs are then sought between different clusters only: in
    a bucket where one cluster has many members, those members meet the others and never each other.
    So a group of near copies costs about its size, no bucket is capped, and no link between
    clusters is missed.
    """
    cuts = segments_of(bits, segments)

    def value(at: int, width: int):
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))

    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), value(at, width).alias("val")) for i, (at, width, _) in enumerate(cuts))))
    index = distinct.select("fp", rows.alias("s")).select("fp", "s.seg", "s.val")
    leaders = index.groupBy("seg", "val").agg(F.min("fp").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    with Scratch(distinct.sparkSession) as scratch:
        stars = scratch.keep(index.join(leaders, ["seg", "val"]).where(F.col("fp") != F.col("leader")).where(near("fp", "leader")).select("fp", "leader").distinct())
        cluster = connected_components(stars, "fp", "leader").select(F.col("node").alias("fp"), F.col("component").alias("cluster"))
        labelled = scratch.keep(distinct.join(cluster, "fp", "left").select("fp", F.coalesce("cluster", "fp").alias("cluster")))

        table = labelled.select("fp", "cluster", rows.alias("s")).select("fp", "cluster", "s.seg", "s.val")
        big = (
            table.groupBy("seg", "val", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= BIG)
            .groupBy("seg", "val").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("big"))
        )
        balls = F.explode(
            F.array(
                *(
                    F.struct(F.lit(i).alias("seg"), value(at, width).bitwiseXOR(F.lit(mask).cast("long")).alias("val"))
                    for i, (at, width, radius) in enumerate(cuts)
                    for mask in _flips(width, radius)
                )
            )
        )
        probes = labelled.select("fp", "cluster", balls.alias("s")).select("fp", "cluster", "s.seg", "s.val")
        tagged = table.join(big, ["seg", "val"], "left").select("seg", "val", F.col("fp").alias("b"), F.col("cluster").alias("to"), F.coalesce(F.col("cluster") == F.col("big"), F.lit(False)).alias("in_big"))
        asked = probes.join(big, ["seg", "val"], "left").select(
            "seg", "val", F.col("fp").alias("a"), F.col("cluster").alias("from"),
            F.explode(F.when(F.col("big").isNull() | (F.col("cluster") == F.col("big")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("in_big"),
        )
        found = asked.join(tagged, ["seg", "val", "in_big"]).where(F.col("from") != F.col("to")).where(near("a", "b"))
        return cut(stars.select(F.col("fp").alias("a"), F.col("leader").alias("b")).unionAll(found.select("a", "b").distinct()))


def near_duplicates(docs: DataFrame, bits: int = 4, segments: int = 3, shingle: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, component_id)``: documents linked, directly or through others, share the least key.

    Documents of equal fingerprint are one node, so groups of copies cost one comparison. Rows of
    null text have fingerprint 0, as blank ones do, and are linked like any other; rows that repeat
    come out as often as they came in; an empty table gives none; other columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle, seed, key, text))
    nodes = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    parts = connected_components(links(nodes.select("fp"), bits, segments), "a", "b")
    group = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    named = group.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(group.join(named, "component").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 4, segments: int = 3, shingle: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each near-duplicate group, with its columns: the one of least key.

    Rows without a key take part and come last in that order; different texts of one key are rows of
    their own; of repeated rows and of texts without words one stays; an empty table gives none.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, row = apart(docs, scratch, key, text)
        groups = near_duplicates(rows, bits, segments, shingle, seed, row, text)
        kept = cut(groups.where(F.col(row) == F.col("component_id")).select(row))
        if row == key:
            return docs.join(kept, key, "left_semi")
        return cut(rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)))
