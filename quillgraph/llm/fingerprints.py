"""Canonical exact fingerprints of documents.

A text is normalised (NFKC, case folded, white space runs to one space, trimmed), digested by
128-bit xxhash and grouped by digest. Digests that several rows share have their canonical bytes
compared: where bytes differ under one digest, each fingerprint also carries the bytes' SHA-256.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.llm.common import raw_text, slices
from quillgraph.plans.lineage import cut

#: Bits of the filter that says which digests may be shared; its broadcast never exceeds 1 MB. A full
#: filter lets rows through that need no comparison and never holds one back.
FILTER_BITS = 1 << 23
#: Bytes of compressed texts that a task remembers to send each one once.
REMEMBERED = 16 << 20
#: Key ranges for each shuffle partition, so that a partition's share of them is even.
RANGES = 16


def canonical(text: str) -> bytes:
    """The bytes that count: NFKC, full case folding, any white space run as one space, trimmed."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = unicodedata.normalize("NFKC", text.casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, digest)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [digest(canonical(x.as_py().decode("utf-8", "replace"))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [key, "digest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, raw_text(text).alias("raw")).mapInArrow(run, f"{key} {kind}, digest string")


def _positions(found: str) -> tuple[int, int]:
    return int(found[:8], 16) % FILTER_BITS, int(found[8:16], 16) % FILTER_BITS


def shared_filter(found: DataFrame) -> bytes | None:
    """A Bloom filter of the digests that more than one row has; None if there are none."""
    shared = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    position = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("long") % FILTER_BITS
    words = (
        shared.select(F.explode(F.array(position(1), position(9))).alias("i"))
        .groupBy(F.floor(F.col("i") / 32).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(i % 32 as int)))").alias("bits"))
    )
    rows = words.toArrow()  # at most FILTER_BITS / 32 rows, as numbers
    if not rows.num_rows:
        return None
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out.tobytes()


def collisions(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests under which different canonical bytes occur.

    Rows of shared digests are compared byte by byte: each task sends one copy of equal bytes, so a
    group of copies costs one row a task, and the least and greatest bytes of a digest must agree.
    """
    bits = shared_filter(found)
    if bits is None:
        return found.sparkSession.createDataFrame([], "digest string")
    packed = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held = np.frombuffer(packed.value, np.uint32), {}, 0
        squeeze = zstandard.ZstdCompressor(level=3)  # one compressor, so equal bytes stay equal
        for batch in slices(batches):
            names, bodies = [], []
            for x in batch.column(0):
                data = canonical(x.as_py().decode("utf-8", "replace"))
                name = digest(data)
                if all(words[i >> 5] >> (i & 31) & 1 for i in _positions(name)):
                    body = squeeze.compress(data)
                    if seen.get(name) == body:
                        continue
                    if held > REMEMBERED:
                        seen, held = {}, 0
                    seen[name], held = body, held + len(body)
                    names.append(name)
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["digest", "body"])

    bodies = docs.select(raw_text(text).alias("raw")).mapInArrow(run, "digest string, body binary")
    return bodies.groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi").select("digest")


def _name(text: str, odd: frozenset) -> str:
    data = canonical(text)
    name = digest(data)
    return f"{name}-{hashlib.sha256(data).hexdigest()}" if name in odd else name


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, group_id)``: rows of equal canonical text share the least key of them."""
    found = cut(digests(docs, key, text))
    odd = frozenset(r["digest"] for r in collisions(docs, found, key, text).collect())  # 128-bit collisions: none, in practice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = [_name(x.as_py().decode("utf-8", "replace"), odd) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(key, raw_text(text).alias("raw")).mapInArrow(run, f"{key} {kind}, fingerprint string") if odd else found.withColumnRenamed("digest", "fingerprint")
    least = named.groupBy("fingerprint").agg(F.min(key).alias("group_id"))
    return named.join(least, "fingerprint").select(key, "fingerprint", "group_id")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following`` (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The next document is the next by integer ``key`` (null keys first; rows of one key in a fixed order), the last
    one's is the first. Exact fingerprints are alike or not, so likeness is 1 or 0. Null texts are
    empty; an empty table gives no rows; other columns are ignored. Keys are cut into ranges, each
    range is sorted in one task, and the first row of each range is also sent to the range before.
    """
    found = cut(digests(docs, key, text))
    odd = frozenset(r["digest"] for r in collisions(docs, found, key, text).collect())
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    quantiles = F.percentile_approx(key, [i / n_parts for i in range(1, n_parts)], 10 * n_parts)
    cuts = sorted(set(found.agg(quantiles.alias("q")).first()["q"] or []))
    kind = docs.schema[key].dataType.simpleString()

    def part_of(k) -> int:
        return 0 if k is None else bisect_right(cuts, k)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, object] = {}
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at = part_of(k)
                if at not in by or k is None or (by[at] is not None and k < by[at]):
                    by[at] = k
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(list(by.values()), batch_type)], ["part", "first"])

    batch_type = to_arrow_type(docs.schema[key].dataType)
    # the first key of every range that has rows is also sent to the range before it, round to the last one
    firsts = {r["part"]: r["first"][0] for r in found.select(key).mapInArrow(least, f"part int, first {kind}").groupBy("part").agg(F.min(F.struct("first")).alias("first")).collect()}
    order = sorted(firsts)
    send = {firsts[at]: order[i - 1] for i, at in enumerate(order)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            rows = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = squeeze.compress(x.as_py())
                rows.append((part_of(k), False, k, body))
                if k in send:
                    rows.append((send[k], True, k, body))
            a, b, c, d = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.bool_()), pa.array(c, batch.schema.field(0).type), pa.array(d, pa.binary())], ["part", "guest", key, "body"])

    routed = docs.select(key, raw_text(text).alias("raw")).mapInArrow(route, f"part int, guest boolean, {key} {kind}, body binary")
    routed = routed.repartition("part").sortWithinPartitions("part", "guest", F.col(key).asc_nulls_first(), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        waiting: tuple | None = None

        def row(held: tuple, following: str, next_name: str) -> tuple:
            k, own, name = held
            new = edited(own, following)
            new_name = name if new == own else _name(new, odd)
            return k, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), name, new_name, float(name == new_name), float(name == next_name)

        for batch in slices(batches):
            out = []
            for at, guest, k, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and (waiting is None or waiting[0] != at):
                    continue  # the row before is this range's already
                content = expand.decompress(body).decode("utf-8", "replace")
                name = _name(content, odd)
                if waiting is not None and waiting[0] == at:
                    out.append(row(waiting[1], content, name))
                waiting = None if guest else (at, (k, content, name))
            if out:
                a = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[0], batch.schema.field(2).type), pa.array(a[1], pa.int64()), *(pa.array(a[i], pa.string()) for i in (2, 3, 4)), pa.array(a[5], pa.float64()), pa.array(a[6], pa.float64())],
                    [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return routed.mapInArrow(run, f"{key} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
