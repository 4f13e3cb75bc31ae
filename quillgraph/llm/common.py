"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.lineage import Scratch

#: A word, wherever a contract counts words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most, for tables of long texts; Spark's own 10,000 would be hundreds of MB in a worker.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; from then on the session's Arrow batches have ``BATCH_ROWS`` rows at most."""
    set_rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if set_rows <= 0 or set_rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text(text: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that long texts are never all held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()  # workers are used again; what one task needed should not stay


#: Bits of a Bloom filter; its broadcast is 2 MB whatever the input. A full filter lets every row through.
FILTER_BITS = 1 << 24


class Maybe:
    """A Bloom filter over a column of keys: says of every wanted key that it is in, and of few others."""

    def __init__(self, wanted: DataFrame, key: str, hashed: bool = False, bits: int = FILTER_BITS):
        own, self.bits = F.col(key) if hashed else F.xxhash64(key), bits
        at = lambda shift: F.shiftrightunsigned(own, shift).bitwiseAND(F.lit(bits - 1))
        words = (
            wanted.select(F.explode(F.array(at(0), at(32))).alias("i")).groupBy(F.shiftright("i", 5).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(i & 31 as int)))").alias("bits")).toArrow()
        )  # at most bits / 32 rows, as numbers
        filled = np.zeros(bits // 32, np.uint32)
        filled[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
        self.sent = wanted.sparkSession.sparkContext.broadcast(filled.tobytes())

    def kept(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches whose last column is the key's xxhash64, without most unwanted rows and without that column."""
        for batch in batches:
            keep = self.has(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(keep))

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each of the hashes may be wanted."""
        bits, keep = np.frombuffer(self.sent.value, np.uint32), np.ones(len(h), bool)
        for shift in (0, 32):
            i = (h >> np.uint64(shift)) & np.uint64(self.bits - 1)
            keep &= (bits[i >> np.uint64(5)] >> (i & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return keep


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``wanted``'s; none that is gets lost.

    Meant before a join that would otherwise shuffle long texts only to drop them.
    """
    return rows.withColumn("_h", F.xxhash64(key)).mapInArrow(Maybe(wanted, key).kept, rows.schema)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart and orders them as ``key`` does.

    That is the key itself where no row shares it and none lacks it. Otherwise rows are written
    with a number: by key, rows without one last, rows of one key by a hash of their text.
    """
    shared = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1 or key is null")
    if shared.isEmpty():
        return docs, key
    row = free_name(docs, "_row")
    ordered = docs.orderBy(F.col(key).asc_nulls_last(), F.xxhash64(text))
    return scratch.keep(ordered.withColumn(row, F.monotonically_increasing_id())), row
