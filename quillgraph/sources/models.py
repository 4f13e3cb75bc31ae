"""Embedding and model sources behind one small interface; the ones that come along work offline."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashing_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Signed hashed words, unit length; the same for the same text everywhere."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(v)
        out.append((v / norm if norm else v).tolist())
    return out


EMBEDDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {"hashing": hashing_embedder}


def embed(df: DataFrame, text: str, provider: str = "hashing", batch: int = 100) -> DataFrame:
    """Adds ``embedding``; a provider gets texts in batches and answers in their order. Null texts get null."""
    call = EMBEDDERS[provider]

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        out: list = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None]
        for lo in range(0, len(at), batch):
            part = at[lo : lo + batch]
            for i, v in zip(part, call([texts.iloc[i] for i in part]), strict=True):
                out[i] = v
        return pd.Series(out)

    return df.withColumn("embedding", run(F.col(text)))


def unpack_float32(df: DataFrame, blob: str, out: str = "embedding") -> DataFrame:
    """Packed little-endian 32-bit floats as an array; null for null and for lengths that are no multiple of four."""
    kept = [c for c in df.columns if c != out]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(blob)
            vectors = [None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(vectors, pa.list_(pa.float32()))], [*kept, out])

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {out} array<float>")


def pack_float32(df: DataFrame, vector: str = "embedding", out: str = "blob") -> DataFrame:
    """The opposite of ``unpack_float32``."""

    @F.pandas_udf("binary")
    def run(vectors):
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(out, run(F.col(vector)))
