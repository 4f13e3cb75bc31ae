"""Importance resampling against a plain version in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quillgraph.llm import resampling
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, percent=5, least=20):
    def bag(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bags = [(k, *bag(t)) for k, t in docs]
    s, t = Counter(b for _, _, bs in bags for b in bs), Counter(b for x in target for b in bag(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for k, n, bs in bags:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([k, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")


def test_equals_the_plain_version(spark):
    words = ["alpha", "Beta", "gamma", "Élan", "x1", "tail", "stop-gap", "日本"]
    docs = [(i, " ".join(words[(i * j + j * j) % 8] for j in range(i % 47))) for i in range(400)]
    target = ["alpha beta gamma tail", "élan x1 日本 alpha"]
    d, t = frames(spark, docs, target)
    assert got(resampling.resample(d, t, percent=30)) == plain(docs, target, 30)
    ranks = sorted(r["rank"] for r in resampling.resample(d.repartition(7), t, percent=30).collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_odd_rows(spark):
    docs = [(i, t) for i, t, _ in ODD] + [(None, "no key " * 30), (None, None), (9, "copy " * 25), (9, "copy " * 25), (9, "other text " * 20)]
    d, t = frames(spark, docs, [None, "", "word word copy"])
    assert got(resampling.resample(d, t, percent=100)) == plain(docs, [None, "", "word word copy"], 100)


def test_empty_tables_and_clashing_columns(spark, make):
    d, t = frames(spark, [], [])
    assert resampling.resample(d, t).count() == 0
    one, _ = frames(spark, [(1, "a b c " * 10)], [])
    assert got(resampling.resample(one, t, percent=100)) == plain([(1, "a b c " * 10)], [], 100)
    docs = make(ODD, extra=True)
    from pyspark.sql import functions as F

    for c in ("w1", "_w", "_id", "_key", "n", "word", "bucket", "gain", "weight", "_text"):
        docs = docs.withColumn(c, F.lit("clash"))
    assert got(resampling.resample(docs, t, percent=50)) == plain([(i, x) for i, x, _ in ODD], [], 50)


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, f"word{i % 3} and more {i} " * 6) for i in range(60)]
    d, t = frames(spark, docs, ["word1 and more"])
    chosen = {r["doc_id"] for r in resampling.resample(d, t, percent=20).collect() if r["rank"]}
    out = resampling.drawn(d, t, percent=20)
    assert out.columns == d.columns and {r["doc_id"] for r in out.collect()} == chosen and len(chosen) == 12


@pytest.mark.parametrize("text,n", [("A B c", 6), ("", 0), ("a", 1), ("a_b", 3), ("naïve", 1)])
def test_features_of_a_text(spark, text, n):
    d, _ = frames(spark, [(1, text)], [])
    assert resampling.counts(d, "text").groupBy().sum("n").first()[0] in ({n} if n else {None})
