"""Phrase mining against a plain version in Python."""

import random
import re
from collections import Counter

import pytest

from quillgraph.llm import phrases
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, best):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            f.update((("und" if lang is None else lang), tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            found[lang, p] = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
    gone = {(lang, p[i:j]) for lang, p in found for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * f[lang, p] >= 80 * f[lang, p[i:j]]}
    out = []
    for lang in {x for x, _ in found}:
        kept = sorted((-s, -f[lang, p], " ".join(p).encode(), l, r) for (x, p), (s, _, l, r) in found.items() if x == lang and (lang, p) not in gone)
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(kept[:best])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, docs):
    return spark.createDataFrame(docs, "lang string, text string")


WORDS = ["the", "The", "of", "red", "fox", "x\x01", "é", "élan", "日本", "a-b", "b"]


def texts(seed, rows=120, longest=40):
    r = random.Random(seed)
    tail = ["red fox of the", "the the the the the", "é élan. 日本"]
    return [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(WORDS) if r.random() < 0.8 else r.choice(tail) + r.choice([" ", "\n", ",", "\t", " ; "]) for _ in range(r.randrange(longest)))) for _ in range(rows)]


@pytest.mark.parametrize("seed", [1])
def test_equals_the_plain_version(spark, seed):
    docs = texts(seed)
    want = plain(docs, 3, 25)
    assert want and got(phrases.mine(frame(spark, docs).repartition(5), least=3, best=25)) == want


def test_small_shards_and_many_ranges(spark, monkeypatch):
    docs = texts(3, 60)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # ranges start in the middle of subtrees, so that the path above them is looked up
        assert got(phrases.mine(frame(spark, docs), least=2, best=1000)) == plain(docs, 2, 1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shards_are_cut_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SHARD_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a", "a"]), pa.array([b"one two", b"Two two", b"", b"x"])], ["lang", "text"])
    cut = [(s.lang, [w.decode() for w in s.words.to_pylist()], s.ids.tolist()) for s in phrases.shards(iter([batch]))]
    assert cut == [("a", ["one", "two"], [0, 1]), ("b", ["two"], [0, 0]), ("a", ["x"], [0])]


def test_odd_rows(spark, make):
    docs = [("en", t) for _, t, _ in ODD] * 3 + [(None, "a b " * 40), ("und", "a b " * 4), ("", "a b " * 9), ("en", ".,;" * 50)]
    assert got(phrases.mine(frame(spark, docs), least=3, best=50)) == plain(docs, 3, 50)
    assert phrases.mine(frame(spark, []), least=3).count() == 0
    assert phrases.mine(frame(spark, [(None, None)]), least=1).count() == 0
    extra = make(ODD, extra=True)
    from pyspark.sql import functions as F

    for c in ("w1", "f", "n", "phrase", "k", "l"):
        extra = extra.withColumn(c, F.lit("clash"))
    assert got(phrases.mine(extra, least=2)) == plain([("en", t) for _, t, _ in ODD], 2, 2000)


def test_words_of_a_path_are_sent_by_one_text_and_not_by_every_shard(spark):
    docs = [("en", f"red fox of the x{i} x{i} hen. of the red fox") for i in range(400)]
    rows = frame(spark, docs).repartition(8).selectExpr("lang", "cast(text as binary) as text")
    with phrases.Scratch(spark) as scratch:
        words = rows.mapInArrow(phrases._words, "lang string, w1 string, n long").groupBy("lang", "w1").sum("n").where("`sum(n)` >= 30")
        known, merged = phrases.counted(rows, scratch.keep(words.select("lang", "w1")), 30, scratch)
        sent = phrases.spelt(rows, known, merged).collect()
        counts = {(r.h, r.g): r.f for r in merged.collect()}
    want = {"red fox", "fox of", "of the", "the red", "red fox of", "fox of the", "of the red", "the red fox", "red fox of the", "of the red fox"}
    found = {" ".join(w for w in r[3:] if w is not None): counts[r.h, r.g] for r in sent if (r.h, r.g) in counts}
    assert set(found) == want and found["red fox"] == 800 and found["fox of the"] == 400
    assert len(sent) < 2 * len(want)  # each of 8 shards has all of them
