"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import suffixes
from tests.llm.conftest import ODD


def plain(docs):
    """Windows in order of rows by key (None last) and by a hash of their text; repeated rows are alike, so which comes first shows in none."""
    seen, out = set(), []
    for key, text in docs:
        raw, gone = (text or "").encode(), bytearray(len((text or "").encode()))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def corpus(seed, rows=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijkléñ") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [prose(40) for _ in range(4)] + ["a" * 350, "ab" * 140, "x" * 101 + "y" * 101]
    docs = []
    for i in range(rows):
        kind = r.randrange(6)
        if kind == 0 and docs:
            text = r.choice(docs)[1]
        elif kind == 1 and docs:
            old = r.choice(docs)[1]
            at = r.randrange(max(1, len(old)))
            text = old[:at] + r.choice(["", "Z", "é"]) + old[at + 1 :]
        else:
            text = prose(r.randrange(60))
            for _ in range(r.randrange(4)):
                s = r.choice(shared)
                cut = r.randrange(len(s) // 2)
                text += r.choice(["", " ", "\n"]) + s[cut : cut + r.choice([60, 99, 100, 101, 150, 400])] + prose(r.randrange(20))
        docs.append((i * 3, text))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_version(spark, seed):
    docs = corpus(seed)
    want = plain(docs)
    assert sum(x[2] for x in want) > 1000
    assert got(suffixes.without_repeats(frame(spark, docs).repartition(5))) == want


def test_many_buckets_hot_seeds_and_short_chunks(spark, monkeypatch):
    docs = corpus(4)
    want = plain(docs)
    monkeypatch.setattr(suffixes, "BUCKET_RUNS", 8)
    monkeypatch.setattr(suffixes, "SEED_RUNS", 2)
    assert got(suffixes.without_repeats(frame(spark, docs))) == want


def test_runs_follow_from_the_text_alone(monkeypatch):
    r = random.Random(5)
    raw = bytes(r.choice(b"abcd ") for _ in range(4000))
    texts = [b"", raw[:50], raw[100:1500], b"x" * 99, raw[600:3000], b"y" * 100]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for chunk in (1 << 18, 700, 128):
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        runs = suffixes.runs_of(data, offsets)
        windows = sorted((int(t), p) for t, lo, hi in zip(runs["text"], runs["lo"], runs["hi"], strict=True) for p in range(lo, hi + 1))
        assert windows == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - 99)]  # every window once
        assert ((runs["at"] >= runs["hi"]) & (runs["at"] + suffixes.SEED <= runs["lo"] + 100)).all()
        seed_of = {(int(t), p): (int(h), int(at) - p) for t, lo, hi, at, h in zip(runs["text"], runs["lo"], runs["hi"], runs["at"], runs["h"], strict=True) for p in range(lo, hi + 1)}
        assert all(seed_of[2, p + 500] == seed_of[4, p] for p in range(800))  # equal windows have equal seeds at equal places


def test_sorted_windows_against_sets():
    r = random.Random(6)
    base = bytes(r.choice(b"ab") for _ in range(suffixes.COLUMNS))
    rows, lo, hi = [], [], []
    for _ in range(300):
        x = bytearray(base)
        for _ in range(r.randrange(3)):
            x[r.randrange(len(x))] = r.choice(b"abc")
        a, b = sorted((r.randrange(suffixes.PLACES), r.randrange(suffixes.PLACES)))
        x[:a], x[b + 100 :] = bytes(a), bytes(len(x) - b - 100)
        rows.append(bytes(x))
        lo.append(a)
        hi.append(b)
    table = np.frombuffer(b"".join(rows), np.uint8).reshape(300, -1)
    out, seen = suffixes.repeats(table, np.array(lo), np.array(hi)), set()
    for i, x in enumerate(rows):
        for c in range(suffixes.PLACES):
            key = (c, x[c : c + 100])
            assert out[i, c] == (lo[i] <= c <= hi[i] and key in seen)
            if lo[i] <= c <= hi[i]:
                seen.add(key)


def test_the_cover_has_every_difference():
    d = {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER}
    assert d == set(range(suffixes.MODULUS))


def test_odd_rows(spark, make):
    docs = [(i, t) for i, t, _ in ODD if i is not None and i < 6] + [(7, "long " * 30), (7, "long " * 30), (9, "é" * 130), (None, "tail " * 50), (None, None)]
    order = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0))
    want = plain(order)
    assert got(suffixes.without_repeats(frame(spark, docs))) == want
    assert suffixes.without_repeats(frame(spark, [])).count() == 0
    few = frame(spark, [(1, None), (2, ""), (3, "short")])
    assert got(suffixes.without_repeats(few)) == plain([(1, None), (2, ""), (3, "short")])
    extra = make(ODD[:6], extra=True)
    for c in ("row", "lo", "hi", "g", "key", "kept", "stretches", "_row"):
        extra = extra.withColumn(c, F.lit("clash"))
    assert got(suffixes.without_repeats(extra)) == plain([(i, t) for i, t, _ in ODD[:6]])


def test_string_keys_and_kept_bytes(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([("b", "start " + text), ("a", text + " end")], "name string, body string")
    rows = {r["name"]: r for r in suffixes.without_repeats(df, "name", "body", with_kept=True).collect()}
    assert bytes(rows["a"]["kept"]).decode() == text + " end" and bytes(rows["b"]["kept"]) == b"start "
    assert (rows["b"]["n_removed"], rows["b"]["n_spans"]) == (len(text), 1)
