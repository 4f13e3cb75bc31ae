"""Sharding, mixing, packing, URL filters, search, personal data and toxicity against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import hamming, mixing, packing, pii, sharding, toxicity, urls

from .conftest import ODD

# --- sharding ---------------------------------------------------------------------------------------------------------


def shards_plain(rows, limit):
    hashes = [(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t, _ in rows]
    out = {}

    def split(part, depth):
        if sum(b for _, b in part) <= limit or len({h for h, _ in part}) == 1:
            for h, _ in part:
                out[h] = depth, h >> (60 - depth), sum(b for _, b in part), len(part)
            return
        for bit in (0, 1):
            half = [x for x in part if x[0] >> (59 - depth) & 1 == bit]
            if half:
                split(half, depth + 1)

    if hashes:
        split(hashes, 0)
    return [out[h] for h, _ in hashes]


@pytest.mark.parametrize("limit", [1, 40, 200, 1000, 10**9])
def test_shards_match_recursive_splitting(make, limit):
    rng = random.Random(limit)
    rows = [*ODD, *((100 + i, "x" * rng.randrange(0, 60), "s") for i in range(150))]
    got = sharding.shard(make(rows, extra=True), limit).collect()
    want = Counter((i, *w) for (i, _, _), w in zip(rows, shards_plain(rows, limit), strict=True))
    assert Counter((r["doc_id"], r["shard_depth"], r["shard_prefix"], r["shard_bytes"], r["shard_rows"]) for r in got) == want


def test_shards_of_nothing_and_on_disk(make, spark, tmp_path):
    assert sharding.shard(make([]), 10).count() == 0
    rows = [(i, "x" * 10, "s") for i in range(50)]
    sharding.write_shards(make(rows), str(tmp_path / "s"), 100)
    back = spark.read.parquet(str(tmp_path / "s"))
    sizes = Counter((r["shard_depth"], r["shard_prefix"]) for r in back.collect())
    assert sum(sizes.values()) == 50 and max(sizes.values()) <= 10


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200, 500 / 3, 250 / 3]
    assert mixing.water_fill([10, 10], [1, 1], 1000, 2) == [20, 20]
    assert mixing.water_fill([0, 10], [5, 1], 5, 2) == [0, 5]
    assert mixing.water_fill([], [], 0, 2) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_water_fill_is_feasible_and_even(sizes):
    weights = mixing.cycle_weights(sizes)
    targets = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2)
    assert sum(targets) == pytest.approx(1.5 * sum(sizes))
    free = [t / w for t, w, s in zip(targets, weights, sizes, strict=True) if t < 2 * s - 1e-6]
    assert max(free, default=0) - min(free, default=0) < 1e-6
    assert all(t <= 2 * s + 1e-6 for t, s in zip(targets, sizes, strict=True))


def test_mix_comes_near_targets(make):
    rng = random.Random(1)
    rows = list(ODD) + [(1000 + i, "w " * rng.randrange(0, 80), rng.choice(["hot"] * 6 + ["x", "y", "z", None])) for i in range(600)]
    got = mixing.mix(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    plain = defaultdict(int)
    for _, t, s in rows:
        plain[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(plain, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.water_fill([plain[s] for s in order], mixing.cycle_weights(order), 1.5 * sum(plain.values()), 2), strict=True))
    assert dict(sizes) == dict(plain) and targets == pytest.approx(want)
    assert all(r["source_size"] == plain[r["source"]] for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 for s in ("hot", "x", "y", "z"))
    again = mixing.mix(make(rows[::-1])).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mix_in_parts_and_empty(make, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 20)
    rows = [(i, "w " * (i % 7), "a" if i % 3 else "b") for i in range(400)]
    got = mixing.mix(make(rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 6 for s in target)
    assert mixing.mix(make([])).count() == 0
    assert mixing.mix(make([(1, None, None), (2, "", "a")])).count() == 2
    repeated = Counter(r["doc_id"] for r in mixing.mixed(make(rows)).collect())
    assert {r["doc_id"]: r["copies"] for r in got if r["copies"]} == dict(repeated)


# --- packing ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_equal_the_tokenizer(tokenizer):
    known = packing.WordIds(tokenizer)
    texts = ["It's 12.5% of x<|endoftext|>. <|ENDOFTEXT|> don't*", "İSTANBUL ΣΑΣ ÉÀ é́. ﬁ ß! 日本。 a‍b «oui».", "", " ... ", "a" * 500, "naïve, Über-Straße; O'Brien's 'tis", "tab\tnew\nline\u0085nel\u00a0nbsp\x1cfs"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abÉüßñ ,.!'’9-\n") for _ in range(80)) for _ in range(300)]
    for t in texts:
        got = np.frombuffer(b"".join(known[w] for w in t.encode().split()), "<u4").tolist()
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_every_vocabulary_word_merges_alike(tokenizer):
    known = packing.WordIds(tokenizer)
    words = [w[:-4] for w in tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha()]
    assert len(words) > 20000
    for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(known.ids(w.encode()), "<u4").tolist() == e.ids


def test_pack_is_whole_and_gapless(make, tokenizer):
    rng = random.Random(2)
    rows = list(ODD) + [(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 90))), "s") for i in range(200)]
    got = packing.pack(make(rows, extra=True), capacity=64).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 64))]
        have = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i])
        assert have == sorted(want * sum(j == i for j, _, _ in rows))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 64) + 2
    assert packing.pack(make([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=15))
def test_plan_uses_every_piece_once(counts):
    planned = packing.plan(counts, 40)
    used = Counter()
    for held, n in planned:
        assert sum(held) <= 40 and n > 0
        for x in held:
            used[x] += n
    assert used == Counter(counts)
    assert len(planned) <= 2 * len(counts) + 1 or len(planned) <= sum(counts.values())


def test_plan_fills_gaps_exactly():
    assert packing.plan({60: 5, 40: 5}, 100) == [([60, 40], 5)]
    assert packing.plan({60: 2, 25: 2, 15: 2}, 100) == [([60, 25, 15], 2)]
    assert packing.plan({50: 1, 20: 1, 18: 1, 12: 1}, 100) == [([50, 20, 18, 12], 1)]


def test_ranks_have_no_gaps(make, spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    rows = spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 7L, id % 5) as length", "id as ids_crc32")
    got = packing.ranked(rows, "doc_id").collect()
    by = defaultdict(list)
    for r in got:
        by[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 500


# --- URL filters ------------------------------------------------------------------------------------------------------

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
URLS = [
    "http://a.Example.org/es/5?x=1", "https://example.org/en/12", "https://notexample.org/en/1", "HTTP://X.COM/fr/1", "http://x.com/FR/1", "x.com/fr/", None, "", "http://org/", "http://org",
    "http://b.org?q", "ftp://u@h.com:80/de/1#f", "http://www.ÉXAMPLE.org/", "a://b://c.org/d", "http://x.net/en/1\nsecond", "http://h.com/de/" + "y" * 5000,
]


def judged_plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_urls_match_rules(spark):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, score string")
    got = {r["page_id"]: r for r in urls.judge(df, RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, best = judged_plain(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0]), u
        assert got[i]["verdict"] == (best[1] if best else ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def test_trees_learn_and_score_alike(spark):
    rows = [(i, f"http://h{i % 7}.{'bad' if i % 3 == 0 else 'good'}.net/{'9' * (i % 3 == 0) * 20}/p{i}") for i in range(300)]
    rules = [(f"h{k}.bad.net/", "block") for k in range(6)] + [(f"h{k}.good.net/", "allow") for k in range(6)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    held = [r for r in got if r["rule"] is None]
    assert len(held) > 30 and all((r["verdict"] == "block") == (".bad." in r["host"]) for r in held)
    counts = [((0, 1), 5.0, 0.0), ((1, 1), 0.0, 5.0), ((1, 0), 3.0, 1.0)]
    prior, trees = urls.boost(counts)

    def walk(tree, bins):
        while isinstance(tree, tuple):
            f, b, low, high = tree
            tree = low if bins[f] <= b else high
        return tree

    score = {b: prior + sum(walk(t, b) for t in trees) for b, _, _ in counts}
    assert score[(1, 1)] > 0 > score[(1, 0)] and score[(0, 1)] < 0
    assert urls.most_rows() < 200_000


# --- search -----------------------------------------------------------------------------------------------------------


def search_plain(rows, k):
    coded = [(i, sum(1 << b for b, x in enumerate(v) if x > 0)) for i, v in rows if v is not None]
    return {q: sorted(((c ^ d).bit_count(), i) for i, d in coded)[:k] for q, c in coded if q % 50 == 0}


@pytest.mark.parametrize("n", [0, 1, 6, 300])
def test_search_is_exact(spark, n):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(n)
    centre = rng.normal(size=(3, 64))
    rows = [(i, [float(x) for x in (centre[i % 3] + rng.normal(size=64) * (i % 4))]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] if n else []
    rows += [(5000, None)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, code string")
    got = defaultdict(list)
    for r in hamming.search(df, F.col("vec_id") % 50 == 0, 7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    assert dict(got) == search_plain(rows, 7)


# --- personal data ----------------------------------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-_+ 0123459()é:[]", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base_plain(text)


def test_spans_keep_the_base_and_add_more():
    model, thresholds = pii.detector()
    text = "Mail a.b@c.org or call me at my phone (555) 123-4567, IP 10.0.0.1, card 4111 1111 1111 1111, version 1.2.3, order 555-123-4567 id"
    base, found = pii.find(text, model, thresholds)
    assert set(base) <= set(found) and len(base) == 3
    assert [text[a:b] for k, a, b in found if (k, a, b) not in base] == ["(555) 123-4567"]
    assert pii.redact(text, found).startswith("Mail [EMAIL] or call me at my phone [PHONE], IP [IP], card [CARD]")
    assert pii.find("nothing here, 12 apples", model, thresholds) == ([], [])


def test_detector_holds_on_new_candidates():
    model, thresholds = pii.detector()
    x, y = pii._samples(600, 99)
    said = [model.probability(r) >= thresholds[int(r[0])] for r in x]
    hits = sum(a and b for a, b in zip(said, y, strict=True))
    assert hits / max(1, sum(said)) > 0.97 and hits / sum(y) > 0.8


def test_scan_rows(make):
    rows = [*ODD, (50, "x@y.zz é +1 (499) 555-6503", "s"), (51, "1" * 100000 + "@" * 1000, "s"), (52, "a" * 50000 + "@b", "s")]
    got = pii.scan(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        want = base_plain(text) if len(text) < 1000 else []
        if len(text) < 1000:
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert (r["n_email"], r["n_phone"]) == (sum(k == "email" for k, _, _ in want), sum(k == "phone" for k, _, _ in want))
    assert pii.scan(make([])).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(make(rows)).collect()}
    assert clean[50] == "[EMAIL] é [PHONE]" and clean[1] is None and clean[4] == "one"


# --- toxicity ---------------------------------------------------------------------------------------------------------

CLEAN = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "grumble" + rng.choice(CLEAN)]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    model = toxicity.Crf({}, -1.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    scores = rng.normal(size=7) * 2
    total, marked = 0.0, np.zeros(7)
    for bits in range(128):
        y = [bits >> i & 1 for i in range(7)]
        e = model.start[y[0]] + sum(y[i] * (scores[i] - 1.0) for i in range(7)) + sum(model.trans[y[i], y[i + 1]] for i in range(6))
        total += np.exp(e)
        marked += np.exp(e) * np.array(y)
    assert np.allclose(model.marginals(scores), marked / total)
    assert len(model.marginals(np.zeros(0))) == 0


def test_toxic_documents_and_spans(make, spark):
    rows = toxic_corpus(800, 1)
    docs = make([(i, t, "s") for i, t, _ in rows] + [(9001, None, None), (9002, "", None), (9003, "123 ...", "s")], extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9001, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(*toxicity.training_texts(docs, labels))
    got = {r["doc_id"]: r for r in toxicity.judge(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.98
    assert all(got[i]["predicted"] == 0 and 0 <= got[i]["score"] < 0.5 for i in (9001, 9002, 9003))
    for i, t, y in rows:
        for s in got[i]["spans"]:
            assert y and re.match("nasty|vile|grumble", t[s["start"] : s["end"]])
    kept = {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"] == 0}


def test_training_reads_no_held_out_row(make, spark):
    rows = toxic_corpus(200, 2)
    docs = make([(i, f"id{i}", "s") for i, _, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    toxic, clean = toxicity.training_texts(docs, labels, 1000)
    seen = {int(t[2:]) for t in toxic + clean}
    assert seen and all(zlib.crc32(str(i).encode()) % 5 for i in seen)


def test_toxicity_without_labels(make, spark):
    docs = make([(1, "a b c", "s")])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.training_texts(docs, labels))
    assert toxicity.judge(docs, model).first()["predicted"] in (0, 1)
    assert toxicity.judge(make([]), model).count() == 0
