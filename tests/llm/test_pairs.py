"""SimHash groups, passages and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import fingerprints, neardup, passages, simhash

from .conftest import ODD

WORDS = [f"w{i}" for i in range(400)]


def simhash_plain(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_plain(prints, bits=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_match_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40):
        text = " ".join(rng.choice(WORDS) for _ in range(n)) + " Ümlaut nbsp É"
        assert simhash.fingerprint(text.encode()) == simhash_plain(text)
    assert simhash.fingerprint(b" \t\n") == 0


def test_groups_match_brute_force(make):
    rng = random.Random(2)
    rows, n = list(ODD), 100
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(120)]
        for _ in range(rng.randrange(1, 6)):
            edited = list(base)
            for _ in range(rng.randrange(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rows.append((n, " ".join(edited), "s"))
            n += 1
    got = simhash.near_duplicates(make(rows, extra=True)).collect()
    want = groups_plain({i: simhash_plain(t) for i, t, _ in rows})
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)


def test_dense_groups_lose_no_link(spark, monkeypatch):
    """Hundreds of fingerprints around a few centres, with the size from which clusters are set apart made small."""
    monkeypatch.setattr(simhash, "BIG", 3)
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(80):
            x = centre
            for _ in range(rng.randrange(0, 9)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(60)}
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    from quillgraph.operators.components import connected_components

    signed = {int(np.uint64(v).view(np.int64)): v for v in values}
    for bits, segments in ((4, 3), (3, 4), (4, 2)):
        got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, bits, segments), "a", "b").collect()}
        plain = groups_plain(dict(signed), bits)
        assert {k: got.get(k, k) for k in signed} == plain


@given(st.integers(1, 6), st.integers(1, 6))
def test_radii_meet_the_pigeonhole(bits, segments):
    cuts = simhash.segments_of(bits, segments)
    assert sum(w for _, w, _ in cuts) == 64 and cuts[0][0] == 0
    assert sum(r + 1 for _, _, r in cuts) > bits or bits < segments


def test_keep_one(make):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "other words are here now", "x"), (2, "other words are here now", "x")]
    kept = simhash.keep_one(make(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2] and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_tables(make):
    none = make([])
    assert simhash.near_duplicates(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert passages.shared_passages(none).count() == 0
    assert fingerprints.compare_with_next(none).count() == 0
    assert fingerprints.groups(none).count() == 0


def test_exact_passages_are_all_found(make):
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    shared, near = text(60), text(80)
    changed = list(near)
    changed[40:42] = ["new", "other", "third"]
    docs = {10 + i: text(100) for i in range(8)}
    for i in (11, 13, 14):
        docs[i][50:50] = shared
    docs[15] = text(30) + near + text(10)
    docs[16] = text(5) + changed + text(40)
    docs[17] = list(docs[12])  # a whole copy
    docs[20] = text(49)
    docs[21] = docs[20][:30] + text(5)  # too short to count
    rows = [(i, " ".join(w), "s") for i, w in docs.items()] + [(1, None, None), (2, "", "a"), (3, "one two", "a")]
    got = {r["doc_id"]: r for r in passages.shared_passages(make(rows, extra=True)).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert got[17]["class_id"] == 12 and got[17]["n_links"] == 0
    for i in (13, 14):
        assert any(p["start"] <= 50 and p["end"] >= 110 and p["other_id"] == 11 for p in got[i]["passages"])
    assert any(p["start"] <= 5 and p["end"] >= 86 and p["other_id"] == 15 and p["identity"] > 0.9 for p in got[16]["passages"])
    assert {i for i, r in got.items() if r["n_links"]} == {13, 14, 16}


def test_fenwick_chain_is_best():
    """Chains over few runs score what trying every order does."""
    rng = random.Random(5)
    for _ in range(200):
        matches = [(rng.randrange(0, 120), rng.randrange(0, 120)) for _ in range(6)]
        found = passages.chains(matches)
        assert sum(len(c) for c in found) == len(passages.runs(matches))
        for c in found:
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:], strict=False))


def test_winnowing_guarantee():
    rng = np.random.default_rng(6)
    run = rng.integers(0, 1 << 60, passages.KMER + passages.WINDOW - 1, dtype=np.uint64)
    for _ in range(50):
        a = np.concatenate([rng.integers(0, 1 << 60, 40, dtype=np.uint64), run, rng.integers(0, 1 << 60, 40, dtype=np.uint64)])
        b = np.concatenate([rng.integers(0, 1 << 60, 7, dtype=np.uint64), run])
        assert set(passages.seeds(a)[0].tolist()) & set(passages.seeds(b)[0].tolist())


def edited_plain(texts, i):
    own, following = texts[i], texts[(i + 1) % len(texts)]
    half = len(own) // 2
    return own[: len(own) - half] + following[:half], following


def test_compare_with_next(make):
    rows = [(i * 3, t, s) for i, (_, t, s) in enumerate([*ODD[:7], (0, "Ünï  çÖdé ﬁ σ", None), (0, "x", "b")])]
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(make(rows, extra=True)).collect()}
    order = sorted(rows)
    texts = [t or "" for _, t, _ in order]
    name = lambda t: fingerprints.digest(fingerprints.canonical(t))
    for i, (k, _, _) in enumerate(order):
        new, following = edited_plain(texts, i)
        r = got[k]
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == name(texts[i]) and r["edited_fingerprint"] == name(new)
        assert r["near_edited"] == float(name(new) == name(texts[i])) and r["near_next"] == float(name(following) == name(texts[i]))
    one = fingerprints.compare_with_next(make([(5, "abcd", "s")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.compare_with_next(make([(8, "x", "c"), (8, "x", "c")])).count() == 2


def test_canonical_and_groups(make):
    assert fingerprints.canonical("  A ﬁ  Straße\n") == fingerprints.canonical("a FI STRASSE")
    got = {r["doc_id"]: r["group_id"] for r in fingerprints.groups(make([(1, "A b", "s"), (2, "a  B", "s"), (3, "a c", "s"), (4, None, "s"), (5, "", "s")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_equal_digests_of_different_bytes_part(make, monkeypatch):
    """With a digest that collides, byte comparison keeps different texts apart (in the driver's own process)."""
    docs = make([(1, "alpha", "s"), (2, "beta", "s"), (3, "alpha", "s")])
    odd = frozenset({fingerprints.digest(fingerprints.canonical("alpha"))})
    assert fingerprints._name("alpha", odd) != fingerprints._name("alpha", frozenset())
    assert fingerprints._name("ALPHA ", odd) == fingerprints._name("alpha", odd)
    assert fingerprints.collisions(docs, fingerprints.digests(docs)).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_canonical_is_stable(a, b):
    once = fingerprints.canonical(a).decode("utf-8", "surrogatepass")
    assert fingerprints.canonical(once) == fingerprints.canonical(fingerprints.canonical(once).decode("utf-8", "surrogatepass"))


@pytest.mark.parametrize("n", [1, 5, 30])
def test_prefilter_keeps_all_wanted(spark, n):
    from quillgraph.llm.common import maybe_in

    rows = spark.range(1000).selectExpr("id", "cast(id as string) as body")
    wanted = spark.range(0, 1000, max(1, 1000 // n))
    kept = maybe_in(rows, "id", wanted)
    assert wanted.join(kept, "id", "left_anti").count() == 0 and kept.count() < wanted.count() + 50
    assert maybe_in(rows, "id", wanted.limit(0)).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t, _ in rows:
        w = (t or "").lower().encode().split()
        out[i] = {b" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    return out


@pytest.mark.parametrize("big", [32, 3])
def test_verified_groups(make, monkeypatch, big):
    """No document joins a group without a link of 0.8; copies always do; most near copies do."""
    monkeypatch.setattr(neardup, "BIG", big)
    rng = random.Random(8)
    rows, n = [r for r in ODD if r[0] != 8], 100
    for _ in range(20):
        base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(300)]
        for _ in range(rng.randrange(2, 7)):
            edited = list(base)
            for _ in range(rng.randrange(0, 9)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rows.append((n, " ".join(edited), "s"))
            n += 1
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make(rows, extra=True)).collect()}
    sets = shingle_sets(rows)
    assert set(got) == set(sets)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links += [(a, b) for a in sets for b in sets if a < b and not sets[a] and not sets[b]]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(find(i) == find(c) for i, c in got.items())
    texts = {}
    for i, t, _ in sorted(rows):
        assert got[texts.setdefault(" ".join((t or "").lower().split()), i)] == got[i]
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)


def test_block_edits_are_all_linked(make):
    """Blocks of new words put in, put after or taken out: groups are those of all pairs at 0.8 or more."""
    rng = random.Random(21)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    rows, n = [r for r in ODD if r[0] != 8], 100
    line = text(12)
    for i in range(40):
        base = text(rng.randrange(60, 400)) + (line if i % 2 else [])
        block, at = text(len(base) * (4 + i % 5) // 40), rng.randrange(len(base))
        for edited in (base, base + block, base[:at] + block + base[at:], base[: len(base) - len(block)]):
            rows.append((n, " ".join(edited), "s"))
            n += 1
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(make(rows, extra=True)).collect()}
    sets = shingle_sets(rows)
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    parent = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and alike(sets[a], sets[b]) and parent[a] != parent[b]:
                low, high = sorted((parent[a], parent[b]))
                parent = {i: low if c == high else c for i, c in parent.items()}
    assert got == parent and sum(i != c for i, c in parent.items()) > 80


def test_passage_of_middle_documents_is_linked(make):
    """Documents that have its halves apart come before, between and after two that have a passage whole."""
    rng = random.Random(22)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    docs = {}
    for at in range(0, 120, 10):
        one, two = text(45), text(45)
        for i in range(1, 8):
            whole = text(20) + one + two + text(20)
            docs[at + i] = whole if i in (3, 5) else text(30) + one + text(150) + two + text(30)
    got = {r["doc_id"]: r for r in passages.shared_passages(make([(i, " ".join(w), "s") for i, w in docs.items()])).collect()}
    for i in range(5, 120, 10):
        assert any(p["other_id"] == i - 2 and min(p["end"], 110) - max(p["start"], 20) >= 50 for p in got[i]["passages"])


def test_edited_passage_with_one_shared_seed(make):
    """Passages with a word changed every nine that have any seed in common are found, be it a single one."""
    rng = random.Random(23)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    docs, due = {}, []
    for i in range(0, 120, 2):
        near = text(70)
        changed = [f"new{i}x{k}" if k % 9 == 8 else w for k, w in enumerate(near)]
        docs[i], docs[i + 1] = text(60) + near + text(60), text(60) + changed + text(60)
        of = [set(passages.seeds(passages.word_hashes([w.encode() for w in docs[j]], {}))[0].tolist()) for j in (i, i + 1)]
        if of[0] & of[1]:
            due.append(i + 1)
    got = {r["doc_id"]: r for r in passages.shared_passages(make([(i, " ".join(w), "s") for i, w in docs.items()])).collect()}
    assert len(due) > 30 and all(any(p["other_id"] == i - 1 for p in got[i]["passages"]) for i in due)


def test_chain_goes_on_past_a_far_better_one():
    """Chains score what dynamic programming over all runs does, and a long run too far back hides none that is near."""
    long = [(i, i) for i in range(0, 195, 5)]
    short = [(500 + 20 * k, 500 + 21 * k) for k in range(6)]
    assert any(len(c) == 6 for c in passages.chains(long + short))
    rng = random.Random(24)
    gap, cost = passages.MAX_GAP, passages.GAP_COST
    for _ in range(200):
        found = sorted(passages.runs([(rng.randrange(0, 400), rng.randrange(0, 400)) for _ in range(30)]))
        best = []
        for i, (a, b, n) in enumerate(found):
            skips = [(best[j], a - x - m, b - y - m) for j, (x, y, m) in enumerate(found[:i])]
            best.append(n + max([0.0] + [s - cost * (p + q) for s, p, q in skips if -3 <= p <= gap and -3 <= q <= gap]))
        chain = passages.chains([(a, b) for a, b, _ in found] + [(a + n - 6, b + n - 6) for a, b, n in found])[0]
        skipped = sum(q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(chain, chain[1:], strict=False))
        assert abs(sum(r[2] for r in chain) - cost * skipped - max(best)) < 1e-6
