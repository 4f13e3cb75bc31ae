"""Phrases whose words come together more often than their parts, from count tries of shards.

A shard of texts is a trie of word runs, as deep as the longest phrase, built level by level in
arrays: a node is its parent and a word, with a count. Shards send their nodes as numbers, 128 bits of
hashes, which are merged level by level; the words of a frequent node are then sent by one document that
has it. A walk over the merged trie, in ranges of paths, meets every left part on the way down, and
suffix links, one word less at the front, lead to the right parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Maybe, raw_text
from quillgraph.llm.words import BASE, LOWER, mixed
from quillgraph.plans.lineage import Scratch, cut

#: Words of a phrase at most, occurrences of a phrase at least, rows of a language at most.
LONGEST, LEAST, BEST = 4, 30, 2000
#: A phrase goes if a longer candidate has this share (in per cent) of its occurrences or more.
COVERED = 80
#: The language of texts without one.
NO_LANG = "und"
#: Bytes of text in one shard's trie.
SHARD_BYTES = 1 << 23
#: Bits of a filter for each key in it, and of a filter at most (16 MB): a fuller one only lets more rows through.
BITS_A_KEY, MOST_BITS = 16, 1 << 27
#: Bits for each key of the filter that says which document sends a node's words: every occurrence asks it.
BITS_A_MARK = 64
#: An odd number, other than ``BASE``, for the second half of a run's hash.
SECOND = 0xD6E8FEB86659FD93
#: Parts that the candidates of a language are dealt to before its best are taken.
DEALT = 64

# Bytes between words, and bytes that no phrase goes over.
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
STOP = np.zeros(256, bool)
STOP[[10, 11, 12, 13, *b".,;:!?"]] = True

PATH = [f"w{i}" for i in range(1, LONGEST + 1)]


class Shard:
    """The words of one language's texts: ``words`` (distinct), ``ids`` in order, ``last`` where a piece ends."""

    def __init__(self, lang: str, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # a line end is a stop, so texts are apart
        stop = STOP[data]
        word = ~(BLANK[data] | stop)
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        upto = np.cumsum(stop, dtype=np.int64)
        self.lang = lang
        self.last = np.ones(len(starts), bool)
        self.last[:-1] = upto[starts[1:]] != upto[ends[:-1] - 1]
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        body = LOWER[data[word]]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(body)]).dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode(), seed=42)
        names = self.words.to_pylist()
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in names], np.uint64)
        self.checks = np.array([xxhash.xxh3_64_intdigest(w, seed=seed) for w in names], np.uint64)
        self.texts, self.starts = texts, starts

    def runs(self, n: int, keep: np.ndarray) -> np.ndarray:
        """Where runs of ``n`` words start that lie in one piece; ``keep`` says it of each run of one word less (at its start)."""
        if len(keep) < 2:
            return np.zeros(0, np.int64)
        return np.flatnonzero(keep[:-1] & keep[1:] & ~self.last[:-1])

    def values(self, n: int, second: bool = False) -> np.ndarray:
        """A hash of the run of ``n`` words that starts at each place, or the ``second`` half of it; meaningless over the end."""
        own, base = (self.checks[self.ids], SECOND) if second else (self.hashes[self.ids], BASE)
        out = own
        for i in range(1, n):
            with np.errstate(over="ignore"):
                out = out * np.uint64(base) + np.concatenate([own[i:], np.zeros(min(i, len(own)), np.uint64)])
        return mixed(out) if n > 1 else own

    def origins(self, at: np.ndarray) -> np.ndarray:
        """For words at the given places a hash of the text that each is in, which no way of dealing texts to shards changes."""
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        return np.array([xxhash.xxh3_64_intdigest(t) for t in self.texts], np.uint64)[np.searchsorted(ends, self.starts[at], "right")]

    def nodes(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The trie's level ``n`` over the given starts: one start a node, and counts; children are keyed by parent and word."""
        size, key = len(self.words), self.ids[at]
        for i in range(1, n):
            if i > 1:
                _, key = np.unique(key, return_inverse=True)
            key = key * size + self.ids[at + i]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return at[first], count


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of ``(lang, text)`` batches: texts are gathered up to ``SHARD_BYTES``, then told apart by language."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def full() -> Iterator[Shard]:
        for lang in sorted(held):
            yield Shard(lang, held[lang])
        held.clear()
        pa.default_memory_pool().release_unused()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            held.setdefault(lang, []).append(raw)
            size += len(raw) + 1
            if size >= SHARD_BYTES:
                yield from full()
                size = 0
    yield from full()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries' first level, ``(lang, w1, n)``."""
    for shard in shards(batches):
        count = np.bincount(shard.ids, minlength=len(shard.words))
        yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(count), pa.string()), shard.words.cast(pa.large_string()).cast(pa.string()), pa.array(count.astype(np.int64))], ["lang", "w1", "n"])


def _frequent(shard: Shard, known: list[Maybe], n: int) -> Iterator[np.ndarray]:
    """For runs of 1 to ``n`` words, whether the one that starts at each place may be frequent; only if its parts may be."""
    keep = known[0].has(shard.hashes)[shard.ids] if len(shard.ids) else np.zeros(0, bool)
    yield keep
    for k in range(2, n + 1):
        at = shard.runs(k, keep)
        keep = np.zeros(len(keep), bool)
        keep[at] = known[k - 1].has(shard.values(k)[at]) if k <= len(known) else True
        yield keep


def _counted(known: list[Maybe], n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tries' level ``n``, ``(h, g, mark, n)``, of runs whose parts may be frequent; ``mark`` is of the run and a text that has it."""
        for shard in shards(batches):
            *_, keep = _frequent(shard, known, n)
            at, count = shard.nodes(np.flatnonzero(keep), n)
            h, g = shard.values(n)[at], shard.values(n, second=True)[at]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h, g, mixed(h ^ shard.origins(at)))] + [pa.array(count.astype(np.int64))], ["h", "g", "mark", "n"])

    return run


def _paths(known: list[Maybe], marks: Maybe) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of the tries' nodes from the second level on, ``(h, g, lang, w1, ...)``, from texts whose mark is asked for."""
        for shard in shards(batches):
            text = shard.words.cast(pa.large_string()).cast(pa.string())
            for n, keep in enumerate(_frequent(shard, known, LONGEST), 1):
                if n == 1:
                    continue
                at, h = np.flatnonzero(keep), shard.values(n)
                at, _ = shard.nodes(at[marks.has(mixed(h[at] ^ shard.origins(at)))], n)
                path = [text.take(pa.array(shard.ids[at + i])) if i < n else pa.nulls(len(at), pa.string()) for i in range(LONGEST)]
                keys = [pa.array(x[at].view(np.int64)) for x in (h, shard.values(n, second=True))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([shard.lang] * len(at), pa.string()), *path], ["h", "g", "lang", *PATH])

    return run


def _filter(keys: DataFrame, key: str = "h", bits_a_key: int = BITS_A_KEY) -> Maybe:
    """A filter over ``key`` whose size follows the number of keys, up to ``MOST_BITS``."""
    bits, wanted = 1 << 16, min(keys.count() * bits_a_key, MOST_BITS)
    while bits < wanted:
        bits *= 2
    return Maybe(keys, key, hashed=True, bits=bits)


def counted(rows: DataFrame, frequent: DataFrame, least: int, scratch: Scratch) -> tuple[list[Maybe], DataFrame]:
    """Filters of the levels from the first on, and ``(h, g, mark, f)`` of the merged nodes from the second on.

    ``rows`` are ``(lang, text)``, ``frequent`` the first level's nodes. ``mark`` is the least of those that shards sent.
    """
    known, merged = [_filter(frequent.select(F.xxhash64("lang", "w1").alias("h")))], None
    for n in range(2, LONGEST + 1):
        sent = rows.mapInArrow(_counted(known, n), "h long, g long, mark long, n long")
        level = scratch.keep(sent.groupBy("h", "g").agg(F.sum("n").alias("f"), F.min("mark").alias("mark")).where(F.col("f") >= least))
        known.append(_filter(level.select("h")))
        merged = level if merged is None else merged.unionByName(level)
    return known, merged


def spelt(rows: DataFrame, known: list[Maybe], merged: DataFrame) -> DataFrame:
    """``(h, g, lang, w1, ...)``: the words of merged nodes. Copies of a text each send them, and so do few others that the filter lets through."""
    marks = _filter(merged.select("mark"), "mark", BITS_A_MARK)
    return rows.mapInArrow(_paths(known, marks), ", ".join(["h long, g long", *(f"{c} string" for c in ("lang", *PATH))]))


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``left1``, ``left2``, ...: counts of a path's first words, from nodes ``(lang, w1, ..., f)`` in order of their paths.

    A walk goes down and up the trie and so keeps the counts on one path only. Where a range starts
    in the middle of a subtree, the path above it is not there, and its counts stay null.
    """
    path: list[str] = []
    above: list[int | None] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        lefts: list[list] = [[] for _ in range(LONGEST - 1)]
        for row in zip(*columns, strict=True):
            own = [row[0], *(w for w in row[1 : LONGEST + 1] if w is not None)]
            same = 0
            while same < len(path) and same < len(own) and path[same] == own[same]:
                same += 1
            above = above[:same] + [None] * (len(own) - same)
            path = own
            above[-1] = row[LONGEST + 1]
            for k in range(1, LONGEST):
                lefts[k - 1].append(above[k] if k < len(own) - 1 else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in lefts)], [*batch.schema.names, *(f"left{k}" for k in range(1, LONGEST))])


def _part(first: int, last: int) -> list[Column]:
    """Columns of the path that words ``first`` to ``last`` (from 1) of a path make."""
    return [(F.col(f"w{first + i}") if first + i <= last else F.lit(None).cast("string")).alias(w) for i, w in enumerate(PATH)]


def _same(a: str, b: str) -> Column:
    on = F.col(f"{a}.lang") == F.col(f"{b}.lang")
    for w in PATH:
        on = on & F.col(f"{a}.{w}").eqNullSafe(F.col(f"{b}.{w}"))
    return on


def scored(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(lang, w1, ..., size, a, l, r, score)`` for the phrases among merged nodes: the cut of the lowest score, of equal ones the first.

    Left parts come from the walk; the few that a range lacks (the path above its first node) are looked
    up. Right parts are what suffix links lead to.
    """
    schema = ", ".join([f"{c} string" for c in ("lang", *PATH)] + ["f long"] + [f"left{k} long" for k in range(1, LONGEST)])
    size = sum((F.col(w).isNotNull().cast("int") for w in PATH[1:]), F.lit(1))
    walked = scratch.keep(nodes.mapInArrow(walk, schema).withColumn("size", size))
    counts = walked.select("lang", *PATH, "f")
    cuts = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            part = walked.where(F.col("size") == n)
            cuts.append(part.select("lang", *PATH, "size", F.col("f").alias("a"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.struct(*_part(1, k)).alias("front"), F.struct(*_part(k + 1, n)).alias("rest")))
    every = cuts[0]
    for c in cuts[1:]:
        every = every.unionAll(c)
    # no more than the words above a range's first node are missing in it
    missing = every.where("l is null").select("lang", "front.*").distinct()
    found = counts.alias("c").join(F.broadcast(missing.alias("m")), _same("c", "m"), "left_semi").select("lang", F.struct(*PATH).alias("front"), F.col("f").alias("known"))
    front = lambda a: F.struct(*(F.coalesce(F.col(f"{a}.front.{w}"), F.lit("")).alias(w) for w in PATH))
    on_front = (F.col("e.lang") == F.col("k.lang")) & (front("e") == front("k"))
    full = every.alias("e").join(F.broadcast(found.alias("k")), on_front, "left").select("e.*", F.coalesce("e.l", "k.known").alias("left_n"))
    flat = full.select("lang", F.struct(*PATH, "size").alias("phrase"), "a", "k", F.col("left_n").alias("l"), "rest.*")
    right = flat.alias("x").join(counts.alias("c"), _same("x", "c")).select("x.lang", "x.phrase", "x.a", "x.k", "x.l", F.col("c.f").alias("r"))
    # whole-number division of decimals, so no product is rounded or overflows
    value = F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(28,0))) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))")
    best = right.withColumn("score", value).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase.*", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates without those whose words lie inside a longer candidate that has ``covered`` per cent of their occurrences."""
    inner = None
    for n in range(3, LONGEST + 1):
        for m in range(2, n):
            for i in range(1, n - m + 2):
                part = candidates.where(F.col("size") == n).select("lang", *_part(i, i + m - 1), F.col("a").alias("longer"))
                inner = part if inner is None else inner.unionAll(part)
    most = inner.groupBy("lang", *PATH).agg(F.max("longer").alias("longer"))
    out = candidates.alias("x").join(most.alias("y"), _same("x", "y"), "left").select("x.*", "y.longer")
    share = F.expr("cast(100 as decimal(38,0)) * cast(longer as decimal(28,0))") >= F.lit(covered).cast("decimal(4,0)") * F.col("a").cast("decimal(28,0)")
    return out.where(F.col("longer").isNull() | ~share).drop("longer")


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``best`` phrases of two to four words.

    ``a`` counts a phrase, ``l`` and ``r`` its parts at the cut, ``n`` all words of the language. Null and
    blank texts have no words; texts without a language are ``und``; repeated rows count as often as
    they come. A table without a frequent phrase gives no rows. Other columns are ignored.

    A phrase is frequent only if all its parts are, so a level is counted only over runs whose parts may
    be frequent: filters over hashes tell, whose size follows the number of keys up to 16 MB. They only
    ever let too much through. Runs are counted as 128 bits of hashes, and the words of one that is frequent
    come from the texts of least mark. Texts are read once a level, and once for the words.
    Ranks are taken of the best rows of ``DEALT`` parts of a language.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).cast("string").alias("lang"), raw_text(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.keep(rows.mapInArrow(_words, "lang string, w1 string, n long").groupBy("lang", "w1").agg(F.sum("n").alias("n")))
        total = words.groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = words.where(F.col("n") >= least)
        known, merged = counted(rows, frequent.select("lang", "w1"), least, scratch)
        paths = spelt(rows, known, merged).dropDuplicates(["h", "g"]).join(merged.select("h", "g", "f"), ["h", "g"]).drop("h", "g")
        trie = scratch.keep(paths.unionByName(frequent.withColumnRenamed("n", "f"), allowMissingColumns=True))
        candidates = scratch.keep(scored(trie.repartitionByRange("lang", *PATH).sortWithinPartitions("lang", *PATH), scratch))
        left = uncovered(candidates).select("lang", F.concat_ws(" ", *PATH).alias("phrase"), "a", "l", "r", "score")
        order = [F.desc("score"), F.desc("a"), "phrase"]
        part = Window.partitionBy("lang", "_part").orderBy(*order)
        first = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= best)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
        return cut(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def sql(least: int = LEAST, best: int = BEST, covered: int = COVERED) -> str:
    """The same in DuckDB SQL."""
    run = " UNION ALL ".join(f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: list_slice(w, i, i + {n - 1}))) AS p FROM pieces WHERE len(w) >= {n}" for n in range(1, LONGEST + 1))
    return f"""WITH raw AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    pieces AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM raw),
    f AS MATERIALIZED (SELECT lang, size, p, count(*) AS f FROM ({run}) GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND f >= {least}),
    cuts AS (SELECT lang, p, f, k, list_slice(p, 1, k) AS x, list_slice(p, k + 1, size) AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
    scores AS (SELECT cuts.lang, cuts.p, cuts.f AS a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * cuts.f // (l.f + r.f) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.p = x JOIN f r ON r.lang = cuts.lang AND r.p = y),
    low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    inside AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
    kept AS (SELECT low.*, array_to_string(low.p, ' ') AS phrase FROM low LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < {covered} * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN n USING (lang) QUALIFY rank <= {best}"""
