"""An inverted index in segments: changes add a segment, reads merge them, and searches stop early.

A segment has the postings of the nodes that it was made for, in ranges of documents of like length,
and for each word and range the greatest frequency and the least length in it. From these follows how
much a range can score at most, whatever the lengths' mean has become since. A node's latest segment
counts; a removed node is a row without postings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import query_tokens
from quillgraph.operators.retrieval import K1, NAME_WEIGHT, B, rescaled, tokens, top
from quillgraph.plans.lineage import cut

#: Documents of a range (about), segments before they are merged, ranges of a query that are read first, words that are pushed to the scan.
RANGE_ROWS, SEGMENTS, FIRST, PUSHED = 256, 8, 4, 1000

POSTINGS = "id, term, tf_name, tf_content, length, range"
BOUNDS = "term, range, most, least, n"


def bm25_part(tf: Column, length: Column, mean: Column) -> Column:
    """A word's share of a score but for its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


@dataclass(frozen=True)
class Segment:
    """``postings``, ``bounds``, ``docs`` ``(id, n_name, n_content, digest, gone)`` and ``dfs`` ``(term, n)``, which may be below 0."""

    postings: DataFrame
    bounds: DataFrame
    docs: DataFrame
    dfs: DataFrame
    name: str | None = None

    def write(self, folder: str, name: str) -> Segment:
        """The segment as Parquet; postings by word and range, so that a reader skips what it isn't asked for."""
        spark = self.docs.sparkSession
        self.postings.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.parquet(f"{folder}/{name}/postings")
        for part in ("bounds", "docs", "dfs"):
            getattr(self, part).write.parquet(f"{folder}/{name}/{part}")
        return Segment.read(spark, folder, name)

    @staticmethod
    def read(spark: SparkSession, folder: str, name: str) -> Segment:
        return Segment(*(spark.read.parquet(f"{folder}/{name}/{part}") for part in ("postings", "bounds", "docs", "dfs")), name=name)


def digest() -> Column:
    """What says that a node's texts are the same."""
    return F.xxhash64(F.coalesce("name", F.lit("")), F.coalesce("content", F.lit("")))


def _ranges(docs: DataFrame) -> DataFrame:
    """``(id, length, range)``: documents of like length share a range. A sort by ranges of lengths, and places in each."""
    lengths = docs.select("id", (F.col("n_name") + F.col("n_content")).alias("length")).repartitionByRange("length", "id").sortWithinPartitions("length", "id")
    at = lengths.withColumn("_at", F.monotonically_increasing_id())
    place = F.shiftright("_at", 33) * (1 << 24) + F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / RANGE_ROWS)
    return cut(at.select("id", "length", place.cast("long").alias("range")))


def _bounds(postings: DataFrame) -> DataFrame:
    most = F.max(F.col("tf_name") * NAME_WEIGHT + F.col("tf_content"))
    return cut(postings.groupBy("term", "range").agg(most.alias("most"), F.min("length").alias("least"), F.count("*").alias("n")))


def segment(nodes: DataFrame, removed: DataFrame | None = None, replaced: DataFrame | None = None) -> Segment:
    """A segment of ``nodes`` ``(id, name, content)``; ``replaced`` are the older postings that it stands for."""
    split = cut(nodes.select("id", tokens(F.col("name")).alias("a"), tokens(F.col("content")).alias("b"), digest().alias("digest")))
    docs = split.select("id", F.size("a").cast("long").alias("n_name"), F.size("b").cast("long").alias("n_content"), "digest", F.lit(False).alias("gone"))
    of = lambda c, own: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(own).alias("own")))
    words = split.select("id", F.explode(F.concat(of("a", 1), of("b", 0))).alias("t"))
    counted = words.groupBy("id", "t.term").agg(F.sum("t.own").alias("tf_name"), F.sum(1 - F.col("t.own")).alias("tf_content"))
    postings = cut(counted.join(_ranges(docs), "id").select(*POSTINGS.split(", ")))
    bounds = _bounds(postings)
    if removed is not None:
        zero = F.lit(0).cast("long")
        docs = docs.unionByName(removed.select("id").distinct().select("id", zero.alias("n_name"), zero.alias("n_content"), zero.alias("digest"), F.lit(True).alias("gone")))
    dfs = bounds.groupBy("term").agg(F.sum("n").alias("n"))
    if replaced is not None:
        dfs = dfs.unionByName(replaced.groupBy("term").agg((-F.count("*")).alias("n"))).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
    return Segment(postings, bounds, cut(docs), cut(dfs))


@dataclass(frozen=True)
class InvertedIndex:
    """Segments, the oldest first."""

    segments: tuple[Segment, ...]

    @staticmethod
    def of(nodes: DataFrame) -> InvertedIndex:
        return InvertedIndex((segment(nodes),))

    def _newer(self, i: int) -> DataFrame | None:
        """Ids that later segments have."""
        later = [s.docs.select("id") for s in self.segments[i + 1 :]]
        return reduce(DataFrame.unionAll, later).distinct() if later else None

    def _live(self, i: int, part: DataFrame) -> DataFrame:
        newer = self._newer(i)
        return part if newer is None else part.join(newer, "id", "left_anti")

    def docs(self) -> DataFrame:
        """``(id, n_name, n_content, digest)`` of every node that is indexed."""
        live = [self._live(i, s.docs) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionAll, live).where("not gone").select("id", "n_name", "n_content", "digest")

    def postings(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [self._live(i, s.postings.select(*POSTINGS.split(", "))) for i, s in enumerate(self.segments)])

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """``(id, col, term, tf)`` and ``(id, n_name, n_content)``, as ``retrieval.postings`` gives them."""
        both = F.array(F.struct(F.lit("name").alias("col"), F.col("tf_name").alias("tf")), F.struct(F.lit("content").alias("col"), F.col("tf_content").alias("tf")))
        rows = self.postings().select("id", "term", F.explode(both).alias("x")).where("x.tf > 0").select("id", "x.col", "term", "x.tf")
        return rows, self.docs().select("id", "n_name", "n_content")

    def dfs(self) -> DataFrame:
        """``(term, df)`` over all live nodes, from what segments added and took away."""
        return reduce(DataFrame.unionAll, [s.dfs for s in self.segments]).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def changed(self, nodes: DataFrame | None = None, removed: DataFrame | None = None) -> InvertedIndex:
        """The index after ``nodes`` came or were replaced and ``removed`` ids went; only nodes whose texts differ are split to words."""
        known = self.docs()
        if nodes is None:
            nodes = known.limit(0).select("id", F.lit("").alias("name"), F.lit("").alias("content"))
        new = nodes.select("id", "name", "content", digest().alias("_digest")).join(known.select("id", "digest"), "id", "left")
        new = cut(new.where(F.col("digest").isNull() | (F.col("digest") != F.col("_digest"))).select("id", "name", "content"))
        gone = cut(known.select("id").join(removed.select("id").distinct(), "id", "left_semi")) if removed is not None else None
        touched = new.select("id") if gone is None else new.select("id").unionAll(gone)
        if touched.isEmpty():
            return self
        replaced = self.postings().join(touched, "id", "left_semi").select("term")
        out = InvertedIndex((*self.segments, segment(new, gone, replaced)))
        return out.merged() if len(out.segments) > SEGMENTS else out

    def in_step_with(self, nodes: DataFrame) -> InvertedIndex:
        """The index of ``nodes``, whatever became of them since: what differs is found by digests."""
        known = self.docs().select("id")
        return self.changed(nodes, known.join(nodes.select("id"), "id", "left_anti"))

    def merged(self) -> InvertedIndex:
        """One segment of what is live, from the postings, without reading a text."""
        docs = cut(self.docs().withColumn("gone", F.lit(False)))
        postings = cut(self.postings().drop("length", "range").join(_ranges(docs), "id").select(*POSTINGS.split(", ")))
        bounds = _bounds(postings)
        return InvertedIndex((Segment(postings, bounds, docs, cut(bounds.groupBy("term").agg(F.sum("n").alias("n")))),))

    def save(self, folder: str, fresh: Callable[[], str]) -> InvertedIndex:
        """The index with every segment written under ``folder``; those that are there stay as they are. ``fresh`` names a new one."""
        return InvertedIndex(tuple(s if s.name else s.write(folder, fresh()) for s in self.segments))

    def _plan(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(query_id, term, idf, mean)`` and what each range can bring, ``(query_id, seg, range, bound)``; no posting is read."""
        asked = queries.select("query_id", F.explode(F.array_distinct(query_tokens(F.col("query")))).alias("q"))
        asked = asked.select("query_id", F.explode(F.filter(F.split("q", "[^a-z0-9]+"), lambda t: t != "")).alias("term")).distinct()
        total = self.docs().agg(F.count("*").alias("total"), F.avg(F.col("n_name") + F.col("n_content")).alias("mean"))  # one row
        terms = cut(asked.join(self.dfs(), "term").join(F.broadcast(total)).select("query_id", "term", "df", idf(F.col("df"), F.col("total")).alias("idf"), "mean"))
        bounds = reduce(DataFrame.unionAll, [s.bounds.select(F.lit(i).alias("seg"), *BOUNDS.split(", ")) for i, s in enumerate(self.segments)])
        each = terms.join(bounds, "term").withColumn("most", F.col("idf") * bm25_part(F.col("most"), F.col("least"), F.col("mean")))
        return terms, cut(each.groupBy("query_id", "seg", "range").agg(F.sum("most").alias("bound"), F.sum("n").alias("n")))

    def _scores(self, terms: DataFrame, ranges: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """``(query_id, id, bm25)`` of the documents in ``ranges`` ``(query_id, seg, range)``."""
        words = [r["term"] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
        parts = []
        for i, s in enumerate(self.segments):
            rows = s.postings if len(words) > PUSHED else s.postings.where(F.col("term").isin(words))
            wanted = terms.join(ranges.where(F.col("seg") == i).select("query_id", "range"), "query_id")
            hits = self._live(i, rows.join(wanted, ["term", "range"]))
            share = F.col("idf") * bm25_part(F.col("tf_name") * NAME_WEIGHT + F.col("tf_content"), F.col("length"), F.col("mean"))
            parts.append(hits.groupBy("query_id", "id").agg(F.round(F.sum(share), 9).alias("bm25")))
        out = reduce(DataFrame.unionAll, parts)
        return out if allowed is None else out.join(allowed, "id", "left_semi")

    def _needed(self, terms: DataFrame, ranges: DataFrame, limit: int, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Scores of the ranges that can bring most, and the others that can still bring a hit."""
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "range")
        ranked = cut(ranges.withColumn("_n", F.row_number().over(order)))
        first = cut(top(self._scores(terms, ranked.where(F.col("_n") <= FIRST), allowed), limit, score="bm25"))
        least = first.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("bm25")).alias("least"))
        rest = ranked.where(F.col("_n") > FIRST).join(least, "query_id", "left")
        return first, cut(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-9)))

    def search(self, queries: DataFrame, limit: int = 10, types: list | None = None, nodes: DataFrame | None = None) -> DataFrame:
        """What ``retrieval.keyword_search`` gives for ``(query_id, query)``, without reading all postings of its words.

        Each query first reads the ranges that can bring most. From the last of its best so far follows
        which other ranges can still bring a hit, and those are read, too; none of the rest can.
        ``types`` of ``nodes`` filter results, not statistics.
        """
        allowed = nodes.where(F.col("type").isin(*types)).select("id") if types else None
        terms, ranges = self._plan(queries)
        first, rest = self._needed(terms, ranges, limit, allowed)
        found = first.unionAll(self._scores(terms, rest.select("query_id", "seg", "range"), allowed))
        return rescaled(top(found, limit, score="bm25"))

    def search_costs(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """``(query_id, postings, read)``: postings of a query's words, and those in ranges that ``search`` reads."""
        terms, ranges = self._plan(queries)
        _, rest = self._needed(terms, ranges, limit, None)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "range")
        early = ranges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST).select("query_id", "n")
        read = early.unionAll(rest.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("read"))
        return ranges.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read, "query_id")
