"""Importance resampling towards a target distribution, in DataFrame functions only.

Documents are bags of hashed features: all runs of one to three words, each in one of a fixed number
of buckets. A bucket's gain is the logarithm of its share of the target over its share of the corpus;
a document's weight is the sum of its features' gains. Gumbel noise on top of it, from a hash of the
key, makes the highest scores a seeded draw without replacement in proportion to the weights.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import apart, free_name
from quillgraph.plans.lineage import Scratch, cut

#: What isn't a word's character: ASCII but digits and letters (upper case is lowered before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a feature at most; buckets; words of a document that can be drawn at least.
LONGEST, BUCKETS, LEAST_WORDS = 3, 10_000, 20


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else. Plain ASCII takes the short way."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: str) -> Column:
    """A text's words in order; null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(F.col(text), F.lit(""))), GAP), "")


def features(rows: DataFrame, text: str, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``keep`` and ``(word, bucket)``, a row a feature; ``word`` is 1 for features of one word.

    A text without words has one row of nulls, so no row of ``rows`` is lost. Each word comes with the
    ones that follow it, so its features are strings that start at it and need no self-join.
    """
    following = [F.slice("_w", i, F.size("_w")).alias(f"w{i}") for i in range(2, LONGEST + 1)]
    each = rows.select(*keep, words(text).alias("_w")).select(*keep, F.explode_outer(F.arrays_zip(F.col("_w").alias("w1"), *following)).alias("_z"))
    run = lambda n: reduce(lambda s, i: F.concat(s, F.lit(" "), F.col(f"_z.w{i}")), range(2, n + 1), F.col("_z.w1"))
    bucket = lambda n: F.pmod(F.crc32(run(n).cast("binary")), F.lit(buckets)).cast("int")
    flat = each.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), bucket(n).alias("bucket")) for n in range(1, LONGEST + 1)))).alias("_f"))
    return flat.select(*keep, "_f.n", "_f.bucket").where("bucket is not null or n = 1").select(*keep, F.when((F.col("n") == 1) & F.col("bucket").isNotNull(), 1).alias("word"), "bucket")


def counts(rows: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features by bucket, ``buckets`` rows at most."""
    return features(rows, text, [], buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` for every bucket of the corpus, from counts ``(bucket, n)`` of both.

    In thousandths of a nat, rounded down, with one more in each bucket of both sides.
    """
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    wide = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left").join(F.broadcast(total(corpus, "_S"))).join(F.broadcast(total(target, "_T")))
    d = lambda c, more: F.col(c).cast("double") + float(more)
    ratio = F.coalesce(F.col("t"), F.lit(0)).cast("double") + 1.0
    return wide.select("bucket", F.floor(1000.0 * F.ln(ratio * d("_S", buckets) / (d("s", 1) * d("_T", buckets)))).cast("long").alias("gain"))


def noise(key: str, seed: int) -> Column:
    """A key's Gumbel noise in thousandths, rounded down; rows without a key share one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / float(1 << 32)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` for every row of ``docs``.

    Of the rows with ``least_words`` words or more, ``percent`` per cent (rounded down) are drawn, those
    of the highest scores, ties to the smaller key; ``rank`` counts them from 1 and is null for all
    others. A null, blank or wordless text has no features and a weight of 0. Rows that share a key are
    drawn on their own, each with the key's noise; rows without one share theirs and come last in ties.
    An empty table gives no rows; with an empty target all gains come from its even start. Other
    columns are ignored, whatever their names.

    Texts are read twice, once to count buckets and once to sum gains; all that is shuffled is a row a
    bucket and task and a row a document. The gain table has ``buckets`` rows. Ranks come from a sort by
    ranges, each row's place in its range and the sizes of the ranges before, one row a range.
    """
    with Scratch(docs.sparkSession) as scratch:
        given = docs.select(F.col(key), F.col(text).alias("_text" if key != "_text" else "_text_"))
        body = given.columns[1]
        given, row = apart(given, scratch, key, body)
        gain = F.broadcast(scratch.keep(gains(counts(given, body, buckets), counts(target, target_text, buckets), buckets)))
        each = features(given.withColumn("_id", F.col(row)), body, ["_id"], buckets).join(gain, "bucket", "left")
        sums = each.groupBy("_id").agg(F.count("word").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
        if row != key:
            sums = sums.join(given.select(F.col(row).alias("_id"), F.col(key).alias("_key")), "_id")
        else:
            sums = sums.withColumn("_key", F.col("_id"))
        scored = sums.withColumn("score", F.col("weight") + noise("_key", seed))
        places = scored.orderBy((F.col("n_words") >= least_words).desc(), F.desc("score"), F.col("_key").asc_nulls_last())
        placed = scratch.keep(places.withColumn("_at", F.monotonically_increasing_id()))
        eligible = F.count_if(F.col("n_words") >= least_words)
        ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n"), eligible.alias("able"))
        every = Window.orderBy("_range")  # one row a range of the sort
        ranges = ranges.select("_range", (F.sum("n").over(every) - F.col("n")).alias("_before"), F.floor(F.sum("able").over(Window.partitionBy()) * percent / 100).alias("_drawn"))
        known = placed.join(F.broadcast(ranges), F.shiftright(placed["_at"], 33) == F.col("_range"))
        rank = (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).cast("long")
        return cut(known.select(F.col("_key").alias(key), "n_features", "weight", "score", F.when(rank <= F.col("_drawn"), rank).alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, all columns kept; ``key`` must tell them apart."""
    chosen = resample(docs, target, key=key, **options).where("rank is not null")
    name = free_name(docs, "_drawn")
    return docs.join(chosen.select(F.col(key).alias(name)), F.col(key).eqNullSafe(F.col(name)), "left_semi")


def fixed_crc32_sql(texts: str) -> str:
    """CTEs that give ``crcs(f, crc)`` for the distinct strings ``f`` of a relation ``texts``: a CRC is affine in its bytes.

    Each byte has a share by its value and its distance from the end; shares are combined by XOR.
    """
    step = lambda v: f"xor({v} >> 1, CASE WHEN {v} & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    return f"""bits AS (SELECT b AS v, b::UBIGINT AS r, 0 AS i FROM range(256) t(b) UNION ALL SELECT v, {step('r')}, i + 1 FROM bits WHERE i < 8),
    base AS MATERIALIZED (SELECT v, r FROM bits WHERE i = 8),
    known AS MATERIALIZED (SELECT f, encode(f) AS raw, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM {texts})),
    longest AS (SELECT max(n) AS n FROM known),
    shares AS (SELECT v, r, 0::BIGINT AS p FROM base UNION ALL SELECT s.v, xor(s.r >> 8, b.r), s.p + 1 FROM shares s JOIN base b ON b.v = s.r & 255 WHERE s.p < (SELECT n FROM longest)),
    starts AS (SELECT 0::BIGINT AS n, 4294967295::UBIGINT AS r UNION ALL SELECT s.n + 1, xor(s.r >> 8, b.r) FROM starts s JOIN base b ON b.v = s.r & 255 WHERE s.n < (SELECT n FROM longest)),
    bytes AS (SELECT f, n, unnest(range(n)) AS i, raw FROM known),
    mixed AS (SELECT f, any_value(b.n) AS n, bit_xor(s.r) AS r FROM (SELECT f, n, n - 1 - i AS p, ('0x' || substr(hex(raw), 2 * i + 1, 2))::INT AS v FROM bytes) b JOIN shares s ON s.p = b.p AND s.v = b.v GROUP BY f),
    crcs AS (SELECT f, xor(xor(m.r, s.r), 4294967295::UBIGINT) AS crc FROM mixed m JOIN starts s ON s.n = m.n)"""


def sql(percent: int = 5, seed: int = 42, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> str:
    """The whole operator over ``documents`` and ``benchmark`` in DuckDB SQL."""
    cut_words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAP}'), lambda x: x <> '')"
    runs = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: " + " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n)) + ")"
    every = " || ".join(f"({runs(n)})" for n in range(1, LONGEST + 1))
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {cut_words} AS w FROM documents), t AS (SELECT {cut_words} AS w FROM benchmark),
    df AS MATERIALIZED (SELECT doc_id, unnest({every}) AS f FROM d), tf AS MATERIALIZED (SELECT unnest({every}) AS f FROM t), both_f AS (SELECT f FROM df UNION ALL SELECT f FROM tf),
    {fixed_crc32_sql('both_f')},
    db AS MATERIALIZED (SELECT doc_id, crc % {buckets} AS b FROM df JOIN crcs USING (f)), s AS (SELECT b, count(*) AS s FROM db GROUP BY b),
    t2 AS (SELECT crc % {buckets} AS b, count(*) AS t FROM tf JOIN crcs USING (f) GROUP BY 1),
    gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tf) + {buckets})::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t2 ON s.b = t2.b),
    sums AS (SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM db JOIN gain USING (b) GROUP BY doc_id),
    scored AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN sums USING (doc_id)),
    placed AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) END AS r, {percent} * count(*) FILTER (n_words >= {least_words}) OVER () // 100 AS k FROM scored)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= k THEN CAST(r AS BIGINT) END AS rank FROM placed"""
