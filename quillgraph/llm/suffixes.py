"""Exact removal of repeated byte strings, by sorting suffixes bucket by bucket.

A suffix counts by its first 100 bytes, its window. Windows go to buckets by their seed, the run of
32 bytes in them whose hash is the least: equal windows have equal seeds at equal places, and a seed's
windows lie side by side, so a document sends a seed's suffixes as one run of bytes. Of seeds that
occur once no suffix is sorted. Of runs that are the same all over, only the first takes part; the
others repeat it. The rest is sorted one bucket at a time: ranks of the positions of a difference
cover are doubled to 64 bytes, and a suffix is compared by a few bytes up to the next position of the
cover and the ranks from there on, never by its whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Maybe, apart, raw_text, slices
from quillgraph.llm.words import BASE, mixed
from quillgraph.plans.lineage import Scratch, cut

#: Bytes of a window, of a seed, of a block whose ranks are known; a power of two and its half twice must make the last two.
WINDOW, SEED, BLOCK = 100, 32, 64
#: Places of a seed in a window; columns of a bucket's table, whose runs are laid out with their seeds below each other.
PLACES = WINDOW - SEED + 1
COLUMNS = PLACES - 1 + WINDOW
#: A difference cover: each number below the modulus is the difference of two of it.
MODULUS, COVER = 16, (0, 1, 2, 5, 8)
#: Bytes that are hashed together, runs that a bucket holds on the average, and of one seed at most.
CHUNK, BUCKET_RUNS, SEED_RUNS = 1 << 18, 1 << 14, 1 << 16
#: Bits that hold a place in a chunk.
LOW = np.uint64((1 << 20) - 1)
#: Bits of a filter for each key in it, and of a filter at most (16 MB): a fuller one only lets more rows through.
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``SEED`` and of ``BLOCK`` bytes that start at each place, by doubling."""
    with np.errstate(over="ignore"):
        h, n, seeds = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, None
        while n < BLOCK:
            h = h[:-n] * np.uint64(pow(BASE, n, 1 << 64)) + h[n:] if len(h) > n else h[:0]
            n *= 2
            seeds = h if n == SEED else seeds
    return mixed(seeds), mixed(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by doubling."""
    out, n = values, 1
    while 2 * n <= width:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    return np.minimum(out[: len(out) - (width - n)], out[width - n :]) if n < width else out


def runs_of(texts: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of windows that share a seed, of texts end to end.

    ``text`` (its number), ``lo`` and ``hi`` (the first and last window's place in it), ``at`` (the
    seed's), ``h`` and ``g`` (hashes of the seed and of all the run's bytes).
    """
    parts: list[tuple] = []
    ends = offsets[1:]
    for begin in range(0, len(texts), CHUNK):
        data = texts[begin : begin + CHUNK + WINDOW - 1]
        if len(data) < WINDOW:
            break
        seeds, blocks = _hashes(data)
        place = np.arange(len(seeds), dtype=np.uint64)
        best = _least((seeds & ~LOW) | place, PLACES)  # the leftmost of the least, by the upper bits
        anchor = (best & LOW).astype(np.int64)
        valid = np.ones(len(anchor) + 1, bool)
        valid[-1] = False
        for e in ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + len(data))] - begin:
            valid[max(0, e - WINDOW + 1) : e] = False  # windows over the end of a text
        new = valid[:-1].copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-2]
        first = np.flatnonzero(new)
        stop = np.flatnonzero(valid[:-1] & np.append(new[1:] | ~valid[1:-1], True))  # a run over the chunk's end is two runs
        if not len(first):
            continue
        at, end = anchor[first], stop + WINDOW
        with np.errstate(over="ignore"):
            g = (at - first).astype(np.uint64) * np.uint64(BASE) + (end - first).astype(np.uint64)
            for piece in (first, first + WINDOW - BLOCK, end - WINDOW, end - BLOCK):  # together all of the run's bytes
                g = mixed(g * np.uint64(BASE) + blocks[piece])
        parts.append((np.searchsorted(ends, first + begin, "right"), first + begin, stop + begin, at + begin, seeds[at], g))
    if not parts:
        none = np.zeros(0, np.int64)
        return {"text": none, "lo": none, "hi": none, "at": none, "h": none.view(np.uint64), "g": none.view(np.uint64)}
    text, lo, hi, at, h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
    base = offsets[text]
    return {"text": text, "lo": lo - base, "hi": hi - base, "at": at - base, "h": h, "g": g}


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of bytes without nulls as one array and its offsets."""
    _, ends, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) > 1 else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict]]:
    """Rows' numbers, their bytes and the runs in them, of ``(row, text)`` batches."""
    for batch in slices(batches, 512):
        data, offsets = _flat(batch.column(1))
        yield batch.column(0).to_numpy(), data, offsets, runs_of(data, offsets)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, runs in _found(batches):
        h, n = np.unique(runs["h"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _known(repeated: Maybe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs whose seed may be repeated."""
        for rows, _, _, runs in _found(batches):
            keep = repeated.has(runs["h"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs["h"][keep].view(np.int64)), pa.array(runs["g"][keep].view(np.int64)), pa.array(rows[runs["text"][keep]]), pa.array(runs["lo"][keep].astype(np.int32)), pa.array(runs["hi"][keep].astype(np.int32))],
                ["h", "g", "row", "lo", "hi"],
            )

    return run


def _mark(h: np.ndarray, g: np.ndarray, row: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One hash for a run at its place."""
    with np.errstate(over="ignore"):
        return mixed(mixed(h * np.uint64(BASE) + g) + row.view(np.uint64) * np.uint64(BASE) + lo.astype(np.uint64))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, g, row, lo = (c.to_numpy() for c in batch.columns[:4])
        yield pa.RecordBatch.from_arrays([pa.array(_mark(h.view(np.uint64), g.view(np.uint64), row, lo).view(np.int64))], ["h"])


def _open(wanted: Maybe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that may be wanted, with their bytes."""
        for rows, data, offsets, runs in _found(batches):
            at = np.flatnonzero(wanted.has(_mark(runs["h"], runs["g"], rows[runs["text"]], runs["lo"])))
            text, lo, hi = runs["text"][at], runs["lo"][at], runs["hi"][at]
            size = hi - lo + WINDOW
            ends = np.concatenate([[0], np.cumsum(size)])
            body = data[np.repeat(offsets[text] + lo - ends[:-1], size) + np.arange(ends[-1])]
            held = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs["h"][at].view(np.int64)), pa.array(runs["g"][at].view(np.int64)), pa.array(rows[text]), pa.array(lo.astype(np.int32)), pa.array((runs["at"][at] - lo).astype(np.int32)), held],
                ["h", "g", "row", "lo", "off", "bytes"],
            )

    return run


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _eight(table: np.ndarray, column: int, n: int = 8) -> np.ndarray:
    """Up to eight bytes from a column on as a number that sorts as they do."""
    out = np.zeros((len(table), 8), np.uint8)
    out[:, 8 - n :] = table[:, column : column + n]
    return out.view(">u8").ravel().astype(np.uint64)


def cover_ranks(table: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of the ``BLOCK`` bytes from each column of the cover on, by doubling: a column and the one so much later are both of it."""
    last = table.shape[1]
    columns = [c for c in range(last) if c % MODULUS in COVER]
    known = {c: _ranks(_eight(table, c), _eight(table, c + 8)) for c in columns if c + MODULUS <= last}
    n = MODULUS
    while n < BLOCK:
        known = {c: _ranks((r << np.uint64(32)) | known[c + n]) for c, r in known.items() if c + n in known}
        n *= 2
    return known


def repeats(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which windows an earlier row has: a bucket's rows in order of their places, windows from column ``lo`` to ``hi`` of each.

    The suffixes of one column are sorted at a time. A suffix's key is what lies before the next column
    of the cover, the ranks there and at the last one from which a block still ends in the window, and
    what lies after that block. No more than a few bytes are compared directly.
    """
    ranks = cover_ranks(table)
    out = np.zeros((len(table), PLACES), bool)
    for c in range(PLACES):
        rows = np.flatnonzero((lo <= c) & (c <= hi))
        if len(rows) < 2:
            continue
        near = next(s for s in range(c, c + MODULUS) if s in ranks)
        far = next(s for s in range(c + WINDOW - BLOCK, c, -1) if s in ranks)
        keys = [(ranks[near][rows] << np.uint64(32)) | ranks[far][rows]]
        if near > c:
            keys.append(_eight(table, c, near - c)[rows])
        if far + BLOCK < c + WINDOW:
            keys.append(_eight(table, far + BLOCK, c + WINDOW - far - BLOCK)[rows])
        order = np.lexsort(keys)  # stable: rows of equal windows stay in their order
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            same &= k[order[1:]] == k[order[:-1]]
        out[rows[order[1:][same]], c] = True
    return out


def _sorted_bucket(bucket: pa.Table) -> pa.Table:
    """Covered stretches ``(row, lo, hi)`` of a bucket's runs."""
    row, lo, off = (bucket.column(c).to_numpy() for c in ("row", "lo", "off"))
    order = np.lexsort((lo + off, row))
    data, offsets = _flat(bucket.column("bytes").combine_chunks().take(pa.array(order)))
    row, lo, off = row[order], lo[order].astype(np.int64), off[order].astype(np.int64)
    size = np.diff(offsets)
    begin = PLACES - 1 - off
    table = np.zeros((len(row), COLUMNS), np.uint8)
    table[np.repeat(np.arange(len(row)), size), np.arange(len(data)) - np.repeat(offsets[:-1] - begin, size)] = data
    again = repeats(table, begin, begin + size - WINDOW)
    edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    shift = (lo - begin)[i]
    return pa.table([pa.array(row[i]), pa.array((first + shift).astype(np.int32)), pa.array((after - 1 + WINDOW + shift).astype(np.int32))], ["row", "lo", "hi"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row ``(h, u, v, row, at)`` for each window of runs ``(h, row, lo, off, bytes)``: hashes of its first and last block, and its place."""
    for batch in slices(batches, 1024):
        data, offsets = _flat(batch.column(4))
        if not len(data):
            continue
        _, blocks = _hashes(data)
        windows = np.diff(offsets) - WINDOW + 1
        i = np.repeat(np.arange(len(windows)), windows)
        step = np.arange(len(i)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = offsets[i] + step
        lo, off = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
        u, v = blocks[at], mixed(blocks[at + WINDOW - BLOCK] + (off[i] - step).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), batch.column(1).take(pa.array(i)), pa.array((lo[i] + step).astype(np.int32))], ["h", "u", "v", "row", "at"])


def _filter(keys: DataFrame) -> Maybe:
    """A filter over ``h`` whose size follows the number of keys, up to ``MOST_BITS``."""
    bits = 1 << 16
    while bits < min(keys.count() * BITS_A_KEY, MOST_BITS):
        bits *= 2
    return Maybe(keys, "h", hashed=True, bits=bits)


def covered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, lo, hi)``: stretches of bytes of ``rows``, ``(row, text)`` of long and binary, that windows with an earlier equal cover."""
    seeds = rows.mapInArrow(_seeds, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = _filter(scratch.keep(seeds.where("n > 1").select("h")))
    runs = scratch.keep(rows.mapInArrow(_known(repeated), "h long, g long, row long, lo int, hi int"))
    kinds = scratch.keep(runs.groupBy("h", "g").agg(F.min(F.struct("row", "lo")).alias("first"), F.count("*").alias("n")))
    # all of a run but its first occurrence; only runs that occur again take part in the join
    again = runs.join(kinds.where("n > 1").select("h", "g", "first"), ["h", "g"]).where((F.col("row") != F.col("first.row")) | (F.col("lo") != F.col("first.lo")))
    again = again.select("row", "lo", (F.col("hi") + WINDOW).alias("hi"))
    # seeds whose runs differ
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    firsts = scratch.keep(kinds.join(several, "h").select("h", "g", "first.row", "first.lo", "kinds"))
    wanted = _filter(scratch.keep(firsts.mapInArrow(_marks, "h long")))
    bytes_of = rows.mapInArrow(_open(wanted), "h long, g long, row long, lo int, off int, bytes binary")
    wide = scratch.keep(bytes_of.join(firsts, ["h", "g", "row", "lo"]).select("h", "row", "lo", "off", "bytes", "kinds"))
    few, many = wide.where(F.col("kinds") <= SEED_RUNS), wide.where(F.col("kinds") > SEED_RUNS)
    buckets = max(1, -(-few.count() // BUCKET_RUNS))
    dealt = few.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int")).select("bucket", "row", "lo", "off", "bytes")
    by_bucket = dealt.groupBy("bucket").applyInArrow(_sorted_bucket, "row long, lo int, hi int")
    single = scratch.keep(many.select("h", "row", "lo", "off", "bytes").mapInArrow(_single, "h long, u long, v long, row long, at int"))
    least = single.groupBy("h", "u", "v").agg(F.min(F.struct("row", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    by_window = single.join(least, ["h", "u", "v"]).where((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    return again.unionAll(by_bucket).unionAll(by_window.select("row", "at", (F.col("at") + WINDOW).alias("hi")))


def _split(lossy: Maybe, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``(row, text, key, h)`` that may lose something, or those that surely don't."""
        for batch in batches:
            yield batch.filter(pa.array(lossy.has(batch.column(3).to_numpy().view(np.uint64)) == keep)).select([0, 1, 2])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of ``(key, text, stretches)``."""
    for batch in slices(batches):
        out = []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            raw, pieces, spans, gone, end = text.as_py(), [], 0, 0, 0
            for lo, hi in sorted((x["lo"], x["hi"]) for x in found.as_py() or ()):
                if lo > end or not spans:
                    pieces.append(raw[end:lo])
                    spans, end = spans + 1, lo
                gone, end = gone + max(0, hi - end), max(end, hi)
            kept = b"".join(pieces) + raw[end:]
            out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` and, if asked, ``kept`` (bytes) for every row.

    Each byte that a string of 100 bytes covers which also starts earlier goes: in a row before (by key,
    rows without one last, rows of one key in the order of a hash of their texts) or earlier in the same
    row, overlaps included. Strings never cross rows. Null and empty texts have no bytes; texts under
    100 bytes stay; repeated rows lose all their bytes but the first. An empty table gives no rows.
    Other columns are ignored, whatever their names.

    Texts are read three times, and hashed at about 30 nanoseconds a byte: to count seeds, to find
    their runs, and for the bytes of runs that differ though their seeds don't. A bucket has about
    ``BUCKET_RUNS`` runs; a seed with more than ``SEED_RUNS`` different ones is counted window by window
    in the shuffle instead. Runs that are equal all over are told by 128 bits of hashes, windows of such
    hot seeds by 192. Only texts that lose something (a filter tells) are shuffled.
    """
    with Scratch(docs.sparkSession) as scratch:
        given = docs.select(F.col(key).alias("key"), raw_text(text).alias("text"))
        if docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte"):
            given, row = apart(given, scratch, "key", "text")
        else:
            given, row = scratch.keep(given.orderBy(F.col("key").asc_nulls_last(), F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())), "_row"
        rows = given.select(F.col(row).cast("long").alias("row"), "text", "key")
        found = scratch.keep(covered(rows.select("row", "text"), scratch))
        by_row = scratch.keep(found.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches")))
        lossy = _filter(by_row.select(F.xxhash64("row").alias("h")))
        hashed = rows.withColumn("h", F.xxhash64("row"))
        some, whole = hashed.mapInArrow(_split(lossy, True), rows.schema), hashed.mapInArrow(_split(lossy, False), rows.schema)
        columns = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_kept else [])
        zero = F.lit(0).cast("long")
        same = whole.select("key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
        cleared = some.join(by_row, "row", "left").select("key", "text", "stretches").mapInArrow(_kept, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        return cut(same.select(*columns).unionByName(cleared.select(*columns)).withColumnRenamed("key", key))


def sql(block: int = 128) -> str:
    """The same over ``documents`` in DuckDB SQL, every window's MD5 grouped; texts are cut to blocks first, so that no long text is searched for an offset."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    blocks AS (SELECT doc_id, n, b, substr(x, 2 * {block} * b + 1, 2 * {block + WINDOW - 1}) AS y FROM (SELECT *, unnest(range((n + {block - 1}) // {block})) AS b FROM d)),
    windows AS (SELECT doc_id, {block} * b + i AS p, md5_number(substr(y, 2 * i + 1, {2 * WINDOW})) AS s FROM (SELECT *, unnest(range({block})) AS i FROM blocks) WHERE {block} * b + i + {WINDOW} <= n),
    firsts AS (SELECT s, min((doc_id, p)) AS first FROM windows GROUP BY s HAVING count(*) > 1),
    again AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE (doc_id, p) <> first),
    marks AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + {WINDOW}, true) AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    islands AS (SELECT doc_id, p, count_if(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marks),
    spans AS (SELECT doc_id, k, min(p) AS lo, max(p) + {WINDOW} AS hi FROM islands GROUP BY doc_id, k),
    pieces AS (SELECT spans.doc_id, k, lo, hi, substr(x, 2 * coalesce(lag(hi) OVER w, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER w, 0))) AS before FROM spans JOIN d USING (doc_id) WINDOW w AS (PARTITION BY spans.doc_id ORDER BY k)),
    cleared AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, string_agg(before, '' ORDER BY k) AS head, max(hi) AS hi FROM pieces GROUP BY doc_id)
    SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
        sha256(CASE WHEN hi IS NULL THEN unhex(x) ELSE unhex(head || substr(x, 2 * hi + 1)) END) AS kept_sha256 FROM d LEFT JOIN cleared USING (doc_id)"""
