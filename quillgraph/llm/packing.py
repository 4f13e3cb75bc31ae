"""Best-fit packing of tokenised documents into fixed-length sequences by exact-complement hashing.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` lengths with counts,
however many documents there are. The plan packs whole counts of equal lengths at once. Each piece
then finds its slot from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import raw_text, slices
from quillgraph.plans.lineage import cut

#: Token ids of so many different words are remembered by a worker, of words no longer than so many bytes.
REMEMBERED, LONGEST = 150_000, 64
#: Marks that may follow a word; after a letter or digit the tokenizer always cuts before them.
MARKS = b".,;:!?*&%$#"
#: A byte that no UTF-8 text has, in place of the vocabulary's word end.
END = b"\xff"
#: Pieces of one length that are ranked together, about.
RANKED = 10_000


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def word_merges(tokenizer):
    """The vocabulary as ranked byte strings for words that are one run of letters; None if it isn't of that kind.

    Such a vocabulary numbers its tokens in the order of their merges, so merging by token number is
    merging by its rules.
    """
    parts = json.loads(tokenizer.to_str())
    model, vocab = parts["model"], parts["model"].get("vocab", {})
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    first = len(vocab) - len(merges)
    kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or "Lowercase" not in kinds or any(vocab.get(m) != first + i for i, m in enumerate(merges) if m in vocab and not m.startswith("<|")):
        return None
    import tiktoken

    of, ranks = byte_alphabet(), {}
    for token, i in vocab.items():
        if not token.startswith("<|"):
            body = token.removesuffix("</w>")
            ranks[bytes(of[c] for c in body) + (END if body != token else b"")] = i
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordIds(dict):
    """Token ids of words between white space, as little-endian bytes; the tokenizer never merges across it.

    A word of Latin letters is merged directly, and the marks after it apart; any other is left to the tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, word_merges(tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.ids(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, word: bytes) -> bytes:
        if self.merge is not None:
            stem = word.rstrip(MARKS)
            low = self.letters(stem)
            if low:
                ids = array("I", self.merge(low + END)).tobytes()
                return ids + self[word[len(stem) :]] if len(stem) < len(word) else ids
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    @staticmethod
    def letters(stem: bytes) -> bytes | None:
        """A run of Latin letters as the tokenizer lower-cases it; None for anything else."""
        if stem.isalpha():  # ASCII
            return stem.lower()
        if stem.isascii():
            return None
        text = stem.decode("utf-8", "replace")
        low = "".join(map(str.lower, text))
        return low.encode() if low.isalpha() and max(low) < "\u0250" and text.isalpha() and unicodedata.is_normalized("NFC", text) else None


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's known words; they outlast a task, since workers are used again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def pieces(docs: DataFrame, tokenizer_path: str | None, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, start, length, ids_crc32)``: each document's ids, its end id included, cut every ``capacity``.

    The path of the tokenizer's file is looked up on the executor if None is given, since machines
    may keep it in different places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        known, end, step = word_ids(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in slices(batches):
            rows: list[tuple] = []
            for at, raw in enumerate(batch.column(1)):
                ids = b"".join(map(known.__getitem__, raw.as_py().split())) + end
                for i, first in enumerate(range(0, len(ids), step)):
                    part = ids[first : first + step]
                    rows.append((at, i, first // 4, len(part) // 4, zlib.crc32(part)))
            of, *rest = zip(*rows, strict=True) if rows else ([],) * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int32())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, raw_text(text).alias("raw")).mapInArrow(run, f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Stock:
    """How many pieces of each length are left, with the lengths that still have any in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)

    def has(self, wanted: list[int]) -> int:
        """How many times all of ``wanted`` can be taken together."""
        return min(self.left.get(x, 0) // wanted.count(x) for x in set(wanted))

    def exact(self, gap: int, held: list[int]) -> list[int] | None:
        """One, two or three lengths that sum to ``gap`` and can be had besides those ``held``; larger ones first."""

        def free(*more: int) -> bool:
            return self.has([*held, *more]) > 0

        if gap in self.left and free(gap):
            return [gap]
        lengths, left = self.lengths, self.left
        top = bisect_right(lengths, gap - 1)
        for i in range(top - 1, -1, -1):
            a = lengths[i]
            if 2 * a < gap:
                break
            if gap - a in left and free(a, gap - a):
                return [a, gap - a]
        for i in range(top - 1, -1, -1):
            a = lengths[i]
            if 3 * a < gap:
                break
            rest = gap - a
            for j in range(bisect_right(lengths, min(a, rest - 1)) - 1, -1, -1):
                b = lengths[j]
                if 2 * b < rest:
                    break
                if rest - b in left and free(a, b, rest - b):
                    return [a, b, rest - b]
        return None

    def best_fit(self, gap: int, held: list[int]) -> int | None:
        for i in range(bisect_right(self.lengths, gap) - 1, -1, -1):
            if self.has([*held, self.lengths[i]]):
                return self.lengths[i]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how many such sequences), largest lengths first.

    A gap is filled exactly by one, two or three lengths where the stock has them, else by the
    largest length that fits, and then asked again. Every step uses up a length, so the number of
    steps depends on the capacity and not on the number of pieces.
    """
    stock, out = Stock(counts), []
    while stock.lengths:
        held = [stock.lengths[-1]]
        gap = capacity - held[0]
        while gap > 0:
            if more := stock.exact(gap, held):
                held += more
                break
            if (one := stock.best_fit(gap, held)) is None:
                break
            held.append(one)
            gap -= one
        n = stock.has(held)
        for x in held:
            stock.take(x, n)
        out.append((held, n))
    return out


def slots(planned: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of slots, its first sequence, its offset in the sequence."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for held, n in planned:
        offset = 0
        for x in held:
            rows.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return {x: tuple(np.array(v, np.int64) for v in zip(*r, strict=True)) for x, r in rows.items()}


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``rank``, from 0 without gaps among the rows of a length, however many rows one length has."""
    parts = 1 + rows.count() // RANKED
    rows = rows.withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)))
    first = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "piece", "ids_crc32")) - 1
    return rows.withColumn("own", own).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("own")).drop("part", "own", "first")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns ``(key, piece, start, length, ids_crc32, sequence_id, offset)``. A null or empty text is
    its end id alone; a text of more than ``capacity`` tokens is cut, others never are; rows that
    repeat are packed as often as they come; an empty table gives none; other columns are ignored.
    """
    rows = cut(pieces(docs, tokenizer_path, capacity, end_id, key, text))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = slots(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = length == x
                first, start, place = where[int(x)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = start[run] + rank[at] - first[run], place[run]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in (key, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return ranked(rows, key).mapInArrow(place, f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
