"""Dictionary names in texts: an automaton over the names reads each text once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.lineage import cut

#: Characters of names in one automaton, which takes some 50 bytes for each; a number counts as eight.
PART_CHARS = 1 << 21
#: Texts that are held as Python strings at once.
ROWS = 256

_last: tuple[str, ahocorasick.Automaton] | None = None


class Dictionary:
    """Names with their ids, ``(name, id)``; a worker builds their automaton once and keeps the last one."""

    def __init__(self, rows: list[tuple]):
        self.token, self.ids = uuid.uuid4().hex, {}
        for name, own in rows:
            self.ids.setdefault(name, []).append(own)

    def automaton(self) -> ahocorasick.Automaton:
        global _last
        if _last is None or _last[0] != self.token:
            found = ahocorasick.Automaton()
            for name, ids in self.ids.items():
                found.add_word(name, ids)
            found.make_automaton()
            _last = self.token, found
        return _last[1]


def mentions(texts: DataFrame, names: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(id, name_id)``: texts ``(id, content)`` that hold a dictionary name ``(name_id, name)`` anywhere, in any case.

    An Aho-Corasick automaton over the names finds all of them, inside each other as well, in one pass
    over a text. A dictionary of more than ``part_chars`` characters is dealt by hash to parts of about
    that size, one automaton each, and texts are read once a part; the driver holds one part at a time.
    What is shuffled are the hits, whatever the texts' length. Several names of one id, and several ids
    of one name, are one hit a text and id. Null and empty names are in no text, null texts hold none.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [texts.schema["id"].dataType, names.schema["name_id"].dataType]
    schema = f"id {kinds[0].simpleString()}, name_id {kinds[1].simpleString()}"
    given = cut(names.where(F.length("name") > 0).select(F.lower("name").alias("name"), "name_id").distinct())
    parts = -(-(given.agg(F.sum(F.length("name") + 8)).first()[0] or 0) // part_chars)
    low = texts.select("id", F.lower("content").alias("content")).where("content is not null")

    def search(part: Column | None) -> DataFrame:
        rows = given if part is None else given.where(part)
        sent = texts.sparkSession.sparkContext.broadcast(Dictionary([tuple(r) for r in rows.collect()]))  # about part_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = sent.value.automaton()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    rows, ids = [], []
                    for i, text in enumerate(batch.column(1).slice(at, ROWS), at):
                        found = {x for _, own in automaton.iter(text.as_py()) for x in own} if len(automaton) else ()
                        rows += [i] * len(found)
                        ids += found
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, to_arrow_type(kinds[1]))], ["id", "name_id"])

        return low.mapInArrow(run, schema)

    if parts <= 1:
        return search(None).distinct()
    own = F.pmod(F.xxhash64("name", "name_id"), F.lit(parts))
    return reduce(DataFrame.unionAll, [cut(search(own == p)) for p in range(parts)]).distinct()


def mention_edges(found: DataFrame, type_: str = "derived_from", context: str = "Lesson derived from") -> DataFrame:
    """Edges from texts to the names that they hold, each with its context."""
    return found.select(F.col("id").alias("source"), F.col("name_id").alias("target"), F.lit(type_).alias("type"), F.concat_ws(" ", F.lit(context), F.col("name_id").cast("string")).alias("context"))
