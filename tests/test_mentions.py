"""Names in texts against a plain search."""

import random

import pytest

from quillgraph.sources import mentions as M


def frames(spark, texts, names):
    return spark.createDataFrame(texts, "id long, content string"), spark.createDataFrame(names, "name_id long, name string")


def plain(texts, names):
    return {(i, n) for i, t in texts for n, name in names if t is not None and name and name.lower() in t.lower()}


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("part_chars", [1 << 21, 200, 30])
def test_every_name_in_every_part(spark, part_chars):
    r = random.Random(1)
    names = [(i % 40, "".join(r.choice("abÄ ") for _ in range(r.randrange(1, 6)))) for i in range(60)] + [(7, "Zz"), (8, "zZ"), (9, "")]
    texts = [(i, "".join(r.choice("abäzZ ") for _ in range(r.randrange(40)))) for i in range(200)] + [(5, "again aba"), (999, None), (1000, "")]
    t, n = frames(spark, texts, names)
    assert got(M.mentions(t, n, part_chars)) == plain(texts, names)


def test_no_names_no_texts(spark):
    t, n = frames(spark, [(1, "text")], [(1, "text")])
    assert got(M.mentions(t, n.limit(0))) == set() and got(M.mentions(t.limit(0), n)) == set()


def test_the_shuffle_does_not_carry_texts(spark):
    t, n = frames(spark, [(i, "x" * 1000) for i in range(50)], [(1, "xx")])
    plan = M.mentions(t, n)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "MapInArrow" in below and "Exchange" not in below[below.index("MapInArrow") :]
    assert len(got(M.mentions(t, n))) == 50


def test_edges(spark):
    t, n = frames(spark, [(1, "Lakoff wrote")], [(3, "lakoff")])
    assert [tuple(r) for r in M.mention_edges(M.mentions(t, n)).collect()] == [(1, 3, "derived_from", "Lesson derived from 3")]
