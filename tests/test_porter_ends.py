"""The stemmer's ends of words: longest first, one test tells that a word has none."""

import itertools

from quillgraph.functions import porter


def test_the_longest_end_is_found_first():
    for ends in (*(e for _, e in porter.ENDS), porter.ENDS4):
        for a, b in itertools.product(("", "rel", "comm", "x"), (*ends, "", "zz")):
            word = a + b
            assert porter._longest(word, ends) == max((s for s in ends if word.endswith(s)), key=len, default=None)
    assert [porter.stem(w) for w in ("relational", "hopefulness", "caresses", "ponies", "adjustment", "sky")] == ["relat", "hope", "caress", "poni", "adjust", "sky"]
