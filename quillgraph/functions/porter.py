"""The Porter stemmer (Porter, 1980), applied to distinct terms through an Arrow batch."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published suffix rules of steps 2, 3 and 4.
STEP2 = (
    "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate "
    "alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble"
).split()
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
STEP2 = dict(zip(STEP2[::2], STEP2[1::2], strict=True))
# Ends of words, longest first, by table: most words have none, which one test of them all tells.
ENDS = [(table, tuple(sorted(table, key=len, reverse=True))) for table in (STEP2, STEP3)]
ENDS4 = tuple(sorted(STEP4, key=len, reverse=True))

VOWEL_RUNS = re.compile(r"v+c+")


def _shape(word: str) -> str:
    """Vowels as v, consonants as c; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(VOWEL_RUNS.findall(_shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    return next(s for s in suffixes if word.endswith(s)) if word.endswith(suffixes) else None


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table, ends in ENDS:
        if (s := _longest(word, ends)) and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    if (s := _longest(word, ENDS4)) and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def porter(term: Column) -> Column:
    @F.pandas_udf("string")
    def run(terms):
        return terms.map(lambda t: None if t is None else stem(t))

    return run(term)
