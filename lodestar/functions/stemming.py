"""The ENGLISH analyzer: stop words and Porter stems, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, words

# Fixed value: the usual English stop words of search engines.
STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)

# The suffix rules of M. F. Porter, "An algorithm for suffix stripping" (1980), steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_PLAIN = re.compile("[a-z]+$")


def _shape(stem: str) -> str:
    """The stem as a string of c (consonant) and v (vowel); y after a consonant is a vowel."""
    out = ""
    for i, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """Porter's stem of a lower-case English word; other words stay as they are."""
    if len(word) <= 2 or not _PLAIN.match(word):
        return word
    end = _longest(word, ("sses", "ies", "ss", "s"))
    word = word if end in (None, "ss") else word[:-2] if end in ("sses", "ies") else word[:-1]

    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_end(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"

    for rules in (dict(STEP_2), dict(STEP_3)):
        end = _longest(word, rules)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]

    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short_end(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def english(tokens: list[str]) -> list[str]:
    return [stem(t) for t in tokens if t not in STOP_WORDS]


def stem_start(token: str) -> str:
    """What each word with this stem begins with: a stem is the beginning of its word with at most two other letters behind it."""
    return token[: max(1, len(token) - 2)]


def _stems(column: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once; the words stay in Arrow."""
    words = column.flatten()
    found = words.dictionary_encode()
    stems = pa.array([None if w is None or w in STOP_WORDS else stem(w) for w in found.dictionary.to_pylist()], pa.string()).take(found.indices)
    kept = stems.is_valid()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    seen = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    offsets = pa.array(seen[np.concatenate([[0], ends]).astype(np.int64)], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.filter(kept))


def stems(words: Column) -> Column:
    """Stems of words, stop words left out; made in Python."""
    return F.arrow_udf(_stems, "array<string>")(words)


def english_words(value: Column | str) -> Column:
    """Stems of the words of a text, stop words left out. Words are cut by Spark; only stems are made in Python."""
    return stems(words(col(value)))
