"""Text as columns: normalisation, tokens, grams and token checks.

Lengths and cuts count code points. Everything here is built from Spark's own
functions, so it stays in generated code and reaches the scan as pruned columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words follow the word boundaries of Unicode (UAX 29) for letters, digits and what may stand between them.
# Characters of the properties MidLetter, MidNum and MidNumLet with the single quote.
MID_LETTER = r":\u00B7\u0387\u055F\u05F4\u2027\uFE13\uFE55\uFF1A"
MID_NUM = r",;\u037E\u0589\u060C\u060D\u066C\u07F8\u2044\uFE10\uFE14\uFE50\uFE54\uFF0C\uFF1B"
MID_NUM_LET = r".\u2018\u2019\u2024\uFE52\uFF07\uFF0E\x27"


def word_pattern(letter: str) -> str:
    """A word: letters that may have one of MID_LETTER or MID_NUM_LET between each other, digits that may have one of
    MID_NUM or MID_NUM_LET, in any row, and underscores among and around them; or one ideograph or Hiragana sign.
    No repeat of a group gives back what it took, so long words need no deep stack."""
    part = rf"(?:{letter}+(?:[{MID_LETTER}{MID_NUM_LET}]{letter}+)*+|\p{{Nd}}+(?:[{MID_NUM}{MID_NUM_LET}]\p{{Nd}}+)*+)"
    return rf"_*+{part}(?:_*+{part})*+_*+|[\p{{IsHan}}\p{{IsHiragana}}]\p{{M}}*+"


# Below U+2E80 there are no ideographs and no Hiragana, so that most characters need no look at their script.
WORD = word_pattern(r"[a-z[\p{L}\p{M}\p{Nl}&&[\x00-\u2E7F[^\p{IsHan}\p{IsHiragana}]]]]").replace("|[\\p{IsHan}", r"|(?![\x00-\u2E7F])[\p{IsHan}")
#: The same for Python's module regex (version 1 of its syntax).
WORD_REGEX = word_pattern(r"[a-z[[\p{L}\p{M}\p{Nl}]--[\p{IsHan}\p{IsHiragana}]]]")
#: Blanks that aren't one space already, so that most of a text is left as it is.
BLANK = r"[\t\n\x0B\f\r][ \t\n\x0B\f\r]*+| [ \t\n\x0B\f\r]++"
SHOWN = r"[^ \t\n\x0B\f\r]"
EDGE = "".join(map(chr, range(0x21)))
#: Prefix lengths that the index side of the prefix analyzer holds.
MIN_GRAM, MAX_GRAM = 2, 20
#: Longer exact values aren't indexed.
MAX_EXACT = 1024


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize(value: Column | str) -> Column:
    """Trimmed of all characters up to U+0020, blanks collapsed to one space; null is empty, case is kept."""
    trimmed = F.btrim(F.coalesce(col(value), F.lit("")), F.lit(EDGE))
    return F.regexp_replace(trimmed, BLANK, " ")


def normalize_exact(value: Column | str) -> Column:
    return F.lower(normalize(value))


def words(value: Column | str) -> Column:
    """Lower-cased words in order of appearance; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(value), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def grams(tokens: Column) -> Column:
    """Prefixes of MIN_GRAM to MAX_GRAM characters of each word, as the index side of the prefix analyzer holds them."""
    return F.flatten(
        F.transform(
            F.filter(tokens, lambda w: F.length(w) >= MIN_GRAM),
            lambda w: F.transform(F.sequence(F.lit(MIN_GRAM), F.least(F.length(w), F.lit(MAX_GRAM))), lambda n: F.substring(w, 1, n)),
        )
    )


def gram_count(tokens: Column) -> Column:
    """How many ``grams`` there are, from the lengths of the words; none is formed."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda n, w: n + F.greatest(F.least(F.length(w), F.lit(MAX_GRAM)) - MIN_GRAM + 1, F.lit(0)))


def prefix_possible(token: str) -> bool:
    """Whether a query token can match any prefix at all."""
    return MIN_GRAM <= len(token) <= MAX_GRAM


def prefix_count(tokens: Column, token: str) -> Column:
    """How many words of an array begin with a query token."""
    return F.size(F.filter(tokens, lambda w: w.startswith(token))) if prefix_possible(token) else F.lit(0)


def equal_count(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == token))


def token_check(tokens: Column, token: str) -> Column:
    """Why a query token is or isn't found by prefix in the words of a text."""
    return (
        F.when(F.lit(len(token) < MIN_GRAM), "too short")
        .when(F.lit(len(token) > MAX_GRAM), "too long")
        .when(F.exists(tokens, lambda w: w.startswith(token)), "found")
        .otherwise("no word with this prefix")
    )


def display_value(value: Column | str, label: Column | str | None = None, max_length: int = 10_000) -> Column:
    """The label if there is one, else the value as text; blank is null; cut at ``max_length``."""
    shown = col(value).cast("string") if label is None else F.coalesce(col(label), col(value).cast("string"))
    return F.when(shown.rlike(SHOWN), truncated(shown, max_length))


def truncated(value: Column | str, max_length: int) -> Column:
    """The first ``max_length`` characters, whatever they are: blanks stay, null is null."""
    return F.substring(col(value), 1, max_length)


def redact(text: Column | str, term: str, mark: str = "[term]") -> Column:
    """The term, and each of its words of three characters or more, replaced whatever their case."""
    parts = [term, *sorted({w for w in term.split() if len(w) >= 3}, key=lambda w: (-len(w), w))]
    quoted = ("".join(c if c.isalnum() or c == "_" else f"\\{c}" if c.isascii() and not c.isspace() else c for c in p) for p in parts if p)
    return reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", mark), quoted, col(text))


def contains_ignoring_case(value: Column | str, needle: str) -> Column:
    return F.contains(F.lower(col(value)), F.lit(needle.lower()))


def index_name_valid(name: Column | str) -> Column:
    """Lower-case names of at most 255 characters that begin with a letter or digit."""
    return F.coalesce(col(name).rlike(r"^[a-z0-9][a-z0-9_.\-]*$") & (F.length(col(name)) <= 255), F.lit(False))
