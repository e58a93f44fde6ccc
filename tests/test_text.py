"""Text functions, stems and highlights."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import highlight, stemming
from lodestar.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, expected", [(None, ""), ("   ", ""), ("  Blue \t\n Widget  ", "Blue Widget"), ("\x00\x1fA\x0bB\x00", "A B"), ("\u00a0nbsp\u00a0", "\u00a0nbsp\u00a0")])
def test_normalize(spark, raw, expected):
    assert one(spark, T.normalize(F.lit(raw))) == expected
    assert one(spark, T.normalize_exact(F.lit(raw))) == expected.lower()


def test_words_and_grams(spark):
    assert one(spark, T.words(F.lit("Don't STOP, Élan_9 3.14"))) == ["don't", "stop", "élan_9", "3.14"]
    assert one(spark, T.words(F.lit(None))) == []
    assert one(spark, T.grams(T.words(F.lit("a abc")))) == ["ab", "abc"]
    assert len(one(spark, T.grams(T.words(F.lit("x" * 60))))) == 19
    assert len(one(spark, T.words(F.lit("xy1" * 20000)))) == 1


WORDS = {
    "O'Neil\u2019s 'quoted' rock'n'roll": ["o'neil\u2019s", "quoted", "rock'n'roll"],
    "3.5 1,000.25 2026-04 v1.2 1.a a.1": ["3.5", "1,000.25", "2026", "04", "v1.2", "1", "a", "a", "1"],
    "end. a.b.c. x:y u,v 1;2 1:2": ["end", "a.b.c", "x:y", "u", "v", "1;2", "1", "2"],
    "_a_ __ a__b _1 ² ½ Ⅷ": ["_a_", "a__b", "_1", "ⅷ"],
    "漢字 ひら カタ abc漢 e\u0301t\u00e9": ["漢", "字", "ひ", "ら", "カタ", "abc", "漢", "e\u0301t\u00e9"],
    "..'' , ;": [],
}


@pytest.mark.parametrize("text, expected", WORDS.items())
def test_words_by_unicode_boundaries(spark, text, expected):
    """Spark, Python and the SQL of the oracles cut alike."""
    import duckdb

    from lodestar.catalog.registry import WORD_SQL
    from lodestar.operators.query import _WORD

    assert one(spark, T.words(F.lit(text))) == expected
    assert _WORD.findall(text.lower()) == expected
    assert duckdb.connect().execute(f"SELECT regexp_extract_all(lower(?), '{WORD_SQL}')", [text]).fetchone()[0] == expected


def test_very_long_words(spark):
    for text in ("a.b" * 30000, "a1" * 30000, "x_" * 30000, "1,2." * 20000):
        assert len(one(spark, T.words(F.lit(text)))) >= 1


def test_token_check(spark):
    words = T.words(F.lit("blue widget"))
    assert [one(spark, T.token_check(words, t)) for t in ("wid", "w", "x" * 21, "red")] == ["found", "too short", "too long", "no word with this prefix"]


def test_display_value(spark):
    assert one(spark, T.display_value(F.lit(7), F.lit("Seven"))) == "Seven"
    assert one(spark, T.display_value(F.lit(7), F.lit(None))) == "7"
    assert one(spark, T.display_value(F.lit(" \t "))) is None
    assert one(spark, T.display_value(F.lit("abcdef"), None, 3)) == "abc"


def test_redact(spark):
    assert one(spark, T.redact(F.lit("Find Blue Widget by the BLUE sea (x)"), "blue widget")) == "Find [term] by the [term] sea (x)"
    assert one(spark, T.redact(F.lit("a (x) b"), "(x)")) == "a [term] b"
    assert one(spark, T.redact(F.lit("to be or"), "to be")) == "[term] or"


def test_index_names(spark):
    names = {"ok": True, "9-a.b_c": True, "_x": False, "Upper": False, "": False, "a" * 255: True, "a" * 256: False, None: False}
    for name, good in names.items():
        assert one(spark, T.index_name_valid(F.lit(name).cast("string"))) is good, name


# Published examples of the algorithm's steps.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
    "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
}


@pytest.mark.parametrize("word, expected", STEMS.items())
def test_stems(word, expected):
    assert stemming.stem(word) == expected


def test_english_column(spark):
    assert one(spark, stemming.english_words(F.lit("The licensed operators are licensing"))) == ["licens", "oper", "licens"]
    assert one(spark, stemming.english_words(F.lit(None).cast("string"))) == []


def test_marked_ranges():
    assert highlight.marked_ranges("<ab>c<d>", "<", ">") == ("abcd", [(0, 2), (3, 4)])
    assert highlight.marked_ranges("<ab><c>d", "<", ">") == ("abcd", [(0, 3)])
    for bad in (None, "  ", "abc", "<abc", "abc>", "<a<b>"):
        assert highlight.marked_ranges(bad, "<", ">") is None


def test_highlight(spark):
    text = "A small blue thing, Bluebell"
    assert highlight.ranges_of(text, ["blue"]) == [(8, 12), (20, 28)]
    assert highlight.ranges_of(text, ["b"]) == []
    assert one(spark, highlight.highlight_snippet(F.lit(text), ["blue"])) == "A small <em>blue</em> thing, <em>Bluebell</em>"
    assert one(spark, highlight.highlight_snippet(F.lit("none"), ["blue"])) is None
    long = "word " * 200 + "needle " + "word " * 200
    piece, ranges = highlight.fragment(long, ["needle"])
    assert len(piece) <= 160 and [piece[a:b] for a, b in ranges] == ["needle"]
    assert [(r.start, r.end) for r in one(spark, highlight.highlight_ranges(F.lit(text), ["blue"]))] == [(8, 12), (20, 28)]


def test_token_offsets(spark):
    text = "Élan, 3.14 don't"
    found = one(spark, highlight.token_offsets(F.lit(text)))
    assert [(t.position, t.token, text[t.start : t.end].lower()) for t in found] == [(i, w, w) for i, w in enumerate(["élan", "3.14", "don't"])]
    assert one(spark, highlight.token_offsets(F.lit("abc def"), 3))[-1].token == "abc"


def test_gram_count_is_the_number_of_grams(spark):
    texts = ["a ab abc", "x" * 25, "", None, "日本 ひらがな 1,000 don't _a_"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.gram_count(T.words("t")).alias("n"), F.size(T.grams(T.words("t"))).alias("m")).collect()
    assert [r.n for r in rows] == [r.m for r in rows] and rows[0].n == 3 and rows[1].n == 19


def test_normalize_trims_before_a_line_separator_only_at_the_end(spark):
    assert one(spark, T.normalize(F.lit("\x01 a  b\t c \n\nd e \x1f"))) == "a b c d e"
    assert one(spark, T.normalize(F.lit("a \u0085"))) == "a \u0085"
    assert one(spark, T.display_value(F.lit(" \t\n"))) is None and one(spark, T.display_value(F.lit(" x"))) == " x"


def test_stems_of_batches_keep_rows_apart():
    import pyarrow as pa

    column = pa.array([["x"], ["the", "licensed", "the"], None, [], ["the"], ["licensing", "to", "licenses"]], pa.list_(pa.string()))
    assert stemming._stems(column).to_pylist() == [["x"], ["licens"], [], [], [], ["licens", "licens"]]
    assert stemming._stems(column.slice(1, 3)).to_pylist() == [["licens"], [], []]


def test_words_begin_with_the_start_of_their_stem():
    ends = {s for s, _ in stemming.STEP_2} | {s for s, _ in stemming.STEP_3} | set(stemming.STEP_4) | {"", "s", "ies", "sses", "ed", "ing", "y", "ability", "ization", "fulness", "ously", "ied", "atings", "e"}
    words = [a + m + e for a in ("ab", "rel", "conflat", "hop", "f", "tr", "sky", "nat") for m in ("", "at", "iv", "al", "bl", "iz", "ll", "tt") for e in ends]
    assert all(w.startswith(stemming.stem_start(stemming.stem(w))) for w in words)
