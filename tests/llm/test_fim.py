"""Fill-in-middle against a plain version over Python strings."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import fim

from . import messy


def brute(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", text
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", text


def rows():
    found = [(r[0], r[1]) for r in messy.rows()]
    found += [(400 + i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M", "<S" * 9, "<<P", "🎉" * 500, "é" * 77 + "🎉", "日本" * 3000, "a" * 200_000])]
    return found + [(500 + i, "one text that very many rows share ñ") for i in range(300)]


def frame(spark, found):
    return spark.createDataFrame([(*r, "mine", 7, b"x") for r in found], "doc_id long, text string, h1 string, n_bytes int, bounds binary").repartition(5)


def test_rows_equal_the_plain_version(spark):
    found = fim.fill_in_middle(frame(spark, rows()))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute(*r) for r in rows())
    forms = {r.form for r in found.collect()}
    assert forms == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(messy.empty(spark)).count() == 0


def test_texts_with_one_key_are_told_apart(spark, monkeypatch):
    """A key that several contents share is seen, and their rows are joined by content."""
    monkeypatch.setattr(fim, "_hashes", lambda text: (F.length(text).cast("long") % 3, F.lit(0).cast("long")))
    found = fim.fill_in_middle(frame(spark, rows()))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute(*r) for r in rows())


def test_elias_fano_selects_every_entry():
    rng = random.Random(3)
    for n, step in ((0, 1), (1, 1), (2, 4), (63, 1), (64, 1), (65, 2), (1000, 4), (500, 300)):
        values = np.cumsum([0, *(rng.randint(1, step) for _ in range(n))]).astype(np.int64)
        data = fim.EliasFano.encode(values)
        kept = fim.EliasFano(data)
        assert [kept.select(i) for i in range(len(values))] == values.tolist()
        assert len(data) <= len(values) * (2 + max(1, step).bit_length()) / 8 + 24
    text = "".join(rng.choice("aé日🎉") for _ in range(999))
    kept = fim.EliasFano(fim.boundaries(text.encode()))
    assert [text.encode()[: kept.select(i)].decode() for i in (0, 1, 500, 999)] == [text[:i] for i in (0, 1, 500, 999)]


def test_index_holds_each_text_once(spark):
    docs = frame(spark, rows()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2 = fim._hashes(F.col("text"))
    keyed = docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))
    assert fim.text_index(keyed).count() == len({t for _, t in rows() if t})
