"""Token alignment against a plain version that encodes whole texts."""

import collections
import hashlib
import random

import pytest

from lodestar.llm import alignment

from . import messy


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows():
    found = [(r[0], r[1]) for r in messy.rows(n=30)]
    odd = ["a ▁ b", "▁", "<s> </s> <unk> <0x41> <|endoftext|> it's", " ", "  ", " a", "a ", "a  b\n c \n\n  d\t e", "日本語 の文 🎉🎉🏽 é́", "\x00 nul \x1f x", "a  b  c", "don't can't  we'll", "1234567890 " * 40, "x" * 5000, "ünïcödé " * 9, "  line", "🎉" * 300]
    return found + [(400 + i, t) for i, t in enumerate(odd)] + [(500 + i, odd[7]) for i in range(40)]


def brute(found, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(paths[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    letters = alignment.byte_of_letter()
    docs, counts = [], collections.Counter()
    for doc_id, text in found:
        groups, pairs, n = [], [], (0, 0)
        if text:
            a = [(i, len(tok.id_to_token(i)), bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, p := sp.id_to_piece(i), bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text)]
            if b"".join(x[2] for x in a) == b"".join(x[2] for x in b) == (" " + text).encode():
                n = len(a), len(b)
                i = j = left = right = 0
                ga, gb = [], []
                while i < len(a):
                    pairs.append((a[i][0], b[j][0]))
                    ea, eb = left + len(a[i][2]), right + len(b[j][2])
                    if ea <= eb:
                        ga.append(a[i][0])
                        i, left = i + 1, ea
                    if eb <= ea:
                        gb.append(b[j][0])
                        j, right = j + 1, eb
                    if ea == eb:
                        groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                        ga, gb = [], []
        counts.update(set(pairs))
        docs.append((doc_id, *n, len(groups), pairs, ";".join(groups)))
    most = collections.defaultdict(int)
    for (a, _), k in counts.items():
        most[a] = max(most[a], k)
    return [(d, na, nb, ng, len(p), sum(counts[x] == most[x[0]] for x in p), sum(counts[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for d, na, nb, ng, p, g in docs]


def test_rows_equal_the_plain_version(spark, paths, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "u", 5) for r in rows()], "doc_id long, text string, block int, unit string, at int").repartition(3)
    expected = brute(rows(), paths)
    assert collections.Counter(map(tuple, alignment.align(docs, *paths, keep_groups=True).collect())) == collections.Counter(expected)
    assert sum(r[1] > 0 for r in expected) > 60 and sum(r[1] == 0 for r in expected) >= 5
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)  # many blocks
    found = alignment.align(docs, *paths).drop("groups")
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(r[:-1] for r in expected)
    assert alignment.align(messy.empty(spark), *paths).count() == 0


def test_units_are_encoded_as_their_texts_are(paths):
    """The tokens of a text's units, put end to end, are those of the text."""
    import sentencepiece

    both, whole = alignment.Tokenizers.of(*paths), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "the", " ", " ", "  ", "\n", "\t", "'s", "1", ".", "...", "é", "日", "🎉", "\xa0", "\x1c", "\u0085", "<s>", "Ab", "((", "_", "\u0301", "԰"]) for _ in range(rng.randint(1, 14)))
        found = [u for w in alignment.words(text) for u in both.units(w)]
        assert "".join(found) == " " + text
        a, b, same = both.encode(found)
        assert all(same)
        assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert sum(b, []) == whole.encode(text), repr(text)


def test_links_of_long_units_are_not_paired(spark):
    """Tokens that never end together form one group; its links are as many as its ends."""
    n = 3000
    tokens = spark.createDataFrame([(7, [1] * n, [2] * n, [2] * n, [3] + [2] * (n - 2) + [1])], "u long, a array<int>, b array<int>, a_size array<int>, b_size array<int>")
    row = alignment.aligned_units(tokens).collect()[0]
    assert (row.n_groups, len(row.links)) == (1, 2 * n - 1)


def test_blocks_are_row_groups(spark, tmp_path, monkeypatch, paths):
    """Rows of many MB are written and read one by one, however many a task makes."""
    import glob

    import pyarrow.parquet as pq

    from lodestar.llm.scratch import Scratch

    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, *args, **kw: written.append(write(self, *args, **kw)) or written[-1])
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 0)  # a block for each document; tasks of a local session are forked from here
    docs = spark.createDataFrame([(i, f"text {i} of it") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert alignment.align(docs, *paths).count() == 40
    of_blocks = [t for t in written if {"vocab", "pairs"} & set(t.columns) and "block" in t.columns]
    assert len(of_blocks) == 2
    for table in of_blocks:
        files = glob.glob(f"{table._lodestar_path.removeprefix('file:')}/*.parquet")
        groups = [pq.ParquetFile(f).metadata for f in files]
        assert sum(m.num_rows for m in groups) == table.count() > 0
        assert all(m.num_row_groups == m.num_rows for m in groups)


def test_groups_of_a_block_take_little_memory():
    """Of the texts of the groups few are held at once: the peak is a small multiple of the block's units."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, per_unit = 40_000, 12
    link = lambda i: (((i % 50_000) << 30) + i % 30_000 << 2) + 3
    links = pa.array([[link(i * per_unit + k) for k in range(per_unit)] for i in range(n)], pa.list_(pa.int64()))
    found = pa.table({"at": pa.array(np.arange(n, dtype=np.int32)), "same": pa.array([True] * n), "n_groups": pa.array([per_unit] * n, pa.int64()), "links": links})
    words = np.arange(n, dtype=np.int32)
    block = pa.table({"block": [7], "sizes": pa.array([[n // 100] * 100], pa.list_(pa.int32())), "ids": [alignment._pack([words])], "n_units": [alignment._pack([np.ones(n, np.int32)])], "units": [alignment._pack([words])]})
    texts = sum(len(f"{(i * per_unit + k) % 50_000}|{(i * per_unit + k) % 30_000};") for i in range(n) for k in range(per_unit))
    run = alignment._documents(False)
    tracemalloc.start()
    try:
        out = run(block, found)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.column("n_groups").to_pylist() == [[n // 100 * per_unit] * 100]
    assert peak < 8 * texts, (peak, texts)
