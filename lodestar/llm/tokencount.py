"""Operator 1: token counts without token ids.

Pieces are counted once per distinct pre-token and joined to the pre-token
frequencies of the documents:

1. Each task cuts its documents into blocks (about ``BLOCK_BYTES`` of text) and
   dictionary-encodes their pre-tokens, so that a pre-token leaves its task once
   per block and not once per document. Frequencies are kept per document as
   packed vectors over the dictionary of the block.
2. Pre-tokens that are entries of the vocabulary (a table bounded by the
   tokenizer file) are one piece and never leave their task; these are also the
   frequent ones, so no hot key is shuffled.
3. The others are shuffled by pre-token. Each distinct one is encoded once, its
   number of pieces goes back to the blocks that hold it.
4. Blocks add up frequency times pieces.

Nulls count as empty texts (0 bytes, 0 tokens). Rows are never merged: repeated
rows and equal or null ids each give a row. Special strings inside a text are
one token each, as by the library's default.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, load

BLOCK_BYTES = 32 << 20
TOKEN_LIMIT = 512

# Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Beyond these code points the Unicode tables of the two libraries may differ.
UNSURE = re.compile("[԰-῿⁥-\U0010ffff]")

_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """Pre-tokens of texts and piece counts of pre-tokens, for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("token counts need a byte-level BPE tokenizer without a normalizer")
        self.tok = Tokenizer.from_file(path)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.find = regex.compile(PRETOKEN).findall
        plain = [s for s in (self.tok.decode([i]) for i in range(self.tok.get_vocab_size())) if s]
        self.single = frozenset(s for s, n in zip(plain, self.count(plain)) if n == 1 and not (self.special and self.special.search(s)))

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pretokens(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their numbers; the number of special strings, a token each."""
        if self.special is None or not self.special.search(text):
            return Counter(self.pretokens(text)), 0
        parts = self.special.split(text)
        total: Counter = Counter()
        for part in parts:
            total.update(self.pretokens(part))
        return total, len(parts) - 1


def _pack(parts: list[np.ndarray]) -> bytes:
    """Small integers by byte planes: the high bytes are nearly all zero and pack well."""
    return np.concatenate(parts).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _blocks(path: str):
    fields = pa.schema([("block", pa.int64()), ("vocab", pa.list_(pa.string())), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("ones", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("freqs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        single = pieces.single
        number = TaskContext.get().partitionId() << 32

        def out(vocab, docs, ids, freqs):
            cols = [[number], [list(vocab)], *([list(c)] for c in zip(*docs)), [_pack(ids)], [_pack(freqs)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)

        vocab, docs, ids, freqs, held = {}, [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                n_bytes = len(text.encode())
                counts, ones = pieces.frequencies(text)
                local, rest = [], []
                for token, n in counts.items():
                    if token in single:
                        ones += n
                    else:
                        local.append(vocab.setdefault(token, len(vocab)))
                        rest.append(n)
                at, n = np.array(local, np.int32), np.array(rest, np.int32)
                order = np.argsort(at)
                ids.append(np.diff(at[order], prepend=np.int32(0)))
                freqs.append(n[order])
                docs.append((doc_id, n_bytes, ones, len(local)))
                held += n_bytes
                if held >= BLOCK_BYTES:
                    yield out(vocab, docs, ids, freqs)
                    vocab, docs, ids, freqs, held, number = {}, [], [], [], 0, number + 1
        if docs:
            yield out(vocab, docs, ids, freqs)

    return run


def _encode_once(path: str):
    """(token, block, at) sorted by token -> (block, at, n); each distinct token is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, last, last_n = Pieces.of(path), None, 0
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            tokens = codes.dictionary.to_pylist()
            counts = pieces.count(tokens[1:] if tokens and tokens[0] == last else tokens)
            if tokens and tokens[0] == last:
                counts = [last_n, *counts]
            if tokens:
                last, last_n = tokens[-1], counts[-1]
            n = np.array(counts, np.int32)[codes.indices.to_numpy()] if tokens else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n, pa.int32())], names=["block", "at", "n"])

    return run


def _add_up(limit: int):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        out = ([], [], [])
        for block in blocks.to_pylist():
            pieces = np.zeros(block["size"] + 1, np.int64)
            pieces[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
            ids, freqs, start = _unpack(block["ids"]), _unpack(block["freqs"]), 0
            for doc_id, n_bytes, ones, size in zip(block["doc_id"], block["n_bytes"], block["ones"], block["sizes"]):
                at = np.cumsum(ids[start : start + size])
                total = int(pieces[at] @ freqs[start : start + size]) + ones
                start += size
                for column, value in zip(out, (doc_id, n_bytes, total)):
                    column.append(value)
        tokens = pa.array(out[2], pa.int64())
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_bytes": pa.array(out[1], pa.int64()), "n_tokens": tokens, "over_limit": pa.array([n > limit for n in out[2]], pa.bool_())})

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level BPE .json, present on every executor.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    blocks = scratch.write(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
            _blocks(tokenizer), "block long, vocab array<string>, doc_id array<long>, n_bytes array<long>, ones array<long>, sizes array<int>, ids binary, freqs binary"
        )
    )
    held = blocks.select("block", F.posexplode("vocab").alias("at", "token")).select("token", "block", "at")
    counts = held.repartition("token").sortWithinPartitions("token").mapInArrow(_encode_once(tokenizer), "block long, at int, n int")
    vectors = blocks.select("block", F.size("vocab").alias("size"), "doc_id", "n_bytes", "ones", "sizes", "ids", "freqs")
    return vectors.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_add_up(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
