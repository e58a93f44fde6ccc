"""Operator 6: SentencePiece encoding and decoding by a streaming Viterbi search.

The model file is a BPE model, so the best path is the one that its merges give.
That path has the Viterbi property: the last piece of the encoding of a prefix
is the one piece that ends there and is compatible with the last piece before
it (two pieces are compatible if the merges of their joined text leave them as
they are). The search therefore keeps, for each position, one backpointer. Only
the positions within the longest piece's length can still be continued; as soon
as all their paths go back to one boundary, the ids before it are committed and
forgotten. Memory is bounded by the window, however long the text.

Where no piece of the vocabulary holds the two characters at a boundary, no
path can cross it and all paths converge there by themselves. Boundaries before
spaces are of that kind in usual models; the words between them are encoded once
and remembered (a bounded number of them).

Decoding joins the pieces' bytes, so that characters in byte pieces come back;
it gives the text again (the character U+2581 becomes a space, as in the
library). Null and empty texts have no ids. Every row gives a row.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import load

SPACE = "▁"
#: Words, and pairs of pieces, that a worker remembers: up to twice as many, as the older half is dropped at once.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 250_000, 125_000

_NEVER = float("-inf")
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_loaded: dict[str, "Model"] = {}


class Model:
    """The vocabulary of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("a ﬁ  b") != f"{SPACE}a{SPACE}ﬁ{SPACE}{SPACE}b":
            raise ValueError("the search needs a model with identity normalisation and a dummy prefix")
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {text[i]: i for i in plain}
        self.score = {text[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the search needs a model with byte fallback")
        self.longest = max(map(len, self.ids))
        #: What an id decodes to.
        self.out = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.spaces_close = not any(b == SPACE != a for piece in self.ids for a, b in zip(piece, piece[1:]))
        #: Pieces by their characters from the last to the first; a whole piece is under "".
        self.backwards: dict = {}
        for piece in self.ids:
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        #: Neighbours within some piece. Between others no path can cross.
        self.joined = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.words, self.old_words = {}, {}
        self.pairs, self.old_pairs = {}, {}

    @classmethod
    def of(cls, path: str) -> "Model":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def merged(self, text: str) -> list[str]:
        """A short text merged pair by pair, best score first, then from the left."""
        parts, score = list(text), self.score.get
        gains = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > _NEVER:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], _NEVER)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges of two pieces' joined text leave them as they are; the empty piece before the text's beginning asks that of ``b`` alone."""
        pair = (a, b)
        known = self.pairs.get(pair)
        if known is None:
            known = self.old_pairs.get(pair)
            if known is None:
                known = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs, self.old_pairs = {}, self.pairs
            self.pairs[pair] = known
        return known

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]

    def _extend(self, text: str, last: list[str], before: str) -> None:
        """Goes on with ``last`` to the end of ``text``: to each position the one piece that can end there, longest first; empty if no path does."""
        backwards, known, compatible = self.backwards, self.pairs, self.compatible
        for end in range(len(last) + 1, len(text) + 1):
            node, k, found = backwards, end, []
            while k:
                k -= 1
                node = node.get(text[k])
                if node is None:
                    break
                if "" in node:
                    found.append(node[""])
            if not found or len(found[0]) > 1:
                found.insert(0, text[end - 1])
            while found:
                piece = found.pop()
                at = end - len(piece)
                previous = last[at - 1] if at else before
                if previous or not at:
                    fits = known.get((previous, piece))
                    if compatible(previous, piece) if fits is None else fits:
                        last.append(piece)
                        break
            else:
                last.append("")

    def stream(self, chunks: Iterator[str]) -> Iterator[str]:
        """Pieces of a text that comes in chunks, each as soon as it is certain."""
        text = ""  # what follows the last committed boundary
        last: list[str] = []  # last[k]: the last piece of the best path to position k + 1 of it
        before = ""  # the last committed piece
        for chunk in chunks:
            for start in range(0, len(chunk), self.longest):
                text += chunk[start : start + self.longest]
                self._extend(text, last, before)
                if len(text) > self.longest and (done := self._converged(last)):
                    path = self._path(last, done)
                    yield from path
                    text, last, before = text[done:], last[done:], path[-1]
        yield from self._path(last, len(last))

    def _converged(self, last: list[str]) -> int:
        """The furthest boundary on the paths to all positions that can still be continued."""
        alive = {k + 1 for k in range(len(last) - self.longest, len(last)) if last[k]}
        while len(alive) > 1:
            k = max(alive)
            alive.remove(k)
            alive.add(k - len(last[k - 1]))
        return alive.pop()

    @staticmethod
    def _path(last: list[str], end: int) -> list[str]:
        out = []
        while end:
            out.append(last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a word, from its stretches between boundaries that no piece crosses."""
        cuts = [0, *(k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.joined), len(word)]
        if len(cuts) == 2:
            if len(word) > self.longest:
                path = self.stream(iter([word]))
            else:  # all of it is within the window
                self._extend(word, last := [], "")
                path = self._path(last, len(word))
            return array("i", [i for piece in path for i in self.piece_ids(piece)]).tobytes()
        return b"".join(map(self._remembered, map(word.__getitem__, map(slice, cuts, cuts[1:]))))

    def _remembered(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.old_words.get(word) or self._word(word)
            if len(word) <= 64:
                if len(self.words) >= REMEMBERED_WORDS:
                    self.words, self.old_words = {}, self.words
                self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        return b"".join(map(self._remembered, _WORDS.findall(text) if self.spaces_close else [text]))

    def decode(self, ids: bytes) -> str:
        found = array("i")
        found.frombytes(ids)
        text = b"".join(map(self.out.__getitem__, found)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_column(path: str):
    """A column function: text to array<int> of ids."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model.of(path)
        for column in columns:
            packed = [model.encode(t or "") for t in column.to_pylist()]
            ends = [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))]))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")


def decode_column(path: str):
    """A column function: array<int> of ids to text."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model.of(path)
        for column in columns:
            yield pa.array([model.decode(array("i", ids or []).tobytes()) for ids in column.to_pylist()], pa.string())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_ids, ids, ids_sha256 (of the ids, 4 bytes each, little-endian), round_trip (they decode to the text)."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model.of(path)
        for column in columns:
            packed, digests, same, ends = [], [], [], [0]
            for text in column.to_pylist():
                ids = model.encode(text or "")
                packed.append(ids)
                ends.append(ends[-1] + len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                same.append(model.decode(ids) == (text or "").replace(SPACE, " "))
            data = pa.py_buffer(b"".join(packed))
            del packed
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, data]))
            yield pa.StructArray.from_arrays([ids, pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["ids", "sha", "same"])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = docs.select("doc_id", F.arrow_udf(run, "struct<ids:array<int>,sha:string,same:boolean>")(F.col("text").cast("string")).alias("__e"))
    return found.select("doc_id", F.size("__e.ids").cast("long").alias("n_ids"), F.col("__e.ids").alias("ids"), F.col("__e.sha").alias("ids_sha256"), F.col("__e.same").alias("round_trip"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(load(spark, sf_dir, "documents"), model_path()).drop("ids")
