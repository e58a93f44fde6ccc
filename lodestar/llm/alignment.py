"""Operator 12: alignment of the tokens of two tokenizers, relationally.

Where a byte-level pre-token ends after a visible character, and no piece holds the
two characters at that place side by side, no token of either tokenizer goes across,
and what follows is encoded as if it stood alone. So a text is a row of units (words
and their marks), whose tokens don't depend on their neighbours; every end of a unit
is a cut, and the alignment of a text is that of its units put end to end.

1. Each task cuts its documents into blocks and dictionary-encodes their words and
   the words' units, so a unit leaves its task once per block (as operator 1 does
   with pre-tokens).
2. Each distinct unit is encoded once by both tokenizers. Its tokens are exploded
   with their positions, running sums of their lengths give their ends, and equi-joins
   on unit and end find where both end. Between neighbouring ends lies
   one stretch of bytes that belongs to one token of each side, and no two
   stretches belong to the same two: a stretch is a link. So the links are the
   rows of the joined ends, each with the next token of either side that ends
   there or later, and are never made by pairing the tokens of a group. The
   running number of cuts is the group.
3. Units go back to their blocks, which put the documents' groups together and count,
   for each pair of ids, their documents that hold it linked.
4. Counts are summed over blocks, joined to the units' links, summed by unit and
   go back to the blocks.

Texts that are null, empty or not given back by the joined bytes of one of the
tokenizers (the character U+2581 is a space to pieces) have no tokens: zeros, and
they count for no pair. Every row gives a row; rows with equal or null ids are
documents of their own. A unit is as long as its text where that has no place to cut;
its tokens are rows that Spark sorts and spills. A task holds one block at a time,
which is a row (and a row group) of the tables. The table of the highest count of
each A id is broadcast: it has at most a row for each entry of the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import SPACE, model_path
from .scratch import Scratch, load
from .tokencount import PRETOKEN, UNSURE, _pack, _unpack

BLOCK_BYTES = 16 << 20
#: Units whose links are written out as text at once.
_AT_ONCE = 10_000

#: A space behind another blank character; looked for one by one, which is much faster than a class of them.
_BLANK_BEFORE_SPACE = [chr(c) + " " for c in range(0x3001) if chr(c).isspace() and c != 32]
_BEGINNING = re.compile(r"(?<=\S)(?= .)", re.DOTALL)

#: A character that no piece joins to another. Before a unit it keeps the library's prefix away from it; these two are two pieces.
_APART = "\n"
#: Tables that are partitioned by unit needn't be shuffled once more for a join on unit and end.
_BY_UNIT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

#: Whole texts go to Python so many at once.
_FEW_TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

_loaded: dict[tuple[str, str], "Tokenizers"] = {}


def words(text: str) -> list[str]:
    """Space + ``text``, cut before each space that follows a visible character and isn't the last character; each without its first space."""
    parts = text.split(" ")
    if "" not in parts and not any(pair in text for pair in _BLANK_BEFORE_SPACE):
        return parts
    return [u[1:] for u in _BEGINNING.split(" " + text)]


def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 letters stand for themselves, the others are moved beyond U+00FF."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Units of words, ids of units by both tokenizers, and the bytes of ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=False))]
        self.a_bytes = [bytes(letters[c] for c in t) for t in entries]
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = sp.id_to_piece
        if sp.normalize("a  b") != f"{SPACE}a{SPACE}{SPACE}b" or any(SPACE in piece(i).lstrip(SPACE) for i in range(len(sp))):
            raise ValueError("alignment needs pieces that hold spaces at their beginning only, identity normalisation and a dummy prefix")
        if self.a.normalizer or self.a.encode("a", add_special_tokens=False).tokens != ["a"]:
            raise ValueError("alignment needs a byte-level tokenizer without normalisation or prefix")
        self.b_bytes = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(piece(i)[3:5], 16)]) if sp.is_byte(i) else piece(i).replace(SPACE, " ").encode() for i in range(len(sp))]
        #: Neighbours within some piece.
        self.joined = {p[k : k + 2] for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for p in [piece(i).replace(SPACE, " ")] for k in range(len(p) - 1)}
        if len(sp.encode(_APART)) != 2 or any(_APART in pair for pair in self.joined):
            raise ValueError("alignment needs pieces that hold no line ends")
        self.find = regex.compile(PRETOKEN).finditer

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Tokenizers":
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = cls(a_path, b_path)
        return _loaded[a_path, b_path]

    def units(self, word: str) -> list[str]:
        """The units of space + ``word``."""
        text = " " + word
        unsure = UNSURE.search(word)
        if word.isalpha() and not unsure:
            return [text]
        ends = [b for _, (_, b) in self.a.pre_tokenizer.pre_tokenize_str(text)] if unsure else [m.end() for m in self.find(text)]
        out, start = [], 0
        for end in ends[:-1]:
            if not text[end - 1].isspace() and text[end - 1 : end + 1] not in self.joined:
                out.append(text[start:end])
                start = end
        return [*out, text[start:]]

    def encode(self, found: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of A and B of each unit, and whether both give its bytes; if not, it has none."""
        a = [e.ids for e in self.a.encode_batch_fast(found, add_special_tokens=False)]
        b = [x[2:] for x in self.b.encode([_APART + u for u in found], num_threads=1)]
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        same = [u.encode() == b"".join(map(a_bytes, x)) == b"".join(map(b_bytes, y)) for u, x, y in zip(found, a, b)]
        return [x if ok else [] for x, ok in zip(a, same)], [x if ok else [] for x, ok in zip(b, same)], same


_BLOCKS = "block long, vocab array<string>, doc_id array<long>, sizes array<int>, ids binary, n_units binary, units binary"
_BLOCK = pa.schema([("block", pa.int64()), ("vocab", pa.list_(pa.string())), ("doc_id", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("n_units", pa.binary()), ("units", pa.binary())])


def _blocks(a_path: str, b_path: str):
    """Documents as blocks: sizes are the documents' numbers of words and ids their numbers, units the numbers of the words' units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Tokenizers.of(a_path, b_path).units
        number = TaskContext.get().partitionId() << 32
        known, vocab, n_units, inside, docs, sizes, ids, held = {}, {}, [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            for word in known:
                mine = cut(word)
                n_units.append(len(mine))
                inside.extend(vocab.setdefault(u, len(vocab)) for u in mine)
            cols = [number], [list(vocab)], [docs], [sizes], [_pack(ids)], [_pack([np.array(n_units, np.int32)])], [_pack([np.array(inside, np.int32)])]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))):
                mine = words(text) if text else []
                docs.append(doc_id)
                sizes.append(len(mine))
                ids.append(np.array([known.setdefault(w, len(known)) for w in mine], np.int32))
                held += len(text or "")
                if held >= BLOCK_BYTES:
                    yield out()
                    known, vocab, n_units, inside, docs, sizes, ids, held, number = {}, {}, [], [], [], [], [], 0, number + 1
        if docs:
            yield out()

    return run


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def _encoded(a_path: str, b_path: str):
    """Distinct units -> ids and lengths in bytes of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; each thread of the library's keeps memory of its own
        both = Tokenizers.of(a_path, b_path)
        a_size, b_size = (list(map(len, x)) for x in (both.a_bytes, both.b_bytes))
        for batch in batches:
            a, b, same = both.encode(batch.column(0).to_pylist())
            sizes = [_lists([[size[i] for i in x] for x in ids]) for ids, size in ((a, a_size), (b, b_size))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(a), _lists(b), *sizes, pa.array(same, pa.bool_())], names=["unit", "a", "b", "a_size", "b_size", "same"])

    return run


def _ends(tokens: DataFrame, side: str) -> DataFrame:
    """(u, end, id) of each token of a side."""
    rows = tokens.select("u", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("pos", "t"))
    end = F.sum("t.size").over(Window.partitionBy("u").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("u", end.alias("end"), F.col("t.id").alias(side))


def links(tokens: DataFrame) -> DataFrame:
    """The links of each unit (u, with ids a and b and sizes a_size and b_size of its tokens): u, end (of the link's bytes), from_end (number of its group, the last one is 1), own_a and own_b (the id if the token ends here), a, b."""
    tokens = tokens.repartition("u")
    a, b = _ends(tokens, "a"), _ends(tokens, "b")
    others = b.join(a, ["u", "end"], "left_anti").select("u", "end", F.lit(None).cast("int").alias("a"), "b")
    joined = a.join(b, ["u", "end"], "left").select("u", "end", "a", "b").union(others)
    back = Window.partitionBy("u").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.select("u", "end", F.sum(cut.cast("int")).over(back).alias("from_end"), F.col("a").alias("own_a"), F.col("b").alias("own_b"), F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b"))


#: A link as a number: the pair of ids, and two bits that say whether A's and B's token end with it.
_PAIR_BITS = 2


def aligned_units(tokens: DataFrame) -> DataFrame:
    """Per unit with tokens: u, n_groups, links (their numbers, in order)."""
    pair = F.shiftleft(F.col("a").cast("long"), 30) + F.col("b")
    bits = F.col("own_a").isNotNull().cast("int") * 2 + F.col("own_b").isNotNull().cast("int")
    rows = links(tokens).select("u", "from_end", F.struct("end", (F.shiftleft(pair, _PAIR_BITS) + bits).alias("link")).alias("l"))
    return rows.groupBy("u").agg(F.max("from_end").alias("n_groups"), F.sort_array(F.collect_list("l")).getField("link").alias("links"))


def group_texts(found: list[int]) -> list[str]:
    """The groups of links that follow each other, each as text: a1,a2|b1."""
    out, a, b = [], [], []
    for link in found:
        if link & 2:
            a.append(str(link >> 32))
        if link & 1:
            b.append(str(link >> 2 & 0x3FFFFFFF))
            if link & 2:
                out.append(f"{','.join(a)}|{','.join(b)}")
                a, b = [], []
    return out


class Lists:
    """Lists of numbers, one after the other."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def of(self, at: np.ndarray) -> np.ndarray:
        """The lists numbered ``at``, put end to end."""
        n = self.lengths[at]
        return self.values[np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)]

    def sums(self, by_value: np.ndarray) -> np.ndarray:
        """For each list the sum of what its numbers stand for."""
        total = np.zeros(len(self.values) + 1, np.int64)
        np.take(by_value, self.values, out=total[1:], mode="clip")  # in place; numbers are those of ``by_value``
        np.cumsum(total, out=total)
        return total[self.ends] - total[self.starts]

    def joined(self, texts: list[str]) -> list[str]:
        """For each list the texts that its numbers stand for, put end to end; of few lists at once the numbers are Python's."""
        out = []
        for i in range(0, len(self.ends), _AT_ONCE):
            ends = self.ends[i : i + _AT_ONCE]
            first = self.starts[i]
            mine = self.values[first : ends[-1]].tolist()
            out += [texts[mine[a]] if b - a == 1 else ";".join(map(texts.__getitem__, mine[a:b])) for a, b in zip((self.starts[i : i + _AT_ONCE] - first).tolist(), (ends - first).tolist())]
        return out


def unit_texts(links: pa.ListArray, n_groups: np.ndarray) -> list[str]:
    """The groups of each unit as text; the groups' own texts are held for few units at once."""
    out = []
    for i in range(0, len(links), _AT_ONCE):
        every, at = group_texts(links.slice(i, _AT_ONCE).flatten().to_pylist()), 0
        for n in n_groups[i : i + _AT_ONCE].tolist():
            out.append(every[at] if n == 1 else ";".join(every[at : at + n]))
            at += n
    return out


def _placed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[at] = values
    return out


def _read(block: dict) -> tuple[Lists, Lists]:
    """The words of its documents and the units of its words."""
    return Lists(_unpack(block["ids"]), np.array(block["sizes"], np.int64)), Lists(_unpack(block["units"]), _unpack(block["n_units"]))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_DOCUMENTS = "block long, same array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, groups array<string>, pairs array<long>, n_docs array<int>"


def _documents(keep_groups: bool):
    """A block and its units -> its documents' groups and counts, and how many of them hold each pair."""

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        of_doc, of_word = _read(block)
        block = block["block"]
        found = found.take(pa.array(np.argsort(found.column("at").to_numpy())))  # every unit of the block is here once
        column = found.column("links").combine_chunks()
        values = column.flatten().to_numpy()
        pairs, which = np.unique(values >> _PAIR_BITS, return_inverse=True)
        of_unit, which = Lists(which.astype(np.int32), np.diff(column.offsets.to_numpy())), None
        numbers = Lists(np.arange(len(values), dtype=np.int32), of_unit.lengths)
        bad = of_doc.sums(of_word.sums((~found.column("same").to_numpy()).astype(np.int64))) > 0
        per_unit = {"n_a": numbers.sums(values >> 1 & 1), "n_b": numbers.sums(values & 1), "n_links": of_unit.lengths, "n_groups": found.column("n_groups").to_numpy().astype(np.int64)}
        counts = {c: np.where(bad, 0, of_doc.sums(of_word.sums(per_unit[c]))) for c in _COUNTS}
        texts = of_word.joined(unit_texts(column, per_unit["n_groups"]))
        n_docs = np.zeros(len(pairs), np.int32)
        shas, groups = [], []
        for start, end, no in zip(of_doc.starts, of_doc.ends, bad):
            if no or start == end:
                shas.append("")
                groups.append("")
                continue
            mine = of_doc.values[start:end]
            whole = ";".join(map(texts.__getitem__, mine.tolist()))
            shas.append(hashlib.sha256(whole.encode()).hexdigest())
            groups.append(whole if keep_groups else None)
            n_docs[np.unique(of_unit.of(of_word.of(np.unique(mine))))] += 1
        held = n_docs > 0
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table({
            "block": pa.array([block], pa.int64()), "same": one((~bad).tolist(), pa.bool_()), **{c: one(v, pa.int64()) for c, v in counts.items()},
            "sha": one(shas, pa.string()), "groups": one(groups, pa.string()), "pairs": one(pairs[held], pa.int64()), "n_docs": one(n_docs[held], pa.int32()),
        })

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _totals(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """A block with its documents' counts, and the sums of its units -> rows."""
    block, at = blocks.to_pylist()[0], found.column("at").to_numpy()
    of_doc, of_word = _read(block)
    out = {"doc_id": block["doc_id"], **{c: block[c] for c in _COUNTS}}
    for name in ("n_best", "count_sum"):
        by_unit = _placed(at, found.column(name).to_numpy(), block["size"])
        out[name] = np.where(np.array(block["same"], bool), of_doc.sums(of_word.sums(by_unit)), 0)
    whole = {"groups_sha256": block["sha"], "groups": block["groups"]}
    return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()} | {n: pa.array(v, pa.string()) for n, v in whole.items()})


def pair_counts(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair with the same A id has more)."""
    rows = documents.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n"))
    counts = scratch.write(rows.groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 30)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups (null unless ``keep_groups``).

    ``a_path`` is the path of a byte-level BPE .json, ``b_path`` that of a piece .model; both are on every executor.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = scratch.write(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_blocks(a_path, b_path), _BLOCKS), conf=_FEW_TEXTS, long_rows=True)
    held = blocks.select("block", F.posexplode("vocab").alias("at", "unit"))
    encoded = held.select("unit").distinct().mapInArrow(_encoded(a_path, b_path), "unit string, a array<int>, b array<int>, a_size array<int>, b_size array<int>, same boolean")
    tokens = scratch.write(encoded.withColumn("u", F.monotonically_increasing_id()))
    places = scratch.write(held.join(tokens.select("unit", "u", "same"), "unit").select("block", "at", "u", "same"))
    found = scratch.write(aligned_units(tokens.select("u", "a", "b", "a_size", "b_size")), conf=_BY_UNIT)
    scratch.drop(tokens)
    # Units that one of the tokenizers doesn't give back have no tokens and so no row of their own.
    of_block = places.join(found, "u", "left").select("block", "at", "same", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("links", F.array().cast("array<long>")).alias("links"))
    slim = blocks.select("block", F.size("vocab").alias("size"), "doc_id", "sizes", "ids", "n_units", "units")
    documents = scratch.write(slim.drop("size", "doc_id").groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(_documents(keep_groups), _DOCUMENTS), long_rows=True)
    counts = scratch.write(pair_counts(documents, scratch))
    pairs = found.select("u", F.explode("links").alias("link")).select("u", F.shiftright("link", _PAIR_BITS).alias("pair"))
    by_unit = pairs.join(counts, "pair").groupBy("u").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    sums = places.join(by_unit, "u").select("block", "at", "count_sum", "n_best")
    rows = slim.join(documents.drop("pairs", "n_docs"), "block")
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_totals, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), model_path()).drop("groups")
