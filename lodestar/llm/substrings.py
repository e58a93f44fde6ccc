"""Operator 9: substring dedup by relative Lempel-Ziv parsing.

The reference is all text; what is before a document in it are the documents of
smaller id and its own earlier words. It is cut into blocks of ``BLOCK`` words
(and the ``WINDOW - 1`` words after them, so that each window lies within one), and
every document is parsed against every block that can give it a factor:

1. Anchors sort out what can't repeat: of each window of ``WINDOW`` words, the
   ``ANCHOR``-word run of smallest hash. Equal windows have equal anchors, so
   only windows whose anchor occurs twice can occur twice. Whole copies of a
   document are found by its fingerprint and are one factor each.
2. The index has the first place of each window with a repeated anchor that
   occurs twice, by a 96-bit hash of its words. A hot window is combined before the
   shuffle. A document meets the blocks in which its windows have their first
   places: a pair of document and block is sent once, however many windows they share.
3. Each document is factored greedily from left to right against the words of
   the blocks it meets: at a position where a window of a block begins that is before
   it, the longest run of equal words over all these places is the factor (of equally
   long ones the earliest place), and the parse goes on at its end. There the boundary
   is checked: windows across it, which begin in the factor's last ``WINDOW - 1`` words, are
   looked up as well, so a factor may overlap the one before.

Factors have ``WINDOW`` words at least; they are the duplicate spans, whose words are
removed. As each window that occurs earlier has its first place in a block that
was met, no such window is missed.

The order is (doc_id, position); null ids come last. Null and short texts have
no window and lose nothing. Rows with equal ids are separate documents, neither
of which is before the other at the same position; rows that repeat id and text
are parsed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .scratch import Scratch, load

WINDOW = 20
ANCHOR = 8
#: Words of a reference block, by where its windows begin.
BLOCK = 128
_LAST = (1 << 63) - 1
#: A second multiplier, for the check hash of a window.
_CHECK = 0xC2B2AE3D27D4EB4F


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of a document (its words' hashes given), and the hashes of all its ANCHOR-word runs."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    runs = hashing.windows(h, ANCHOR)
    return _sliding_min(runs, WINDOW - ANCHOR + 1), runs


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, prints, lists = [], [], []
        for text in batch.column("text").to_pylist():
            w = words(text)
            n.append(len(w))
            prints.append(hashlib.sha256(b" ".join(w)).hexdigest())
            of_window, runs = anchors(hashing.word_hashes(w))
            # An anchor that is found twice within the document is listed twice.
            one, times = np.unique(runs, return_counts=True)
            mine = np.unique(of_window)
            lists.append(np.concatenate([mine, np.intersect1d(mine, one[times > 1], assume_unique=True)]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("d"), batch.column("h"), pa.array(n, pa.int64()), pa.array(prints, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
            names=["doc_id", "d", "h", "n_words", "print", "anchors"],
        )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a document whose anchors are repeated."""
    for batch in batches:
        for d, h, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text", "repeated"))):
            of_words = hashing.word_hashes(words(text))
            at = np.flatnonzero(np.isin(anchors(of_words)[0], np.array(repeated, np.int64).view(np.uint64))).astype(np.int32)
            key = hashing.windows(of_words, WINDOW)[at].view(np.int64)
            check = hashing.windows(of_words, WINDOW, _CHECK)[at].astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), pa.array(np.full(len(at), d, np.int64)), pa.array(np.full(len(at), h, np.int64)), pa.array(at)], names=["key", "check", "d", "h", "at"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reference's documents in blocks of words."""
    for batch in batches:
        for d, h, text in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text"))):
            w = words(text)
            parts = [b" ".join(w[i : i + BLOCK + WINDOW - 1]) for i in range(0, len(w) - WINDOW + 1, BLOCK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=["source", "source_h", "block", "words"])


def factors(own: np.ndarray, d: int, blocks: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, source document, source start) of the document ``d``, given its words' hashes and the blocks it meets (source, start, words' hashes)."""
    blocks = sorted(blocks, key=lambda b: b[:2])
    keys = [hashing.windows(b[2], WINDOW) for b in blocks]
    if not any(len(k) for k in keys):
        return []
    of_block = np.repeat(np.arange(len(blocks)), [len(k) for k in keys])
    offset = np.concatenate([np.arange(len(k)) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")  # places of a window stay in their order
    flat, mine = flat[order], hashing.windows(own, WINDOW)
    low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
    known = np.flatnonzero(low < high)
    out, k = [], 0
    while k < len(known):
        at, best = int(known[k]), None
        for place in order[low[at] : high[at]]:
            source, start, theirs = blocks[of_block[place]]
            o = int(offset[place])
            if (source, start + o) >= (d, at):
                break
            a = own[at : at + len(theirs) - o]
            apart = np.flatnonzero(a != theirs[o : o + len(a)])
            n = int(apart[0]) if len(apart) else len(a)
            if n >= WINDOW and (best is None or n > best[1]):
                best = at, n, source, start + o
        if best is None:
            k += 1
            continue
        out.append(best)
        k = int(np.searchsorted(known, at + best[1] - WINDOW + 1))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for d, h, text, met in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text", "met"))):
            w = words(text)
            parse = factors(hashing.word_hashes(w), d, [(m["source"], m["block"] * BLOCK, hashing.word_hashes(m["words"].split())) for m in met])
            keep = np.ones(len(w), bool)
            for start, size, _, _ in parse:
                keep[start : start + size] = False
            kept = [x for x, k in zip(w, keep) if k]
            out.append((d, h, len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [dict(zip(("start", "words", "source", "source_start"), f)) for f in parse]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["d", "h", "removed", "kept_print", "factors"])


FACTORS = "array<struct<start:int,words:int,source:bigint,source_start:int>>"


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, factors (duplicate spans with their sources).

    A copy of a whole earlier document has one factor, from that document's start.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    summary = scratch.write(docs.mapInArrow(_summary, "doc_id long, d long, h long, n_words long, print string, anchors array<long>"))
    sizes = summary.select("doc_id", "d", "h", "n_words", "print")
    firsts = sizes.where(f"n_words >= {WINDOW}").groupBy("print").agg(F.min("d").alias("first_copy"))
    placed = sizes.join(firsts, "print", "left")
    copies = placed.where("d > first_copy").select("d", "h").distinct()

    # Copies need no windows of their own: each of theirs is in the first copy too.
    listed = summary.join(copies, ["d", "h"], "left_anti").select("d", "h", F.explode("anchors").alias("anchor"))
    # Written before it is joined back: Spark can then split a hot anchor's rows, and the count's shuffle files are gone.
    again = scratch.write(listed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    repeated = listed.join(again, "anchor").groupBy("d", "h").agg(F.collect_set("anchor").alias("repeated"))
    reference = scratch.write(docs.join(repeated, ["d", "h"]).select("d", "h", "text", "repeated").dropDuplicates(["d", "h"]))

    windows = reference.mapInArrow(_indexed, "key long, check int, d long, h long, at int")
    index = scratch.write(windows.groupBy("key", "check").agg(F.count("*").alias("n"), F.min(F.struct("d", "at", "h")).alias("first")).where("n > 1").drop("n"))
    earlier = windows.join(index, ["key", "check"]).where("first.d < d OR (first.d = d AND first.at < at)")
    pairs = scratch.write(earlier.select("d", "h", F.col("first.d").alias("source"), F.col("first.h").alias("source_h"), F.expr(f"first.at div {BLOCK}").cast("int").alias("block")).distinct())
    blocks = reference.select("d", "h", "text").mapInArrow(_blocks, "source long, source_h long, block int, words binary")
    met = pairs.join(blocks, ["source", "source_h", "block"]).groupBy("d", "h").agg(F.collect_list(F.struct("source", "block", "words")).alias("met"))
    parsed = scratch.write(reference.select("d", "h", "text").join(met, ["d", "h"]).mapInArrow(_parsed, f"d long, h long, removed long, kept_print string, factors {FACTORS}"))

    whole = F.col("d") > F.col("first_copy")
    one = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("words"), F.col("first_copy").alias("source"), F.lit(0).alias("source_start")))
    return placed.join(parsed, ["d", "h"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_print", "print")).alias("kept_sha256"),
        F.when(whole, one).otherwise(F.coalesce("factors", F.array().cast(FACTORS))).alias("factors"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(load(spark, sf_dir, "documents")).drop("factors")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
di AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM di),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM win),
c AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM f WHERE rn > 1) x),
ws AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT ws.doc_id, string_agg(ws.w[ws.j], ' ' ORDER BY ws.j) AS kept FROM ws LEFT JOIN c ON c.doc_id = ws.doc_id AND c.j = ws.j WHERE c.j IS NULL GROUP BY ws.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
