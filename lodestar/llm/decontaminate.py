"""Operator 2: benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words; any ASCII character but a digit
or a letter separates words. A window is ``size`` consecutive words of an item,
or all its words if it has fewer. All windows go into one automaton over word
numbers; each document is scanned once, and the words that windows cover are
mapped back to offsets (code points) of the original text.

The windows are sent to the executors only up to ``SHARD_BYTES`` (measured
first). A larger benchmark is split by window and item into shards of that size, each
with its own automaton and its own pass over the documents; the passes' hits
are merged.

Null or wordless texts have no words and hit nothing. Items without id are
ignored; repeated items count once. Every row of the documents gives a row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, load

WINDOW = 10
SHARD_BYTES = 8 << 20

KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
NORMAL = bytes(c if c >= 128 or c in KEPT else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_built: dict = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    ids.append(item)
                    found.append(b" ".join(w[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], names=["item", "window"])

    return run


class Automaton:
    """Word numbers of the windows' words and an automaton over them."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.number: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows:
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.split(b" "))
            self.machine.add_word(key, (len(key), items))
        if windows:
            self.machine.make_automaton()
        self.empty = not windows

    def scan(self, w: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Runs of words that windows cover (start, end) and the items of those windows."""
        runs: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not w:
            return runs, items
        get = self.number.get
        for last, (size, of) in self.machine.iter(tuple([get(x, 0) for x in w])):
            start, end = last + 1 - size, last + 1
            items.update(of)
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append([start, end])
        return runs, items


HITS = "struct<n_words:bigint,runs:array<struct<a:int,b:int>>,items:array<string>>"
ARROW_HITS = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _scanner(shared):
    key = uuid.uuid4().hex

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(shared.value)
        automaton = _built[key]
        for column in texts:
            out = []
            for text in column.to_pylist():
                w = words(text)
                runs, items = automaton.scan(w)
                out.append({"n_words": len(w), "runs": [{"a": a, "b": b} for a, b in runs], "items": sorted(items)})
            yield pa.array(out, ARROW_HITS)

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, HITS)


def _merged(passes: pa.Array) -> pa.Array:
    out = []
    for hits in passes.to_pylist():
        runs: list[list[int]] = []
        for a, b in sorted((r["a"], r["b"]) for h in hits for r in h["runs"]):
            if runs and runs[-1][1] >= a:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out.append({"n_words": hits[0]["n_words"], "runs": [{"a": a, "b": b} for a, b in runs], "items": sorted({i for h in hits for i in h["items"]})})
    return pa.array(out, ARROW_HITS)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES, text_col: str = "text", into: str = "__hits") -> DataFrame:
    """``docs`` with the column ``into``: n_words, covered runs of words, items (sorted ids as strings)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    windows = scratch.write(
        benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(_windows(size), "item string, window binary").distinct()
    )
    total = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 16)).first()[0] or 0
    n = -(-total // shard_bytes) or 1

    def scanned(part: DataFrame):
        """The column of hits of one shard."""
        grouped = part.groupBy("window").agg(F.collect_set("item").alias("items")).collect()
        return _scanner(spark.sparkContext.broadcast([(bytes(r.window), r["items"]) for r in grouped]))(F.col(text_col).cast("string"))

    if n == 1:
        return docs.withColumn(into, scanned(windows))
    # A shard after another over the documents as they are; only hits are carried on. The items of a window are dealt
    # to the shards too, so that a window of very many items doesn't make one larger.
    rows = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = []
    for k in range(n):
        hits = rows.select("__row", scanned(windows.where(F.expr(f"pmod(xxhash64(window, item), {n}) = {k}"))).alias("__found"))
        found.append(scratch.write(hits if k == 0 else hits.where("size(__found.items) > 0")))
    merged = reduce(DataFrame.union, found).groupBy("__row").agg(F.collect_list("__found").alias("__passes"))
    return rows.join(merged.select("__row", F.arrow_udf(_merged, HITS)("__passes").alias(into)), "__row").select(*docs.columns, into)


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets (code points) of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def original_spans(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Offsets in the original texts of what ``scan`` found."""
    out = [
        [{"start": a, "end": b} for a, b in spans(text, [(r["a"], r["b"]) for r in found])] if found else []
        for text, found in zip(texts.to_pylist(), runs.to_pylist())
    ]
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (offsets in the text)."""
    found = scan(docs.select("doc_id", "text"), benchmark, size)
    hit = F.aggregate("__hits.runs", F.lit(0).cast("long"), lambda t, r: t + r["b"] - r["a"])
    return found.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__hits.items"), 256).alias("items_sha256"),
        (F.size("__hits.runs") > 0).alias("contaminated"),
        F.arrow_udf(original_spans, "array<struct<start:int,end:int>>")(F.col("text").cast("string"), "__hits.runs").alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM di, (SELECT DISTINCT k FROM bw) ks WHERE i + k - 1 <= len(w)),
h AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) x GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
