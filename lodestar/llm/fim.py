"""Operator 13: fill-in-middle transformation over an index of distinct texts.

1. Identical texts are grouped by their content (``distinct``: copies fall
   together in each task before anything is shuffled). Each distinct text gets
   the byte offsets of its code points once, as an Elias-Fano list: about two
   bits a code point, from which any boundary is selected without decoding.
2. The index row holds two hashes of the text and its length in place of the text.
   The index knows every text there is, so a key that stands there once belongs to
   one content and a join by key is exact. Keys of several contents, should
   there be any, are joined by the text itself.
3. Documents are joined with the lists (a hot text's documents are split over
   tasks by Spark's skew join), and each draws its cuts from the SHA-256 of
   ``seed:doc_id`` and selects the two boundaries.

Null texts count as empty; empty texts, texts that hold a sentinel and a tenth of
the others stay plain. A null id is drawn as the empty string. Every row gives a
row, repeated rows and equal ids too; other columns are left out. A text of any
length is one row; its list takes a quarter of its size at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, load

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred documents so many are transformed, and of those so many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20

_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
KEY = ("h1", "h2", "n_bytes")


class EliasFano:
    """A growing list of integers: low bits in full, high bits as a row of ones (an entry) and zeros (the next high value)."""

    HEAD = np.dtype([("n", "<u8"), ("low", "u1")])

    def __init__(self, data: bytes):
        head = np.frombuffer(data, self.HEAD, 1)[0]
        self.n, self.low = int(head["n"]), int(head["low"])
        at = self.HEAD.itemsize + -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8)[self.HEAD.itemsize : at]
        self.high = np.frombuffer(data, "<u8", offset=at)
        self.upto = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> low) + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        bits[ones] = 1
        lows = np.packbits((values[:, None] >> np.arange(low)) & 1, bitorder="little") if low else np.zeros(0, np.uint8)
        return np.array([(n, low)], cls.HEAD).tobytes() + lows.tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """Entry ``i``."""
        word = int(np.searchsorted(self.upto, i, "right"))
        rest = i - int(self.upto[word - 1]) if word else i
        inside = np.flatnonzero(np.unpackbits(self.high[word : word + 1].view(np.uint8), bitorder="little"))[rest]
        value = word * 64 + int(inside) - i
        for k in range(self.low):
            bit = i * self.low + self.low - 1 - k
            value = value << 1 | int(self.lows[bit >> 3]) >> (bit & 7) & 1
        return value


def boundaries(text: bytes) -> bytes:
    """Elias-Fano list of where the code points of a UTF-8 text begin, and its end."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return EliasFano.encode(np.append(starts, len(text)).astype(np.int64))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, list of boundaries)."""
    for batch in batches:
        found = [boundaries(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(found, pa.binary())], names=[*KEY, "bounds"])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the seeded hash."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12)]


def restore(output: bytes, form: str) -> bytes:
    """The text again, from a transformed one and its form."""
    if form == "plain":
        return output
    first, second = (_P, _S) if form == "psm" else (_S, _P)
    a, rest = output.removeprefix(first).split(second, 1)
    b, middle = rest.split(_M, 1)
    return a + middle + b if form == "psm" else b + middle + a


def _cut(seed: int):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, data in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("bounds").to_pylist()):
                h1, h2, h3, h4 = draws(seed, doc_id)
                bounds = EliasFano(data) if data else None
                n = bounds.n - 1 if data else 0
                if not n or h3 % 100 >= TRANSFORMED or any(mark in text for mark in (_P, _S, _M)):
                    out.append((doc_id, n, "plain", None, None, text, text))
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                i, j = bounds.select(a), bounds.select(b)
                prefix, middle, suffix = text[:i], text[i:j], text[j:]
                form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                whole = b"".join((_S, suffix, _P, prefix, _M, middle) if form == "spm" else (_P, prefix, _S, suffix, _M, middle))
                out.append((doc_id, n, form, a, b - a, whole, restore(whole, form)))
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _hashes(text):
    """The two hashes of a text's key."""
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def text_index(keyed: DataFrame) -> DataFrame:
    """A row for each distinct non-empty text of ``keyed`` (text and key): its key and its boundaries."""
    texts = keyed.where("n_bytes > 0").select(*KEY, "text").distinct()
    return texts.mapInArrow(_lists, "h1 long, h2 long, n_bytes long, bounds binary")


def _with_lists(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """``keyed`` with the boundaries of each row's text, null for empty ones."""
    index = scratch.write(text_index(keyed))
    clash = index.groupBy(*KEY).agg(F.count("*").alias("contents")).where("contents > 1").drop("contents")
    if clash.isEmpty():
        return keyed.join(index, [*KEY], "left")
    clash = scratch.write(clash)
    rest = keyed.join(clash, [*KEY], "left_semi")
    texts = rest.select("text").distinct()
    lists = texts.select("text", F.arrow_udf(lambda t: pa.array([boundaries(x) for x in t.cast(pa.binary()).to_pylist()], pa.binary()), "binary")("text").alias("bounds"))
    return keyed.join(clash, [*KEY], "left_anti").join(index, [*KEY], "left").unionByName(rest.join(lists, "text"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output, restored (the text rebuilt from output and form)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2 = _hashes(text)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"))
    found = _with_lists(keyed, Scratch(docs.sparkSession, "fim")).select("doc_id", "text", "bounds")
    return found.mapInArrow(_cut(seed), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
r AS (SELECT doc_id, t, n,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS a, greatest(a, b) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR c >= {TRANSFORMED} THEN 'plain' WHEN d < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
