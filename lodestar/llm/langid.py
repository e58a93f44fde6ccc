"""Operator 4: language identification by nearest centroid.

Texts become vectors of hashed byte n-grams (1 to 3 bytes of the lower-cased
text, ASCII characters that aren't letters as one space) with TF-IDF weights and length 1. Each
language gets several centroids by spherical k-means; a text takes the language
of the centroid of largest cosine. It is rejected (``rejected``) if that cosine
is below the language's threshold for texts of its length: ``REJECT`` times the
``QUANTILE`` of the cosines of training texts in the same band of lengths, each compared
with centroids that leave it out. The quantile of a band is drawn toward that of shorter texts, the more the fewer training texts it has.

The model is fitted on a bounded sample: for each language the ``PER_LANGUAGE`` labelled
texts with the smallest hash of id and text (a repeated row counts once); of each the whole text is used. All languages
are learned; the model is 64 KB for each. Prediction reads every whole text.

Texts that are null or have no letter (a character of a Unicode category L) get ``und`` with score 0 and are
rejected; so does everything if there is nothing to learn from. Rows with null
language or text teach nothing. Only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, load

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1000
#: Languages whose centroids are compared at once.
SHARD = 1024
CENTROIDS = 4
#: A text is rejected below this share of this quantile of its language's training texts of like length.
REJECT = 0.5
QUANTILE = 0.02
#: Bands of lengths: the first has fewer than SHORT letters, each next one ends at twice as many, the last has no end.
BANDS = 6
SHORT = 20
#: The quantile of a band is drawn toward that of shorter texts by the weight of so many texts.
SHRINK = 20
UNKNOWN = "und"
#: Parts in which the sample of a language is ranked first.
_PARTS = 64

_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_CHUNK = 1 << 20


def grams(text: str) -> np.ndarray:
    """Numbers of the hashed n-grams of a text."""
    words = text.lower().encode().translate(_PLAIN).split()
    data = np.frombuffer(b" %b " % b" ".join(words), np.uint8)
    out = np.zeros(DIMENSIONS, np.int64)
    for start in range(0, len(data), _CHUNK):
        part = data[start : start + _CHUNK + max(ORDERS) - 1].astype(np.uint32)
        for order in ORDERS:
            n = min(len(part) - order + 1, _CHUNK)
            if n <= 0:
                continue
            code = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for j in range(order):
                code = (code ^ part[j : j + n]) * np.uint32(0x85EBCA6B)
                code ^= code >> np.uint32(15)
            out += np.bincount(code & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return out


def band(letters: int) -> int:
    """Number of the band of lengths."""
    return min((letters // SHORT).bit_length(), BANDS - 1)


def letters(text: str) -> int:
    """Letters of a text, counted no further than where the last band begins."""
    n, most = 0, SHORT << (BANDS - 2)
    for c in text:
        if c.isalpha():
            n += 1
            if n == most:
                break
    return n


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1."""
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    thresholds: np.ndarray  # of each centroid and band
    idf: np.ndarray


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grams(text) for text in batch.column(1).to_pylist()]
        at = [np.flatnonzero(v).astype("<i2") for v in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([band(letters(t)) for t in batch.column(1).to_pylist()], pa.int32()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([np.minimum(v[a], 1 << 30).astype("<i4").tobytes() for v, a in zip(found, at)], pa.binary())],
            names=["lang", "band", "at", "n"],
        )


def _dense(at: pd.Series, n: pd.Series) -> np.ndarray:
    out = np.zeros((len(at), DIMENSIONS), np.float32)
    for row, (a, v) in enumerate(zip(at, n)):
        out[row, np.frombuffer(a, "<i2")] = np.frombuffer(v, "<i4")
    return out


def _left_out(x: np.ndarray, centres: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Largest cosine of each text, its own cluster's centroid taken without it."""
    cosine = x @ centres.T
    sums = np.array([x[best == c].sum(axis=0) for c in range(len(centres))])
    own = sums[best] - x
    cosine[np.arange(len(x)), best] = (own * x).sum(axis=1) / np.maximum(np.linalg.norm(own, axis=1), 1e-9)
    return cosine.max(axis=1)


def _thresholds(cosine: np.ndarray, bands: np.ndarray) -> list[float]:
    """A threshold for each band: its quantile, drawn toward that of the next shorter band, and that of the shortest toward that of all."""
    out, near = [], float(np.quantile(cosine, QUANTILE))
    for b in range(BANDS):
        of = cosine[bands == b]
        if len(of):
            near = (len(of) * float(np.quantile(of, QUANTILE)) + SHRINK * near) / (len(of) + SHRINK)
        out.append(REJECT * near)
    return out


def _cluster(idf: np.ndarray, k: int):
    """Spherical k-means over the vectors of one language (at most PER_LANGUAGE rows)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "n"])  # whatever order the rows came in, the same centroids
        x = weighted(_dense(rows["at"], rows["n"]), idf)
        centres = x[[0]]
        while len(centres) < min(k, len(x)):
            centres = np.vstack([centres, x[[np.argmin((x @ centres.T).max(axis=1))]]])
        for _ in range(12):
            best = (x @ centres.T).argmax(axis=1)
            sums = np.array([x[best == c].sum(axis=0) if (best == c).any() else centres[c] for c in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        best = (x @ centres.T).argmax(axis=1)
        low = _thresholds(_left_out(x, centres, best), rows["band"].to_numpy())
        return pd.DataFrame({"lang": [key[0]] * len(centres), "centre": [c.astype("<f4").tobytes() for c in centres], "low": [low] * len(centres)})

    return run


def fit(labelled: DataFrame) -> Model | None:
    """A model from ``labelled`` (doc_id, text, lang); None if it has no usable row."""
    usable = labelled.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    scratch = Scratch(labelled.sparkSession, "langid")
    if usable.isEmpty():
        return None
    # The sample is chosen by hashes alone: within parts of a language first, so that no task sees all of a hot one.
    keyed = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("__key"))
    least = lambda rows, *by: rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("lang", *by).orderBy("__key"))).where(f"rank <= {PER_LANGUAGE}").drop("rank")
    parts = keyed.select("lang", "__key").withColumn("part", F.expr(f"pmod(__key, {_PARTS})"))
    chosen = scratch.write(least(scratch.write(least(parts, "part").distinct())).select("lang", "__key"))
    sample = keyed.join(chosen, ["lang", "__key"], "left_semi").dropDuplicates(["lang", "__key"])
    rows = scratch.write(sample.select("lang", "text").mapInArrow(_vectors, "lang string, band int, at binary, n binary"))
    present = rows.select(F.explode(F.arrow_udf(_indices, "array<int>")("at")).alias("i")).groupBy("i").count()
    frequency = np.zeros(DIMENSIONS)
    for row in present.collect():
        frequency[row.i] = row["count"]
    idf = (np.log((1 + rows.count()) / (1 + frequency)) + 0.1).astype(np.float32)
    found = rows.groupBy("lang").applyInPandas(_cluster(idf, CENTROIDS), "lang string, centre binary, low array<double>").orderBy("lang", "centre").collect()
    return Model([r.lang for r in found], np.array([np.frombuffer(r.centre, "<f4") for r in found]), np.array([r.low for r in found]), idf)


def _indices(at: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(a, "<i2").astype(np.int32) for a in at.to_pylist()], pa.list_(pa.int32()))


VERDICT = "struct<lang:string,score:double,rejected:boolean>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predictor(spark: SparkSession, model: Model | None):
    """A column function: text to (lang, score, rejected). The model has CENTROIDS * DIMENSIONS floats (64 KB) for each language, however many texts there are."""
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in columns:
            out = []
            texts = column.to_pylist()
            for start in range(0, len(texts), 256):
                sizes = [letters(t) if t is not None else 0 for t in texts[start : start + 256]]
                part = [t if n else None for t, n in zip(texts[start : start + 256], sizes)]
                if m is None:
                    out += [(UNKNOWN, 0.0, True)] * len(part)
                    continue
                x = weighted(np.array([grams(t) if t is not None else np.zeros(DIMENSIONS, np.int64) for t in part]), m.idf)
                best, top = np.zeros(len(part), np.int64), np.full(len(part), -np.inf)
                for first in range(0, len(m.centroids), SHARD * CENTROIDS):
                    cosine = x @ m.centroids[first : first + SHARD * CENTROIDS].T
                    here = cosine.argmax(axis=1)
                    better = cosine[np.arange(len(part)), here] > top
                    best[better], top[better] = here[better] + first, cosine[np.arange(len(part)), here][better]
                for t, b, c in zip(part, best, top):
                    if t is None:
                        out.append((UNKNOWN, 0.0, True))
                        continue
                    size = band(letters(t))
                    out.append((m.languages[b], float(min(max(c, 0.0), 1.0)), bool(size >= 0 and c < m.thresholds[b, size])))
            yield pa.array([dict(zip(("lang", "score", "rejected"), v)) for v in out], _ARROW)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, VERDICT)


def in_fold(id_col: str = "doc_id"):
    """Held out: CRC-32 of the id as text is 2 modulo 4. Null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, rejected; fitted on those rows that aren't held out (null ids neither teach nor are held out)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(docs.where(~in_fold()))
    found = docs.withColumn("__v", predictor(docs.sparkSession, model)("text"))
    return found.select("doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), F.col("__v.lang").alias("lang_pred"), F.col("__v.score").alias("score"), F.col("__v.rejected").alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
