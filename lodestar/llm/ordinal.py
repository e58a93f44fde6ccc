"""Operator 10: quality classifier by ordinal cumulative-link regression.

Ratings are graded 0, 1, 2: toxic; not toxic but of low quality; neither. The
model has one weight for each hashed text feature, shared by all grades, and
ordered thresholds: P(grade > k) = sigmoid(w . x - threshold_k). The result of
a text is its expected grade and its tail probability P(grade = 2), by which
``kept`` selects.

Features are the distinct lower-cased words of the whole text and shape
features (shares of capitals, symbols, repeated words, separators and repeated
lines, each in steps). The model is fitted on a bounded sample: the
``SAMPLE`` rated documents with the smallest hash of their id. Words in fewer
than ``LEAST_DOCS`` sample documents have no weight.

Null and wordless texts get the prior's grade (thresholds alone). Ratings with a
null id, quality or toxic value, or without a document, teach nothing; several
ratings of a document each count. With no rating at all every text gets the
middle grade, tail probability 0.5, and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, load

DIMENSIONS = 1 << 18
SAMPLE = 12_000
LEAST_DOCS = 5
GRADES = 3
STEPS = 300
RATE = 0.1
DECAY = 2e-3
#: Documents are kept from this tail probability on.
SELECT = 0.5

_EDGES = (0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
_SYMBOLS = frozenset("#*$%&|<>!~^_=+{}[]\\@")
_KEEP = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct numbers of a text's features."""
    text = text or ""
    words = text.lower().encode().translate(_KEEP).split()
    if not words:
        return np.zeros(0, np.int32)
    h = xxhash.xxh32_intdigest
    found = {h(w) % DIMENSIONS for w in set(words)}
    raw, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(raw)
    shares = {
        "capitals": sum(w.isupper() and len(w) > 1 for w in raw) / n,
        "symbols": sum(w[-1] in _SYMBOLS for w in raw) / n,
        "alone": sum(not any(c.isalnum() for c in w) for w in raw) / n,
        "again": sum(a == b for a, b in zip(raw, raw[1:])) / n,
        "pairs": 1 - len(set(zip(raw, raw[1:]))) / max(n - 1, 1),
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
    }
    for name, share in shares.items():
        for edge in _EDGES:
            if share >= edge:
                found.add(h(f"\0{name}>{edge}".encode()) % DIMENSIONS)
    return np.array(sorted(found), np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of each feature
    thresholds: np.ndarray  # ordered, GRADES - 1 of them


def tails(model: Model, found: np.ndarray) -> np.ndarray:
    """P(grade > k) for each k."""
    return 1 / (1 + np.exp(np.clip(model.thresholds - model.weights[found].sum(), -40, 40)))


def train(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood with decay, by Adam over the whole sample; thresholds are kept ordered by their gaps' logarithms."""
    if not rows:
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(GRADES - 1))
    at = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    frequent = np.bincount(at, minlength=DIMENSIONS) >= LEAST_DOCS
    at, doc = at[frequent[at]], doc[frequent[at]]
    used, at = np.unique(at, return_inverse=True)
    beyond = np.clip(np.array([(grades > k).mean() for k in range(GRADES - 1)]), 0.01, 0.99)
    start = np.log((1 - beyond) / beyond)
    p = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    n = len(rows)
    for step in range(1, STEPS + 1):
        w, low, gaps = p[: len(used)], p[len(used)], np.exp(p[len(used) + 1 :])
        cuts = low + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(doc, w[at], minlength=n)
        above = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40))), np.zeros((n, 1))])
        density = above * (1 - above)
        here, row = grades, np.arange(n)
        chance = np.maximum(above[row, here] - above[row, here + 1], 1e-9)
        by_score = -(density[row, here] - density[row, here + 1]) / chance
        by_cut = np.zeros((n, GRADES + 1))
        by_cut[row, here] += density[row, here] / chance
        by_cut[row, here + 1] -= density[row, here + 1] / chance
        cut_sums = by_cut[:, 1:GRADES].sum(axis=0)
        slope = np.concatenate([np.bincount(at, by_score[doc], minlength=len(used)) / n + DECAY * w, [cut_sums.sum() / n], [cut_sums[k + 1 :].sum() * gaps[k] / n for k in range(GRADES - 2)]])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = p[: len(used)]
    return Model(weights, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def _featured(texts: pa.Array) -> pa.Array:
    return pa.array([features(t).tobytes() for t in texts.to_pylist()], pa.binary())


def grade_of(toxic, quality):
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade from 0 to GRADES - 1)."""
    chosen = ratings.where("doc_id is not null and grade is not null").select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    scratch = Scratch(docs.sparkSession, "ordinal")
    chosen = scratch.write(chosen)  # at most `sample` rows of 12 bytes, so it may be broadcast
    rows = scratch.write(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", F.arrow_udf(_featured, "binary")(F.col("text").cast("string")).alias("x")))
    found = rows.orderBy("doc_id", "grade", "x").limit(sample).collect()
    return train([np.frombuffer(r.x, np.int32) for r in found], np.array([r.grade for r in found], np.int64))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, expected_grade, tail_probability, kept. The model has DIMENSIONS floats (1 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [tails(shared.value, features(t)) for t in column.to_pylist()]
            yield pa.array([{"e": float(v.sum()), "p": float(v[-1])} for v in out], pa.struct([("e", pa.float64()), ("p", pa.float64())]))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = docs.select("doc_id", F.arrow_udf(run, "struct<e:double,p:double>")(F.col("text").cast("string")).alias("__v"))
    return found.select("doc_id", F.col("__v.e").alias("expected_grade"), F.col("__v.p").alias("tail_probability"), (F.col("__v.p") >= SELECT).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = load(spark, sf_dir, "labels").where("toxic is not null and quality is not null").select("doc_id", grade_of(F.col("toxic"), F.col("quality")).alias("grade"))
    return predict(docs, fit(docs, ratings))
