"""Nearest neighbours: scores and order against brute force, recall, and rows that take no part."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import neighbours


def brute(rows, asks, k=5):
    """query position -> [(score, id)] of all candidates, best first."""
    out = {}
    for i, (qid, q) in enumerate(rows):
        if asks(qid):
            scored = [(float(np.dot(x, q) / math.sqrt(np.dot(x, x) * np.dot(q, q))), vid) for j, (vid, x) in enumerate(rows) if j != i and len(x) == len(q)]
            out[i] = sorted(scored, key=lambda s: (-round(s[0], 12), s[1]))
    return out


def uniform(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(i, x) for i, x in enumerate(rng.standard_normal((n, dim)))]


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    return [(i, centres[i % 20] + 0.05 * rng.standard_normal(dim)) for i in range(n)]


def recall(found, expected, rows):
    """Share of the true k best scores that were found; every score is checked too."""
    got = collections.defaultdict(list)
    for r in found:
        got[r.query_id].append(r)
    hit = total = 0
    for i, best in expected.items():
        mine = sorted(got[rows[i][0]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, min(5, len(best)) + 1))
        truth = collections.defaultdict(list)
        for s, v in best:
            truth[v].append(s)
        for r in mine:
            assert min(abs(s - r.score) for s in truth[r.vec_id]) < 1e-12
        for a, b in zip(mine, mine[1:]):
            assert a.score > b.score or a.score == b.score and a.vec_id <= b.vec_id
        wanted = collections.Counter(v for _, v in best[:5])
        hit += sum((wanted & collections.Counter(r.vec_id for r in mine)).values())
        total += sum(wanted.values())
    return hit / total


@pytest.mark.parametrize("make", [uniform, clustered])
@pytest.mark.parametrize("block", [300, 100_000])
def test_recall(spark, make, block):
    rows = make(2000, 24, 8)
    frame = spark.createDataFrame([(i, x.tolist(), 3.0) for i, x in rows], "vec_id long, embedding array<double>, score double").repartition(3)
    found = neighbours.nearest(frame, F.col("vec_id") % 10 == 0, block=block).collect()
    assert recall(found, brute(rows, lambda i: i % 10 == 0), rows) >= 0.95


def test_odd_rows(spark):
    rng = random.Random(2)
    v = lambda d=6: [rng.gauss(0, 1) for _ in range(d)]
    same = v()
    good = [(i, v()) for i in range(120)] + [(200 + i, same) for i in range(40)] + [(0, same), (50, v()), (50, v(3)), (51, v(3)), (300, [1e200 * x for x in same]), (350, [1e-200 * x for x in same]), (400, v(9))]
    odd = [(1000, None), (1050, []), (1100, [0.0] * 6), (1150, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1200, [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0]), (1250, [float("inf")] * 6), (None, v())]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = neighbours.nearest(frame(good + odd), F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in found} == {0, 50, 100, 200, 300, 350}  # 400 has no candidate of its length
    assert not {r.vec_id for r in found} & {1000, 1050, 1100, 1150, 1200, 1250, None, 400}
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r.rank):
        by[r.query_id].append((r.rank, r.vec_id))
    assert by[200] == [(1, 0), (2, 201), (3, 202), (4, 203), (5, 204)]  # ties to the smaller id
    assert len(by[50]) == 5 + 5 + 1 and len(by[0]) == 10  # each row is a query; one has a single candidate
    assert all(r.score > 1 - 1e-12 for r in found if r.query_id in (300, 350))
    assert neighbours.nearest(frame(good[:0] + odd[:1]), F.col("vec_id") % 50 == 0).count() == 0


def test_given_table(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = neighbours.query(spark, sf_dir).collect()
    assert recall(found, brute(rows, lambda i: i % 50 == 0), rows) >= 0.9
