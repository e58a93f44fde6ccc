"""Operator 11: approximate nearest neighbours by collision counting.

Vectors are brought to length one, so the nearest by cosine are the nearest by
distance. Each is hashed by ``PROJECTIONS`` single random projections. A query
counts, for every vector, the projections in which it lies within ``HALF * R``
of the query. A vector at distance R does so in each projection with probability
P(|N(0, 1)| <= HALF), so one that is nearer reaches ``threshold()`` collisions but
for one case in ``MISSED``; those that reach it are verified by their exact
cosine. R grows from round to round (virtual rehashing: the same sorted arrays, wider
windows around the query), and ends as soon as the k-th best verified vector is
no farther than R: nearer ones would have reached the threshold.

1. Rows are cut into blocks of about ``BLOCK`` vectors that are neighbours on a
   leading direction (by its quantiles; blocks that would be larger, as many equal
   vectors make them, are split by a hash). All rows are indexed, and there is no cap.
2. Each block sorts its projections once and answers its own queries. That bounds
   how far a query's k-th neighbour is.
3. Queries of like bounds form groups, which meet the blocks that their bounds reach on the
   leading direction (exactly those others that may hold something nearer), and expand no farther
   than their bounds. Pairs of a group and a block are formed from their ranges, one row each;
   vectors are sent to a few groups at a time (``WAVE``), so the disk needed stays
   a small multiple of the table.
4. The best k of all blocks are ranked, ties by smaller id.

Where the data have structure, bounds are small, and few blocks and short windows
remain. Where they have none (uniform directions in many dimensions) every
block is met and most windows are wide: no index of this recall can do less there.

Vectors that are null, empty, zero or hold a null or non-finite component take no
part, nor do rows without an id. Only vectors of equal length are compared. A
query's own row is no candidate, but a row that repeats its id and vector is. Rows
of equal ids are queries of their own; equal scores are ordered by id, then by row. A
query with fewer than k candidates gets all of them. Where a block holds fewer
than k other vectors, all are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .scratch import Scratch, load

PROJECTIONS = 128
#: Half a window, for a radius of one.
HALF = 1.0
#: Of so many vectors within the radius one stays below the threshold.
MISSED = 40
#: Vectors of a block, and quantiles of the leading direction.
BLOCK, CUTS = 16_384, 4096
#: Queries of a group, and the most neighbouring cuts they come from; groups to which a vector is sent at a time.
GROUP, GROUP_CUTS, WAVE = 20_000, 16, 4
FIRST_RADIUS, GROWTH = 0.1, 1.5
#: No two vectors of length one are farther apart.
FARTHEST = 2.0
_SEED = 20250611
#: Between the sorted arrays of two projections; no projection of a vector of length one is a quarter of it.
_APART = 64.0
_SALTS = 16


def threshold() -> int:
    """The most collisions that a vector at the radius misses in one of ``MISSED`` cases."""
    p, missed = math.erf(HALF / math.sqrt(2)), 0.0
    for count in range(PROJECTIONS + 1):
        missed += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if missed > 1 / MISSED:
            return count
    return PROJECTIONS


def directions(dim: int) -> np.ndarray:
    """The projections of vectors of a length."""
    return np.random.default_rng([_SEED, dim]).standard_normal((PROJECTIONS, dim))


def leading(dim: int) -> np.ndarray:
    """The direction, of length one, along which blocks are cut."""
    v = np.random.default_rng([_SEED, dim, 1]).standard_normal(dim)
    return v / np.linalg.norm(v)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors brought to length one, however large or small their components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with ``q``; a row's doesn't depend on where it stands."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        dot, squares = (x * q).sum(axis=1), (x * x).sum(axis=1) * (q * q).sum()
        out = dot / np.sqrt(squares)
    odd = ~(np.isfinite(out) & np.isfinite(squares) & (squares > 1e-280))
    if odd.any():
        out[odd] = (unit(x[odd]) * unit(q[None])[0]).sum(axis=1)
    return out


class Arrays:
    """A block's sorted projections, one after the other, and its vectors for verification."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.n, dim = self.vectors.shape
        self.directions = directions(dim)
        values = self.directions @ unit(self.vectors).T
        places = np.argsort(values, axis=1)
        self.places = places.ravel()
        self.offsets = _APART * np.arange(PROJECTIONS)
        self.sorted = (np.take_along_axis(values, places, axis=1) + self.offsets[:, None]).ravel()
        self.first = np.arange(PROJECTIONS) * self.n
        self.least = threshold()

    def search(self, vector: np.ndarray, row: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best of the verified vectors, but for the query's own row. Those farther than ``bound`` aren't sought."""
        q = self.directions @ unit(vector[None])[0] + self.offsets
        counts, seen = np.zeros(self.n, np.int64), self.rows == row
        left = right = np.searchsorted(self.sorted, q)
        places, scores, n_found = [], [], 0
        best, radius = bound, min(FIRST_RADIUS, bound) if bound == FARTHEST else bound / GROWTH
        while True:
            reach = HALF * radius
            a = np.maximum(np.searchsorted(self.sorted, q - reach), self.first)
            b = np.minimum(np.searchsorted(self.sorted, q + reach, "right"), self.first + self.n)
            met = [self.places[x:y] for x, y in zip([*a, *right], [*left, *b]) if x < y]
            left, right = a, b
            if met:
                counts += np.bincount(np.concatenate(met), minlength=self.n)
            new = np.flatnonzero((counts >= self.least) & ~seen)
            if radius >= FARTHEST and n_found + len(new) < k:
                new = np.flatnonzero(~seen)  # there are no k others
            if len(new):
                seen[new] = True
                n_found += len(new)
                places.append(new)
                scores.append(cosines(self.vectors[new], vector))
                if n_found >= k:
                    best = min(bound, distance(-np.partition(-np.concatenate(scores), k - 1)[k - 1]))
            if radius >= best:
                break
            # Windows wider than the k-th best needs are of no use.
            radius = best if best < bound else min(best, radius * GROWTH)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        at, score = np.concatenate(places), np.concatenate(scores)
        top = np.lexsort((at, -score))[:k]  # places are in the order of ids
        return at[top], score[top]


def distance(cosine: float) -> float:
    """Between vectors of length one; a little more, for rounding."""
    return min(FARTHEST, math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7)


def _vectors(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_FOUND = "query_row long, query_id long, row long, vec_id long, score double, bound double"


def _answers(arrays: Arrays | None, queries: Iterator[tuple[int, int, np.ndarray, float]], k: int) -> pa.Table:
    """The best of a block for each query, with the distance of the k-th."""
    out: dict[str, list] = {n: [] for n in ("query_row", "query_id", "row", "vec_id", "score", "bound")}
    for row, query_id, vector, bound in queries:
        at, score = arrays.search(vector, row, k, bound)
        out["query_row"] += [row] * len(at)
        out["query_id"] += [query_id] * len(at)
        out["row"] += arrays.rows[at].tolist()
        out["vec_id"] += arrays.ids[at].tolist()
        out["score"] += score.tolist()
        out["bound"] += [distance(score[-1]) if len(at) == k else FARTHEST] * len(at)
    return pa.table({n: pa.array(v, pa.float64() if n in ("score", "bound") else pa.int64()) for n, v in out.items()})


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _at_home(k: int):
    """A block's answers to its own queries."""

    def run(block: pa.Table) -> pa.Table:
        asks = np.flatnonzero(block.column("asks").to_numpy())
        if not len(asks):
            return _answers(None, iter(()), k)
        (rows, ids), x = _columns(block, "row", "vec_id"), _vectors(block.column("x"))
        return _answers(Arrays(rows, ids, x), ((int(rows[i]), int(ids[i]), x[i], FARTHEST) for i in asks), k)

    return run


def _abroad(k: int):
    """A block's answers to a group of queries of other blocks."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        if not block.num_rows or not queries.num_rows:
            return _answers(None, iter(()), k)
        arrays = Arrays(*_columns(block, "row", "vec_id"), _vectors(block.column("x")))
        here = block.column("block")[0].as_py()
        rows, ids, bounds = _columns(queries, "row", "vec_id", "bound")
        others = [i for i, home in enumerate(queries.column("home").to_pylist()) if home != here]
        x = _vectors(queries.column("x"))
        return _answers(arrays, ((int(rows[i]), int(ids[i]), x[i], float(bounds[i])) for i in others), k)

    return run


def _leading(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Place of each vector on the leading direction of its length."""
    for column in columns:
        sizes = np.diff(column.offsets.to_numpy())
        out = np.zeros(len(column))
        for dim in np.unique(sizes):
            mine = np.flatnonzero(sizes == dim)
            out[mine] = unit(_vectors(column.take(pa.array(mine)))) @ leading(int(dim))
        yield pa.array(out, pa.float64())


_leading.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}


def _placing(steps: list[float], n: int, block: int):
    """A column function: (u, row) to (cut, part). ``steps`` are the CUTS quantiles of ``u``; equal ones show where many vectors are."""
    steps = np.array(steps)
    edges = np.unique(steps[max(1, CUTS * block // n) - 1 :: max(1, CUTS * block // n)])
    held = np.bincount(np.searchsorted(edges, steps, "right"), minlength=len(edges) + 1) + 1
    parts = np.maximum(1, np.ceil(held * n / CUTS / (2 * block)).astype(np.int64))

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for u, row in columns:
            cut = np.searchsorted(edges, u.to_numpy(), "right")
            part = hashing.mix(row.to_numpy().astype(np.uint64)) % parts[cut].astype(np.uint64)
            yield pa.StructArray.from_arrays([pa.array(cut.astype(np.int32)), pa.array(part.astype(np.int32))], names=["cut", "part"])

    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<cut:int,part:int>")


def _valid(vector: str):
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _blocked(vectors: DataFrame, scratch: Scratch, block: int) -> tuple[DataFrame, int]:
    """``vectors`` with row, dim, u, cut, part and block; cuts whose queries may share a group."""
    placed = scratch.write(vectors.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("x"), "u": F.arrow_udf(_leading, "double")("x")}))
    # One row of a fixed number of quantiles.
    steps = F.percentile_approx("u", [i / CUTS for i in range(1, CUTS)], 4 * CUTS)
    n, n_asks, steps = placed.agg(F.count("*"), F.count_if("asks"), steps).first()
    place = _placing(steps or [], max(n, 1), block)("u", "row")
    rows = placed.withColumn("at", place).select(*placed.columns, "at.cut", "at.part")
    together = max(1, min(GROUP_CUTS, GROUP * max(n, 1) // (block * max(n_asks, 1))))
    return rows.withColumn("block", F.concat_ws("/", "dim", "cut", "part")), together


def _meetings(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(block, group, n): a row for each block that a group of queries may find something in but the home of all of them."""
    ranges = blocks.groupBy("dim", "block").agg(F.min("u").alias("low"), F.max("u").alias("high"), F.count("*").alias("n"))
    asked = queries.groupBy("dim", "group").agg(F.min(F.col("u") - F.col("bound")).alias("from"), F.max(F.col("u") + F.col("bound")).alias("to"), F.min("home").alias("a"), F.max("home").alias("b"))
    # All vectors may be of one length: its rows are dealt to several tasks.
    ranges = ranges.withColumn("salt", F.expr(f"pmod(xxhash64(block), {_SALTS})"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>")))
    near = ranges.join(asked, ["dim", "salt"]).where("low <= to and high >= from and not (a = b and a = block)")
    return near.select("block", "group", "n")


def nearest(vectors: DataFrame, asks, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """For each row of ``vectors`` for which the condition ``asks`` holds: query_id, rank (from 1), vec_id, score of its k nearest."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    taken = vectors.where(F.col(id_col).isNotNull() & _valid(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows, together = _blocked(taken, scratch, block)
    home = scratch.write(rows.select("block", "row", "vec_id", "x", "asks").groupBy("block").applyInArrow(_at_home(k), _FOUND))
    bounds = home.groupBy("query_row").agg(F.min("bound").alias("bound"))
    asked = rows.where("asks").withColumnRenamed("block", "home").join(bounds, F.col("row") == F.col("query_row"), "left").withColumn("bound", F.coalesce("bound", F.lit(FARTHEST)))
    # Queries of one group have bounds within a factor of two.
    group = F.concat_ws("/", "dim", F.floor(F.log2(F.greatest("bound", F.lit(1e-6)))), F.floor(F.col("cut") / together), "part")
    asked = scratch.write(asked.select("row", "vec_id", "x", "dim", "u", "home", "bound", group.alias("group")))
    pairs = scratch.write(_meetings(rows, asked))
    sent, there = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rows.count()
    waves = -(-sent // (WAVE * max(there, 1)))
    found = [home]
    for wave in range(waves):
        now = pairs.where(f"pmod(xxhash64(block, group), {waves}) = {wave}").select("block", "group")
        left = rows.select("block", "row", "vec_id", "x").join(now, "block").groupBy("block", "group")
        right = asked.select("group", "row", "vec_id", "x", "home", "bound").join(now, "group").groupBy("block", "group")
        found.append(scratch.write(left.cogroup(right).applyInArrow(_abroad(k), _FOUND)))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
