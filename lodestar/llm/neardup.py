"""Operator 3: near-duplicate groups by MinHash.

Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds
its distinct shingles of ``SHINGLE`` words (all its words as one shingle if it
has fewer). Documents are linked from a Jaccard similarity of ``SIMILARITY`` on.

1. Equal sets fall together first: one class per set, so thousands of copies
   cost one row from here on.
2. Each class gets ``BANDS * ROWS`` minima under universal hashes; a band of
   ``ROWS`` minima is a bucket key. A pair at the threshold shares no bucket
   with probability (1 - 0.75 ** 6) ** 64 = 4e-6.
3. In each bucket, members are compared with a pivot, the smallest member, never
   all with all. A pair goes on if its signatures agree in ``AGREE`` of the bytes (6
   standard deviations below the threshold), and is then confirmed on the full sets.
4. Links are closed to components by alternating large-star and small-star.
5. Members of buckets that still hold several components may be similar to
   others than the pivot. These pairs are found exactly, without signatures, by
   prefix, size and position filters over their shingles, rare ones first
   (``_closing_pairs``), and confirmed in the same way. No bucket is cut off. So of
   documents that share a bucket no link is lost but for step 3's, which step 5
   finds again where it matters.

Null ids: such rows take part; a component's id is its smallest non-null id.
Null and wordless texts have no shingles and are linked with nothing; their
component is their own id. Rows with equal ids are separate documents; a row is
known by its id and a 128-bit hash of its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .components import components
from .scratch import Scratch, load

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
BANDS, ROWS = 64, 6
#: Bytes of a signature: the low byte of so many minima.
SIGNATURE = 256
#: A pair whose signatures agree less is dropped unconfirmed: 6 standard deviations below the threshold.
AGREE = 0.58
#: Ratio of the sizes at the ends of a size class.
SIZE_STEP = 1.02

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A32 = (_A >> np.uint64(24)).astype(np.uint32) | np.uint32(1)
_B32 = _rng.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(hashing.BASE)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashing.word_hashes(words)
    return np.unique(hashing.windows(h, min(size, len(h))) + np.uint64(len(h) if len(h) < size else 0))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value under each universal hash ``a * x + b`` modulo 2**32."""
    x = hashing.mix(found).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 512):
        values = _A32[:, None] * x[None, start : start + 512]
        values += _B32[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    keys = hashing.mix(_BAND.copy())
    for row in least.reshape(BANDS, ROWS).T:
        keys = hashing.mix(keys * np.uint64(hashing.BASE) + row.astype(np.uint64))
    return keys.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: id, text hashes, size of its set, fingerprint of it, bucket keys, signature."""
    for batch in batches:
        sizes, prints, bands, signs = [], [], [], []
        for text in batch.column(3).to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            least = minima(found) if len(found) else None
            prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            bands.append(_bands(least) if len(found) else None)
            signs.append(least[:SIGNATURE].astype(np.uint8).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
            names=["doc_id", "h1", "h2", "n_shingles", "print", "bands", "sign"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, two hashes of the text, the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))


def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal signature bytes."""
    if not len(a):
        return pa.array([], pa.float64())
    left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, SIGNATURE) for x in (a, b))
    return pa.array((left == right).mean(axis=1), pa.float64())


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose full sets are similar enough; pairs of a pivot come together."""
    last, last_set = None, None
    for batch in batches:
        a, b, links = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for x, y, text_x, text_y in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if last != y:
                last, last_set = y, shingles(text_y)
            mine = shingles(text_x)
            both = len(np.intersect1d(mine, last_set, assume_unique=True))
            if SIMILARITY.denominator * both >= SIMILARITY.numerator * (len(mine) + len(last_set) - both):
                links.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    signs = classes.select("node", "sign")
    return pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b").where(F.arrow_udf(agreement, "double")("sign_a", "sign_b") >= AGREE).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among ``pairs`` (member a, pivot b), confirmed on full sets."""
    near = scratch.write(pairs)
    whole = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return scratch.write(whole.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"))


def _unsettled(live: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the members of buckets that hold more than one component."""
    placed = live.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return placed.join(keys, "key").select("node", "root").distinct()


def _size_class(n: str) -> str:
    return f"cast(floor(ln({n}) / {math.log(SIZE_STEP)!r}D) AS int)"


def _closing_pairs(apart: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, exactly, by prefix, size and position filters.

    With the shingles of all sets in one common order, rare ones first, two similar sets
    of n <= m shingles share at least ``o = 3/7 (n + m)`` of them, and the first one shared lies
    at positions p and q with ``min(n - p, m - q) >= o``. So the smaller set can be met
    only in its first seventh, the larger one in its first quarter, and a shingle at position p of a
    set of n can only meet sets of at most ``7/3 (n - p) - n`` shingles. The size is part
    of the join's key, in classes (``SIZE_STEP``): a smaller set's shingle stands once for each class of
    sizes that it can meet, ten to fifteen at most. Pages of one template with too much of
    their own to be similar begin with their own shingles and form no pair at all.
    The largest component of a shingle is never paired with itself.
    """
    num, den = SIMILARITY.numerator, SIMILARITY.denominator
    sets = texts.join(apart, "node").select("node", "root", "text").mapInArrow(_shingle_lists, "node long, root long, n int, shingles array<long>")
    rows = scratch.write(sets.select("node", "root", "n", F.explode("shingles").alias("s")))
    times = scratch.write(rows.groupBy("s").agg(F.count("*").alias("times")).where("times > 1"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("times").asc_nulls_first(), "s")) - 1
    first = rows.join(times, "s", "left").withColumn("p", place).where(f"p <= n - (({num} * n + {den - 1}) div {den}) and times is not null")
    # The most shingles of a set that can be met at this position.
    first = scratch.write(first.drop("times").withColumn("most", F.expr(f"({num + den} * (n - p)) div {num} - n")))
    of_root = first.groupBy("s", "root").agg(F.count("*").alias("k"))
    mixed = scratch.write(of_root.groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1").drop("roots"))
    here = scratch.write(first.join(mixed, "s").withColumn("minor", F.expr("root <> major")).drop("major"))
    smaller = here.where("most >= n").withColumn("size_class", F.expr(f"explode(sequence({_size_class('n')}, {_size_class('most')}))"))
    larger = here.withColumn("size_class", F.expr(_size_class("n"))).select("s", "size_class", *[F.col(c).alias(f"{c}_2") for c in ("node", "root", "n", "p", "most", "minor")])
    least = f"(({num} * (n + n_2) + {num + den - 1}) div {num + den})"
    in_order = "(n < n_2 or n = n_2 and node < node_2)"
    fits = f"{in_order} and n_2 <= most and n <= most_2 and root <> root_2 and least(n - p, n_2 - p_2) >= {least}"
    # At least one side of a pair isn't in the shingle's largest component.
    near = smaller.where("minor").join(larger, ["s", "size_class"]).where(fits).union(smaller.where("not minor").join(larger.where("minor_2"), ["s", "size_class"]).where(fits))
    return near.select(F.greatest("node", "node_2").alias("a"), F.least("node", "node_2").alias("b")).distinct()


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["node", "root", "n", "shingles"])


def _same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])


def _repeats(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Ids and text hashes that several rows have."""
    found = scratch.write(rows.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return None if found.isEmpty() else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (its id is the component's), and four columns for joins: h1 and h2, hashes of its text, print, the fingerprint of its set, and root, its component's class (null without words)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = _keyed(docs, id_col, text_col)
    sketches = scratch.write(docs.mapInArrow(_sketches, "doc_id long, h1 long, h2 long, n_shingles long, print binary, bands array<long>, sign binary"))
    sets = sketches.select("doc_id", "h1", "h2", "n_shingles", "print")

    # One class per set. The sketches of a class are equal, so any one of them will do.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    classes = scratch.write(
        sketches.where("print is not null")
        .groupBy("print")
        .agg(F.min(row).alias("row"), F.first("bands").alias("bands"), F.first("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    buckets = classes.select("node", F.explode("bands").alias("key"))
    # Written before it is joined back: Spark can then split a hot bucket's rows, and the count's shuffle files are gone.
    shared = scratch.write(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").drop("n"))
    live = scratch.write(buckets.join(shared, "key"))

    # The texts of classes that share a bucket, found by id and text hashes. Of rows that repeat both, one is enough.
    wanted = live.select("node").distinct().join(classes.select("node", "row.doc_id", "row.h1", "row.h2"), "node")
    found = lambda t: docs.join(t, _same_row(docs, t)).select("node", "text")
    repeats = _repeats(sets, scratch)
    if repeats is None:
        texts = scratch.write(found(wanted))
    else:
        once, more = (scratch.write(wanted.join(repeats, _same_row(wanted, repeats), how)) for how in ("left_anti", "left_semi"))
        texts = scratch.write(found(once).union(found(more).dropDuplicates(["node"])))
    pairs = live.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _verified(_agreeing(pairs, classes), texts, scratch)
    roots = components(links, scratch)
    apart = _unsettled(live, roots)
    if not apart.isEmpty():
        apart = scratch.write(apart)
        links = links.union(_verified(_closing_pairs(apart, texts, scratch), texts, scratch))
        roots = components(links, scratch)

    placed = classes.join(roots, "node", "left").select("print", F.col("row.doc_id").alias("least_id"), F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = placed.join(ids, "root").select("print", "component_id", "root")
    out = sets.join(known, "print", "left").withColumn("component_id", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h1", "h2", "print", "root")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that stay: one row of each component, and all rows without words."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = scratch.write(near_duplicates(docs).select("doc_id", "h1", "h2", "root"))
    best = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("b"))
    kept = scratch.write(best.select("b.doc_id", "b.h1", "b.h2").union(found.where("root is null").select("doc_id", "h1", "h2").distinct()))
    text = F.col("text").cast("string")
    marked = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__h1": F.xxhash64(text), "__h2": F.xxhash64(text, F.lit(1))})
    same = lambda t: marked["__id"].eqNullSafe(t["doc_id"]) & (marked["__h1"] == t["h1"]) & (marked["__h2"] == t["h2"])
    # Rows that repeat a kept id and text: only one of them stays. They are few, and only they are shuffled once more.
    repeats = _repeats(found.where("root is not null"), scratch)
    if repeats is None:
        return marked.join(kept, same(kept), "left_semi").select(*docs.columns)
    once, more = (scratch.write(kept.join(repeats, _same_row(kept, repeats), how)) for how in ("left_anti", "left_semi"))
    return marked.join(once, same(once), "left_semi").union(marked.join(more, same(more), "left_semi").dropDuplicates(["__id", "__h1", "__h2"])).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).drop("h1", "h2", "print", "root")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
di AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM di),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
