"""Postings: searchable words of the index, stored once and sorted by word (then path) within each file.

A posting is (path, word, document, tf, dl). A query reads only the words it may
match: equality or a prefix range, both of which reach the Parquet scan, where
the sorting lets row groups be skipped. Words, not grams, are stored; a prefix
is a range of words. Statistics per path are stored beside them, so a query
never scans the index to learn N or mean lengths. So are the lengths of each document: they are
what is taken off the statistics for documents that were replaced or deleted since.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import STOP_WORDS, english_words
from ..plans.config import Analyzer, TableConfig
from .query import HIT, Path, Plan, clauses_scored, measured, once, valued, with_allowed_text

SCHEMA = "path string, word string, document_id string, source_table string, record_id string, record_label string, tf int, dl int"
LENGTHS = "array<struct<path:string,dl:int>>"


def path_name(path: Path) -> str:
    return f"{path.name}|{path.analyzer.name}"


def paths_of(tables: list[TableConfig]) -> list[Path]:
    """Everything that a search of these tables may look into."""
    found = [Path("searchable_text")] if any(not t.filtered for t in tables) else []
    found += [Path("__allowed")] if any(t.filtered for t in tables) else []
    return list(dict.fromkeys([*found, *(Path(f.name, f.resolved_analyzer) for t in tables for f in t.indexed_fields)]))


def _words(path: Path, value: Column) -> Column:
    if path.analyzer is Analyzer.EXACT:
        return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))
    if path.analyzer is Analyzer.ENGLISH:
        return english_words(value)
    words = T.words(value)
    return F.filter(words, lambda w: F.length(w) >= T.MIN_GRAM) if path.analyzer is Analyzer.PREFIX else words


def _values(documents: DataFrame, tables: list[TableConfig], paths: list[Path]) -> DataFrame:
    """Per document its paths that have a value: HIT, ps (path, words)."""
    rows = valued(with_allowed_text(documents, tables), HIT, paths)
    lists = F.array(*[F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(path_name(p)).alias("path"), _words(p, F.col(f"v{i}")).alias("words"))) for i, p in enumerate(paths)])
    return once(rows, HIT, {"ps": F.filter(F.array_compact(lists), lambda p: F.size(p["words"]) > 0)})


def build_postings(documents: DataFrame, tables: list[TableConfig], paths: list[Path] | None = None) -> DataFrame:
    """The postings of ``paths`` (left out: of all). Each task's are sorted by path and word, so each of its files is read by word ranges; nothing is shuffled."""
    each = _values(documents, tables, paths_of(tables) if paths is None else paths).select(*HIT, F.explode("ps").alias("p"))
    # Counted within each document's sorted words.
    rows = each.select("p.path", F.size("p.words").alias("dl"), *HIT, F.explode(_counted(F.sort_array("p.words"))).alias("w"))
    found = rows.select("path", "w.word", *HIT, "w.tf", "dl")
    return found.sortWithinPartitions("path", "word", "document_id")


def postings_and_lengths(documents: DataFrame, tables: list[TableConfig], paths: list[Path] | None = None) -> DataFrame:
    """``build_postings`` (kind 0) and ``document_lengths`` (kind 1) from one cut into words, sorted by word and path within each task.

    Words come first in the order: Spark compares their first bytes without looking at the rows. Documents of a word stay in their order.
    """
    words = F.transform("ps", lambda p: F.struct(p["path"].alias("path"), F.size(p["words"]).alias("dl"), _counted(F.sort_array(p["words"])).alias("found"), F.lit(None).cast(LENGTHS).alias("lengths")))
    found = once(_values(documents, tables, paths_of(tables) if paths is None else paths), HIT, {"ps": words})
    lengths = F.transform("ps", lambda p: F.struct(p["path"].alias("path"), p["dl"].alias("dl")))
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("tf")))
    whole = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("dl"), nothing.alias("found"), lengths.alias("lengths"))
    each = found.select(*HIT, F.explode(F.concat("ps", F.array(whole))).alias("p"))
    rows = each.select("p.path", "p.dl", "p.lengths", *HIT, F.explode("p.found").alias("w"))
    return rows.select(F.col("path").isNull().cast("int").alias("kind"), "path", "w.word", *HIT, "w.tf", "dl", "lengths").sortWithinPartitions("word", "path")


def _counted(sorted_words: Column) -> Column:
    """Distinct words with their number, as array<struct<word, tf>>."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 1)
        begins = F.filter(at, lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(F.get(w, i).alias("word"), (F.coalesce(F.get(b, k + 1), F.size(w)) - i).alias("tf"))))[0]

    return F.transform(F.array(sorted_words), of)[0]


def _length(path: Path, value: Column) -> Column:
    """How many words ``_words`` gives; stems needn't be known."""
    if path.analyzer is Analyzer.ENGLISH:
        return F.size(F.filter(T.words(value), lambda w: ~w.isin(*sorted(STOP_WORDS))))
    return F.size(_words(path, value))


def document_lengths(documents: DataFrame, tables: list[TableConfig], paths: list[Path] | None = None) -> DataFrame:
    """Per document the lengths of its paths (left out: of all) that have words: document_id, source_table, lengths."""
    paths = paths_of(tables) if paths is None else paths
    rows, keep = valued(with_allowed_text(documents, tables), ("document_id", "source_table"), paths), ("document_id", "source_table")
    lists = F.array(*[F.when(F.col(f"v{i}").isNotNull(), F.struct(F.lit(path_name(p)).alias("path"), _length(p, F.col(f"v{i}")).alias("dl"))) for i, p in enumerate(paths)])
    return once(rows, keep, {"lengths": F.filter(F.array_compact(lists), lambda p: p["dl"] > 0)})


def lengths_summed(lengths: DataFrame) -> DataFrame:
    """Per path: documents that have it (n), and the sum of their lengths (total)."""
    return lengths.select(F.explode("lengths").alias("p")).groupBy("p.path").agg(F.count("*").alias("n"), F.sum(F.col("p.dl").cast("long")).alias("total"))


def path_statistics(documents: DataFrame, tables: list[TableConfig]) -> DataFrame:
    """The sums of all paths of documents."""
    return lengths_summed(document_lengths(documents, tables))


def without(stats: DataFrame, gone: DataFrame) -> DataFrame:
    """Sums per path less those of documents that no longer count."""
    return stats.join(gone.withColumnsRenamed({"n": "__n", "total": "__total"}), "path", "left").select("path", (F.col("n") - F.coalesce("__n", F.lit(0))).alias("n"), (F.col("total") - F.coalesce("__total", F.lit(0))).alias("total"))


def _range(path: Path, token: str) -> Column:
    at = F.col("path") == path_name(path)
    if path.analyzer is not Analyzer.PREFIX:
        return at & (F.col("word") == token)
    if not T.prefix_possible(token):
        return F.lit(False)
    return at & (F.col("word") >= token) & F.col("word").startswith(token)


def score_postings(postings: DataFrame, stats: DataFrame, query: Plan, tables: list[TableConfig] = (), changed: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """The hits of ``query.score``, from stored postings and statistics.

    ``changed`` are documents that aren't in the postings and are scanned; ``touched`` (document_id) names the documents
    whose postings no longer count, and ``stats`` are sums without them. Both are small beside the postings. Scores are those
    of a scan of the documents that count.
    """
    empty = "array<struct<clause:string,score:double>>"
    if not query.clauses:
        return postings.where(F.lit(False)).select(*HIT, F.lit(0.0).alias("score"), F.array().cast(empty).alias("contributions"))
    paths = query.paths
    tokens = {p: [query.term.lower()] if p.analyzer is Analyzer.EXACT else p.tokens(query.term) for p in paths}
    ranges = [_range(p, t) for p in paths for t in tokens[p]]
    read = postings.where(reduce(lambda a, b: a | b, ranges, F.lit(False)))
    tf = [F.coalesce(F.sum(F.when(_range(p, t), F.col("tf"))), F.lit(0)).cast("int").alias(f"tf{i}_{j}") for i, p in enumerate(paths) for j, t in enumerate(tokens[p])]
    dl = [F.coalesce(F.max(F.when(F.col("path") == path_name(p), F.col("dl"))), F.lit(0)).alias(f"dl{i}") for i, p in enumerate(paths)]
    found = read.groupBy(*HIT).agg(*tf, *dl)
    numbers = [[F.col(f"tf{i}_{j}") for j in range(len(tokens[p]))] for i, p in enumerate(paths)]
    shaped = found.select(*HIT, *[F.struct(F.array(*numbers[i]).cast("array<int>").alias("tf"), F.col(f"dl{i}").alias("dl")).alias(f"p{i}") for i in range(len(paths))])
    # Small numbers, a row for each path of the configuration.
    known = {r.path: r for r in stats.where(F.col("path").isin(*map(path_name, paths))).collect()}
    live = (shaped if touched is None else shaped.join(touched, "document_id", "left_anti").select(shaped.columns)).withColumn("__new", F.lit(False))
    if changed is not None:
        more = measured(valued(with_allowed_text(changed, list(tables)), HIT, paths), HIT, paths, query.term)
        live = live.unionByName(more.withColumn("__new", F.lit(True)))
    total = _statistics_of_all(live, paths, [len(tokens[p]) for p in paths], known)
    return clauses_scored(live.where(F.col("source_table").isin(*query.tables)).crossJoin(F.broadcast(total)), query, HIT)  # one row


def _statistics_of_all(live: DataFrame, paths: list[Path], n_tokens: list[int], known: dict) -> DataFrame:
    """One row as ``statistics`` gives it. Of the documents with postings ``live`` has only those with a token: their numbers and lengths are ``known``; of the new ones it has all."""
    aggregates, columns = [], []
    for i, path in enumerate(paths):
        n, length = (known[path_name(path)].n, known[path_name(path)].total) if path_name(path) in known else (0, 0)
        new = F.col("__new") & (F.col(f"p{i}.dl") > 0)
        aggregates += [F.count_if(new).alias(f"n{i}"), F.coalesce(F.sum(F.when(new, F.col(f"p{i}.dl"))), F.lit(0)).alias(f"sum{i}")]
        aggregates += [F.count_if(F.col(f"p{i}.tf")[j] > 0).alias(f"df{i}_{j}") for j in range(n_tokens[i])]
        of_all, mean = F.lit(n) + F.col(f"n{i}"), (F.lit(length) + F.col(f"sum{i}")) / F.greatest(F.lit(n) + F.col(f"n{i}"), F.lit(1))
        # A path that no document has is never scored.
        columns += [of_all.alias(f"n{i}"), F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias(f"avg{i}"), *(F.col(f"df{i}_{j}") for j in range(n_tokens[i]))]
    return live.agg(*aggregates).select(*columns)
