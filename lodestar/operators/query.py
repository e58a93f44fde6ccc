"""Matching and ranking: a term against the documents of many tables, in one plan.

A document matches if all tokens of the term occur in its searchable text, or
in one of its table's own fields outside that text, or, for tables with
protected fields, across the fields that may be seen. Its score is the BM25
score of the alternatives that match, plus weight times BM25 for each configured
field that holds all tokens. Statistics are per field over the whole index.

Choices where nothing is prescribed: boosts carry no table filter, so that a
field name shared by two tables gets the boosts of both; scores are rounded to
six digits and ties are ordered by table and record id. Scoring is one narrow
scan: per document only token counts and lengths are kept, and the statistics
join as a single row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import STOP_WORDS, english, stem_start, stems
from ..plans.config import Analyzer, EngineConfig, FieldConfig, TableConfig
from .documents import MAPS, allowed_snippet

K1, B = 1.2, 0.75
SCALE = 6
_WORD = regex.compile(T.WORD_REGEX, regex.V1)
_BLANKS = regex.compile(r"[ \t\n\x0b\f\r]+")
_EDGE = regex.compile(r"^[\x00-\x20]+|[\x00-\x20]+$")

HIT = ("document_id", "source_table", "record_id", "record_label")


def normalize_term(term: str | None) -> str:
    return _BLANKS.sub(" ", _EDGE.sub("", term or ""))


def tokenize(term: str) -> list[str]:
    """The query side of the word and prefix analyzers; repeated tokens count once."""
    return list(dict.fromkeys(_WORD.findall(term.lower())))


@dataclass(frozen=True)
class Path:
    """A searchable place of a document: its text, or a field by an analyzer."""

    name: str
    analyzer: Analyzer = Analyzer.PREFIX

    def tokens(self, term: str) -> list[str]:
        found = tokenize(term)
        return list(dict.fromkeys(english(found))) if self.analyzer is Analyzer.ENGLISH else found

    def value(self) -> Column:
        if self.name in ("searchable_text", "__allowed"):
            return F.col(self.name)
        return F.col(MAPS[self.analyzer])[self.name]

    def counted(self, value: Column, term: str) -> Column:
        """Counts of each token (tf) and length (dl) of a value of the path. By the ENGLISH analyzer the words that may have a
        token as their stem stand in place of the counts (``near``): only those go to Python."""
        if self.analyzer is Analyzer.EXACT:
            hit = F.coalesce((value == T.normalize(F.lit(term.lower()))).cast("int"), F.lit(0))
            return F.struct(F.array(hit).alias("tf"), value.isNotNull().cast("int").alias("dl"))
        tokens = self.tokens(term)

        def of(w: Column) -> Column:
            if self.analyzer is Analyzer.ENGLISH:
                near = F.filter(w, lambda x: reduce(lambda a, b: a | b, [x.startswith(stem_start(t)) for t in tokens], F.lit(False)))
                return F.struct(near.alias("near"), F.size(F.filter(w, lambda x: ~x.isin(*sorted(STOP_WORDS)))).alias("dl"))
            prefix = self.analyzer is Analyzer.PREFIX
            count = T.prefix_count if prefix else T.equal_count
            long = F.filter(w, lambda x: F.length(x) >= T.MIN_GRAM) if prefix else w
            return F.struct(F.array(*[count(w, t) for t in tokens]).alias("tf"), F.size(long).alias("dl"))

        # The words are bound once, whatever the number of tokens.
        return F.transform(F.array(T.words(value)), of)[0]

    def finished(self, counts: Column, term: str) -> Column:
        """``counted`` with the counts of stems."""
        if self.analyzer is not Analyzer.ENGLISH:
            return counts
        tokens, empty = self.tokens(term), F.array().cast("array<int>")
        tf = F.transform(F.array(stems(counts["near"])), lambda w: F.array(*[T.equal_count(w, t) for t in tokens]))[0] if tokens else empty
        return F.struct(tf.alias("tf"), counts["dl"].alias("dl"))


def once(rows: DataFrame, keep, found: dict[str, Column]) -> DataFrame:
    """``keep`` and further columns, each computed once for a row: Spark copies what a projection computes into the filters and
    aggregates above it, but nothing through ``inline``."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))


def measured(values: DataFrame, keep, paths: list[Path], term: str) -> DataFrame:
    """``keep`` and per path the counts p0, p1, ... of rows with the values v0, v1, ... of paths (``valued``)."""
    rows = once(values, keep, {f"p{i}": p.counted(F.col(f"v{i}"), term) for i, p in enumerate(paths)})
    if not any(p.analyzer is Analyzer.ENGLISH for p in paths):
        return rows
    return once(rows, keep, {f"p{i}": p.finished(F.col(f"p{i}"), term) for i, p in enumerate(paths)})


def valued(documents: DataFrame, keep, paths: list[Path]) -> DataFrame:
    return once(documents, keep, {f"v{i}": p.value() for i, p in enumerate(paths)})


@dataclass
class Clause:
    """One part of a query: which documents it is for, what it adds to the score."""

    name: str
    path: Path
    weight: float = 1.0
    tables: tuple[str, ...] | None = None  # None: any
    required: bool = True  # one of the required clauses must hold


@dataclass
class Plan:
    term: str
    tables: tuple[str, ...]
    clauses: list[Clause] = field(default_factory=list)

    @property
    def paths(self) -> list[Path]:
        return list(dict.fromkeys(c.path for c in self.clauses))


def plan(term: str, tables: list[TableConfig]) -> Plan:
    """The clauses of a term over tables; without a clause nothing matches."""
    term = normalize_term(term)
    tables = [t for t in tables if t.searchable]
    out = Plan(term, tuple(t.name for t in tables))
    if not tokenize(term):
        return out
    open_tables = tuple(t.name for t in tables if not t.filtered)
    if open_tables:
        out.clauses.append(Clause("text", Path("searchable_text"), tables=open_tables))
    if closed := tuple(t.name for t in tables if t.filtered):
        out.clauses.append(Clause("text", Path("__allowed"), tables=closed))
    for table in tables:
        for f in table.indexed_fields:
            if not f.snippet:
                out.clauses.append(Clause(f"field:{f.name}", _path(f), tables=(table.name,)))
    for table in tables:
        for f in table.indexed_fields:
            out.clauses.append(Clause(f"boost:{f.name}", _path(f), float(f.weight), required=False))
    return out


def _path(f: FieldConfig) -> Path:
    return Path(f.name, f.resolved_analyzer)


def with_allowed_text(documents: DataFrame, tables: list[TableConfig]) -> DataFrame:
    """Adds the text of filtered tables rebuilt from the fields that may be seen; null for other tables."""
    closed = [t for t in tables if t.filtered]
    text = reduce(lambda c, t: c.when(F.col("source_table") == t.name, allowed_snippet(t)), closed, F.when(F.lit(False), F.lit(None).cast("string")))
    return documents.withColumn("__allowed", text)


def statistics(measured: DataFrame, paths: list[Path], term: str) -> DataFrame:
    """One row: for each path the number of documents that have it, their mean length, and document frequencies."""
    aggregates = []
    for i, path in enumerate(paths):
        has = F.col(f"p{i}.dl") > 0
        aggregates += [F.count_if(has).alias(f"n{i}"), F.avg(F.when(has, F.col(f"p{i}.dl"))).alias(f"avg{i}")]
        n_tokens = 1 if path.analyzer is Analyzer.EXACT else len(path.tokens(term))
        aggregates += [F.count_if(F.col(f"p{i}.tf")[j] > 0).alias(f"df{i}_{j}") for j in range(n_tokens)]
    return measured.agg(*aggregates)


def bm25(tf: Column, dl: Column, df: Column, n: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _path_score(i: int, path: Path, term: str) -> tuple[Column, Column]:
    """Whether a path holds all tokens, and its score."""
    p = f"p{i}"
    if path.analyzer is Analyzer.EXACT:
        df, n = F.col(f"df{i}_0"), F.col(f"n{i}")
        return F.col(f"{p}.tf")[0] > 0, F.log(1 + (n - df + 0.5) / (df + 0.5))
    tokens = path.tokens(term)
    if not tokens:
        return F.lit(False), F.lit(0.0)
    holds = reduce(lambda a, b: a & b, [F.col(f"{p}.tf")[j] > 0 for j in range(len(tokens))])
    parts = [bm25(F.col(f"{p}.tf")[j], F.col(f"{p}.dl"), F.col(f"df{i}_{j}"), F.col(f"n{i}"), F.col(f"avg{i}")) for j in range(len(tokens))]
    return holds, reduce(lambda a, b: a + b, parts)


def _may_match(query: Plan) -> Column:
    """A cheap condition that all matches fulfil: a required path's text holds every token as a part."""

    def of(path: Path) -> Column:
        value = F.col(f"v{query.paths.index(path)}")
        if path.analyzer in (Analyzer.ENGLISH, Analyzer.EXACT):
            return value.isNotNull()
        text = F.lower(value)
        return reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in path.tokens(query.term)])

    return reduce(lambda a, b: a | b, [F.coalesce(of(p), F.lit(False)) for p in dict.fromkeys(c.path for c in query.clauses if c.required)])


def score(documents: DataFrame, query: Plan, tables: list[TableConfig], keep: tuple[str, ...] = ()) -> DataFrame:
    """Matching documents: document_id, source_table, record_id, record_label, score, contributions (clause, score), and ``keep``.

    ``documents`` is the whole index: statistics don't depend on the tables searched.
    """
    empty = "array<struct<clause:string,score:double>>"
    columns = [*HIT, *keep]
    if not query.clauses:
        return documents.where(F.lit(False)).select(*columns, F.lit(0.0).alias("score"), F.array().cast(empty).alias("contributions"))
    paths = query.paths
    whole = with_allowed_text(documents, tables)
    # Only documents that can match are cut into words again.
    maybe = valued(whole.where(F.col("source_table").isin(*query.tables)), columns, paths).where(_may_match(query))
    total = statistics(measured(valued(whole, (), paths), (), paths, query.term), paths, query.term)
    scored = measured(maybe, columns, paths, query.term).crossJoin(F.broadcast(total))  # one row
    return clauses_scored(scored, query, tuple(columns))


def clauses_scored(scored: DataFrame, query: Plan, columns: tuple[str, ...]) -> DataFrame:
    """Matches among rows with the counts of each path and the statistics: ``columns``, score, contributions."""
    at = {p: _path_score(i, p, query.term) for i, p in enumerate(query.paths)}
    required, parts = [], []
    for clause in query.clauses:
        holds, value = at[clause.path]
        if clause.tables is not None:
            holds = holds & F.col("source_table").isin(*clause.tables)
        if clause.required:
            required.append(holds)
        parts.append(F.when(holds, F.struct(F.lit(clause.name).alias("clause"), (value * clause.weight).alias("score"))))
    matches = reduce(lambda a, b: a | b, required)
    found = scored.where(matches).withColumn("contributions", F.array_compact(F.array(*parts)))
    total = F.aggregate("contributions", F.lit(0.0), lambda t, c: t + c["score"])
    return found.select(*columns, F.round(total, SCALE).alias("score"), "contributions")


def order() -> list[Column]:
    return [F.col("score").desc(), F.col("source_table"), F.col("record_id")]


def matched_clauses(hits: DataFrame) -> DataFrame:
    return hits.select("document_id", F.transform("contributions", lambda c: c["clause"]).alias("clauses"))


def explain_contributions(hits: DataFrame) -> DataFrame:
    """A row for each clause that a hit satisfied, with what it adds to the score."""
    return hits.select("document_id", F.explode("contributions").alias("c")).select("document_id", "c.clause", F.round("c.score", SCALE).alias("score"))
