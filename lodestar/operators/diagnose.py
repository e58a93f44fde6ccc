"""Diagnostics: counts, samples, differences, match gates, status and health."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.config import TableConfig
from .query import explain_contributions, matched_clauses, order, plan, score, tokenize

LEVELS = ("OK", "WARN", "FAIL")


def level_of(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), severity + 1)


def count_check(counts: DataFrame) -> DataFrame:
    """Counts (table_name, source_count, index_count): equal is OK, off by up to 5 or 1 % a warning, else a failure."""
    off = F.abs(F.col("source_count") - F.col("index_count"))
    bearable = F.greatest(F.lit(5), F.floor(F.col("source_count") / 100))
    return counts.select("table_name", "source_count", "index_count", F.when(off == 0, "OK").when(off <= bearable, "WARN").otherwise("FAIL").alias("level"))


def overall(findings: DataFrame) -> DataFrame:
    """PASS, or the worst level found."""
    worst = F.max(F.when(F.col("level") == "FAIL", 2).when(F.col("level") == "WARN", 1).otherwise(0))
    return findings.agg(F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS").alias("overall"), F.count("*").alias("n"))


def _entries(documents: DataFrame) -> DataFrame:
    """A row per part of a document: its label, its text, each field."""
    parts = F.map_concat(F.create_map(F.lit("(label)"), F.col("record_label"), F.lit("(text)"), F.col("searchable_text")), F.col("field_values"))
    return documents.select("document_id", F.explode(parts).alias("part", "value"))


def document_diff(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Parts in which documents of the database and of the index differ: changed, missing or extra."""
    new, old = _entries(expected).withColumnRenamed("value", "__new"), _entries(indexed).withColumnRenamed("value", "__old")
    found = new.join(old, ["document_id", "part"], "full").where(~F.col("__new").eqNullSafe(F.col("__old")))
    what = F.when(F.col("__old").isNull(), "missing").when(F.col("__new").isNull(), "extra").otherwise("changed")
    return found.select("document_id", "part", what.alias("difference"))


def verdicts(chosen: DataFrame, expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per chosen document: CURRENT, STALE, MISSING, NOT_INDEXED or NO_RECORD."""
    differing = document_diff(expected, indexed).select("document_id").distinct().withColumn("differs", F.lit(True))
    there = expected.select("document_id", F.lit(True).alias("record"))
    known = indexed.select("document_id", F.lit(True).alias("known"))
    found = chosen.select("document_id").distinct().join(there, "document_id", "left").join(known, "document_id", "left").join(differing, "document_id", "left")
    verdict = (
        F.when(F.col("record").isNull() & F.col("known").isNull(), "NOT_INDEXED")
        .when(F.col("record").isNull(), "NO_RECORD")
        .when(F.col("known").isNull(), "MISSING")
        .when(F.col("differs"), "STALE")
        .otherwise("CURRENT")
    )
    return found.select("document_id", verdict.alias("verdict"))


def sample_check(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """Findings over sampled records: each whose document is missing or differs is a failure."""
    bad = verdicts(expected.select("document_id"), expected, indexed)
    return bad.select("document_id", F.when(F.col("verdict") == "CURRENT", "OK").otherwise("FAIL").alias("level"), F.col("verdict"))


def orphan_check(sampled: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Findings over sampled documents: one without a record is a failure."""
    there = source_ids.select("source_table", "record_id").distinct().withColumn("__there", F.lit(True))
    found = sampled.join(there, ["source_table", "record_id"], "left")
    return found.select("document_id", F.when(F.col("__there"), "OK").otherwise("FAIL").alias("level"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, as one aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, *[F.col(f"__row.{c}") for c in rest])


def split_names(text: str | None) -> list[str]:
    """Names separated by commas or blanks, each once."""
    return list(dict.fromkeys(n for n in (text or "").replace(",", " ").split() if n))


def playground(documents: DataFrame, tables: list[TableConfig], term: str, readable: DataFrame | None = None, most: int = 20) -> dict[str, DataFrame]:
    """Everything about one term: its hits with their clauses, contributions, counts per table, and why other documents don't match."""
    hits = score(documents, plan(term, tables), tables)
    shown = hits if readable is None else hits.join(readable.select("source_table", "record_id"), ["source_table", "record_id"], "left_semi").select(hits.columns)
    top = shown.orderBy(*order()).limit(most)
    return {
        "hits": top,
        "clauses": matched_clauses(top),
        "contributions": explain_contributions(top),
        "counts": shown.groupBy("source_table").agg(F.count("*").alias("n")),
        "gates": match_gates(documents.where(F.col("source_table").isin(*[t.name for t in tables])), term),
    }


def match_gates(documents: DataFrame, term: str) -> DataFrame:
    """Per document the first reason why a term doesn't match its text; null if it matches."""
    tokens = tokenize(term)
    gate = F.when(F.lit(len(term) < 2), "term too short").when(F.lit(len(term) > 100), "term too long").when(F.lit(not tokens), "no word in the term")
    for t in tokens:
        found = T.token_check(T.words("searchable_text"), t)
        gate = gate.when(found != "found", F.concat(F.lit(f"{t}: "), found))
    return documents.select("document_id", gate.alias("reason"))


def rank_of(hits: DataFrame, document_id: str) -> DataFrame:
    """The place of a document among its table's hits, counted without sorting them all."""
    mine = F.broadcast(hits.where(F.col("document_id") == document_id).select(F.col("source_table").alias("__t"), F.col("score").alias("__s"), F.col("record_id").alias("__r")))
    ahead = (F.col("score") > F.col("__s")) | ((F.col("score") == F.col("__s")) & (F.col("record_id") < F.col("__r")))
    found = hits.join(mine, F.col("source_table") == F.col("__t"))
    return found.groupBy("source_table").agg((F.count_if(ahead) + 1).alias("rank"), F.count("*").alias("of"))


def readable_hits(hits: DataFrame, readable: DataFrame) -> DataFrame:
    """Raw hits that may be seen, each with the number hidden; if any is hidden, no score is shown."""
    marked = hits.join(readable.select("source_table", "record_id").withColumn("__ok", F.lit(True)), ["source_table", "record_id"], "left")
    hidden = marked.agg(F.count_if(F.col("__ok").isNull()).alias("hidden"))
    out = marked.where("__ok").crossJoin(F.broadcast(hidden))  # one row
    return out.select("document_id", F.when(F.col("hidden") == 0, F.col("score")).alias("score"), "hidden")


def backlog(events: DataFrame, cap: int = 1000) -> DataFrame:
    """Failed events waiting and given up, counted up to ``cap`` rows in the order of ids."""
    seen = events.where("status in ('PENDING', 'EXHAUSTED')").orderBy("event_id").limit(cap + 1)
    counts = seen.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "EXHAUSTED").alias("exhausted"), (F.count("*") > cap).alias("truncated"))
    return counts


def status_rollup(index_rows: DataFrame, most: int = 100) -> DataFrame:
    """One row over the tables: how many of them, active, building, degraded; the latest pull.

    The last run's outcome is recorded with its type, so a failure is one of any type.
    """
    rows = index_rows.orderBy("table_name").limit(most)
    failed = F.coalesce(F.col("last_run").rlike(r"(^|\s)FAILED$"), F.lit(False))
    return rows.agg(
        F.count("*").alias("tables"),
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
        F.count_if(F.col("status").isin("PENDING_BUILD", "BUILDING", "REBUILDING")).alias("building"),
        F.coalesce(F.bool_or(failed | (F.col("status") == "NEEDS_REINDEX")), F.lit(False)).alias("degraded"),
        F.max(F.greatest("last_pull", "last_build")).alias("latest"),
    )


def health(paused: Column, pending: Column, exhausted: Column, truncated: Column) -> Column:
    return F.when(paused | (pending > 100) | (exhausted > 0) | truncated, "DEGRADED").otherwise("HEALTHY")


def backlog_health(settings: DataFrame, counts: DataFrame) -> DataFrame:
    """One row from one row of settings (paused) and one of ``backlog``."""
    return settings.crossJoin(F.broadcast(counts)).select("paused", "pending", "exhausted", health(F.col("paused"), F.col("pending"), F.col("exhausted"), F.col("truncated")).alias("health"))


def table_health(index_rows: DataFrame) -> DataFrame:
    state = (
        F.when(~F.col("enabled"), "DISABLED")
        .when(F.col("status").isin("PENDING_BUILD", "BUILDING", "REBUILDING"), "BUILDING")
        .when(F.col("status") == "NEEDS_REINDEX", "DEGRADED")
        .otherwise("HEALTHY")
    )
    return index_rows.select("table_name", state.alias("health"))


def home_text(settings: DataFrame, index_rows: DataFrame) -> DataFrame:
    """The line that tells what the index is doing."""
    sums = index_rows.agg(F.count_if(F.col("status").isin("PENDING_BUILD", "BUILDING", "REBUILDING")).alias("b"), F.count_if(F.col("status") == "NEEDS_REINDEX").alias("n"))
    text = (
        F.when(F.col("paused"), "Indexing is paused.")
        .when(F.col("b") > 0, F.concat(F.lit("Building "), F.col("b").cast("string"), F.lit(" table(s).")))
        .when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" table(s) need a rebuild.")))
        .otherwise("Up to date.")
    )
    return settings.crossJoin(F.broadcast(sums)).select(text.alias("text"))


class RateLimiter:
    """At most ``most`` runs of a key within a sliding window of seconds."""

    def __init__(self, most: int, clock, seconds: float = 60.0):
        self.most, self.clock, self.seconds, self.seen = most, clock, seconds, {}

    def admit(self, key) -> bool:
        now, times = self.clock(), self.seen.setdefault(key, deque())
        while times and times[0] <= now - self.seconds:
            times.popleft()
        if len(times) >= self.most:
            return False
        times.append(now)
        return True


class AdmissionWindow:
    """At most ``most`` events within each fixed window of seconds; the others are counted as dropped."""

    def __init__(self, most: int, clock, seconds: float = 60.0):
        self.most, self.clock, self.seconds, self.start, self.n, self.dropped = most, clock, seconds, None, 0, 0

    def admit(self) -> bool:
        now = self.clock()
        if self.start is None or now - self.start >= self.seconds:
            self.start, self.n = now, 0
        self.n += 1
        if self.n > self.most:
            self.dropped += 1
            return False
        return True
