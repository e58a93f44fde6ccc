"""Search orchestration: pages, per-table results, record locks, suggestions, the search provider.

Hits come ranked from one plan, over documents or a stored index, which a page evaluates once: its rows
are few and are fetched with it, and its total is counted while they are sought. Locks are semi-joins
with the readable rows. Totals and flags are exact within the best ``window`` hits
(10,000; a part of it for each of several locked tables), beyond which a total is a lower bound. A ``whole`` request
for a page of locked tables looks at all hits: its total is exact, and only the flag tells that there are more hits than the window.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.highlight import FIELD_FRAGMENTS, FRAGMENT, highlight_fields
from ..plans.config import EngineConfig, TableConfig
from .query import Plan, normalize_term, order, plan, score, tokenize
from .watch import Watch

SUGGEST_GROUPS, MAX_SUGGEST_GROUPS = 8, 20
SUGGEST_ITEMS, MAX_SUGGEST_ITEMS = 5, 10
PROVIDER_FACTOR = 4


@dataclass(frozen=True)
class Request:
    term: str
    tables: tuple[str, ...] | None = None
    limit: int | None = None
    offset: int = 0
    per_table: int | None = None
    single_pass: bool = False
    whole: bool = False


@dataclass(frozen=True)
class Bounds:
    """A checked request: nothing to search if ``empty``."""

    term: str
    limit: int
    offset: int
    per_table: int | None
    empty: bool


@dataclass
class Page:
    rows: DataFrame
    total: int
    lower_bound: bool
    has_more: bool


def check(request: Request, config: EngineConfig) -> Bounds:
    term = normalize_term(request.term)
    if len(term) > config.max_term:
        raise ValueError(f"a search term has at most {config.max_term} characters")
    limit = min(request.limit, config.max_search_limit) if request.limit and request.limit > 0 else config.default_limit
    offset = max(request.offset or 0, 0)
    per_table = min(request.per_table, config.max_search_limit) if request.per_table else None
    return Bounds(term, min(limit, max(config.window - offset, 0)), offset, per_table, len(term) < config.min_term or offset >= config.window)


def allowed_tables(request: Request, config: EngineConfig, readable: set[str] | None = None) -> list[TableConfig]:
    """Requested tables (all, by name, if none is named) that are configured, enabled, readable and have an open key; each once."""
    names = list(dict.fromkeys(request.tables)) if request.tables else sorted(t.name for t in config.tables)
    found = (config.table(n) for n in names)
    return [t for t in found if t is not None and t.enabled and t.searchable and (readable is None or t.name in readable)]


def accessible(hits: DataFrame, locks: Mapping[str, DataFrame]) -> DataFrame:
    """Hits that may be read. ``locks``: of locked tables the readable record ids (``record_id``); other tables are open."""
    if not locks:
        return hits
    sides = [ids.select(F.lit(name).alias("source_table"), F.col("record_id").cast("string").alias("record_id")) for name, ids in locks.items()]
    locked = F.col("source_table").isin(*locks)
    return hits.where(~locked).unionByName(hits.where(locked).join(reduce(DataFrame.union, sides), ["source_table", "record_id"], "left_semi").select(hits.columns))


def page(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return hits.orderBy(*order()).offset(offset).limit(limit)


def ranked_per_table(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Hits ranked ``offset + 1`` to ``offset + limit`` of each table, with ``rank``. Spark cuts each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("source_table").orderBy(F.col("score").desc(), "record_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= offset + limit).where(F.col("rank") > offset)


def bounded_total(hits: DataFrame, config: EngineConfig) -> tuple[int, bool]:
    """How many hits, counted up to the window; whether that is a lower bound."""
    n = hits.limit(config.window + 1).count()
    return min(n, config.window), n > config.window


def table_window(n_tables: int, per_table: int, config: EngineConfig, single_pass: bool = False) -> int:
    """How many of a locked table's hits are looked at: its part of the window, two pages at least; just these in a single pass."""
    least = min(config.window, 2 * per_table)
    return least if single_pass else max(config.window // n_tables, least)


def fetched(shown: DataFrame) -> DataFrame:
    """A page as rows that are there, so that nothing is evaluated again; ``shown`` is bounded by the search limit."""
    return shown.sparkSession.createDataFrame(shown.collect(), shown.schema)


def open_page(hits: DataFrame, limit: int, offset: int, config: EngineConfig) -> Page:
    """A page of all hits. They are counted in the job that finds the page."""
    seen = Observation()
    rows = fetched(page(hits.observe(seen, F.count("*").alias("n")), limit, offset))
    n = seen.get["n"]
    total = min(n, config.window)
    return Page(rows, total, n > config.window, offset + limit < total)


def locked_page(hits: DataFrame, locks: Mapping[str, DataFrame], limit: int, offset: int, config: EngineConfig) -> Page:
    """A page of the accessible ones of the best ``window`` hits, which are kept while they are looked at."""
    best = hits.orderBy(*order()).limit(config.window + 1).persist()
    try:
        floor = best.count() > config.window
        free = accessible(best.orderBy(*order()).limit(config.window), locks)
        total = free.count()
        return Page(fetched(page(free, limit, offset)), total, floor, total > offset + limit or floor)
    finally:
        best.unpersist()


def whole_locked_page(hits: DataFrame, locks: Mapping[str, DataFrame], limit: int, offset: int, config: EngineConfig) -> Page:
    """A page of all accessible hits, with their exact total. The hits are kept, on disk too, while they are looked at."""
    kept = hits.persist()
    try:
        floor = kept.count() > config.window
        free = accessible(kept, locks)
        total = free.count()
        return Page(fetched(page(free, limit, offset)), total, floor, total > offset + limit)
    finally:
        kept.unpersist()


def search_hits(source, query: Plan, tables: list[TableConfig]) -> DataFrame:
    """Ranked hits of documents or of a stored index."""
    return score(source, query, tables) if isinstance(source, DataFrame) else source.hits(query, tables)


def execute(source, request: Request, config: EngineConfig, readable: set[str] | None = None, locks: Mapping[str, DataFrame] | None = None) -> Page:
    """One search over all of ``source``: a DataFrame of documents, or a stored index, which answers from its postings."""
    bounds, tables, locks = check(request, config), allowed_tables(request, config, readable), locks or {}
    asked = plan("" if bounds.empty else bounds.term, tables)
    hits = search_hits(source, asked, tables)
    if not asked.clauses:
        return Page(hits.limit(0), 0, False, False)
    if bounds.per_table is not None:
        return _per_table(hits, bounds, tables, locks, config, request.single_pass)
    if locks:
        return (whole_locked_page if request.whole else locked_page)(hits, locks, bounds.limit, bounds.offset, config)
    return open_page(hits, bounds.limit, bounds.offset, config)


def _cases(values: Mapping[str, int]):
    """The number that ``values`` gives for a row's table."""
    return reduce(lambda c, kv: c.when(F.col("source_table") == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0))


def _per_table(hits: DataFrame, bounds: Bounds, tables: list[TableConfig], locks, config: EngineConfig, single_pass: bool) -> Page:
    """A page of each table, in the tables' order and from one plan; totals add up, flags are or-ed."""
    part = table_window(len(tables), bounds.per_table, config, single_pass)
    windows = {t.name: part if t.name in locks else config.window for t in tables}
    ranked = ranked_per_table(hits, config.window + 1).withColumn("window", _cases(windows))
    mine = {k: v for k, v in locks.items() if k in windows}
    free = accessible(ranked.where("rank <= window").drop("window"), mine)
    # A row for each table.
    counts = {r.source_table: r for r in ranked.groupBy("source_table").agg(F.bool_or(F.col("rank") > F.col("window")).alias("floor")).join(free.groupBy("source_table").agg(F.count("*").alias("n")), "source_table", "left").collect()}
    totals = {name: (r.n or 0) for name, r in counts.items()}
    floors = {name: r.floor for name, r in counts.items()}
    more = any(n > bounds.offset + bounds.per_table or floors[name] and name in mine for name, n in totals.items())
    place = {t.name: i for i, t in enumerate(tables)}
    shown = ranked_per_table(free.drop("rank"), bounds.per_table, bounds.offset).drop("rank")
    rows = shown.withColumn("__spot", _cases(place)).orderBy("__spot", F.col("score").desc(), "record_id").drop("__spot")
    return Page(rows, sum(totals.values()), any(floors.values()), more)


def highlighted(found: DataFrame, documents: DataFrame, term: str, tables: list[TableConfig], size: int = FRAGMENT) -> DataFrame:
    """Hits of a page with ``highlights``: of each field whose value has a word that the term's tokens begin, one fragment with the places of the hits in it, by field name.

    Any field counts, whichever clause matched; protected fields don't. ``found`` is a page, so the documents are read once, to join it.
    """
    hidden = reduce(lambda c, t: c.when(F.col("source_table") == t.name, F.array(*map(F.lit, sorted(t.protected)))), (t for t in tables if t.protected), F.when(F.lit(False), F.array().cast("array<string>")))
    values = F.map_filter("field_values", lambda k, _: ~F.coalesce(F.array_contains(hidden, k), F.lit(False)))
    shown = documents.join(F.broadcast(found.select("document_id")), "document_id", "left_semi").select("document_id", highlight_fields(values, tokenize(normalize_term(term)), size).alias("highlights"))
    return found.join(shown, "document_id", "left").select(*found.columns, F.coalesce("highlights", F.array().cast(FIELD_FRAGMENTS)).alias("highlights"))


def results(hits: DataFrame, tables: list[TableConfig], labels: Mapping[str, str] | None = None) -> DataFrame:
    """Hits as results: the table's label, the record's label or else the table's name."""
    shown = reduce(lambda c, kv: c.when(F.col("source_table") == kv[0], kv[1]), (labels or {}).items(), F.when(F.lit(False), "")) if labels else F.lit(None).cast("string")
    return hits.withColumns({"table_label": F.coalesce(shown, F.col("source_table")), "record_label": F.coalesce(F.when(F.col("record_label") != "", F.col("record_label")), F.col("source_table"))})


def suggest(hits: DataFrame, items: int | None = None, groups: int | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Groups of suggestions: source_table, position, has_more, truncated, items (record_id, label) best first.

    Groups come by their best score, then by name. One item more than shown is
    asked for to know if there are more, but never more than the search limit.
    """
    items = min(items or SUGGEST_ITEMS, MAX_SUGGEST_ITEMS)
    groups = min(groups or SUGGEST_GROUPS, MAX_SUGGEST_GROUPS)
    asked = min(items + 1, config.max_search_limit)
    top = ranked_per_table(hits, asked)
    found = top.groupBy("source_table").agg(
        F.max("score").alias("best"),
        (F.count("*") > items).alias("has_more"),
        F.transform(F.filter(F.sort_array(F.collect_list(F.struct("rank", "record_id", "record_label"))), lambda x: x["rank"] <= items), lambda x: F.struct(x["record_id"].alias("record_id"), x["record_label"].alias("label"))).alias("items"),
    )
    # One row per table from here on.
    spot = Window.orderBy(F.col("best").desc(), "source_table")
    placed = found.withColumn("position", F.row_number().over(spot)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return placed.where(F.col("position") <= groups).select("source_table", "position", "has_more", (F.col("n") > groups).alias("truncated"), "items")


#: Seconds that a host's record search may take.
RECORD_SEARCH_SECONDS = 2.5


class Provider:
    """Record search for a host: it claims tables, and steps back for a while after a failure.

    ``source`` is a stored index, which answers from its postings, or a DataFrame of documents. A search that takes longer than
    ``limit_seconds`` (None: as long as it takes) is interrupted, which is a failure.
    """

    def __init__(self, source, config: EngineConfig, clock, backoff_seconds: float = 30.0, limit_seconds: float | None = RECORD_SEARCH_SECONDS):
        self.source, self.config, self.clock, self.backoff, self.until = source, config, clock, backoff_seconds, float("-inf")
        self.limit_seconds = limit_seconds

    def claims(self, table: str) -> bool:
        found = self.config.table(table)
        return found is not None and found.enabled and found.searchable and self.clock() >= self.until

    def search(self, term: str, tables: list[str], limit: int, locks: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """The best readable hits of each claimed table: at most ``limit`` rows for each, computed once. A failure is raised, and no table is claimed for a while."""
        claimed = [t for t in map(self.config.table, tables) if t is not None and self.claims(t.name)]
        try:
            asked = min(self.config.max_search_limit, PROVIDER_FACTOR * limit)
            hits = ranked_per_table(search_hits(self.source, plan(term, claimed), claimed), asked)
            found = ranked_per_table(accessible(hits.drop("rank"), locks or {}), limit)
            with Watch(found.sparkSession, limit=self.limit_seconds):
                rows = found.collect()  # bounded by limit and tables
            return found.sparkSession.createDataFrame(rows, found.schema)
        except Exception:
            self.until = self.clock() + self.backoff
            raise


def path_diagnosis(tables: DataFrame) -> DataFrame:
    """Why a table is searched by the index, by its host, or not at all: from flags configured, enabled, key_protected, readable, in_backoff, host_fields."""
    by_host = F.when(F.col("host_fields") > 0, "host").otherwise("none")
    reason = (
        F.when(~F.col("readable"), "not readable")
        .when(~F.col("configured"), "not indexed")
        .when(F.col("key_protected"), "key is protected")
        .when(~F.col("enabled"), "disabled")
        .when(F.col("in_backoff"), "search failed a moment ago")
    )
    searched = F.when(~F.col("readable"), "none").when(reason.isNotNull(), by_host).otherwise("index")
    return tables.select("table_name", searched.alias("searched_by"), F.coalesce(reason, F.lit("indexed")).alias("reason"))
