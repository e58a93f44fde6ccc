"""Search pages, locks, budgets, suggestions, the provider."""

import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import diagnose, search
from lodestar.operators import query as Q
from lodestar.operators.documents import build_documents, union_documents
from lodestar.operators.postings import build_postings, path_statistics, score_postings
from lodestar.operators.watch import Interrupted
from lodestar.plans.config import Analyzer, EngineConfig, FieldConfig, Role, TableConfig

PRODUCT = TableConfig("product", "id", (FieldConfig("name", weight=3, role=Role.TITLE), FieldConfig("description"), FieldConfig("sku", role=Role.EXACT, weight=2), FieldConfig("notes", analyzer=Analyzer.ENGLISH, in_snippet=False)))
EVENT = TableConfig("event", "id", (FieldConfig("title", weight=2), FieldConfig("quantity"), FieldConfig("day")))
CONFIG = EngineConfig(tables=(PRODUCT, EVENT))


@pytest.fixture(scope="module")
def docs(spark):
    products = [(1, "Blue Widget", "A small thing", "4711", "running late"), (2, "Gadget", "A blue widget holder", "A-1", None), (3, "Red Widget", "Stella made it", None, "he runs"), (4, "Stone", "grey", "47", None), (5, None, None, None, None)]
    events = [(1, "Delivery", 4242, "2026-04-01"), (2, "Widget fair", 7, "2026-05-02")]
    parts = [
        build_documents(spark.createDataFrame(products, "id int, name string, description string, sku string, notes string"), PRODUCT),
        build_documents(spark.createDataFrame(events, "id int, title string, quantity int, day string"), EVENT),
    ]
    return union_documents(parts).persist()


def found(docs, term, tables=("product", "event"), **more):
    page = search.execute(docs, search.Request(term, tables, **more), CONFIG)
    return [(r.source_table, r.record_id) for r in page.rows.collect()], page


def test_and_over_fields(docs):
    assert {i for _, i in found(docs, "blue widget", ("product",))[0]} == {"1", "2"}
    assert found(docs, "zzzz")[0] == [] and found(docs, "zzzz")[1].total == 0
    assert found(docs, "stella", ("product",))[0] == [("product", "3")]
    assert found(docs, "4242")[0] == [("event", "1")] and found(docs, "2026 04")[0] == [("event", "1")]


def test_one_letter_tokens_match_nothing(docs):
    assert found(docs, "blue w")[0] == [] and found(docs, "w")[0] == []


def test_words_of_several_pieces(spark):
    rows = spark.createDataFrame([(1, "Pat O'Neil", "costs 3.5", None, None), (2, "O Neil", "3 5", None, None), (3, "x", "we don't", None, "it isn't")], "id int, name string, description string, sku string, notes string")
    docs = build_documents(rows, PRODUCT)
    for term, ids in (("O'Neil", {"1"}), ("o'neil 3.5", {"1"}), ("3.5", {"1"}), ("don't", {"3"}), ("don", {"3"}), ("neil", {"2"})):
        assert {i for _, i in found(docs, term, ("product",))[0]} == ids, term


def test_exact_and_english_fields(docs):
    assert found(docs, "4711")[0] == [("product", "1")] and found(docs, "471")[0] == []
    assert {i for _, i in found(docs, "runs")[0]} == {"1", "3"}


def test_scores_are_positive_and_titles_lead(docs):
    page = found(docs, "widget")[1]
    rows = page.rows.collect()
    assert all(r.score > 0 for r in rows) and page.total == 4
    assert rows[-1].record_id == "2"


def test_postings_give_the_same_hits(docs):
    tables = list(CONFIG.tables)
    postings, stats = build_postings(docs, tables).persist(), path_statistics(docs, tables).persist()
    for term in ("widget", "blue widget", "runs", "4711", "zzz", "w", "2026", "delivery 42"):
        query = Q.plan(term, tables)
        scan = {(r.document_id, r.score) for r in Q.score(docs, query, tables).collect()}
        assert scan == {(r.document_id, r.score) for r in score_postings(postings, stats, query).collect()}, term


def test_pages(docs):
    first, one = found(docs, "widget", limit=1)
    second, two = found(docs, "widget", limit=3, offset=1)
    assert len(first) == 1 and len(second) == 3 and not set(first) & set(second)
    assert one.has_more and not two.has_more and one.total == two.total == 4


def test_a_page_is_evaluated_once(spark, docs):
    """Its rows are there: nothing of the index is read again."""
    rows = search.execute(docs, search.Request("widget", limit=2), CONFIG).rows
    assert "InMemoryTableScan" not in rows._jdf.queryExecution().toString() and [r.record_id for r in rows.collect()]
    none = search.execute(docs, search.Request("zzzz"), CONFIG)
    assert (none.total, none.has_more, none.rows.count()) == (0, False, 0)
    for term in ("!!", ""):
        empty = search.execute(docs, search.Request(term), EngineConfig(tables=CONFIG.tables, min_term=1))
        assert (empty.total, empty.has_more, empty.rows.count()) == (0, False, 0)
    assert search.execute(docs.limit(0), search.Request("widget"), CONFIG).total == 0
    past = search.execute(docs, search.Request("widget", offset=50), CONFIG)
    assert past.total == 4 and not past.has_more and past.rows.count() == 0


def test_fields_of_hits_are_highlighted(spark):
    long = "x" * 300 + " blue " + "word " * 60
    closed = TableConfig("closed", "id", (FieldConfig("name"), FieldConfig("secret"), FieldConfig("notes", in_snippet=False)), protected=frozenset({"secret"}))
    rows = spark.createDataFrame([(1, "Blue and BLUEST", "blue", long), (2, "red", None, "comes in blue and green"), (3, "red", "blue", None)], "id int, name string, secret string, notes string")
    docs = build_documents(rows, closed)
    page = docs.select("document_id", "record_id").where("record_id <> '4'")
    found = {r.record_id: {h.field: (h.fragment, [(x.start, x.end) for x in h.ranges]) for h in r.highlights} for r in search.highlighted(page, docs, " blue ", [closed]).collect()}
    assert found["1"]["name"] == ("Blue and BLUEST", [(0, 4), (9, 15)]) and set(found["1"]) == {"name", "notes"}
    piece, ranges = found["1"]["notes"]
    assert len(piece) <= 160 and [piece[a:b] for a, b in ranges] == ["blue"]
    assert found["2"] == {"notes": ("comes in blue and green", [(9, 13)])} and found["3"] == {}
    assert search.highlighted(page, docs.limit(0), "blue", [closed]).where("size(highlights) = 0").count() == 3
    assert search.highlighted(page, docs, "!", []).where("size(highlights) = 0").count() == 3


def test_requests_are_bounded():
    bounds = search.check(search.Request("  x  "), CONFIG)
    assert bounds.empty and bounds.term == "x"
    assert search.check(search.Request("xx"), CONFIG).limit == 25
    assert search.check(search.Request("xx", limit=500), CONFIG).limit == 100
    assert search.check(search.Request("xx", limit=100, offset=9950), CONFIG).limit == 50
    assert search.check(search.Request("xx", offset=10_000), CONFIG).empty
    assert search.check(search.Request("xx", offset=-5), CONFIG).offset == 0
    with pytest.raises(ValueError):
        search.check(search.Request("x" * 101), CONFIG)


def test_allowed_tables():
    names = lambda **k: [t.name for t in search.allowed_tables(search.Request("x", **k), CONFIG)]
    assert names() == ["event", "product"] and names(tables=("product", "nope", "product")) == ["product"]
    assert search.allowed_tables(search.Request("x"), CONFIG, readable={"event"})[0].name == "event"


def test_per_table_pages_come_in_the_tables_order(docs):
    rows, page = found(docs, "widget", ("event", "product"), per_table=2)
    assert rows[0] == ("event", "2") and len(rows) == 3 and page.total == 4 and page.has_more


def test_locked_records_are_left_out(spark, docs):
    locks = {"product": spark.createDataFrame([("2",), ("3",), ("77",)], "record_id string")}
    page = search.execute(docs, search.Request("widget", limit=1), CONFIG, locks=locks)
    assert page.total == 3 and page.has_more and not page.lower_bound and page.rows.count() == 1
    rows = search.execute(docs, search.Request("widget", limit=10), CONFIG, locks=locks).rows.collect()
    assert {(r.source_table, r.record_id) for r in rows} == {("product", "2"), ("product", "3"), ("event", "2")}
    assert search.accessible(docs, {}) is docs


def test_windows_of_locked_tables(spark, docs):
    assert search.table_window(2, 5, CONFIG) == 5000 and search.table_window(3, 5, CONFIG, single_pass=True) == 10
    assert search.table_window(5000, 50, CONFIG) == 100
    tight = EngineConfig(tables=CONFIG.tables, window=2)
    locks = {"product": spark.createDataFrame([("2",), ("3",)], "record_id string")}
    page = search.execute(docs, search.Request("widget"), tight, locks=locks)
    assert page.total < 4 and page.lower_bound and page.has_more
    page = search.execute(docs, search.Request("widget", per_table=5), CONFIG, locks=locks)
    assert (page.total, page.lower_bound, page.has_more) == (3, False, False)
    assert [r.record_id for r in page.rows.where("source_table = 'product'").collect()] in (["2", "3"], ["3", "2"])


def test_whole_locked_pages_count_beyond_the_window(spark, docs):
    tight = EngineConfig(tables=CONFIG.tables, window=2)
    locks = {"product": spark.createDataFrame([("2",), ("3",)], "record_id string")}
    page = search.execute(docs, search.Request("widget", limit=2, whole=True), tight, locks=locks)
    assert (page.total, page.lower_bound, page.has_more, page.rows.count()) == (3, True, True, 2)
    page = search.execute(docs, search.Request("widget", limit=2, whole=True), CONFIG, locks=locks)
    assert (page.total, page.lower_bound, page.has_more) == (3, False, True)


def test_suggestions(docs):
    tables = list(CONFIG.tables)
    hits = Q.score(docs, Q.plan("widget", tables), tables)
    rows = search.suggest(hits, items=2, groups=1).collect()
    assert len(rows) == 1 and rows[0].source_table == "product" and rows[0].has_more and rows[0].truncated and len(rows[0]["items"]) == 2
    rows = search.suggest(hits).orderBy("position").collect()
    assert [r.source_table for r in rows] == ["product", "event"] and not rows[0].truncated and not rows[0].has_more


def test_provider_steps_back_after_a_failure(docs):
    now = [0.0]
    provider = search.Provider(docs, CONFIG, clock=lambda: now[0], limit_seconds=None)
    assert provider.claims("product") and not provider.claims("nope")
    assert {r.record_id for r in provider.search("blue", ["product"], 5).collect()} == {"1", "2"}
    slow = search.Provider(docs.where(F.udf(lambda _: time.sleep(60) or True, "boolean")("record_id")), CONFIG, clock=lambda: now[0], limit_seconds=1.0)
    began = time.monotonic()
    with pytest.raises(Interrupted):
        slow.search("stone", ["product"], 5)
    assert time.monotonic() - began < 20 and not slow.claims("product") and provider.claims("product")
    broken = search.Provider(docs.drop("searchable_text"), CONFIG, clock=lambda: now[0])
    with pytest.raises(Exception):
        broken.search("blue", ["product"], 5)
    assert not broken.claims("product")
    now[0] = 30.0
    assert broken.claims("product")


def test_results_fall_back_to_the_tables_name(docs):
    rows = search.results(docs.withColumn("record_label", F.lit("")), list(CONFIG.tables), {"product": "Products"}).collect()
    assert {(r.source_table, r.table_label, r.record_label) for r in rows} == {("product", "Products", "product"), ("event", "event", "event")}


def test_rank_and_gates(docs):
    tables = list(CONFIG.tables)
    hits = Q.score(docs, Q.plan("widget", tables), tables)
    ranks = {d: diagnose.rank_of(hits, d).collect() for d in ("product:1", "product:9")}
    assert ranks["product:1"][0].of == 3 and ranks["product:9"] == []
    gates = {r.document_id: r.reason for r in diagnose.match_gates(docs, "blue wid").collect()}
    assert gates["product:1"] is None and gates["product:3"] == "blue: no word with this prefix"
    assert set(r.reason for r in diagnose.match_gates(docs, "x").collect()) == {"term too short"}


def test_rate_windows():
    now = [0.0]
    limiter = diagnose.RateLimiter(2, lambda: now[0])
    assert [limiter.admit("a") for _ in range(3)] == [True, True, False] and limiter.admit("b")
    now[0] = 60.0
    assert limiter.admit("a")
    window = diagnose.AdmissionWindow(2, lambda: now[0])
    assert [window.admit() for _ in range(3)] == [True, True, False] and window.dropped == 1
    now[0] = 125.0
    assert window.admit()


def test_plan_has_no_python_and_prunes_columns(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/docs")
    table = TableConfig("event", "id", (FieldConfig("title", weight=2),))
    plan = Q.score(spark.read.parquet(f"{tmp_path}/docs"), Q.plan("widget", [table]), [table])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "display_values" not in plan and "CartesianProduct" not in plan


def test_playground(spark, docs):
    readable = docs.where("document_id <> 'product:1'").select("source_table", "record_id")
    found = diagnose.playground(docs, list(CONFIG.tables), "widget", readable)
    assert {r.document_id for r in found["hits"].collect()} == {"product:2", "product:3", "event:2"}
    assert {(r.source_table, r.n) for r in found["counts"].collect()} == {("product", 2), ("event", 1)}
    assert all("text" in r.clauses for r in found["clauses"].collect())
    assert found["gates"].where("reason is null").count() == 4
    assert found["contributions"].where("clause = 'boost:name'").count() == 1


def test_names_are_split_once():
    assert diagnose.split_names(" part, customer\n part\torders,,") == ["part", "customer", "orders"] and diagnose.split_names(None) == []


def test_texts_are_cut_into_words_once_for_matches_and_once_for_statistics(docs):
    tables = list(CONFIG.tables)
    asked = Q.plan("small widget", tables)
    cut = Q.score(docs, asked, tables)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    words = sum(p.analyzer is not Analyzer.EXACT for p in asked.paths)
    assert cut == 2 * words


def test_postings_are_sorted_within_tasks_without_a_shuffle(docs):
    plan = build_postings(docs, list(CONFIG.tables))._jdf.queryExecution().executedPlan().toString()
    assert "Sort [path" in plan and "rangepartitioning" not in plan
