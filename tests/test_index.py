"""The stored index, maintenance and the change stream."""

import datetime
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import admin, maintain, processes, validate
from lodestar.operators import query as Q
from lodestar.operators.documents import build_documents
from lodestar.operators.watch import Interrupted, Watch
from lodestar.plans.config import Analyzer, DocumentsChoice, EngineConfig, FieldConfig, Role, TableConfig
from lodestar.sources.index import Index, MappingChanged, Moved, Rival, TakenOver
from lodestar.streaming.changes import ChangeHandler, IndexPublisher, Source, follow, last_changes

PEOPLE = TableConfig("people", "id", (FieldConfig("name", weight=3), FieldConfig("city")), timestamp="changed")
PLACES = TableConfig("places", "id", (FieldConfig("name"),))
CONFIG = EngineConfig(tables=(PEOPLE, PLACES))


def people(spark, rows):
    return spark.createDataFrame([(i, n, c, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=v)) for i, n, c, v in rows], "id int, name string, city string, changed timestamp")


def docs(spark, rows):
    return build_documents(people(spark, rows), PEOPLE)


@pytest.fixture
def index(spark, tmp_path):
    found = Index(spark, str(tmp_path / "index"), CONFIG)
    places = build_documents(spark.createDataFrame([(1, "Stone house")], "id int, name string"), PLACES)
    found.rebuild({"people": docs(spark, [(1, "Stella", "Bern", 10), (2, "Stone", "Bonn", 10)]), "places": places})
    return found


def names(index):
    return {r.document_id: r.field_values["name"] for r in index.documents().collect()}


def test_rebuild_and_search(spark, index, tmp_path):
    assert names(index) == {"people:1": "Stella", "people:2": "Stone", "places:1": "Stone house"}
    assert {r.document_id for r in index.search("stone").collect()} == {"people:2", "places:1"}
    before = index.manifest()
    index.rebuild({"people": docs(spark, [(1, "Ada", "Bern", 10)])})
    assert names(index) == {"people:1": "Ada"} and index.search("stone").count() == 0
    assert os.path.exists(before["tables"]["people"]["base"]) and index.manifest()["version"] == before["version"] + 1
    assert not Index(spark, str(tmp_path / "none"), CONFIG).exists() and not index.needs_rebuild()


def test_older_writes_are_skipped(spark, index):
    newer, older = [docs(spark, [(1, n, "x", v)]).withColumn("seq", F.lit(s).cast("long")) for n, v, s in (("New", 20, 1), ("Old", 5, 2))]
    index.apply("people", newer)
    index.apply("people", older)
    assert names(index)["people:1"] == "New"
    same = docs(spark, [(1, "Same", "x", 20)]).withColumn("seq", F.lit(3).cast("long"))
    index.apply("people", same, deleted=spark.createDataFrame([("people:2",)], "document_id string"))
    assert names(index) == {"people:1": "Same", "places:1": "Stone house"}
    assert {r.document_id for r in index.search("same").collect()} == {"people:1"}


def test_a_batch_writes_one_small_segment(spark, index):
    """Neither the base nor the postings are written again, and a search sees the batch."""
    before = index.manifest()
    index.apply("people", docs(spark, [(3, "Stonewall", "Ulm", 1)]).withColumn("seq", F.lit(1).cast("long")))
    now = index.manifest()
    kept = lambda m: [m["tables"]["people"][k] for k in ("base", "postings")]
    assert kept(now) == kept(before) and now["tables"]["places"] == before["tables"]["places"]
    (segment,) = now["tables"]["people"]["segments"]
    assert sum(f.endswith(".parquet") for f in os.listdir(segment["writes"])) <= 4 and segment["deletes"] is None
    assert {r.document_id for r in index.search("stone").collect()} == {"people:2", "people:3", "places:1"}
    index.apply("people", docs(spark, [(2, "Ston", "Ulm", 99)]).withColumn("seq", F.lit(1).cast("long")), spark.createDataFrame([("people:3",), ("people:77",)], "document_id string"))
    index.apply("places", deleted=spark.createDataFrame([("places:1",)], "document_id string"))
    assert {r.document_id for r in index.search("stone").collect()} == set() and {r.document_id for r in index.search("ulm").collect()} == {"people:2"}
    assert index.segments() == {"people": 2, "places": 1}
    # What a scan of the live documents gives is what a compacted index gives, scores too.
    query, tables = Q.plan("ston", list(CONFIG.tables)), list(CONFIG.tables)
    scanned = {(r.document_id, r.score) for r in Q.score(index.documents(), query, tables).collect()}
    assert {r.document_id for r in index.hits(query, tables).collect()} == {d for d, _ in scanned}
    index.compact()
    assert index.segments() == {"people": 0, "places": 0} and {(r.document_id, r.score) for r in index.hits(query, tables).collect()} == scanned


def same_as_a_scan(index, *terms):
    """The index's hits and scores, which are those of a scan of its live documents."""
    tables, out = list(CONFIG.tables), []
    for term in terms:
        hits = {(r.document_id, r.score) for r in index.search(term).collect()}
        assert hits == {(r.document_id, r.score) for r in Q.score(index.documents(), Q.plan(term, tables), tables).collect()}, term
        out.append(len(hits))
    return out


def test_scores_are_those_of_the_live_documents(spark, index):
    """Replaced, deleted and added documents, writes that are skipped and dropped tables: no compaction is needed."""
    terms = ("stone", "ulm")
    assert same_as_a_scan(index, "stone", "stone house") == [2, 1]
    index.apply("people", docs(spark, [(1, "Stone of many words in a long name", "Stonetown", 20), (2, "Old", "x", 5), (3, "Stonewall", "Ulm", 1)]).withColumn("seq", F.lit(1).cast("long")))
    assert same_as_a_scan(index, *terms)[0] == 4
    index.apply("people", deleted=spark.createDataFrame([("people:1",), ("people:99",)], "document_id string"))
    assert same_as_a_scan(index, *terms)[0] == 3
    postings = index.manifest()["tables"]["people"]["postings"]
    index.drop_table("places")
    assert postings and index.manifest()["tables"]["people"]["postings"] == postings and same_as_a_scan(index, *terms) == [2, 1]
    index.drop_table("nowhere")
    again = build_documents(spark.createDataFrame([(1, "Stone hut"), (2, None)], "id int, name string"), PLACES)
    index.apply("places", again.withColumn("seq", F.lit(1).cast("long")))
    assert same_as_a_scan(index, *terms)[0] == 3
    before = {(r.document_id, r.score) for r in index.search("stone").collect()}
    index.compact()
    now = index.manifest()
    assert now["tables"]["people"]["postings"] != postings and now["tables"]["places"]["postings"] and same_as_a_scan(index, *terms)[0] == 3
    assert before == {(r.document_id, r.score) for r in index.search("stone").collect()}
    index.drop_table("people"), index.drop_table("places")
    assert index.search("stone").count() == 0


def test_postings_of_an_older_layout_are_not_read(spark, index):
    """A table without readable postings is scanned, the others are not; a compaction mends it."""
    for name in ("people", "places"):
        index._discard(index.manifest()["tables"][name]["postings"][0] + "/lengths")
        assert same_as_a_scan(index, "stone") == [2]
    index.compact()
    assert all(index._has_postings(e) for e in index.manifest()["tables"].values()) and same_as_a_scan(index, "stone") == [2]


def test_a_table_built_meanwhile_is_not_left_without_postings(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), CONFIG)
    draft = index.draft()
    draft.add("people", docs(spark, [(1, "Ada", "Bern", 10)]))
    index.rebuild({"places": build_documents(spark.createDataFrame([(1, "Stone")], "id int, name string"), PLACES)})
    draft.finish()
    assert same_as_a_scan(index, "stone", "ada") == [1, 1]


def test_deleted_documents_come_back_with_any_version(spark, index):
    one = lambda name, v: docs(spark, [(1, name, "x", v)]).withColumn("seq", F.lit(0).cast("long"))
    index.apply("people", one("Old", 1))
    assert names(index)["people:1"] == "Stella"
    index.apply("people", deleted=spark.createDataFrame([("people:1",)], "document_id string"))
    assert "people:1" not in names(index)
    index.apply("people", one("Old", 1))
    assert names(index)["people:1"] == "Old"
    stored = index.compact()
    assert names(index)["people:1"] == "Old" and stored["tables"]["places"]["segments"] == []


def test_files_outlive_their_manifest_for_a_while(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), CONFIG, retain=0.0)
    first = index.rebuild({"people": docs(spark, [(1, "Ada", "Bern", 10)])})
    reader = index.documents()
    index.rebuild({"people": docs(spark, [(1, "Eva", "Bern", 10)])})
    assert [r.field_values["name"] for r in reader.collect()] == ["Ada"]
    index.rebuild({"people": docs(spark, [(1, "Ida", "Bern", 10)])})
    assert not os.path.exists(first["tables"]["people"]["base"]) and names(index) == {"people:1": "Ida"}


def test_two_writers_of_one_version(spark, index):
    """The second to create a manifest fails, even if it has checked before the first was there."""
    other = Index(spark, index.path, CONFIG)
    stale = other.manifest()
    index.drop_table("places")
    other.manifest = lambda: stale
    with pytest.raises(Moved):
        other.swap(stale, stale["version"])


def one(spark, i, name, v, seq=0):
    return docs(spark, [(i, name, "x", v)]).withColumn("seq", F.lit(seq).cast("long"))


class Busy(Index):
    """Another writer comes in between the writing and the commit."""

    meanwhile = staticmethod(lambda: None)

    def _postings(self, tables):
        path = super()._postings(tables)
        self.meanwhile()
        return path


def test_rebuild_and_compact_end_under_live_writes(spark, index):
    busy = Busy(spark, index.path, CONFIG)

    def meanwhile():
        index.apply("people", one(spark, 7, "Late", 1))
        index.apply("people", deleted=spark.createDataFrame([("people:2",)], "document_id string"))

    busy.meanwhile = meanwhile
    busy.rebuild({"people": docs(spark, [(1, "Stella", "Bern", 10), (2, "Stone", "Bonn", 10)])})
    assert names(index) == {"people:1": "Stella", "people:7": "Late"} and index.segments() == {"people": 2}
    assert {r.document_id for r in index.search("late").collect()} == {"people:7"}
    busy.meanwhile = lambda: index.apply("people", one(spark, 1, "Newer", 99))
    busy.compact()
    assert names(index) == {"people:1": "Newer", "people:7": "Late"} and index.segments() == {"people": 1}
    busy.meanwhile = lambda: index.apply("places", build_documents(spark.createDataFrame([(4, "Hill")], "id int, name string"), PLACES).withColumn("seq", F.lit(0).cast("long")))
    busy.compact()
    assert names(index) == {"people:1": "Newer", "people:7": "Late", "places:4": "Hill"}


def test_replacements_of_a_table_conflict_and_leave_no_files(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"), CONFIG, retain=0.0)
    index.rebuild({"people": docs(spark, [(1, "Ada", "Bern", 10)])})
    busy = Busy(spark, index.path, CONFIG, retain=0.0)
    busy.meanwhile = lambda: index.rebuild({"people": docs(spark, [(1, "Eva", "Bern", 10)])})
    with pytest.raises(Moved):
        busy.rebuild({"people": docs(spark, [(1, "Ida", "Bern", 10)])})
    assert names(index) == {"people:1": "Eva"}
    index.apply("people", one(spark, 2, "Two", 1))
    turns = []

    def once():
        if not turns:
            turns.append(1)
            index.rebuild({"people": docs(spark, [(1, "Uta", "Bern", 10)])})
            index.apply("people", one(spark, 3, "Three", 1))

    busy.meanwhile = once
    busy.compact()  # the second turn succeeds
    assert names(index) == {"people:1": "Uta", "people:3": "Three"} and index.segments() == {"people": 0}
    lost = index._write(docs(spark, [(9, "Lost", "x", 1)]), "people")  # a process that died here
    assert index.vacuum() == [lost] and not os.path.exists(lost)
    assert names(index) == {"people:1": "Uta", "people:3": "Three"} and index.search("three").count() == 1


def test_many_writers_lose_nothing(spark, index):
    import concurrent.futures

    def write(k):
        Index(spark, index.path, CONFIG).apply("people", one(spark, 100 + k, f"Writer{k}", 1))

    with concurrent.futures.ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    assert {f"people:{100 + k}" for k in range(12)} <= set(names(index)) and index.segments()["people"] == 12


def test_a_batch_is_committed_once(spark, index):
    index.apply("people", one(spark, 5, "Five", 1), once=("stream", 3))
    before = index.manifest()
    index.apply("people", one(spark, 5, "Five", 1), once=("stream", 3))
    index.apply("people", one(spark, 6, "Six", 1), once=("stream", 2))
    assert index.manifest() == before and "people:6" not in names(index)
    index.apply("people", one(spark, 6, "Six", 1), once=("stream", 4))
    index.compact()
    assert index.manifest()["batches"] == {"stream": 4} and "people:6" in names(index)


def test_a_lease_fences_its_former_holder(spark, index):
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    first = index.acquire("*", "first", at(0))
    with pytest.raises(Rival):
        index.acquire("*", "second", at(29))
    index.renew(first, at(20))
    with pytest.raises(Rival):
        index.acquire("*", "second", at(49))
    draft = index.draft()
    draft.add("people", docs(spark, [(1, "First", "x", 1)]))
    other = Index(spark, index.path, CONFIG)
    second = other.acquire("*", "second", at(51))
    assert second.token == first.token + 1
    with pytest.raises(TakenOver):
        draft.finish(lease=first)
    draft.discard()
    other.rebuild({"people": docs(spark, [(1, "Second", "x", 1)])}, lease=second)
    index.apply("people", one(spark, 8, "Stream", 1))  # writers of segments hold no lease
    assert names(index) == {"people:1": "Second", "people:8": "Stream"}
    other.release(second, at(52))
    assert index.acquire("*", "third", at(52)).token == second.token + 1
    with pytest.raises(TakenOver):
        other.compact(lease=second)


def test_fields_of_a_stored_index_are_known(spark, index):
    assert index.mapping_differences().count() == 0 and not index.needs_rebuild()
    heavier = Index(spark, index.path, EngineConfig(tables=(TableConfig("people", "id", (FieldConfig("name", weight=9), FieldConfig("city")), timestamp="changed"), PLACES)))
    assert not heavier.needs_rebuild() and heavier.search("stone").count() == 2
    other = Index(spark, index.path, EngineConfig(tables=(TableConfig("people", "id", (FieldConfig("name", analyzer=Analyzer.WORD),), timestamp="changed"), PLACES)))
    assert other.needs_rebuild() and {(r.field_name, r.stored, r.configured) for r in other.mapping_differences().collect()} == {("name", "PREFIX in the snippet", "WORD in the snippet"), ("city", "PREFIX in the snippet", None)}
    with pytest.raises(MappingChanged):
        other.search("stone")
    assert other.search("stone", ["places"]).count() == 1  # this table's fields are as they were
    other.rebuild({"people": docs(spark, [(1, "Stone", "Bern", 10)])})
    assert not other.needs_rebuild() and other.search("stone").count() == 1


def test_schema_of_a_stored_index(spark, index):
    assert index.schema_differences() == {}
    index.rebuild({"people": docs(spark, [(1, "Ada", "Bern", 10)]).drop("subtitle").withColumn("version", F.lit("x"))})
    (wrong,) = index.schema_differences().values()
    assert wrong == ["subtitle: missing for string", "version: string for bigint"]


def test_a_moved_manifest_is_refused(index):
    stale = index.manifest()
    index.drop_table("places")
    assert "places" not in index.manifest()["tables"]
    with pytest.raises(Moved):
        index.swap(stale, stale["version"])


def test_change_stream(spark, index, tmp_path):
    rows = people(spark, [(1, "Stella II", "Bern", 50), (3, "Nova", "Genf", 50)])
    changes = [(1, "people", "1", "UPDATE"), (2, "people", "2", "DELETE"), (3, "people", "3", "INSERT"), (4, "people", "1", "DELETE"), (5, "broken", "9", "UPDATE"), (6, "people", None, "UPDATE")]
    schema = "seq long, table_name string, record_id string, action string"
    spark.createDataFrame(changes, schema).write.parquet(str(tmp_path / "changes"))

    def bad():
        raise OSError("no source")

    handler = ChangeHandler({"people": Source(PEOPLE, lambda: rows), "broken": Source(PLACES.__class__("broken", "id", PLACES.fields), bad)}, IndexPublisher(index), lambda f: f.write.mode("append").parquet(str(tmp_path / "failed")), rebuilding=lambda: {"people"})
    for _ in range(2):  # the second start finds nothing new
        follow(spark.readStream.schema(schema).parquet(str(tmp_path / "changes")), handler, str(tmp_path / "check"), available_now=True).awaitTermination()
    # Record 1 was deleted last, but it exists, so what counts is its current row.
    assert names(index) == {"people:1": "Stella II", "people:3": "Nova", "places:1": "Stone house"}
    failed = {(r.table_name, r.record_id, r.action, r.status) for r in spark.read.parquet(str(tmp_path / "failed")).collect()}
    assert failed == {("broken", "9", "INDEX", "PENDING"), ("people", "1", "DELETE", "AWAITING_REINDEX"), ("people", "2", "DELETE", "AWAITING_REINDEX")}


def test_halves_of_a_batch_fail_alone(spark, index):
    class Half(IndexPublisher):
        def publish(self, table, writes, deleted):
            if writes is not None:
                raise OSError("disk full")
            super().publish(table, writes, deleted)

    rows = people(spark, [(1, "New", "x", 99)])
    changes = spark.createDataFrame([(1, "people", "1", "UPDATE"), (2, "people", "2", "DELETE")], "seq long, table_name string, record_id string, action string")
    seen = []
    ChangeHandler({"people": Source(PEOPLE, lambda: rows)}, Half(index), lambda f: seen.extend(f.collect()))(changes, 0)
    assert [(r.record_id, r.action, r.status, r.error) for r in seen] == [("1", "INDEX", "PENDING", "OSError: disk full")]
    assert names(index) == {"people:1": "Stella", "places:1": "Stone house"}


def test_pull_all_isolates_tables(spark, index, tmp_path):
    ledger, now = processes.Ledger(spark, str(tmp_path / "runs")), datetime.datetime(2024, 2, 1)

    def broken():
        raise OSError("no source")

    sources = {"people": Source(PEOPLE, lambda: people(spark, [(1, "Old", "x", 5), (3, "Nova", "y", 900)])), "places": Source(PLACES, broken)}
    last = datetime.datetime(2024, 1, 1, 0, 10)
    due = spark.createDataFrame([("people", "changed", None), ("places", None, last), ("unknown", None, last)], "table_name string, timestamp_field string, last_pull timestamp")
    found = {r.table_name: r for r in processes.pull_all(index, due, sources, ledger, now).collect()}
    assert [found["people"][c] for c in ("status", "processed", "indexed", "skipped", "last_pull")] == ["COMPLETED", 2, 1, 1, now]
    assert (found["places"].status, found["places"].last_pull, found["places"].first_error) == ("FAILED", last, "OSError: no source")
    assert found["unknown"].errors == 1 and names(index)["people:1"] == "Stella" and names(index)["people:3"] == "Nova"
    assert {(r.table_name, r.status, r.errors) for r in ledger.runs().collect()} == {("people", "COMPLETED", 0), ("places", "FAILED", 1), ("unknown", "FAILED", 1)}


def test_rebuild_of_all(spark, index, tmp_path):
    ledger, clock = processes.Ledger(spark, str(tmp_path / "runs")), [datetime.datetime(2024, 2, 1)]
    events = spark.createDataFrame([(1, "people", "9", "AWAITING_REINDEX"), (2, "people", "1", "AWAITING_REINDEX"), (3, "people", "7", "PENDING")], "event_id long, table_name string, record_id string, status string")
    sources = {"people": Source(PEOPLE, lambda: people(spark, [(1, "Eva", "x", 1)]))}
    run, left = processes.rebuild(index, sources, ledger, lambda: clock[0], lambda: events)
    assert names(index) == {"people:1": "Eva"} and [r.event_id for r in left.collect()] == [3]
    row = run.first()
    assert (row.status, row.processed, row.indexed, row.skipped) == ("COMPLETED", 1, 1, 0) and row.heartbeat is not None
    rival = ledger.start("people", "FULL", clock[0])
    with pytest.raises(processes.Rival):
        processes.rebuild(index, sources, ledger, lambda: clock[0], lambda: events)
    clock[0] += datetime.timedelta(hours=1)  # the rival is dead by now

    def cancelling():
        ledger.cancel(ledger.runs().where(f"status = 'RUNNING' and run_id <> '{rival}'").first().run_id, clock[0])
        return people(spark, [(5, "Ida", "x", 1)])

    with pytest.raises(processes.Cancelled):
        processes.rebuild(index, {"people": Source(PEOPLE, cancelling)}, ledger, lambda: clock[0], lambda: events)
    assert names(index) == {"people:1": "Eva"} and ledger.runs().where("status = 'CANCELLED' and cancel_requested").count() == 1


def test_paused_changes_are_deferred(spark, index, tmp_path):
    changes = spark.createDataFrame([(1, "people", "1", "UPDATE")], "seq long, table_name string, record_id string, action string")
    seen = []
    ChangeHandler({"people": Source(PEOPLE, lambda: people(spark, []))}, IndexPublisher(index), lambda f: seen.extend(f.collect()), paused=lambda: True)(changes, 0)
    assert [(r.record_id, r.status) for r in seen] == [("1", "DEFERRED")] and len(names(index)) == 3
    released = maintain.release_deferred(spark.createDataFrame(seen, "table_name string, record_id string, action string, attempts int, status string, error string")).collect()
    assert released[0].status == "PENDING"


def test_last_changes(spark):
    rows = spark.createDataFrame([(1, "t", "a", "INSERT"), (2, "t", "a", "DELETE"), (3, "u", "a", "UPDATE")], "seq long, table_name string, record_id string, action string")
    assert {(r.table_name, r.action) for r in last_changes(rows).collect()} == {("t", "DELETE"), ("u", "UPDATE")}


def test_versions_resolve_in_order(spark):
    def survivor(*writes):
        rows = [("d", v, s) for s, v in enumerate(writes)]
        return maintain.resolve_versions(spark.createDataFrame(rows, "document_id string, version long, seq long")).collect()[0].seq

    assert survivor(2000, 1000) == 0 and survivor(1000, 1000) == 1 and survivor(1, 3, 2) == 1
    assert survivor(2000, None) == 1 and survivor(2000, None, 5) == 2 and survivor(None, 7, 3) == 1


def test_reconcile_keeps_everything_after_an_error(spark):
    stored = docs(spark, [(1, "a", "x", 1), (9, "gone", "x", 1)])
    rebuilt = docs(spark, [(1, "b", "x", 2)])
    kept = lambda e: {r.document_id: r.field_values["name"] for r in maintain.reconcile(stored, rebuilt, "people", e).collect()}
    assert kept(0) == {"people:1": "b"} and kept(1) == {"people:1": "b", "people:9": "gone"}


def test_pulls(spark):
    rows = people(spark, [(1, "a", "x", 0), (2, "b", "x", 1000)])
    at = datetime.datetime(2024, 1, 1, 0, 20)
    assert maintain.changed_since(rows, "changed", None).count() == 2
    assert [r.id for r in maintain.changed_since(rows, "changed", at, 300).collect()] == [2]
    assert maintain.changed_since(rows, None, at).count() == 0
    assert maintain.next_watermark(1, 2, 0) == 2 and maintain.next_watermark(1, 2, 3) == 1


def test_statuses():
    assert maintain.next_status("PENDING_BUILD", "build") == "BUILDING" and maintain.next_status("BUILDING", "cancelled") == "NEEDS_REINDEX"
    assert maintain.next_status("ACTIVE", "rebuild") == "REBUILDING" and maintain.next_status("REBUILDING", "failed", "NEEDS_REINDEX") == "NEEDS_REINDEX"
    assert maintain.next_status("BUILDING", "index missing") == "BUILDING" and maintain.next_status("ACTIVE", "index missing") == "PENDING_BUILD"
    assert maintain.next_status("ACTIVE", "whatever") == "ACTIVE"


def test_sample_is_repeatable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    pick = lambda seed: sorted(r.k for r in maintain.hash_sample(rows, "k", 20, seed).collect())
    assert pick(1) == pick(1) != pick(2) and len(pick(1)) == 20
    assert sorted(r.k for r in maintain.edges(rows, "k", 5).collect()) == [0, 1, 2, 998, 999]
    assert maintain.edges(rows.limit(3), "k", 10).count() == 3


def test_removing_a_table(spark, index):
    rows = spark.createDataFrame([("people", True), ("places", True)], "table_name string, enabled boolean")
    graves = spark.createDataFrame([], "table_name string, field_name string")
    left = admin.remove_table("people", rows, rows, rows, graves, index.documents())
    assert [[r.table_name for r in f.collect()] for f in left[:3]] == [["places"]] * 3
    assert [(r.table_name, r.field_name) for r in left[3].collect()] == [("people", None)]
    assert {r.source_table for r in left[4].collect()} == {"places"}
    kept = admin.remove_table("people", rows, rows, rows, graves, index.documents(), DocumentsChoice.KEEP)[4]
    assert {r.source_table for r in kept.collect()} == {"places", "people"}


def test_enabling_queues_a_build(spark):
    rows = spark.createDataFrame([("a", False, "ACTIVE", False), ("b", True, "ACTIVE", False)], "table_name string, enabled boolean, status string, owner_edited boolean")
    found = {r.table_name: (r.enabled, r.status, r.owner_edited) for r in admin.set_enabled(rows, ["a", "b"], True).collect()}
    assert found == {"a": (True, "PENDING_BUILD", True), "b": (True, "ACTIVE", False)}


def test_cancel(spark):
    runs = spark.createDataFrame([(1, "RUNNING", False), (2, "COMPLETE", False), (3, "RUNNING", False)], "run_id int, status string, cancel_requested boolean")
    assert {r.run_id for r in admin.cancel_runs(runs, [1, 2]).where("cancel_requested").collect()} == {1}


SETTINGS = "paused boolean, paused_at timestamp, paused_by string, pause_reason string, last_primed_at timestamp, last_priming_summary string, last_priming_new_tables long"


def test_pause_stamps(spark):
    at = datetime.datetime(2024, 1, 1)
    plain = spark.createDataFrame([(False, None, None, None, None, None, None)], SETTINGS)
    paused = admin.set_paused(plain, True, F.lit(at), "ann", "disk full")
    assert tuple(paused.first())[:4] == (True, at, "ann", "disk full")
    again = admin.set_paused(paused, True, F.lit(at + datetime.timedelta(1)), "bob", "other")
    assert tuple(again.first())[:4] == (True, at, "ann", "disk full")
    assert tuple(admin.set_paused(again, False, F.lit(at)).first())[:4] == (False, None, None, None)


def test_settings_tell_changes_only(spark):
    at = datetime.datetime(2024, 1, 2)
    rows = lambda schema: spark.createDataFrame([], schema)
    pair = "table_name string, field_name string"
    step = "table_name string, step string"
    nothing = admin.priming_report(rows(pair), rows(pair), rows(step), rows(step), rows("table_name string"), rows("table_name string, label string"))
    told = nothing.first()
    assert (told.new_tables, told.skipped, told.has_changes, told.summary) == (0, 0, False, "No changes: the records match the code defaults.")
    known = spark.createDataFrame([(True, None, None, "x", None, "before", 7)], SETTINGS)
    assert tuple(admin.settings_after_priming(known, nothing, F.lit(at)).first()) == (True, None, None, "x", at, "before", 7)
    assert tuple(admin.settings_after_priming(rows(SETTINGS), nothing, F.lit(at)).first()) == (False, None, None, None, at, told.summary, 0)


def test_edits_of_the_system_mark_nothing(spark):
    row, edit = "table_name string, enabled boolean, interval_minutes int, timestamp_field string", ("a", True, -5, "nowhere")
    rows = spark.createDataFrame([("a", False, 5, None, None, "BUILDING")], row + ", owner_edited boolean, status string")
    times = spark.createDataFrame([], "table_name string, field_name string")
    edits = spark.createDataFrame([edit], row)
    assert tuple(admin.check_index_edits(edits, rows, times, system=True).first()) == ("a", None, False, "BUILDING")
    assert admin.check_index_edits(edits, rows, times).first().owner_edited is False
    fine = spark.createDataFrame([("a", True, 5, None)], row)
    assert tuple(admin.check_index_edits(fine, rows, times).first()) == ("a", None, True, "BUILDING")


def test_index_rows_come_from_priming_where_it_is_configured(spark):
    rows = spark.createDataFrame([("a", True, 1)], "table_name string, enabled boolean, other int")
    code = spark.createDataFrame([("a", True, 5, None), ("b", None, None, None), ("b", None, None, None)], "table_name string, enabled boolean, interval_minutes int, timestamp_field string")
    assert sorted((r.table_name, r.other, r.status) for r in admin.ensure_index_rows(rows, code).collect()) == [("a", 1, None), ("b", None, "ACTIVE")]
    assert admin.ensure_index_rows(rows, code, configured=True).count() == 1


def slow(spark, seconds=60):
    """Rows that take their time, on half of the cores."""
    return people(spark, [(i, f"N{i}", "x", 1) for i in range(8)]).coalesce(2).where(F.udf(lambda _: time.sleep(seconds) or True, "boolean")("id"))


def test_a_running_rebuild_gives_signs_of_life_and_is_stopped(spark, index, tmp_path):
    ledger, clock = processes.Ledger(spark, str(tmp_path / "runs")), [datetime.datetime(2024, 2, 1)]

    def now():
        clock[0] += datetime.timedelta(seconds=1)
        return clock[0]

    none = spark.createDataFrame([], "event_id long, table_name string, record_id string, status string")
    seen, other = [], spark.sparkContext.statusTracker()

    def cancel():
        while len(seen) < 2:  # while the table is written
            time.sleep(0.5)
            run = ledger.runs().first()
            if run and other.getActiveStageIds() and run.heartbeat not in seen:
                seen.append(run.heartbeat)
        ledger.cancel(ledger.runs().first().run_id, now())

    before, files = index.manifest(), sum(map(len, (f for _, _, f in os.walk(index.path + "/tables"))))
    thread = threading.Thread(target=cancel, daemon=True)
    thread.start()
    began = time.monotonic()
    with pytest.raises(processes.Cancelled):
        processes.rebuild(index, {"people": Source(PEOPLE, lambda: slow(spark))}, ledger, now, lambda: none, every=0.2)
    thread.join()
    assert time.monotonic() - began < 45 and len(set(seen)) == 2
    after = index.manifest()
    assert after["tables"] == before["tables"] and sum(map(len, (f for _, _, f in os.walk(index.path + "/tables")))) == files
    assert [r.status for r in ledger.runs().collect()] == ["CANCELLED"]
    assert processes.rebuild(index, {"people": Source(PEOPLE, lambda: people(spark, [(1, "Ada", "x", 1)]))}, ledger, now, lambda: none)[0].first().status == "COMPLETED"
    n = ledger.runs().count()
    ledger.compact()
    assert ledger.runs().count() == n and sum(f.endswith(".parquet") for f in os.listdir(ledger.path)) == 1 and not os.listdir(ledger.path + "_beats")


def test_a_watch_stops_its_own_jobs_only(spark):
    with Watch(spark, limit=60):
        assert spark.range(10).count() == 10
    results = []
    thread = threading.Thread(target=lambda: results.append(slow(spark, 0.5).count()))
    thread.start()
    with pytest.raises(Interrupted) as stopped:
        with Watch(spark, limit=0.5):
            slow(spark).count()
    thread.join()
    assert results == [8] and "0.5 seconds" in stopped.value.reason
    with pytest.raises(ValueError):  # errors of the block are its own
        with Watch(spark):
            raise ValueError


def test_documents_that_fail_are_kept_with_their_causes(spark, index, tmp_path):
    ledger, now = processes.Ledger(spark, str(tmp_path / "runs")), datetime.datetime(2024, 2, 1)
    rows = spark.createDataFrame([(1, "Good", "x", "2024-01-05"), (2, "Bad time", "x", "soon"), (3, "Big " * 999, "x", None), (None, "No key", "x", None), (4, "Fine", None, None)], "id int, name string, city string, changed string")
    due = spark.createDataFrame([("people", None, None)], "table_name string, timestamp_field string, last_pull timestamp")
    row = processes.pull_all(index, due, {"people": Source(PEOPLE, lambda: rows)}, ledger, now, max_bytes=2000).first()
    assert (row.status, row.processed, row.indexed, row.errors, row.first_error, row.last_pull) == ("COMPLETED", 4, 2, 2, "people:2: changed is no timestamp", None)
    assert {(r.record_id, r.cause) for r in ledger.rejected().collect()} == {("2", "changed is no timestamp"), ("3", "larger than 2000 bytes")}
    assert {"people:1", "people:4"} <= set(names(index)) and names(index)["people:1"] == "Good"
    none = spark.createDataFrame([], "event_id long, table_name string, record_id string, status string")
    run, _ = processes.rebuild(index, {"people": Source(PEOPLE, lambda: rows)}, ledger, lambda: now, lambda: none, max_bytes=2000)
    assert run.select("status", "processed", "indexed", "errors").first() == ("COMPLETED", 4, 2, 2)
    assert set(names(index)) == {"people:1", "people:4"} and ledger.rejected().count() == 4


def test_a_micro_batch_that_comes_again_adds_no_segment(spark, index):
    handler = ChangeHandler({"people": Source(PEOPLE, lambda: people(spark, [(1, "Changed", "x", 50)]))}, IndexPublisher(index), lambda failed: pytest.fail("nothing fails here"), stream="changes")
    batch = spark.createDataFrame([(1, "people", "1", "UPDATE"), (2, "people", "2", "DELETE")], "seq long, table_name string, record_id string, action string")
    handler(batch, 0)
    before = index.manifest()
    handler(batch, 0)
    assert index.manifest() == before and index.segments()["people"] == 2 and names(index) == {"people:1": "Changed", "places:1": "Stone house"}
    handler(batch, 1)
    assert index.segments()["people"] == 4


def test_a_rebuild_of_nothing(spark, index, tmp_path):
    ledger, now = processes.Ledger(spark, str(tmp_path / "runs")), datetime.datetime(2024, 2, 1)
    none = spark.createDataFrame([], "event_id long, table_name string, record_id string, status string")
    run, _ = processes.rebuild(index, {"people": Source(PEOPLE, lambda: people(spark, []))}, ledger, lambda: now, lambda: none)
    assert run.select("status", "processed", "indexed", "errors").first() == ("COMPLETED", 0, 0, 0) and names(index) == {}


def test_a_compaction_leaves_other_tables_alone(spark, index):
    before = index.manifest()["tables"]["places"]
    index.apply("people", one(spark, 3, "Stonewall", 1))
    index.compact(tables=["places"])
    assert index.segments() == {"people": 1, "places": 0}
    index.compact()
    assert index.segments()["people"] == 0 and index.manifest()["tables"]["places"] == before and same_as_a_scan(index, "stone") == [3]


def everything(index):
    return sorted((r.document_id, r.version, tuple(sorted(r.field_values.items()))) for r in index.documents().collect())


def test_merged_segments_say_what_they_said_apart(spark, index):
    """Older versions, deletes before and after writes, documents that come back, and writes without a version."""
    unversioned = one(spark, 2, "Unversioned", 0).withColumn("version", F.lit(None).cast("long"))
    batches = [
        (one(spark, 1, "Older", 5), None), (one(spark, 3, "Three", 7), None), (unversioned, None), (one(spark, 2, "Low", 1), None),
        (one(spark, 4, "Four", 3).union(one(spark, 5, "Five", 3)), ["people:5"]), (None, ["people:1", "people:99"]), (one(spark, 1, "Back", 2), None), (one(spark, 3, "Three of old", 6), ["people:4"]),
    ]
    states = []
    for writes, deleted in batches:
        index.apply("people", writes, None if deleted is None else spark.createDataFrame([(d,) for d in deleted], "document_id string"))
        states.append(everything(index))
    many = index.segments()["people"]
    merged = index.merge_segments("people")
    assert merged["tables"]["people"]["base"] and index.segments()["people"] < many and everything(index) == states[-1]
    assert dict((d, v) for d, v, _ in states[-1]) == {"people:1": 1704067202000, "people:2": 1704067201000, "people:3": 1704067207000, "places:1": None}
    assert same_as_a_scan(index, "three", "low", "back") == [1, 1, 1]
    index.apply("people", one(spark, 3, "Three again", 7))
    index.merge_segments("people")
    index.compact()
    assert index.segments()["people"] == 0 and [f["name"] for d, _, f in [(d, v, dict(f)) for d, v, f in everything(index)] if d == "people:3"] == ["Three again"]


def test_a_row_of_batches_leaves_few_segments(spark, index):
    written = 0
    for k in range(24):
        index.apply("people", one(spark, 100 + k, f"Batch{k}", 1))
        small = index.manifest()["tables"]["people"]["segments"][-1]["bytes"]
        after = index.merge_segments("people")["tables"]["people"]["segments"]
        written += small + (after[-1]["bytes"] if "first" in after[-1] else 0)
    assert index.segments()["people"] <= 9 and len(names(index)) == 27 and written < 4 * 24 * small


def test_nothing_is_merged_during_a_replacement(spark, index):
    draft = index.draft()
    draft.add("people", docs(spark, [(1, "Ada", "Bern", 10)]))
    for k in range(6):
        index.apply("people", one(spark, 10 + k, f"N{k}", 1))
    index.merge_segments("people")
    assert index.segments()["people"] == 6
    draft.finish()
    assert len(names(index)) == 7 and index.segments() == {"people": 6}
    index.merge_segments("people")
    assert len(names(index)) == 7 and index.segments()["people"] < 6


def test_added_fields_are_written_alone(spark, index):
    """Own-field clauses find the values of stored documents, of segments before and after, and of compacted ones."""
    index.apply("people", one(spark, 3, "Stone three", 20))
    index.apply("people", one(spark, 1, "Stella older", 1))  # skipped: the base's document counts
    grown = TableConfig("people", "id", (*PEOPLE.fields, FieldConfig("job", role=Role.KEYWORD, weight=2), FieldConfig("code", role=Role.EXACT)), timestamp="changed")
    config = EngineConfig(tables=(grown, PLACES))
    later = Index(spark, index.path, config)
    with pytest.raises(MappingChanged):
        later.search("mason")
    rows = people(spark, [(1, "Stella", "Bern", 10), (2, "Stone", "Bonn", 10), (3, "Stone three", "x", 20), (9, "Unknown", "x", 1)]).withColumns({"job": F.when(F.col("id") != 2, "stone mason"), "code": F.concat(F.lit("C"), "id")})
    before = index.manifest()["tables"]["people"]
    after = later.extend(build_documents(rows, grown), "people")["tables"]["people"]
    assert after["base"] == before["base"] and after["postings"][:1] == before["postings"] and len(after["postings"]) == 2
    assert not later.needs_rebuild() and later.extend(build_documents(rows, grown), "people")["tables"]["people"] == after

    def same(term):
        hits = {(r.document_id, r.score) for r in later.search(term).collect()}
        assert hits == {(r.document_id, r.score) for r in Q.score(later.documents(), Q.plan(term, list(config.tables)), list(config.tables)).collect()}
        return {d for d, _ in hits}

    def all_of():
        return same("mason"), same("c2"), same("stone")

    expected = ({"people:1", "people:3"}, {"people:2"}, {"people:1", "people:2", "people:3", "places:1"})
    assert all_of() == expected
    new = build_documents(rows.where("id = 9").withColumn("job", F.lit("mason")), grown).withColumn("seq", F.lit(0).cast("long"))
    later.apply("people", new)
    later.merge_segments("people")
    expected[0].add("people:9")
    assert all_of() == expected
    later.compact()
    assert all_of() == expected and later.manifest()["tables"]["people"].get("added") is None
    shown = EngineConfig(tables=(TableConfig("people", "id", (*grown.fields, FieldConfig("town")), timestamp="changed"), PLACES))
    with pytest.raises(MappingChanged):
        Index(spark, index.path, shown).extend(build_documents(rows.withColumn("town", F.lit("x")), shown.tables[0]), "people")


def test_bookkeeping_of_index_rows(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("a", "x", "old", True), ("b", None, None, None), ("c", "y", "kept", False)], "table_name string, last_run string, last_error string, owner_edited boolean")
    runs = spark.createDataFrame(
        [("a", "PULL", "FAILED", at(1), "E" * 5000), ("a", "PULL", "COMPLETED", at(2), None), ("b", "FULL", "CANCELLED", at(9), "stopped"), ("c", "PULL", "RUNNING", None, None), ("gone", "PULL", "FAILED", at(3), "x")],
        "table_name string, run_type string, status string, end_time timestamp, first_error string",
    )
    booked = lambda r: {tuple(x) for x in admin.update_index_rows(rows, processes.run_changes(r, rows)).collect()}
    assert booked(runs) == {("a", "PULL COMPLETED", None, True), ("b", "FULL CANCELLED", "stopped", None), ("c", "y", "kept", False)}
    assert {len(r.last_error) for r in processes.run_changes(runs, rows).where("last_error like 'E%'").collect()} == {4000}
    all_tables = runs.union(spark.createDataFrame([("*", "FULL", "COMPLETED", at(5), None)], runs.schema))
    assert {(t, r) for t, r, _, _ in booked(all_tables)} == {("a", "FULL COMPLETED"), ("b", "FULL CANCELLED"), ("c", "FULL COMPLETED")}
    assert booked(runs.limit(0)) == {tuple(r) for r in rows.collect()}


def test_validation_is_kept(spark, index, tmp_path):
    rows = people(spark, [(1, "Stella", "Bern", 10), (2, "Stone II", "Bonn", 10), (4, "Missing", "x", 1), (None, "No key", "x", 1)])
    sources = {"people": Source(PEOPLE, lambda: rows), "places": Source(PLACES, lambda: spark.createDataFrame([], "id int, name string"))}
    found = validate.validate(index, sources, sample=10)
    bad = {(r.table_name, r.kind, r.subject, r.level) for r in found.where("level <> 'OK'").collect()}
    assert bad == {("people", "count", "2 of 3", "WARN"), ("people", "record", "people:2: STALE", "FAIL"), ("people", "record", "people:4: MISSING", "FAIL"), ("places", "count", "1 of 0", "WARN"), ("places", "document", "places:1", "FAIL")}
    reports, at = validate.Reports(spark, str(tmp_path / "reports")), datetime.datetime(2024, 1, 1)
    first = reports.save(found, 10, at, at + datetime.timedelta(minutes=1), user="ann")
    row = reports.runs().first()
    assert (row.status, row.table_names, row.summary, row.user_name, row.report_id) == ("FAIL", "people,places", "FAIL: 2 table(s), 3 failed check(s), 2 warning(s).", "ann", first)
    assert reports.findings(first).count() == found.count()
    fine = {"people": Source(PEOPLE, lambda: people(spark, [(1, "Stella", "Bern", 10), (2, "Stone", "Bonn", 10)]))}
    reports.save(validate.validate(index, fine), 100, at, at + datetime.timedelta(minutes=2))
    assert {(r.table_name, r.level) for r in reports.newest().collect()} == {("people", "OK"), ("places", "FAIL")} and reports.runs().where("status = 'PASS'").count() == 1
    other = Index(spark, index.path, EngineConfig(tables=(TableConfig("people", "id", (FieldConfig("name", analyzer=Analyzer.WORD), FieldConfig("city")), timestamp="changed"), PLACES)))
    assert [r.subject for r in validate.validate(other, fine).where("kind = 'field'").collect()] == ["name"]
    assert [tuple(r) for r in validate.validate(Index(spark, str(tmp_path / "none"), CONFIG), fine).collect()] == [("people", "stored", None, "FAIL")]


def test_words_come_first_in_the_files_of_postings(spark, tmp_path):
    """Sorted once, by word and then path; a document without words has its row of lengths all the same."""
    import glob

    import pyarrow.parquet as pq

    rows = [(i, f"Zoe {'abc'[i % 3]}x of m{i} ab {'x ' * (i % 4)}", "Bern" if i % 2 else "an", i) for i in range(60)] + [(60, "?", "!", 1), (61, None, None, 1)]
    index = Index(spark, str(tmp_path / "words"), CONFIG)
    index.rebuild({"people": docs(spark, rows).coalesce(1)})
    folder = index.manifest()["tables"]["people"]["postings"][0]
    files = [pq.ParquetFile(f).read().to_pylist() for f in glob.glob(f"{folder}/words/*.parquet")]
    found = [(r["word"], r["path"]) for rows in files for r in rows]
    assert len(files) == 1 and found == sorted(found) and len({p for _, p in found}) == 3
    lengths = [r for f in glob.glob(f"{folder}/lengths/*.parquet") for r in pq.ParquetFile(f).read().to_pylist()]
    assert len(lengths) == 62 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    by = {r["document_id"]: {p["path"]: p["dl"] for p in r["lengths"]} for r in lengths}
    assert by["people:60"] == by["people:61"] == {} and by["people:3"] == {"searchable_text|PREFIX": 6, "name|PREFIX": 5, "city|PREFIX": 1}
    assert {r["tf"] for rows in files for r in rows if r["word"] == "ab"} == {1}


def test_a_base_has_row_groups_for_many_tasks(spark, index):
    import glob

    import pyarrow.parquet as pq

    texts = spark.range(0, 4000, 1, 1).select(F.col("id").alias("document_id"), F.concat(*[F.sha2((F.col("id") * 200 + i).cast("string"), 512) for i in range(100)]).alias("text"))
    path = index._write(texts, "people")
    found = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/*.parquet")]
    assert len(found) == 1 and found[0] > 1
