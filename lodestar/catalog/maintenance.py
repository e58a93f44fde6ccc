"""Queries of index maintenance."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import maintain as M
from ..operators.documents import build_documents
from ..plans.config import EngineConfig, FieldConfig, Role, TableConfig
from ..sources.index import Index
from .registry import NOW, load, query, scratch_folder

# A few named tables with the odd cases, and one for each customer; the same text for both engines.
INDEX_ROWS = f"""SELECT table_name, enabled, interval_minutes, CAST(last_pull AS TIMESTAMP) AS last_pull, CAST(last_build AS TIMESTAMP) AS last_build, status, document_count, last_run FROM (SELECT * FROM (VALUES
 ('part', true, 5, '2024-01-19 23:50:00', '2024-01-02 00:00:00', 'ACTIVE', 2000, 'PULL COMPLETE'),
 ('customer', true, 60, '2024-01-19 23:30:00', '2023-12-01 00:00:00', 'ACTIVE', 1500, 'FULL FAILED'),
 ('supplier', true, NULL, '2024-01-10 00:00:00', NULL, 'NEEDS_REINDEX', 100, NULL),
 ('orders', false, 5, NULL, NULL, 'ACTIVE', 0, NULL),
 ('events', true, 5, NULL, NULL, 'PENDING_BUILD', NULL, 'PULL COMPLETE'),
 ('documents', true, 5, '2024-01-19 23:59:00', '2024-01-05 00:00:00', 'REBUILDING', 0, 'PULL FAILED')
) AS v(table_name, enabled, interval_minutes, last_pull, last_build, status, document_count, last_run)
 UNION ALL SELECT 't' || c_custkey, c_custkey % 7 <> 0, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_custkey % 60 AS INTEGER) END, CASE c_custkey % 4 WHEN 0 THEN '2024-01-19 23:30:00' WHEN 1 THEN '2024-01-19 23:58:00' WHEN 2 THEN '2024-01-10 00:00:00' END,
 CASE c_custkey % 5 WHEN 0 THEN '2024-01-02 00:00:00' WHEN 1 THEN '2023-11-30 00:00:00' WHEN 2 THEN '2024-01-18 00:00:00' END, CASE c_custkey % 6 WHEN 0 THEN 'REBUILDING' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'NEEDS_REINDEX' WHEN 3 THEN 'PENDING_BUILD' ELSE 'ACTIVE' END,
 CASE WHEN c_custkey % 8 > 0 THEN CAST(c_custkey % 8 - 1 AS INTEGER) END, CASE c_custkey % 10 WHEN 0 THEN 'PULL FAILED' WHEN 1 THEN NULL ELSE 'PULL COMPLETE' END FROM customer) AS t"""

RUNS = """SELECT run_id, table_name, run_type, status, CAST(start_time AS TIMESTAMP) AS start_time, CAST(heartbeat AS TIMESTAMP) AS heartbeat FROM (SELECT * FROM (VALUES
 (1, 'documents', 'FULL', 'RUNNING', '2024-01-19 22:00:00', '2024-01-19 22:10:00'),
 (2, 'documents', 'FULL', 'RUNNING', '2024-01-19 21:00:00', NULL),
 (3, 'part', 'FULL', 'RUNNING', '2024-01-19 20:00:00', '2024-01-19 23:45:00'),
 (4, 'part', 'FULL', 'COMPLETE', '2024-01-18 20:00:00', '2024-01-18 23:45:00'),
 (5, 'customer', 'PULL', 'RUNNING', '2024-01-19 23:55:00', NULL)
) AS v(run_id, table_name, run_type, status, start_time, heartbeat)
 UNION ALL SELECT CAST(1000 + c_custkey AS INTEGER), 't' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'PULL' ELSE 'FULL' END, CASE c_custkey % 4 WHEN 0 THEN 'COMPLETE' ELSE 'RUNNING' END, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-19 23:40:00' ELSE '2024-01-08 22:00:00' END, CASE c_custkey % 7 WHEN 0 THEN '2024-01-19 23:45:00' WHEN 1 THEN '2024-01-19 22:10:00' END FROM customer
 UNION ALL SELECT CAST(1000000 + c_custkey AS INTEGER), 't' || c_custkey, 'FULL', 'RUNNING', '2024-01-19 21:00:00', CASE WHEN c_custkey % 12 = 0 THEN '2024-01-19 23:50:00' END FROM customer WHERE c_custkey % 6 = 0) AS t"""

#: Failed events made from the event stream: customers by user id, some beyond any customer.
EVENTS = """SELECT event_id, 'customer' AS table_name, CAST(user_id * 12 AS {s}) AS record_id, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INDEX' END AS action, CAST(event_id % 12 AS INTEGER) AS attempts,
 CASE WHEN event_id % 5 = 0 THEN 'EXHAUSTED' WHEN event_id % 7 = 0 THEN 'DEFERRED' WHEN event_id % 11 = 0 THEN 'AWAITING_REINDEX' ELSE 'PENDING' END AS status FROM events"""
EVENTS_SQL = EVENTS.format(s="VARCHAR")


def values(spark, sf_dir, sql: str):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(sql)


def events(spark, sf_dir):
    load(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(EVENTS.format(s="STRING"))


def customer_ids(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.lit("customer").alias("source_table"), F.col("c_custkey").cast("string").alias("record_id"))


def now():
    return F.lit(NOW).cast("timestamp")


def writes(spark, sf_dir):
    """Versioned writes: a document per user; 'signup' writes carry no version."""
    rows = load(spark, sf_dir, "events")
    version = F.when(F.col("event_type") != "signup", (F.col("value") * 100).cast("long"))
    return rows.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("document_id"), version.alias("version"), F.col("event_id").alias("seq"), "event_type")


_WRITES = "w AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS document_id, CASE WHEN event_type <> 'signup' THEN CAST(floor(value * 100) AS BIGINT) END AS version, event_id AS seq, event_type FROM events)"


@query(
    "versioned_upsert",
    f"""WITH {_WRITES}, s AS (SELECT *, max(CASE WHEN version IS NULL THEN seq END) OVER (PARTITION BY document_id) AS since FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC NULLS LAST, seq DESC) AS rk FROM s WHERE since IS NULL OR seq >= since)
SELECT document_id, version, seq, event_type FROM r WHERE rk = 1""",
)
def versioned_upsert(spark, sf_dir):
    return M.resolve_versions(writes(spark, sf_dir))


@query(
    "bulk_outcomes",
    f"""WITH {_WRITES}, a AS (SELECT document_id, max(version) AS version FROM w WHERE seq % 2 = 0 GROUP BY document_id), b AS (SELECT document_id, max(version) AS version FROM w WHERE seq % 2 = 1 GROUP BY document_id)
SELECT CASE WHEN b.version < a.version THEN 'skipped' ELSE 'indexed' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM b LEFT JOIN a ON a.document_id = b.document_id GROUP BY 1""",
)
def bulk_outcomes(spark, sf_dir):
    rows = writes(spark, sf_dir)
    half = lambda k: rows.where(F.col("seq") % 2 == k).groupBy("document_id").agg(F.max("version").alias("version"))
    return M.bulk_outcomes(half(0), half(1))


@query("first_wins_dedupe", "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) x WHERE rk = 1")
def first_wins_dedupe(spark, sf_dir):
    return M.first_wins(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("pull_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-30 23:55:00'")
def pull_filter(spark, sf_dir):
    import datetime

    return M.changed_since(load(spark, sf_dir, "orders"), "o_orderdate", datetime.datetime(2001, 7, 1)).select("o_orderkey")


@query("pull_due", f"SELECT table_name FROM ({INDEX_ROWS}) r WHERE enabled AND (last_pull IS NULL OR interval_minutes IS NULL OR last_pull + interval_minutes * INTERVAL 1 MINUTE < TIMESTAMP '{NOW}')")
def pull_due(spark, sf_dir):
    return M.pull_due(values(spark, sf_dir, INDEX_ROWS), now()).select("table_name")


@query("keyset_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return M.page_after(load(spark, sf_dir, "part"), "p_partkey", 100, 50).select("p_partkey", "p_name")


@query("edge_sample", "SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 13) a UNION SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 12) b")
def edge_sample(spark, sf_dir):
    return M.edges(load(spark, sf_dir, "part"), "p_partkey", 25).select("p_partkey")


@query("hash_sample", "SELECT p_partkey FROM part ORDER BY md5('0:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 50")
def hash_sample(spark, sf_dir):
    return M.hash_sample(load(spark, sf_dir, "part"), "p_partkey", 50).select("p_partkey")


@query("typed_ids", "SELECT DISTINCT TRY_CAST(r AS BIGINT) AS key FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'x' || CAST(event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS r FROM events) e WHERE TRY_CAST(r AS BIGINT) IS NOT NULL")
def typed_ids(spark, sf_dir):
    r = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return M.typed_ids(load(spark, sf_dir, "events").select(r.alias("record_id")), "long")


def label_documents(spark, sf_dir):
    """Documents as an index left over from ``labels``: record ids of rated documents, each indexed at a day of its id."""
    day = F.make_dt_interval((F.col("doc_id") % 40).cast("int"))
    at = F.when(F.col("doc_id") % 9 != 0, F.lit("2024-01-01").cast("timestamp") + day)
    table = F.when(F.col("doc_id") % 4 == 0, "retired").otherwise("documents")
    shifted = F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).cast("string")
    return load(spark, sf_dir, "labels").select(table.alias("source_table"), shifted.alias("record_id"), at.alias("indexed_at"), F.concat_ws(":", table, shifted).alias("document_id"))


_LABEL_DOCS = "d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'retired' ELSE 'documents' END AS source_table, CAST(CASE WHEN doc_id % 10 = 0 THEN doc_id + 1000000 ELSE doc_id END AS VARCHAR) AS record_id, CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id % 40 AS INTEGER) * INTERVAL 1 DAY END AS indexed_at FROM labels)"


@query("reconcile_stale", f"WITH {_LABEL_DOCS} SELECT source_table || ':' || record_id AS document_id FROM d WHERE source_table <> 'documents' OR (indexed_at IS NOT NULL AND indexed_at >= TIMESTAMP '{NOW}')")
def reconcile_stale(spark, sf_dir):
    return M.without_stale(label_documents(spark, sf_dir), "documents", now()).select("document_id")


@query("orphan_tables", f"WITH {_LABEL_DOCS} SELECT source_table, CAST(count(*) AS BIGINT) AS n FROM d WHERE source_table NOT IN (SELECT table_name FROM ({INDEX_ROWS}) r) GROUP BY source_table")
def orphan_tables(spark, sf_dir):
    return M.orphan_tables(label_documents(spark, sf_dir), values(spark, sf_dir, INDEX_ROWS)).groupBy("source_table").agg(F.count("*").alias("n"))


def document_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("record_id"))


@query("orphan_documents", f"WITH {_LABEL_DOCS} SELECT record_id FROM d WHERE source_table = 'documents' AND record_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)")
def orphan_documents(spark, sf_dir):
    mine = label_documents(spark, sf_dir).where("source_table = 'documents'")
    return M.orphan_documents(mine, document_ids(spark, sf_dir)).select("record_id")


@query("missing_documents", f"WITH {_LABEL_DOCS} SELECT CAST(doc_id AS VARCHAR) AS record_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT record_id FROM d WHERE source_table = 'documents')")
def missing_documents(spark, sf_dir):
    return M.missing_documents(document_ids(spark, sf_dir), label_documents(spark, sf_dir)).select("record_id")


@query(
    "reconcile_table",
    "SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS document_id, CASE WHEN p_partkey % 3 = 0 THEN 'old ' ELSE '' END || p_name AS searchable_text FROM part",
)
def reconcile_table(spark, sf_dir):
    """An index with newer documents for every third part and leftovers of parts that are gone, built anew."""
    table = TableConfig("part", "p_partkey", (FieldConfig("p_name"),))
    rebuilt = build_documents(load(spark, sf_dir, "part"), table, now=now()).withColumn("version", F.lit(1).cast("long"))
    stored = rebuilt.withColumns(
        {"version": F.when(F.col("record_id").cast("long") % 3 == 0, 2).otherwise(0).cast("long"), "searchable_text": F.concat(F.lit("old "), "searchable_text")}
    )
    gone = stored.withColumn("document_id", F.concat("document_id", F.lit("-gone")))
    return M.reconcile(stored.union(gone), rebuilt, "part").select("document_id", "searchable_text")


_THERE = "record_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)"


@query("replay_split", f"SELECT event_id, action, CASE WHEN action = 'DELETE' AND {_THERE} THEN 'none' WHEN action = 'INDEX' AND {_THERE} THEN 'index' ELSE 'delete' END AS step FROM ({EVENTS_SQL}) e WHERE status = 'PENDING'")
def replay_split(spark, sf_dir):
    return M.replay_split(events(spark, sf_dir), customer_ids(spark, sf_dir)).select("event_id", "action", "step")


@query("replay_attempts", f"SELECT event_id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 10 THEN 'EXHAUSTED' ELSE status END AS status FROM ({EVENTS_SQL}) e WHERE status = 'PENDING' AND event_id % 2 = 0")
def replay_attempts(spark, sf_dir):
    pending = events(spark, sf_dir).where("status = 'PENDING'")
    return M.replay_attempts(pending, pending.where("event_id % 2 = 0")).select("event_id", "attempts", "status")


@query("captured_delete_split", f"SELECT event_id, CASE WHEN {_THERE} THEN 'keep' ELSE 'delete' END AS step FROM ({EVENTS_SQL}) e WHERE status = 'AWAITING_REINDEX' AND event_id <= 5000")
def captured_delete_split(spark, sf_dir):
    return M.captured_delete_split(events(spark, sf_dir), customer_ids(spark, sf_dir), 5000).select("event_id", "step")


@query("captured_hand_over", f"SELECT status2 AS status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN status = 'AWAITING_REINDEX' AND event_id <= 5000 THEN 'PENDING' ELSE status END AS status2 FROM ({EVENTS_SQL}) e) x GROUP BY 1")
def captured_hand_over(spark, sf_dir):
    return M.hand_over_captured(events(spark, sf_dir), "customer", 5000).groupBy("status").agg(F.count("*").alias("n"))


@query("deferred_release", f"SELECT status2 AS status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN status = 'DEFERRED' THEN 'PENDING' ELSE status END AS status2 FROM ({EVENTS_SQL}) e) x GROUP BY 1")
def deferred_release(spark, sf_dir):
    return M.release_deferred(events(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("events_per_table", "SELECT event_type AS table_name, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def events_per_table(spark, sf_dir):
    return M.events_per_table(load(spark, sf_dir, "events").select(F.col("event_type").alias("table_name")))


_SEEN = "greatest(start_time, coalesce(heartbeat, start_time))"


@query("dead_run_liveness", f"SELECT table_name, bool_or({_SEEN} >= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE) AS alive, CAST(count(*) AS BIGINT) AS n FROM ({RUNS}) r WHERE status = 'RUNNING' AND run_type = 'FULL' GROUP BY table_name")
def dead_run_liveness(spark, sf_dir):
    return M.live_runs(values(spark, sf_dir, RUNS), now()).select("table_name", "alive", "n")


@query("earliest_start", f"SELECT table_name, CAST(epoch_ms(min(start_time)) AS BIGINT) AS earliest, CAST(epoch_ms(max({_SEEN})) AS BIGINT) AS seen FROM ({RUNS}) r WHERE status = 'RUNNING' AND run_type = 'FULL' GROUP BY table_name")
def earliest_start(spark, sf_dir):
    return M.live_runs(values(spark, sf_dir, RUNS), now()).select("table_name", F.unix_millis("earliest_start").alias("earliest"), F.unix_millis("last_seen").alias("seen"))


@query(
    "dead_run_recovery",
    f"""WITH d AS (SELECT table_name, min(start_time) AS begun FROM ({RUNS}) r WHERE status = 'RUNNING' AND run_type = 'FULL' GROUP BY table_name HAVING NOT bool_or(coalesce({_SEEN} >= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE, false)))
SELECT r.table_name, CASE WHEN status = 'REBUILDING' AND begun IS NOT NULL THEN 'ACTIVE' ELSE status END AS status, CAST(epoch_ms(CASE WHEN status = 'REBUILDING' AND begun IS NOT NULL THEN least(last_pull, begun) ELSE last_pull END) AS BIGINT) AS last_pull FROM ({INDEX_ROWS}) r LEFT JOIN d ON d.table_name = r.table_name""",
)
def dead_run_recovery(spark, sf_dir):
    return M.recover_dead(values(spark, sf_dir, INDEX_ROWS), M.live_runs(values(spark, sf_dir, RUNS), now())).select("table_name", "status", F.unix_millis("last_pull").alias("last_pull"))


@query("queue_builds", f"SELECT table_name FROM ({INDEX_ROWS}) r WHERE enabled AND status NOT IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING') AND (last_pull IS NOT NULL AND (last_build IS NULL OR last_build < TIMESTAMP '2024-01-01 00:00:00'))")
def queue_builds(spark, sf_dir):
    return M.queue_builds(values(spark, sf_dir, INDEX_ROWS), F.lit("2024-01-01 00:00:00").cast("timestamp"), False)


@query("queue_builds_empty_index", f"SELECT table_name FROM ({INDEX_ROWS}) r WHERE enabled AND status NOT IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING') AND ((last_pull IS NOT NULL AND (last_build IS NULL OR last_build < TIMESTAMP '2000-01-01 00:00:00')) OR coalesce(document_count, 0) > 0)")
def queue_builds_empty_index(spark, sf_dir):
    return M.queue_builds(values(spark, sf_dir, INDEX_ROWS), F.lit("2000-01-01 00:00:00").cast("timestamp"), True)


@query("run_purge", f"SELECT event_id FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 10 DAY ORDER BY ts LIMIT 500")
def run_purge(spark, sf_dir):
    return M.expired(load(spark, sf_dir, "events"), "ts", F.lit(NOW).cast("timestamp_ntz"), EngineConfig(retention_days=10, purge_limit=500)).select("event_id")


@query("reindex_chosen", "SELECT record_id, CASE WHEN TRY_CAST(record_id AS BIGINT) IS NULL THEN 'skip: invalid id' WHEN c_custkey IS NULL THEN 'delete' WHEN c_nationkey < 10 THEN 'write' ELSE 'skip: not readable' END AS step FROM (SELECT DISTINCT CASE WHEN event_id % 50 = 0 THEN 'n/a ' || CAST(event_id AS VARCHAR) ELSE CAST(user_id * 12 AS VARCHAR) END AS record_id FROM events) e LEFT JOIN customer ON c_custkey = TRY_CAST(record_id AS BIGINT)")
def reindex_chosen(spark, sf_dir):
    ids = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("n/a "), F.col("event_id").cast("string"))).otherwise((F.col("user_id") * 12).cast("string"))
    customers = load(spark, sf_dir, "customer")
    chosen = load(spark, sf_dir, "events").select(ids.alias("record_id"))
    key = F.col("c_custkey").cast("string").alias("record_id")
    return M.reindex_chosen(chosen, customers.select(key), customers.where("c_nationkey < 10").select(key))


# Processes over a stored index.


def _process(spark, *tables):
    """An empty index and a ledger in the shared folder."""
    from ..operators.processes import Ledger

    base = scratch_folder(spark)
    return Index(spark, f"{base}/index", EngineConfig(tables=tables)), Ledger(spark, f"{base}/runs")


def _at(minute: int = 0) -> datetime:
    return datetime.fromisoformat(NOW).replace(tzinfo=timezone.utc) + timedelta(minutes=minute)


SUPPLIERS = TableConfig("supplier", "s_suppkey", (FieldConfig("s_name"),))
NATIONS = TableConfig("nation", "n_nationkey", (FieldConfig("n_name"),))


@query(
    "pull_all_outcomes",
    f"SELECT table_name, status, CAST(n AS BIGINT) AS processed, CAST(n AS BIGINT) AS indexed, CAST(e AS BIGINT) AS errors, CAST(epoch_ms(p) AS BIGINT) AS last_pull FROM (SELECT 'broken' AS table_name, 'FAILED' AS status, 0 AS n, 1 AS e, TIMESTAMP '2024-01-19 00:00:00' AS p UNION ALL SELECT 'events', 'COMPLETED', (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 300 SECOND), 0, TIMESTAMP '{NOW}' UNION ALL SELECT 'nation', 'COMPLETED', (SELECT count(*) FROM nation), 0, TIMESTAMP '{NOW}') x",
)
def pull_all_outcomes(spark, sf_dir):
    """A first pull, one of what has changed, and one whose source fails and keeps its watermark."""
    from ..operators.processes import Source, pull_all

    table = TableConfig("events", "event_id", (FieldConfig("event_type"),), timestamp="ts")
    index, ledger = _process(spark, table, NATIONS)
    sources = {
        "events": Source(table, lambda: load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))),
        "nation": Source(NATIONS, lambda: load(spark, sf_dir, "nation")),
        "broken": Source(NATIONS, lambda: load(spark, sf_dir, "no_such_table")),
    }
    due = spark.sql("SELECT * FROM VALUES ('events', 'ts', timestamp'2024-01-10 00:00:00'), ('nation', null, null), ('broken', 'ts', timestamp'2024-01-19 00:00:00') AS t(table_name, timestamp_field, last_pull)")
    return pull_all(index, due, sources, ledger, _at()).select("table_name", "status", "processed", "indexed", "errors", F.unix_millis("last_pull").alias("last_pull"))


@query(
    "rebuild_runs",
    "SELECT * FROM (SELECT 'COMPLETED' AS status, (SELECT CAST(count(*) AS BIGINT) FROM supplier) + (SELECT CAST(count(*) AS BIGINT) FROM nation) AS processed, (SELECT CAST(count(*) AS BIGINT) FROM supplier) + (SELECT CAST(count(*) AS BIGINT) FROM nation) AS indexed, CAST(0 AS BIGINT) AS errors UNION ALL SELECT 'FAILED', 0, 0, 1 UNION ALL SELECT 'RUNNING', 0, 0, 0 UNION ALL SELECT 'CANCELLED', (SELECT CAST(count(*) AS BIGINT) FROM nation), 0, 0) x",
)
def rebuild_runs(spark, sf_dir):
    """A rebuild that a dead rival doesn't stop, one that is cancelled after its first table, and one that fails."""
    from ..operators.processes import Cancelled, Source, rebuild

    index, ledger = _process(spark, SUPPLIERS, NATIONS)
    none = spark.createDataFrame([], "event_id long, table_name string, record_id string, status string")
    sources = {"supplier": Source(SUPPLIERS, lambda: load(spark, sf_dir, "supplier")), "nation": Source(NATIONS, lambda: load(spark, sf_dir, "nation"))}
    ledger.start("*", "FULL", _at(-60))  # died an hour ago
    rebuild(index, sources, ledger, _at, lambda: none)

    def stopping():
        mine = ledger.runs().where("status = 'RUNNING'").orderBy(F.desc("start_time")).first()
        ledger.cancel(mine.run_id, _at())
        return load(spark, sf_dir, "nation")

    for broken in ({**sources, "nation": Source(NATIONS, stopping)}, {"nation": Source(NATIONS, lambda: load(spark, sf_dir, "no_such_table"))}):
        try:
            rebuild(index, broken, ledger, _at, lambda: none, every=3600)
        except (Cancelled, AnalysisException):
            pass
    return ledger.runs().select("status", "processed", "indexed", "errors")


_SUPPLIER_ID = "'supplier:' || CAST(s_suppkey AS VARCHAR)"
#: Suppliers after a batch that renames every third one and deletes every fifth.
_CHANGED_SQL = f"SELECT {_SUPPLIER_ID} AS document_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS record_label FROM supplier WHERE s_suppkey % 5 <> 0"


def _under_changes(spark, sf_dir):
    """An index of suppliers, and one in whose replacements a batch comes in between the writing and the commit."""
    titled = TableConfig("supplier", "s_suppkey", (FieldConfig("s_name", role=Role.TITLE),))
    index, _ = _process(spark, titled)
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    built = build_documents(rows, titled)
    index.rebuild({"supplier": built})

    class Busy(Index):
        def _postings(self, tables):
            path = super()._postings(tables)
            renamed = build_documents(rows.where("s_suppkey % 3 = 0").withColumn("s_name", F.concat(F.lit("new "), "s_name")), titled)
            index.apply("supplier", renamed.withColumn("seq", F.lit(0).cast("long")), built.where("cast(record_id as long) % 5 = 0"))
            return path

    return index, Busy(spark, index.path, index.config), built


@query("rebuild_under_changes", f"SELECT document_id, record_label, CAST(1 AS BIGINT) AS segments FROM ({_CHANGED_SQL}) x")
def rebuild_under_changes(spark, sf_dir):
    """A rebuild of all suppliers that ends while a batch is applied, which isn't lost."""
    index, busy, built = _under_changes(spark, sf_dir)
    busy.rebuild({"supplier": built})
    return index.documents().select("document_id", "record_label", F.lit(index.segments()["supplier"]).cast("long").alias("segments"))


@query("compact_under_changes", f"SELECT document_id, record_label, CAST(1 AS BIGINT) AS segments FROM (SELECT {_SUPPLIER_ID} AS document_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name WHEN s_suppkey % 2 = 0 THEN 'old ' || s_name ELSE s_name END AS record_label FROM supplier WHERE s_suppkey % 5 <> 0) x")
def compact_under_changes(spark, sf_dir):
    """A compaction of a segment that ends while another is added."""
    index, busy, built = _under_changes(spark, sf_dir)
    index.apply("supplier", built.where("cast(record_id as long) % 2 = 0").withColumns({"record_label": F.concat(F.lit("old "), "record_label"), "seq": F.lit(0).cast("long")}))
    busy.compact()
    return index.documents().select("document_id", "record_label", F.lit(index.segments()["supplier"]).cast("long").alias("segments"))


@query("rebuild_takeover", "SELECT 'second' AS owner, CAST(2 AS BIGINT) AS token, CAST(count(*) AS BIGINT) AS documents, 'taken over' AS first FROM customer")
def rebuild_takeover(spark, sf_dir):
    """A rebuild of all customers that was taken for dead and can't swap in what it has written, as another has taken its place."""
    from ..sources.index import TakenOver

    table = TableConfig("customer", "c_custkey", (FieldConfig("c_name"),))
    index, _ = _process(spark, table)
    built = build_documents(load(spark, sf_dir, "customer"), table)
    first, draft, told = index.acquire("*", "first", _at(-60)), index.draft(), "swapped"
    draft.add("customer", built.where("cast(record_id as long) % 2 = 0"))
    second = index.acquire("*", "second", _at())
    index.rebuild({"customer": built}, lease=second)
    try:
        draft.finish(lease=first)
    except TakenOver:
        draft.discard()
        told = "taken over"
    return index.documents().agg(F.lit(second.owner).alias("owner"), F.lit(second.token).cast("long").alias("token"), F.count("*").alias("documents"), F.lit(told).alias("first"))


@query(
    "mapping_differences",
    "SELECT 'part' AS table_name, * FROM (VALUES ('p_type', 'PREFIX in the snippet', 'WORD'), ('p_brand', 'PREFIX in the snippet', 'PREFIX in the snippet with label'), ('p_size', NULL, 'PREFIX in the snippet'), ('p_name', 'PREFIX in the snippet', NULL)) AS t(field_name, stored, configured), (SELECT CAST(count(*) AS BIGINT) AS documents FROM part) n",
)
def mapping_differences(spark, sf_dir):
    """A stored index of parts, opened with fields that are analyzed, placed or named in another way."""
    before = TableConfig("part", "p_partkey", (FieldConfig("p_name"), FieldConfig("p_type"), FieldConfig("p_brand", weight=3)))
    index, _ = _process(spark, before)
    index.rebuild({"part": build_documents(load(spark, sf_dir, "part"), before)})
    after = TableConfig("part", "p_partkey", (FieldConfig("p_type", role=Role.KEYWORD), FieldConfig("p_brand", include_label=True), FieldConfig("p_size")))
    return Index(spark, index.path, EngineConfig(tables=(after,))).mapping_differences().join(index.count().withColumnsRenamed({"source_table": "table_name", "count": "documents"}), "table_name")


@query(
    "mapping_extended",
    "SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS document_id, CAST(2 AS BIGINT) AS postings, CAST(0 AS BIGINT) AS differences FROM part WHERE list_contains(string_split(lower(p_brand), ' '), 'brand#13') OR list_contains(regexp_extract_all(lower(p_brand), '[a-z]+|[0-9]+'), '13')",
)
def mapping_extended(spark, sf_dir):
    """A stored index of all parts that takes in the brand as a field of its own; only the new field's postings are written, and a search finds stored parts by it."""
    before = TableConfig("part", "p_partkey", (FieldConfig("p_name"), FieldConfig("p_type")))
    after = TableConfig("part", "p_partkey", (*before.fields, FieldConfig("p_brand", role=Role.KEYWORD)))
    rows = load(spark, sf_dir, "part")
    index, _ = _process(spark, before)
    index.rebuild({"part": build_documents(rows, before)})
    index = Index(spark, index.path, EngineConfig(tables=(after,)))
    stored = index.extend(build_documents(rows, after), "part")["tables"]["part"]
    return index.search("13").select("document_id", F.lit(len(stored["postings"])).cast("long").alias("postings"), F.lit(index.mapping_differences().count()).cast("long").alias("differences"))


@query(
    "segments_merged",
    "WITH e AS (SELECT user_id, event_id, event_type, event_id % 12 AS batch FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, event_id DESC) AS k FROM e) SELECT 'user:' || CAST(user_id AS VARCHAR) AS document_id, event_type AS record_label, true AS fewer FROM r WHERE k = 1 AND NOT (batch < 11 AND user_id % 7 = 3)",
)
def segments_merged(spark, sf_dir):
    """All events as twelve batches of writes of their users, of which the last deletes some users that it doesn't write; merged as they come."""
    table = TableConfig("user", "user_id", (FieldConfig("event_type", role=Role.TITLE),))
    index, _ = _process(spark, table)
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    for k in range(12):
        batch = rows.where(F.col("event_id") % 12 == k)
        writes = build_documents(batch.withColumnRenamed("event_id", "seq"), table, carried=("seq",))
        deletes = build_documents(rows.where("user_id % 7 = 3").join(batch, "user_id", "left_anti"), table) if k == 11 else None
        index.apply("user", writes, deletes)
        index.merge_segments("user")
    return index.documents().select("document_id", "record_label", F.lit(index.segments()["user"] < 12).alias("fewer"))


@query(
    "index_row_bookkeeping",
    f"""WITH r AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'FULL' ELSE 'PULL' END || ' ' || CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS last_run, CASE WHEN event_type = 'error' THEN 'at ' || CAST(event_id AS VARCHAR) END AS last_error FROM events WHERE event_id % 4 <> 1),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, last_run DESC, last_error DESC NULLS LAST) AS k FROM r),
s AS (SELECT ts, last_run FROM (SELECT ts, 'FULL COMPLETED' AS last_run FROM events WHERE event_id % 400 = 1) x ORDER BY ts DESC LIMIT 1)
SELECT 't' || CAST(c_custkey AS VARCHAR) AS table_name, CASE WHEN s.ts > coalesce(a.ts, TIMESTAMP '1900-01-01') THEN s.last_run ELSE a.last_run END AS last_run, CASE WHEN s.ts > coalesce(a.ts, TIMESTAMP '1900-01-01') THEN NULL ELSE a.last_error END AS last_error, c_custkey % 2 = 0 AS owner_edited
FROM customer JOIN s ON true LEFT JOIN a ON a.user_id = c_custkey AND a.k = 1""",
)
def index_row_bookkeeping(spark, sf_dir):
    """Runs of many tables, of which some haven't ended and some are over all tables, as the events tell them, booked in a row for each customer's table."""
    from ..operators import admin
    from ..operators.processes import run_changes

    key, error = F.col("event_id"), F.col("event_type") == "error"
    every = key % 400 == 1
    runs = load(spark, sf_dir, "events").select(
        F.when(every, "*").otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("table_name"),
        F.when(every | (key % 3 == 0), "FULL").otherwise("PULL").alias("run_type"),
        F.when(every, "COMPLETED").when(key % 4 == 1, "RUNNING").when(error, "FAILED").otherwise("COMPLETED").alias("status"),
        F.col("ts").alias("end_time"),
        F.when(error & ~every, F.concat(F.lit("at "), key.cast("string"))).alias("first_error"),
    )
    number = F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(F.concat(F.lit("t"), number.cast("string")).alias("table_name"), F.lit(None).cast("string").alias("last_run"), F.lit(None).cast("string").alias("last_error"), (number % 2 == 0).alias("owner_edited"))
    return admin.update_index_rows(rows, run_changes(runs, rows))


@query(
    "validation_saved",
    """SELECT 'customer' AS table_name, CAST(1 + 1 + 100 + least(100, a.n) AS BIGINT) AS checks, CAST(0 AS BIGINT) AS warn_count, CAST(1 + e.n AS BIGINT) AS fail_count, 'FAIL' AS level
FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 5 <> 0) a, (SELECT count(*) AS n FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS low, row_number() OVER (ORDER BY c_custkey DESC) AS high FROM customer) x WHERE (low <= 50 OR high <= 50) AND c_custkey % 5 = 0) e
UNION ALL SELECT 'nation', CAST(2 + 2 * count(*) AS BIGINT), 0, 0, 'OK' FROM nation UNION ALL SELECT 'region', 1, 0, 1, 'FAIL'""",
)
def validation_saved(spark, sf_dir):
    """A stored index without every fifth customer and without regions, validated twice; the newest kept findings of each table."""
    from ..operators.processes import Source
    from ..operators.validate import Reports, validate

    customers, regions = TableConfig("customer", "c_custkey", (FieldConfig("c_name"),)), TableConfig("region", "r_regionkey", (FieldConfig("r_name"),))
    index, _ = _process(spark, customers, NATIONS, regions)
    read = lambda name: load(spark, sf_dir, name)
    index.rebuild({"customer": build_documents(read("customer").where("c_custkey % 5 <> 0"), customers), "nation": build_documents(read("nation"), NATIONS)})
    sources = {t.name: Source(t, lambda t=t: read(t.name)) for t in (customers, NATIONS, regions)}
    reports = Reports(spark, f"{scratch_folder(spark)}/reports")
    reports.save(validate(index, {"nation": sources["nation"]}), 100, _at(-9), _at(-8))
    reports.save(validate(index, sources), 100, _at(-2), _at(-1))
    return reports.newest().select("table_name", "checks", "warn_count", "fail_count", "level")


_BAD = "CASE WHEN event_id % 97 = 3 THEN 'ts is no timestamp' WHEN event_id % 89 = 5 THEN 'larger than 4096 bytes' END"


@query(
    "failed_documents",
    f"WITH e AS (SELECT {_BAD} AS cause, CAST(event_id AS VARCHAR) AS id FROM events) SELECT cause, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM e WHERE cause IS NOT NULL GROUP BY cause UNION ALL SELECT 'indexed', CAST(count(*) AS BIGINT), min(id) FROM e WHERE cause IS NULL UNION ALL SELECT 'counted', CAST(count(*) AS BIGINT), NULL FROM e WHERE cause IS NOT NULL",
)
def failed_documents(spark, sf_dir):
    """A pull of all events, of which some have no readable time and some are too large: the others are indexed, these are kept with their causes."""
    from ..operators.processes import Source, pull_all

    table = TableConfig("events", "event_id", (FieldConfig("event_type"),), timestamp="ts")
    index, ledger = _process(spark, table)
    key = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", F.when(key % 97 == 3, "soon").otherwise(F.col("ts").cast("string")).alias("ts"), F.when(key % 89 == 5, F.expr("repeat(event_type, 2000)")).otherwise(F.col("event_type")).alias("event_type"))
    due = spark.createDataFrame([("events", None, None)], "table_name string, timestamp_field string, last_pull timestamp")
    told = pull_all(index, due, {"events": Source(table, lambda: rows)}, ledger, _at(), max_bytes=4096)
    kept = ledger.rejected().groupBy("cause").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id"))
    indexed = index.documents().agg(F.lit("indexed").alias("cause"), F.count("*").alias("n"), F.min("record_id").alias("first_id"))
    return kept.union(indexed).union(told.select(F.lit("counted"), "errors", F.lit(None).cast("string")))


@query(
    "delete_drain",
    f"SELECT 'documents' AS what, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM ({EVENTS_SQL}) e WHERE status <> 'AWAITING_REINDEX' OR event_id > 5000",
)
def delete_drain(spark, sf_dir):
    """Customers rebuilt with documents of others left over, and the deletes captured meanwhile drained up to an event."""
    from ..operators.processes import drain_deletes

    table = TableConfig("customer", "c_custkey", (FieldConfig("c_name"),))
    index, _ = _process(spark, table)
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ids = rows.select(F.col("c_custkey").cast("string").alias("record_id"))
    captured = events(spark, sf_dir).where("status <> 'AWAITING_REINDEX' or event_id <= 5000")
    later = events(spark, sf_dir).where("status = 'AWAITING_REINDEX' and event_id > 5000")
    stale = captured.where("status = 'AWAITING_REINDEX'").select(F.col("record_id").cast("long").cast(rows.schema["c_custkey"].dataType).alias("c_custkey"), F.lit("gone").alias("c_name")).distinct()
    index.rebuild({"customer": build_documents(rows.union(stale.join(rows, "c_custkey", "left_anti")), table)})
    left = drain_deletes(index, captured, {"customer": ids})
    return index.documents().agg(F.lit("documents").alias("what"), F.count("*").alias("n")).union(left.union(later).agg(F.lit("events").alias("what"), F.count("*").alias("n")))


@query("stream_upsert", "SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS document_id, s_name AS record_label, s_name || ' ' || n_name AS searchable_text FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey IN (SELECT user_id FROM events)")
def stream_upsert(spark, sf_dir):
    """Changes of suppliers followed as a stream into a stored index: one document per changed supplier that exists."""
    from ..streaming.changes import ChangeHandler, IndexPublisher, Source, follow
    from .registry import SUPPLIER, labels

    base = scratch_folder(spark)
    changes = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.lit("supplier").alias("table_name"), F.col("user_id").cast("string").alias("record_id"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("action")
    )
    changes.write.parquet(f"{base}/changes")
    index = Index(spark, f"{base}/index", EngineConfig(tables=(SUPPLIER,)))
    handler = ChangeHandler({"supplier": Source(SUPPLIER, lambda: load(spark, sf_dir, "supplier"), labels(spark, sf_dir, "s_nationkey"))}, IndexPublisher(index), lambda failed: failed.write.mode("append").parquet(f"{base}/failed"))
    follow(spark.readStream.schema(changes.schema).parquet(f"{base}/changes"), handler, f"{base}/checkpoint", available_now=True).awaitTermination()
    return index.documents().select("document_id", "record_label", "searchable_text")


@query("stream_upsert_oracle", "SELECT CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_suppkey IN (SELECT user_id FROM events)")
def stream_upsert_oracle(spark, sf_dir):
    return stream_upsert(spark, sf_dir).agg(F.count("*").alias("n"))
