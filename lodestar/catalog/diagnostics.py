"""Queries of diagnostics: counts, differences, status, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnose as D
from ..operators import search
from .maintenance import EVENTS_SQL, INDEX_ROWS, events, values
from .registry import PART, documents_of, load, query

COUNTS = "SELECT event_type AS table_name, CAST(count(*) AS BIGINT) AS source_count, CAST(count(*) FILTER (WHERE event_id % {m} <> 0) AS BIGINT) AS index_count FROM events GROUP BY event_type"


@query("count_check", "SELECT table_name, source_count, index_count, CASE WHEN source_count = index_count THEN 'OK' WHEN source_count - index_count <= greatest(5, source_count // 100) THEN 'WARN' ELSE 'FAIL' END AS level FROM (SELECT o_orderpriority AS table_name, CAST(count(*) AS BIGINT) AS source_count, CAST(count(*) FILTER (WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0) AND NOT (o_orderpriority = '5-LOW' AND o_orderkey % 211 = 0)) AS BIGINT) AS index_count FROM orders GROUP BY o_orderpriority) x")
def count_check(spark, sf_dir):
    lost = ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 7 == 0)) | ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 211 == 0))
    counts = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("table_name")).agg(F.count("*").alias("source_count"), F.count_if(~lost).alias("index_count"))
    return D.count_check(counts)


@query("validation_overall", "SELECT 'FAIL' AS overall, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n FROM orders")
def validation_overall(spark, sf_dir):
    return D.overall(count_check(spark, sf_dir))


def expected_and_indexed(spark, sf_dir):
    """Documents of parts, and an index in which every 50th name is old, every 70th document is missing, and some are left over."""
    expected = documents_of(spark, sf_dir, PART)
    key = F.col("record_id").cast("long")
    old = F.when(key % 50 == 0, F.concat(F.lit("old "), "record_label")).otherwise(F.col("record_label"))
    indexed = expected.withColumn("record_label", old).where(key % 70 != 3)
    extra = indexed.where(key % 90 == 1).withColumn("document_id", F.concat("document_id", F.lit("x")))
    return expected, indexed.union(extra)


_K = "part:' || CAST(p_partkey AS VARCHAR)"
_PARTS = "(SELECT unnest(['(label)', '(text)', 'p_name', 'p_type', 'p_brand']) AS part) q"


@query("doc_diff", f"SELECT '{_K} AS document_id, '(label)' AS part, 'changed' AS difference FROM part WHERE p_partkey % 50 = 0 AND p_partkey % 70 <> 3 UNION ALL SELECT '{_K}, part, 'missing' FROM part, {_PARTS} WHERE p_partkey % 70 = 3 UNION ALL SELECT '{_K} || 'x', part, 'extra' FROM part, {_PARTS} WHERE p_partkey % 90 = 1 AND p_partkey % 70 <> 3")
def doc_diff(spark, sf_dir):
    return D.document_diff(*expected_and_indexed(spark, sf_dir))


@query(
    "inspect_verdicts",
    f"SELECT '{_K} AS document_id, CASE WHEN p_partkey % 70 = 3 THEN 'MISSING' WHEN p_partkey % 50 = 0 THEN 'STALE' ELSE 'CURRENT' END AS verdict FROM part UNION ALL SELECT '{_K} || 'x', CASE WHEN p_partkey % 90 = 1 AND p_partkey % 70 <> 3 THEN 'NO_RECORD' ELSE 'NOT_INDEXED' END FROM part",
)
def inspect_verdicts(spark, sf_dir):
    expected, indexed = expected_and_indexed(spark, sf_dir)
    ids = expected.select("document_id")
    return D.verdicts(ids.union(ids.select(F.concat("document_id", F.lit("x")))), expected, indexed)


_BACKLOG = f"SELECT CAST(count(*) FILTER (WHERE status = 'PENDING') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE status = 'EXHAUSTED') AS BIGINT) AS exhausted, count(*) > 1000 AS truncated FROM (SELECT * FROM ({EVENTS_SQL}) e WHERE status IN ('PENDING', 'EXHAUSTED') ORDER BY event_id LIMIT 1001) x"


@query("backlog_counts", _BACKLOG)
def backlog_counts(spark, sf_dir):
    return D.backlog(events(spark, sf_dir))


@query("status_rollup", f"SELECT CAST(count(*) AS BIGINT) AS tables, CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE status IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING')) AS BIGINT) AS building, bool_or(status = 'NEEDS_REINDEX' OR coalesce(last_run LIKE '%FAILED', false)) AS degraded, CAST(epoch_ms(max(greatest(last_pull, last_build))) AS BIGINT) AS latest FROM (SELECT * FROM ({INDEX_ROWS}) i ORDER BY table_name LIMIT 100) r")
def status_rollup(spark, sf_dir):
    return D.status_rollup(values(spark, sf_dir, INDEX_ROWS)).withColumn("latest", F.unix_millis("latest"))


@query("health_levels", f"SELECT table_name, CASE WHEN NOT enabled THEN 'DISABLED' WHEN status IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING') THEN 'BUILDING' WHEN status = 'NEEDS_REINDEX' THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM ({INDEX_ROWS}) r")
def health_levels(spark, sf_dir):
    return D.table_health(values(spark, sf_dir, INDEX_ROWS))


@query("backlog_health", f"SELECT false AS paused, pending, exhausted, CASE WHEN pending > 100 OR exhausted > 0 OR truncated THEN 'DEGRADED' ELSE 'HEALTHY' END AS health FROM ({_BACKLOG}) b")
def backlog_health(spark, sf_dir):
    return D.backlog_health(spark.range(1).select(F.lit(False).alias("paused")), D.backlog(events(spark, sf_dir)))


@query("home_text", f"SELECT 'Building ' || count(*) || ' table(s).' AS text FROM ({INDEX_ROWS}) r WHERE status IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING')")
def home_text(spark, sf_dir):
    return D.home_text(spark.range(1).select(F.lit(False).alias("paused")), values(spark, sf_dir, INDEX_ROWS))


PATHS = "SELECT * FROM (VALUES ('part', true, true, false, true, false, 2), ('customer', true, false, false, true, false, 1), ('supplier', true, true, true, true, false, 0), ('orders', false, false, false, true, false, 3), ('events', true, true, false, false, false, 1), ('documents', true, true, false, true, true, 1)) AS t(table_name, configured, enabled, key_protected, readable, in_backoff, host_fields) UNION ALL SELECT 't' || c_custkey, c_custkey % 2 = 0, c_custkey % 3 > 0, c_custkey % 5 = 0, c_custkey % 7 > 0, c_custkey % 11 = 0, CAST(c_custkey % 4 AS INTEGER) FROM customer"


_WHY_NOT = "CASE WHEN NOT readable THEN 'not readable' WHEN NOT configured THEN 'not indexed' WHEN key_protected THEN 'key is protected' WHEN NOT enabled THEN 'disabled' WHEN in_backoff THEN 'search failed a moment ago' END"


@query("path_diagnosis", f"SELECT table_name, CASE WHEN {_WHY_NOT} IS NULL THEN 'index' WHEN readable AND host_fields > 0 THEN 'host' ELSE 'none' END AS searched_by, coalesce({_WHY_NOT}, 'indexed') AS reason FROM ({PATHS}) p")
def path_diagnosis(spark, sf_dir):
    return search.path_diagnosis(values(spark, sf_dir, PATHS))


@query("documents_per_table", "SELECT 'part' AS source_table, CAST(count(*) AS BIGINT) AS n FROM part UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT) FROM customer UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT) FROM supplier")
def documents_per_table(spark, sf_dir):
    from .registry import CUSTOMER, SUPPLIER

    return documents_of(spark, sf_dir, PART, CUSTOMER, SUPPLIER).groupBy("source_table").agg(F.count("*").alias("n"))


@query(
    "validation_sample",
    f"WITH s AS (SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 40) a UNION SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 40) b) SELECT '{_K} AS document_id, CASE WHEN p_partkey % 70 = 3 OR p_partkey % 50 = 0 THEN 'FAIL' ELSE 'OK' END AS level, CASE WHEN p_partkey % 70 = 3 THEN 'MISSING' WHEN p_partkey % 50 = 0 THEN 'STALE' ELSE 'CURRENT' END AS verdict FROM s",
)
def validation_sample(spark, sf_dir):
    """The lowest and the highest records, built again and compared with the index."""
    from ..operators import maintain
    from ..operators.documents import build_documents

    _, indexed = expected_and_indexed(spark, sf_dir)
    sample = maintain.edges(load(spark, sf_dir, "part"), "p_partkey", 80)
    return D.sample_check(build_documents(sample, PART), indexed)


@query("validation_orphans", f"SELECT '{_K} || CASE WHEN x = 1 THEN 'x' ELSE '' END AS document_id, CASE WHEN x = 1 THEN 'FAIL' ELSE 'OK' END AS level FROM part, (SELECT unnest([0, 1]) AS x) q WHERE p_partkey % 70 <> 3 AND (x = 0 OR p_partkey % 90 = 1)")
def validation_orphans(spark, sf_dir):
    expected, indexed = expected_and_indexed(spark, sf_dir)
    kept = indexed.withColumn("record_id", F.regexp_extract("document_id", ":(.*)$", 1))
    return D.orphan_check(kept, expected)


@query("latest_per_kind", "SELECT event_type, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) x WHERE rk = 1")
def latest_per_kind(spark, sf_dir):
    found = D.latest(load(spark, sf_dir, "events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"])
    return found.select("event_type", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
