"""Queries of configuration: priming, effective fields, rules, edits.

Their tables are a few named ones, which hold the odd cases, and one for each customer, whose settings follow from its key;
the same text is read by both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin as A
from ..operators import maintain as M
from ..plans import rules as R
from .registry import NOW, load, query

CODE_TABLES = """SELECT * FROM (VALUES ('part', true, 5, CAST(NULL AS {s})), ('customer', true, 10, 'modify_date'), ('supplier', false, 5, NULL), ('orders', true, 5, 'o_orderdate'), ('secret_tokens', true, 5, NULL))
 AS t(table_name, enabled, interval_minutes, timestamp_field)
 UNION ALL SELECT 't' || c_custkey, c_custkey % 4 <> 0, CAST(c_custkey % 7 AS INTEGER), CASE WHEN c_custkey % 3 = 0 THEN 'changed' END FROM customer"""
CODE_FIELDS = """SELECT * FROM (VALUES ('part', 'p_name', 3, false, 0), ('part', 'p_type', 1, false, 1), ('part', 'p_brand', 2, true, 2), ('customer', 'c_name', 3, false, 0), ('customer', 'c_acctbal', 1, false, 1), ('customer', 'c_mktsegment', 1, false, 2),
 ('supplier', 's_name', 3, false, 0), ('orders', 'o_orderpriority', 1, false, 0)) AS t(table_name, field_name, weight, include_label, position)
 UNION ALL SELECT 't' || c_custkey, 'name', CAST(c_custkey % 3 AS INTEGER), false, 0 FROM customer UNION ALL SELECT 't' || c_custkey, 'note', 1, c_custkey % 2 = 0, 1 FROM customer"""
CONFIG_ROWS = """SELECT * FROM (VALUES ('part', true, 15, CAST(NULL AS {s}), false, 'ACTIVE'), ('customer', true, 5, 'other_date', true, 'ACTIVE'), ('orders', true, 5, 'o_orderdate', false, 'ACTIVE'), ('documents', true, 5, NULL, false, 'PENDING_BUILD'))
 AS t(table_name, enabled, interval_minutes, timestamp_field, owner_edited, status)
 UNION ALL SELECT 't' || c_custkey, c_custkey % 5 <> 0, CAST(c_custkey % 6 AS INTEGER), CASE WHEN c_custkey % 6 = 0 THEN 'changed' END, c_custkey % 11 = 0, CASE c_custkey % 8 WHEN 0 THEN 'BUILDING' WHEN 2 THEN 'NEEDS_REINDEX' ELSE 'ACTIVE' END FROM customer WHERE c_custkey % 2 = 0"""
FIELD_ROWS = """SELECT * FROM (VALUES (1, 'part', 'p_name', 3, 'TITLE', CAST(NULL AS {s}), CAST(NULL AS BOOLEAN), false, 20, false), (2, 'part', 'p_type', 4, 'BODY', NULL, NULL, false, 10, true), (3, 'part', 'p_size', NULL, 'KEYWORD', 'WORD', NULL, false, NULL, false),
 (4, 'part', 'p_name', 9, 'BODY', NULL, NULL, false, 30, false), (5, 'customer', 'c_name', 2, 'BODY', 'NONSENSE', true, false, 10, false), (6, 'customer', 'c_phone', 1, 'EXACT', NULL, NULL, true, 20, false), (7, 'customer', 'c_mktsegment', 1, 'odd', NULL, NULL, NULL, 30, false))
 AS t(row_id, table_name, field_name, weight, role, analyzer, in_snippet, include_label, sort_order, owner_edited)
 UNION ALL SELECT CAST(1000 + c_custkey AS INTEGER), 't' || c_custkey, 'name', CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 5 AS INTEGER) END, CASE c_custkey % 3 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'other' ELSE 'BODY' END, CASE c_custkey % 7 WHEN 0 THEN 'WORD' WHEN 1 THEN 'none' END, c_custkey % 4 = 0, c_custkey % 9 = 0, CAST(c_custkey % 40 AS INTEGER), c_custkey % 13 = 0 FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT CAST(1000000 + c_custkey AS INTEGER), 't' || c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'name' ELSE 'note' END, 2, 'BODY', NULL, NULL, NULL, CASE WHEN c_custkey % 3 > 0 THEN 15 END, false FROM customer WHERE c_custkey % 10 = 0"""
TOMBSTONES = """SELECT * FROM (VALUES ('supplier', CAST(NULL AS {s})), ('part', 'p_brand')) AS t(table_name, field_name) UNION ALL SELECT 't' || c_custkey, NULL FROM customer WHERE c_custkey % 29 = 0 UNION ALL SELECT 't' || c_custkey, 'note' FROM customer WHERE c_custkey % 31 = 0"""
FIELDS = """SELECT table_name, field_name, label, type, ordinal, is_label_field, is_key, is_hidden, is_sensitive, is_personal, is_locked FROM (VALUES
 ('part', 'p_partkey', 'Id', 'INTEGER', 1, false, true, false, false, false, false), ('part', 'p_name', 'Name', 'STRING', 2, true, false, false, false, false, false), ('part', 'p_type', 'Type', 'STRING', 3, false, false, false, false, false, false),
 ('part', 'p_brand', 'Brand', 'STRING', 4, false, false, false, false, false, false), ('part', 'p_size', 'Size', 'INTEGER', 5, false, false, NULL, false, false, false), ('part', 'updated_at', 'Updated', 'DATE_TIME', 6, false, false, false, false, false, false),
 ('customer', 'c_custkey', 'Id', 'INTEGER', 1, false, true, false, false, false, false), ('customer', 'c_name', 'Name', 'STRING', 2, true, false, false, false, false, false), ('customer', 'c_acctbal', 'Balance', 'DECIMAL', 3, false, false, false, true, false, false),
 ('customer', 'c_phone', 'Phone', 'STRING', 4, false, false, false, false, true, false), ('customer', 'c_mktsegment', 'Segment', 'STRING', 5, false, false, false, false, false, false), ('customer', 'password', 'Password', 'PASSWORD', 6, false, false, false, false, false, false),
 ('customer', 'photo', 'Photo', 'BLOB', 7, false, false, false, false, false, false), ('customer', 'active', 'Active', 'BOOLEAN', 8, false, false, false, false, false, false), ('customer', 'notes', 'Notes', 'HTML', 9, false, false, true, false, false, false),
 ('customer', 'modified', 'Modified', 'DATE_TIME', 10, false, false, false, false, false, false), ('customer', 'modify_date', 'Modify date', 'DATE_TIME', 11, false, false, false, false, false, false),
 ('account', 'a_key', 'Key', 'STRING', 1, false, true, false, false, true, false), ('account', 'a_name', 'Name', 'TEXT', 2, true, false, false, false, false, false), ('orders', 'o_orderdate', 'Date', 'DATE_TIME', 1, false, false, false, false, false, false),
 ('orders', 'untyped', 'Untyped', NULL, 2, false, false, false, false, false, false), ('blobs', 'b', 'B', 'BLOB', 1, false, false, false, false, false, false)
 ) AS t(table_name, field_name, label, type, ordinal, is_label_field, is_key, is_hidden, is_sensitive, is_personal, is_locked)
 UNION ALL SELECT 't' || c_custkey, 'name', 'Name', 'STRING', 1, true, false, false, c_custkey % 17 = 0, false, false FROM customer
 UNION ALL SELECT 't' || c_custkey, 'note', 'Note', CASE c_custkey % 6 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'BLOB' WHEN 3 THEN 'PASSWORD' WHEN 4 THEN 'HTML' WHEN 5 THEN 'DECIMAL' END, 2, false, c_custkey % 4 = 1, c_custkey % 8 = 0, false, c_custkey % 5 = 0, c_custkey % 19 = 0 FROM customer
 UNION ALL SELECT 't' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'modify_date' WHEN 1 THEN 'updated' ELSE 'created' END, 'Time', 'DATE_TIME', 3, false, false, NULL, false, false, false FROM customer"""
META_TABLES = """SELECT table_name, label, is_hidden, is_internal, has_variants, can_query, can_read FROM (VALUES ('part', 'Part', false, false, false, true, true), ('customer', 'customer', false, false, false, true, true), ('account', 'Account', NULL, false, false, true, false),
 ('orders', 'Orders', false, false, false, true, true), ('blobs', 'Blobs', false, false, false, true, true), ('search_index', 'Index', false, false, false, true, true), ('api_keys_secret', 'Keys', false, false, false, true, true), ('audit', 'Audit', true, false, false, true, true),
 ('user_session', 'Sessions', false, false, false, true, true), ('oauth_client', 'Clients', false, false, false, true, true), ('PRIVATEKEY', 'Keys', false, false, false, true, true), ('etc_passwd', 'Users', false, false, false, true, true),
 ('my_apikey', 'Keys', false, false, false, true, true), ('saved_view', 'Views', false, false, false, true, true), ('Script_Log_Line', 'Lines', false, false, false, true, true), ('tableTrigger', 'Triggers', false, false, false, true, true), ('audition', 'Auditions', false, false, false, true, true),
 ('host_jobs', 'Jobs', false, false, false, true, true), ('log', 'Log', false, true, false, true, true), ('variants', 'Variants', false, false, true, true, true), ('unread', 'Unread', false, false, false, false, true)) AS t(table_name, label, is_hidden, is_internal, has_variants, can_query, can_read)
 UNION ALL SELECT 't' || c_custkey, c_name, c_custkey % 21 = 0, c_custkey % 22 = 0, c_custkey % 23 = 0, c_custkey % 24 <> 0, c_custkey % 25 <> 0 FROM customer"""

V, S = {"s": "VARCHAR"}, {"s": "STRING"}
_REASON = """CASE WHEN coalesce(is_hidden, false) THEN 'hidden' WHEN is_personal OR is_locked THEN 'classified' WHEN is_sensitive THEN 'sensitive' WHEN type IS NULL THEN 'no type' WHEN type = 'PASSWORD' THEN 'masked type' WHEN type IN ('BOOLEAN', 'BLOB') THEN 'type not searchable' END"""
_OK = f"ok AS (SELECT *, {_REASON} AS reason FROM ({FIELDS}) f), u AS (SELECT * FROM ok WHERE reason IS NULL)"


def sql(spark, sf_dir, text: str):
    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(text.format(**S))


def indexable(spark, sf_dir):
    return R.indexable_fields(sql(spark, sf_dir, FIELDS)).select("table_name", "field_name")


@query("indexable_reasons", f"SELECT table_name, field_name, {_REASON} AS reason FROM ({FIELDS}) f")
def indexable_reasons(spark, sf_dir):
    return sql(spark, sf_dir, FIELDS).select("table_name", "field_name", R.why_not_indexable().alias("reason"))


@query("table_protection", f"SELECT table_name, bool_or(is_personal OR is_locked OR is_sensitive OR coalesce(type = 'PASSWORD', false)) AS filtered, bool_or((is_personal OR is_locked OR is_sensitive OR coalesce(type = 'PASSWORD', false)) AND is_key) AS protected_key FROM ({FIELDS}) f GROUP BY table_name")
def table_protection(spark, sf_dir):
    return R.protection(sql(spark, sf_dir, FIELDS))


@query(
    "default_fields",
    f"""WITH {_OK}, r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY is_label_field DESC, ordinal, field_name) AS rk FROM u WHERE is_label_field OR type IN ('STRING', 'TEXT', 'HTML'))
SELECT table_name, field_name, CASE WHEN is_label_field THEN 'TITLE' ELSE 'BODY' END AS role, CASE WHEN is_label_field THEN 3 ELSE 1 END AS weight, CAST(rk * 10 AS INTEGER) AS sort_order FROM r WHERE rk <= 20""",
)
def default_fields(spark, sf_dir):
    return R.default_fields(sql(spark, sf_dir, FIELDS))


@query("default_timestamps", f"SELECT table_name, field_name AS timestamp_field FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY CASE WHEN field_name = 'modify_date' THEN 0 ELSE 1 END, ordinal) AS rk FROM ({FIELDS}) f WHERE type = 'DATE_TIME' AND (contains(field_name, 'modif') OR contains(field_name, 'updat'))) x WHERE rk = 1")
def default_timestamps(spark, sf_dir):
    return R.default_timestamps(sql(spark, sf_dir, FIELDS))


_ELIGIBLE = f"""WITH {_OK}, e AS (SELECT t.table_name, label, coalesce(can_read, false) AS can_read, CASE WHEN is_internal THEN 'internal' WHEN table_name = 'search_index' THEN 'part of the search engine'
 WHEN table_name IN ('audit', 'saved_view', 'Script_Log_Line', 'tableTrigger', 'host_jobs') THEN 'system table' WHEN table_name IN ('api_keys_secret', 'user_session', 'oauth_client', 'PRIVATEKEY', 'etc_passwd', 'my_apikey') THEN 'may hold secrets'
 WHEN coalesce(is_hidden, false) THEN 'hidden' WHEN has_variants THEN 'has variants' WHEN NOT can_query THEN 'can''t be queried' WHEN table_name NOT IN (SELECT table_name FROM u) THEN 'no indexable field' END AS reason FROM ({META_TABLES}) t)"""


@query("table_eligibility", _ELIGIBLE + " SELECT table_name, reason FROM e")
def table_eligibility(spark, sf_dir):
    return R.eligibility(sql(spark, sf_dir, META_TABLES), sql(spark, sf_dir, FIELDS), ["HostJobs"]).select("table_name", "reason")


@query("eligible_tables", _ELIGIBLE + " SELECT table_name, label FROM e WHERE reason IS NULL AND can_read AND table_name <> 'customer'")
def eligible_tables(spark, sf_dir):
    indexed = spark.createDataFrame([("customer",)], "table_name string")
    return R.eligible_tables(sql(spark, sf_dir, META_TABLES), sql(spark, sf_dir, FIELDS), indexed, ["HostJobs"])


_DIFFERS = "(c.interval_minutes IS DISTINCT FROM r.interval_minutes OR c.timestamp_field IS DISTINCT FROM r.timestamp_field)"
_GONE = f"(SELECT table_name FROM ({TOMBSTONES.format(**V)}) z WHERE field_name IS NULL)"
_BURIED = f"EXISTS (SELECT 1 FROM ({TOMBSTONES.format(**V)}) z WHERE z.table_name = c.table_name AND z.field_name = c.field_name)"
_STEP = f"CASE WHEN c.table_name IN {_GONE} THEN 'skip' WHEN r.table_name IS NULL THEN 'insert' WHEN {_DIFFERS} AND NOT r.owner_edited THEN 'update' ELSE 'keep' END"


@query("prime_plan", f"SELECT c.table_name, {_STEP} AS step, CASE WHEN {_STEP} = 'insert' THEN CASE WHEN c.enabled THEN 'PENDING_BUILD' ELSE 'ACTIVE' END END AS new_status FROM ({CODE_TABLES.format(**V)}) c LEFT JOIN ({CONFIG_ROWS.format(**V)}) r ON r.table_name = c.table_name")
def prime_plan(spark, sf_dir):
    return A.prime_tables(sql(spark, sf_dir, CODE_TABLES), sql(spark, sf_dir, CONFIG_ROWS), sql(spark, sf_dir, TOMBSTONES))


_LIVE = f"live AS (SELECT c.* FROM ({CODE_FIELDS}) c JOIN u ON u.table_name = c.table_name AND u.field_name = c.field_name WHERE c.table_name NOT IN {_GONE} AND NOT {_BURIED})"
_FIELD_STEP = f"""WITH {_OK}, {_LIVE}, fr AS (SELECT * FROM ({FIELD_ROWS.format(**V)}) f WHERE row_id <> 4 AND row_id < 1000000),
p AS (SELECT l.table_name, l.field_name, CASE WHEN f.row_id IS NULL THEN 'insert' WHEN (l.weight IS DISTINCT FROM f.weight OR l.include_label IS DISTINCT FROM f.include_label) AND NOT f.owner_edited THEN 'update' ELSE 'keep' END AS step, CASE WHEN f.row_id IS NULL THEN (l.position + 1) * 10 END AS sort_order
 FROM live l LEFT JOIN fr f ON f.table_name = l.table_name AND f.field_name = l.field_name)"""


def primed(spark, sf_dir):
    _, fields = A.live_code(sql(spark, sf_dir, CODE_TABLES), sql(spark, sf_dir, CODE_FIELDS), sql(spark, sf_dir, TOMBSTONES), indexable(spark, sf_dir))
    return A.prime_fields(fields, sql(spark, sf_dir, FIELD_ROWS).where("row_id <> 4 and row_id < 1000000"))


@query("prime_fields", _FIELD_STEP + " SELECT table_name, field_name, step, CAST(sort_order AS INTEGER) AS sort_order FROM p")
def prime_fields(spark, sf_dir):
    return primed(spark, sf_dir)


@query("prime_rebuilds", _FIELD_STEP + f" SELECT table_name FROM ({CONFIG_ROWS.format(**V)}) r WHERE enabled AND status NOT IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING') AND table_name IN (SELECT table_name FROM p WHERE step <> 'keep')")
def prime_rebuilds(spark, sf_dir):
    return A.rebuilds_after_priming(sql(spark, sf_dir, CONFIG_ROWS), primed(spark, sf_dir))


@query(
    "effective_fields",
    f"""WITH {_OK}, a AS (SELECT f.*, row_number() OVER (PARTITION BY f.table_name, f.field_name ORDER BY sort_order NULLS LAST, row_id) AS rk FROM ({FIELD_ROWS.format(**V)}) f JOIN u ON u.table_name = f.table_name AND u.field_name = f.field_name)
SELECT table_name, field_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY sort_order NULLS LAST, row_id) AS INTEGER) AS place, coalesce(weight, 1) AS weight, CASE WHEN role IN ('DISPLAY', 'TITLE', 'SUBTITLE', 'BODY', 'KEYWORD', 'EXACT') THEN role ELSE 'BODY' END AS role,
 CASE WHEN analyzer IN ('PREFIX', 'WORD', 'ENGLISH', 'EXACT') THEN analyzer END AS analyzer, in_snippet, coalesce(include_label, false) AS include_label FROM a WHERE rk = 1""",
)
def effective_fields(spark, sf_dir):
    return A.effective_fields(sql(spark, sf_dir, FIELD_ROWS), indexable(spark, sf_dir))


EDITS = """SELECT * FROM (VALUES (1, 'part', 'p_name', 2000, 'TITLE', CAST(NULL AS {s})), (20, 'part', 'p_type', 5, 'BODY', NULL), (21, 'part', 'p_new', 0, 'BODY', NULL), (22, 'part', 'p_x', 5, 'HERO', NULL), (23, 'part', 'p_y', 5, 'BODY', 'SOUNDEX'), (24, 'part', ' ', 5, 'BODY', NULL), (5, 'customer', 'c_name', 7, 'BODY', 'WORD')) AS t(row_id, table_name, field_name, weight, role, analyzer) UNION ALL SELECT CAST(2000000 + c_custkey AS INTEGER), 't' || c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'name' ELSE 'other' END, CAST(c_custkey % 1300 AS INTEGER), CASE WHEN c_custkey % 7 = 0 THEN 'HERO' ELSE 'BODY' END, CASE c_custkey % 9 WHEN 0 THEN 'SOUNDEX' WHEN 1 THEN 'WORD' END FROM customer"""


@query(
    "field_edits",
    f"""SELECT row_id, CASE WHEN trim(field_name) = '' THEN 'a field is required' WHEN weight NOT BETWEEN 1 AND 1000 THEN 'weight must be from 1 to 1000' WHEN role NOT IN ('DISPLAY', 'TITLE', 'SUBTITLE', 'BODY', 'KEYWORD', 'EXACT') THEN 'unknown role'
 WHEN analyzer NOT IN ('PREFIX', 'WORD', 'ENGLISH', 'EXACT') THEN 'unknown analyzer' WHEN EXISTS (SELECT 1 FROM ({FIELD_ROWS.format(**V)}) f WHERE f.table_name = e.table_name AND f.field_name = e.field_name AND f.row_id <> e.row_id) THEN 'the table has this field already' END AS reason, true AS owner_edited FROM ({EDITS.format(**V)}) e""",
)
def field_edits(spark, sf_dir):
    return A.check_edits(sql(spark, sf_dir, EDITS), sql(spark, sf_dir, FIELD_ROWS)).select("row_id", "reason", "owner_edited")


@query("next_sort_order", f"SELECT table_name, CAST(coalesce(max(sort_order), 0) + 10 AS INTEGER) AS sort_order FROM ({FIELD_ROWS.format(**V)}) f GROUP BY table_name")
def next_sort_order(spark, sf_dir):
    return A.next_sort_order(sql(spark, sf_dir, FIELD_ROWS))


_REMOVED = "SELECT 'orders' AS table_name, CAST(NULL AS {s}) AS field_name UNION ALL SELECT 'supplier', NULL UNION ALL SELECT 't' || c_custkey, NULL FROM customer WHERE c_custkey % 37 = 0"
_ADDED = "SELECT 'part' AS table_name, 'p_brand' AS field_name UNION ALL SELECT 't' || c_custkey, 'note' FROM customer WHERE c_custkey % 62 = 0"


@query("tombstone_edits", f"SELECT table_name, field_name FROM (({TOMBSTONES.format(**V)}) UNION ({_REMOVED.format(**V)})) x EXCEPT SELECT * FROM ({_ADDED}) y")
def tombstone_edits(spark, sf_dir):
    """Tables are removed, and fields that had a tombstone are added again."""
    return A.clear_tombstones(A.add_tombstones(sql(spark, sf_dir, TOMBSTONES), sql(spark, sf_dir, _REMOVED)), sql(spark, sf_dir, _ADDED))


def recorded_fields(spark, sf_dir, now: bool):
    """Fields of each customer's table as recorded at its last build, or as they are now: a weight that may differ, and every other one has another field."""
    key = F.col("c_custkey")
    one = lambda name, weight: F.concat(F.lit('{"name":"'), name, F.lit('","weight":'), weight.cast("string"), F.lit(',"includeLabel":false}'))
    second = F.when(key % 2 == 1, "extra").otherwise("note") if now else F.lit("note")
    fields = F.concat(F.lit("["), one(F.lit("name"), key % (3 if now else 4)), F.lit(","), one(second, F.lit(1)), F.lit("]"))
    return load(spark, sf_dir, "customer").select(F.concat(F.lit("t"), key.cast("string")).alias("table_name"), fields.alias("fields_json"), key)


_T = "SELECT 't' || c_custkey AS table_name"


@query("field_diff", f"{_T}, 'name' AS field_name, 'changed' AS change FROM customer WHERE c_custkey % 4 <> c_custkey % 3 UNION ALL {_T}, 'note', 'removed' FROM customer WHERE c_custkey % 2 = 1 UNION ALL {_T}, 'extra', 'added' FROM customer WHERE c_custkey % 2 = 1")
def field_diff(spark, sf_dir):
    return A.field_diff(recorded_fields(spark, sf_dir, False), recorded_fields(spark, sf_dir, True))


@query("drift_detect", f"{_T}, 'NEEDS_REINDEX' AS status FROM customer WHERE (c_custkey % 4 <> c_custkey % 3 OR c_custkey % 2 = 1) AND c_custkey % 7 > 1 AND c_custkey % 11 <> 0")
def drift_detect(spark, sf_dir):
    """Tables that were built with other fields; some are known to be, some are built just now, and of some nothing is recorded."""
    status = F.when(F.col("c_custkey") % 7 == 0, "REBUILDING").when(F.col("c_custkey") % 7 == 1, "NEEDS_REINDEX").otherwise("ACTIVE")
    rows = recorded_fields(spark, sf_dir, False).select("table_name", F.when(F.col("c_custkey") % 11 != 0, F.col("fields_json")).alias("fields_json"), status.alias("status"))
    return M.drift(rows, recorded_fields(spark, sf_dir, True))


@query("table_choices", "SELECT table_name, label FROM (" + META_TABLES + ") t WHERE table_name IN (SELECT table_name FROM (" + CONFIG_ROWS.format(**V) + ") r) AND (contains(lower(label), 'r') OR contains(table_name, 'r'))")
def table_choices(spark, sf_dir):
    return A.indexed_choices(sql(spark, sf_dir, CONFIG_ROWS), sql(spark, sf_dir, META_TABLES).select("table_name", "label"), "R")


@query("stop_and_start", f"SELECT table_name, CASE WHEN table_name = 'part' THEN false ELSE enabled END AS enabled, status, CASE WHEN table_name = 'part' THEN true ELSE owner_edited END AS owner_edited FROM ({CONFIG_ROWS.format(**V)}) r")
def stop_and_start(spark, sf_dir):
    return A.set_enabled(sql(spark, sf_dir, CONFIG_ROWS), ["part"], False).select("table_name", "enabled", "status", "owner_edited")


@query("queue_tables", f"SELECT table_name, CASE WHEN table_name IN ('part', 'documents') THEN 'PENDING_BUILD' ELSE status END AS status FROM ({CONFIG_ROWS.format(**V)}) r")
def queue_tables(spark, sf_dir):
    return A.queue(sql(spark, sf_dir, CONFIG_ROWS), ["part", "documents"]).select("table_name", "status")


_REPORT = f"""{_FIELD_STEP}, t AS (SELECT c.table_name, coalesce(m.label, c.table_name) AS label, {_STEP} AS step FROM ({CODE_TABLES.format(**V)}) c LEFT JOIN ({CONFIG_ROWS.format(**V)}) r ON r.table_name = c.table_name LEFT JOIN ({META_TABLES}) m ON m.table_name = c.table_name),
 b AS (SELECT coalesce(m.label, r.table_name) AS label FROM ({CONFIG_ROWS.format(**V)}) r LEFT JOIN ({META_TABLES}) m ON m.table_name = r.table_name WHERE enabled AND status NOT IN ('PENDING_BUILD', 'BUILDING', 'REBUILDING') AND r.table_name IN (SELECT table_name FROM p WHERE step <> 'keep')),
 n AS (SELECT (SELECT count(*) FROM t WHERE step = 'insert') AS new_tables, (SELECT count(*) FROM p WHERE step = 'insert') AS new_fields, (SELECT count(*) FROM p WHERE step = 'update') AS updated_fields, (SELECT count(*) FROM t WHERE step = 'update') AS updated_tables, (SELECT count(*) FROM b) AS rebuilds,
  (SELECT count(*) FROM t WHERE step = 'skip') + (SELECT count(*) FROM ({CODE_FIELDS}) c WHERE table_name NOT IN {_GONE} AND {_BURIED}) AS skipped)
SELECT *, true AS has_changes, 'New: ' || new_tables || ' table' || CASE WHEN new_tables = 1 THEN '' ELSE 's' END || ' added and building (' || (SELECT string_agg(label, ', ' ORDER BY label) FROM t WHERE step = 'insert') || '); ' || new_fields || ' field' || CASE WHEN new_fields = 1 THEN '' ELSE 's' END || ' added, ' || updated_fields || ' updated from code defaults; rebuilding '
 || (SELECT string_agg(label, ', ' ORDER BY label) FROM b) || '; ' || updated_tables || ' index setting' || CASE WHEN updated_tables = 1 THEN '' ELSE 's' END || ' updated from code defaults.' AS summary FROM n"""


@query("priming_report", _REPORT)
def priming_report(spark, sf_dir):
    tables = A.prime_tables(sql(spark, sf_dir, CODE_TABLES), sql(spark, sf_dir, CONFIG_ROWS), sql(spark, sf_dir, TOMBSTONES))
    fields = primed(spark, sf_dir)
    rebuilds = A.rebuilds_after_priming(sql(spark, sf_dir, CONFIG_ROWS), fields)
    return A.priming_report(sql(spark, sf_dir, CODE_FIELDS), sql(spark, sf_dir, TOMBSTONES), tables, fields, rebuilds, sql(spark, sf_dir, META_TABLES).select("table_name", "label"))


SETTINGS = "paused boolean, paused_at timestamp, paused_by string, pause_reason string, last_primed_at timestamp, last_priming_summary string, last_priming_new_tables long"


@query("settings_primed", f"SELECT true AS paused, 'disk full' AS pause_reason, TIMESTAMP '{NOW}' AS last_primed_at, summary AS last_priming_summary, new_tables AS last_priming_new_tables FROM ({_REPORT}) r")
def settings_primed(spark, sf_dir):
    settings = spark.createDataFrame([(True, None, "ann", "disk full", None, "before", 7)], SETTINGS)
    told = A.settings_after_priming(settings, priming_report(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return told.select("paused", "pause_reason", "last_primed_at", "last_priming_summary", "last_priming_new_tables")


INDEX_EDITS = """SELECT * FROM (VALUES ('part', true, -1, 'p_name'), ('customer', true, 5, 'modified'), ('orders', true, 5, ' '), ('documents', true, 5, ''), ('supplier', true, 5, NULL), ('unknown', true, 5, NULL)) AS t(table_name, enabled, interval_minutes, timestamp_field) UNION ALL SELECT 't' || c_custkey, c_custkey % 3 <> 0, CAST(c_custkey % 9 - 2 AS INTEGER), CASE c_custkey % 5 WHEN 0 THEN 'modify_date' WHEN 1 THEN 'updated' WHEN 2 THEN ' ' WHEN 4 THEN 'name' END FROM customer"""
_EDITED = CONFIG_ROWS.replace("('part'", "('supplier', false, 5, NULL, false, 'ACTIVE'), ('part'", 1).replace("NULL, false, 'ACTIVE'), ('part', true, 15, CAST(NULL AS {s})", "CAST(NULL AS {s}), false, 'ACTIVE'), ('part', true, 15, NULL", 1)


@query(
    "index_row_edits",
    f"""WITH x AS (SELECT e.table_name, e.enabled, e.interval_minutes, CASE WHEN trim(e.timestamp_field) <> '' THEN e.timestamp_field END AS ts, o.enabled AS o_enabled, o.interval_minutes AS o_interval, CASE WHEN trim(o.timestamp_field) <> '' THEN o.timestamp_field END AS o_ts, o.owner_edited, o.status
 FROM ({INDEX_EDITS}) e JOIN ({_EDITED.format(**V)}) o ON o.table_name = e.table_name),
y AS (SELECT *, enabled IS DISTINCT FROM o_enabled OR interval_minutes IS DISTINCT FROM o_interval OR ts IS DISTINCT FROM o_ts AS changed,
 concat_ws('; ', CASE WHEN ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({FIELDS}) f WHERE f.table_name = x.table_name AND f.field_name = ts AND type = 'DATE_TIME') THEN 'the timestamp must be a date-time field of the table' END, CASE WHEN interval_minutes < 0 THEN 'the interval must not be negative' END) AS wrong FROM x)
SELECT table_name, CASE WHEN changed AND wrong <> '' THEN wrong END AS reason, coalesce(owner_edited, false) OR (changed AND wrong = '') AS owner_edited,
 CASE WHEN changed AND wrong = '' AND coalesce(enabled, true) AND NOT coalesce(o_enabled, true) AND coalesce(status, '') NOT IN ('BUILDING', 'REBUILDING') THEN 'PENDING_BUILD' ELSE status END AS status FROM y""",
)
def index_row_edits(spark, sf_dir):
    times = sql(spark, sf_dir, FIELDS).where("type = 'DATE_TIME'").select("table_name", "field_name")
    return A.check_index_edits(sql(spark, sf_dir, INDEX_EDITS), sql(spark, sf_dir, _EDITED), times)


@query("index_rows_ensured", f"SELECT table_name, interval_minutes, status FROM ({CONFIG_ROWS.format(**V)}) r UNION ALL SELECT table_name, interval_minutes, 'ACTIVE' FROM ({CODE_TABLES.format(**V)}) c WHERE table_name NOT IN (SELECT table_name FROM ({CONFIG_ROWS.format(**V)}) r)")
def index_rows_ensured(spark, sf_dir):
    return A.ensure_index_rows(sql(spark, sf_dir, CONFIG_ROWS), sql(spark, sf_dir, CODE_TABLES)).select("table_name", "interval_minutes", "status")


_FAILED = "SELECT CASE user_id % 3 WHEN 0 THEN 'part' WHEN 1 THEN 'customer' ELSE 'unknown' END AS table_name FROM events"


@query("error_counts", f"SELECT table_name, CASE WHEN table_name = 'part' THEN 4 ELSE 0 END + (SELECT count(*) FROM ({_FAILED}) f WHERE f.table_name = r.table_name) AS real_time_errors FROM ({CONFIG_ROWS.format(**V)}) r")
def error_counts(spark, sf_dir):
    """Failed events of all of ``events``, counted on the index rows of their tables."""
    rows = sql(spark, sf_dir, CONFIG_ROWS).withColumn("real_time_errors", F.when(F.col("table_name") == "part", F.lit(4)).cast("long"))
    failed = load(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 == 0, "part").when(F.col("user_id") % 3 == 1, "customer").otherwise("unknown").alias("table_name"))
    return A.count_errors(rows, failed).select("table_name", "real_time_errors")
