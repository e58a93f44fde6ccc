"""Index maintenance: upserts, incremental pulls, reconciliation, rebuilds, replay, history.

All of it is plain joins, filters and latest-wins aggregates over tables of
documents, source rows and configuration; the driver only decides what runs.
Times are arguments, so a plan means the same whenever it runs.

Tables: ``index_rows`` (table_name, enabled, interval_minutes, timestamp_field,
status, last_pull, last_build, document_count, fields_json), ``runs`` (run_id,
table_name, run_type, status, start_time, heartbeat, cancel_requested),
``events`` (event_id, table_name, record_id, action, attempts, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import EngineConfig

BUILDING_STATES = ("PENDING_BUILD", "BUILDING", "REBUILDING")


def resolve_versions(writes: DataFrame) -> DataFrame:
    """The surviving write of each document: writes (document_id, version, seq, ...) applied in the order of ``seq``.

    A write counts if its version is not below the stored one; a write without a
    version always counts, and any write counts after it.
    """
    of = Window.partitionBy("document_id")
    since = F.max(F.when(F.col("version").isNull(), F.col("seq"))).over(of)
    rank = F.row_number().over(of.orderBy(F.col("version").desc_nulls_last(), F.col("seq").desc()))
    live = writes.withColumn("__since", since).where("__since is null or seq >= __since").drop("__since")
    return live.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored documents (at most one of an id) after a batch (in order of ``seq``)."""
    return resolve_versions(stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(incoming)).drop("seq")


def bulk_outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many of a batch's writes (one a document) succeed, or are skipped as older than what is stored."""
    known = stored.select("document_id", F.col("version").alias("__stored"))
    older = (F.col("version") < F.col("__stored")) & F.col("__stored").isNotNull()
    outcome = F.when(F.coalesce(older, F.lit(False)), "skipped").otherwise("indexed")
    return incoming.join(known, "document_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


# Incremental pulls.


def pull_due(index_rows: DataFrame, now: Column) -> DataFrame:
    """Enabled tables that were never pulled, have no interval, or whose interval is over."""
    next_pull = F.col("last_pull") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("interval_minutes"))
    due = F.col("last_pull").isNull() | F.col("interval_minutes").isNull() | (next_pull < now)
    return index_rows.where(F.col("enabled") & due)


def changed_since(rows: DataFrame, timestamp: str | None, last_pull, overlap_seconds: int = 300) -> DataFrame:
    """Rows that an incremental pull reads: from ``overlap_seconds`` before the last pull on; all on the first pull, none later without a timestamp."""
    if last_pull is None:
        return rows
    if timestamp is None:
        return rows.where(F.lit(False))
    return rows.where(F.col(timestamp) >= F.lit(last_pull) - F.expr(f"interval {overlap_seconds} seconds"))


def next_watermark(last_pull, run_start, errors: int):
    """The start of the run, but only if nothing went wrong."""
    return run_start if errors == 0 else last_pull


def page_after(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page by key."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def edges(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the lowest ceil(n/2) and highest floor(n/2) keys; a row in both counts once."""
    low = rows.orderBy(F.col(key).asc()).limit((n + 1) // 2)
    return low.union(rows.orderBy(F.col(key).desc()).limit(n // 2)).dropDuplicates([key])


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of the MD5 of seed and key: random to the eye, the same each time and in any engine."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def typed_ids(ids: DataFrame, kind: str) -> DataFrame:
    """Record ids as keys of a type; what can't be converted is dropped, repeats count once."""
    return ids.select(F.col("record_id").try_cast(kind).alias("key")).where("key is not null").distinct()


# Reconciliation.


def without_stale(documents: DataFrame, table: str, cutoff: Column) -> DataFrame:
    """Documents but those of a table that were last indexed before ``cutoff``; never indexed counts as before."""
    fresh = F.coalesce(F.col("indexed_at") >= cutoff, F.lit(False))
    return documents.where((F.col("source_table") != table) | fresh)


def orphan_tables(documents: DataFrame, configured: DataFrame) -> DataFrame:
    """Documents of tables that aren't configured."""
    return documents.join(configured.select(F.col("table_name").alias("source_table")), "source_table", "left_anti")


def orphan_documents(documents: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Documents (source_table, record_id) without a source row."""
    return documents.join(source_ids.select("source_table", "record_id"), ["source_table", "record_id"], "left_anti")


def missing_documents(source_ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Source rows without a document."""
    return source_ids.join(documents.select("source_table", "record_id"), ["source_table", "record_id"], "left_anti")


def reconcile(documents: DataFrame, rebuilt: DataFrame, table: str, errors: int = 0) -> DataFrame:
    """Documents after a table was built anew. With an error nothing is removed.

    A document that a rebuilt one doesn't replace because it is newer stays: its
    record exists, so it isn't stale.
    """
    of_table = F.col("source_table") == table
    kept = documents.where(~of_table)
    stored = documents.where(of_table)
    if not errors:
        stored = stored.join(rebuilt.select("document_id"), "document_id", "left_semi")
    return kept.unionByName(upsert(stored, rebuilt.withColumn("seq", F.lit(0).cast("long"))))


# Failed events and captured deletes.


def replay_split(events: DataFrame, source_ids: DataFrame, batch: int | None = None) -> DataFrame:
    """What a replay does with each pending event, in the order of ids: index, delete or nothing.

    A record that was deleted and exists again is left alone; one that was to be
    indexed and is gone has its document deleted.
    """
    pending = events.where("status = 'PENDING'")
    if batch is not None:
        pending = pending.orderBy("event_id").limit(batch)
    there = source_ids.select(F.col("source_table").alias("table_name"), "record_id").distinct().withColumn("there", F.lit(True))
    found = pending.join(there, ["table_name", "record_id"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    step = F.when(F.col("action") == "DELETE", F.when(F.col("there"), "none").otherwise("delete")).otherwise(F.when(F.col("there"), "index").otherwise("delete"))
    return found.select("event_id", "table_name", "record_id", "action", step.alias("step"))


def replay_attempts(events: DataFrame, failed: DataFrame, most: int = 10) -> DataFrame:
    """Events after a replay: those that failed again count one more attempt and are exhausted at ``most``; the others are done."""
    again = events.join(failed.select("event_id"), "event_id", "left_semi").withColumn("attempts", F.col("attempts") + 1)
    return again.withColumn("status", F.when(F.col("attempts") >= most, "EXHAUSTED").otherwise(F.col("status")))


def captured_delete_split(events: DataFrame, source_ids: DataFrame, last_id: int) -> DataFrame:
    """Deletes captured during a rebuild, up to the last id at its end: which documents go, and which records exist again."""
    captured = events.where(f"status = 'AWAITING_REINDEX' and event_id <= {last_id}")
    there = source_ids.select(F.col("source_table").alias("table_name"), "record_id").distinct().withColumn("there", F.lit(True))
    found = captured.join(there, ["table_name", "record_id"], "left")
    return found.select("event_id", "table_name", "record_id", F.when(F.col("there").isNull(), "delete").otherwise("keep").alias("step"))


def hand_over_captured(events: DataFrame, table: str, last_id: int) -> DataFrame:
    """After a dead rebuild, captured deletes become pending for the next pull."""
    mine = (F.col("status") == "AWAITING_REINDEX") & (F.col("table_name") == table) & (F.col("event_id") <= last_id)
    return events.withColumn("status", F.when(mine, "PENDING").otherwise(F.col("status")))


def release_deferred(events: DataFrame) -> DataFrame:
    """On resume, deferred events become pending."""
    return events.withColumn("status", F.when(F.col("status") == "DEFERRED", "PENDING").otherwise(F.col("status")))


def events_per_table(events: DataFrame) -> DataFrame:
    return events.groupBy("table_name").agg(F.count("*").alias("n"))


# Runs.


def live_runs(runs: DataFrame, now: Column, stale_minutes: int = 30) -> DataFrame:
    """Per table with running rebuilds: whether any was seen within ``stale_minutes``, and when the first of them began."""
    running = runs.where("status = 'RUNNING' and run_type = 'FULL'")
    seen = F.greatest("start_time", "heartbeat")
    alive = F.bool_or(F.coalesce(seen >= now - F.expr(f"interval {stale_minutes} minutes"), F.lit(False)))
    return running.groupBy("table_name").agg(alive.alias("alive"), F.min("start_time").alias("earliest_start"), F.max(seen).alias("last_seen"), F.count("*").alias("n"))


def recover_dead(index_rows: DataFrame, liveness: DataFrame) -> DataFrame:
    """Index rows after recovery: a rebuild without a live run ends, and the next pull begins where it did."""
    dead = liveness.where("not alive").select("table_name", "earliest_start")
    found = index_rows.join(dead, "table_name", "left")
    over = (F.col("status") == "REBUILDING") & F.col("earliest_start").isNotNull()
    rewound = F.least("last_pull", "earliest_start")
    return found.withColumns({"status": F.when(over, "ACTIVE").otherwise(F.col("status")), "last_pull": F.when(over, rewound).otherwise(F.col("last_pull"))}).drop("earliest_start")


def queue_builds(index_rows: DataFrame, created_at: Column, index_empty: bool) -> DataFrame:
    """Enabled tables to build again: pulled before the index was created and not built since, or counted though the index is empty."""
    unbuilt = F.col("last_pull").isNotNull() & (F.col("last_build").isNull() | (F.col("last_build") < created_at))
    lost = F.lit(index_empty) & (F.coalesce("document_count", F.lit(0)) > 0)
    return index_rows.where(F.col("enabled") & ~F.col("status").isin(*BUILDING_STATES) & (unbuilt | lost)).select("table_name")


def drift(index_rows: DataFrame, current: DataFrame) -> DataFrame:
    """Tables whose documents were built with other fields than configured now (``current``: table_name, fields_json)."""
    found = index_rows.join(current.select("table_name", F.col("fields_json").alias("__now")), "table_name")
    changed = F.col("fields_json").isNotNull() & (F.col("fields_json") != F.col("__now"))
    return found.where(changed & ~F.col("status").isin("NEEDS_REINDEX", "REBUILDING")).select("table_name", F.lit("NEEDS_REINDEX").alias("status"))


def expired(history: DataFrame, time: str, now: Column, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Rows to purge: older than the retention, the oldest first, at most ``purge_limit`` a time."""
    old = history.where(F.col(time) < now - F.expr(f"interval {config.retention_days} days"))
    return old.orderBy(time).limit(config.purge_limit)


def reindex_chosen(chosen: DataFrame, source_ids: DataFrame, readable_ids: DataFrame, key_type: str = "long") -> DataFrame:
    """What to do with chosen records: write what may be read, delete what is gone, skip the rest."""
    typed = F.col("record_id").try_cast(key_type).cast("string")
    there = source_ids.select(F.col("record_id").alias("__id"), F.lit(True).alias("there"))
    open_ids = readable_ids.select(F.col("record_id").alias("__open_id"), F.lit(True).alias("open"))
    found = chosen.select("record_id").distinct().withColumn("__typed", typed).join(there, F.col("__typed") == F.col("__id"), "left").join(open_ids, F.col("__typed") == F.col("__open_id"), "left")
    step = F.when(F.col("__typed").isNull(), "skip: invalid id").when(F.col("open"), "write").when(F.col("there"), "skip: not readable").otherwise("delete")
    return found.select("record_id", step.alias("step"))


#: Statuses of a table's row and what leads on from them.
TRANSITIONS = {
    ("PENDING_BUILD", "build"): "BUILDING",
    ("BUILDING", "built"): "ACTIVE",
    ("BUILDING", "failed"): "PENDING_BUILD",
    ("BUILDING", "paused"): "PENDING_BUILD",
    ("BUILDING", "cancelled"): "NEEDS_REINDEX",
    ("ACTIVE", "drifted"): "NEEDS_REINDEX",
    ("ACTIVE", "edited"): "NEEDS_REINDEX",
    ("REBUILDING", "built"): "ACTIVE",
    ("REBUILDING", "recovered"): "ACTIVE",
}


def next_status(status: str | None, what: str, prior: str = "ACTIVE") -> str:
    """The status after ``what``; a rebuild begins from any status and falls back to ``prior`` if it fails; other pairs change nothing."""
    if what == "rebuild":
        return "REBUILDING"
    if what == "index missing" and status not in BUILDING_STATES:
        return "PENDING_BUILD"
    if (status, what) == ("REBUILDING", "failed"):
        return prior
    return TRANSITIONS.get((status, what), status)
