"""Processes over a stored index: pulls of all due tables, a full rebuild, the drain of captured deletes.

Each is a row of Spark jobs, one or a few for each configured table; the loops on the driver are over tables, never over
records. Runs are kept in a ledger, an append-only table of what happened to them, from which their state is
folded: a cancellation or an outcome is one more row, and rows of several drivers don't collide. While a job of a run
writes, a watch gives signs of life (a file for each run, replaced each time) and looks for a cancellation, which stops the job.
Documents that can't be indexed go to a table of their own, with causes; the others of their batch are indexed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.config import TableConfig
from ..sources.index import Index, Rival
from .documents import BULK_BYTES, Label, checked_documents
from .maintain import bulk_outcomes, captured_delete_split, changed_since, live_runs
from .watch import Interrupted, Watch

EVENT = "run_id string, table_name string, run_type string, what string, at timestamp, processed long, indexed long, skipped long, errors long, first_error string"
OUTCOMES = ("COMPLETED", "FAILED", "CANCELLED")
REJECTED = "run_id string, table_name string, record_id string, cause string, at timestamp"


class Cancelled(RuntimeError):
    """A run was asked to stop; ``counts`` is what it had done."""

    def __init__(self, counts: Counts):
        super().__init__("the run was cancelled")
        self.counts = counts


@dataclass
class Counts:
    processed: int = 0
    indexed: int = 0
    skipped: int = 0
    errors: int = 0
    first_error: str | None = None

    def failed(self, error: Exception, n: int = 1) -> None:
        self.refused(f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:4000], n)

    def refused(self, cause: str | None, n: int) -> None:
        self.errors += n
        self.first_error = self.first_error or cause


@dataclass
class Source:
    """Where a table's rows come from."""

    config: TableConfig
    rows: Callable[[], DataFrame]
    labels: dict[str, Label] = field(default_factory=dict)


class Ledger:
    """Runs of processes. Their ids are made here; times are the caller's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, run: str, table: str | None, kind: str | None, what: str, at: datetime, counts: Counts = Counts()) -> None:
        row = (run, table, kind, what, at, counts.processed, counts.indexed, counts.skipped, counts.errors, counts.first_error)
        self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, table: str, kind: str, at: datetime) -> str:
        run = uuid.uuid4().hex
        self._add(run, table, kind, "STARTED", at)
        return run

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def beat(self, run: str, at: datetime) -> None:
        """A sign of life in place of the last one: nothing grows with the time that a run takes."""
        row = json.dumps({"run_id": run, "what": "HEARTBEAT", "at": at.isoformat()})
        file = self._at(f"{self.path}_beats/{run}.json")
        out = file.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(file, True)
        out.write(bytearray(row.encode()))
        out.close()

    def cancel(self, run: str, at: datetime) -> None:
        self._add(run, None, None, "CANCEL", at)
        mark = self._at(f"{self.path}_cancelled/{run}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()

    def reject(self, run: str, documents: DataFrame, at: datetime) -> None:
        """Keeps what a run couldn't index: documents with their ``cause``."""
        rows = documents.select(F.lit(run).alias("run_id"), F.col("source_table").alias("table_name"), "record_id", "cause", F.lit(at).cast("timestamp").alias("at"))
        rows.write.mode("append").parquet(f"{self.path}_rejected")

    def rejected(self) -> DataFrame:
        return self._stored(f"{self.path}_rejected", REJECTED)

    def _stored(self, path: str, schema: str, kind: str = "parquet") -> DataFrame:
        at = self._at(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(kind).load(path)

    def end(self, run: str, outcome: str, at: datetime, counts: Counts) -> None:
        self._add(run, None, None, outcome, at, counts)

    def events(self) -> DataFrame:
        beats = self._stored(f"{self.path}_beats", "run_id string, what string, at timestamp", "json").where("at is not null")
        return self._stored(self.path, EVENT).unionByName(beats, allowMissingColumns=True)

    def runs(self) -> DataFrame:
        return run_states(self.events())

    def is_cancelled(self, run: str) -> bool:
        """From a file of its own, so that a watch can ask often."""
        mark = self._at(f"{self.path}_cancelled/{run}")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def compact(self) -> None:
        """The rows so far in one file in place of one for each, and the signs of life of runs that are over deleted."""
        rows = self._stored(self.path, EVENT)
        names = [r[0] for r in rows.select(F.input_file_name()).distinct().collect()]  # a name for each event since the last time
        if len(names) > 1:
            rows.coalesce(1).write.mode("append").parquet(self.path)
        over = [r.run_id for r in rows.where(F.col("what").isin(*OUTCOMES)).select("run_id").distinct().collect()]
        for path in [*(names if len(names) > 1 else []), *(f"{self.path}_beats/{run}.json" for run in over)]:
            at = self._at(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, False)


def run_states(events: DataFrame) -> DataFrame:
    """A row for each run, folded from its events: its last outcome (RUNNING without one), heartbeat, cancellation, counts."""
    outcome = F.col("what").isin(*OUTCOMES)
    last = lambda c: F.max_by(F.when(outcome, F.col(c)), F.when(outcome, F.col("at")))
    return events.groupBy("run_id").agg(
        F.max("table_name").alias("table_name"),
        F.max("run_type").alias("run_type"),
        F.coalesce(last("what"), F.lit("RUNNING")).alias("status"),
        F.min(F.when(F.col("what") == "STARTED", F.col("at"))).alias("start_time"),
        F.max(F.when(F.col("what") == "HEARTBEAT", F.col("at"))).alias("heartbeat"),
        F.bool_or(F.col("what") == "CANCEL").alias("cancel_requested"),
        F.max(F.when(outcome, F.col("at"))).alias("end_time"),
        *[F.coalesce(last(c), F.lit(0)).cast("long").alias(c) for c in ("processed", "indexed", "skipped", "errors")],
        last("first_error").alias("first_error"),
    )


#: Characters of an error that an index row keeps.
ERROR_LENGTH = 4000


def run_changes(runs: DataFrame, index_rows: DataFrame) -> DataFrame:
    """What the last run that ended of each table leaves in its index row (``admin.update_index_rows``): its kind and status, and its first error or none. A run over ``*`` is one of every table."""
    told = [F.col("end_time").alias("at"), F.concat_ws(" ", "run_type", "status").alias("last_run"), F.substring("first_error", 1, ERROR_LENGTH).alias("last_error")]
    ended = runs.where(F.col("status").isin(*OUTCOMES))
    of_all = ended.where("table_name = '*'").select(*told).agg(F.max_by(F.struct("*"), F.struct("*")).alias("r")).where("r is not null").select("r.*")
    each = index_rows.select("table_name").crossJoin(F.broadcast(of_all))  # one row
    return ended.where("table_name <> '*'").select("table_name", *told).unionByName(each)


PULLED = "table_name string, status string, processed long, indexed long, skipped long, errors long, first_error string, last_pull timestamp"


def pull_all(index: Index, due: DataFrame, sources: dict[str, Source], ledger: Ledger, now: datetime, overlap_seconds: int = 300, max_bytes: int = BULK_BYTES) -> DataFrame:
    """Pulls each due table (table_name, timestamp_field, last_pull). A table that fails doesn't stop the others, nor does a
    document its batch; only tables without errors get ``now`` as their watermark. Returns a row per due table."""
    spark, out = index.spark, []
    for row in due.select("table_name", "timestamp_field", "last_pull").orderBy("table_name").collect():  # a row per table
        run, counts, broken = ledger.start(row.table_name, "PULL", now), Counts(), False
        try:
            source = sources[row.table_name]
            rows = changed_since(source.rows(), row.timestamp_field, row.last_pull, overlap_seconds)
            # Whether a write is older than what is stored is seen from the version, so the order within a pull doesn't matter.
            checked = checked_documents(rows, source.config, source.labels, max_bytes=max_bytes).withColumn("seq", F.lit(0).cast("long")).persist()
            try:
                bad = F.col("cause").isNotNull()
                told = checked.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min_by(F.when(bad, F.concat_ws(": ", "document_id", "cause")), F.when(bad, F.col("document_id"))).alias("first")).first()
                counts.processed = told.n
                if told.bad:
                    ledger.reject(run, checked.where(bad), now)
                    counts.refused(told.first, told.bad)
                if told.n > told.bad:
                    writes = checked.where(~bad).drop("cause")
                    stored = index.documents()
                    found = bulk_outcomes(stored.where(F.col("source_table") == row.table_name), writes) if stored is not None else writes.groupBy(F.lit("indexed").alias("outcome")).agg(F.count("*").alias("n"))
                    outcomes = {r.outcome: r.n for r in found.collect()}
                    index.apply(row.table_name, writes)
                    counts.indexed, counts.skipped = outcomes.get("indexed", 0), outcomes.get("skipped", 0)
            finally:
                checked.unpersist()
        except Exception as error:  # recorded with its cause
            counts.failed(error)
            broken = True
        status = "FAILED" if broken else "COMPLETED"
        ledger.end(run, status, now, counts)
        out.append((row.table_name, status, counts.processed, counts.indexed, counts.skipped, counts.errors, counts.first_error, row.last_pull if counts.errors else now))
    return spark.createDataFrame(out, PULLED)


#: Seconds between looks at a running job: a sign of life each time, and whether it is to stop.
LOOK_SECONDS = 2.0


def rebuild(index: Index, sources: dict[str, Source], ledger: Ledger, now: Callable[[], datetime], events: Callable[[], DataFrame], stale_minutes: int = 30, max_bytes: int = BULK_BYTES, every: float = LOOK_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Builds all tables anew beside the live index and swaps them in; then drains the deletes captured meanwhile.

    It holds the index's lease for replacing tables; another live rebuild stops it before it begins (``Rival``), a dead one is taken
    over and can't swap any more. While a table is written, signs of life are given and a cancellation stops the job
    (``Cancelled``; the live index stays, and what was written is deleted). Each source is read once. A table that fails stops the
    whole, as half an index can't be swapped in; a document that can't be indexed doesn't. ``events`` are the
    failed-event rows, read after the swap. Returns the run's row and the events that are left.
    """
    begun = now()
    rivals = live_runs(ledger.runs(), F.lit(begun), stale_minutes).where(F.col("alive") & F.col("table_name").isin(*sources, "*"))
    if not rivals.isEmpty():
        raise Rival(f"a rebuild of {rivals.first().table_name} is running")
    lease = index.acquire("*", uuid.uuid4().hex, begun, stale_minutes * 60)
    run, counts, draft = ledger.start("*", "FULL", begun), Counts(), index.draft()

    def look() -> str | None:
        ledger.beat(run, now())
        index.renew(lease, now())
        return "cancelled" if ledger.is_cancelled(run) else None

    try:
        for name, source in sorted(sources.items()):
            if look():
                raise Cancelled(counts)
            seen = Observation()
            bad = F.col("cause").isNotNull()
            rows = F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.concat_ws(": ", "document_id", "cause"))).alias("first")
            with Watch(index.spark, look, every):
                checked = checked_documents(source.rows(), source.config, source.labels, now=F.lit(begun), max_bytes=max_bytes).observe(seen, *rows)
                draft.add(name, checked.where(~F.coalesce(bad, F.lit(False))).drop("cause"))
            told = {"rows": 0, "bad": 0, "first": None, **seen.get}  # Spark may see that there is nothing to read
            counts.processed += told["rows"]
            if told["bad"]:  # few, and read once more only then
                ledger.reject(run, checked_documents(source.rows(), source.config, source.labels, now=F.lit(begun), max_bytes=max_bytes).where(bad), begun)
                counts.refused(told["first"], told["bad"])
        if look():
            raise Cancelled(counts)
        with Watch(index.spark, look, every):
            draft.finish(begun.isoformat(), lease)
        counts.indexed = counts.processed - counts.errors
        left = drain_deletes(index, events(), {n: s.rows().select(F.col(s.config.key).cast("string").alias("record_id")) for n, s in sources.items()})
    except (Cancelled, Interrupted) as stop:
        draft.discard()
        ledger.end(run, "CANCELLED", now(), counts)
        raise stop if isinstance(stop, Cancelled) else Cancelled(counts) from stop
    except Exception as error:
        draft.discard()
        counts.failed(error)
        ledger.end(run, "FAILED", now(), counts)
        raise
    finally:
        index.release(lease, now())
    ledger.end(run, "COMPLETED", now(), counts)
    return ledger.runs().where(F.col("run_id") == run), left


def drain_deletes(index: Index, events: DataFrame, source_ids: dict[str, DataFrame]) -> DataFrame:
    """Deletes captured during a rebuild, up to the newest one now, applied to the index, but for records that exist again.

    One segment per table; what is captured later stays. Returns the events that are left.
    """
    last = events.where("status = 'AWAITING_REINDEX'").agg(F.max("event_id")).first()[0]
    if last is None:
        return events
    for table, ids in source_ids.items():
        mine = events.where(F.col("table_name") == table)
        steps = captured_delete_split(mine, ids.withColumn("source_table", F.lit(table)), last)
        gone = steps.where("step = 'delete'").select(F.concat_ws(":", "table_name", "record_id").alias("document_id"))
        if not gone.isEmpty():
            index.apply(table, deleted=gone)
    done = (F.col("status") == "AWAITING_REINDEX") & (F.col("event_id") <= last) & F.col("table_name").isin(*source_ids)
    return events.where(~done)
