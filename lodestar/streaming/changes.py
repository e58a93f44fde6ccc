"""Change streams: record changes become documents, in committed micro-batches.

A change row is (seq, table_name, record_id, action) with action INSERT, UPDATE
or DELETE. Each micro-batch keeps the last change of each record, reads the
current source rows of those records (not the rows as they were when the change
was made), and applies one batch of writes and deletes per table. Delivery is at
least once; applying a batch again changes nothing, since writes are versioned
and deletes are by id. A handler with a ``stream`` name also commits each batch's number with
its segment, so that a batch that comes again after a crash adds no segment; the name goes
with the checkpoint (a new checkpoint, which counts from 0, needs a new name). What
can't be applied is recorded for replay and does not stop the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import build_documents, record_id_of
from ..operators.maintain import first_wins
from ..operators.processes import Source
from ..sources.index import Index


class Publisher(Protocol):
    def publish(self, table: str, writes: DataFrame | None, deleted: DataFrame | None) -> None: ...

    def close(self) -> None: ...


@dataclass
class IndexPublisher:
    """Publishes to a stored index."""

    index: Index

    def publish(self, table: str, writes: DataFrame | None, deleted: DataFrame | None, once: tuple[str, int] | None = None) -> None:
        if writes is not None and not writes.isEmpty():
            self.index.apply(table, writes, once=once)
        if deleted is not None and not deleted.isEmpty():
            self.index.apply(table, deleted=deleted, once=once)

    def close(self) -> None:
        pass


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each record."""
    return first_wins(changes.where("record_id is not null"), ["table_name", "record_id"], [F.col("seq").desc()])


def split(changes: DataFrame, source: Source) -> tuple[DataFrame, DataFrame]:
    """Documents to write and ids to delete: a record that is gone by now is a delete whatever was done to it, one that is back isn't."""
    config = source.config
    mine = last_changes(changes.where(F.col("table_name") == config.name)).select("record_id", "seq")
    rows = source.rows().withColumn("__id", F.col(config.key).cast("string"))
    there = rows.join(mine.withColumnRenamed("record_id", "__id"), "__id")
    writes = build_documents(there, config, source.labels)
    numbered = writes.join(mine, "record_id").select(*writes.columns, "seq")
    gone = mine.join(rows.select(F.col("__id").alias("record_id")), "record_id", "left_anti")
    return numbered, gone.select(F.concat_ws(":", F.lit(config.name), "record_id").alias("document_id"))


@dataclass
class ChangeHandler:
    """foreachBatch function: applies a micro-batch table by table; a table that fails doesn't stop the others."""

    sources: dict[str, Source]
    publisher: Publisher
    record_failures: Callable[[DataFrame], None]
    paused: Callable[[], bool] = lambda: False
    rebuilding: Callable[[], set[str]] = set
    stream: str | None = None

    def __call__(self, changes: DataFrame, batch: int) -> None:
        changes = changes.persist()
        try:
            if self.paused():
                self.record_failures(self._events(changes, "DEFERRED"))
                return
            # Read before publishing: a rebuild that begins later reads the source after these changes.
            rebuilding = self.rebuilding()
            for name, source in self.sources.items():
                mine = changes.where(F.col("table_name") == name)
                if mine.isEmpty():
                    continue
                try:
                    writes, deleted = split(mine, source)
                except Exception as error:
                    self.record_failures(self._events(mine, "PENDING", error))
                    continue
                # Each half for itself: a failure of one doesn't undo or repeat the other.
                for half, ids in (("writes", writes.select("document_id")), ("deleted", deleted)):
                    once = {"once": (f"{self.stream}/{name}/{half}", batch)} if self.stream else {}
                    try:
                        self.publisher.publish(name, **{"writes": None, "deleted": None, half: writes if half == "writes" else deleted}, **once)
                    except Exception as error:
                        theirs = mine.join(ids.select(record_id_of("document_id").alias("record_id")), "record_id", "left_semi")
                        self.record_failures(self._events(theirs, "PENDING", error))
                if name in rebuilding:
                    self.record_failures(self._events(mine.where("action = 'DELETE'"), "AWAITING_REINDEX"))
        finally:
            changes.unpersist()

    @staticmethod
    def _events(changes: DataFrame, status: str, error: Exception | None = None) -> DataFrame:
        """Events to replay, with the cause."""
        cause = f"{type(error).__name__}: {error}".splitlines()[0][:4000] if error else None
        action = F.when(F.col("action") == "DELETE", "DELETE").otherwise("INDEX")
        return last_changes(changes).select("table_name", "record_id", action.alias("action"), F.lit(0).alias("attempts"), F.lit(status).alias("status"), F.lit(cause).cast("string").alias("error"))


def follow(changes: DataFrame, handler: ChangeHandler, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts following a stream of changes."""
    writer = changes.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
