"""The stored index: immutable generations and segments behind numbered manifests.

A table has a base, a folder of documents, and segments: each applied batch adds one
small folder of writes and one of deletes and touches nothing else. Readers resolve
them (the last delete and the newest version of a document count) for the documents
that segments name; the base's other documents pass through without a shuffle.
``merge_segments`` folds small segments into larger ones as they add up, so that of a long row of batches few are left and
each is written a few times; ``compact`` writes a new base. Postings belong to a table's base and are replaced with it, so the
work of one table never rewrites another's; a search reads them and scans the segments' documents only, and all
documents of a table that has no postings. Its statistics are those of the live documents: what replaced and
deleted documents have in the stored sums is taken off, once for a manifest and from narrow rows of lengths.

``extend`` adds fields outside the snippet to a stored table: their values and postings are written beside the base,
which stays as it is until the next compaction takes them in.

A manifest is a file of the next number that is created only if it isn't there, so of two
writers one is told that it has moved. A writer states its change as a function of the live manifest and
is rebased: an added segment goes behind those added meanwhile, and a rebuild or a compaction
carries over the segments that were added since it began. Only replacements of the same
table conflict (``Moved``). Readers keep the manifest they began with: what a newer one
no longer names is deleted only ``RETAIN_SECONDS`` later, and so are folders that no manifest ever named (``vacuum``).

Whoever replaces tables may hold a lease: files with growing tokens, each created only if it isn't there.
The token of the last holder stands in the manifest and is compared in the same commit, so
a holder that was taken for dead and replaced can't swap any more (``TakenOver``).
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import MAPS, empty_documents, union_documents
from ..operators.maintain import resolve_versions
from ..operators.postings import SCHEMA, lengths_summed, postings_and_lengths, score_postings, without
from ..operators.query import HIT, Path, Plan, plan, score
from ..plans.config import EngineConfig, Role, TableConfig

MAPPING_VERSION = 3
RETAIN_SECONDS = 3600.0


#: Times that a commit is tried on newer manifests, and that a compaction is done again.
ATTEMPTS, COMPACTIONS = 100, 3
#: A segment is merged with those behind it once they hold this many times its bytes.
GROWTH = 4
#: Seconds after which a replacement of tables that merges wait for is taken for dead.
HOLD_SECONDS = 86400.0
#: Roles of fields that only their own clauses look into; others are part of what a stored document shows.
OWN_ROLES = (Role.BODY, Role.KEYWORD, Role.EXACT)
LENGTHS = "document_id string, source_table string, lengths array<struct<path:string,dl:int>>"
STATISTICS = "path string, n long, total long"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Bytes of a row group of stored documents. Each may go to a task of its own, whose words are sorted.
GROUP_BYTES = 16 << 20


class Moved(RuntimeError):
    """Another writer has swapped the manifest meanwhile."""


class MappingChanged(RuntimeError):
    """A stored table was built with other fields than it is searched by; a rebuild mends it."""


class Rival(RuntimeError):
    """Another process that replaces tables is alive."""


class TakenOver(RuntimeError):
    """The lease has gone to another holder."""


@dataclass(frozen=True)
class Lease:
    """The right to replace tables, until a later token is given."""

    scope: str
    token: int
    owner: str


class Index:
    def __init__(self, spark: SparkSession, path: str, config: EngineConfig, retain: float = RETAIN_SECONDS):
        self.spark, self.path, self.config, self.retain = spark, path.rstrip("/"), config, retain
        self._jvm, self._net = spark._jvm, (None, None)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # Manifests.

    def _numbers(self) -> list[int]:
        at = self._at(f"{self.path}/manifests")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """The live manifest, that of the largest number; an empty one before the first."""
        while True:
            numbers = self._numbers()
            if not numbers:
                return {"version": 0, "mapping": MAPPING_VERSION, "tables": {}, "created_at": None, "retired": []}
            try:
                return self._read(self._file(numbers[-1]))
            except Py4JJavaError:
                if self._numbers()[-1] == numbers[-1]:  # else it was replaced and deleted while it was looked up
                    raise

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._at(path))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _file(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010}.json"

    def swap(self, new: dict, expected: int) -> dict:
        """Makes ``new`` the live manifest if ``expected`` is still the live version; what it no longer names is retired."""
        before = self.manifest()
        if before["version"] != expected:
            raise Moved(f"the manifest is no longer at version {expected}")
        now = time.time()
        gone = sorted(self._paths(before) - self._paths(new))
        due = [r["path"] for r in before["retired"] if r["at"] <= now - self.retain]
        retired = [*before["retired"], *({"path": p, "at": now} for p in gone)]
        new = {**new, "version": expected + 1, "mapping": MAPPING_VERSION, "retired": [r for r in retired if r["path"] not in due]}
        self._create(self._file(expected + 1), json.dumps(new).encode())
        for path in due:  # a failure leaves files, not a broken index
            self._fs.delete(self._at(path), True)
        for number in self._numbers()[:-2]:
            self._fs.delete(self._at(self._file(number)), False)
        return new

    def commit(self, change: Callable[[dict], dict | None], lease: Lease | None = None) -> dict:
        """Swaps in what ``change`` makes of the live manifest (None: nothing is to be done), again on a newer one if another writer was first."""
        for attempt in range(ATTEMPTS):
            before = self.manifest()
            if lease and before.get("fences", {}).get(lease.scope) != lease.token:
                raise TakenOver(f"the lease on {lease.scope} has gone from {lease.owner} to another holder")
            new = change(before)
            if new is None:
                return before
            try:
                return self.swap(new, before["version"])
            except Moved:
                time.sleep(random.uniform(0, min(1.0, 0.01 * 2 ** min(attempt, 7))))
        raise Moved(f"other writers were first {ATTEMPTS} times")

    # Leases.

    def _lease(self, scope: str, token: int, kind: str) -> str:
        return f"{self.path}/leases/{'all' if scope == '*' else scope}/{token:010}.{kind}"

    def _tokens(self, scope: str) -> list[int]:
        at = self._at(self._lease(scope, 0, "json")).getParent()
        return sorted(int(n[:-5]) for f in self._fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json")) if self._fs.exists(at) else []

    def acquire(self, scope: str, owner: str, now: datetime, stale_seconds: float = 1800) -> Lease:
        """A lease with the next token. While the last holder's is neither released nor ``stale_seconds`` without a sign of life, it is refused (``Rival``)."""
        last = max(self._tokens(scope), default=0)
        if last:
            seen = self._read(self._lease(scope, last, "seen" if self._fs.exists(self._at(self._lease(scope, last, "seen"))) else "json"))
            if not seen["released"] and datetime.fromisoformat(seen["at"]) >= now - timedelta(seconds=stale_seconds):
                raise Rival(f"{seen['owner']} holds the lease on {scope}")
        lease = Lease(scope, last + 1, owner)
        try:
            self._create(self._lease(scope, lease.token, "json"), self._sign(lease, now))
        except Moved as error:
            raise Rival(f"another process has just taken the lease on {scope}") from error

        def fence(before: dict) -> dict | None:
            if before.get("fences", {}).get(scope, 0) > lease.token:
                raise TakenOver(f"the lease on {scope} has gone from {owner} to another holder")
            return {**before, "fences": {**before.get("fences", {}), scope: lease.token}}

        self.commit(fence)
        return lease

    @staticmethod
    def _sign(lease: Lease, now: datetime, released: bool = False) -> bytes:
        return json.dumps({"owner": lease.owner, "at": now.isoformat(), "released": released}).encode()

    def renew(self, lease: Lease, now: datetime) -> None:
        """A sign of life."""
        self._put(self._lease(lease.scope, lease.token, "seen"), self._sign(lease, now))

    def release(self, lease: Lease, now: datetime) -> None:
        self._put(self._lease(lease.scope, lease.token, "seen"), self._sign(lease, now, True))

    def _put(self, path: str, data: bytes) -> None:
        """A file with all its content in place of another."""
        self._create(path, data, replace=True)

    def _create(self, path: str, data: bytes, replace: bool = False) -> None:
        """A file with all its content, or an error if there is one already."""
        draft, file = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._at(path)
        out = self._fs.create(draft, False)
        out.write(bytearray(data))
        out.close()
        self._fs.mkdirs(file.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, int(replace))
        if replace:
            options[0] = kind.OVERWRITE
        try:
            context.rename(draft, file, options)  # refuses a target that exists, unless it is to be replaced
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(file):
                raise Moved(f"another writer has made {path}") from error
            raise

    @staticmethod
    def _paths(manifest: dict) -> set[str]:
        tables = manifest["tables"].values()
        segments = [s for t in tables for s in t["segments"]]
        parts = [p for s in segments for p in (s["writes"], s["deletes"], s.get("first"))]
        added = [p for e in (*tables, *segments) for p in e.get("added", [])]
        postings = [p for t in tables for p in t.get("postings", [])]
        return {p for p in (*(t["base"] for t in tables), *parts, *added, *postings, manifest.get("postings")) if p}

    def _mapping(self, name: str) -> dict[str, str] | None:
        """How the configured fields of a table are analyzed and placed, which its documents and postings follow; None for tables that aren't configured. Weights are no part of it."""
        table = self.config.table(name)
        return table and {f.name: f.resolved_analyzer.name + " in the snippet" * f.snippet + " with label" * f.include_label for f in table.indexed_fields}

    def _differing(self, manifest: dict) -> list[tuple[str, str, str | None, str | None]]:
        out = []
        for name, entry in sorted(manifest["tables"].items()):
            stored, now = entry.get("fields"), self._mapping(name)
            if stored is not None and now is not None:
                out += [(name, f, stored.get(f), now.get(f)) for f in sorted({*stored, *now}) if stored.get(f) != now.get(f)]
        return out

    def mapping_differences(self) -> DataFrame:
        """Fields that stored tables were built with in another way than they are configured now: table_name, field_name, stored, configured (null: not at all)."""
        return self.spark.createDataFrame(self._differing(self.manifest()), "table_name string, field_name string, stored string, configured string")

    def needs_rebuild(self) -> bool:
        """Whether the live index was written by an older layout or with other fields."""
        manifest = self.manifest()
        return manifest["mapping"] < MAPPING_VERSION or bool(self._differing(manifest))

    def exists(self) -> bool:
        return bool(self.manifest()["tables"])

    # Reading.

    def _part(self, path: str, owner: dict) -> DataFrame:
        """Stored documents with the values of fields that were added to the table since they were written (``owner["added"]``)."""
        rows = self.spark.read.parquet(path)
        for added in owner.get("added", []):
            values = self.spark.read.parquet(added).select("document_id", *[F.col(m).alias(f"__{m}") for m in MAPS.values()])
            rows = rows.join(values, "document_id", "left").withColumns({m: self._with_added(m) for m in MAPS.values()}).drop(*(f"__{m}" for m in MAPS.values()))
        return rows

    @staticmethod
    def _with_added(name: str) -> Column:
        """A map of values with the entries that were added to it; a document's own entry counts."""
        own, more = F.col(name), F.col(f"__{name}")
        both = F.map_concat(own, F.map_filter(more, lambda k, _: ~F.array_contains(F.map_keys(own), k)))
        return F.when(more.isNull(), own).when(own.isNull(), more).otherwise(both)

    def _segments(self, segments: list[dict]) -> tuple[DataFrame | None, DataFrame | None]:
        """All writes of segments with their place (__segment, seq), and per deleted document the place of the last delete, which holds for the writes up to it."""
        writes = [self._part(s["writes"], s).withColumn("__segment", F.lit(2 * i + 1)) for i, s in enumerate(segments) if s["writes"]]
        deletes = [self.spark.read.parquet(s[kind]).withColumn("__segment", F.lit(2 * i + late)) for i, s in enumerate(segments) for kind, late in (("first", 0), ("deletes", 1)) if s.get(kind)]
        gone = union_documents(deletes).groupBy("document_id").agg(F.max("__segment").alias("__gone")) if deletes else None
        return (union_documents(writes) if writes else None), gone

    def _touched(self, entry: dict) -> DataFrame | None:
        """Ids that the segments of a table name."""
        ids = [s[kind] for s in entry["segments"] for kind in ("first", "writes", "deletes") if s.get(kind)]
        return reduce(DataFrame.union, [self.spark.read.parquet(p).select("document_id") for p in ids]).distinct() if ids else None

    @staticmethod
    def _not_deleted(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        return rows if gone is None else rows.join(gone, "document_id", "left").where("__gone is null or __segment > __gone").drop("__gone")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        """One order over all segments: a batch's own order within it."""
        return resolve_versions(rows.withColumn("seq", F.struct("__segment", "seq")).drop("__segment")).drop("seq")

    def _changed(self, entry: dict) -> DataFrame | None:
        """The live documents among those that the segments of a table name; versions are compared with the base's."""
        writes, gone = self._segments(entry["segments"])
        if writes is None:
            return None
        rows = writes
        if entry["base"]:
            base = self._part(entry["base"], entry).join(self._touched(entry), "document_id", "left_semi")
            rows = base.withColumns({"seq": F.lit(-1).cast("long"), "__segment": F.lit(-1)}).unionByName(writes, allowMissingColumns=True)
        return self._last(self._not_deleted(rows, gone))

    def _live(self, entry: dict) -> DataFrame:
        changed, touched = self._changed(entry), self._touched(entry)
        if not entry["base"]:
            return changed
        base = self._part(entry["base"], entry)
        kept = base if touched is None else base.join(touched, "document_id", "left_anti")
        return kept if changed is None else kept.unionByName(changed, allowMissingColumns=True)

    def documents(self, manifest: dict | None = None) -> DataFrame | None:
        """The live documents; None for an empty index."""
        found = (manifest or self.manifest())["tables"]
        return union_documents([self._live(entry) for _, entry in sorted(found.items())]) if found else None

    def get(self, ids: DataFrame) -> DataFrame:
        """Documents of the ids (document_id) given."""
        return self.documents().join(ids, "document_id", "left_semi")

    def count(self) -> DataFrame:
        return self.documents().groupBy("source_table").count()

    def hits(self, query: Plan, tables: list[TableConfig]) -> DataFrame:
        """Ranked hits of a plan: from the bases' postings and a scan of the segments, or by a scan of all where there are no postings. Tables whose stored fields are others are refused (``MappingChanged``), as their clauses would match nothing."""
        manifest = self.manifest()
        if wrong := sorted({d[0] for d in self._differing(manifest)} & {t.name for t in tables}):
            raise MappingChanged(f"{', '.join(wrong)}: stored with other fields than configured")
        entries = list(manifest["tables"].values())
        stored = [e for e in entries if self._has_postings(e)]
        if not stored:
            found = self.documents(manifest)
            return score(empty_documents(self.spark) if found is None else found, query, tables)
        scanned = [c for c in (self._changed(e) if e in stored else self._live(e) for e in entries) if c is not None]
        words = self._postings_of(stored, "words", SCHEMA)
        return score_postings(words, self._statistics(stored), query, tables, union_documents(scanned) if scanned else None, self._all_touched(stored))

    def _has_postings(self, entry: dict) -> bool:
        """Whether postings of this layout are stored for a table's base."""
        runs = entry.get("postings", [])
        return bool(runs) and all(self._fs.exists(self._at(f"{r}/lengths")) for r in runs)

    def _postings_of(self, entries: list[dict], kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{r}/{kind}" for e in entries for r in e["postings"]])

    def _all_touched(self, entries: list[dict]) -> DataFrame | None:
        touched = [t for t in map(self._touched, entries) if t is not None]
        return reduce(DataFrame.union, touched) if touched else None

    def _statistics(self, entries: list[dict]) -> DataFrame:
        """The stored sums of the paths without those of documents whose postings no longer count. They are kept for the next search of the same tables: a row for each path."""
        key = json.dumps([[e["postings"], e["segments"]] for e in entries])
        if self._net[0] != key:
            sums = self._postings_of(entries, "statistics", STATISTICS).groupBy("path").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            touched = self._all_touched(entries)
            if touched is not None:
                gone = self._postings_of(entries, "lengths", LENGTHS).join(touched, "document_id", "left_semi")
                sums = without(sums, lengths_summed(gone))
            self._net = key, sums.collect()
        return self.spark.createDataFrame(self._net[1], STATISTICS)

    def search(self, term: str, tables: list[str] | None = None) -> DataFrame:
        """Ranked hits of a term."""
        chosen = [t for t in self.config.tables if (tables is None or t.name in tables) and t.enabled]
        return self.hits(plan(term, chosen), chosen)

    # Writing.

    def _write(self, documents: DataFrame, table: str) -> str:
        path = f"{self.path}/tables/{table}/{uuid.uuid4().hex}"
        documents.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        return path

    def _postings(self, tables: dict[str, dict]) -> str:
        """Postings of the live documents of tables, as new files."""
        return self._write_postings(self.documents({"tables": tables}))

    def _write_postings(self, documents: DataFrame, paths: list[Path] | None = None) -> str:
        base = f"{self.path}/postings/{uuid.uuid4().hex}"
        before = self.spark.conf.get(WRITERS, None)
        self.spark.conf.set(WRITERS, "4")  # both kinds' files are open at once; else, and where there are as many kinds, Spark sorts all rows by kind
        try:
            postings_and_lengths(documents, list(self.config.tables), paths).write.partitionBy("kind").parquet(f"{base}/both")
        finally:
            self.spark.conf.unset(WRITERS) if before is None else self.spark.conf.set(WRITERS, before)
        for kind, name in enumerate(("words", "lengths")):  # a kind without rows has no folder
            written, place = self._at(f"{base}/both/kind={kind}"), self._at(f"{base}/{name}")
            if not (self._fs.rename(written, place) if self._fs.exists(written) else self._fs.mkdirs(place)):
                raise OSError(f"{base}/{name} could not be made")
        self._discard(f"{base}/both")
        lengths_summed(self.spark.read.schema(LENGTHS).parquet(f"{base}/lengths")).coalesce(1).write.parquet(f"{base}/statistics")
        return base

    def _bytes(self, *paths: str | None) -> int:
        return sum(self._fs.getContentSummary(self._at(p)).getLength() for p in paths if p)

    def _discard(self, *paths: str | None) -> None:
        for path in filter(None, paths):
            self._fs.delete(self._at(path), True)

    def _hold(self) -> str:
        """While this file is there, the segments that there are now aren't merged, so that a replacement of their table doesn't meet others at its end."""
        path = f"{self.path}/holds/{uuid.uuid4().hex}.json"
        self._create(path, b"{}")
        return path

    def _held(self) -> bool:
        at = self._at(f"{self.path}/holds")
        return self._fs.exists(at) and any(f.getModificationTime() / 1000 > time.time() - HOLD_SECONDS for f in self._fs.listStatus(at))

    def draft(self) -> Draft:
        """Begins a new generation of tables."""
        return Draft(self)

    def rebuild(self, built: dict[str, DataFrame], created_at: str | None = None, lease: Lease | None = None) -> dict:
        """A new generation of all tables, swapped in when it is complete; segments that were added meanwhile stay."""
        draft = self.draft()
        try:
            for name, documents in built.items():
                draft.add(name, documents)
            return draft.finish(created_at, lease)
        except Exception:
            draft.discard()
            raise

    def apply(self, table: str, writes: DataFrame | None = None, deleted: DataFrame | None = None, once: tuple[str, int] | None = None) -> dict:
        """A batch of one table as a new segment: versioned writes (with ``seq``), then deletes (document_id).

        ``once`` (the name of a row of batches, the number of this one) is committed with the segment: a batch whose number isn't
        above the last one committed under its name changes nothing.
        """
        before = self.manifest()
        done = lambda manifest: once is not None and manifest.get("batches", {}).get(once[0], -1) >= once[1]
        if writes is None and deleted is None or done(before):
            return before
        segment = {
            "writes": None if writes is None else self._write(writes, f"{table}/writes"),
            "deletes": None if deleted is None else self._write(deleted.select("document_id").distinct(), f"{table}/deletes"),
        }
        paths, used = tuple(segment.values()), False
        segment["bytes"] = self._bytes(*paths)

        def add(before: dict) -> dict | None:
            nonlocal used
            entry = before["tables"].get(table, {"base": None, "segments": [], "fields": self._mapping(table)})
            used = not done(before) and bool(entry["base"] or entry["segments"] or writes is not None)
            if not used:
                return None
            batches = {**before.get("batches", {}), **({once[0]: once[1]} if once else {})}
            return {**before, "batches": batches, "tables": {**before["tables"], table: {**entry, "segments": [*entry["segments"], segment]}}}

        try:
            return self.commit(add)
        except Exception:
            used = False
            raise
        finally:
            if not used:
                self._discard(*paths)

    def segments(self) -> dict[str, int]:
        """How many segments each table has; many of them make reading slow and compaction due."""
        return {name: len(entry["segments"]) for name, entry in self.manifest()["tables"].items()}

    def merge_segments(self, table: str, lease: Lease | None = None) -> dict:
        """Folds a table's newest segments into one where those behind a segment hold ``GROWTH`` times its bytes.

        Whatever is merged becomes several times larger, so a row of n batches leaves some log n segments and writes each batch
        some log n times, and neither the base nor its postings are read. A merged segment deletes first and writes then: it
        holds the last write of each document, and takes the stored one away where a write without a version has replaced it.
        While a rebuild, a compaction or an extension is under way, nothing is merged.
        """
        for _ in range(COMPACTIONS):
            begun = self.manifest()
            if self._held():
                return begun
            entry = begun["tables"].get(table, {"segments": []})
            segments = entry["segments"]
            size = [s.get("bytes", 0) for s in segments]
            at = next((i for i in range(len(segments) - 1) if sum(size[i + 1 :]) >= GROWTH * size[i]), None)
            if at is None:
                return begun
            # Rows of segments with other added fields are extended by other files; only those that are alike are merged.
            while at < len(segments) and segments[at].get("added") != segments[-1].get("added"):
                at += 1
            old = segments[at:]
            if len(old) < 2:
                return begun
            writes, gone = self._segments([{**s, "added": []} for s in old])
            first = [gone.select("document_id")] if gone is not None else []
            if writes is not None:
                first.append(writes.where("version is null").select("document_id"))
            new = {
                "writes": None if writes is None else self._write(self._last(self._not_deleted(writes, gone)).withColumn("seq", F.lit(0).cast("long")), f"{table}/writes"),
                "deletes": None,
                "first": self._write(reduce(DataFrame.union, first).distinct(), f"{table}/deletes"),
            }
            paths = tuple(new.values())
            new |= {"bytes": self._bytes(*paths)} | ({"added": old[0]["added"]} if "added" in old[0] else {})

            def replace(before: dict) -> dict:
                now = before["tables"].get(table, {"base": None, "segments": []})
                if now["base"] != entry["base"] or now["segments"][at : len(segments)] != old:
                    raise Moved(f"{table} was replaced or compacted meanwhile")
                return {**before, "tables": {**before["tables"], table: {**now, "segments": [*now["segments"][:at], new, *now["segments"][len(segments) :]]}}}

            try:
                return self.commit(replace, lease)
            except Moved:
                self._discard(*paths)
            except Exception:
                self._discard(*paths)
                raise
        raise Moved(f"{table} was replaced during each of {COMPACTIONS} merges")

    def compact(self, lease: Lease | None = None, tables: list[str] | None = None) -> dict:
        """New bases and postings for tables that have segments or added fields. Each table is committed by itself and no other is read or written. Segments added meanwhile stay behind; if a table was replaced meanwhile, it is done again."""
        hold = self._hold()
        try:
            for name in sorted(self.manifest()["tables"]) if tables is None else tables:
                self._compact(name, lease)
            return self.commit(lambda _: None, lease)
        finally:
            self._discard(hold)

    def _compact(self, table: str, lease: Lease | None) -> None:
        for _ in range(COMPACTIONS):
            old, base, postings = self.manifest()["tables"].get(table), None, None
            if old is None or not (old["segments"] or old.get("added") or (old["base"] and not self._has_postings(old))):
                return

            def replace(before: dict) -> dict:
                now, n = before["tables"].get(table), len(old["segments"])
                if now is None:
                    raise Moved(f"{table} was dropped meanwhile")
                if now["base"] != old["base"] or now.get("added") != old.get("added") or now["segments"][:n] != old["segments"]:
                    raise Moved(f"{table} was replaced meanwhile")
                return {**before, "tables": {**before["tables"], table: {**new, "fields": now.get("fields"), "segments": now["segments"][n:]}}}

            try:
                base = self._write(self._live(old), table)
                postings = self._postings({table: {"base": base, "segments": []}})
                new = {"base": base, "postings": [postings]}
                self.commit(replace, lease)
                return
            except Moved:
                self._discard(base, postings)
            except Exception:
                self._discard(base, postings)
                raise
        raise Moved(f"{table} was replaced during each of {COMPACTIONS} compactions")

    def extend(self, documents: DataFrame, table: str, lease: Lease | None = None) -> dict:
        """Adds the configured fields that a stored table lacks, from documents of its rows as they are built now. Only the new fields' values and postings are written.

        The fields must be searched by their own clauses alone: one that is part of the snippet or of what a hit shows needs a
        rebuild, and so does any other difference (``MappingChanged``). Documents that segments bring later have the fields
        already. Documents whose rows are gone keep none.
        """
        hold = self._hold()
        try:
            return self._extend(documents, table, lease)
        finally:
            self._discard(hold)

    def _extend(self, documents: DataFrame, table: str, lease: Lease | None) -> dict:
        config = self.config.table(table)
        for _ in range(COMPACTIONS):
            entry = self.manifest()["tables"][table]
            stored, now = entry.get("fields") or {}, self._mapping(table) or {}
            new = [f for f in config.indexed_fields if f.name not in stored] if config else []
            if {**now, **stored} != now or any(f.snippet or f.role not in OWN_ROLES for f in new):
                raise MappingChanged(f"{table}: fields were changed or removed, or added to what all tables are searched by or a hit shows")
            if not new:
                return self.manifest()
            names = [f.name for f in new]
            only = {m: F.map_filter(m, lambda k, _: k.isin(*names)) for m in MAPS.values()}
            held = reduce(lambda a, b: a | b, [F.coalesce(F.size(m) > 0, F.lit(False)) for m in MAPS.values()])
            values = postings = None
            try:
                values = self._write(documents.select("document_id", *[c.alias(m) for m, c in only.items()]).where(held), f"{table}/added")
                if entry["base"]:
                    hits = self.spark.read.parquet(entry["base"]).select(*HIT)
                    found = hits.join(self.spark.read.parquet(values), "document_id").withColumn("searchable_text", F.lit(None).cast("string"))
                    postings = self._write_postings(found, [Path(f.name, f.resolved_analyzer) for f in new])

                def add(before: dict) -> dict:
                    live, n = before["tables"].get(table), len(entry["segments"])
                    if live is None or live["base"] != entry["base"] or live.get("fields") != entry.get("fields") or live["segments"][:n] != entry["segments"]:
                        raise Moved(f"{table} was replaced meanwhile")
                    older = [{**s, "added": [*s.get("added", []), values]} for s in live["segments"][:n]]
                    grown = {**live, "fields": now, "segments": [*older, *live["segments"][n:]]}
                    if entry["base"]:
                        grown |= {"added": [*live.get("added", []), values], "postings": [*live.get("postings", []), postings] if live.get("postings") else []}
                    return {**before, "tables": {**before["tables"], table: grown}}

                return self.commit(add, lease)
            except Moved:
                self._discard(values, postings)
            except Exception:
                self._discard(values, postings)
                raise
        raise Moved(f"{table} was replaced during each of {COMPACTIONS} extensions")

    def vacuum(self) -> list[str]:
        """Deletes folders that no manifest names and nobody has written to for ``retain`` seconds: what processes that died have left. Returns their paths."""
        manifest, gone = self.manifest(), []
        kept = {self._at(p).toUri().getPath() for p in (*self._paths(manifest), *(r["path"] for r in manifest["retired"]))}
        for pattern in ("tables/*/*", "tables/*/writes/*", "tables/*/deletes/*", "tables/*/added/*", "postings/*", "drafts/*"):
            for found in self._fs.globStatus(self._at(f"{self.path}/{pattern}")) or []:
                path = found.getPath()
                place = path.toUri().getPath()
                if place in kept or any(k.startswith(f"{place}/") for k in kept) or pattern == "tables/*/*" and path.getName() in ("writes", "deletes", "added"):
                    continue
                if self._last_written(path) <= time.time() - self.retain:
                    self._fs.delete(path, True)
                    gone.append(place)
        for found in self._fs.globStatus(self._at(f"{self.path}/holds/*")) or []:
            if found.getModificationTime() / 1000 <= time.time() - HOLD_SECONDS:
                self._fs.delete(found.getPath(), False)
                gone.append(found.getPath().toUri().getPath())
        return gone

    def _last_written(self, path) -> float:
        """When the newest file of a folder was written."""
        newest, files = self._fs.getFileStatus(path).getModificationTime(), self._fs.listFiles(path, True)
        while files.hasNext():
            newest = max(newest, files.next().getModificationTime())
        return newest / 1000

    def drop_table(self, table: str) -> dict:
        """Without a table and its postings; the others' stay as they are."""

        def drop(before: dict) -> dict | None:
            if table not in before["tables"]:
                return None
            return {**before, "tables": {k: v for k, v in before["tables"].items() if k != table}}

        return self.commit(drop)

    def schema_differences(self) -> dict[str, list[str]]:
        """Per stored table what of its stored layout isn't that of documents built now: columns that are missing, added or of another type."""
        expected = {f.name: f.dataType.simpleString() for f in empty_documents(self.spark).schema}
        out = {}
        for name, entry in self.manifest()["tables"].items():
            stored = {f.name: f.dataType.simpleString() for f in self._live(entry).schema}
            wrong = [f"{c}: {stored.get(c, 'missing')} for {expected.get(c, 'nothing')}" for c in sorted({*stored, *expected}) if stored.get(c) != expected.get(c)]
            if wrong:
                out[name] = wrong
        return out


class Draft:
    """A generation of tables that is being written beside the live one."""

    def __init__(self, index: Index):
        self.index, self.hold, self.tables = index, index._hold(), {}
        self.begun = index.manifest()

    def add(self, name: str, documents: DataFrame) -> None:
        self.tables[name] = {"base": self.index._write(documents, name), "segments": [], "fields": self.index._mapping(name), "postings": []}

    def finish(self, created_at: str | None = None, lease: Lease | None = None) -> dict:
        """Swaps the tables in. A table's segments that were added since the beginning stay behind its new base; tables that are new since then stay as they are."""
        try:
            for name, entry in self.tables.items():
                entry["postings"] = [self.index._postings({name: {"base": entry["base"], "segments": []}})]
            return self._swapped(created_at, lease)
        finally:
            self.index._discard(self.hold)

    def _swapped(self, created_at: str | None, lease: Lease | None) -> dict:
        def replace(before: dict) -> dict:
            now = {}
            for name, entry in self.tables.items():
                old, live = (m["tables"].get(name, {"base": None, "segments": []}) for m in (self.begun, before))
                if live["base"] != old["base"]:
                    raise Moved(f"{name} was replaced meanwhile")
                now[name] = {**entry, "segments": self._later(name, old["segments"], live["segments"])}
            new = {n: e for n, e in before["tables"].items() if n not in self.begun["tables"] and n not in now}
            return {**{k: v for k, v in before.items() if k not in ("postings", "dropped")}, "tables": now | new, "created_at": created_at}

        return self.index.commit(replace, lease)

    @staticmethod
    def _later(name: str, old: list[dict], live: list[dict]) -> list[dict]:
        """Segments that were added since the beginning."""
        if live[: len(old)] == old:
            return live[len(old) :]
        raise Moved(f"segments of {name} were merged meanwhile")

    def discard(self) -> None:
        """Deletes what was written."""
        self.index._discard(self.hold, *(e["base"] for e in self.tables.values()), *(p for e in self.tables.values() for p in e["postings"]))
