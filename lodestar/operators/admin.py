"""Configuration as data: priming from code, effective fields, edits, tombstones, processes.

Configuration tables are small, but everything is a plan over DataFrames, so
that rules read the same for one table or for many thousands.

Tables: ``code_tables`` (table_name, enabled, interval_minutes,
timestamp_field), ``code_fields`` (table_name, field_name, weight,
include_label, position), ``index_rows`` (table_name, enabled,
interval_minutes, timestamp_field, owner_edited, status, real_time_errors),
``settings`` (paused, paused_at, paused_by, pause_reason, last_primed_at,
last_priming_summary, last_priming_new_tables; one row or none), ``field_rows``
(table_name, field_name, weight, role, analyzer, in_snippet, include_label,
sort_order, owner_edited), ``tombstones`` (table_name, field_name; a null
field stands for the whole table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Analyzer, DocumentsChoice, Role
from .maintain import BUILDING_STATES, first_wins


def live_code(code_tables: DataFrame, code_fields: DataFrame, tombstones: DataFrame, indexable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code tables and fields but those that an owner removed or the rules refuse (``indexable``: table_name, field_name)."""
    gone = tombstones.where("field_name is null").select("table_name")
    tables = code_tables.join(gone, "table_name", "left_anti")
    fields = code_fields.join(gone, "table_name", "left_anti").join(tombstones.where("field_name is not null").select("table_name", "field_name"), ["table_name", "field_name"], "left_anti")
    return tables, fields.join(indexable.select("table_name", "field_name"), ["table_name", "field_name"], "left_semi")


def prime_tables(code_tables: DataFrame, index_rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What priming does with each code table: skip (tombstone), insert, update (interval or timestamp follow the code) or keep."""
    gone = tombstones.where("field_name is null").select("table_name", F.lit(True).alias("gone"))
    rows = index_rows.select("table_name", F.col("interval_minutes").alias("__i"), F.col("timestamp_field").alias("__t"), F.col("owner_edited").alias("__o"), F.lit(True).alias("known"))
    found = code_tables.join(gone, "table_name", "left").join(rows, "table_name", "left")
    differs = ~F.col("interval_minutes").eqNullSafe(F.col("__i")) | ~F.col("timestamp_field").eqNullSafe(F.col("__t"))
    step = F.when(F.col("gone"), "skip").when(F.col("known").isNull(), "insert").when(differs & ~F.coalesce("__o", F.lit(False)), "update").otherwise("keep")
    status = F.when(step == "insert", F.when(F.col("enabled"), "PENDING_BUILD").otherwise("ACTIVE"))
    return found.select("table_name", step.alias("step"), status.alias("new_status"))


def prime_fields(code_fields: DataFrame, field_rows: DataFrame) -> DataFrame:
    """What priming does with each live code field: insert (role BODY, sort order by tens), update (weight or label follow the code) or keep. Nothing is deleted."""
    rows = field_rows.select("table_name", "field_name", F.col("weight").alias("__w"), F.col("include_label").alias("__l"), F.col("owner_edited").alias("__o"), F.lit(True).alias("known"))
    found = code_fields.join(rows, ["table_name", "field_name"], "left")
    differs = ~F.col("weight").eqNullSafe(F.col("__w")) | ~F.col("include_label").eqNullSafe(F.col("__l"))
    step = F.when(F.col("known").isNull(), "insert").when(differs & ~F.coalesce("__o", F.lit(False)), "update").otherwise("keep")
    return found.select("table_name", "field_name", step.alias("step"), F.when(F.col("known").isNull(), (F.col("position") + 1) * 10).alias("sort_order"))


def rebuilds_after_priming(index_rows: DataFrame, primed: DataFrame) -> DataFrame:
    """Tables to build again as priming changed their fields: enabled and not yet queued or being built."""
    changed = primed.where("step <> 'keep'").select("table_name").distinct()
    return index_rows.join(changed, "table_name", "left_semi").where(F.col("enabled") & ~F.col("status").isin(*BUILDING_STATES)).select("table_name")


def priming_report(code_fields: DataFrame, tombstones: DataFrame, tables: DataFrame, fields: DataFrame, rebuilds: DataFrame, labels: DataFrame) -> DataFrame:
    """One row that sums up a priming: what ``prime_tables``, ``prime_fields`` and ``rebuilds_after_priming`` gave, and the
    code fields that a tombstone holds back. Tables appear by their label (else name), sorted."""
    gone = tombstones.where("field_name is null").select("table_name")
    buried = code_fields.join(gone, "table_name", "left_anti").join(tombstones.select("table_name", "field_name"), ["table_name", "field_name"], "left_semi")
    marks = (
        tables.select("table_name", F.concat(F.lit("table "), "step").alias("mark"))
        .union(fields.select("table_name", F.concat(F.lit("field "), "step")))
        .union(buried.select("table_name", F.lit("field skip")))
        .union(rebuilds.select("table_name", F.lit("rebuild")))
    )
    named = marks.join(labels.select("table_name", "label").dropDuplicates(["table_name"]), "table_name", "left").withColumn("label", F.coalesce("label", "table_name"))
    is_ = lambda mark: F.col("mark") == mark
    sums = named.agg(
        F.array_sort(F.collect_list(F.when(is_("table insert"), F.col("label")))).alias("new"),
        F.count_if(is_("field insert")).alias("new_fields"),
        F.count_if(is_("field update")).alias("updated_fields"),
        F.count_if(is_("table update")).alias("updated_tables"),
        F.array_sort(F.collect_list(F.when(is_("rebuild"), F.col("label")))).alias("again"),
        F.count_if(F.col("mark").isin("table skip", "field skip")).alias("skipped"),
    )
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))
    n_new, n_fields, n_updated, n_tables = F.size("new").cast("long"), F.col("new_fields"), F.col("updated_fields"), F.col("updated_tables")
    parts = F.concat_ws(
        "; ",
        F.when(n_new > 0, F.concat(F.lit("New: "), plural(n_new, "table"), F.lit(" added and building ("), F.array_join("new", ", "), F.lit(")"))),
        F.when((n_fields > 0) | (n_updated > 0), F.concat(plural(n_fields, "field"), F.lit(" added, "), n_updated.cast("string"), F.lit(" updated from code defaults"))),
        F.when(F.size("again") > 0, F.concat(F.lit("rebuilding "), F.array_join("again", ", "))),
        F.when(n_tables > 0, F.concat(plural(n_tables, "index setting"), F.lit(" updated from code defaults"))),
    )
    summary = F.when(parts == "", "No changes: the records match the code defaults.").otherwise(F.concat(parts, F.lit(".")))
    return sums.select(n_new.alias("new_tables"), "new_fields", "updated_fields", "updated_tables", F.size("again").cast("long").alias("rebuilds"), "skipped", (parts != "").alias("has_changes"), summary.alias("summary"))


def settings_after_priming(settings: DataFrame, report: DataFrame, at: Column) -> DataFrame:
    """The row of settings after a priming: always its time, its summary only if something changed or the row is new."""
    told = report.select(F.col("has_changes").alias("__changed"), F.col("summary").alias("__summary"), F.col("new_tables").alias("__new"))
    found = told.join(settings.limit(1).withColumn("__known", F.lit(True)), F.lit(True), "left")  # one row beside one row
    tell = F.col("__changed") | F.col("__known").isNull()
    new = {
        "paused": F.coalesce("paused", F.lit(False)),
        "last_primed_at": at,
        "last_priming_summary": F.when(tell, F.col("__summary")).otherwise(F.col("last_priming_summary")),
        "last_priming_new_tables": F.when(tell, F.col("__new")).otherwise(F.col("last_priming_new_tables")),
    }
    return found.withColumns(new).select(*settings.columns)


def ensure_index_rows(index_rows: DataFrame, code_tables: DataFrame, configured: bool = False) -> DataFrame:
    """Index rows with one for each code table that lacks it. Hosts whose configuration is in tables (``configured``) get theirs
    by priming only, so that a removed table isn't made again."""
    if configured:
        return index_rows
    missing = code_tables.dropDuplicates(["table_name"]).join(index_rows, "table_name", "left_anti")
    rows = missing.select("table_name", "enabled", "interval_minutes", "timestamp_field", F.lit("ACTIVE").alias("status"), F.lit(0).cast("long").alias("real_time_errors"))
    return index_rows.unionByName(rows, allowMissingColumns=True)


def update_index_rows(index_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Index rows with the bookkeeping of ``changes`` (table_name, at, and columns of theirs), which marks nothing as edited.

    Of a table's changes the newest counts (of equal times the largest values) with all its values, nulls too. Changes of
    tables without a row, and columns that rows don't have, count nowhere.
    """
    new = [c for c in changes.columns if c in index_rows.columns and c != "table_name"]
    values = F.struct(*[F.col(c).cast(index_rows.schema[c].dataType).alias(c) for c in new])
    last = changes.groupBy("table_name").agg(F.max_by(values, F.struct("at", values)).alias("__new"))
    with_new = index_rows.join(last, "table_name", "left")
    return with_new.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in index_rows.columns])


def count_errors(index_rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Index rows with their tables' failed events (a row each, table_name) added to ``real_time_errors``; others' events count nowhere."""
    new = failed.groupBy("table_name").agg(F.count("*").alias("__n"))
    total = F.coalesce("real_time_errors", F.lit(0)).cast("long") + F.coalesce("__n", F.lit(0))
    return index_rows.join(new, "table_name", "left").withColumn("real_time_errors", total).select(*index_rows.columns)


def effective_fields(field_rows: DataFrame, indexable: DataFrame) -> DataFrame:
    """The fields that are in force, in order: rows the rules refuse are dropped, of a repeated field the first counts, missing weights are 1."""
    usable = field_rows.join(indexable.select("table_name", "field_name"), ["table_name", "field_name"], "left_semi")
    order = [F.col("sort_order").asc_nulls_last(), F.col("row_id")]
    once = first_wins(usable, ["table_name", "field_name"], order)
    place = F.row_number().over(Window.partitionBy("table_name").orderBy(*order))
    role = F.when(F.col("role").isin(*[r.name for r in Role]), F.col("role")).otherwise(Role.BODY.name)
    analyzer = F.when(F.col("analyzer").isin(*[a.name for a in Analyzer]), F.col("analyzer"))
    return once.select("table_name", "field_name", place.alias("place"), F.coalesce("weight", F.lit(1)).alias("weight"), role.alias("role"), analyzer.alias("analyzer"), "in_snippet", F.coalesce("include_label", F.lit(False)).alias("include_label"))


def why_edit_refused() -> Column:
    """The first rule that an edited field row breaks; null if none."""
    return (
        F.when(F.coalesce(F.trim("field_name"), F.lit("")) == "", "a field is required")
        .when(F.col("weight").isNotNull() & ~F.col("weight").between(1, 1000), "weight must be from 1 to 1000")
        .when(F.col("role").isNotNull() & ~F.col("role").isin(*[r.name for r in Role]), "unknown role")
        .when(F.col("analyzer").isNotNull() & ~F.col("analyzer").isin(*[a.name for a in Analyzer]), "unknown analyzer")
    )


def check_edits(edits: DataFrame, field_rows: DataFrame, system: bool = False) -> DataFrame:
    """Each edited row with the reason it is refused, if any, and whether an owner made it."""
    taken = field_rows.select("table_name", "field_name", F.col("row_id").alias("__other"))
    found = edits.join(taken, ["table_name", "field_name"], "left").groupBy(*edits.columns).agg(F.bool_or(F.coalesce(~F.col("__other").eqNullSafe(F.col("row_id")), F.lit(False)) & F.col("__other").isNotNull()).alias("__twice"))
    reason = F.coalesce(why_edit_refused(), F.when(F.col("__twice"), "the table has this field already"))
    return found.select(*edits.columns, reason.alias("reason"), F.lit(not system).alias("owner_edited"))


def check_index_edits(edits: DataFrame, index_rows: DataFrame, timestamps: DataFrame, system: bool = False) -> DataFrame:
    """Each edited index row (table_name, enabled, interval_minutes, timestamp_field) with the reason it is refused, if any, and
    what becomes of its mark and status.

    ``timestamps`` are the date-time fields (table_name, field_name). An edit that changes nothing, or comes from the system,
    isn't checked and marks nothing; blank and null are the same; a null ``enabled`` means enabled. Switching on queues a build
    unless one runs. Edits of unknown tables give no row.
    """
    blank = lambda c: F.when(F.trim(c) != "", c)
    old = index_rows.select("table_name", *[F.col(c).alias("__" + c) for c in ("enabled", "interval_minutes", "timestamp_field", "owner_edited", "status")])
    times = timestamps.select("table_name", F.col("field_name").alias("timestamp_field"), F.lit(True).alias("__time")).distinct()
    found = edits.join(old, "table_name").join(times, ["table_name", "timestamp_field"], "left")
    same = F.col("enabled").eqNullSafe(F.col("__enabled")) & F.col("interval_minutes").eqNullSafe(F.col("__interval_minutes"))
    changed = ~(same & blank(F.col("timestamp_field")).eqNullSafe(blank(F.col("__timestamp_field")))) & F.lit(not system)
    wrong = F.concat_ws(
        "; ",
        F.when(blank(F.col("timestamp_field")).isNotNull() & F.col("__time").isNull(), "the timestamp must be a date-time field of the table"),
        F.when(F.col("interval_minutes") < 0, "the interval must not be negative"),
    )
    reason = F.when(changed & (wrong != ""), wrong)
    taken = changed & reason.isNull()
    on = F.coalesce("enabled", F.lit(True)) & ~F.coalesce("__enabled", F.lit(True)) & ~F.coalesce(F.col("__status").isin("BUILDING", "REBUILDING"), F.lit(False))
    return found.select("table_name", reason.alias("reason"), (F.coalesce("__owner_edited", F.lit(False)) | taken).alias("owner_edited"), F.when(taken & on, "PENDING_BUILD").otherwise(F.col("__status")).alias("status"))


def next_sort_order(field_rows: DataFrame) -> DataFrame:
    return field_rows.groupBy("table_name").agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 10).alias("sort_order"))


def add_tombstones(tombstones: DataFrame, removed: DataFrame) -> DataFrame:
    return tombstones.select("table_name", "field_name").union(removed.select("table_name", "field_name")).distinct()


def clear_tombstones(tombstones: DataFrame, added: DataFrame) -> DataFrame:
    """Tombstones but those of what an owner adds again."""
    back = added.select(F.col("table_name").alias("__t"), F.col("field_name").alias("__f"))
    return tombstones.join(back, F.col("table_name").eqNullSafe(F.col("__t")) & F.col("field_name").eqNullSafe(F.col("__f")), "left_anti")


def parse_fields(rows: DataFrame) -> DataFrame:
    """Recorded fields of index rows, one row each."""
    schema = "array<struct<name:string,weight:int,includeLabel:boolean,role:string,analyzer:string,inSnippet:boolean>>"
    one = rows.select("table_name", F.explode(F.from_json("fields_json", schema)).alias("f"))
    return one.select("table_name", F.col("f.name").alias("field_name"), F.to_json(F.struct("f.weight", "f.includeLabel", "f.role", "f.analyzer", "f.inSnippet")).alias("how"))


def field_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Fields added, removed or changed between what was recorded (table_name, fields_json) and what is configured now."""
    old = parse_fields(recorded).withColumnRenamed("how", "__old")
    new = parse_fields(current).withColumnRenamed("how", "__new")
    found = old.join(new, ["table_name", "field_name"], "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return found.select("table_name", "field_name", change.alias("change")).where("change is not null")


# Processes: each takes the rows it concerns and returns them changed.


def queue(index_rows: DataFrame, names: list[str]) -> DataFrame:
    """Queue builds of tables; those that are queued or being built stay as they are."""
    mine = F.col("table_name").isin(*names) & ~F.col("status").isin(*BUILDING_STATES)
    return index_rows.withColumn("status", F.when(mine, "PENDING_BUILD").otherwise(F.col("status")))


def set_enabled(index_rows: DataFrame, names: list[str], enabled: bool) -> DataFrame:
    """Switch tables on or off as their owner; switching on queues a build."""
    changed = F.col("table_name").isin(*names) & (F.col("enabled") != enabled)
    status = F.when(changed & F.lit(enabled), "PENDING_BUILD").otherwise(F.col("status"))
    return index_rows.withColumns({"status": status, "owner_edited": F.col("owner_edited") | changed, "enabled": F.when(changed, F.lit(enabled)).otherwise(F.col("enabled"))})


def set_paused(settings: DataFrame, paused: bool, at: Column, user: str | None = None, reason: str | None = None) -> DataFrame:
    """Settings paused, with when, by whom and why, or resumed and without stamps (then ``maintain.release_deferred`` is due);
    settings in that state already keep their stamps."""
    change = F.coalesce("paused", F.lit(False)) != paused
    stamps = {"paused_at": at, "paused_by": F.lit(user), "pause_reason": F.lit(reason)}
    new = {c: F.when(change, v if paused else F.lit(None)).otherwise(F.col(c)) for c, v in stamps.items()}
    return settings.withColumns({**new, "paused": F.lit(paused)})


def remove_table(name: str, index_rows: DataFrame, field_rows: DataFrame, events: DataFrame, tombstones: DataFrame, documents: DataFrame, choice: DocumentsChoice = DocumentsChoice.DELETE):
    """Everything of a table goes, and a tombstone keeps code from bringing it back; its documents go or stay."""
    other = F.col("table_name") != name
    spark = index_rows.sparkSession
    grave = spark.createDataFrame([(name, None)], "table_name string, field_name string")
    left = documents if choice is DocumentsChoice.KEEP else documents.where(F.col("source_table") != name)
    return index_rows.where(other), field_rows.where(other), events.where(other), add_tombstones(tombstones, grave), left


def cancel_runs(runs: DataFrame, ids: list[int]) -> DataFrame:
    mine = F.col("run_id").isin(*ids) & (F.col("status") == "RUNNING")
    return runs.withColumn("cancel_requested", F.col("cancel_requested") | mine)


def indexed_choices(index_rows: DataFrame, labels: DataFrame, term: str = "") -> DataFrame:
    """Indexed tables whose id or label holds a term, by label."""
    found = index_rows.select("table_name").join(labels, "table_name")
    hit = F.contains(F.lower("label"), F.lit(term.lower())) | F.contains(F.lower("table_name"), F.lit(term.lower()))
    return found.where(hit).orderBy(F.lower("label"), "table_name")
