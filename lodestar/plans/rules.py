"""Rules over metadata: which fields and tables may be indexed, and the defaults.

Metadata is a DataFrame, one row per field: table_name, field_name, label, type,
ordinal, is_label_field, is_key, is_hidden, is_sensitive, is_personal, is_locked;
and one row per table: table_name, label, is_hidden, is_internal, has_variants,
can_query, can_read. Missing flags count as false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Field types by treatment, tables of the engine itself, of a host's own workings (lower-case, without
# underscores), and names that smell of secrets.
STRING_TYPES = ("STRING", "TEXT", "HTML")
MASKED_TYPES = ("PASSWORD",)
UNSEARCHABLE_TYPES = ("BOOLEAN", "BLOB")
ENGINE_TABLES = ("search_index", "search_index_field", "search_index_run", "search_failed_event", "search_settings", "search_tombstone", "search_event", "search_validation")
SYSTEM_TABLES = (
    "audit", "auditdetail", "audittable", "audituser", "savedview", "savedreport", "sharedsavedview", "sharedsavedreport",
    "scheduledjob", "scheduledjobparameter", "script", "scriptrevision", "scriptrevisionfile", "scriptlog", "scriptlogline",
    "scripttype", "scripttypefilemode", "tabletrigger", "processtrace", "cachedrecord",
)
SECRET_NAMES = r"(?i)(secret|credential|password|passwd|token|api_?key|session|oauth|private_?key)"

DEFAULT_FIELDS = 20
LABEL_WEIGHT = 3


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def is_protected() -> Column:
    return _flag("is_personal") | _flag("is_locked") | _flag("is_sensitive") | F.coalesce(F.col("type").isin(*MASKED_TYPES), F.lit(False))


def why_not_indexable() -> Column:
    """The first rule that keeps a field out of the index; null if none does."""
    return (
        F.when(F.col("field_name").isNull(), "unknown field")
        .when(_flag("is_hidden"), "hidden")
        .when(_flag("is_personal") | _flag("is_locked"), "classified")
        .when(_flag("is_sensitive"), "sensitive")
        .when(F.col("type").isNull(), "no type")
        .when(F.col("type").isin(*MASKED_TYPES), "masked type")
        .when(F.col("type").isin(*UNSEARCHABLE_TYPES), "type not searchable")
    )


def indexable_fields(fields: DataFrame) -> DataFrame:
    return fields.where(why_not_indexable().isNull())


def protection(fields: DataFrame) -> DataFrame:
    """Per table: whether its results need filtering (a protected field), and whether its key is protected."""
    return fields.groupBy("table_name").agg(F.bool_or(is_protected()).alias("filtered"), F.bool_or(is_protected() & _flag("is_key")).alias("protected_key"))


def default_fields(fields: DataFrame, cap: int = DEFAULT_FIELDS) -> DataFrame:
    """Label fields as titles of weight 3, then string fields as bodies of weight 1, at most ``cap`` a table."""
    usable = indexable_fields(fields).where(_flag("is_label_field") | F.col("type").isin(*STRING_TYPES))
    order = Window.partitionBy("table_name").orderBy(_flag("is_label_field").desc(), "ordinal", "field_name")
    ranked = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    title = _flag("is_label_field")
    return ranked.select("table_name", "field_name", F.when(title, "TITLE").otherwise("BODY").alias("role"), F.when(title, LABEL_WEIGHT).otherwise(1).alias("weight"), (F.col("rank") * 10).alias("sort_order"))


def default_timestamps(fields: DataFrame) -> DataFrame:
    """Per table: modify_date if it is a date-time, else the first date-time whose name speaks of modification."""
    name = F.lower("field_name")
    usable = fields.where("type = 'DATE_TIME'").where(F.col("field_name").isin("modify_date", "modifyDate") | F.contains(name, F.lit("modif")) | F.contains(name, F.lit("updat")))
    exact = F.col("field_name").isin("modify_date", "modifyDate")
    return usable.groupBy("table_name").agg(F.min_by("field_name", F.struct(~exact, "ordinal")).alias("timestamp_field"))


def why_not_eligible(with_fields: Column, host_tables: Sequence[str] = ()) -> Column:
    """The first rule that keeps a table from being indexed; ``with_fields`` says if it has an indexable field. ``host_tables`` are further system tables of a host."""
    plain = F.lower(F.replace("table_name", F.lit("_"), F.lit("")))
    hosts = [t.replace("_", "").lower() for t in host_tables]
    return (
        F.when(F.col("table_name").isNull(), "unknown table")
        .when(_flag("is_internal"), "internal")
        .when(F.col("table_name").isin(*ENGINE_TABLES), "part of the search engine")
        .when(plain.isin(*SYSTEM_TABLES, *hosts), "system table")
        .when(F.col("table_name").rlike(SECRET_NAMES), "may hold secrets")
        .when(_flag("is_hidden"), "hidden")
        .when(_flag("has_variants"), "has variants")
        .when(~_flag("can_query"), "can't be queried")
        .when(~with_fields, "no indexable field")
    )


def eligibility(tables: DataFrame, fields: DataFrame, host_tables: Sequence[str] = ()) -> DataFrame:
    """Per table: table_name, label, can_read, reason (null if it may be indexed)."""
    usable = indexable_fields(fields).select(F.col("table_name").alias("__t")).distinct()
    joined = tables.join(usable, F.col("table_name") == F.col("__t"), "left")
    return joined.select("table_name", "label", _flag("can_read").alias("can_read"), why_not_eligible(F.col("__t").isNotNull(), host_tables).alias("reason"))


def eligible_tables(tables: DataFrame, fields: DataFrame, indexed: DataFrame, host_tables: Sequence[str] = ()) -> DataFrame:
    """Tables that may be indexed, may be read and aren't indexed yet, by label whatever its case."""
    found = eligibility(tables, fields, host_tables).where("reason is null and can_read").join(indexed.select("table_name"), "table_name", "left_anti")
    return found.select("table_name", "label").orderBy(F.lower("label"), "table_name")
