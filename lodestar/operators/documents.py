"""Document building: rows of many tables become search documents of one shape.

A build is one projection of the source rows (plus a left join per labelled
dimension, which Spark broadcasts if it is small), so a table of any size is one
scan without a shuffle. Rows without a key give no document.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.config import Analyzer, EngineConfig, FieldConfig, Role, TableConfig

ROLE_LENGTH = 500
_MAP = "map<string,string>"
MAPS = {Analyzer.PREFIX: "field_values", Analyzer.WORD: "field_values_word", Analyzer.ENGLISH: "field_values_english", Analyzer.EXACT: "field_values_exact"}


@dataclass(frozen=True)
class Label:
    """Where the display values of a field come from: ``dimension.key`` is the field's value, ``dimension.label`` is shown."""

    dimension: DataFrame
    key: str
    label: str


def with_labels(rows: DataFrame, labels: Mapping[str, Label] | None) -> DataFrame:
    """``rows`` with a column ``__label_<field>`` for each labelled field; keys of a dimension are taken as unique."""
    for name, label in (labels or {}).items():
        side = label.dimension.select(F.col(label.key).alias(f"__key_{name}"), F.col(label.label).cast("string").alias(f"__label_{name}"))
        rows = rows.join(side, F.col(name) == F.col(f"__key_{name}"), "left").drop(f"__key_{name}")
    return rows


def shown(field: FieldConfig, labels: Mapping[str, Label] | None, config: EngineConfig) -> Column:
    label = F.col(f"__label_{field.name}") if field.name in (labels or {}) else None
    return T.display_value(F.col(field.name), label, config.max_field_length)


def _joined(fields, value, separator: str = " ") -> Column:
    return F.concat_ws(separator, *[value(f) for f in fields]) if fields else F.lit("")


def _map(fields, value) -> Column:
    """field -> value of those that have one; an empty map has no entries."""
    if not fields:
        return F.create_map().cast(_MAP)
    return F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f.name), value(f))]), lambda _, v: v.isNotNull())


def _null_if_empty(entries: Column) -> Column:
    return F.when(F.size(entries) > 0, entries)


def searchable_text(table: TableConfig, labels: Mapping[str, Label] | None = None, config: EngineConfig = EngineConfig()) -> Column:
    """Normalised display values of the snippet's fields in their order, ``label: value`` where the label is included."""

    def part(f: FieldConfig) -> Column:
        value = shown(f, labels, config)
        return F.when(value.isNotNull(), F.concat(F.lit(f"{f.shown}: "), value)) if f.include_label else value

    return T.normalize(_joined([f for f in table.indexed_fields if f.snippet], part))


def _label(table: TableConfig, labels, config: EngineConfig) -> Column:
    key = F.col(table.key).cast("string")
    titles = [f for f in table.indexed_fields if f.role is Role.TITLE]
    title = F.substring(_joined(titles, lambda f: shown(f, labels, config)), 1, ROLE_LENGTH)
    fallback = F.coalesce(F.when(title != "", title), key)
    if table.label_format is None:
        return fallback
    if len(re.findall(r"%(?!%)", table.label_format)) != len(table.label_fields) or re.search(r"%(?![s%])", table.label_format):
        return fallback  # a format that can't take the display values is not used
    known = {f.name: f for f in table.fields}
    parts = [F.coalesce(shown(known.get(name, FieldConfig(name)), labels, config), F.lit("")) for name in table.label_fields]
    return F.format_string(table.label_format, *parts)


def build_documents(rows: DataFrame, table: TableConfig, labels: Mapping[str, Label] | None = None, config: EngineConfig = EngineConfig(), now: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The documents of a table's rows. ``now`` is the time of indexing (the query's time if left out). Columns ``carried`` are kept as they are."""
    rows = with_labels(rows, labels)
    fields = table.indexed_fields
    by = {a: [f for f in fields if f.resolved_analyzer is a] for a in Analyzer}
    value = lambda f: shown(f, labels, config)
    exact = lambda f: F.when(F.length(T.normalize_exact(value(f))) <= T.MAX_EXACT, T.normalize_exact(value(f)))
    subtitle = F.substring(_joined([f for f in fields if f.role is Role.SUBTITLE], value, " - "), 1, ROLE_LENGTH)
    displayed = [f for f in fields if f.role is Role.DISPLAY]
    display = F.map_filter(F.create_map(*[x for f in displayed for x in (F.lit(f.shown), F.substring(value(f), 1, ROLE_LENGTH))]), lambda _, v: v.isNotNull()) if displayed else F.create_map().cast(_MAP)
    version = F.unix_millis(F.col(table.timestamp).cast("timestamp")) if table.timestamp else F.lit(None).cast("long")
    key = F.col(table.key).cast("string")
    built = rows if table.searchable else rows.where(F.lit(False))
    return built.where(F.col(table.key).isNotNull()).select(
        F.concat_ws(":", F.lit(table.name), key).alias("document_id"),
        F.lit(table.name).alias("source_table"),
        key.alias("record_id"),
        _label(table, labels, config).alias("record_label"),
        searchable_text(table, labels, config).alias("searchable_text"),
        F.coalesce(now, F.current_timestamp()).alias("indexed_at") if now is not None else F.current_timestamp().alias("indexed_at"),
        _map(fields, value).alias("field_values"),
        _null_if_empty(_map(by[Analyzer.WORD], value)).alias("field_values_word"),
        _null_if_empty(_map(by[Analyzer.ENGLISH], value)).alias("field_values_english"),
        _null_if_empty(_map(by[Analyzer.EXACT], exact)).alias("field_values_exact"),
        F.when(subtitle != "", subtitle).alias("subtitle"),
        _null_if_empty(display).alias("display_values"),
        version.alias("version"),
        *carried,
    )


#: Bytes of the largest document that a batch takes, and of what stands before one in a bulk request.
BULK_BYTES, BULK_HEADER = 5 << 20, 128


def checked_documents(rows: DataFrame, table: TableConfig, labels: Mapping[str, Label] | None = None, config: EngineConfig = EngineConfig(), now: Column | None = None, max_bytes: int = BULK_BYTES) -> DataFrame:
    """Documents with a column ``cause``: why one can't be indexed, null if it can. All from one pass, and no row makes the others fail.

    A timestamp that can't be read gives a document without a version, and that is its cause; so is a size beyond ``max_bytes``.
    """
    unread = F.lit(False)
    if table.timestamp:
        read = F.col(table.timestamp).try_cast("timestamp")
        unread = F.col(table.timestamp).isNotNull() & read.isNull()
        rows = rows.withColumns({"__unread": unread, table.timestamp: read})
    else:
        rows = rows.withColumn("__unread", unread)
    built = build_documents(rows, table, labels, config, now, ("__unread",))
    size = F.octet_length(F.to_json(F.struct(*[c for c in built.columns if c != "__unread"]))) + BULK_HEADER
    cause = F.when(F.col("__unread"), F.lit(f"{table.timestamp} is no timestamp")).when(size > max_bytes, F.lit(f"larger than {max_bytes} bytes"))
    return built.withColumn("cause", cause).drop("__unread")


def union_documents(parts: list[DataFrame]) -> DataFrame:
    """All rows; a column that an older layout lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def empty_documents(spark: SparkSession) -> DataFrame:
    """No document, with the layout that documents have."""
    rows = spark.createDataFrame([], "id string, at timestamp")
    return build_documents(rows, TableConfig("none", "id", (FieldConfig("id"),), timestamp="at"))


def record_id_of(document_id: Column | str) -> Column:
    """What follows the first colon of a document id."""
    c = T.col(document_id)
    return F.substring(c, F.locate(":", c) + 1, F.length(c))


def allowed_snippet(table: TableConfig) -> Column:
    """The snippet of a filtered table, rebuilt from the stored values of the fields that may be seen."""
    return T.normalize(_joined([f for f in table.indexed_fields if f.snippet], lambda f: F.col("field_values")[f.name]))


def without_protected(documents: DataFrame, table: TableConfig) -> DataFrame:
    """Documents of a filtered table with only allowed values; others as they are."""
    if not table.filtered:
        return documents
    allowed = [f.name for f in table.indexed_fields]
    return documents.withColumns({"searchable_text": allowed_snippet(table), "field_values": F.map_filter("field_values", lambda k, _: k.isin(*allowed))})


def estimated_bytes(documents: DataFrame) -> DataFrame:
    """Bytes that a document takes in a bulk request: its JSON and a header."""
    return documents.select("document_id", (F.octet_length(F.to_json(F.struct("*"))) + BULK_HEADER).cast("long").alias("bytes"))
