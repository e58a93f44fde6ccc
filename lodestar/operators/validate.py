"""Validation of a stored index against its sources, as findings that are summed up and kept.

A finding is (table_name, kind, subject, level). Counts are compared for all rows of a table, one aggregate a side; records
and documents are compared for a sample that is fixed by its keys, so two runs over the same data find the same. What is
kept of a run is its row and a row for each table; the findings themselves are a table beside them and never a value.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .diagnose import LEVELS, count_check, latest, orphan_check, sample_check
from .documents import build_documents, empty_documents
from .maintain import edges, hash_sample

if TYPE_CHECKING:
    from ..sources.index import Index
    from ..streaming.changes import Source

FINDINGS = "table_name string, kind string, subject string, level string"
NAMES_LENGTH, SUMMARY_LENGTH = 1000, 250


def _found(rows: DataFrame, table: str | Column, kind: str, subject: str | Column) -> DataFrame:
    named = F.lit(table) if isinstance(table, str) else table
    return rows.select(named.alias("table_name"), F.lit(kind).alias("kind"), (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"), "level")


def validate(index: Index, sources: Mapping[str, Source], sample: int = 100, seed: int = 0) -> DataFrame:
    """The findings over the tables of ``sources``: that each is stored, its number of documents, ``sample`` records at both ends of the
    key, ``sample`` documents by hash, and its fields and columns as they are configured. Rows without a key count nowhere."""
    spark, stored = index.spark, set(index.manifest()["tables"])
    documents = index.documents()
    documents = empty_documents(spark) if documents is None else documents
    parts = [spark.createDataFrame([(n, "stored", None, "OK" if n in stored else "FAIL") for n in sorted(sources)], FINDINGS)]
    for name, source in sorted(sources.items()):
        if name not in stored:
            continue
        key = source.config.key
        rows = source.rows().where(F.col(key).isNotNull())
        mine = documents.where(F.col("source_table") == name)
        counts = rows.agg(F.count("*").alias("source_count")).crossJoin(mine.agg(F.count("*").alias("index_count"))).withColumn("table_name", F.lit(name))  # one row each
        told = F.concat_ws(" of ", F.col("index_count").cast("string"), F.col("source_count").cast("string"))
        parts.append(_found(count_check(counts), name, "count", told))
        expected = build_documents(edges(rows, key, sample), source.config, source.labels, index.config)
        kept = mine.join(expected.select("document_id"), "document_id", "left_semi")
        parts.append(_found(sample_check(expected, kept), name, "record", F.concat_ws(": ", "document_id", "verdict")))
        ids = rows.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("record_id"))
        parts.append(_found(orphan_check(hash_sample(mine, "document_id", sample, seed), ids), name, "document", F.col("document_id")))
    fields = index.mapping_differences().where(F.col("table_name").isin(*sources)).withColumn("level", F.lit("FAIL"))
    parts.append(_found(fields, F.col("table_name"), "field", F.col("field_name")))
    columns = [(n, "column", c, "FAIL") for n, found in sorted(index.schema_differences().items()) if n in sources for c in found]
    parts.append(spark.createDataFrame(columns, FINDINGS))
    return reduce(DataFrame.unionByName, parts)


def table_stats(findings: DataFrame) -> DataFrame:
    """Per table how many checks were made, how many of them gave warnings or failed, and the worst level."""
    n = {level: F.count_if(F.col("level") == level) for level in LEVELS}
    worst = F.when(n["FAIL"] > 0, "FAIL").when(n["WARN"] > 0, "WARN").otherwise("OK")
    return findings.groupBy("table_name").agg(F.count("*").alias("checks"), n["WARN"].alias("warn_count"), n["FAIL"].alias("fail_count"), worst.alias("level"))


def report_row(stats: DataFrame, sample: int, start: Column, end: Column, trigger: str = "MANUAL", user: str | None = None) -> DataFrame:
    """The row of a validation run, from the rows of its tables; a run over no table passes."""
    fails, warns = (F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fail_count", "warn_count"))
    summed = stats.agg(F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("names"), F.count("*").alias("tables_checked"), fails, warns)  # a name for each table
    status = F.when(F.col("fail_count") > 0, "FAIL").when(F.col("warn_count") > 0, "WARN").otherwise("PASS")
    told = F.format_string("%s: %d table(s), %d failed check(s), %d warning(s).", status, "tables_checked", "fail_count", "warn_count")
    return summed.select(
        status.alias("status"), F.lit(trigger).alias("trigger_type"), F.lit(user).cast("string").alias("user_name"), F.substring("names", 1, NAMES_LENGTH).alias("table_names"),
        F.lit(sample).alias("sample_size"), "tables_checked", "fail_count", "warn_count", F.substring(told, 1, SUMMARY_LENGTH).alias("summary"), start.alias("start_time"), end.alias("end_time"),
    )


class Reports:
    """Validation runs that are kept below a path: ``runs``, ``tables`` and ``findings``, each with the run's report_id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, findings: DataFrame, sample: int, start: datetime, end: datetime, trigger: str = "MANUAL", user: str | None = None) -> str:
        """Keeps a run. Its row is written last, so a run that broke off is none."""
        name = uuid.uuid4().hex
        findings.write.parquet(f"{self.path}/findings/report_id={name}")
        kept = self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings/report_id={name}")
        table_stats(kept).coalesce(1).write.parquet(f"{self.path}/tables/report_id={name}")
        stats = self.spark.read.parquet(f"{self.path}/tables/report_id={name}")
        report_row(stats, sample, F.lit(start), F.lit(end), trigger, user).withColumn("report_id", F.lit(name)).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        return name

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs")

    def tables(self) -> DataFrame:
        """The rows of tables of all kept runs."""
        return self.spark.read.option("basePath", f"{self.path}/tables").parquet(f"{self.path}/tables").join(self.runs().select("report_id", "end_time"), "report_id")

    def findings(self, report_id: str) -> DataFrame:
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings/report_id={report_id}")

    def newest(self) -> DataFrame:
        """What the newest run that checked a table has found in it, a row for each table."""
        return latest(self.tables(), ["table_name"], ["end_time", "report_id"])
