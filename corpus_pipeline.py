"""Corpus pipeline: documents to encoded training text in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``, so extra columns pass
through. Null and empty texts, repeated rows and null ids are handled as the
operators say: a text without a letter is rejected by the first stage. Of a
group of near copies the row with the smallest id stays, and one of rows that
repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, langid, neardup, pieces, pii
from lodestar.llm.scratch import load


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose language is recognised."""
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    predict = langid.predictor(spark, langid.fit(labelled.where(~langid.in_fold())))
    verdict = docs.withColumn("__lang", predict(F.col("text").cast("string")))
    return verdict.where("not __lang.rejected").drop("__lang")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each near-duplicate group; documents without words are no copies of each other."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold no window of a benchmark item."""
    found = decontaminate.scan(docs, load(spark, sf_dir, "benchmark"), into="__hits")
    return found.where(F.size("__hits.runs") == 0).drop("__hits")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data replaced by the names of their kinds; null texts stay null."""
    model = pii.fit(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    found = docs.withColumn("__pii", pii.detector(spark, model, redact=True)(F.col("text").cast("string")))
    text = F.when(F.col("text").isNotNull(), F.col("__pii.redacted"))
    new = {"text": text, "n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return found.withColumns(new).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: SentencePiece ids of each document, which decode to its text again."""
    return pieces.encoded(docs, pieces.model_path())


STAGES = [
    ("language ID", keep_known_language),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", redact),
    ("encoding", encode),
]

#: Learned decisions (language, personal data) and ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
