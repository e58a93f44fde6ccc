"""The corpus pipeline stage by stage, each on its own input, against brute force."""

import collections

import corpus_pipeline
from lodestar.llm import pii
from pyspark.sql import functions as F

from . import messy
from .test_operators import brute_groups, brute_spans, shingle_set

BENCH = "the quick brown fox jumps over the lazy dog while seven wizards watch from afar"


def tables(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_messy_rows(spark, tmp_path):
    docs = messy.documents(spark)
    dirty = docs.where("doc_id in (1, 2, 4)").withColumns({"text": F.concat_ws(" ", "text", F.lit(BENCH.upper()), "text"), "doc_id": F.col("doc_id") + 5000})
    sf = tables(spark, tmp_path, docs.union(dirty))
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if i < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/out{i}")
        seen[name] = (now.collect(), spark.read.parquet(f"{tmp_path}/out{i}").collect())
        now = spark.read.parquet(f"{tmp_path}/out{i}")

    before, after = seen["language ID"]
    lost = collections.Counter(r.doc_id for r in before) - collections.Counter(r.doc_id for r in after)
    assert set(lost) <= {300, 301, 302, 305, 309, None}

    before, after = seen["near-duplicates"]
    assert sum(bool(shingle_set(r.text)) for r in after) == len(brute_groups([(r.doc_id, r.text) for r in before]))

    before, after = seen["decontamination"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in before if r.doc_id is not None and r.doc_id >= 5000} and gone

    before, after = seen["personal data"]
    assert len(before) == len(after)
    assert all(not brute_spans(r.text or "") and r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    clean = collections.Counter((r.doc_id, r.text) for r in before if not pii.candidates(r.text or ""))
    assert not clean - collections.Counter((r.doc_id, r.text) for r in after)

    before, after = seen["encoding"]
    assert len(before) == len(after) and all(r.round_trip for r in after)


def test_empty_documents(spark, tmp_path):
    sf = tables(spark, tmp_path, messy.empty(spark))
    assert corpus_pipeline.run(spark, sf).count() == 0
