"""Every registered query against its SQL, and the registry without the training-data operators."""

import math
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from lodestar import catalog

from .conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 9) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    frame = catalog.queries()[name](spark, sf_dir)
    found = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found[0]
        return
    result = oracle.execute(sql)
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    for mine, theirs in zip(found[1], expected[1]):
        assert mine == pytest.approx(theirs, abs=1e-6) if any(isinstance(v, float) for v in mine) and all(isinstance(v, (int, float)) for v in mine) else all(a == b or (isinstance(a, float) and abs(a - b) < 1e-6) for a, b in zip(mine, theirs)), (mine, theirs)


def test_cut_texts_equal_their_sql_whatever_they_hold(spark, tmp_path):
    texts = [None, "", " ", " \t\n" * 50, " " * 120 + "x", "\u3000", "\x00" * 101, "e\u0301" * 60, "\U0001f468\u200d\U0001f469\u200d\U0001f467" * 30, "\r\n" * 60, "a" * 99, "a" * 100, "a" * 101, "\ufeffb", "\u0130\u00df" * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.shown for r in catalog.queries()["field_truncate"](spark, str(tmp_path)).collect()}
    sql = catalog.oracle_sql()["field_truncate"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == dict(duckdb.execute(sql).fetchall()) and found[1] == "" and found[2] == " "


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries() and catalog.FLAGSHIP in catalog.oracle_sql()


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_ranked_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "lodestar")):
        if os.path.basename(folder) == "llm" or "__pycache__" in folder:
            continue
        for name in files:
            text = open(os.path.join(folder, name), encoding="utf-8").read()
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", text, re.M), name
