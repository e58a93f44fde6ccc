"""Document building and configuration objects."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.operators import documents as D
from lodestar.plans.config import Analyzer, EngineConfig, FieldConfig, Role, TableConfig


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "John", "Developer", "AB  12", 10, datetime.datetime(2024, 1, 2, 3, 4, 5)), (2, None, " ", None, 99, None), (3, "Ann", "x" * 20000, "y" * 1025, 20, None), (None, "Nobody", None, None, None, None)]
    return spark.createDataFrame(rows, "id int, name string, description string, sku string, company int, modified timestamp")


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([(10, "Acme"), (20, None)], "key int, label string")


def built(people, fields, labels=None, **more):
    return {r.record_id: r for r in D.build_documents(people, TableConfig("people", "id", tuple(fields), **more), labels).collect()}


def test_text_and_label(people):
    rows = built(people, [FieldConfig("name"), FieldConfig("description")])
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"].document_id == "people:1" and rows["1"].searchable_text == "John Developer"
    assert rows["2"].searchable_text == "" and rows["2"].field_values == {} and rows["2"].record_label == "2"
    assert len(rows["3"].searchable_text) == 10_004
    assert built(people, [FieldConfig("name", include_label=True, label="Name")])["1"].searchable_text == "Name: John"


def test_display_values_come_from_the_dimension(people, companies):
    rows = built(people, [FieldConfig("name"), FieldConfig("company")], {"company": D.Label(companies, "key", "label")})
    assert rows["1"].field_values == {"name": "John", "company": "Acme"}
    assert rows["2"].field_values == {"company": "99"} and rows["3"].field_values["company"] == "20"


def test_roles(people):
    fields = [FieldConfig("name", role=Role.TITLE), FieldConfig("sku", label="SKU Code", role=Role.EXACT), FieldConfig("description", role=Role.SUBTITLE), FieldConfig("company", role=Role.DISPLAY, label="Company")]
    rows = built(people, fields)
    assert rows["1"].record_label == "John" and rows["1"].field_values_exact == {"sku": "ab 12"} and rows["1"].searchable_text == "John Developer 10"
    assert rows["1"].subtitle == "Developer" and rows["1"].display_values == {"Company": "10"}
    assert rows["3"].field_values_exact is None and len(rows["3"].subtitle) == 500
    assert rows["2"].subtitle is None and rows["2"].record_label == "2"


def test_label_formats(people):
    fields = [FieldConfig("name"), FieldConfig("sku")]
    assert built(people, fields, label_format="%s - %s", label_fields=("name", "sku"))["1"].record_label == "John - AB  12"
    assert built(people, fields, label_format="%s - %s", label_fields=("name", "sku"))["2"].record_label == " - "
    for bad in ("%d-%s", "%s", "%s %s %s"):
        assert built(people, fields, label_format=bad, label_fields=("name", "sku"))["1"].record_label == "1"


def test_versions(people):
    rows = built(people, [FieldConfig("name")], timestamp="modified")
    assert rows["1"].version == 1704164645000 and rows["2"].version is None
    assert built(people, [FieldConfig("name")])["1"].version is None


def test_protected_values_never_leave(people):
    fields = [FieldConfig("name"), FieldConfig("sku")]
    rows = built(people, fields, protected=frozenset({"sku"}))
    assert rows["1"].field_values == {"name": "John"} and "AB" not in str(rows["1"])
    assert built(people, fields, protected=frozenset({"id"})) == {}


def test_build_is_one_scan(people):
    plan = D.build_documents(people, TableConfig("people", "id", (FieldConfig("name"),)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_record_ids(spark):
    assert spark.range(1).select(D.record_id_of(F.lit("t:a:b")).alias("v")).first().v == "a:b"


def test_analyzers_and_snippets():
    assert FieldConfig("a").resolved_analyzer is Analyzer.PREFIX and FieldConfig("a").snippet
    assert FieldConfig("a", role=Role.KEYWORD).resolved_analyzer is Analyzer.WORD and not FieldConfig("a", role=Role.KEYWORD).snippet
    assert FieldConfig("a", role=Role.KEYWORD, in_snippet=True).snippet
    assert FieldConfig("a", role=Role.EXACT, analyzer=Analyzer.WORD).resolved_analyzer is Analyzer.EXACT
    assert not FieldConfig("a", analyzer=Analyzer.EXACT, in_snippet=True).snippet
    assert Role.named(" title ") is Role.TITLE and Role.named("x", Role.BODY) is Role.BODY and Role.named(None) is None


def test_configuration_is_checked():
    field = FieldConfig("a")
    for bad in (lambda: FieldConfig(" "), lambda: FieldConfig("a", weight=0), lambda: FieldConfig("a", weight=1001), lambda: TableConfig("a:b", "id", (field,)), lambda: TableConfig("a", "id", ()), lambda: TableConfig("a", "id", (field, field))):
        with pytest.raises(ValueError):
            bad()
    table = TableConfig("a", "id", (field,))
    for bad in (lambda: EngineConfig(index_name="-x"), lambda: EngineConfig(max_search_limit=0), lambda: EngineConfig(tables=(table, table))):
        with pytest.raises(ValueError):
            bad()
    assert TableConfig("a", "id", (FieldConfig("x", weight=3, role=Role.TITLE),)).fingerprint() == '[{"name":"x","weight":3,"includeLabel":false,"role":"TITLE"}]'
    assert table.fingerprint() == '[{"name":"a","weight":1,"includeLabel":false}]' and table.plain and not table.filtered
