"""Where queries and their SQL are registered, and the tables that they run on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import Label, build_documents, union_documents
from ..plans.config import EngineConfig, FieldConfig, Role, TableConfig
from ..sources.index import Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The searchable tables of the catalogue.

PART = TableConfig("part", "p_partkey", (FieldConfig("p_name", weight=3, role=Role.TITLE), FieldConfig("p_type"), FieldConfig("p_brand", weight=2, role=Role.KEYWORD)))
CUSTOMER = TableConfig(
    "customer",
    "c_custkey",
    (FieldConfig("c_name", weight=3, role=Role.TITLE), FieldConfig("c_nationkey", label="Nation", include_label=True), FieldConfig("c_mktsegment", weight=2, role=Role.KEYWORD)),
)
SUPPLIER = TableConfig("supplier", "s_suppkey", (FieldConfig("s_name", weight=3, role=Role.TITLE), FieldConfig("s_nationkey", label="Nation")))
TEXTS = TableConfig("documents", "doc_id", (FieldConfig("text"), FieldConfig("source"), FieldConfig("lang", weight=5, role=Role.EXACT)))
TABLES = (PART, CUSTOMER, SUPPLIER, TEXTS)
#: Whole texts are searched; the cut of long values is shown by ``field_truncate``.
WHOLE = 2**31 - 1
CONFIG = EngineConfig(tables=TABLES, max_field_length=WHOLE)

#: Times in the catalogue are literals, so that both engines mean the same.
NOW = "2024-01-20 00:00:00"


def labels(spark: SparkSession, sf_dir: str, field: str) -> dict[str, Label]:
    return {field: Label(load(spark, sf_dir, "nation"), "n_nationkey", "n_name")}


def documents_of(spark: SparkSession, sf_dir: str, *tables: TableConfig) -> DataFrame:
    """The search documents of catalogue tables."""
    known = {"customer": "c_nationkey", "supplier": "s_nationkey"}
    parts = []
    for t in tables:
        named = labels(spark, sf_dir, known[t.name]) if t.name in known else None
        parts.append(build_documents(load(spark, sf_dir, t.name), t, named, CONFIG, F.lit(NOW).cast("timestamp")))
    return union_documents(parts)


def scratch_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared folder, deleted when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/lodestar-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return path.toString()


_INDEXES: dict[tuple, Index] = {}


def stored_index(spark: SparkSession, sf_dir: str, config: EngineConfig) -> Index:
    """The index of a folder's tables, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, config.tables)
    if key not in _INDEXES:
        index = Index(spark, scratch_folder(spark), config)
        index.rebuild({t.name: documents_of(spark, sf_dir, t) for t in config.tables})
        _INDEXES[key] = index
    return _INDEXES[key]


# SQL for the same documents, written out independently.

# Words of letters ({l}) and digits; an apostrophe, stop or the like stands inside a word between two of a kind.
_LETTER_SQL = r"[^\p{Nd}\p{No}\p{P}\p{S}\p{Z}\p{C}\p{Han}\p{Hiragana}]"
_RUN_SQL = (
    r"(?:{l}+(?:[:.\x27\x{B7}\x{387}\x{55F}\x{5F4}\x{2018}\x{2019}\x{2024}\x{2027}\x{FE13}\x{FE52}\x{FE55}\x{FF07}\x{FF0E}\x{FF1A}]{l}+)*"
    r"|\p{Nd}+(?:[,;.\x27\x{37E}\x{589}\x{60C}\x{60D}\x{66C}\x{7F8}\x{2018}\x{2019}\x{2024}\x{2044}\x{FE10}\x{FE14}\x{FE50}\x{FE52}\x{FE54}\x{FF07}\x{FF0C}\x{FF0E}\x{FF1B}]\p{Nd}+)*)"
).replace("{l}", _LETTER_SQL)
WORD_SQL = rf"_*{_RUN_SQL}(?:_*{_RUN_SQL})*_*|[\p{{Han}}\p{{Hiragana}}]\p{{M}}*"


def normal_sql(value: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({value}, ''), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"


_SHOWN = "CASE WHEN trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> '' THEN {0} END"

VALUES_SQL = {
    "part": """
 SELECT 'part' AS st, CAST(p_partkey AS VARCHAR) AS rid, 'p_name' AS path, p_name AS v FROM part
 UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'p_type', p_type FROM part
 UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'p_brand', p_brand FROM part
 UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'searchable_text', p_name || ' ' || p_type FROM part""",
    "customer": """
 SELECT 'customer' AS st, CAST(c_custkey AS VARCHAR) AS rid, 'c_name' AS path, c_name AS v FROM customer
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_nationkey', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment FROM customer
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'searchable_text', c_name || ' Nation: ' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "supplier": """
 SELECT 'supplier' AS st, CAST(s_suppkey AS VARCHAR) AS rid, 's_name' AS path, s_name AS v FROM supplier
 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 's_nationkey', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'searchable_text', s_name || ' ' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "documents": f"""
 SELECT 'documents' AS st, CAST(doc_id AS VARCHAR) AS rid, 'text' AS path, {_SHOWN.format("text")} AS v FROM documents
 UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'source', source FROM documents
 UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'lang', lower(lang) FROM documents
 UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'searchable_text', {normal_sql("concat_ws(' ', " + _SHOWN.format("text") + ", source)")} FROM documents""",
}


def ranked_sql(term: str, tables: list[str], clauses: list[tuple[str, str, str, float, str | None, bool]], searched: list[str] | None = None) -> str:
    """CTEs up to ``hits`` (st, rid, score) and ``parts`` (st, rid, clause, s) of a ranked search.

    ``clauses``: name, path, analyzer (prefix, word, exact), weight, table or None, required. ``tables`` are the whole index.
    """
    tokens = term.lower().split()
    rows = ", ".join(f"('{n}', '{p}', '{a}', {float(w)}, {repr(t) if t else 'NULL'}, {str(r).lower()})" for n, p, a, w, t, r in clauses)
    paths = ", ".join(sorted({f"('{p}', '{a}')" for _, p, a, *_ in clauses}))
    allowed = ", ".join(f"'{t}'" for t in searched or tables)
    return f"""
WITH fv AS ({" UNION ALL ".join(VALUES_SQL[t] for t in tables)}),
pa(path, an) AS (VALUES {paths}),
q(tok) AS (VALUES {", ".join(f"('{t}')" for t in tokens)}),
w AS (SELECT st, rid, path, an, unnest(regexp_extract_all(lower(v), '{WORD_SQL}')) AS word FROM fv JOIN pa USING (path) WHERE v IS NOT NULL AND an <> 'exact'),
dl AS (SELECT path, an, st, rid, count(*) AS dl FROM w WHERE an <> 'prefix' OR length(word) >= 2 GROUP BY path, an, st, rid),
pst AS (SELECT path, an, count(*) AS n, avg(dl) AS a FROM dl GROUP BY path, an),
m AS (SELECT path, an, st, rid, tok, count(*) AS tf FROM w JOIN q ON (an = 'prefix' AND starts_with(word, tok) AND length(tok) BETWEEN 2 AND 20) OR (an = 'word' AND word = tok) GROUP BY path, an, st, rid, tok),
df AS (SELECT path, an, tok, count(*) AS df FROM m GROUP BY path, an, tok),
fs AS (SELECT m.path, m.an, m.st, m.rid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))) AS s
  FROM m JOIN df ON df.path = m.path AND df.an = m.an AND df.tok = m.tok JOIN dl ON dl.path = m.path AND dl.an = m.an AND dl.st = m.st AND dl.rid = m.rid JOIN pst ON pst.path = m.path AND pst.an = m.an
  GROUP BY m.path, m.an, m.st, m.rid HAVING count(*) = {len(tokens)}),
xn AS (SELECT path, count(*) AS n, count(*) FILTER (WHERE v = '{term.lower()}') AS df FROM fv JOIN pa USING (path) WHERE an = 'exact' AND v IS NOT NULL GROUP BY path),
fx AS (SELECT fv.path, 'exact' AS an, st, rid, ln(1 + (n - df + 0.5) / (df + 0.5)) AS s FROM fv JOIN xn ON xn.path = fv.path WHERE v = '{term.lower()}'),
fa AS (SELECT * FROM fs UNION ALL SELECT * FROM fx),
c(name, path, an, weight, tab, required) AS (VALUES {rows}),
parts AS (SELECT fa.st, fa.rid, c.name AS clause, c.required, c.weight * s AS s FROM fa JOIN c ON c.path = fa.path AND c.an = fa.an AND (c.tab IS NULL OR c.tab = fa.st) WHERE fa.st IN ({allowed})),
hits AS (SELECT st, rid, round(sum(s), 6) AS score FROM parts GROUP BY st, rid HAVING bool_or(required))
"""


#: The clauses that searching all of part, customer and supplier has.
TEXT = [("text", "searchable_text", "prefix", 1, None, True)]
PART_CLAUSES = [("field:p_brand", "p_brand", "word", 1, "part", True), ("boost:p_name", "p_name", "prefix", 3, None, False), ("boost:p_type", "p_type", "prefix", 1, None, False), ("boost:p_brand", "p_brand", "word", 2, None, False)]
CUSTOMER_CLAUSES = [("field:c_mktsegment", "c_mktsegment", "word", 1, "customer", True), ("boost:c_name", "c_name", "prefix", 3, None, False), ("boost:c_nationkey", "c_nationkey", "prefix", 1, None, False), ("boost:c_mktsegment", "c_mktsegment", "word", 2, None, False)]
SUPPLIER_CLAUSES = [("boost:s_name", "s_name", "prefix", 3, None, False), ("boost:s_nationkey", "s_nationkey", "prefix", 1, None, False)]
TEXTS_CLAUSES = [("field:lang", "lang", "exact", 1, "documents", True), ("boost:text", "text", "prefix", 1, None, False), ("boost:source", "source", "prefix", 1, None, False), ("boost:lang", "lang", "exact", 5, None, False)]
