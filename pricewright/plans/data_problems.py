"""Queries of the general data problems, each over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.operators import history, packed, references, rejects, snapshots
from pricewright.runtime import shared_dir, table


def _day(c: str):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    h = history.product_history(table(spark, d, "products"), table(spark, d, "price_books"))
    return h.select(F.col("entity").alias("sku"), _day("valid_from").alias("valid_from"), _day("valid_to").alias("valid_to"))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    h = history.product_history(table(spark, d, "products"), table(spark, d, "price_books"))
    return h.select(F.col("entity").alias("sku"), "version_no", "valid_from", "valid_to", "base_price", "is_active", "retired_date")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    c = snapshots.product_changes(table(spark, d, "hager_products"))
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("sku"), "change")


def p2_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery against the stored dictionary and words of those before it."""
    c = snapshots.latest_product_changes(table(spark, d, "hager_products"), f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("sku"), "change")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: table(spark, d, n) for n in ("products", "product_options", "price_books", "product_families")}
    return references.catalog_orphans(tables, table(spark, d, "deleted_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = rejects.load_delimited(table(spark, d, "key_tables"), typed=False).where("reason is not null").select(F.lit("key_tables").alias("table_name"), "record_id", "reason")
    rows = rejects.load_numbers(table(spark, d, "select_products_enhanced"), "record_id", "row_index").where("reason is not null")
    return lines.unionByName(rows.select(F.lit("select_products_enhanced").alias("table_name"), "record_id", "reason"))


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    lines = rejects.load_delimited(table(spark, d, "key_tables")).where("reason is null")
    return lines.select("record_id", "model", F.posexplode_outer("prices").alias("price_no", "price"))


def p6_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_numbers(table(spark, d, "select_products_enhanced"), "record_id", "row_index").where("reason is null").select("record_id", "number")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    a = packed.split_options(table(spark, d, "sample_products_export"), "export_id", "options").withColumn("table_name", F.lit("sample_products_export"))
    b = packed.split_constraints(table(spark, d, "select_hinges_options"), "record_id", "constraints_json").withColumn("table_name", F.lit("select_hinges_options"))
    return a.unionByName(b).select("table_name", "record_id", "field_name", "value_no", "value")


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p2_found, p2_latest, p4_found, p4_counts, p6_found, p6_loaded, p6_row_numbers, p7_found)}

_PLAIN = "nullif(upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"

_VERSIONS = f"""
WITH books AS (SELECT id, min(effective_date) AS d FROM price_books WHERE effective_date IS NOT NULL GROUP BY id),
rows AS (
  SELECT {_PLAIN.format("p.sku")} AS sku, coalesce(p.effective_date, b.d) AS day, p.base_price, p.is_active, p.retired_date, p.updated_at, p.id
  FROM products p LEFT JOIN books b ON p.price_book_id = b.id),
held AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku, day ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST, base_price DESC NULLS LAST, is_active DESC NULLS LAST, retired_date DESC NULLS LAST) AS k
    FROM rows WHERE sku IS NOT NULL AND day IS NOT NULL) WHERE k = 1),
marked AS (
  SELECT *, row_number() OVER w = 1 OR base_price IS DISTINCT FROM lag(base_price) OVER w OR is_active IS DISTINCT FROM lag(is_active) OVER w OR retired_date IS DISTINCT FROM lag(retired_date) OVER w AS starts
  FROM held WINDOW w AS (PARTITION BY sku ORDER BY day)),
versions AS (
  SELECT sku, row_number() OVER v AS version_no, day AS valid_from, lead(day) OVER v AS next_from, base_price, is_active, retired_date
  FROM marked WHERE starts WINDOW v AS (PARTITION BY sku ORDER BY day)),
ended AS (SELECT *, least(next_from, CASE WHEN retired_date > valid_from THEN retired_date END) AS valid_to FROM versions)
"""

_ORPHANS = """
WITH refs AS (
  SELECT 'products' AS table_name, 'price_book_id' AS field_name, 'price_books' AS target, id AS record_id, price_book_id AS key, created_at AS t FROM products
  UNION ALL SELECT 'products', 'family_id', 'product_families', id, family_id, created_at FROM products
  UNION ALL SELECT 'product_options', 'product_id', 'products', id, product_id, created_at FROM product_options),
parents AS (
  SELECT 'price_books' AS target, id AS key, min(upload_date) AS born FROM price_books GROUP BY id
  UNION ALL SELECT 'product_families', id, min(created_at) FROM product_families GROUP BY id
  UNION ALL SELECT 'products', id, min(created_at) FROM products GROUP BY id),
gone AS (SELECT DISTINCT table_name AS target, record_id AS key FROM deleted_records),
found AS (
  SELECT DISTINCT r.table_name, r.field_name, r.record_id,
    CASE WHEN p.key IS NOT NULL THEN 'late' WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind, coalesce(strftime(r.t, '%Y-%m'), '') AS period
  FROM refs r LEFT JOIN parents p ON r.target = p.target AND r.key = p.key LEFT JOIN gone g ON r.target = g.target AND r.key = g.key
  WHERE r.key IS NOT NULL AND (p.key IS NULL OR p.born > r.t))
"""

_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"
_MONEY = _SPACE + r"(?:[-\x{2010}-\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]|\$?" + _SPACE + r"(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{2})?)?" + _SPACE


def _by_delimiter(d: str, rx: str) -> str:
    """Whether records of one delimiter are well-formed, and their raw fields."""
    return f"""SELECT line_id, cols, delimiter, regexp_full_match(data, '(?:"(?:[^"]|"")*"|[^"{rx}\\r\\n]*)(?:{rx}(?:"(?:[^"]|"")*"|[^"{rx}\\r\\n]*))*') AS formed,
  regexp_extract_all('{d}' || data, '{rx}("(?:[^"]|"")*"|[^"{rx}]*)', 1) AS raw FROM lines WHERE delimiter = '{d}'"""


_RECORDS = f"""WITH lines AS (SELECT line_id, cols, delimiter, coalesce(data, '') AS data FROM key_tables),
parts AS ({" UNION ALL ".join(_by_delimiter(d, rx) for d, rx in ((",", ","), (";", ";"), ("|", chr(92) + "|"), (chr(9), chr(92) + "t")))}
  UNION ALL SELECT line_id, NULL, delimiter, true, [] FROM lines WHERE delimiter IS NULL OR delimiter NOT IN (',', ';', '|', chr(9))),
fields AS (SELECT line_id, cols, formed, list_transform(raw, lambda f: CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f FROM parts),
judged AS (SELECT line_id, f, CASE WHEN NOT formed THEN 'quoting' WHEN cols IS NULL OR cols < 1 OR len(f) <> cols THEN 'columns'
  WHEN regexp_full_match(f[1], '{_SPACE}') OR len(list_filter(f[2:], lambda x: NOT regexp_full_match(x, '{_MONEY}'))) > 0 THEN 'value' END AS reason FROM fields)
"""
_ROW_NUMBERS = f"SELECT record_id, regexp_replace(coalesce(row_index, ''), '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM select_products_enhanced"

_CHANGES = f"""
WITH rows AS (
  SELECT snapshot_date, {_PLAIN.format("sku")} AS sku, loaded_at, cast(round(cast(base_price AS DECIMAL(18,6)) * 100, 0) AS BIGINT) AS cents,
    translate(regexp_replace(regexp_replace(lower(description), '[\\s\\x{{00A0}}\\x{{2009}}\\x{{202F}}\\x{{3000}}\\x{{200B}}]+', '', 'g'), '''''|’’|′′', '"', 'g'), '“”„‟″«»‘’‚‛′`´''', repeat('"', 15)) AS text
  FROM hager_products),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, sku ORDER BY loaded_at DESC NULLS LAST, cents DESC NULLS LAST, text DESC NULLS LAST) AS k FROM rows WHERE sku IS NOT NULL) WHERE k = 1),
days AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM hager_products WHERE snapshot_date IS NOT NULL)),
pairs AS (
  SELECT d.snapshot_date AS day, n.sku AS sku, n.cents, n.text, true AS new FROM days d JOIN latest n ON n.snapshot_date = d.snapshot_date WHERE d.before IS NOT NULL),
old AS (SELECT d.snapshot_date AS day, o.sku, o.cents, o.text, true AS old FROM days d JOIN latest o ON o.snapshot_date = d.before)
SELECT strftime(coalesce(p.day, o.day), '%Y-%m-%d') AS snapshot_date, coalesce(p.sku, o.sku) AS sku,
  CASE WHEN o.old IS NULL THEN 'added' WHEN p.new IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM pairs p FULL JOIN old o ON p.day = o.day AND p.sku = o.sku
WHERE o.old IS NULL OR p.new IS NULL OR p.cents IS DISTINCT FROM o.cents OR p.text IS DISTINCT FROM o.text
"""

ORACLE = {
    "p6_found": _RECORDS + f"SELECT 'key_tables' AS table_name, line_id AS record_id, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT 'select_products_enhanced', record_id, 'value' FROM ({_ROW_NUMBERS}) WHERE NOT regexp_full_match(t, '[0-9]{{1,4}}')",
    "p6_loaded": _RECORDS + f"""SELECT line_id AS record_id, regexp_replace(f[1], '^{_SPACE}|{_SPACE}$', '', 'g') AS model, i AS price_no, try_cast(regexp_replace(f[i + 2], '[^0-9.]', '', 'g') AS DECIMAL(18,2)) AS price
FROM judged LEFT JOIN range(0, 64) r(i) ON i < len(f) - 1 WHERE reason IS NULL""",
    "p6_row_numbers": f"SELECT record_id, cast(t AS INTEGER) AS number FROM ({_ROW_NUMBERS}) WHERE regexp_full_match(t, '[0-9]{{1,4}}')",
    "p1_found": _VERSIONS + "SELECT sku, coalesce(strftime(valid_from, '%Y-%m-%d'), '') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to FROM ended",
    "p1_versions": _VERSIONS + "SELECT sku, version_no, valid_from, valid_to, base_price, is_active, retired_date FROM ended",
    "p2_found": _CHANGES,
    "p2_latest": f"SELECT * FROM ({_CHANGES}) WHERE snapshot_date = (SELECT strftime(max(snapshot_date), '%Y-%m-%d') FROM hager_products)",
    "p4_found": _ORPHANS + "SELECT * FROM found",
    "p4_counts": _ORPHANS + "SELECT table_name, field_name, kind, period, count(*) AS records FROM found GROUP BY ALL",
}
