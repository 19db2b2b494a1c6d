"""Queries on layers of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import scoring
from pricewright.operators import layers
from pricewright.plans import tables
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry
from pricewright.runtime import table

QUERIES, ORACLE, query = registry()

_ANY = lambda ws: "(" + " OR ".join(f"contains(upper(text), '{w}')" for w in ws) + ")"


@query(f"""SELECT doc_id, contains(upper(text), '{layers.FINISH_PAGE}') AS finishes, doc_id <= 100 AND {_ANY(layers.RULE_WORDS)} AS rules, doc_id <= 100 AND {_ANY(layers.ADDITION_WORDS)} AS additions,
  contains(text, '$') OR {" + ".join(f"contains(text, '{w}')::int" for w in layers.ITEM_WORDS)} >= 2 AS items FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def page_steps(spark: SparkSession, d: str) -> DataFrame:
    """Which steps look at which pages."""
    return layers.page_steps(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


_L = oracle("layers")
_COMMON = "length(sku) >= 3 AND (" + " OR ".join(f"regexp_matches(upper(trim(sku)), '{p}')" for p in scoring.COMMON_SKUS) + " OR (NOT contains(trim(sku), ' ') AND regexp_matches(upper(trim(sku)), '^[A-Z0-9\\-/]+$') AND regexp_matches(upper(sku), '[A-Z]') AND regexp_matches(sku, '[0-9]')))"


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "layers").withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""SELECT layer, round(n / pages, 6) AS per_page, round(c, 6) AS confidence, round(bad, 6) AS invalid, n / pages < 12 OR c < 0.8 OR bad >= 0.25 AS second, n / pages < 5 AS third
FROM (SELECT layer, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN {_COMMON} THEN 0.0 ELSE 1.0 END) AS bad, (SELECT count(DISTINCT page) FROM {_L}) AS pages FROM {_L} GROUP BY 1)""")
def layer_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether what each layer found is enough by itself."""
    x = _layers(spark, d)
    out = None
    for k in (1, 2, 3):
        g = layers.gates(x.where(F.col("layer") == k), x).select(F.lit(k).alias("layer"), "*")
        out = g if out is None else out.unionByName(g)
    return out


@query(f"SELECT layer, pos, page FROM {_L} WHERE layer = 1 AND page NOT IN (SELECT page FROM {oracle('found_items')}) UNION ALL SELECT 9, pos, page FROM {oracle('found_items')}")
def layers_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A first layer without the pages that another one read, and the other."""
    a = _layers(spark, d).where("layer = 1").select("layer", "pos", "page")
    return layers.replaced(a, derived(spark, d, "found_items").select(F.lit(9).alias("layer"), "pos", "page"))


@query(f"SELECT layer, pos, round(least(1.0, confidence * 1.1), 6) AS confidence FROM {_L} WHERE confidence >= 0.6")
def scanner_items(spark: SparkSession, d: str) -> DataFrame:
    """A scanner's items from a confidence on, raised."""
    return layers.scanned(_layers(spark, d), 0.6).select("layer", "pos", F.round("confidence", 6).alias("confidence"))


_LT = oracle("length_tables")
_RX, _SIZE = "(?i)(SL\\s*\\d{2,3})\\s*([A-Z]{2})?\\s*([A-Z]+\\d*)?", '(HD\\d+|LD\\d+|LL|\\d+\\s*")'


@query(f"""WITH src AS (SELECT table_id, row_index, col_index, trim(cell) AS cell FROM {_LT} WHERE row_index > 0), heads AS (SELECT table_id, col_index, upper(trim(cell)) AS h FROM {_LT} WHERE row_index = 0),
rows AS (SELECT table_id, row_index, upper(replace(regexp_extract(cell, '{_RX}', 1), ' ', '')) AS base_model, nullif(upper(regexp_extract(cell, '{_RX}', 2)), '') AS f, coalesce(nullif(upper(regexp_extract(cell, '{_RX}', 3)), ''), nullif(replace(regexp_extract(cell, '{_SIZE}', 1), ' ', ''), '')) AS ld FROM src WHERE col_index = 0 AND regexp_matches(cell, '{_RX}')),
priced AS (SELECT *, list_filter(list_transform(regexp_extract_all(replace(cell, ',', ''), '\\$?\\s*(\\d+\\.?\\d{{0,2}})', 1), lambda x: try_cast(x AS DOUBLE)), lambda x: x BETWEEN 10 AND 5000)[1] AS base_price FROM src
  WHERE lower(cell) NOT IN ('', 'nan', 'none', '-', 'n/a') AND regexp_replace(regexp_replace(cell, 'SL\\d{{2,3}}', '', 'g'), '\\s+', '', 'g') NOT IN ('-', '')),
f AS (SELECT p.*, base_model, ld, h, CASE WHEN h IN ('CL', 'BR', 'BK') THEN h WHEN contains(h, 'CL') THEN 'CL' WHEN contains(h, 'BR') THEN 'BR' WHEN contains(h, 'BK') OR contains(h, 'BLACK') THEN 'BK' WHEN f IS NOT NULL THEN f WHEN regexp_matches(cell, '(?i)\\bCL\\b') THEN 'CL' WHEN regexp_matches(cell, '(?i)\\bBR\\b') THEN 'BR' WHEN regexp_matches(cell, '(?i)\\bBK\\b') THEN 'BK' END AS finish
  FROM priced p JOIN rows USING (table_id, row_index) LEFT JOIN heads USING (table_id, col_index) WHERE base_price IS NOT NULL),
l AS (SELECT *, coalesce(ld, first_value(nullif(replace(regexp_extract(cell, '{_SIZE}', 1), ' ', ''), '') IGNORE NULLS) OVER (PARTITION BY table_id, row_index ORDER BY col_index ROWS UNBOUNDED PRECEDING)) AS length_duty FROM f WHERE finish IN ('CL', 'BR', 'BK'))
SELECT table_id, row_index, col_index, concat_ws('_', base_model, finish, length_duty, nullif(regexp_extract(h, '(\\d+)\\s*"', 1), '')) AS sku, base_model, finish, length_duty, base_price FROM l""")
def every_price(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with a price as a product of its row's model."""
    return layers.every_price(*tables._length_cells(spark, d, "length_tables"))


_SOLD = "row_index, base_model, finish, duty, length, base_price, concat_ws('-', base_model, finish, duty, length) AS sku"


@query(f"SELECT table_id, {_SOLD} FROM ({tables.ORACLE['length_prices']}) UNION ALL SELECT table_id + 10000000, {_SOLD} FROM ({tables.ORACLE['packed_prices']})")
def priced_tables(spark: SparkSession, d: str) -> DataFrame:
    """Goods of both kinds of tables of lengths in one run."""
    a, b = (derived(spark, d, n) for n in ("length_tables", "packed_tables"))
    both = a.unionByName(b.withColumn("table_id", F.col("table_id") + 10_000_000))
    return layers.priced_tables(both.where("row_index > 0"), both.where("row_index = 0").select("table_id", "col_index", F.col("cell").alias("header")))


@query("""WITH h AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\d+\\.\\d{2}')) AS prices, len(regexp_extract_all(coalesce(text, ''), 'US\\d+')) AS finishes FROM documents)
SELECT doc_id, prices, finishes, (SELECT sum(prices) FROM h) AS of_all FROM h ORDER BY prices DESC, doc_id LIMIT 10""")
def busiest_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ten pages with most prices, and the sum over all pages."""
    h = layers.regex_hits(table(spark, d, "documents"), "doc_id", "text", {"prices": r"\d+\.\d{2}", "finishes": r"US\d+"})
    return layers.busiest(h, "prices", "doc_id")
