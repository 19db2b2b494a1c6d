"""Queries on scores, corrections, feedback and extraction quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import scoring
from pricewright.operators import merge, review
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry
from pricewright.runtime import table

QUERIES, ORACLE, query = registry()

_CLAMP = "greatest(0.0, least(1.0, {}))"
_RAW = "CASE l_linenumber % 4 WHEN 0 THEN ' $' || cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) WHEN 1 THEN 'USD ' || cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) WHEN 2 THEN 'call' ELSE cast(cast(l_extendedprice * 40 AS DECIMAL(12,2)) AS VARCHAR) END"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, translate(trim({_RAW}), '$,', '') AS t, avg(cast(l_extendedprice AS DOUBLE)) OVER (PARTITION BY l_partkey) AS s FROM lineitem), v AS (SELECT *, try_cast(t AS DOUBLE) AS v FROM r)
SELECT l_orderkey, l_linenumber, round({_CLAMP.format("CASE WHEN regexp_matches(t, '^[$]?\\d+\\.?\\d*$') THEN 0.4 ELSE -0.2 END + CASE WHEN v IS NULL THEN -0.4 WHEN v BETWEEN 0.01 AND 50000 THEN 0.3 WHEN v > 50000 THEN 0.1 ELSE -0.3 END + CASE WHEN v IS NULL OR s IS NULL THEN 0 WHEN least(v, s) / greatest(v, s) > 0.5 THEN 0.2 ELSE -0.1 END")}, 6) AS score FROM v""")
def price_scores(spark: SparkSession, d: str) -> DataFrame:
    """Trust in prices as read, beside the mean of the same part's prices."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("double").alias("p"))
    k = F.col("l_linenumber") % 4
    text = lambda c: c.cast("decimal(12,2)").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" $"), text(F.col("p")))).when(k == 1, F.concat(F.lit("USD "), text(F.col("p")))).when(k == 2, "call").otherwise(text(F.col("p") * 40))
    mean = li.groupBy("l_partkey").agg(F.avg("p").alias("s"))
    return li.withColumn("raw", raw).join(mean, "l_partkey").select("l_orderkey", "l_linenumber", F.round(scoring.price_score(F.col("raw"), F.col("s")), 6).alias("score"))


def _sku_sql(own: str) -> str:
    return f"CASE WHEN coalesce(sku, '') = '' THEN 0.0 ELSE {_CLAMP.format(f'''CASE WHEN regexp_matches(t, '^[A-Z0-9-]{{2,20}}$') THEN 0.5 ELSE -0.3 END + CASE WHEN length(t) BETWEEN 3 AND 15 THEN 0.2 WHEN length(t) > 15 THEN -0.1 ELSE -0.2 END + CASE WHEN regexp_matches(t, '{own}') THEN 0.2 ELSE 0 END''')} END"


@query(f"""SELECT 'products' AS source, id AS record_id, round({_sku_sql("^[A-Z]{2,4}[0-9]{2,6}")}, 6) AS score FROM (SELECT DISTINCT id, sku, upper(trim(sku)) AS t FROM products)
UNION ALL SELECT 'sheets', record_id, round({_sku_sql("^SL[0-9]{2}|^[A-Z]{2,3}[0-9-]+")}, 6) FROM (SELECT record_id, sku, upper(trim(sku)) AS t FROM select_products_enhanced)""")
def sku_scores(spark: SparkSession, d: str) -> DataFrame:
    """Trust in skus by their maker's patterns."""
    a = table(spark, d, "products").select("id", "sku").distinct().select(F.lit("products").alias("source"), F.col("id").alias("record_id"), F.round(scoring.sku_score(F.col("sku"), "hager"), 6).alias("score"))
    b = table(spark, d, "select_products_enhanced").select(F.lit("sheets").alias("source"), "record_id", F.round(scoring.sku_score(F.col("sku"), "select_hinges"), 6).alias("score"))
    return a.unionByName(b)


@query(f"""WITH t AS (SELECT DISTINCT id, CASE id % 4 WHEN 0 THEN 'Effective ' || strftime(effective_date, '%m/%d/%Y') WHEN 1 THEN edition WHEN 2 THEN ' march 3, ' || (2015 + id % 20) ELSE '' END AS t FROM price_books)
SELECT id, round(CASE WHEN coalesce(t, '') = '' THEN 0.0 ELSE {_CLAMP.format(f'''CASE WHEN regexp_matches(trim(t), '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') OR regexp_matches(trim(t), '{scoring.LONG_DATE}') THEN 0.6 ELSE -0.4 END + CASE WHEN contains(lower(t), 'effective') THEN 0.3 ELSE 0 END
  + CASE WHEN NOT regexp_matches(t, '\\b20\\d{{2}}\\b') THEN 0 WHEN try_cast(regexp_extract(t, '\\b(20\\d{{2}})\\b', 1) AS INT) BETWEEN 2020 AND 2030 THEN 0.2 ELSE -0.2 END''')} END, 6) AS score FROM t""")
def date_scores(spark: SparkSession, d: str) -> DataFrame:
    """Trust in dates as books tell them."""
    k = F.col("id") % 4
    text = F.when(k == 0, F.concat(F.lit("Effective "), F.date_format("effective_date", "MM/dd/yyyy"))).when(k == 1, F.col("edition")).when(k == 2, F.concat(F.lit(" march 3, "), (F.lit(2015) + F.col("id") % 20).cast("string"))).otherwise("")
    return table(spark, d, "price_books").select("id", text.alias("t")).distinct().select("id", F.round(scoring.date_score(F.col("t")), 6).alias("score"))


_FIELD = {
    "sku": "CASE WHEN coalesce(v, '') = '' THEN 0.0 WHEN " + " OR ".join(f"regexp_matches(trim(v), '{p}')" for p in scoring.STRONG_SKUS) + " THEN 0.95 WHEN " + " OR ".join(f"regexp_matches(trim(v), '{p}')" for p in scoring.MIDDLING_SKUS) + " THEN 0.85 WHEN length(trim(v)) >= 3 THEN 0.60 ELSE 0.30 END",
    "base_price": "CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN 0.30 WHEN try_cast(v AS DOUBLE) BETWEEN 0.01 AND 100000 THEN 0.95 WHEN try_cast(v AS DOUBLE) > 0 AND try_cast(v AS DOUBLE) < 0.01 THEN 0.70 WHEN try_cast(v AS DOUBLE) > 100000 AND try_cast(v AS DOUBLE) <= 500000 THEN 0.80 ELSE 0.50 END",
    "description": f"CASE WHEN coalesce(v, '') = '' THEN 0.0 WHEN length(trim(v)) < 5 THEN 0.40 ELSE least(1.0, CASE WHEN length(trim(v)) > 20 THEN 0.85 ELSE 0.65 END + CASE WHEN regexp_matches(lower(v), '{'|'.join(scoring.TRADE)}') THEN 0.10 ELSE 0 END) END",
}


def _quality_sql(least: int, short: float) -> str:
    return f"CASE WHEN coalesce(trim(v), '') = '' THEN 0.0 WHEN contains(v, '�') OR contains(v, '||') OR contains(v, '|_') OR contains(v, '\\x') THEN 0.40 WHEN length(v) >= {least} THEN 0.90 ELSE {short} END"


@query(" UNION ALL ".join(f"""SELECT export_id, '{f}' AS field_name, round(s, 6) AS score, round(s, 6) >= {scoring.THRESHOLDS[f]} AS acceptable FROM (SELECT export_id, least(1.0, CASE WHEN coalesce(c, 0) = 0 THEN 0.7 ELSE c END * 0.4 + {_FIELD[f]} * 0.3 + {_quality_sql(*((2, 0.50) if f == "sku" else (3, 0.60)))} * 0.2 + CASE m WHEN 'layer2_camelot' THEN 0.9 WHEN 'layer1_text' THEN 0.85 ELSE 0.7 END * 0.1) AS s
FROM (SELECT export_id, cast({f} AS VARCHAR) AS v, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS c, CASE extraction_method WHEN 'camelot' THEN 'layer2_camelot' WHEN 'pdfplumber' THEN 'layer1_text' ELSE extraction_method END AS m FROM sample_products_export))""" for f in _FIELD))
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in the fields of extracted goods, and whether it is enough."""
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    m = F.when(F.col("extraction_method") == "camelot", "layer2_camelot").when(F.col("extraction_method") == "pdfplumber", "layer1_text").otherwise(F.col("extraction_method"))
    e = table(spark, d, "sample_products_export").withColumns({"c": c, "m": m})
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.round(scoring.field_score(f, F.col(f).cast("string"), F.col("m"), F.col("c")), 6).alias("score")) for f in _FIELD))
    x = e.select("export_id", F.explode(each).alias("x")).select("export_id", "x.*")
    enough = F.lit(None).cast("boolean")
    for f in _FIELD:
        enough = F.when(F.col("field_name") == f, scoring.acceptable(f, F.col("score"))).otherwise(enough)
    return x.withColumn("acceptable", enough)


_COMMON = "length(sku) >= 3 AND (" + " OR ".join(f"regexp_matches(t, '{p}')" for p in scoring.COMMON_SKUS) + " OR (NOT contains(t, ' ') AND regexp_matches(t, '^[A-Z0-9\\-/]+$') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]')))"


@query(f"""SELECT export_id, round(least(1.0, CASE WHEN length(sku) >= 4 THEN 0.50 ELSE 0 END + CASE WHEN length(sku) >= 4 AND ({_COMMON}) THEN 0.07 ELSE 0 END + CASE WHEN base_price BETWEEN 0.01 AND 100000 THEN 0.45 ELSE 0 END + CASE WHEN base_price BETWEEN 0.50 AND 50000 THEN 0.03 ELSE 0 END
  + CASE WHEN length(description) > 3 THEN 0.02 ELSE 0 END + CASE WHEN coalesce(finish, '') <> '' THEN 0.01 ELSE 0 END + CASE WHEN coalesce(options, '') <> '' THEN 0.01 ELSE 0 END), 6) AS score,
  length(trim(sku)) BETWEEN 3 AND 30 AND lower(trim(sku)) NOT IN ({", ".join(repr(x) for x in scoring.NOT_SKUS)}) AND NOT regexp_matches(trim(sku), '(?i)^[A-Z]{{3,9}}\\s+\\d{{1,2}}$') AND NOT regexp_matches(trim(sku), '^\\d{{4}}$') AND regexp_matches(sku, '[\\p{{L}}\\p{{N}}]') AS valid
FROM (SELECT *, upper(trim(sku)) AS t FROM sample_products_export)""".replace(" AS valid", " AS v0").replace("SELECT export_id, round", "SELECT export_id, score, coalesce(v0, false) AS valid FROM (SELECT export_id, round", 1) + ")")
def product_scores(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in extracted goods, and whether their sku can be one."""
    c = F.col
    return table(spark, d, "sample_products_export").select("export_id", F.round(scoring.product_score(c("sku"), c("base_price"), c("finish"), c("options"), c("description")), 6).alias("score"), scoring.valid_sku(c("sku")).alias("valid"))


_T = oracle("tall_cells")
_NUM = "try_cast(regexp_extract(regexp_replace(trim(cell), '[$,\\s]', '', 'g'), '^-?\\d+(?:\\.\\d+)?$') AS DOUBLE)"
_BLANK = "(cell IS NULL OR lower(trim(cell)) IN ('', 'nan', 'none'))"
_EXPECTED = ["model", "price", "finish", "weight"]


@query(f"""SELECT t.table_id, round({_CLAMP.format("filled * 0.4 + coalesce(found, 0) * 0.4 + CASE WHEN numeric THEN 0.2 ELSE 0 END")}, 6) AS score FROM (SELECT table_id, avg(CASE WHEN {_BLANK} THEN 0.0 ELSE 1.0 END) AS filled FROM {_T} GROUP BY 1) t
LEFT JOIN (SELECT table_id, ({" + ".join(f"max(contains(lower(cell), '{w}')::int)" for w in _EXPECTED)}) / {len(_EXPECTED)} AS found FROM (SELECT table_id, coalesce(cell, '') AS cell FROM {_T} WHERE row_index = 0) GROUP BY 1) f USING (table_id)
LEFT JOIN (SELECT table_id, bool_or(k > n * 0.7) AS numeric FROM (SELECT table_id, col_index, count(*) AS n, count({_NUM}) AS k FROM (SELECT * FROM {_T} WHERE NOT {_BLANK} QUALIFY row_number() OVER (PARTITION BY table_id, col_index ORDER BY row_index) <= 10) GROUP BY 1, 2) GROUP BY 1) n USING (table_id)""")
def table_scores(spark: SparkSession, d: str) -> DataFrame:
    """Trust in extracted tables."""
    from pricewright.functions.keys import is_blank
    from pricewright.operators import grid

    t = derived(spark, d, "tall_cells")
    filled = t.groupBy("table_id").agg(F.avg((~is_blank(F.col("cell"))).cast("double")).alias("filled"))
    head = t.where("row_index = 0").groupBy("table_id").agg((sum(F.max(F.contains(F.lower(F.coalesce("cell", F.lit(""))), F.lit(w)).cast("int")) for w in _EXPECTED) / len(_EXPECTED)).alias("found"))
    numeric = grid.column_types(t).groupBy("table_id").agg(F.bool_or(F.col("kind") == "number").alias("numeric"))
    x = filled.join(head, "table_id", "left").join(numeric, "table_id", "left")
    return x.select("table_id", F.round(scoring.table_score(F.col("filled"), F.coalesce("found", F.lit(0.0)), F.coalesce("numeric", F.lit(False))), 6).alias("score"))


_L = oracle("layers")
_W = "CASE method WHEN 'pdfplumber_digital' THEN 0.95 WHEN 'camelot_lattice' THEN 0.85 WHEN 'ocr_tesseract' THEN 0.5 ELSE 0.3 END"


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "layers").withColumn("confidence", F.col("confidence").cast("double"))


@query(f"""WITH first5 AS (SELECT page, layer, sku, base_price, method FROM {_L} QUALIFY row_number() OVER (PARTITION BY page, layer ORDER BY pos) <= 5), scored AS (SELECT page, layer, method, ({_sku_sql("^$")} + CASE WHEN base_price IS NULL THEN 0 WHEN base_price BETWEEN 0.01 AND 50000 THEN 0.7 ELSE 0.5 END) / CASE WHEN base_price IS NULL THEN 1 ELSE 2 END AS s FROM (SELECT *, upper(trim(sku)) AS t FROM first5))
SELECT page, layer, round({_CLAMP.format("CASE max(method) WHEN 'pdfplumber_digital' THEN 0.95 WHEN 'camelot_lattice' THEN 0.9 ELSE 0.5 END * 0.4 + avg(s) * 0.6 * 0.6")}, 6) AS score FROM scored GROUP BY 1, 2""")
def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    """Trust in a page's extraction by each layer, from its first five goods."""
    from pyspark.sql import Window

    f = _layers(spark, d).withColumn("_k", F.row_number().over(Window.partitionBy("page", "layer").orderBy("pos"))).where("_k <= 5")
    p, s = F.col("base_price"), scoring.sku_score(F.col("sku"))
    each = F.when(p.isNull(), s).otherwise((s + scoring.price_score(p.cast("decimal(18,2)").cast("string"))) / 2)
    g = f.groupBy("page", "layer").agg(F.max("method").alias("m"), F.avg(each).alias("s"))
    return g.select("page", "layer", F.round(scoring.overall_score(scoring.method_score(F.col("m"), F.lit(None).cast("double")), None, F.col("s")), 6).alias("score"))


@query(f"""SELECT count(*) AS items, round(avg({_W}) * 0.6 + avg(confidence) * 0.4, 6) AS quality, round(avg(confidence), 6) AS mean_confidence, count_if(confidence >= 0.8) AS high, count_if(confidence >= 0.6 AND confidence < 0.8) AS medium, count_if(confidence < 0.6) AS low, count_if(confidence < 0.5) AS issues,
  coalesce((SELECT string_agg(sku, ',' ORDER BY pos) FROM (SELECT sku, pos FROM {_L} WHERE confidence < 0.5 ORDER BY pos LIMIT 10)), '') AS first_issues,
  array_to_string(list_filter([CASE WHEN count_if(method = 'ocr_tesseract') > count(*) * 0.5 THEN 'scan_in_higher_resolution' END, CASE WHEN count_if(method = 'failed') > 0 THEN 'check_files_that_failed' END, CASE WHEN avg(confidence) < 0.6 THEN 'review_by_hand' END, CASE WHEN count_if(confidence < 0.5) > count(*) * 0.2 THEN 'review_input_and_configuration' END], lambda x: x IS NOT NULL), ',') AS advice FROM {_L}""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row on the whole extraction, with what to do about it."""
    return merge.quality_summary(_layers(spark, d), scoring.PROVENANCE)


@query(f"""WITH s AS (SELECT count(*) AS items, avg({_W}) * 0.6 + avg(confidence) * 0.4 AS quality, avg(confidence) AS mean FROM {_L}), m AS (SELECT method, count(*) AS n FROM {_L} GROUP BY 1), p AS (SELECT page, count(*) AS n FROM {_L} GROUP BY 1)
SELECT 0 AS part, 0 AS line_no, printf('Total Items: %d', items) AS line FROM s UNION ALL SELECT 0, 1, printf('Quality Score: %.2f', round(quality, 6)) FROM s UNION ALL SELECT 0, 2, printf('Average Confidence: %.2f', round(mean, 6)) FROM s
UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, method) - 1, printf('%s: %d (%.1f%%)', method, n, n / (SELECT items FROM s) * 100) FROM m UNION ALL SELECT 2, row_number() OVER (ORDER BY page) - 1, printf('Page %d: %d items', page, n) FROM p""")
def provenance_report(spark: SparkSession, d: str) -> DataFrame:
    """The text report on an extraction."""
    x = _layers(spark, d)
    return review.report_lines(merge.quality_summary(x, scoring.PROVENANCE), x.groupBy("method").agg(F.count("*").alias("items")), x.groupBy("page").agg(F.count("*").alias("items")))


@query(f"SELECT layer, pos, round(least(1.0, confidence + CASE WHEN n >= 3 THEN 0.08 WHEN n = 2 THEN 0.05 ELSE 0 END), 6) AS confidence FROM (SELECT l.*, n FROM (SELECT *, regexp_replace(sku, '[^0-9]', '', 'g') AS k FROM {_L}) l JOIN (SELECT regexp_replace(sku, '[^0-9]', '', 'g') AS k, count(DISTINCT layer) AS n FROM {_L} GROUP BY 1) USING (k))")
def layer_boost(spark: SparkSession, d: str) -> DataFrame:
    """Confidence raised by the number of layers that found a sku."""
    x = _layers(spark, d).withColumn("sku", F.regexp_replace("sku", "[^0-9]", ""))
    return merge.layer_boost(x).select("layer", "pos", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT items, round(sure / items, 6) AS sure_rate, CASE WHEN sure / items >= 0.9 THEN 'excellent' WHEN sure / items >= 0.7 THEN 'good' WHEN sure / items >= 0.5 THEN 'fair' ELSE 'poor' END AS label,
  array_to_string(list_filter([CASE WHEN unpriced > 0 THEN 'items_without_price' END, CASE WHEN unnamed > 0 THEN 'items_without_sku' END, CASE WHEN sure / items < 0.7 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS warnings
FROM (SELECT count(*) AS items, count_if(confidence >= 0.8) AS sure, count_if(base_price IS NULL) AS unpriced, count_if(coalesce(trim(sku), '') = '') AS unnamed FROM {_L})""")
def result_validation(spark: SparkSession, d: str) -> DataFrame:
    """How far a whole result can be trusted."""
    return merge.result_validation(_layers(spark, d))


@query("""WITH o AS (SELECT *, upper(trim(option_code)) AS k, (id % 40 + 60) / 100.0 AS c FROM (SELECT DISTINCT id, option_code, option_name, adder_type, adder_value FROM product_options) WHERE trim(coalesce(option_code, '')) <> '')
SELECT k AS option_key, arg_min(option_name, (-c, id)) FILTER (option_name IS NOT NULL) AS option_name, arg_min(adder_type, (-c, id)) FILTER (adder_type IS NOT NULL) AS adder_type, round(avg(cast(adder_value AS DOUBLE)), 4) AS adder_value, count(adder_value) AS adder_sources, count(*) AS sources,
  round(least(1.0, max(c) + CASE count(*) WHEN 1 THEN 0 WHEN 2 THEN 0.08 ELSE 0.10 END), 6) AS confidence FROM o GROUP BY 1""")
def merged_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of all sources, one row per code."""
    o = table(spark, d, "product_options").select("id", "option_code", "option_name", "adder_type", "adder_value").distinct()
    return merge.merge_options(o.withColumns({"pos": F.col("id"), "confidence": (F.col("id") % 40 + 60) / 100}), ["option_name", "adder_type"])


@query(f"SELECT DISTINCT page FROM {_L} WHERE page NOT IN (SELECT page FROM {oracle('found_items')})")
def failed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which nothing was found."""
    return merge.failed_pages(_layers(spark, d), derived(spark, d, "found_items"))


@query("""WITH g AS (SELECT DISTINCT upper(trim(code)) AS option_code FROM select_hinges_options WHERE trim(code) <> ''), f AS (SELECT upper(trim(option_code)) AS found_code, min(id) AS pos FROM product_options WHERE trim(option_code) <> '' GROUP BY 1)
SELECT g.option_code, arg_min(found_code, (pos, found_code)) AS found_code FROM g LEFT JOIN f ON contains(g.option_code, f.found_code) OR contains(f.found_code, g.option_code) GROUP BY 1""")
def golden_options(spark: SparkSession, d: str) -> DataFrame:
    """Golden option codes with the first found code that holds them, or that they hold."""
    g = table(spark, d, "select_hinges_options").select(F.upper(F.trim("code")).alias("option_code")).where("option_code <> ''")
    f = table(spark, d, "product_options").select(F.upper(F.trim("option_code")).alias("option_code"), "id").where("option_code <> ''").groupBy("option_code").agg(F.min("id").alias("pos"))
    return merge.options_of_golden(f, g)


# --- corrections and feedback ------------------------------------------------------

_MENDED = "replace(regexp_replace(trim(sku, ' '), '[�|]', '', 'g'), '\\x00', '')"
for _read, _digit in (("O", "0"), ("I", "1"), ("l", "1")):
    # Twice, as a digit between two of them is a neighbour of both.
    for _ in range(2):
        _MENDED = f"regexp_replace({_MENDED}, '(\\d){_read}(\\d|$)', '\\1{_digit}\\2', 'g')"
_CORRECTED = f"""WITH c AS (SELECT export_id, CASE WHEN sku = '' THEN sku ELSE {_MENDED} END AS sku, CASE WHEN {_MENDED} <> sku THEN sku END AS sku_original, base_price AS p, description AS d, trim(regexp_replace(regexp_replace(description, '�|\\\\x00|\\|\\||\\|_', '', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM sample_products_export),
x AS (SELECT *, min(export_id) OVER (PARTITION BY sku) AS first_id FROM c),
items AS (SELECT export_id, sku, sku_original, cast(p AS DOUBLE) AS base_price, CASE WHEN d = '' THEN d ELSE t END AS description, sku_original IS NOT NULL OR coalesce(t <> d, false) AS was_corrected, coalesce(sku <> '' AND export_id > first_id, false) AS is_duplicate FROM x),
judged AS (SELECT *, list_filter([CASE WHEN is_duplicate THEN 'sku' END, CASE WHEN base_price < 0.01 THEN 'base_price' END], lambda v: v IS NOT NULL) AS errors, list_filter([CASE WHEN base_price > 50000 THEN 'base_price' END, CASE WHEN description <> '' AND length(description) < 5 THEN 'description' END], lambda v: v IS NOT NULL) AS warnings FROM items)
"""


@query(_CORRECTED + "SELECT * REPLACE (array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings) FROM judged")
def corrected_items(spark: SparkSession, d: str) -> DataFrame:
    """Extracted goods put right."""
    e = table(spark, d, "sample_products_export").select("export_id", "sku", F.col("base_price").cast("string").alias("base_price"), "description")
    c = review.corrected(e, "export_id")
    return c.withColumns({"errors": F.array_join("errors", ","), "warnings": F.array_join("warnings", ",")})


@query(_CORRECTED + "SELECT count(*) AS items, count_if(was_corrected) AS corrected, sum(len(errors)) AS errors, sum(len(warnings)) AS warnings, round(1 - sum(len(errors)) / count(*), 6) AS rate FROM judged")
def correction_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "sample_products_export").select("export_id", "sku", F.col("base_price").cast("string").alias("base_price"), "description")
    return review.correction_summary(review.corrected(e, "export_id"))


_FB = """(SELECT substr(sku, 1, 2) AS manufacturer, 'sku' AS field_name, upper(sku) AS original_value, substr(upper(sku), 1, 2) || translate(substr(upper(sku), 3), 'OILZ', '0112') AS corrected_value, exported_at AS ts, export_id FROM sample_products_export WHERE sku IS NOT NULL
UNION ALL SELECT substr(sku, 1, 2), 'finish', finish, replace(upper(finish), 'U5', 'US'), exported_at, export_id FROM sample_products_export WHERE sku IS NOT NULL)"""


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback as scans give it: skus and finishes as read and as meant."""
    e = table(spark, d, "sample_products_export").where("sku is not null")
    maker, up = F.substring("sku", 1, 2), F.upper("sku")
    a = e.select(maker.alias("manufacturer"), F.lit("sku").alias("field_name"), up.alias("original_value"), F.concat(F.substring(up, 1, 2), F.translate(F.expr("substring(upper(sku), 3)"), "OILZ", "0112")).alias("corrected_value"), F.col("exported_at").alias("ts"), "export_id")
    b = e.select(maker.alias("manufacturer"), F.lit("finish").alias("field_name"), F.col("finish").alias("original_value"), F.replace(F.upper("finish"), F.lit("U5"), F.lit("US")).alias("corrected_value"), F.col("exported_at").alias("ts"), "export_id")
    return a.unionByName(b)


_REPORT = f"report AS (SELECT CASE WHEN grouping(manufacturer) = 1 THEN 'all' ELSE manufacturer END AS manufacturer, field_name, count(*) AS total, count_if(original_value IS DISTINCT FROM corrected_value) AS errors, round(1 - count_if(original_value IS DISTINCT FROM corrected_value) / count(*), 6) AS accuracy FROM {_FB} GROUP BY GROUPING SETS ((manufacturer, field_name), (field_name)))"
_PATTERNS = f"""chars AS (SELECT manufacturer, field_name, string_split(original_value, '') AS a, string_split(corrected_value, '') AS b FROM {_FB} WHERE length(original_value) = length(corrected_value) AND original_value <> corrected_value),
patterns AS (SELECT manufacturer, field_name, a[i] AS read, b[i] AS meant, count(*) AS n FROM chars, range(1, 100) t(i) WHERE i <= len(a) AND a[i] <> b[i] GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY manufacturer ORDER BY n DESC, field_name, read, meant) AS rank FROM patterns)"""


@query(f"WITH {_REPORT} SELECT * FROM report")
def feedback_report(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per maker and field, and per field over all makers."""
    return review.feedback_report(_feedback(spark, d))


@query(f"WITH {_PATTERNS} SELECT * FROM ranked WHERE rank <= 10")
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent corrections of each maker."""
    return review.top_patterns(review.error_patterns(_feedback(spark, d)))


@query(f"WITH {_REPORT}, {_PATTERNS} SELECT manufacturer, field_name AS subject, 'improve_patterns' AS advice FROM report WHERE manufacturer <> 'all' AND total >= 10 AND accuracy < 0.9 UNION ALL SELECT manufacturer, field_name || ':' || read || '->' || meant, 'add_correction_rule' FROM ranked WHERE rank <= 3 AND n >= 5")
def feedback_advice(spark: SparkSession, d: str) -> DataFrame:
    f = _feedback(spark, d)
    return review.advice(review.feedback_report(f), review.error_patterns(f))


@query(f"""WITH RECURSIVE {_PATTERNS}, rules AS (SELECT manufacturer, field_name, list({{'r': read, 'm': meant}} ORDER BY n DESC, read, meant) AS rs FROM patterns WHERE n >= 3 GROUP BY 1, 2),
history AS (SELECT manufacturer, field_name, original_value, arg_min(corrected_value, ts) AS known FROM {_FB} WHERE export_id % 2 = 0 GROUP BY 1, 2, 3),
vals AS (SELECT export_id, substr(sku, 1, 2) AS manufacturer, 'sku' AS field_name, upper(sku) AS v FROM sample_products_export WHERE sku IS NOT NULL)
SELECT export_id, v AS value, CASE WHEN h.original_value IS NOT NULL THEN known END AS suggested FROM vals LEFT JOIN history h ON vals.manufacturer = h.manufacturer AND vals.field_name = h.field_name AND v = h.original_value""".replace("WHERE export_id % 2 = 0 ", ""))
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """What skus should be, by what the same ones were corrected to."""
    e = table(spark, d, "sample_products_export").where("sku is not null").select("export_id", F.substring("sku", 1, 2).alias("manufacturer"), F.lit("sku").alias("field_name"), F.upper("sku").alias("value"))
    return review.suggestions(e, _feedback(spark, d)).select("export_id", "value", "suggested")


_TRUSTED = "(SELECT substr(sku, 1, 2) AS manufacturer, export_id, sku, CASE WHEN confidence > 1 THEN confidence / 100 ELSE coalesce(confidence, 0) END AS c, '^' || regexp_replace(upper(trim(sku)), '\\d+', '\\\\d+', 'g') || '$' AS p FROM sample_products_export WHERE sku IS NOT NULL)"


@query(f"SELECT export_id, round(CASE WHEN k.p IS NOT NULL THEN least(1.0, c + 0.05) ELSE c END, 6) AS confidence FROM {_TRUSTED} t LEFT JOIN (SELECT DISTINCT manufacturer, p FROM {_TRUSTED} WHERE c >= 0.97) k USING (manufacturer, p)".replace("k.p IS NOT NULL", "k.known").replace("SELECT DISTINCT manufacturer, p FROM", "SELECT DISTINCT manufacturer, p, true AS known FROM"))
def learned_boost(spark: SparkSession, d: str) -> DataFrame:
    """Confidence raised where a pattern that trusted skus teach fits."""
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.coalesce("confidence", F.lit(0.0)))
    e = table(spark, d, "sample_products_export").where("sku is not null").select("export_id", "sku", F.substring("sku", 1, 2).alias("manufacturer"), c.alias("confidence"))
    return review.learned_boost(e, review.learned(e, 0.97)).select("export_id", F.round("confidence", 6).alias("confidence"))


@query("""SELECT doc_id, length(trim(t, ' ')) < 50 OR (regexp_matches(lower(t), 'model|price|description|series|[$]') AND doc_id % 3 = 0) OR (doc_id % 3 > 0 AND doc_id % 10 / 10.0 < 0.3) AS scan,
  coalesce(list_sum(list_transform(string_split(t, chr(10)), lambda s: (length(trim(s, ' ')) = 1)::int + regexp_full_match(trim(s, ' '), '[0-9]{1,2}')::int)) > len(string_split(t, chr(10))) * 0.3, false) AS rotated FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def scan_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Which pages should be scanned, and which may be rotated."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", review.scan_needed(F.col("text"), k % 3, k % 10 / 10).alias("scan"), review.maybe_rotated(F.coalesce("text", F.lit(""))).alias("rotated"))
