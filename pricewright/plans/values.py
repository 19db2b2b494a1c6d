"""Queries on scalar normalisers, statistics and list helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import normalize, scoring
from pricewright.operators import lookups, metrics
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry
from pricewright.runtime import table

QUERIES, ORACLE, query = registry()


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'prices effective ' || strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%b') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) WHEN 4 THEN month(o_orderdate) || '-' || day(o_orderdate) || '-' || year(o_orderdate) ELSE 'soon' END AS raw, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN cast(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 6 < 5 THEN 0.95 ELSE 0.2 END AS score FROM t""")
def dates_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Dates in the notations of books, and what they are worth."""
    k, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    words = F.date_format(day, "d, yyyy")
    raw = F.when(k == 0, F.concat(F.lit("prices effective "), F.date_format(day, "MMMM "), words)).when(k == 1, F.date_format(day, "MM/dd/yyyy")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).when(k == 3, F.concat(F.date_format(day, "MMM "), words)).when(k == 4, F.date_format(day, "M-d-yyyy")).otherwise("soon")
    o = table(spark, d, "orders").select("o_orderkey", normalize.date(raw).alias("day"))
    return o.withColumn("score", normalize.normalised_score(F.col("day"), "date"))


_ENTRY = " ".join(f"WHEN t IN ({', '.join(repr(a) for a in (k, *alts))}) THEN '{{}}'".format(f"{k}|{name}") for k, (name, alts) in normalize.FINISHES.items())


@query(f"SELECT export_id, t AS code, nullif(split_part(e, '|', 1), '') AS bhma, nullif(split_part(e, '|', 2), '') AS name, coalesce(nullif(split_part(e, '|', 1), ''), t, '') AS short FROM (SELECT export_id, t, CASE {_ENTRY} ELSE '' END AS e FROM (SELECT export_id, nullif(upper(trim(CASE export_id % 3 WHEN 0 THEN ' orb ' WHEN 1 THEN finish ELSE 'AnT' END)), '') AS t FROM sample_products_export))")
def finishes_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Finishes by their codes and other names."""
    k = F.col("export_id") % 3
    raw = F.when(k == 0, " orb ").when(k == 1, F.col("finish")).otherwise("AnT")
    e = table(spark, d, "sample_products_export").select("export_id", raw.alias("raw"))
    return e.select("export_id", normalize.finish_entry(F.col("raw")).alias("x"), F.coalesce(normalize.finish(F.col("raw")), F.lit("")).alias("short")).select("export_id", "x.*", "short")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'EA' WHEN 2 THEN 'SET' WHEN 3 THEN 'DZ' WHEN 4 THEN 'LF' WHEN 5 THEN 'A VERY LON' ELSE 'EA' END AS unit FROM lineitem""")
def units_normalised(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ["each", " Set", "DOZ ", "linear foot", "a very long unit", "", None])), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", normalize.unit(raw).alias("unit"))


@query("SELECT export_id, trim(regexp_replace(regexp_replace(description, '\\s+', ' ', 'g'), '[^\\w\\s\\-.,()/&]', '', 'g')) AS text, trim(regexp_replace(regexp_replace(description, '�|\\\\x00|\\|\\||\\|_', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM sample_products_export")
def descriptions_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions with odd characters and with debris alone taken out."""
    return table(spark, d, "sample_products_export").select("export_id", normalize.description(F.col("description")).alias("text"), normalize.clean_text(F.col("description")).alias("clean"))


_LOOSE = "CASE l_linenumber % 4 WHEN 0 THEN '$' || cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) WHEN 1 THEN replace(cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') || ' EUR' WHEN 2 THEN '1,' || cast(cast(l_quantity AS INT) + 100 AS VARCHAR) ELSE 'call' END"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_LOOSE} AS raw, regexp_replace({_LOOSE}, '[^\\d.,-]', '', 'g') AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, try_cast(CASE WHEN NOT contains(t, '.') AND len(string_split(t, ',')) = 2 AND length(string_split(t, ',')[2]) <= 2 THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS DOUBLE) AS price, regexp_matches(raw, '^\\$?\\d+\\.?\\d*$|^\\$?\\d{{1,3}}(,\\d{{3}})*(\\.\\d{{1,2}})?$') AS looks_like_price FROM t""")
def loose_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices whose comma may be a decimal mark."""
    k, amount = F.col("l_linenumber") % 4, F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("$"), amount)).when(k == 1, F.concat(F.replace(amount, F.lit("."), F.lit(",")), F.lit(" EUR"))).when(k == 2, F.concat(F.lit("1,"), (F.col("l_quantity").cast("int") + 100).cast("string"))).otherwise("call")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", normalize.loose_price(raw).alias("price"), normalize.looks_like_price(raw).alias("looks_like_price"))


@query("""SELECT export_id, coalesce(regexp_replace(regexp_replace(upper(trim(s)), '^[^A-Z0-9_-]+', ''), '[^A-Z0-9_-]+$', ''), '') AS clean, regexp_replace(regexp_replace(coalesce(sku, ''), '-US\\d+[A-Z]*$', ''), '-+$', '') AS model, CASE WHEN contains(upper(sku), 'US3') THEN 'US3' WHEN contains(upper(sku), 'US4') THEN 'US4' WHEN contains(upper(sku), 'US10B') THEN 'US10B' WHEN contains(upper(sku), 'US15') THEN 'US15' WHEN contains(upper(sku), 'US26D') THEN 'US26D' END AS finish,
  coalesce(length(sku) >= 3 AND regexp_matches(upper(sku), '^BB\\d+|^BBH\\d+|^[A-Z]{2,3}\\d+|^[A-Z]+\\d+[A-Z]*'), false) AS looks_like_sku FROM (SELECT export_id, sku, '* ' || sku || ' #.' AS s FROM sample_products_export)""")
def loose_skus(spark: SparkSession, d: str) -> DataFrame:
    """Skus without marks at their ends, with their model and finish."""
    s = F.col("sku")
    return table(spark, d, "sample_products_export").select("export_id", normalize.loose_sku(F.concat(F.lit("* "), s, F.lit(" #."))).alias("clean"), normalize.model_of(s).alias("model"), normalize.finish_in(s).alias("finish"), normalize.looks_like_sku(s).alias("looks_like_sku"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 5 WHEN 0 THEN 'Effective date: ' || strftime(o_orderdate, '%m/%d/%Y') || ' of 1/2/03' WHEN 1 THEN 'seen 7-8-99, prices effective ' || strftime(o_orderdate, '%m-%d-%y') WHEN 2 THEN 'from ' || strftime(o_orderdate, '%m/%d/%y') WHEN 3 THEN '' ELSE 'no date' END AS t FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m-%d-%y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%y') END AS named, CASE WHEN o_orderkey % 5 < 3 THEN cast(o_orderdate AS DATE) WHEN o_orderkey % 5 = 4 THEN DATE '2020-01-01' END AS day FROM t""")
def dates_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Effective dates texts name in figures; what isn't a date is a given day."""
    k, day = F.col("o_orderkey") % 5, lambda f: F.date_format("o_orderdate", f)
    text = F.when(k == 0, F.concat(F.lit("Effective date: "), day("MM/dd/yyyy"), F.lit(" of 1/2/03"))).when(k == 1, F.concat(F.lit("seen 7-8-99, prices effective "), day("MM-dd-yy"))).when(k == 2, F.concat(F.lit("from "), day("MM/dd/yy"))).when(k == 3, "").otherwise("no date")
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"), normalize.date_in(text).alias("named"))
    return o.select("o_orderkey", "named", normalize.date_or(F.when(F.col("t") == "", "").otherwise(F.coalesce("named", "t")), F.to_date(F.lit("2020-01-01"))).alias("day"))


_SPACED = "regexp_replace(regexp_replace(regexp_replace(text, '\\$\\s+', '$', 'g'), '(\\d)\\s*,\\s*(\\d{3})', '\\1,\\2', 'g'), '(\\d)\\s+\\.(\\d{2})', '\\1.\\2', 'g')"
for _rx, _mark in normalize.UNIT_WORDS:
    _SPACED = f"regexp_replace({_SPACED}, '(?i){_rx}', '{_mark}', 'g')"


@query(f"SELECT doc_id, md5({_SPACED}) AS mark, CASE {' '.join(f'''WHEN contains(lower(coalesce(text, '')), '{m}') THEN '{m}' ''' for m in normalize.MAKERS)} ELSE 'unknown' END AS maker FROM documents")
def texts_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Texts with amounts closed up and units marked, as digests, and the maker they name."""
    return table(spark, d, "documents").select("doc_id", F.md5(normalize.spacing(F.col("text"))).alias("mark"), normalize.maker_in(F.col("text")).alias("maker"))


_LN = oracle("lines")


@query(f"""SELECT page_number, line_no, trim(coalesce(nullif(regexp_extract(line, '(?i)(\\d+\\.?\\d*\\s*x\\s*\\d+\\.?\\d*)', 1), ''), nullif(regexp_extract(line, '(?i)(\\d+"\\s*x\\s*\\d+")', 1), ''), nullif(regexp_extract(line, '(?i)(\\d+\\.?\\d*)\\s*(?:in|inch|mm|cm)', 1), ''))) AS size,
  array_to_string(list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(line, '(?i)\\bUS\\s*\\d+[A-Z]?\\b'), regexp_extract_all(line, '(?i)\\b[A-Z]{{2,3}}\\b')), regexp_extract_all(line, '(?i)\\bBHMA\\s*\\d+[A-Z]?\\b')), lambda x: trim(x)))), ',') AS finishes FROM {_LN}""")
def line_marks(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and finishes lines name."""
    return derived(spark, d, "lines").select("page_number", "line_no", normalize.size_in(F.col("line")).alias("size"), F.array_join(normalize.finishes_in(F.col("line")), ",").alias("finishes"))


# --- statistics and lists -----------------------------------------------------------


@query("""SELECT count(*) AS total, count_if(o_orderstatus = 'F') AS successful, count_if(o_orderstatus = 'P') AS failed, count_if(o_orderstatus = 'O') AS running, count_if(o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS recent, round(count_if(o_orderstatus = 'F') / count(*) * 100, 6) AS success_rate,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 90 + 1 END), 6) AS avg_seconds, sum(o_custkey % 7) AS total_rows FROM orders""")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of runs: totals by state, those of the last thirty days, success, durations, rows."""
    o = table(spark, d, "orders")
    runs = o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_custkey") % 90 + 1)).alias("completed_at"), (F.col("o_custkey") % 7).alias("rows_processed"))
    return metrics.run_statistics(runs, {"successful": "F", "failed": "P", "running": "O"})


@query("SELECT snapshot_name, count(*) AS rows, round(avg(nullif(base_price, 0)), 4) AS mean_price, min(nullif(base_price, 0)) AS least, max(nullif(base_price, 0)) AS most, count_if(is_active) AS active, count_if(NOT is_active) AS inactive FROM hager_products GROUP BY 1")
def sheet_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Prices and states of each delivery, as summary sheets show them."""
    return metrics.sheet_statistics(table(spark, d, "hager_products"), "snapshot_name")


@query("WITH r AS (SELECT event_type AS name FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE) SELECT count_if(name = 'purchase') AS errors, count(*) AS requests, round(coalesce(count_if(name = 'purchase') / nullif(count(*), 0), 0), 6) AS error_rate, coalesce(count_if(name = 'purchase') / nullif(count(*), 0), 0) < 0.05 AS healthy FROM r")
def health(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of the last five minutes and whether it is low."""
    return metrics.health(table(spark, d, "events"), "ts", F.col("event_type") == "purchase", F.lit(True))


_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{rx}') THEN '{k}'" for k, rx in normalize.ERRORS.items()) + " ELSE 'unknown' END"
_NAMED = "(SELECT CASE event_id % 6 WHEN 0 THEN 'errors_ValueError' WHEN 1 THEN 'errors_parse_page' WHEN 2 THEN 'http_status_404' WHEN 3 THEN 'http_status_503' WHEN 4 THEN 'http_status_200' ELSE 'errors_PermissionDenied' END AS name FROM events)"


@query(f"SELECT 'category' AS kind, {_CAT.replace('name', 'substr(name, 8)')} AS value, count(*) AS n FROM {_NAMED} WHERE name LIKE 'errors\\_%' ESCAPE '\\' GROUP BY 2 UNION ALL SELECT 'status', substr(name, 13), count(*) FROM {_NAMED} WHERE regexp_matches(name, '^http_status_[45]') GROUP BY 2")
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Errors by category and by state, from the names of counters."""
    names = F.element_at(F.array(*map(F.lit, ["errors_ValueError", "errors_parse_page", "http_status_404", "http_status_503", "http_status_200", "errors_PermissionDenied"])), (F.col("event_id") % 6 + 1).cast("int"))
    return metrics.error_counts(table(spark, d, "events").select(names.alias("name")))


@query("""WITH b AS (SELECT id, row_number() OVER (ORDER BY effective_date DESC NULLS LAST, upload_date DESC NULLS LAST, id) AS k FROM (SELECT DISTINCT id, effective_date, upload_date FROM price_books))
SELECT 2 AS page, count(*) AS total, ceil(count(*) / 50.0) AS total_pages, 2 < ceil(count(*) / 50.0) AS has_next, true AS has_previous, coalesce(string_agg(id, ',' ORDER BY k) FILTER (k BETWEEN 51 AND 100), '') AS ids FROM b""")
def books_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of books, newest first, undated last, with its envelope."""
    b = table(spark, d, "price_books").select("id", "effective_date", "upload_date").distinct()
    return lookups.envelope(b, [F.col("effective_date").desc_nulls_last(), F.col("upload_date").desc_nulls_last(), F.col("id")], 2, 50, "id")


@query("SELECT export_id, sku, base_price, k AS place FROM (SELECT export_id, sku, base_price, row_number() OVER (ORDER BY try_cast(regexp_replace(finish, '[^0-9.]', '', 'g') AS DOUBLE) NULLS LAST, lower(finish) NULLS LAST, export_id) AS k FROM sample_products_export WHERE contains(lower(concat_ws(' ', sku, description, finish)), 'pivot')) WHERE k <= 25")
def searched(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 goods with a word anywhere, sorted by a column's numbers, then its letters."""
    e = table(spark, d, "sample_products_export").select("export_id", "sku", "base_price", "description", "finish")
    return lookups.search(e, "pivot", ["sku", "description", "finish"], "finish", "export_id", 25).select("export_id", "sku", "base_price", "place")


@query("SELECT id, CASE WHEN updated_at IS NOT NULL AND created_at IS NOT NULL THEN epoch(updated_at) - epoch(created_at) END AS seconds, updated_at IS NULL AS running, json_extract_string(j, '$.sku') AS sku, cast(json_extract_string(j, '$.base_price') AS DECIMAL(10,2)) AS base_price FROM (SELECT DISTINCT id, created_at, updated_at, to_json({'sku': sku, 'base_price': base_price}) AS j FROM products)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """How long records took, and their snapshot written as JSON and read again."""
    p = table(spark, d, "products").select("id", "created_at", "updated_at", "sku", "base_price").distinct()
    seconds = F.unix_micros(F.col("updated_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    back = F.from_json(F.to_json(F.struct("sku", "base_price")), "sku string, base_price decimal(10,2)")
    return p.select("id", seconds.alias("seconds"), F.col("updated_at").isNull().alias("running"), back.alias("x")).distinct().select("id", "seconds", "running", "x.*")


@query(f"SELECT layer, pos, coalesce(CASE WHEN pos % 3 > 0 THEN confidence END, 0.7) AS confidence FROM {oracle('layers')}")
def confidences_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "layers").select("layer", "pos", scoring.unwrapped(F.when(F.col("pos") % 3 > 0, F.col("confidence"))).alias("confidence"))
