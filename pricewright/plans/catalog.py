"""Queries on catalogs, layers, text lines, cell grids, metrics and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import classify, keys, normalize, scoring
from pricewright.operators import grid, lines, lookups, merge, metrics, publish
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry
from pricewright.runtime import table

QUERIES, ORACLE, query = registry()


# --- lookups -----------------------------------------------------------------


@query("""SELECT l_partkey, l_shipdate AS priced_on, l_orderkey, l_extendedprice AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1""")
def latest_price(spark: SparkSession, d: str) -> DataFrame:
    """The newest price of each product."""
    rows = lookups.latest(table(spark, d, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_extendedprice"])
    return rows.select("l_partkey", F.col("l_shipdate").alias("priced_on"), "l_orderkey", F.col("l_extendedprice").alias("price"))


@query("""SELECT o.o_orderkey, o.o_custkey, p.o_orderkey AS previous FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) p ON o.o_custkey = p.o_custkey AND o.o_orderdate - INTERVAL 30 DAY >= p.o_orderdate""")
def order_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the customer's last one at least thirty days before it."""
    o = table(spark, d, "orders")
    left = o.select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("at"))
    right = o.groupBy("o_custkey", F.col("o_orderdate").alias("since")).agg(F.max("o_orderkey").alias("previous"))
    return lookups.as_of(left, right, "o_custkey", "at", "since", "previous").select("o_orderkey", "o_custkey", "previous")


@query("SELECT o_orderpriority, count(*) AS total, ceil(count(*) / 50.0) AS total_pages, CASE WHEN count(*) % 50 = 0 THEN 50 ELSE count(*) % 50 END AS last_page_size FROM orders GROUP BY 1")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return lookups.page_counts(table(spark, d, "orders"), ["o_orderpriority"], 50)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 50")
def second_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of fifty products by price."""
    return lookups.page(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey")], 2, 50).select("p_partkey", "p_name")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return lookups.top_per_key(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("""SELECT f.id, f.name, m.code, count(DISTINCT p.id) AS products FROM product_families f JOIN manufacturers m ON f.manufacturer_id = m.id LEFT JOIN products p ON p.family_id = f.id GROUP BY ALL""")
def family_summary(spark: SparkSession, d: str) -> DataFrame:
    """Products per family, families without any included."""
    n = table(spark, d, "products").select("family_id", "id").distinct().groupBy(F.col("family_id").alias("id")).agg(F.count("*").alias("n"))
    m = table(spark, d, "manufacturers").select(F.col("id").alias("manufacturer_id"), "code")
    f = table(spark, d, "product_families").select("id", "manufacturer_id", "name").join(m, "manufacturer_id")
    return f.join(n, "id", "left").select("id", "name", "code", F.coalesce("n", F.lit(0)).alias("products"))


@query("""WITH b AS (SELECT DISTINCT id, manufacturer_id, effective_date FROM price_books), n AS (SELECT price_book_id, count(DISTINCT id) AS n, count(DISTINCT sku) AS skus FROM products GROUP BY 1)
SELECT m.code, count(*) AS books, min(b.effective_date) AS first_date, max(b.effective_date) AS last_date, coalesce(sum(n), 0) AS products FROM b JOIN manufacturers m ON b.manufacturer_id = m.id LEFT JOIN n ON n.price_book_id = b.id GROUP BY 1""")
def maker_summary(spark: SparkSession, d: str) -> DataFrame:
    """Books, dates and products per manufacturer."""
    b = table(spark, d, "price_books").select("id", "manufacturer_id", "effective_date").distinct()
    n = table(spark, d, "products").select("price_book_id", "id").distinct().groupBy(F.col("price_book_id").alias("id")).agg(F.count("*").alias("n"))
    m = table(spark, d, "manufacturers").select(F.col("id").alias("manufacturer_id"), "code")
    j = b.join(m, "manufacturer_id").join(n, "id", "left")
    return j.groupBy("code").agg(F.count("*").alias("books"), F.min("effective_date").alias("first_date"), F.max("effective_date").alias("last_date"), F.coalesce(F.sum("n"), F.lit(0)).alias("products"))


@query("""SELECT b.id AS price_book_id, count(o.id) FILTER (o.product_id IS NOT NULL) AS own_options, (SELECT count(DISTINCT id) FROM product_options WHERE product_id IS NULL) AS global_options
FROM (SELECT DISTINCT id FROM price_books) b LEFT JOIN (SELECT DISTINCT id, price_book_id FROM products) p ON p.price_book_id = b.id LEFT JOIN (SELECT DISTINCT id, product_id FROM product_options) o ON o.product_id = p.id GROUP BY 1""")
def option_summary(spark: SparkSession, d: str) -> DataFrame:
    """Options per book: its products' own, and the global ones every book has."""
    o = table(spark, d, "product_options").select("id", "product_id").distinct()
    own = o.where("product_id is not null").groupBy("product_id").agg(F.count("*").alias("n"))
    p = table(spark, d, "products").select(F.col("id").alias("product_id"), "price_book_id").distinct()
    by_book = p.join(own, "product_id").groupBy("price_book_id").agg(F.sum("n").alias("own_options"))
    everywhere = o.where("product_id is null").agg(F.count("*")).scalar()
    b = table(spark, d, "price_books").select(F.col("id").alias("price_book_id")).distinct()
    return b.join(by_book, "price_book_id", "left").select("price_book_id", F.coalesce("own_options", F.lit(0)).alias("own_options"), everywhere.alias("global_options"))


@query("SELECT s_nationkey AS key, CASE WHEN c.k IS NULL THEN 'old' ELSE 'both' END AS side FROM (SELECT DISTINCT s_nationkey FROM supplier) s LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer) c ON k = s_nationkey UNION ALL SELECT DISTINCT c_nationkey, 'new' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def set_sides(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two tables: in the one, the other or both."""
    return lookups.set_sides(table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), table(spark, d, "customer").select(F.col("c_nationkey").alias("key")), "key")


@query("SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part WHERE p_brand || p_type NOT IN (SELECT p_brand || p_type FROM part WHERE p_size < 10) GROUP BY 1, 2")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Families to be created for goods whose family isn't known."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_size", "p_partkey")
    return lookups.missing_rows(p, p.where("p_size < 10"), ["p_brand", "p_type"], "p_partkey").select("p_brand", "p_type", "p_partkey")


@query("SELECT o.id FROM product_options o WHERE o.product_id IS NULL OR o.product_id NOT IN (SELECT record_id FROM deleted_records WHERE table_name = 'products')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Options that are left when the logged products are deleted."""
    gone = table(spark, d, "deleted_records").where("table_name = 'products'").select(F.col("record_id").alias("product_id"))
    return lookups.without(table(spark, d, "product_options"), gone, "product_id").select("id")


# --- merging sources ---------------------------------------------------------

_L = oracle("layers")
_KEY = "regexp_replace(upper(trim(sku)), '[\\s\\-_]', '', 'g')"
_MERGED = f"""WITH l AS (SELECT *, {_KEY} AS item_key FROM {_L}),
m AS (SELECT item_key, arg_min(sku, (-confidence, pos)) AS sku, arg_min(base_price, (-confidence, pos)) FILTER (base_price IS NOT NULL) AS p, arg_min(description, (-confidence, pos)) FILTER (description IS NOT NULL) AS description, arg_min(finish, (-confidence, pos)) FILTER (finish IS NOT NULL) AS finish,
  count(*) AS sources, count(DISTINCT method) AS methods, max(confidence) AS best, avg(base_price) AS mp, min(base_price) AS lo, max(base_price) AS hi, count(base_price) AS np FROM l GROUP BY 1),
x AS (SELECT *, coalesce(np > 1 AND lo > 0 AND (hi - lo) / lo <= 0.01, false) AS agree FROM m WHERE sources > 1 OR best >= 0.6),
merged AS (SELECT item_key, sku, round(CASE WHEN agree THEN mp ELSE p END, 4) AS base_price, description, finish, sources, methods, np > 1 AND NOT agree AS price_conflict,
  round(least(1.0, best + CASE WHEN sources < 2 THEN 0 WHEN methods >= 3 THEN 0.10 ELSE 0.08 END), 6) AS confidence FROM x)
"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "layers").withColumn("confidence", F.col("confidence").cast("double"))


@query(_MERGED + "SELECT * FROM merged")
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_sources(_layers(spark, d), ["description", "finish"])


@query(_MERGED + "SELECT count(*) AS items, round(count_if(sources > 1) / count(*), 6) AS multi_source_rate, round(count_if(confidence >= 0.9) / count(*), 6) AS trusted_rate, round(avg(confidence), 6) AS mean_confidence, count_if(price_conflict) AS conflicts FROM merged")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_stats(merge.merge_sources(_layers(spark, d), ["description", "finish"]))


@query(f"SELECT item_key, layer, pos FROM (SELECT *, {_KEY} AS item_key, row_number() OVER (PARTITION BY {_KEY} ORDER BY layer DESC, pos) AS k FROM {_L}) WHERE k = 1")
def merged_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return merge.by_priority(_layers(spark, d), "layer").select("item_key", "layer", "pos")


@query(f"SELECT item_key, base_price, pos FROM (SELECT *, {_KEY} AS item_key, row_number() OVER (PARTITION BY {_KEY} ORDER BY coalesce(base_price, -1) DESC, pos DESC) AS k FROM {_L}) WHERE k = 1")
def merged_by_price(spark: SparkSession, d: str) -> DataFrame:
    return merge.by_price(_layers(spark, d))


@query(f"SELECT p.page, coalesce(n, 0) AS found FROM (SELECT DISTINCT page FROM {_L}) p LEFT JOIN (SELECT page, count(*) AS n FROM {oracle('found_items')} GROUP BY 1) f ON p.page = f.page WHERE coalesce(n, 0) < 30")
def weak_pages(spark: SparkSession, d: str) -> DataFrame:
    return merge.weak_pages(_layers(spark, d), derived(spark, d, "found_items"), 30)


@query(f"""SELECT method, count(*) AS items, round(avg(confidence), 6) AS mean_confidence, count_if(confidence >= 0.8) AS high, count_if(confidence < 0.6) AS low,
  round(count(*) / sum(count(*)) OVER () * CASE method WHEN 'pdfplumber_digital' THEN 0.95 WHEN 'camelot_lattice' THEN 0.85 WHEN 'ocr_tesseract' THEN 0.5 ELSE 0.3 END, 6) AS weighted FROM (SELECT * REPLACE (confidence AS confidence) FROM {_L}) GROUP BY method""")
def extraction_quality(spark: SparkSession, d: str) -> DataFrame:
    return merge.extraction_quality(_layers(spark, d), scoring.PROVENANCE)


@query(f"""WITH f AS (SELECT {_KEY} AS k, arg_max(base_price, (coalesce(base_price, -1), pos)) AS p FROM {_L} GROUP BY 1)
SELECT count(*) AS golden, count(f.k) AS found, count_if(f.k IS NOT NULL AND abs(f.p - g.base_price) <= 5) AS "right", round(count(f.k) / count(*), 6) AS row_accuracy FROM {oracle("golden_items")} g LEFT JOIN f ON g.k = f.k""")
def golden_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The dearest extraction of each item against golden values."""
    return merge.accuracy(merge.by_price(_layers(spark, d)).withColumnRenamed("item_key", "k"), derived(spark, d, "golden_items"), "k", "base_price", 5.0)


# --- lines of text -----------------------------------------------------------

_LN = oracle("lines")


@query(f"""SELECT page_number, option_code, amount, min(line_no) AS line_no FROM (SELECT page_number, line_no, regexp_extract(line, '\\b([A-Z]{{2,4}}(?:-\\d{{1,2}})?)\\s+(?:add|adder|option):?\\s*\\$?(\\d+\\.?\\d*)', 1) AS option_code,
  try_cast(regexp_extract(line, '\\b([A-Z]{{2,4}}(?:-\\d{{1,2}})?)\\s+(?:add|adder|option):?\\s*\\$?(\\d+\\.?\\d*)', 2) AS DOUBLE) AS amount FROM {_LN}) WHERE option_code <> '' GROUP BY ALL""")
def line_adders(spark: SparkSession, d: str) -> DataFrame:
    return lines.adders(derived(spark, d, "lines"))


@query()
def line_items(spark: SparkSession, d: str) -> DataFrame:
    """Goods out of lines; its patterns look around, which the SQL's engine can't."""
    return lines.items(derived(spark, d, "lines"))


@query(f"SELECT page_number, line_no, 0 AS price_no, cast(regexp_extract(line, '\\$(\\d[\\d,]*\\.?\\d*)', 1) AS DOUBLE) AS price FROM {_LN} WHERE regexp_matches(line, '\\$\\d')")
def line_prices(spark: SparkSession, d: str) -> DataFrame:
    return lines.all_prices(derived(spark, d, "lines"))


@query(f"SELECT page_number, line_no, last_value(nullif(regexp_extract(line, '^Series (BB\\d+)', 1), '') IGNORE NULLS) OVER (PARTITION BY page_number ORDER BY line_no) AS series FROM {_LN}")
def line_series(spark: SparkSession, d: str) -> DataFrame:
    return lines.carry(derived(spark, d, "lines"), F.nullif(F.regexp_extract("line", r"^Series (BB\d+)", 1), F.lit("")), "series").select("page_number", "line_no", "series")


@query(f"SELECT page_number, line_no, sum(CASE WHEN line LIKE 'Series %' THEN 1 ELSE 0 END) OVER (PARTITION BY page_number ORDER BY line_no) AS block FROM {_LN}")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines.blocks(derived(spark, d, "lines"), F.col("line").startswith("Series ")).select("page_number", "line_no", "block")


@query(f"""WITH h AS (SELECT page_number, line_no, regexp_matches(line, '\\d') AS ok, row_number() OVER w - sum(CASE WHEN regexp_matches(line, '\\d') THEN 1 ELSE 0 END) OVER w AS i FROM {_LN} WINDOW w AS (PARTITION BY page_number ORDER BY line_no))
SELECT page_number, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM h WHERE ok GROUP BY page_number, i HAVING count(*) >= 2""")
def line_runs(spark: SparkSession, d: str) -> DataFrame:
    return lines.runs(derived(spark, d, "lines"), F.col("line").rlike(r"\d"))


@query(f"""SELECT *, CASE WHEN prices * 4 >= lines THEN 'data_table' WHEN codes > 0 THEN 'option_list' WHEN words < 20 THEN 'sparse' ELSE 'text' END AS kind FROM (
  SELECT page_number, count(*) AS lines, sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))) AS words, count_if(regexp_matches(line, '\\$\\d+')) AS prices, count_if(regexp_matches(line, 'US\\d+[A-Z]?|CTW|EPT|EMS')) AS codes FROM {_LN} GROUP BY 1)""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return lines.page_features(derived(spark, d, "lines"))


@query("""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> '') AS w, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM documents)
SELECT doc_id, round(CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z0-9$.,%-]+'))) / greatest(1, len(w)) * 0.6
  + least(1.0, coalesce(list_sum(list_transform(l, lambda s: length(s))), 0) / greatest(1, len(l)) / 50) * 0.4 - least(0.3, length(regexp_replace(text, '[^|§¦¨©«»°±²³]', '', 'g')) / length(text)))) END, 6) AS quality FROM t""")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(normalize.text_quality(F.col("text")), 6).alias("quality"))


@query("SELECT doc_id, k - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_lines(table(spark, d, "documents").select("doc_id", "text"))


# --- cell grids --------------------------------------------------------------

_C = oracle("cells")
_BLANK = "(cell IS NULL OR lower(trim(cell)) IN ('', 'nan', 'none'))"
_NUM = "try_cast(regexp_extract(regexp_replace(trim(cell), '[$,\\s]', '', 'g'), '^-?\\d+(?:\\.\\d+)?$') AS DOUBLE)"


@query(f"SELECT table_id, row_index, col_index, last_value(CASE WHEN NOT {_BLANK} THEN cell END IGNORE NULLS) OVER (PARTITION BY table_id, col_index ORDER BY row_index) AS filled FROM {_C}")
def cells_filled_down(spark: SparkSession, d: str) -> DataFrame:
    return grid.fill_down(derived(spark, d, "cells")).drop("cell")


@query(f"SELECT table_id, row_index, col_index, CASE WHEN row_index < 3 THEN last_value(CASE WHEN NOT {_BLANK} THEN cell END IGNORE NULLS) OVER (PARTITION BY table_id, row_index ORDER BY col_index) ELSE cell END AS filled FROM {_C}")
def cells_filled_right(spark: SparkSession, d: str) -> DataFrame:
    return grid.fill_right(derived(spark, d, "cells")).drop("cell")


@query(f"""WITH g AS (SELECT *, sum(CASE WHEN {_BLANK} THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, col_index ORDER BY row_index) AS g FROM {_C})
SELECT table_id, col_index, min(row_index) AS head_row, max(row_index) AS last_row FROM g WHERE g > 0 GROUP BY table_id, col_index, g HAVING count(*) > 1""")
def cells_merged(spark: SparkSession, d: str) -> DataFrame:
    return grid.merged_regions(derived(spark, d, "cells"))


_TYPES = f"(SELECT table_id, col_index, count(*) AS filled, count({_NUM}) AS numeric, CASE WHEN count({_NUM}) > count(*) * 0.7 THEN 'number' ELSE 'text' END AS kind FROM {_C} WHERE row_index < 10 AND NOT {_BLANK} GROUP BY 1, 2)"


@query(f"SELECT * FROM {_TYPES}")
def cell_types(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_types(derived(spark, d, "cells"))


@query(f"SELECT c.table_id, c.row_index, c.col_index, CASE WHEN t.kind = 'number' THEN {_NUM} END AS number FROM {_C} c LEFT JOIN {_TYPES} t ON c.table_id = t.table_id AND c.col_index = t.col_index")
def cells_typed(spark: SparkSession, d: str) -> DataFrame:
    return grid.typed(derived(spark, d, "cells")).select("table_id", "row_index", "col_index", "number")


@query(f"""SELECT table_id, rows, cols, completeness, digit_cells, cols * 10 + digit_cells AS quality, cols || 'x' || rows || '#' || mark AS fingerprint FROM (SELECT table_id, count(DISTINCT row_index) AS rows, count(DISTINCT col_index) AS cols, round(avg(CASE WHEN {_BLANK} THEN 0 ELSE 1 END), 6) AS completeness,
  count_if(NOT {_BLANK} AND regexp_matches(cell, '\\d')) AS digit_cells, string_agg(CASE WHEN {_NUM} IS NULL THEN 'T' ELSE 'N' END, '' ORDER BY col_index, row_index) FILTER (row_index < 3 AND col_index < 3) AS mark FROM {_C} GROUP BY 1)""")
def table_profiles(spark: SparkSession, d: str) -> DataFrame:
    return grid.table_profile(derived(spark, d, "cells"))


@query(f"""SELECT table_id, min(row_index) AS header_row FROM (SELECT table_id, row_index, lower(string_agg(coalesce(cell, ''), ' ' ORDER BY col_index)) AS t FROM {_C} WHERE row_index < 5 GROUP BY 1, 2) WHERE contains(t, 'urgent')::int + contains(t, 'call')::int + contains(t, 'high')::int + contains(t, '$')::int >= 2 GROUP BY 1""")
def header_rows(spark: SparkSession, d: str) -> DataFrame:
    return grid.header_row(derived(spark, d, "cells"), ["urgent", "call", "high", "$"])


@query(f"SELECT v.table_id, v.row_index, v.col_index, trim(k.cell) AS key, {_NUM.replace('cell', 'v.cell')} AS value FROM {_C} v JOIN {_C} k ON v.table_id = k.table_id AND v.row_index = k.row_index WHERE k.col_index = 0 AND v.col_index <> 0 AND {_NUM.replace('cell', 'v.cell')} IS NOT NULL AND NOT {_BLANK.replace('cell', 'k.cell')}")
def cells_unpivoted(spark: SparkSession, d: str) -> DataFrame:
    return grid.unpivot(derived(spark, d, "cells"))


@query(f"SELECT table_id, row_index, max(cell) FILTER (col_index = 0 AND NOT {_BLANK}) AS model, max(cell) FILTER (col_index = 1 AND NOT {_BLANK}) AS duty, max(cell) FILTER (col_index = 2 AND NOT {_BLANK}) AS price FROM {_C} GROUP BY 1, 2")
def cells_by_role(spark: SparkSession, d: str) -> DataFrame:
    return grid.pivot_rows(derived(spark, d, "cells"), {"model": 0, "duty": 1, "price": 2})


@query(f"""SELECT table_id, row_index, col_index, cell, found FROM (SELECT *, coalesce(lead(ok, 1) OVER w, lag(ok, 1) OVER w, lead(ok, 2) OVER w, lag(ok, 2) OVER w) AS found FROM (SELECT *, CASE WHEN regexp_matches(cell, '^[A-Z]$') THEN cell END AS ok FROM {_C}) WINDOW w AS (PARTITION BY table_id, row_index ORDER BY col_index)) WHERE {_NUM} IS NOT NULL""")
def cell_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return grid.neighbours(derived(spark, d, "cells"), F.col("cell").rlike("^[A-Z]$"))


_T = oracle("tall_cells")
_TALL_TYPES = f"(SELECT table_id, col_index, count(*) AS filled, count({_NUM}) AS numeric, CASE WHEN count({_NUM}) > count(*) * 0.7 THEN 'number' ELSE 'text' END AS kind FROM (SELECT * FROM {_T} WHERE NOT {_BLANK} QUALIFY row_number() OVER (PARTITION BY table_id, col_index ORDER BY row_index) <= 10) GROUP BY 1, 2)"


@query(f"SELECT * FROM {_TALL_TYPES}")
def tall_cell_types(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_types(derived(spark, d, "tall_cells"))


@query(f"SELECT c.table_id, c.row_index, c.col_index, CASE WHEN t.kind = 'number' THEN {_NUM} END AS number FROM {_T} c LEFT JOIN {_TALL_TYPES} t ON c.table_id = t.table_id AND c.col_index = t.col_index")
def tall_cells_typed(spark: SparkSession, d: str) -> DataFrame:
    return grid.typed(derived(spark, d, "tall_cells")).select("table_id", "row_index", "col_index", "number")


@query(f"""WITH r AS (SELECT table_id, row_index, lower(string_agg(coalesce(cell, ''), ' ' ORDER BY col_index)) AS t, count(*) AS n, count({_NUM}) AS k FROM {_T} GROUP BY 1, 2),
h AS (SELECT table_id, row_index, regexp_matches(t, '{"|".join(grid.HEADER_WORDS)}') AND k < n * 0.3 AND coalesce(abs(lead(k) OVER (PARTITION BY table_id ORDER BY row_index) - k) >= 2, true) AS head FROM r),
f AS (SELECT table_id, min(row_index) AS a FROM h WHERE head AND row_index < 3 GROUP BY 1),
g AS (SELECT f.table_id, a, coalesce(min(row_index), 3) AS b FROM f LEFT JOIN h ON f.table_id = h.table_id AND row_index BETWEEN a AND 2 AND NOT head GROUP BY 1, 2),
d AS (SELECT table_id, col_index, b - a AS rows, CASE WHEN NOT {_BLANK} THEN trim(cell) END AS t, min(row_index) AS pos FROM {_T} JOIN g USING (table_id) WHERE row_index >= a AND row_index < b GROUP BY 1, 2, 3, 4)
SELECT table_id, col_index, rows, coalesce(string_agg(t, ' ' ORDER BY pos), 'col_' || col_index) AS header FROM d GROUP BY 1, 2, 3""")
def tall_headers(spark: SparkSession, d: str) -> DataFrame:
    return grid.weld_headers(derived(spark, d, "tall_cells"))


@query(f"SELECT page, left_ AS start FROM (SELECT page, left_, lag(left_) OVER (PARTITION BY page ORDER BY left_) AS b FROM (SELECT DISTINCT page, left_ FROM {oracle('words')})) WHERE b IS NULL OR left_ - b >= 30")
def scanned_columns(spark: SparkSession, d: str) -> DataFrame:
    return grid.column_starts(derived(spark, d, "words"))


@query(f"SELECT page, count(*) AS words, round(avg(conf) / 100, 6) AS confidence FROM {oracle('words')} WHERE trim(word) <> '' AND conf > 0 GROUP BY 1")
def scanned_confidence(spark: SparkSession, d: str) -> DataFrame:
    w = derived(spark, d, "words").where("trim(word) <> '' and conf > 0")
    return w.groupBy("page").agg(F.count("*").alias("words"), scoring.rounded(F.avg("conf") / 100).alias("confidence"))


# --- normalisers -------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, try_cast(replace(CASE WHEN regexp_matches(t, '^\\$?[0-9,]+\\.?[0-9]*$') THEN regexp_extract(t, '^\\$?([0-9,]+\\.?[0-9]*)$', 1) ELSE regexp_extract(t, '([0-9,]+\\.?[0-9]*)', 1) END, ',', '') AS DECIMAL(18,4)) AS price, cast(l_linenumber % 3 <> 2 AS BOOLEAN) AS usable FROM (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ' $' || cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || ' ' WHEN 1 THEN 'USD ' || cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) ELSE 'call' END AS raw, trim(raw) AS t FROM lineitem)""")
def prices_normalised(spark: SparkSession, d: str) -> DataFrame:
    amount = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" $"), amount, F.lit(" "))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("USD "), amount)).otherwise("call")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", normalize.price(raw).alias("price"), normalize.price_usable(raw).alias("usable"))


@query("SELECT id, sku, CASE WHEN regexp_matches(t, '^[A-Z0-9-]{3,20}$') THEN t WHEN length(r) BETWEEN 2 AND 20 THEN r END AS clean, '^' || regexp_replace(sku, '\\d+', '\\\\d+', 'g') || '$' AS pattern FROM (SELECT DISTINCT id, sku, upper(trim(sku)) AS t, regexp_replace(upper(trim(sku)), '[^A-Z0-9-]', '', 'g') AS r FROM products)")
def skus_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("id", "sku").distinct().select("id", "sku", normalize.sku(F.col("sku")).alias("clean"), normalize.pattern_of(F.col("sku")).alias("pattern"))


@query("SELECT id, coalesce(nullif(regexp_extract(file_path, '(\\d{4})', 1), '') || ' Edition', 'Unknown Edition') AS edition, sha256(concat_ws('|', lower(trim(coalesce(edition, ''))), cast(manufacturer_id AS VARCHAR))) AS key FROM (SELECT DISTINCT id, edition, manufacturer_id, file_path FROM price_books)")
def editions_named(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "price_books").select("id", "edition", "manufacturer_id", "file_path").distinct()
    return b.select("id", normalize.edition_of(F.col("file_path")).alias("edition"), normalize.natural_key(F.col("edition"), F.col("manufacturer_id")).alias("key"))


@query("SELECT export_id, nullif(translate(upper(regexp_replace(sku, '[^A-Za-z0-9]', '', 'g')), 'OILZSBG', '0112586'), '') AS key FROM sample_products_export")
def scan_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_products_export").select("export_id", keys.scan_key(F.col("sku")).alias("key"))


@query("""WITH p AS (SELECT string_split(upper(sku), '') AS a, string_split(nullif(translate(upper(sku), 'OILZSBG', '0112586'), ''), '') AS b FROM sample_products_export)
SELECT a[i] AS read, b[i] AS meant, count(*) AS n FROM p, unnest(range(1, len(a) + 1)) t(i) WHERE a[i] <> b[i] GROUP BY 1, 2""")
def scan_substitutions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_products_export").select(F.upper("sku").alias("read"), F.translate(F.upper("sku"), keys.SCAN_FROM, keys.SCAN_TO).alias("meant"))
    return metrics.corrections(s, "read", "meant")


@query(f"SELECT layer, pos, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS level, round(least(1.0, CASE method WHEN 'pdfplumber_digital' THEN 0.95 WHEN 'camelot_lattice' THEN 0.9 ELSE 0.5 END * 0.7 + confidence * 0.3), 6) AS score FROM {_L}")
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    df = _layers(spark, d)
    return df.select("layer", "pos", scoring.level(F.col("confidence")).alias("level"), F.round(scoring.method_score(F.col("method"), F.col("confidence")), 6).alias("score"))


# --- metrics -----------------------------------------------------------------


@query("SELECT event_type AS name, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(arg_max(value, (ts, value)), 6) AS last FROM events GROUP BY 1")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metric_summary(table(spark, d, "events"), "event_type", "ts", "value")


@query("SELECT period, start, name, count(*) AS n FROM (SELECT 'day' AS period, date_trunc('day', ts) AS start, event_type AS name FROM events UNION ALL SELECT 'week', date_trunc('week', ts), event_type FROM events UNION ALL SELECT 'month', date_trunc('month', ts), event_type FROM events) GROUP BY ALL")
def period_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.period_counts(table(spark, d, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, grouping(event_type) AS is_total, count(*) AS n, count_if(value > 50) AS ok, round(count_if(value > 50) / count(*), 6) AS rate FROM events GROUP BY ROLLUP (event_type)")
def event_rates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rates(table(spark, d, "events"), "event_type", F.col("value") > 50)


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recent(table(spark, d, "events"), "ts", 24 * 60).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000")
def events_kept(spark: SparkSession, d: str) -> DataFrame:
    """The last thousand of each kind, as the retention rule keeps them."""
    return metrics.keep_last(table(spark, d, "events"), "event_type", "ts", "event_id", 1000).select("event_id")


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM f)
SELECT user_id AS user, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM n GROUP BY 1, 2""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sessions(table(spark, d, "events"), "user_id", "ts")


# --- publishing --------------------------------------------------------------

ITEMS = publish.TableRule(
    "Items", ("manufacturer", "family", "model", "size", "finish"),
    {"sku": publish.FieldRule(required=True, max_length=12, pattern=r"^[A-Z0-9-]+$"), "model": publish.FieldRule(required=True), "finish": publish.FieldRule(max_length=4, among=tuple(f"US{i}" for i in range(0, 28))), "base_price": publish.FieldRule(number=True, low=905, high=1900)},
)


@query(f"""SELECT violation, count(*) AS n FROM (SELECT 'finish:value' AS violation FROM {oracle('new_edition')} WHERE try_cast(replace(finish, 'US', '') AS INT) >= 28 UNION ALL SELECT 'base_price:low' FROM {oracle('new_edition')} WHERE base_price < 905 UNION ALL SELECT 'base_price:high' FROM {oracle('new_edition')} WHERE base_price > 1900) GROUP BY 1""")
def publish_violations(spark: SparkSession, d: str) -> DataFrame:
    return publish.violation_counts(derived(spark, d, "new_edition"), ITEMS)


_H = "sha256(concat_ws('|', lower(trim(manufacturer)), lower(trim(family)), lower(trim(model)), lower(trim(size)), lower(trim(finish))))"


@query(f"""SELECT s.h AS key_hash, CASE WHEN t.h IS NULL THEN 'create' WHEN s.base_price IS NOT DISTINCT FROM t.base_price AND s.description IS NOT DISTINCT FROM t.description THEN 'same' ELSE 'update' END AS action, s.base_price, s.description
FROM (SELECT {_H} AS h, base_price, description FROM {oracle('new_edition')}) s LEFT JOIN (SELECT {_H} AS h, base_price, description FROM {oracle('old_edition')}) t ON s.h = t.h""")
def publish_plan(spark: SparkSession, d: str) -> DataFrame:
    return publish.upsert_plan(derived(spark, d, "new_edition"), derived(spark, d, "old_edition"), ITEMS, ["base_price", "description"], "pos")


# --- classification, contracts, learned patterns ------------------------------

_SCORES = ", ".join("(" + " + ".join(f"regexp_matches(t, '(?i){p}')::int" for p in ps) + f") / {len(ps)} AS s_{k}" for k, ps in classify.PATTERNS.items())
_TOTAL = " + ".join(f"s_{k}" for k in classify.PATTERNS)
_SIGNS = "((s_data_table > 0.3)::int + priced + marked + (density > 3)::int)"


@query(
    f"""WITH s AS (SELECT doc_id, {_SCORES}, regexp_matches(t, '{classify.PRICE}')::int AS priced, regexp_matches(t, '{classify.MARKER}')::int AS marked,
  CASE WHEN length(t) = 0 THEN 0.0 ELSE len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> '')) / len(string_split(t, chr(10))) END AS density FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, CASE {" ".join(f"WHEN s_{k} > {x} THEN '{k}'" for k, x in classify.LADDER)} WHEN {_SIGNS} >= 2 THEN 'data_table' WHEN {_TOTAL} > 0.5 THEN 'mixed' ELSE 'unknown' END AS kind,
  round(CASE {" ".join(f"WHEN s_{k} > {x} THEN s_{k}" for k, x in classify.LADDER)} WHEN {_SIGNS} >= 2 THEN least(1.0, s_data_table + 0.2 * priced + 0.2 * marked + least(density / 10, 0.3)) WHEN {_TOTAL} > 0.5 THEN ({_TOTAL}) / 6 ELSE 0.1 END, 6) AS confidence FROM s"""
)
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", classify.page_class(F.col("text")).alias("c"))
    return c.select("doc_id", "c.kind", F.round("c.confidence", 6).alias("confidence"))


CONTRACT = publish.TableRule(
    "pricing_row", ("sku",),
    {
        "sku": publish.FieldRule(required=True, pattern="^[A-Z0-9]+[_ ][A-Z]{2}[_ ][A-Z0-9]+[_ ][0-9]+$"), "finish": publish.FieldRule(required=True, among=("NK", "BZ", "GR", "AL")),
        "length": publish.FieldRule(number=True, low=70, high=125), "base_price": publish.FieldRule(required=True, number=True, low=100, high=1800),
    },
)


@query(
    """SELECT violation, count(*) AS n FROM (
  SELECT 'sku:missing' AS violation FROM select_products_enhanced WHERE coalesce(trim(sku), '') = '' UNION ALL SELECT 'sku:pattern' FROM select_products_enhanced WHERE trim(sku) <> '' AND NOT regexp_matches(sku, '^[A-Z0-9]+[_ ][A-Z]{2}[_ ][A-Z0-9]+[_ ][0-9]+$')
  UNION ALL SELECT 'finish:missing' FROM select_products_enhanced WHERE coalesce(trim(finish), '') = '' UNION ALL SELECT 'finish:value' FROM select_products_enhanced WHERE trim(finish) <> '' AND finish NOT IN ('NK', 'BZ', 'GR', 'AL')
  UNION ALL SELECT 'length:number' FROM select_products_enhanced WHERE trim(length) <> '' AND try_cast(length AS DOUBLE) IS NULL UNION ALL SELECT 'length:low' FROM select_products_enhanced WHERE try_cast(length AS DOUBLE) < 70 UNION ALL SELECT 'length:high' FROM select_products_enhanced WHERE try_cast(length AS DOUBLE) > 125
  UNION ALL SELECT 'base_price:missing' FROM select_products_enhanced WHERE base_price IS NULL UNION ALL SELECT 'base_price:low' FROM select_products_enhanced WHERE base_price < 100 UNION ALL SELECT 'base_price:high' FROM select_products_enhanced WHERE base_price > 1800) GROUP BY 1"""
)
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of option sheets against the declared row contract."""
    return publish.violation_counts(table(spark, d, "select_products_enhanced"), CONTRACT)


@query("SELECT manufacturer, pattern, count(*) AS skus FROM (SELECT manufacturer, '^' || regexp_replace(upper(trim(sku)), '\\d+', '\\\\d+', 'g') || '$' AS pattern FROM (SELECT DISTINCT lower(manufacturer) AS manufacturer, sku FROM hager_products WHERE sku IS NOT NULL)) GROUP BY 1, 2")
def learned_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns the makers' skus generalise to, with how many skus teach them."""
    s = table(spark, d, "hager_products").where("sku is not null").select(F.lower("manufacturer").alias("manufacturer"), "sku").distinct()
    return s.groupBy("manufacturer", normalize.pattern_of(F.upper(F.trim("sku"))).alias("pattern")).agg(F.count("*").alias("skus"))


@query("SELECT word, count(*) AS n, count(DISTINCT id) AS products FROM (SELECT DISTINCT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda w: length(w) > 3))) AS word FROM products) GROUP BY 1")
def learned_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Words of descriptions and how many products have them."""
    w = table(spark, d, "products").select("id", F.explode(normalize.keywords(F.col("description"))).alias("word")).distinct()
    return w.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("id").alias("products"))


#: The scan rules for an engine without lookarounds: neighbours are put back.
_SCAN = [(r"\b0(\w)", r"O\1"), (r"(\w)0\b", r"\1O"), (r"\b1(\w)", r"I\1"), ("rn", "m"), ("vv", "w"), (r"\|", "I"), (r"\$(\s+)(\d)", r"$\2"), (r"(\d)\s+\.(\d{2})", r"\1.\2"), (r"([A-Z]+)(\s+)(\d+)", r"\1\3")]
_SCANNED = "SELECT export_id, description AS t, cast(coalesce(confidence, 0) AS DOUBLE) AS c FROM sample_products_export WHERE description IS NOT NULL"
for _find, _put in _SCAN:
    _SCANNED = f"SELECT export_id, n AS t, CASE WHEN n <> t THEN c * 0.9 ELSE c END AS c FROM (SELECT *, regexp_replace(t, '{_find}', '{_put}', 'g') AS n FROM ({_SCANNED}))"


@query(f"SELECT export_id, t AS text, round(c, 6) AS confidence FROM ({_SCANNED})")
def scan_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Extracted descriptions after the scan rules."""
    e = table(spark, d, "sample_products_export").where("description is not null")
    return e.select("export_id", classify.scan_fixes(F.col("description"), F.coalesce("confidence", F.lit(0.0))).alias("x")).select("export_id", "x.text", F.round("x.confidence", 6).alias("confidence"))
