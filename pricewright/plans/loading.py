"""Queries on loading parsed results, change logs, and what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import normalize
from pricewright.operators import diff, load, lookups
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry
from pricewright.runtime import table

QUERIES, ORACLE, query = registry()

_HASH = "sha256(concat_ws('|', {}))"
_KEY = lambda *cs: _HASH.format(", ".join(f"coalesce(lower(trim(cast({c} AS VARCHAR))), '')" for c in cs))


def _results(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parsed results as parsers of two makers give them, from the sheets and deliveries."""
    books = table(spark, d, "price_books").select(F.when(F.col("id") % 3 == 0, "Hager").when(F.col("id") % 3 == 1, " select hinges").otherwise("Maker-0").alias("manufacturer"), F.col("file_path").alias("file_name"), F.date_format("effective_date", "MMMM d, yyyy").alias("effective"), F.col("id").alias("pos"))
    e = table(spark, d, "sample_products_export")
    finishes = e.select(F.lit("Hager").alias("manufacturer"), F.col("finish").alias("code"), F.lit("").alias("name"), F.col("finish_description").alias("label"), F.col("export_id").alias("pos"))
    s = table(spark, d, "select_products_enhanced")
    products = s.select(F.lit("select hinges").alias("manufacturer"), "sku", "model", F.col("base_model").alias("series"), F.concat_ws(" ", F.lit("Hinge"), "duty").alias("description"), "base_price", F.col("record_id").alias("pos"))
    o = table(spark, d, "select_hinges_options")
    options = o.select(F.trim("manufacturer").alias("manufacturer"), F.col("code").alias("option_code"), F.col("label").alias("option_name"), F.col("add_type").alias("adder_type"), F.col("amount").alias("adder_value"), F.col("record_id").alias("pos"))
    rules = derived(spark, d, "old_rules").select(F.lit("hager").alias("manufacturer"), "signature", F.lit("a rule").alias("description"), "pos")
    return {"books": books, "finishes": finishes, "products": products, "options": options, "rules": rules}


def _catalog(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    m = table(spark, d, "manufacturers").select("name", "code")
    known = [("Hager", k) for k in normalize.FINISHES]
    f = table(spark, d, "product_families").select(F.lit("select hinges").alias("manufacturer"), "name")
    b = table(spark, d, "price_books").where("manufacturer_id is null").select(F.lit("").alias("manufacturer"), "edition")
    return {"manufacturers": m, "price_books": b, "finishes": spark.createDataFrame(known, "manufacturer string, code string"), "families": f}


def _loaded(spark: SparkSession, d: str) -> load.Loaded:
    return load.load(_results(spark, d), _catalog(spark, d))


_BOOKS = "(SELECT CASE id % 3 WHEN 0 THEN 'Hager' WHEN 1 THEN ' select hinges' ELSE 'Maker-0' END AS manufacturer, file_path AS file_name, effective_date, coalesce(nullif(regexp_extract(file_path, '(\\d{4})', 1), '') || ' Edition', 'Unknown Edition') AS edition, id AS pos FROM price_books)"
_MAKERS = f"""makers AS (SELECT min(name) AS name, code FROM (SELECT n, min(trim(manufacturer)) AS name, CASE WHEN contains(n, 'select') THEN 'SEL' WHEN contains(n, 'hager') THEN 'HAG' ELSE upper(substr(min(trim(manufacturer)), 1, 3)) END AS code FROM (SELECT *, lower(trim(manufacturer)) AS n FROM {_BOOKS}) GROUP BY n)
  WHERE n NOT IN (SELECT lower(trim(name)) FROM manufacturers WHERE name IS NOT NULL) AND code NOT IN (SELECT code FROM manufacturers) GROUP BY code)"""
_NEW_BOOKS = f"books AS (SELECT {_KEY('manufacturer', 'edition')} AS key_hash, arg_min({{'m': manufacturer, 'e': edition, 'd': effective_date, 'f': file_name, 'p': pos}}, pos) AS r FROM {_BOOKS} GROUP BY 1)"
_NEW_FINISHES = f"fins AS (SELECT key_hash, code, label AS name FROM (SELECT {_KEY(chr(39) + 'Hager' + chr(39), 'finish')} AS key_hash, finish AS code, finish_description AS label, row_number() OVER (PARTITION BY lower(trim(finish)) ORDER BY export_id) AS k FROM sample_products_export WHERE coalesce(finish, '') <> '') WHERE k = 1 AND upper(trim(code)) NOT IN ({', '.join(repr(k) for k in normalize.FINISHES)}))"
_NEW_FAMILIES = f"""fams AS (SELECT key_hash, name, 'Hinges' AS category, name || ' Series' AS description FROM (SELECT {_KEY(chr(39) + 'select hinges' + chr(39), 'f')} AS key_hash, f AS name, row_number() OVER (PARTITION BY lower(trim(f)) ORDER BY record_id) AS k FROM (SELECT record_id, coalesce(nullif(base_model, ''), nullif(model, '')) AS f FROM select_products_enhanced) WHERE f IS NOT NULL)
  WHERE k = 1 AND lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM product_families WHERE name IS NOT NULL))"""


@query(f"WITH {_MAKERS} SELECT name, code FROM makers")
def loaded_makers(spark: SparkSession, d: str) -> DataFrame:
    """Makers that are known neither by name nor by code."""
    return _loaded(spark, d).tables["manufacturers"]


@query(f"WITH {_NEW_BOOKS} SELECT key_hash, r.e AS edition, r.d AS effective_date, r.p AS pos FROM books")
def loaded_books(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).tables["price_books"].select("key_hash", "edition", "effective_date", "pos")


@query(f"WITH {_NEW_FINISHES} SELECT * FROM fins")
def loaded_finishes(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).tables["finishes"].select("key_hash", "code", "name")


@query(f"WITH {_NEW_FAMILIES} SELECT * FROM fams")
def loaded_families(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).tables["product_families"].select("key_hash", "name", "category", "description")


@query(f"SELECT {_KEY(chr(39) + 'select hinges' + chr(39), 'coalesce(nullif(base_model, ' + chr(39) * 2 + '), nullif(model, ' + chr(39) * 2 + '))')} AS family_key, sku, cast(base_price AS DECIMAL(10,2)) AS base_price, concat_ws(' ', 'Hinge', duty) AS description FROM select_products_enhanced")
def loaded_products(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d).tables["products"].select("family_key", "sku", "base_price", "description")


@query("SELECT trim(manufacturer) AS manufacturer, code AS option_type, code AS option_code, label AS option_name, cast(amount AS DECIMAL(10,2)) AS adder_value, cast(NULL AS BIGINT) AS product_id FROM select_hinges_options")
def loaded_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of a sheet as global options."""
    return _loaded(spark, d).tables["product_options"].select("manufacturer", "option_type", "option_code", "option_name", "adder_value", "product_id")


@query(f"SELECT 'price_rule' AS change_type, '{{\"signature\":\"' || signature || '\",\"description\":\"a rule\"}}' AS new_value FROM {oracle('old_rules')}")
def loaded_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules as rows of the change log."""
    return _loaded(spark, d).tables["change_logs"].select("change_type", "new_value")


@query(f"""WITH {_MAKERS}, {_NEW_BOOKS}, {_NEW_FINISHES}, {_NEW_FAMILIES} SELECT 'manufacturers' AS table_name, count(*) AS inserted FROM makers UNION ALL SELECT 'price_books', count(*) FROM books UNION ALL SELECT 'finishes', count(*) FROM fins UNION ALL SELECT 'product_families', count(*) FROM fams
UNION ALL SELECT 'products', count(*) FROM select_products_enhanced UNION ALL SELECT 'product_options', count(*) FROM select_hinges_options UNION ALL SELECT 'change_logs', count(*) FROM {oracle("old_rules")}""")
def load_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a whole load inserts."""
    return _loaded(spark, d).counts()


_FAMILY = "CASE WHEN sku LIKE 'BB%' THEN 'BB Series' WHEN sku LIKE 'H%' THEN 'H Series' WHEN sku LIKE 'S%' THEN 'S Series' WHEN contains(lower(coalesce(description, '')), 'hinge') THEN 'Hinges' WHEN contains(lower(coalesce(description, '')), 'lock') THEN 'Locks' WHEN contains(lower(coalesce(description, '')), 'handle') THEN 'Handles' END"


@query(f"SELECT id, family, CASE WHEN family IS NULL THEN 'General' WHEN contains(lower(family), 'hinge') THEN 'Hinges' WHEN contains(lower(family), 'lock') THEN 'Locks' WHEN contains(lower(family), 'handle') THEN 'Handles' WHEN contains(lower(family), 'series') THEN 'Hardware' ELSE 'General' END AS category FROM (SELECT DISTINCT id, {_FAMILY} AS family FROM products)")
def families_guessed(spark: SparkSession, d: str) -> DataFrame:
    """Families and categories by skus and descriptions."""
    p = table(spark, d, "products").select("id", load.family_of(F.col("sku"), F.col("description")).alias("family")).distinct()
    return p.withColumn("category", load.family_category(F.col("family")))


# --- change logs and exports -----------------------------------------------------


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.sku_changes(derived(spark, d, "old_skus"), derived(spark, d, "new_skus"))


@query(f"""WITH o AS (SELECT * FROM {oracle("old_skus")}), n AS (SELECT * FROM {oracle("new_skus")}) SELECT sku, 'retired_product' AS change, 'Product retired: ' || sku AS description FROM o WHERE sku NOT IN (SELECT sku FROM n) UNION ALL SELECT sku, 'new_product', 'New product added: ' || sku FROM n WHERE sku NOT IN (SELECT sku FROM o)
UNION ALL SELECT sku, 'price_change', printf('Price changed from $%.2f to $%.2f (%+.1f%%)', o.base_price, n.base_price, (n.base_price - o.base_price) / o.base_price * 100) FROM o JOIN n USING (sku) WHERE o.base_price <> n.base_price AND n.base_price <> 0
UNION ALL SELECT sku, 'description_change', 'Description updated for ' || sku FROM o JOIN n USING (sku) WHERE o.description <> n.description UNION ALL SELECT sku, 'status_change', 'Product ' || CASE WHEN n.is_active THEN 'activated' ELSE 'deactivated' END || ': ' || sku FROM o JOIN n USING (sku) WHERE o.is_active <> n.is_active""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Changes between two books as people read them."""
    return load.change_log(_changes(spark, d)).select("sku", "change", "description")


@query("SELECT id, sku, base_price FROM (SELECT DISTINCT id, sku, base_price FROM products) ORDER BY id, sku, base_price LIMIT 10")
def golden_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first ten products, as golden data starts from."""
    p = table(spark, d, "products").select("id", "sku", "base_price").distinct()
    return p.orderBy("id", "sku", "base_price").limit(10)


@query("SELECT record_id, code AS option_code, coalesce(nullif(label, ''), code) AS option_name, CASE WHEN trim(constraints_json) = '' THEN NULL ELSE constraints_json END AS constraints, to_json({'code': code, 'amount': amount}) AS item FROM select_hinges_options")
def options_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Options as flat rows for a sheet, nested parts as JSON."""
    o = table(spark, d, "select_hinges_options")
    item = F.to_json(F.struct("code", F.col("amount").alias("amount")), {"ignoreNullFields": "false"})
    return o.select("record_id", F.col("code").alias("option_code"), F.coalesce(F.nullif("label", F.lit("")), "code").alias("option_name"), F.when(F.trim("constraints_json") != "", F.col("constraints_json")).alias("constraints"), item.alias("item"))


@query("""SELECT m.code, b.id, b.effective_date, row_number() OVER (PARTITION BY m.code ORDER BY b.effective_date DESC NULLS LAST, b.id) AS place, coalesce(n.products, 0) AS products, sum(coalesce(n.products, 0)) OVER (PARTITION BY m.code) AS all_products, min(b.effective_date) OVER (PARTITION BY m.code) AS first_date
FROM (SELECT DISTINCT id, manufacturer_id, effective_date FROM price_books) b JOIN manufacturers m ON b.manufacturer_id = m.id LEFT JOIN (SELECT price_book_id, count(DISTINCT id) AS products FROM products GROUP BY 1) n ON n.price_book_id = b.id""")
def catalog_books(spark: SparkSession, d: str) -> DataFrame:
    """Each maker's books, newest first, with their products and the maker's totals."""
    from pyspark.sql import Window

    b = table(spark, d, "price_books").select("id", "manufacturer_id", "effective_date").distinct()
    n = table(spark, d, "products").select("price_book_id", "id").distinct().groupBy(F.col("price_book_id").alias("id")).agg(F.count("*").alias("n"))
    m = table(spark, d, "manufacturers").select(F.col("id").alias("manufacturer_id"), "code")
    j = b.join(m, "manufacturer_id").join(n, "id", "left").withColumn("products", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("code")
    return j.select("code", "id", "effective_date", F.row_number().over(w.orderBy(F.col("effective_date").desc_nulls_last(), "id")).alias("place"), "products", F.sum("products").over(w).alias("all_products"), F.min("effective_date").over(w).alias("first_date"))


@query("""SELECT p.price_book_id, p.id AS product_id, o.option_code FROM (SELECT DISTINCT id, price_book_id FROM products WHERE price_book_id IS NOT NULL) p JOIN (SELECT DISTINCT id % 50 AS price_book_id, option_code FROM product_options WHERE product_id IS NULL) o USING (price_book_id)""")
def options_for_all(spark: SparkSession, d: str) -> DataFrame:
    """Each global option of a book at each of its products."""
    o = table(spark, d, "product_options").where("product_id is null").select((F.col("id") % 50).alias("price_book_id"), "option_code").distinct()
    p = table(spark, d, "products").where("price_book_id is not null").select("id", "price_book_id").distinct()
    return load.options_for_all(o, p)


#: What the published table of items must have.
ITEM_COLUMNS = {"natural_key_hash": "string", "manufacturer": "string", "family": "string", "model": "string", "size": "string", "finish": "string", "base_price": "double", "confidence_score": "double", "currency": "string", "source_page": "int"}


@query("SELECT * FROM (VALUES ('natural_key_hash', 'string'), ('confidence_score', 'double'), ('currency', 'string'), ('source_page', 'int')) t(\"column\", \"type\")")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns an edition must get to be published."""
    return load.missing_columns(ITEM_COLUMNS, derived(spark, d, "new_edition"))


@query(f"SELECT cast(NULL AS VARCHAR) AS natural_key_hash, manufacturer, family, model, size, finish, base_price, cast(NULL AS DOUBLE) AS confidence_score, cast(NULL AS VARCHAR) AS currency, cast(NULL AS INT) AS source_page FROM {oracle('new_edition')}")
def rebuilt_items(spark: SparkSession, d: str) -> DataFrame:
    """An edition in the published table's columns."""
    return load.rebuilt(derived(spark, d, "new_edition"), ITEM_COLUMNS)


_ITEM = _KEY("manufacturer", "family", "model", "finish", "size")


@query(f"SELECT {_ITEM} AS natural_key_hash, manufacturer, family, model, finish, size, description, '' AS series, '' AS duty, '' AS extraction_method, base_price, 0.5 AS confidence_score, 0 AS source_page FROM {oracle('new_edition')}")
def published_items(spark: SparkSession, d: str) -> DataFrame:
    return load.published_items(derived(spark, d, "new_edition"))


@query(f"SELECT {_ITEM} AS item_natural_key, finish, 'base' AS price_type, base_price AS price, 'USD' AS currency, 0.5 AS confidence_score FROM {oracle('new_edition')}")
def published_prices(spark: SparkSession, d: str) -> DataFrame:
    return load.published_prices(derived(spark, d, "new_edition").withColumnRenamed("base_price", "price"))


@query("SELECT manufacturer, code AS option_code, coalesce(label, '') AS option_name, coalesce(cast(amount AS DOUBLE), 0) AS adder_value, coalesce(add_type, 'fixed') AS adder_type, coalesce(nullif(trim(constraints_json), ''), '{}') AS constraints FROM select_hinges_options")
def published_options(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "select_hinges_options")
    return load.published_options(o.select("manufacturer", F.col("code").alias("option_code"), F.col("label").alias("option_name"), F.col("amount").alias("adder_value"), F.col("add_type").alias("adder_type"), F.col("constraints_json").alias("constraints")))


_RULE = f"(SELECT lower(a.r_name) AS rule_type, 'US' || a.r_regionkey AS source_finish, 'US' || b.r_regionkey AS target_finish, a.r_regionkey * 5 AS percentage FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey)"


def _rules(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    b = r.select(F.col("r_regionkey").alias("k"))
    j = r.withColumn("k", F.explode(F.array(*map(F.lit, range(5))))).join(b, "k").where("k <> r_regionkey")
    return j.select(F.lower("r_name").alias("rule_type"), F.concat(F.lit("US"), F.col("r_regionkey").cast("string")).alias("source_finish"), F.concat(F.lit("US"), F.col("k").cast("string")).alias("target_finish"), (F.col("r_regionkey") * 5).alias("percentage"))


@query(f"""SELECT 'hager' AS manufacturer, rule_type, source_finish AS source_identifier, target_finish AS target_identifier, '{{"rule_type":"' || rule_type || '","source_finish":"' || source_finish || '","target_finish":"' || target_finish || '","percentage":' || percentage || '}}' AS rule_data FROM {_RULE}""")
def published_rules(spark: SparkSession, d: str) -> DataFrame:
    return load.published_rules(_rules(spark, d).withColumn("manufacturer", F.lit("hager")))


@query(f"SELECT concat_ws('|', rule_type, source_finish, target_finish, cast(percentage AS VARCHAR)) AS signature FROM {_RULE}")
def rule_signatures(spark: SparkSession, d: str) -> DataFrame:
    """What makes rules the same."""
    return _rules(spark, d).select(diff.rule_signature().alias("signature"))


@query("SELECT code, name FROM (VALUES ('HAG', 'Hager'), ('SEL', 'SELECT Hinges'), ('M01', 'Seed')) t(code, name) WHERE code NOT IN (SELECT code FROM manufacturers)")
def seed_makers(spark: SparkSession, d: str) -> DataFrame:
    """Seed rows that aren't there yet."""
    seed = spark.createDataFrame([("HAG", "Hager"), ("SEL", "SELECT Hinges"), ("M01", "Seed")], "code string, name string")
    return lookups.missing_rows(seed, table(spark, d, "manufacturers"), ["code"], "name")
