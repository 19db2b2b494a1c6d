"""Loading parsed results into the catalog, and what leaves it again.

Every load is a get-or-create by natural keys: rows of a batch whose key isn't
known yet, once each. Keys are the SHA-256 of the natural key, so loads of
different tables need no numbers of each other and may run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions import normalize
from pricewright.functions.normalize import natural_key


def maker_code(name: Column) -> Column:
    """A maker's code: of the two known ones their own, else the first three letters."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("select")), "SEL").when(F.contains(low, F.lit("hager")), "HAG").otherwise(F.upper(F.substring(name, 1, 3)))


def family_of(sku: Column, description: Column) -> Column:
    """A product's family by how its sku begins, else by its description."""
    low = F.lower(F.coalesce(description, F.lit("")))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(sku.startswith("BB"), "BB Series").when(sku.startswith("H"), "H Series").when(sku.startswith("S"), "S Series")
        .when(has("hinge"), "Hinges").when(has("lock"), "Locks").when(has("handle"), "Handles")
    )


def family_category(family: Column) -> Column:
    """A family's category by its name."""
    low = F.lower(family)
    has = lambda w: F.contains(low, F.lit(w))
    return F.when(has("hinge"), "Hinges").when(has("lock"), "Locks").when(has("handle"), "Handles").when(has("series"), "Hardware").otherwise("General")


def product_category(description: Column, series: Column) -> Column:
    """A product's category by its description and series."""
    d, s = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(series, F.lit("")))
    either = lambda w: F.contains(d, F.lit(w)) | F.contains(s, F.lit(w))
    return F.when(either("hinge"), "Hinges").when(either("lock"), "Locks").when(F.contains(d, F.lit("door")), "Door Hardware").otherwise("Hardware")


def new_makers(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, code) of makers that aren't known by name or code. names: (name)."""
    batch = names.where(F.coalesce(F.trim("name"), F.lit("")) != "").groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min(F.trim("name")).alias("name"))
    batch = batch.withColumn("code", maker_code(F.col("name")))
    batch = batch.join(known.select(F.lower(F.trim("name")).alias("_n")), "_n", "left_anti").join(known.select("code"), "code", "left_anti")
    return batch.groupBy("code").agg(F.min("name").alias("name")).select("name", "code")


def new_rows(batch: DataFrame, known: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a batch whose key isn't known, the first by order of each key, with
    their natural key. Keys compare trimmed and regardless of case; null is empty."""
    key = natural_key(*(F.col(k) for k in keys)).alias("key_hash")
    rows = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r"))
    fresh = rows.join(known.select(key), "key_hash", "left_anti")
    return fresh.select("key_hash", "r.*")


@dataclass
class Loaded:
    """The new rows of each table of a load."""

    tables: dict[str, DataFrame]

    def counts(self) -> DataFrame:
        """(table_name, inserted) of all tables."""
        out = None
        for name, df in self.tables.items():
            n = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("inserted"))
            out = n if out is None else out.unionByName(n)
        return out


def load(results: dict[str, DataFrame], catalog: dict[str, DataFrame]) -> Loaded:
    """What a batch of parsed results adds to a catalog.

    results: books (manufacturer, file_name, effective), finishes (manufacturer,
    code, name, label), products (manufacturer, sku, model, series, description,
    base_price), options (manufacturer, option_code, option_name, adder_type,
    adder_value) and rules (manufacturer, description, ...), each with a column
    pos. catalog: manufacturers (name, code), price_books (manufacturer,
    edition), finishes (manufacturer, code) and families (manufacturer, name).

    Makers are known by name or code, books by maker and edition, finishes by
    maker and code, families by maker and name. Products aren't compared with
    those there are; options are global ones, whose type is their code; rules
    become change-log rows of type price_rule. Writing the tables is the
    caller's: each is a plain append."""
    books = results["books"].withColumns({"edition": normalize.edition_of(F.col("file_name")), "effective_date": normalize.date(F.col("effective"))}).select("manufacturer", "edition", "effective_date", "file_name", "pos")
    finishes = results["finishes"].withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "label")).where(F.coalesce("code", F.lit("")) != "")
    p = results["products"].withColumn("family", F.coalesce(F.nullif("series", F.lit("")), F.nullif("model", F.lit(""))))
    families = p.where("family is not null").select("manufacturer", F.col("family").alias("name"), product_category(F.col("description"), F.col("series")).alias("category"), F.concat("family", F.lit(" Series")).alias("description"), "pos")
    products = p.select(natural_key(F.col("manufacturer"), F.col("family")).alias("family_key"), "manufacturer", "sku", "model", "description", F.col("base_price").try_cast("decimal(10,2)").alias("base_price"), F.lit(True).alias("is_active"))
    options = results["options"].select("manufacturer", F.lit(None).cast("bigint").alias("product_id"), F.col("option_code").alias("option_type"), "option_code", "option_name", "adder_type", F.col("adder_value").try_cast("decimal(10,2)").alias("adder_value"), F.lit(False).alias("is_required"))
    rules = results["rules"]
    logs = rules.select("manufacturer", F.lit("price_rule").alias("change_type"), F.to_json(F.struct(*[c for c in rules.columns if c not in ("manufacturer", "pos")])).alias("new_value"), "description")
    return Loaded({
        "manufacturers": new_makers(results["books"].select(F.col("manufacturer").alias("name")), catalog["manufacturers"]), "price_books": new_rows(books, catalog["price_books"], ["manufacturer", "edition"], "pos"),
        "finishes": new_rows(finishes, catalog["finishes"], ["manufacturer", "code"], "pos"), "product_families": new_rows(families, catalog["families"], ["manufacturer", "name"], "pos"), "products": products, "product_options": options, "change_logs": logs,
    })


def options_for_all(options: DataFrame, products: DataFrame, book: str = "price_book_id") -> DataFrame:
    """Each global option of a book at each of the book's products: an equi-join
    on the book, (book, product_id, option_code). Its size is what is asked for."""
    return products.select(book, F.col("id").alias("product_id")).join(options.select(book, "option_code"), book)


def change_log(changes: DataFrame) -> DataFrame:
    """Changes between two books as people read them: (sku, change, old_value,
    new_value, percent, description). changes: as sku_changes gives them."""
    price = lambda c: F.format_string("$%.2f", F.col(c).try_cast("double"))
    text = (
        F.when(F.col("change") == "fuzzy_match", F.concat(F.lit("Product likely renamed: "), "old_value", F.lit(" → "), "new_value"))
        .when(F.col("change") == "retired_product", F.concat(F.lit("Product retired: "), "sku")).when(F.col("change") == "new_product", F.concat(F.lit("New product added: "), "sku"))
        .when(F.col("change") == "price_change", F.concat(F.lit("Price changed from "), price("old_value"), F.lit(" to "), price("new_value"), F.format_string(" (%+.1f%%)", "percent")))
        .when(F.col("change") == "description_change", F.concat(F.lit("Description updated for "), "sku"))
        .otherwise(F.concat(F.lit("Product "), F.when(F.col("new_value") == "true", "activated").otherwise("deactivated"), F.lit(": "), "sku"))
    )
    return changes.withColumn("description", text)


def golden_sample(products: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first n products by order, as golden data starts from."""
    return products.orderBy(order).limit(n)


def missing_columns(wanted: dict[str, str], have: DataFrame) -> DataFrame:
    """(column, type) a table must get so that it has all wanted columns; columns
    are only ever added."""
    known = {c.lower() for c in have.columns}
    rows = [(c, t) for c, t in wanted.items() if c.lower() not in known]
    return have.sparkSession.createDataFrame(rows, "column string, type string")


def rebuilt(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """A table with exactly the wanted columns, in their types; new ones are null."""
    known = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(known[c.lower()]).try_cast(t) if c.lower() in known else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()))


# --- what is published -----------------------------------------------------------


def published_items(items: DataFrame) -> DataFrame:
    """Items as they are published, with their natural key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in items.columns else F.lit("")
    number = lambda c, other: F.coalesce(F.col(c).try_cast("double"), F.lit(other)) if c in items.columns else F.lit(other)
    fields = ("manufacturer", "family", "model", "finish", "size", "description", "series", "duty", "extraction_method")
    d = items.select(*(text(c).alias(c) for c in fields), number("base_price", 0.0).alias("base_price"), number("confidence", 0.5).alias("confidence_score"), number("page_number", 0.0).cast("int").alias("source_page"))
    return d.withColumn("natural_key_hash", natural_key(*(F.col(c) for c in ("manufacturer", "family", "model", "finish", "size"))))


def published_prices(prices: DataFrame) -> DataFrame:
    """Prices as they are published, by the natural key of their item."""
    key = natural_key(*(F.col(c) for c in ("manufacturer", "family", "model", "finish", "size")))
    pick = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in prices.columns else F.lit(other)
    return prices.select(key.alias("item_natural_key"), pick("finish", "").alias("finish"), pick("price_type", "base").alias("price_type"), F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("price"), pick("currency", "USD").alias("currency"), pick("confidence", 0.5).alias("confidence_score"))


def published_options(options: DataFrame) -> DataFrame:
    """Options as they are published; constraints as JSON."""
    c = F.col
    return options.select("manufacturer", "option_code", F.coalesce("option_name", F.lit("")).alias("option_name"), F.coalesce(c("adder_value").try_cast("double"), F.lit(0.0)).alias("adder_value"), F.coalesce("adder_type", F.lit("fixed")).alias("adder_type"), F.coalesce(F.nullif(F.trim("constraints"), F.lit("")), F.lit("{}")).alias("constraints"))


def published_rules(rules: DataFrame) -> DataFrame:
    """Rules as they are published, with the whole rule as JSON."""
    return rules.select(F.coalesce("manufacturer", F.lit("")).alias("manufacturer"), "rule_type", F.coalesce("source_finish", F.lit("")).alias("source_identifier"), F.coalesce("target_finish", F.lit("")).alias("target_identifier"), F.to_json(F.struct("rule_type", "source_finish", "target_finish", "percentage")).alias("rule_data"))
