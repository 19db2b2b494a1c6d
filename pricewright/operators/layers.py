"""Layers of extraction: which pages a step looks at, whether the next layer is
needed, what it replaces, and the whole way from a maker's tables to goods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.keys import is_blank
from pricewright.functions.scoring import common_sku
from pricewright.operators import sections

# Words by which pages are chosen for each step.
FINISH_PAGE = "ARCHITECTURAL FINISH SYMBOLS"
RULE_WORDS = ["FINISH PRICE", "USE PRICE OF", "PRICE MAPPING"]
ADDITION_WORDS = ["ADDITION", "OPTION", "EPT", "ETW", "EMS"]
ITEM_WORDS = ["BB", "WT", "ECBB", "Model", "Series", "Hinge", "List", "Price", "Steel", "Brass", "Description", "Part Number", "Finish", "US3", "US4", "US10", "US26", "Size", "Heavy", "Standard"]


def page_steps(pages: DataFrame, page: str, text: str, front: int = 100) -> DataFrame:
    """Pages with the steps that look at them: finishes, rules and additions (in
    the front pages only), items (a dollar sign, or two words of the trade)."""
    t = F.coalesce(text, F.lit(""))
    up = F.upper(t)
    any_of = lambda ws: sum((F.contains(up, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    words = sum((F.contains(t, F.lit(w)).cast("int") for w in ITEM_WORDS), F.lit(0))
    first = F.col(page) <= front
    return pages.select(page, F.contains(up, F.lit(FINISH_PAGE)).alias("finishes"), (first & any_of(RULE_WORDS)).alias("rules"), (first & any_of(ADDITION_WORDS)).alias("additions"), (F.contains(t, F.lit("$")) | (words >= 2)).alias("items"))


def gates(found: DataFrame, pages: DataFrame, per_page: float = 12, confidence: float = 0.8, invalid: float = 0.25, least: float = 5) -> DataFrame:
    """One row on what the first layer found: items per page, mean confidence, the
    share of skus of no known form, and whether the second and third layer are needed."""
    n = pages.agg(F.count_distinct("page")).scalar()
    bad = ~F.coalesce(common_sku(F.col("sku")), F.lit(False))
    d = found.agg((F.count("*") / F.nullif(n, F.lit(0))).alias("per_page"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.avg(bad.cast("double")), F.lit(1.0)).alias("invalid"))
    p = F.coalesce("per_page", F.lit(0.0))
    second = (p < per_page) | (F.col("confidence") < confidence) | (F.col("invalid") >= invalid)
    return d.select(F.round(p, 6).alias("per_page"), F.round("confidence", 6).alias("confidence"), F.round("invalid", 6).alias("invalid"), second.alias("second"), (p < least).alias("third"))


def replaced(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both layers' items, without the first's on pages that the second read."""
    return first.join(second.select("page").distinct(), "page", "left_anti").unionByName(second)


def scanned(df: DataFrame, least: float = 0.0, factor: float = 1.1) -> DataFrame:
    """Items of a scanner, from a confidence on, raised by a factor up to 1."""
    return df.where(F.col("confidence") >= least).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") * factor))


def every_price(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, sku, base_model, finish, length_duty,
    base_price): every cell with a price as a product of its row's model. The
    finish is the column's, else the row's, else the cell's; a length or duty is
    the row's, else the first that a cell of the row names; the column may add a
    length. cells: data rows; headers: (table_id, col_index, header)."""
    rx = r"(?i)(SL\s*\d{2,3})\s*([A-Z]{2})?\s*([A-Z]+\d*)?"
    size = r'(HD\d+|LD\d+|LL|\d+\s*")'
    got = lambda c, p, k=1: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    grid = cells.select("table_id", "row_index", "col_index", F.trim("cell").alias("cell"))
    rows = grid.where("col_index = 0").select(
        "table_id", "row_index", F.upper(F.replace(got("cell", rx), F.lit(" "), F.lit(""))).alias("base_model"), F.upper(got("cell", rx, 2)).alias("_f"),
        F.coalesce(F.upper(got("cell", rx, 3)), F.replace(got("cell", size), F.lit(" "), F.lit(""))).alias("_ld"),
    ).where("base_model is not null")
    bare = F.regexp_replace(F.regexp_replace("cell", r"SL\d{2,3}", ""), r"\s+", "")
    prices = F.filter(F.transform(F.regexp_extract_all(F.replace("cell", F.lit(","), F.lit("")), F.lit(r"\$?\s*(\d+\.?\d{0,2})"), F.lit(1)), lambda x: x.try_cast("double")), lambda x: x.between(10, 5000))
    d = grid.where(~is_blank(F.col("cell")) & ~F.lower("cell").isin("-", "n/a") & ~bare.isin("-", "")).withColumn("base_price", F.get(prices, F.lit(0))).where("base_price is not null")
    h = F.upper(F.trim(F.coalesce("header", F.lit(""))))
    in_head = lambda *ws: sum((F.contains(F.col("_h"), F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    d = d.join(rows, ["table_id", "row_index"]).join(headers.select("table_id", "col_index", h.alias("_h")), ["table_id", "col_index"], "left")
    own = F.when(F.col("cell").rlike(r"(?i)\bCL\b"), "CL").when(F.col("cell").rlike(r"(?i)\bBR\b"), "BR").when(F.col("cell").rlike(r"(?i)\bBK\b"), "BK")
    finish = F.when(F.col("_h").isin("CL", "BR", "BK"), F.col("_h")).when(in_head("CL", "CLEAR"), "CL").when(in_head("BR", "BRONZE"), "BR").when(in_head("BK", "BLACK"), "BK").otherwise(F.coalesce("_f", own))
    d = d.withColumn("finish", finish).where(F.col("finish").isin(*sections.SELECT_FINISHES))
    w = Window.partitionBy("table_id", "row_index").orderBy("col_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.first(F.replace(got("cell", size), F.lit(" "), F.lit("")), ignorenulls=True).over(w)
    d = d.withColumn("length_duty", F.coalesce("_ld", named))
    return d.select("table_id", "row_index", "col_index", F.concat_ws("_", "base_model", "finish", "length_duty", got("_h", r'(\d+)\s*"')).alias("sku"), "base_model", "finish", "length_duty", "base_price")


def priced_tables(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, row_index, sku, base_model, finish, duty, length, base_price):
    the goods of a maker's tables of lengths, whichever way they are set: with
    a length per column where headers name some, else packed into lines."""
    by_column = sections.length_columns(headers).select("table_id").distinct()
    a = sections.priced_by_length(cells, headers)
    packed = lambda d: d.join(by_column, "table_id", "left_anti")
    b = sections.priced_by_line(packed(cells), packed(headers))
    c = F.col
    return a.unionByName(b).withColumn("sku", sections.sku_of(c("base_model"), c("finish"), c("duty"), c("length")))


def regex_hits(pages: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, *names): how often each pattern is met on a page."""
    return pages.select(key, *(F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).alias(n) for n, p in patterns.items()))


def busiest(hits: DataFrame, by: str, key: str, k: int = 10) -> DataFrame:
    """The first k pages by hits, ties by key, with the sum over all pages."""
    return hits.orderBy(F.col(by).desc(), key).limit(k).withColumn("of_all", hits.agg(F.sum(by)).scalar())
