"""Items, options, prices and sizes out of lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import normalize

# Patterns of model numbers, tried in this order.
MODELS = [r"\b([A-Z]{2,}[\s-]?\d{1,}[A-Z\d]*)\b", r"\b(\d{3,}-[A-Z0-9]+-\d+)\b", r"\b([A-Z]+\d+[-_][A-Z\d]+(?:[-_][A-Z\d.x]+)?)\b", r"\b([A-Z]{2,}\d{2,})\b", r"\b([A-Z]\d{3,})\b", r"\b(\d{4,8})\b"]
#: Words that look like model numbers and aren't.
NOT_MODELS = ["page", "item", "bhma"]


def split_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row per line of a page's text, numbered from 0; blank lines stay."""
    return pages.select(*[c for c in pages.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def model_in(line: Column) -> Column:
    """The first model number of a line, of at least four characters."""
    tries = []
    for p in MODELS:
        m = F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
        tries.append(F.when((F.length(m) >= 4) & ~F.lower(F.regexp_replace(m, r"[\s\d-]", "")).isin(*NOT_MODELS), m))
    return F.coalesce(*tries)


def items(lines: DataFrame) -> DataFrame:
    """(page_number, line_no, sku, finish, size, base_price, description): a row
    per line with a model and a price; the description is what stands between."""
    line = F.col("line")
    model, price = model_in(line), normalize.price_packed(line)
    d = lines.where(line.isNotNull()).select("page_number", "line_no", "line", model.alias("sku"), price.alias("base_price")).where("sku is not null and base_price is not null")
    rest = F.substring(line, F.expr("locate(sku, line) + length(sku)"), F.lit(200))
    text = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\$?\s*\d[\d,]*\.?\d*.*$", ""), r"^[\s\-|:,]+|[\s\-|:,]+$", ""))
    finish = F.nullif(F.regexp_extract(line, r"\b(US\d+[A-Z]?)\b", 1), F.lit(""))
    size = F.nullif(F.regexp_extract(line, r"(\d+\.?\d*\s*x\s*\d+\.?\d*)", 1), F.lit(""))
    return d.select("page_number", "line_no", "sku", finish.alias("finish"), size.alias("size"), F.round("base_price", 2).alias("base_price"), text.alias("description"))


def adders(lines: DataFrame) -> DataFrame:
    """(page_number, line_no, option_code, amount): options with their price,
    the first of repeated (code, amount) pairs of a page."""
    pattern = r"\b([A-Z]{2,4}(?:-\d{1,2})?)\s+(?:add|adder|option):?\s*\$?(\d+\.?\d*)"
    d = lines.select("page_number", "line_no", F.regexp_extract("line", pattern, 1).alias("option_code"), F.regexp_extract("line", pattern, 2).try_cast("double").alias("amount")).where("option_code <> ''")
    return d.groupBy("page_number", "option_code", "amount").agg(F.min("line_no").alias("line_no"))


def all_prices(lines: DataFrame) -> DataFrame:
    """(page_number, line_no, price_no, price): every dollar price of a line once."""
    found = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\$(\d[\d,]*\.?\d*)"), F.lit(1)))
    d = lines.select("page_number", "line_no", F.posexplode(found).alias("price_no", "raw"))
    return d.select("page_number", "line_no", "price_no", F.replace("raw", F.lit(","), F.lit("")).try_cast("double").alias("price"))


def carry(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Lines with the last value seen on their page, up to themselves: series,
    sizes and headings hold until the next one."""
    w = Window.partitionBy("page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def blocks(lines: DataFrame, head: Column) -> DataFrame:
    """Lines with the number of the block they are in: a block begins at each head."""
    w = Window.partitionBy("page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("block", F.sum(F.coalesce(head, F.lit(False)).cast("int")).over(w))


def runs(lines: DataFrame, holds: Column, least: int = 2) -> DataFrame:
    """(page_number, first_line, last_line, n): maximal runs of lines that hold."""
    w = Window.partitionBy("page_number").orderBy("line_no")
    d = lines.withColumn("_h", F.coalesce(holds, F.lit(False)))
    island = F.row_number().over(w) - F.sum(F.col("_h").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_i", island).where("_h")
    return d.groupBy("page_number", "_i").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_i")


def page_features(lines: DataFrame) -> DataFrame:
    """(page_number, lines, words, prices, codes, kind): what a page looks like."""
    g = lines.groupBy("page_number").agg(
        F.count("*").alias("lines"), F.sum(F.size(F.filter(F.split(F.coalesce("line", F.lit("")), r"\s+"), lambda w: w != ""))).alias("words"),
        F.count_if(F.col("line").rlike(r"\$\d+")).alias("prices"), F.count_if(F.col("line").rlike(r"US\d+[A-Z]?|CTW|EPT|EMS")).alias("codes"),
    )
    kind = F.when(F.col("prices") * 4 >= F.col("lines"), "data_table").when(F.col("codes") > 0, "option_list").when(F.col("words") < 20, "sparse").otherwise("text")
    return g.withColumn("kind", kind)
