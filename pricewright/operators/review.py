"""Correction, feedback and learned patterns of extracted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import normalize


def corrected(df: DataFrame, order: str) -> DataFrame:
    """Items with sku, base_price and description put right: (order,
    sku, sku_original, base_price, description, was_corrected, is_duplicate,
    errors, warnings). Digits a scan misread are mended, amounts read as numbers,
    debris taken out of texts. All rows stay; a sku that came before is an error,
    as is a price below a cent; a price over 50,000 and a short text are warnings."""
    sku, text = normalize.scan_digits(F.col("sku")), normalize.clean_text(F.col("description"))
    price = F.coalesce(F.trim(F.translate(F.col("base_price").cast("string"), "$,", "")).try_cast("double"), F.when(F.col("base_price").isNotNull(), 0.0))
    d = df.select(
        order, F.when(F.col("sku") == "", F.col("sku")).otherwise(sku).alias("sku"), F.when(sku != F.col("sku"), F.col("sku")).alias("sku_original"), price.alias("base_price"),
        F.when(F.col("description") == "", F.col("description")).otherwise(text).alias("description"),
        F.coalesce(sku != F.col("sku"), F.lit(False)).alias("_s"), F.coalesce(F.col("base_price").try_cast("double").isNull() & F.col("base_price").isNotNull(), F.lit(False)).alias("_p"), F.coalesce(text != F.col("description"), F.lit(False)).alias("_t"),
    )
    # Which rows come first is one aggregation, so a hot sku is never one window.
    named = d.where(F.coalesce("sku", F.lit("")) != "").groupBy("sku").agg(F.min(order).alias("_first"))
    d = d.join(named, "sku", "left").withColumn("is_duplicate", F.coalesce(F.col(order) > F.col("_first"), F.lit(False)))
    errors = F.array_compact(F.array(F.when(F.col("is_duplicate"), "sku"), F.when(F.col("base_price") < 0.01, "base_price")))
    warnings = F.array_compact(F.array(F.when(F.col("base_price") > 50000, "base_price"), F.when((F.coalesce(F.col("description"), F.lit("")) != "") & (F.length("description") < 5), "description")))
    return d.select(order, "sku", "sku_original", "base_price", "description", (F.col("_s") | F.col("_p") | F.col("_t")).alias("was_corrected"), "is_duplicate", errors.alias("errors"), warnings.alias("warnings"))


def correction_summary(c: DataFrame) -> DataFrame:
    """Items, corrected ones, errors, warnings, and the rate without errors."""
    d = c.agg(F.count("*").alias("items"), F.count_if("was_corrected").alias("corrected"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))
    return d.withColumn("rate", F.when(F.col("items") > 0, F.round(1 - F.col("errors") / F.col("items"), 6)).otherwise(0.0))


def feedback_report(feedback: DataFrame) -> DataFrame:
    """(manufacturer, field_name, total, errors, accuracy) of recorded feedback,
    with a row per field over all makers (manufacturer all). feedback: one row
    per judged value; an error is a value that was corrected."""
    wrong = ~F.col("original_value").eqNullSafe(F.col("corrected_value"))
    g = feedback.rollup("field_name", "manufacturer").agg(F.grouping("manufacturer").alias("_all"), F.grouping("field_name").alias("_none"), F.count("*").alias("total"), F.count_if(wrong).alias("errors"))
    d = g.where("_none = 0").withColumn("manufacturer", F.when(F.col("_all") == 1, "all").otherwise(F.col("manufacturer")))
    return d.select("manufacturer", "field_name", "total", "errors", F.round(1 - F.col("errors") / F.col("total"), 6).alias("accuracy"))


def error_patterns(feedback: DataFrame) -> DataFrame:
    """(manufacturer, field_name, read, meant, n): characters that were corrected."""
    pairs = normalize.substitutions(F.col("original_value"), F.col("corrected_value"))
    return feedback.select("manufacturer", "field_name", F.explode(pairs).alias("s")).groupBy("manufacturer", "field_name", "s.read", "s.meant").agg(F.count("*").alias("n"))


def top_patterns(patterns: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent patterns of each maker, ties by their text."""
    w = Window.partitionBy("manufacturer").orderBy(F.col("n").desc(), "field_name", "read", "meant")
    return patterns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def advice(report: DataFrame, patterns: DataFrame) -> DataFrame:
    """(manufacturer, subject, advice): fields below 90 % in ten cases or more,
    and error patterns seen five times or more among a maker's first three."""
    low = report.where("manufacturer <> 'all' and total >= 10 and accuracy < 0.9").select("manufacturer", F.col("field_name").alias("subject"), F.lit("improve_patterns").alias("advice"))
    often = top_patterns(patterns, 3).where("n >= 5").select("manufacturer", F.concat_ws("", "field_name", F.lit(":"), "read", F.lit("->"), "meant").alias("subject"), F.lit("add_correction_rule").alias("advice"))
    return low.unionByName(often)


def suggestions(values: DataFrame, feedback: DataFrame, least: int = 3) -> DataFrame:
    """values with suggested: what the same value of the same maker and field was
    first corrected to; else the value after its maker's character patterns seen
    `least` times or more, most frequent first; null where that changes nothing.

    values: (manufacturer, field_name, value, ...). Patterns of a maker's field
    are pairs of characters, so a bounded list."""
    keys = ["manufacturer", "field_name"]
    history = feedback.groupBy(*keys, F.col("original_value").alias("value")).agg(F.min_by("corrected_value", "ts").alias("_known"), F.lit(True).alias("_seen"))
    rules = error_patterns(feedback).where(F.col("n") >= least).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "read", "meant"))).alias("_rules"))
    d = values.join(history, [*keys, "value"], "left").join(F.broadcast(rules), keys, "left")
    mended = F.aggregate(F.coalesce("_rules", F.array().cast("array<struct<k:bigint,read:string,meant:string>>")), F.col("value"), lambda v, r: F.replace(v, r["read"], r["meant"]))
    return d.withColumn("suggested", F.when(F.col("_seen"), F.col("_known")).otherwise(F.when(mended != F.col("value"), mended))).drop("_known", "_seen", "_rules")


def learned(items: DataFrame, least: float = 0.9) -> DataFrame:
    """(manufacturer, pattern, skus): patterns that trusted skus teach."""
    p = items.where((F.col("confidence") >= least) & F.col("sku").isNotNull()).select("manufacturer", normalize.pattern_of(F.upper(F.trim("sku"))).alias("pattern"), "sku").distinct()
    return p.groupBy("manufacturer", "pattern").agg(F.count("*").alias("skus"))


def learned_boost(items: DataFrame, patterns: DataFrame, boost: float = 0.05) -> DataFrame:
    """Items with their confidence raised where a learned pattern of their maker
    fits the sku: the pattern a sku generalises to is looked up by equality, so
    no pattern is tried on every sku."""
    key = normalize.pattern_of(F.upper(F.trim("sku")))
    p = patterns.select("manufacturer", F.col("pattern").alias("_p"), F.lit(True).alias("_known")).distinct()
    d = items.withColumn("_p", key).join(p, ["manufacturer", "_p"], "left")
    return d.withColumn("confidence", F.when(F.col("_known"), F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence"))).drop("_p", "_known")


def report_lines(summary: DataFrame, methods: DataFrame, pages: DataFrame) -> DataFrame:
    """(part, line_no, line): a text report on an extraction, to be read in order.
    summary: (items, quality, mean_confidence); methods: (method, items);
    pages: (page, items). Methods come by number, pages in order."""
    def numbered(d: DataFrame, part: int, order: list[Column], line: Column) -> DataFrame:
        return d.select(F.lit(part).alias("part"), F.struct(*order).alias("_o"), line.alias("line")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("_o", "line"))).alias("x")).select("part", F.posexplode(F.transform("x", lambda r: r["line"])).alias("line_no", "line"))

    total = summary.select("items").scalar()
    head = summary.select(F.lit(0).alias("part"), F.posexplode(F.array(F.format_string("Total Items: %d", "items"), F.format_string("Quality Score: %.2f", "quality"), F.format_string("Average Confidence: %.2f", "mean_confidence"))).alias("line_no", "line"))
    m = numbered(methods, 1, [(-F.col("items")).alias("a"), F.col("method").alias("b")], F.format_string("%s: %d (%.1f%%)", "method", "items", F.col("items") / total * 100))
    p = numbered(pages, 2, [F.col("page").alias("a"), F.lit("").alias("b")], F.format_string("Page %d: %d items", "page", "items"))
    return head.unionByName(m).unionByName(p)


def scan_needed(text: Column, tables: Column, confidence: Column, least_text: int = 50, least_confidence: float = 0.3) -> Column:
    """Whether a page should be scanned: little text, signs of tables without
    tables, or tables of a low mean confidence."""
    t = F.coalesce(text, F.lit(""))
    signs = F.lower(t).rlike(r"model|price|description|series|\$")
    return (F.length(F.trim(t)) < least_text) | (signs & (tables == 0)) | ((tables > 0) & (F.coalesce(confidence, F.lit(1.0)) < least_confidence))


def maybe_rotated(text: Column) -> Column:
    """Whether more than three lines in ten are one character or a short number;
    a digit alone counts twice."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    odd = F.aggregate(lines, F.lit(0), lambda n, s: n + (F.length(s) == 1).cast("int") + s.rlike(r"^\d{1,2}$").cast("int"))
    return F.coalesce(odd > F.size(lines) * 0.3, F.lit(False))
