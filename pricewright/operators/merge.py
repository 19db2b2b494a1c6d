"""Evidence from several extractions, merged to one row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_key(sku: Column) -> Column:
    """A sku for matching sources: capitals, no blanks, hyphens or underscores."""
    return F.regexp_replace(F.upper(F.trim(sku)), r"[\s\-_]", "")


def _first(name: str) -> Column:
    """The first value, by trust, that isn't null: partial on the map side."""
    trust = F.struct((-F.col("confidence")).alias("c"), "pos")
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), trust)).alias(name)


def merge_sources(df: DataFrame, fields: list[str], threshold: float = 0.6, spread: float = 0.01) -> DataFrame:
    """One row per item_key: each field from the most trusted source that has it,
    the mean price where the prices agree within `spread`, else the most trusted
    one and a conflict flag; confidence raised where several sources or methods
    agree. A single source below the threshold drops out.

    All parts are decomposable aggregates, so a hot item shrinks before the
    shuffle. df: (sku, pos, base_price, method, confidence, *fields)."""
    p = F.col("base_price")
    g = df.withColumn("item_key", item_key(F.col("sku"))).where(F.coalesce(F.col("item_key"), F.lit("")) != "").groupBy("item_key")
    m = g.agg(
        _first("sku"), _first("base_price"), *(_first(f) for f in fields), F.count("*").alias("sources"), F.size(F.collect_set("method")).alias("methods"),
        F.max("confidence").alias("best"), F.avg(p).alias("mean_price"), F.min(p).alias("low"), F.max(p).alias("high"), F.count(p).alias("prices"),
    )
    agree = (F.col("prices") > 1) & (F.col("low") > 0) & ((F.col("high") - F.col("low")) / F.col("low") <= spread)
    conflict = (F.col("prices") > 1) & ~F.coalesce(agree, F.lit(False))
    boost = F.when(F.col("sources") < 2, 0.0).when(F.col("methods") >= 3, 0.10).otherwise(0.08)
    m = m.where((F.col("sources") > 1) | (F.col("best") >= threshold))
    return m.select(
        "item_key", "sku", F.round(F.when(agree, F.col("mean_price")).otherwise(F.col("base_price")), 4).alias("base_price"), *fields, "sources", "methods",
        conflict.alias("price_conflict"), F.round(F.least(F.lit(1.0), F.col("best") + boost), 6).alias("confidence"),
    )


def merge_stats(merged: DataFrame) -> DataFrame:
    """Rates of items with several sources, of trusted items, and mean confidence."""
    n = F.count("*")
    return merged.agg(
        n.alias("items"), F.round(F.count_if(F.col("sources") > 1) / n, 6).alias("multi_source_rate"), F.round(F.count_if(F.col("confidence") >= 0.9) / n, 6).alias("trusted_rate"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"), F.count_if("price_conflict").alias("conflicts"),
    )


def by_priority(df: DataFrame, priority: str) -> DataFrame:
    """One row per item, of the highest layer, in it the first."""
    key = item_key(F.col("sku"))
    w = Window.partitionBy("item_key").orderBy(F.col(priority).desc(), "pos")
    return df.withColumn("item_key", key).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def by_price(df: DataFrame) -> DataFrame:
    """(item_key, base_price, pos): of each item the row with the highest price,
    of equal ones the last; rows without a price only where there is no other."""
    best = F.max(F.struct(F.coalesce("base_price", F.lit(-1.0)).alias("p"), "pos", "base_price")).alias("b")
    return df.groupBy(item_key(F.col("sku")).alias("item_key")).agg(best).select("item_key", "b.base_price", "b.pos")


def weak_pages(pages: DataFrame, found: DataFrame, least: int = 5) -> DataFrame:
    """(page, found): pages on which fewer items than `least` were found."""
    n = found.groupBy("page").agg(F.count("*").alias("n"))
    return pages.select("page").distinct().join(n, "page", "left").select("page", F.coalesce("n", F.lit(0)).alias("found")).where(F.col("found") < least)


def extraction_quality(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Items per method with their mean trust, and the method's share times its weight."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    m = df.groupBy("method").agg(F.count("*").alias("items"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.6).alias("low"))
    # Methods are named by the data; their sum is a subquery, not a window.
    share = F.col("items") / m.agg(F.sum("items")).scalar()
    return m.withColumn("weighted", F.round(share * F.coalesce(F.try_element_at(w, F.col("method")), F.lit(0.3)), 6))


def quality_summary(df: DataFrame, weights: dict[str, float], first: int = 10) -> DataFrame:
    """One row on a whole extraction: items, quality (six to four of the methods'
    weights and the mean confidence), confidences in three bands, the first low
    items by pos, and what to do about it."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    c = F.col("confidence")
    n = F.count("*")
    low = df.where(c < 0.5).orderBy("pos").limit(first).agg(F.array_sort(F.collect_list(F.struct("pos", "sku"))).alias("i")).select(F.transform("i", lambda x: x["sku"])).scalar()
    d = df.agg(
        n.alias("items"), F.avg(F.coalesce(F.try_element_at(w, F.col("method")), F.lit(0.3))).alias("weighted"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_confidence"), F.count_if(c >= 0.8).alias("high"),
        F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.count_if(c < 0.5).alias("issues"),
        F.count_if(F.col("method") == "ocr_tesseract").alias("scanned"), F.count_if(F.col("method") == "failed").alias("failed"),
    )
    advice = F.array_compact(F.array(
        F.when(F.col("scanned") > F.col("items") * 0.5, "scan_in_higher_resolution"), F.when(F.col("failed") > 0, "check_files_that_failed"),
        F.when(F.col("mean_confidence") < 0.6, "review_by_hand"), F.when(F.col("issues") > F.col("items") * 0.2, "review_input_and_configuration"),
    ))
    return d.select(
        "items", F.round(F.coalesce("weighted", F.lit(0.0)) * 0.6 + F.col("mean_confidence") * 0.4, 6).alias("quality"), F.round("mean_confidence", 6).alias("mean_confidence"), "high", "medium", "low", "issues",
        F.array_join(low, ",").alias("first_issues"), F.array_join(advice, ",").alias("advice"),
    )


def merge_options(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per option code: each field from the most trusted source that has
    it, the mean of all amounts, confidence raised where sources agree."""
    key = F.upper(F.trim("option_code"))
    a = F.col("adder_value").cast("double")
    m = df.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias("option_key")).agg(
        *(_first(f) for f in fields), F.avg(a).alias("adder_value"), F.count(a).alias("adder_sources"), F.count("*").alias("sources"), F.max("confidence").alias("best"),
    )
    boost = F.when(F.col("sources") == 1, 0.0).when(F.col("sources") == 2, 0.08).otherwise(0.10)
    return m.select("option_key", *fields, F.round("adder_value", 4).alias("adder_value"), "adder_sources", "sources", F.round(F.least(F.lit(1.0), F.col("best") + boost), 6).alias("confidence"))


def layer_boost(df: DataFrame) -> DataFrame:
    """Rows with their confidence raised by the number of layers that found their sku."""
    n = df.where("sku is not null").groupBy("sku").agg(F.count_distinct("layer").alias("_n"))
    boost = F.when(F.col("_n") >= 3, 0.08).when(F.col("_n") == 2, 0.05).otherwise(0.0)
    return df.join(n, "sku", "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + F.coalesce(boost, F.lit(0.0)))).drop("_n")


def result_validation(df: DataFrame) -> DataFrame:
    """One row: items, the share with a confidence from 0.8 on, a label, and warnings."""
    n, c = F.count("*"), F.col("confidence")
    d = df.agg(n.alias("items"), F.count_if(c >= 0.8).alias("sure"), F.count_if(F.col("base_price").isNull()).alias("unpriced"), F.count_if(F.coalesce(F.trim("sku"), F.lit("")) == "").alias("unnamed"))
    rate = F.when(F.col("items") > 0, F.col("sure") / F.col("items")).otherwise(0.0)
    label = F.when(rate >= 0.9, "excellent").when(rate >= 0.7, "good").when(rate >= 0.5, "fair").otherwise("poor")
    warnings = F.array_compact(F.array(F.when(F.col("items") == 0, "no_items"), F.when(F.col("unpriced") > 0, "items_without_price"), F.when(F.col("unnamed") > 0, "items_without_sku"), F.when(rate < 0.7, "low_confidence")))
    return d.select("items", F.round(rate, 6).alias("sure_rate"), label.alias("label"), F.array_join(warnings, ",").alias("warnings"))


def failed_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages on which nothing was found."""
    return pages.select("page").distinct().join(found.select("page"), "page", "left_anti")


def options_of_golden(found: DataFrame, golden: DataFrame, key: str = "option_code", order: str = "pos") -> DataFrame:
    """(key, found_code) of golden option codes: the first found code that holds
    it or that it holds. Codes are probed by all their substrings, an equi-join;
    a code is short."""
    def parts(c: str) -> Column:
        n = F.length(c)
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col(c), i, k)))))

    f = found.where(F.length(key) > 0).select(F.col(key).alias("found_code"), F.col(order).alias("_o"))
    g = golden.where(F.length(key) > 0).select(key).distinct()
    inside = g.select(key, F.explode(parts(key)).alias("found_code")).join(f, "found_code")
    around = f.select("found_code", "_o", F.explode(parts("found_code")).alias(key)).join(g, key)
    best = inside.select(key, "found_code", "_o").unionByName(around.select(key, "found_code", "_o")).groupBy(key).agg(F.min(F.struct("_o", "found_code")).alias("b"))
    return golden.select(key).distinct().join(best.select(key, F.col("b.found_code").alias("found_code")), key, "left")


def accuracy(found: DataFrame, golden: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Rows of a golden table that were found, and of those the values that hold."""
    f = found.select(key, F.col(value).alias("_got"), F.lit(True).alias("_there"))
    j = golden.select(key, F.col(value).alias("_want")).join(f, key, "left")
    right = F.col("_there") & (F.abs(F.col("_got") - F.col("_want")) <= tolerance)
    return j.agg(F.count("*").alias("golden"), F.count_if("_there").alias("found"), F.count_if(right).alias("right"), F.round(F.count_if("_there") / F.count("*"), 6).alias("row_accuracy"))
