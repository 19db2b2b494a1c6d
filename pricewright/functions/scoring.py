"""Confidence scores of values, fields, products, tables and extractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What extraction methods are worth.
METHODS = {"pdfplumber_digital": 0.95, "camelot_lattice": 0.90, "camelot_stream": 0.75, "ocr_tesseract": 0.50, "fallback_text": 0.30}
# The same where the quality of a whole extraction is judged.
PROVENANCE = {"pymupdf_digital": 1.0, "pdfplumber_digital": 0.95, "camelot_lattice": 0.85, "camelot_stream": 0.75, "ocr_tesseract": 0.5, "failed": 0.1}
# How reliable extraction layers are, and the least confidence of each field.
LAYERS = {"layer1_text": 0.85, "layer2_camelot": 0.90, "layer3_paddleocr": 0.95, "layer3_ml": 0.70}
THRESHOLDS = {"sku": 0.85, "base_price": 0.80, "description": 0.70, "model": 0.75, "finish": 0.70, "option_code": 0.75}
# Sku patterns that makers' catalogs have in common.
COMMON_SKUS = [r"^[A-Z]{2,4}[-\s]?\d{3,}", r"^\d{4,8}[A-Z]{0,3}$", r"^[A-Z]\d{4,}", r"^[A-Z]{2,}\d+[A-Z\d]*", r"^\d{3,}[-A-Z0-9]+$"]
# How the skus of two makers begin.
OWN_SKUS = {"hager": [r"^[A-Z]{2,4}[0-9]{2,6}"], "select_hinges": [r"^SL[0-9]{2}", r"^[A-Z]{2,3}[0-9-]+"]}
# Strong and middling forms of skus.
STRONG_SKUS = [r"^[A-Z]{2,}\d{2,}$", r"^[A-Z]{2,}\d{2,}-[A-Z\d]+$", r"^\d{4,}-[A-Z\d]+$"]
MIDDLING_SKUS = [r"^[A-Z\d-]{4,}$", r"^[A-Z]{1}\d{3,}$"]
# Words of the trade.
TRADE = ["hinge", "lock", "door", "closer", "hardware", "continuous", "geared"]
# Marks of a broken text, as literal texts.
BROKEN = ["�", "||", "|_", "\\x", "\0"]
# Fixed value: a date with its month in words.
LONG_DATE = r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}"


def clamp(c: Column) -> Column:
    """From 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rounded(c: Column, digits: int = 6) -> Column:
    """To so many digits as the SQL's engine does it: the double times a power of
    ten to the nearest whole number, halves away from zero. Spark's own round
    goes by the decimal digits, so 0.5040625, times 1e6 504062.49999999994, goes
    up there and down here. What the power takes beyond all doubles stays as it is."""
    x = F.round(c * 10.0**digits) / 10.0**digits
    return F.when(F.abs(x) < float("inf"), x).otherwise(c)


def _of(table: dict[str, float], key: Column, other: float) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), F.lit(other))


def level(c: Column, high: float = 0.9, medium: float = 0.7, low: float = 0.5) -> Column:
    """The level of a confidence."""
    return F.when(c >= high, "high").when(c >= medium, "medium").when(c >= low, "low").otherwise("very_low")


def unwrapped(c: Column, other: float = 0.7) -> Column:
    """A confidence, or what counts as one where there is none."""
    return F.coalesce(c.cast("double"), F.lit(other))


def method_score(method: Column, quality: Column) -> Column:
    """A method's worth, seven to three with the quality of its tables where known."""
    base = _of(METHODS, method, 0.30)
    return F.least(F.lit(1.0), F.when(quality.isNull(), base).otherwise(base * 0.7 + quality * 0.3))


def _plain(raw: Column) -> Column:
    return F.translate(F.trim(raw), "$,", "")


def price_score(raw: Column, similar: Column | None = None) -> Column:
    """How far a price as read can be trusted: its form, its range, and whether
    it lies within twice the mean of similar prices. Nothing read scores 0."""
    text = _plain(raw)
    value = text.try_cast("double")
    score = F.when(text.rlike(r"^\$?\d+\.?\d*$"), 0.4).otherwise(-0.2)
    score = score + F.when(value.isNull(), -0.4).when(F.isnan(value), -0.3).when(value.between(0.01, 50000), 0.3).when(value > 50000, 0.1).otherwise(-0.3)
    if similar is not None:
        ratio = F.least(value, similar) / F.nullif(F.greatest(value, similar), F.lit(0.0))
        score = score + F.when(value.isNull() | similar.isNull(), 0.0).when(ratio > 0.5, 0.2).otherwise(-0.1)
    return F.when(F.coalesce(raw, F.lit("")) == "", 0.0).otherwise(clamp(score))


def sku_score(sku: Column, maker: str | None = None) -> Column:
    """How far a sku can be trusted: its form, its length, its maker's pattern."""
    t = F.upper(F.trim(sku))
    n = F.length(t)
    score = F.when(t.rlike("^[A-Z0-9-]{2,20}$"), 0.5).otherwise(-0.3) + F.when(n.between(3, 15), 0.2).when(n > 15, -0.1).otherwise(-0.2)
    own = OWN_SKUS.get((maker or "").lower())
    if own:
        score = score + F.when(_any(t, own), 0.2).otherwise(0.0)
    return F.when(F.coalesce(sku, F.lit("")) == "", 0.0).otherwise(clamp(score))


def date_score(text: Column) -> Column:
    """How far an effective date can be trusted: its form, the word effective, its year."""
    t = F.trim(text)
    year = F.regexp_extract(t, r"\b(20\d{2})\b", 1).try_cast("int")
    score = F.when(t.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}") | t.rlike(LONG_DATE), 0.6).otherwise(-0.4) + F.when(F.lower(t).contains("effective"), 0.3).otherwise(0.0)
    score = score + F.when(year.isNull(), 0.0).when(year.between(2020, 2030), 0.2).otherwise(-0.2)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(clamp(score))


def table_score(filled: Column, found: Column | None, numeric: Column) -> Column:
    """Of a table: its share of filled cells, its share of expected columns, and
    whether it has a column of numbers."""
    score = filled * 0.4 + F.when(numeric, 0.2).otherwise(0.0)
    return clamp(score if found is None else score + found * 0.4)


def overall_score(method: Column, date: Column | None, products: Column | None) -> Column:
    """Of an extraction: four to six of its method and its parts, dates two
    tenths of these, products six; the method alone where no part is scored."""
    parts = [(c, w) for c, w in ((date, 0.2), (products, 0.6)) if c is not None]
    data = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    none = F.lit(True)
    for c, _ in parts:
        none = none & c.isNull()
    return clamp(F.when(none, method).otherwise(method * 0.4 + data * 0.6))


def _any(t: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike(p)
    return out


def _pattern_score(field: str, value: Column) -> Column:
    t = F.trim(value)
    n = F.length(t)
    missing = F.coalesce(value, F.lit("")) == ""
    if field == "sku":
        return F.when(missing, 0.0).when(_any(t, STRONG_SKUS), 0.95).when(_any(t, MIDDLING_SKUS), 0.85).when(n >= 3, 0.60).otherwise(0.30)
    if field == "base_price":
        v = F.trim(F.translate(value, "$,", "")).try_cast("double")
        return F.when(v.isNull(), 0.30).when(F.isnan(v), 0.50).when(v.between(0.01, 100000), 0.95).when((v > 0) & (v < 0.01), 0.70).when((v > 100000) & (v <= 500000), 0.80).otherwise(0.50)
    if field == "description":
        trade = F.when(F.lower(t).rlike("|".join(TRADE)), 0.10).otherwise(0.0)
        return F.when(missing, 0.0).when(n < 5, 0.40).otherwise(F.least(F.lit(1.0), F.when(n > 20, 0.85).otherwise(0.65) + trade))
    if field == "option_code":
        return F.when(missing, 0.0).when(t.rlike("^[A-Z]{2,4}$"), 0.90).when(t.rlike(r"^[A-Z\d]{2,}$"), 0.75).otherwise(0.50)
    return F.lit(0.75)


def _quality_score(field: str, value: Column) -> Column:
    broken = F.lit(False)
    for mark in BROKEN:
        broken = broken | F.contains(value, F.lit(mark))
    short, least = (0.50, 2) if field in ("sku", "option_code", "finish") else (0.60, 3)
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", 0.0).when(broken, 0.40).when(F.length(value) >= least, 0.90).otherwise(short)


def field_score(field: str, value: Column, method: Column, scan: Column | None = None) -> Column:
    """Confidence in a field: of the scan (0.7 where unknown or 0), its pattern,
    its quality and the method's reliability, four to three to two to one."""
    base = F.lit(0.7) if scan is None else F.when(F.coalesce(scan, F.lit(0.0)) == 0, 0.7).otherwise(scan)
    return F.least(F.lit(1.0), base * 0.4 + _pattern_score(field, value) * 0.3 + _quality_score(field, value) * 0.2 + _of(LAYERS, method, 0.70) * 0.1)


def acceptable(field: str, score: Column) -> Column:
    """Whether a field's confidence is enough for it."""
    return score >= THRESHOLDS.get(field, 0.70)


def common_sku(sku: Column) -> Column:
    """Whether a sku has a form that makers' catalogs have in common."""
    t = F.upper(F.trim(sku))
    mixed = ~F.contains(t, F.lit(" ")) & t.rlike(r"^[A-Z0-9\-/]+$") & t.rlike("[A-Z]") & t.rlike("[0-9]")
    return F.coalesce((F.length(sku) >= 3) & (_any(t, COMMON_SKUS) | mixed), F.lit(False))


def product_score(sku: Column, price: Column, finish: Column, size: Column, description: Column) -> Column:
    """Confidence in a product: mostly its sku and price, a little its other fields."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    named = F.coalesce(F.length(sku) >= 4, F.lit(False))
    score = F.when(named, 0.50).otherwise(0.0) + F.when(named & common_sku(sku), 0.07).otherwise(0.0)
    score = score + F.when(price.between(0.01, 100000), 0.45).otherwise(0.0) + F.when(price.between(0.50, 50000), 0.03).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(F.length(description) > 3, 0.02).otherwise(0.0) + F.when(has(finish), 0.01).otherwise(0.0) + F.when(has(size), 0.01).otherwise(0.0))


def table_quality(sku: Column, price: Column, description: Column, rows: Column, cols: Column) -> Column:
    """Quality of a table by the columns that are known in it and its size."""
    known = F.when(sku.isNotNull(), 0.30).otherwise(0.0) + F.when(price.isNotNull(), 0.30).otherwise(0.0) + F.when(description.isNotNull(), 0.20).otherwise(0.0)
    size = F.when(rows.between(5, 500), 0.10).when(rows.between(2, 4), 0.05).otherwise(0.0) + F.when(cols.between(3, 15), 0.10).when(cols == 2, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), known + size)


def table_boost(confidence: Column, quality: Column) -> Column:
    """A product's confidence raised by the quality of its table."""
    return F.least(F.lit(1.0), confidence + F.when(quality >= 0.9, 0.06).when(quality >= 0.7, 0.04).when(quality >= 0.5, 0.02).otherwise(0.0))


# What can't be a sku.
NOT_SKUS = [
    "per", "of", "to", "lock", "pin", "sold", "bag", "box", "uncombinated", "housing", "cams", "cores", "n/a", "na",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "model", "item", "product", "description", "price", "list",
]


def valid_sku(sku: Column) -> Column:
    """Whether a text can be a sku: 3 to 30 characters, letters or digits, no
    common word, no month with a day, no year."""
    t = F.trim(sku)
    bad = F.lower(t).isin(*NOT_SKUS) | t.rlike(r"(?i)^[A-Z]{3,9}\s+\d{1,2}$") | t.rlike(r"^\d{4}$")
    return F.coalesce(F.length(t).between(3, 30) & ~bad & t.rlike(r"[\p{L}\p{N}]"), F.lit(False))
