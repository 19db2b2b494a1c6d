"""Keys and comparison forms of text: plain sku, scan-proof sku, description form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a scan mistakes for each other, as (read, taken for).
SCAN_FROM = "OILZSBG"
SCAN_TO = "0112586"

# Quote marks that count as the same.
QUOTES = "“”„‟″«»‘’‚‛′`´'\""


def plain_sku(sku: Column) -> Column:
    """Letters and digits only, in upper case; null for a sku without any."""
    return F.nullif(F.upper(F.regexp_replace(sku, r"[^\p{L}\p{N}]", "")), F.lit(""))


def scan_key(sku: Column) -> Column:
    """The plain sku with every character a scan may confuse replaced by the
    one digit that stands for its class."""
    return F.translate(plain_sku(sku), SCAN_FROM, SCAN_TO)


def text_form(text: Column) -> Column:
    """Text regardless of letter case, spacing and kind of quote mark."""
    squeezed = F.regexp_replace(F.lower(text), r"(?U)[\s​‌‍﻿]+", "")
    return F.translate(F.regexp_replace(squeezed, "''|’’|′′", '"'), QUOTES, '"' * len(QUOTES))


def cents(price: Column) -> Column:
    """A price in whole cents, half up on the decimal digits as written."""
    return F.round(price.cast("decimal(38,6)") * 100, 0).cast("bigint")


def is_blank(text: Column) -> Column:
    """Null, empty, white space, or the words nan and none."""
    return text.isNull() | F.lower(F.trim(text)).isin("", "nan", "none")
