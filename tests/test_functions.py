from datetime import date
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewright.functions import keys, normalize, scoring


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("$1,234.50", D("1234.5")), (" 12 $", D(12)), ("about 7.25 each", D("7.25")), ("call", None), (None, None), ("", None), ("-5", D(5))])
def test_price(spark, raw, want):
    assert one(spark, normalize.price, raw) == want


@pytest.mark.parametrize("raw,want", [("$ 1 ,145.00", 1145.0), ("$120.37", 120.37), ("255", 255.0), ("3", None), ("12.50 USD", 12.5), ("A12345", 2345.0), (None, None)])
def test_packed_price(spark, raw, want):
    assert one(spark, normalize.price_packed, raw) == want


@pytest.mark.parametrize("raw,want", [(" sl-11 ", "SL-11"), ("a#b!c", "ABC"), ("#", None), (None, None), ("x" * 30, None)])
def test_sku(spark, raw, want):
    assert one(spark, normalize.sku, raw) == want


@pytest.mark.parametrize("raw,want", [("Effective March 5, 2024", date(2024, 3, 5)), ("on 3/5/2024", date(2024, 3, 5)), ("2024-03-05", date(2024, 3, 5)), ("no date", None), (None, None), ("13/45/2024", None)])
def test_date(spark, raw, want):
    assert one(spark, normalize.date, raw) == want


@pytest.mark.parametrize("raw,want", [("each", "EA"), (" Dozen", "DZ"), ("furlong per day", "FURLONG PE"), ("", "EA"), (None, "EA")])
def test_unit(spark, raw, want):
    assert one(spark, normalize.unit, raw) == want


def test_other_normalisers(spark):
    assert one(spark, normalize.finish, " orb ") == "US26D"
    assert one(spark, normalize.finish, "zz") == "ZZ"
    assert one(spark, normalize.scan_digits, "1O2l3I|") == "102131"
    assert one(spark, normalize.scan_digits, "OIL") == "OIL"
    assert one(spark, normalize.amount_spacing, "$ 125 .50") == "$125.50"
    assert one(spark, normalize.edition_of, "book_2024.pdf") == "2024 Edition"
    assert one(spark, normalize.edition_of, "book.pdf") == "Unknown Edition"
    assert one(spark, normalize.pattern_of, "SL11-2") == r"^SL\d+-\d+$"
    assert one(spark, normalize.natural_key, " A ", None) == one(spark, normalize.natural_key, "a", "")
    assert [tuple(r) for r in one(spark, normalize.substitutions, "10S", "1OS")] == [("0", "O")]
    assert one(spark, normalize.substitutions, "ab", "a") == []
    assert one(spark, normalize.text_quality, None) == 0.0
    assert 0.9 < one(spark, normalize.text_quality, "plain words of a readable line that is long enough, yes") <= 1


def test_keys(spark):
    assert one(spark, keys.plain_sku, " ab-1 ") == "AB1"
    assert one(spark, keys.plain_sku, "--") is None
    assert one(spark, keys.scan_key, "US1O-l") == one(spark, keys.scan_key, "u5 101")
    assert one(spark, keys.text_form, "4'' X 4”") == one(spark, keys.text_form, '4"x4″')
    assert spark.sql("select cast(125.6498 as double) a").select(keys.cents(F.col("a")).alias("x")).first().x == 12565


def test_scores(spark):
    assert spark.range(1).select(scoring.level(F.lit(0.95)).alias("x")).first().x == "high"
    assert one(spark, scoring.sku_score, "BB1100") == pytest.approx(0.7)
    assert one(spark, lambda c: scoring.sku_score(c, "hager"), "BB1100") == pytest.approx(0.9)
    assert one(spark, scoring.sku_score, None) == 0.0


@pytest.mark.parametrize(
    "score,text,want",
    [
        (scoring.price_score, "$125.50", 0.7), (scoring.price_score, "1,250.00", 0.7), (scoring.price_score, "99999", 0.5), (scoring.price_score, "call", 0.0), (scoring.price_score, None, 0.0), (scoring.price_score, "0", 0.1),
        (scoring.date_score, "Effective March 3, 2024", 1.0), (scoring.date_score, "1/2/24", 0.6), (scoring.date_score, "2011", 0.0), (scoring.date_score, "", 0.0),
        (lambda c: scoring.field_score("sku", c, F.lit("layer2_camelot")), "SL100-US26D", 0.7 * 0.4 + 0.95 * 0.3 + 0.9 * 0.2 + 0.09),
        (lambda c: scoring.field_score("description", c, F.lit("?"), F.lit(0.5)), "ab", 0.5 * 0.4 + 0.4 * 0.3 + 0.6 * 0.2 + 0.07),
        (lambda c: scoring.product_score(c, F.lit(12.0), F.lit("US3"), F.lit(None).cast("string"), F.lit("hinge")), "BB1100", 1.0), (lambda c: scoring.product_score(c, F.lit(None).cast("double"), F.lit(""), F.lit(""), F.lit("")), "B1", 0.0),
    ],
)
def test_scorers(spark, score, text, want):
    assert one(spark, score, text) == pytest.approx(want)


@pytest.mark.parametrize("sku,ok", [("BB1100", True), ("MARCH 9", False), ("2020", False), ("AB", False), (None, False), ("--- ", False), ("price", False), ("x" * 31, False), ("A-1", True)])
def test_valid_skus(spark, sku, ok):
    assert one(spark, scoring.valid_sku, sku) is ok


@pytest.mark.parametrize("text", ["0ak d0or", "1ron barn", "$  45 .55", "$  45 .50", "BB 2345", "BB 1100", "a|b", "plain", "", "00 x0 100"])
def test_scan_fixes(spark, text):
    """The rules, one after the other, as Python's own expressions apply them."""
    import re

    from pricewright.functions import classify

    want = text
    for find, put in classify.SCAN_RULES:
        want = re.sub(find, re.sub(r"\$(\d)", r"\\\1", put.replace(r"\$", "\0")).replace("\0", "$"), want)
    assert one(spark, lambda c: classify.scan_fixes(c, F.lit(1.0))["text"], text) == want
    assert one(spark, lambda c: classify.scan_fixes(c, F.lit(1.0))["text"], None) is None


def test_scan_fixes_known_values(spark):
    from pricewright.functions import classify

    got = [one(spark, lambda c: classify.scan_fixes(c, F.lit(1.0))["text"], t) for t in ("0ak d0or", "1ron barn", "$  45 .55", "BB 2345", "a|b")]
    assert got == ["Oak d0or", "Iron bam", "$45.55", "BB2345", "aIb"]


def test_rounding_as_the_sql_does(spark):
    # Halves that the product by the power of ten misses, meets, or overshoots; what is near them; what is beyond.
    halves = [n / 3200 for n in range(1, 3200)] + [x + s * 1e-12 for x in (0.5040625, 0.5046875) for s in (-1, 1)]
    values = [*halves, 0.0, 1.0, 1e300, 1e305, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = dict(df.select("i", scoring.rounded(F.col("v"))).collect())
    want = dict(duckdb.execute("SELECT i - 1, round(v[i], 6) FROM (SELECT ?::DOUBLE[] AS v), range(1, ? + 1) t(i)", [values, len(values)]).fetchall())
    assert {i: repr(x) for i, x in got.items()} == {i: repr(x) for i, x in want.items()}
    assert got[halves.index(0.5040625)] == 0.504062


def test_scanned_confidence_to_the_last_digit(spark, tmp_path):
    # A page of 64 words of 3,226 together: a mean of 0.5040625, which the SQL rounds down.
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i % 15 + i // 64 * 15 AS l_orderkey, i // 15 + 1 AS l_linenumber, i AS l_suppkey, 'N' AS l_returnflag, CASE WHEN i < 13 THEN 26.0 ELSE 25.0 END::DOUBLE AS l_quantity FROM range(100) r(i)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = {tuple(r) for r in entry.queries()["scanned_confidence"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(entry.oracle_sql()["scanned_confidence"]).fetchall())
    assert (0, 64, 0.504062) in got
