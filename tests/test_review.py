"""Corrections, feedback and reports."""

import re

from pyspark.sql import functions as F

from pricewright.functions import normalize
from pricewright.operators import merge, review

ITEMS = "n int, sku string, base_price string, description string, sku_original string"


def test_corrections(spark):
    rows = [(1, "BB1O0", "$1,200.50", "Full  hinge", "x"), (2, "BB100", "call", "ab", "x"), (3, None, None, None, "x"), (4, "4I1l", "60000", "good text", "x"), (5, "", "", "", "x"), (6, "BB100", "0.001", "fine text", "x")]
    got = {r.n: r for r in review.corrected(spark.createDataFrame(rows, ITEMS), "n").collect()}
    assert (got[1].sku, got[1].sku_original, got[1].base_price, got[1].description, got[1].was_corrected) == ("BB100", "BB1O0", 1200.5, "Full hinge", True)
    assert (got[2].is_duplicate, got[2].base_price, got[2].errors, got[2].warnings) == (True, 0.0, ["sku", "base_price"], ["description"])
    assert (got[3].errors, got[3].warnings, got[3].was_corrected) == ([], [], False)
    assert (got[4].sku, got[4].warnings) == ("4111", ["base_price"])
    assert got[6].errors == ["sku", "base_price"]
    s = review.correction_summary(review.corrected(spark.createDataFrame(rows, ITEMS), "n")).first()
    assert (s["items"], s.errors) == (6, 5)
    none = review.correction_summary(review.corrected(spark.createDataFrame([], ITEMS), "n")).first()
    assert (none["items"], none.rate) == (0, 0.0)


def test_scan_digits_against_plain_python(spark, rows):
    def plain(t):
        t = t.strip().replace("|", "").replace("�", "").replace("\\x00", "")
        for a, b in (("O", "0"), ("I", "1"), ("l", "1")):
            t = re.sub(rf"(?<=\d){a}(?=\d|$)", b, t)
        return t

    texts = ["BB1O1O", "1l1I1", "OIl", " 5O ", "A|1O|1", "1OO1", "", "9I", "x\\x001O"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(normalize.scan_digits(F.col("t")).alias("x")).collect()] == [plain(t) for t in texts]


def test_feedback_and_suggestions(spark):
    s = "manufacturer string, field_name string, original_value string, corrected_value string, ts int"
    fb = spark.createDataFrame([("a", "sku", f"B{i}O", f"B{i}0", i) for i in range(5)] + [("a", "sku", "S1", "S1", 9), ("a", "sku", "B0O", "other", 99), ("b", "sku", "x", None, 1), ("b", "sku", None, None, 1)], s)
    report = {(r.manufacturer, r.field_name): (r.total, r.errors) for r in review.feedback_report(fb).collect()}
    assert report == {("a", "sku"): (7, 6), ("b", "sku"): (2, 1), ("all", "sku"): (9, 7)}
    values = spark.createDataFrame([("a", "sku", v) for v in ("B0O", "QOO", "S1", "plain", None)] + [("c", "sku", "B0O")], "manufacturer string, field_name string, value string")
    got = {(r.manufacturer, r.value): r.suggested for r in review.suggestions(values, fb).collect()}
    assert got == {("a", "B0O"): "B00", ("a", "QOO"): "Q00", ("a", "S1"): "S1", ("a", "plain"): None, ("a", None): None, ("c", "B0O"): None}
    assert review.suggestions(values, fb.limit(0)).where("suggested is not null").count() == 0
    assert {(r.subject, r.advice) for r in review.advice(review.feedback_report(fb), review.error_patterns(fb)).collect()} == {("sku:O->0", "add_correction_rule")}


def test_learned_patterns_raise_confidence(spark):
    items = spark.createDataFrame([("a", "BB1100", 0.95), ("a", "BB7", 0.5), ("a", "CC7", 0.5), ("b", "BB7", 0.99), ("a", None, 0.99)], "manufacturer string, sku string, confidence double")
    got = {(r.manufacturer, r.sku): round(r.confidence, 2) for r in review.learned_boost(items, review.learned(items)).collect()}
    assert got == {("a", "BB1100"): 1.0, ("a", "BB7"): 0.55, ("a", "CC7"): 0.5, ("b", "BB7"): 1.0, ("a", None): 0.99}


def test_empty_and_summary(spark):
    s = "pos int, sku string, base_price double, method string, confidence double"
    none = merge.quality_summary(spark.createDataFrame([], s), {"a": 1.0}).first()
    assert (none["items"], none.quality, none.mean_confidence) == (0, 0.0, 0.0)
    assert merge.result_validation(spark.createDataFrame([], s)).first().warnings == "no_items,low_confidence"
    rows = [(2, "B", None, "failed", 0.1), (1, "A", 1.0, "ocr_tesseract", 0.2), (3, None, 1.0, "ocr_tesseract", 0.9)]
    got = merge.quality_summary(spark.createDataFrame(rows, s), {"ocr_tesseract": 0.5, "failed": 0.1}).first()
    assert got.first_issues == "A,B" and got.advice == "scan_in_higher_resolution,check_files_that_failed,review_by_hand,review_input_and_configuration"


def test_golden_options_by_parts(spark):
    s = "option_code string, pos int"
    found = spark.createDataFrame([("CTW-4", 2), ("CTW", 1), ("EPT", 3), ("", 0), (None, 0)], s)
    golden = spark.createDataFrame([("CTW-4", 0), ("PT", 0), ("ZZ", 0), ("XCTWX", 0)], s)
    got = {r.option_code: r.found_code for r in merge.options_of_golden(found, golden).collect()}
    assert got == {"CTW-4": "CTW", "PT": "EPT", "ZZ": None, "XCTWX": "CTW"}
