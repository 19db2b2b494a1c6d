import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.functions import similarity
from pricewright.operators import diff

S = "pos int, manufacturer string, family string, sku string, model string, size string, finish string, description string, base_price double"


def book(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], S)


def item(model, price, family="bb", sku=None, size='4.5" x 4.5"', finish="US3", text="hinge"):
    return ("hager", family, sku or model, model, size, finish, text, price)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=80), st.text("abcd", max_size=80))
def test_lcs(a, b):
    assert similarity.lcs_length(a, b) == slow_lcs(a, b)
    assert similarity.indel_ratio_of(a, b) == similarity.indel_ratio_of(b, a)


def test_ratio_values(spark):
    df = spark.createDataFrame([("BB1100-1 BB1100", "BB11001A BB1100"), ("REMOVED TEST", "ADDED TEST"), ("", ""), ("a", ""), (None, "a")], "a string, b string")
    got = df.select(F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 4).alias("x"), F.round(similarity.indel_ratio_sql(F.col("a"), F.col("b")), 4).alias("y")).collect()
    assert [r.x for r in got] == [93.3333, 63.6364, 100.0, 0.0, None]
    assert [r.y for r in got] == [93.3333, 63.6364, 100.0, 0.0, None]


def test_match_key(spark):
    k = diff.keyed(book(spark, [("Hager", "BB1100", "BB1100-1", "BB1100-1", '4.5" x 4.5"', "US3", "d", 1.0)])).first()
    assert k.match_key == "hager#bb1100#BB11001#4.5 x 4.5#US3"


def test_changes_of_all_kinds(spark):
    old = book(spark, [item("CTW-4", 45.5), item("BB1100-1", 125.5), item("GONE", 1.0, family="x"), item("SAME", 5.0, text="a")])
    new = book(spark, [item("CTW4", 47.0), item("BB11001A", 128.0), item("COME", 1.0, family="y"), item("SAME", 5.0, text="b")])
    got = {(r.change, r.old_value, r.new_value) for r in diff.item_changes(diff.matches(old, new)).collect()}
    assert got == {("price_changed", "45.5", "47.0"), ("price_changed", "125.5", "128.0"), ("renamed", "BB1100-1", "BB11001A"), ("removed", "GONE", None), ("added", None, "COME"), ("description_changed", "a", "b")}


def test_a_book_against_itself_and_nothing(spark):
    a = book(spark, [item("A1", 1.0), item("A2", None), item("A1", 1.0)])
    none = a.limit(0)
    assert diff.item_changes(diff.matches(a, a, fuzzy=False)).count() == 0
    assert {r.change for r in diff.item_changes(diff.matches(a, none)).collect()} == {"removed"}
    assert {r.change for r in diff.item_changes(diff.matches(none, a)).collect()} == {"added"}
    assert diff.matches(none, none).count() == 0


def test_a_new_item_is_taken_once_in_order(spark):
    old = book(spark, [item("MODEL-100X", 1.0), item("MODEL-100Y", 1.0)])
    new = book(spark, [item("MODEL-100Z", 1.0)])
    m = diff.matches(old, new).where("method = 'fuzzy'").collect()
    assert len(m) == 1 and m[0].o.model == "MODEL-100X"


def test_rows_without_model_and_sku_have_no_part(spark):
    a = book(spark, [(None, None, None, None, None, None, None, None), ("h", "f", "S1", None, None, None, None, 1.0)])
    assert [r.match_key for r in diff.keyed(a).collect()] == ["h#f#S1##"]


@pytest.mark.parametrize("score,level", [(0.99, "exact"), (0.85, "high"), (0.65, "medium"), (0.45, "low"), (0.25, "very_low")])
def test_levels(spark, score, level):
    assert spark.range(1).select(diff.confidence_level(F.lit(score)).alias("x")).first().x == level


def test_options(spark):
    s = "pos int, option_code string, amount double"
    old = spark.createDataFrame([(1, "EPT", 25.0), (2, "CTW", 35.5), (3, "REMOVED", 15.0), (4, "N", None)], s)
    new = spark.createDataFrame([(1, "EPT", 27.5), (2, "CTW", 35.5), (3, "NEW", 45.0), (4, "N", None)], s)
    got = {(r.option_code, r.change) for r in diff.keyed_changes(old, new, "option_code", "amount").collect()}
    assert got == {("EPT", "changed"), ("REMOVED", "removed"), ("NEW", "added")}


def _greedy(old, new, threshold=70.0):
    """Brute force: rows in order take the best of their three best partners that is free."""
    taken, out = set(), {}
    for i, o in enumerate(old):
        best = sorted(((-similarity.indel_ratio_of(o, n), j) for j, n in enumerate(new)))
        for s, j in [(s, j) for s, j in best if -s >= threshold][:3]:
            if j not in taken:
                taken.add(j)
                out[i] = j
                break
    return out


@pytest.mark.parametrize("chunk", [3, 1024])
def test_matching_is_the_greedy_one(spark, monkeypatch, chunk):
    import random

    monkeypatch.setattr(diff, "CHUNK", chunk)
    rnd = random.Random(chunk)
    names = lambda k: [f"AB{rnd.randrange(30):02}{rnd.choice('XYZ')}{rnd.choice('QRS')}{k}" for _ in range(40)]
    a, b = names("O"), list(dict.fromkeys(names("N")))
    old, new = (book(spark, [("h", "f", None, m, None, None, None, 1.0) for m in side]) for side in (a, b))
    got = {r.o.pos: r.n.pos for r in diff.matches(old, new).where("method = 'fuzzy'").collect()}
    assert got == _greedy([f"{m} F" for m in a], [f"{m} F" for m in b])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=150), min_size=1, max_size=6), st.text("abcd", max_size=150))
def test_ratios_side_by_side(texts, a):
    assert list(similarity.ratios(texts)(a)) == pytest.approx([similarity.indel_ratio_of(a, t) for t in texts])


def test_sku_changes(spark):
    s = "pos int, manufacturer string, sku string, model string, description string, base_price double, is_active boolean"
    old = spark.createDataFrame([(1, "h", "AB100", "AB", "hinge", 10.0, True), (2, "h", "CD200", "CD", "pin", 5.0, True), (3, "h", "ZZ1", "Z", "q", None, None), (4, "h", "EF300-1", "EF300", "gear hinge", 1.0, True)], s)
    new = spark.createDataFrame([(1, "h", "AB100", "AB", "hinge", 12.0, False), (2, "h", "XY9", "X", "w", 5.0, True), (3, "h", "ZZ1", "Z", "q", None, None), (4, "h", "EF300-2", "EF300", "gear hinge", 1.0, True), (5, "other", "EF300-3", "EF300", "gear hinge", 1.0, True)], s)
    got = sorted((r.sku, r.change, r.old_value, r.new_value) for r in diff.sku_changes(old, new, block="manufacturer").collect())
    assert got == [
        ("AB100", "price_change", "10.0", "12.0"), ("AB100", "status_change", "true", "false"), ("CD200", "retired_product", "CD200", None), ("EF300-2", "fuzzy_match", "EF300-1", "EF300-2"), ("EF300-2", "fuzzy_match", "EF300-1", "EF300-2"),
        ("EF300-3", "new_product", None, "EF300-3"), ("XY9", "new_product", None, "XY9"),
    ]
    one = diff.sku_changes(old, new, block="manufacturer", second_pass=False)
    assert diff.sku_summary(one).first().asDict()["fuzzy_match"] == 1
    assert diff.sku_changes(old.limit(0), new.limit(0), block="manufacturer").count() == 0
