import pytest

from pricewright.operators import rejects

CASES = [
    ("a,1,2", ",", 3, None), ('"a, b","1,234.00",-', ",", 3, None), ('"a ""x""",$ 5,—', ",", 3, None), ("a; 1 ;", ";", 3, None), ('"a\nb",1,', ",", 3, None), ("a\t$1,000\t2.50", "\t", 3, None),
    ("a,1", ",", 3, "columns"), ("a,1,2,3", ",", 3, "columns"), ("", ",", 3, "columns"), (None, ",", 2, "columns"), ("a", None, 1, "columns"), ("a,1", ",", None, "columns"), ("a,1", ",,", 2, "columns"),
    (" ,1,2", ",", 3, "value"), ("a,x,2", ",", 3, "value"), ("a,1.5,2", ",", 3, "value"), ('a,"12,34",2', ",", 3, "value"), ("a,--,2", ",", 3, "value"), ("a,-5,2", ",", 3, "value"), ("a,1³,2", ",", 3, "value"), ('"",1,2', ",", 3, "value"),
    ('a,"1,2', ",", 3, "quoting"), ('a,1",2', ",", 3, "quoting"), ('a,"1" x,2', ",", 3, "quoting"), ('a 7" b,1,2', ",", 3, "quoting"), ('a, "1",2', ",", 3, "quoting"), ("a\nb,1,2", ",", 3, "quoting"), ('a,",2', ",", 3, "quoting"), ('"a,1,"2"', ",", 3, "quoting"),
]


def load(spark, cases):
    df = spark.createDataFrame([(i, c[2], c[1], c[0], "x", "y") for i, c in enumerate(cases)], "line_id bigint, cols int, delimiter string, data string, reason string, model string").coalesce(1)
    return {r.record_id: r for r in rejects.load_delimited(df).collect()}


def test_reasons_even_when_bad_lines_stand_side_by_side(spark):
    got = load(spark, CASES)
    assert {CASES[i][0]: r.reason for i, r in got.items()} == {c[0]: c[3] for c in CASES}
    assert len(got) == len(CASES)


def test_typed_rows(spark):
    got = load(spark, CASES)
    assert (got[1].model, [None if p is None else float(p) for p in got[1].prices]) == ("a, b", [1234.0, None])
    assert got[2].model == 'a "x"' and float(got[2].prices[0]) == 5
    assert got[4].model == "a\nb"


def test_empty_table_and_long_line(spark):
    assert load(spark, []) == {}
    long = "x" * 3_000_000
    got = load(spark, [(f"{long},1", ",", 2, None), ("a,2", ",", 2, None)])
    assert got[0].reason is None and len(got[0].model) == 3_000_000 and got[1].reason is None


@pytest.mark.parametrize("text,number", [("7", 7), (" 0012\t", 12), ("9999", 9999), ("12345", None), ("", None), (None, None), ("1.0", None), ("1e2", None), ("-1", None), ("٣", None), ('"1"', None), ("1 2", None), ("l0", None)])
def test_numbers(spark, text, number):
    r = rejects.load_numbers(spark.createDataFrame([(1, text)], "record_id bigint, row_index string"), "record_id", "row_index").first()
    assert (r.reason, r.number) == (None if number is not None else "value", number)


def test_many_open_quotes_in_one_batch(spark):
    cases = [('a,"1', ",", 2, "quoting") if i % 2 else ('"b",2', ",", 2, None) for i in range(1200)]
    got = load(spark, cases)
    assert [got[i].reason for i in range(1200)] == [c[3] for c in cases]


@pytest.mark.parametrize("d", [",", ";", "|", "\t"])
def test_surplus_empty_fields_count(spark, d):
    cases = [
        (f"a{d}1{d}2{d}", d, 3, "columns"), (f"a{d}1{d}2{d}{d}", d, 3, "columns"), (f'"a"{d}"1"{d}"2"{d}', d, 3, "columns"), (f'a{d}1{d}2{d}""', d, 3, "columns"), (f'a{d}1{d}2{d}""{d}""', d, 3, "columns"),
        (f"a{d}", d, 1, "columns"), (f"a{d}1{d}", d, 3, None), (f"a{d}{d}", d, 3, None), (f'a{d}""{d}2', d, 3, None), (f'a{d}"1', d, 2, "quoting"), (f"b{d}7", d, 2, None),
    ]
    got = load(spark, cases)
    assert [got[i].reason for i in range(len(cases))] == [c[3] for c in cases]


def test_reasons_come_from_the_reject_tables():
    con = rejects._connect()
    bad = [(1, 3, ",", 'a,"1" x,2'), (2, 3, ",", '"a,1,"2"'), (3, 3, ",", "a,1,2"), (4, 3, ",", "a,1")]
    from unittest import mock

    with mock.patch.object(rejects, "_well_formed", lambda d: lambda data: True):  # without the exact check
        assert {r[0]: r[1] for r in rejects.parse_records(bad, con)} == {1: "quoting", 2: "quoting", 3: None, 4: "columns"}
