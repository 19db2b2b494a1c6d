import pytest

from pricewright.operators import packed


def values(text, words=False):
    return [v for v, _ in packed.split_values(text, words)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("a, b;c|d / e\nf", list("abcdef")), ("5/8 R / 1-1/2 O", ["5/8 R", "1-1/2 O"]), ('"a, b", c', ["a, b", "c"]), ('"T ""F"""; x', ['T "F"', "x"]), ('["a", "b; c", "T \\"F\\""]', ["a", "b; c", 'T "F"']),
        (" , ;", []), ("", []), ("a,,a,", ["a", "a"]), ("Fire (90 min)", ["Fire (90 min)"]), ("a/b", ["a", "b"]), ("[a, [b|c]], d", list("abcd")), ("'x, y'; z", ["x, y", "z"]),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_malformed_quotes_are_read_as_they_stand_and_flagged():
    assert packed.split_values('"a; b') == (('"a', True), ("b", False))
    assert packed.split_values('5" x, b') == (('5" x', True), ("b", False))


def test_words_are_separated_by_blanks_too():
    assert values("SGR CNP", True) == ["SGR", "CNP"]
    assert values("'A-1', 'B'", True) == ["A-1", "B"]
    assert values("KTW-4 / ELX-6", True) == ["KTW-4", "ELX-6"]


@pytest.mark.parametrize(
    "text,requires,excludes",
    [
        ('{"requires": ["A", "B; C"], "excludes": "D"}', ["A", "B; C"], ["D"]), ("{'excludes': \"'K', 'L'\", 'on': True}", [], ["'K', 'L'"]), ('{"requires": null, "excludes": []}', [], []), ("null", [], []), ("", [], []),
        ('{"note": "requires", "excludes": "X\\nY"}', [], ["X\nY"]), ('{"requires": ["A", "B"', ["A", "B"], []), ("{\n 'Requires': 'O\\'N'}", ["O'N"], []),
    ],
)
def test_objects(text, requires, excludes):
    got = packed.object_lists(text, ("requires", "excludes"))
    assert (got["requires"], got["excludes"]) == (requires, excludes)


def test_positions_run_through_the_field(spark, rows):
    df = spark.createDataFrame([(1, '{"requires": ["A;B", "C"]}', "x"), (2, None, "x"), (3, " ", "x"), (1, '{"requires": ["A;B", "C"]}', "x")], "record_id bigint, constraints_json string, value string")
    got = packed.split_constraints(df, "record_id", "constraints_json").select("record_id", "field_name", "value_no", "value")
    assert sorted(rows(got).items()) == [((1, "requires", i + 1, v), 2) for i, v in enumerate("ABC")]
    assert packed.split_options(df.limit(0), "record_id", "constraints_json").count() == 0


def test_a_very_long_field(spark):
    df = spark.createDataFrame([(1, ";".join(["ab"] * 50_000))], "export_id bigint, options string")
    assert packed.split_options(df, "export_id", "options").count() == 50_000


def _within(seconds, text, words=False):
    import time

    t = time.perf_counter()
    got = packed.split_values(text, words)
    assert time.perf_counter() - t < seconds
    return got


@pytest.mark.parametrize("words", [False, True])
def test_malformed_texts_take_time_in_proportion(words):
    packed.split_values("a", words)
    assert len(_within(0.05, "[a," * 30, words)) == 30
    assert _within(0.05, '"' + "\\" * 40, words) == (('"' + "\\" * 40, True),)
    assert len(_within(2, "[a," * 5000, words)) == 5000
    _within(2, "[" * 10_000 + " " * 10_000 + '"' * 10_001, words)
    _within(2, "['a," * 5000 + "]" * 4000, words)


def test_ten_thousand_levels():
    deep = "[" * 10_000 + "a, b" + "]" * 10_000
    assert [v for v, _ in _within(2, deep + "; c")] == ["a", "b", "c"]
    assert [v for v, _ in packed.split_values("[a; [b, 'c, d'], [[e]]] | f")] == ["a", "b", "c, d", "e", "f"]


def test_open_brackets_and_quotes_fall_back_to_bare_text():
    assert packed.split_values("[a, b") == (("[a", False), ("b", False))
    assert packed.split_values('["a", b') == (('["a"', True), ("b", False))
    assert packed.split_values('"a"], b') == (('"a"]', True), ("b", False))
    assert packed.split_values("[a] x, b") == (("[a] x", False), ("b", False))
    assert packed.split_values("[[a] x], b") == (("[[a] x]", False), ("b", False))
