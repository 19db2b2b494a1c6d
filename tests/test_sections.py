"""Goods out of makers' tables and pages, at their edges."""

import pytest
from pyspark.sql import functions as F

from pricewright.operators import grid, load, lookups, sections
from pricewright.sources import documents

CELLS = "table_id int, row_index int, col_index int, cell string, header string, length string"


def cells(spark, rows, table=1):
    return spark.createDataFrame([(table, r, c, v, "x", "x") for r, row in enumerate(rows) for c, v in enumerate(row)], CELLS)


def headers(spark, names, table=1):
    return spark.createDataFrame([(table, c, n, "x") for c, n in enumerate(names)], "table_id int, col_index int, header string, cell string")


@pytest.mark.parametrize(
    "text,want",
    [("SL11 CL HD600", ("SL11", "CL", "HD600")), ("sl 14 bk", ("sl14", "BK", None)), ("SL11 LL", ("SL11", None, "LL")), ("SL11", None), ("306", None), ("model", None), ("", None), (None, None), ("  SL24CL  ", ("SL24", "CL", None))],
)
def test_descriptors(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(sections.descriptor(F.col("t")).alias("x")).first().x
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "text,want",
    [("45.50", 45.5), ("-", None), ("—\n1,105", 1105.0), ("1/2", None), ("102 mm", None), ("5", None), ("20000", None), ("n/a", None), ("", None), (None, None), ("see edge\n$ 99", 99.0), ("x" * 100_000, None)],
)
def test_cell_prices(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(sections.cell_price(F.col("t")).alias("x")).first().x == want


def test_lengths_dashes_and_held_descriptors(spark):
    c = cells(spark, [["SL11 CL HD600", "100", "200"], ["", "-", "300"], ["SL12", "1", "400"], ["", "", "500 SL99"], [None, None, None], ["SL14 BR", "95", "600"]])
    got = sorted((r.row_index, r.base_model, r.length, r.base_price) for r in sections.priced_by_length(c, headers(spark, ["Model #", '95"', '83"/85"'])).collect())
    # Row 2 names another model, row 3 a model in the price's place; 95 in the column of length 95 is no price.
    assert got == [(0, "SL11", "83", 200.0), (0, "SL11", "85", 200.0), (0, "SL11", "95", 100.0), (1, "SL11", "83", 300.0), (1, "SL11", "85", 300.0), (5, "SL14", "83", 600.0), (5, "SL14", "85", 600.0)]
    none = cells(spark, [])
    assert sections.priced_by_length(none, headers(spark, [])).count() == 0


def test_packed_lengths_meet_prices_in_order(spark):
    c = cells(spark, [["SL11 CL", "100\n–\n300", "400"], ["", "nan", None]])
    got = [(r.length, r.base_price) for r in sections.priced_by_line(c, headers(spark, ['79"\n83" / 85"\n95\n79', "a"])).orderBy("length").collect()]
    assert got == [("79", 100.0), ("95", 300.0)]


def test_net_adders_count_once(spark):
    t = spark.createDataFrame([(1, "CTW-4 $108.00\n$108.00 net add per CTW-4; tipit LEFT 25", 0), (2, None, 0), (3, "", 0), (4, "FR3: $0", 0)], "text_id int, text string, option_code int")
    got = sorted(tuple(r) for r in sections.net_adders(t, "text_id", "text").collect())
    assert (1, "CTW", "4", 108.0) in got and (1, "TIPIT", "Left", 25.0) in got and {g[0] for g in got} == {1} and len(set(got)) == len(got)


def test_matrix_pages(spark):
    text = 'BB1191 Full Mortise Ball Bearing\nUS4\n4" x 4"\nUS3\n10.50\n11.00\nUS10B 12.25\n4-1/2" x 4"\nUS26D 9 mm 8.00\nUS15 each 7.75'
    p = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "no model US3 1.00", "s")], "page_id int, text string, sku string")
    got = [(r.sku, r.base_price, r.series) for r in sections.matrix_products(p).orderBy("entry_no").collect()]
    assert got == [("BB1191-4x4-US3", 10.5, "Ball Bearing Hinge"), ("BB1191-4x4-US10B", 12.25, "Ball Bearing Hinge"), ("BB1191-4.5x4-US15", 7.75, "Ball Bearing Hinge")]
    assert [r.x for r in p.orderBy("page_id").select(sections.is_matrix_page(F.col("text")).alias("x")).collect()] == [True, None, False]


def test_lines_of_two_cells(spark):
    rows = [(1, "ETM-4 a\nBB110 b", "5\n6"), (2, "BB110 x\ny", "7"), (3, "Description", "9"), (4, "BB1 x", "price"), (5, None, "4"), (6, "plain", "4"), (7, "BB7 x", "0")]
    d = spark.createDataFrame([(*r, "s", 0) for r in rows], "row_id int, description string, price string, sku string, line_no int")
    assert sorted((r.row_id, r.line_no, r.sku, r.base_price) for r in sections.paired_lines(d, ["row_id"], "description", "price").collect()) == [(1, 0, "ETM-4", 5.0), (1, 1, "BB110", 6.0), (2, 0, "BB110", 7.0)]


def test_column_roles(spark):
    c = cells(spark, [["BB1", "10", "US3", "4x4"], ["BB2", "11", "US4", "5x5"], ["BB3", "12", None, ""]])
    names = lambda *n: spark.createDataFrame([(1, i, x, 0) for i, x in enumerate(n)], "table_id int, col_index int, name string, price int")
    assert tuple(grid.column_roles(c, names("Model", "List", "Finish", "Dim")).first()) == (1, 0, 1, 2, 3, None)
    # A sku in the first column counts as not taken: a later one replaces it.
    assert grid.column_roles(c, names("Model", "List", "Part no", "")).first().sku == 2
    assert tuple(grid.column_roles(c, names("", "", "", "")).first()) == (1, 0, 1, None, 3, None)
    assert grid.column_roles(c.limit(0), names()).count() == 0


def test_structures_of_small_tables(spark):
    assert grid.structures(cells(spark, [])).count() == 0
    one = grid.structures(cells(spark, [["a"]])).first()
    assert (one.rows, one.cols, one.header_rows, one.data_rows, one.fingerprint) == (1, 1, 0, 1, "0#1x1#T")
    # One header row isn't welded, so it counts among the first three of its column.
    t = grid.structures(cells(spark, [["Model", "Price"], ["A", "1"], ["B", "2"], ["Total", "3"]])).first()
    assert (t.rows, t.data_rows, t.patterns) == (4, 3, "TT")


def test_loading_twice_adds_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    results = {
        "books": spark.createDataFrame([("Hager", "book_2025.pdf", "March 3, 2025", 1), (" hager", "b.pdf", None, 2), (None, None, None, 3)], "manufacturer string, file_name string, effective string, pos int"),
        "finishes": spark.createDataFrame([("hager", "US3", "", "Brass", 1), ("hager", "us3", "x", "", 2), ("hager", None, "x", "", 3)], "manufacturer string, code string, name string, label string, pos int"),
        "products": spark.createDataFrame([("hager", "S1", "M1", None, "a hinge", "1.50", 1), ("hager", None, None, "", None, None, 2)], "manufacturer string, sku string, model string, series string, description string, base_price string, pos int"),
        "options": none("manufacturer string, option_code string, option_name string, adder_type string, adder_value string, pos int"), "rules": none("manufacturer string, description string, pos int"),
    }
    empty = {"manufacturers": none("name string, code string"), "price_books": none("manufacturer string, edition string"), "finishes": none("manufacturer string, code string"), "families": none("manufacturer string, name string")}
    first = load.load(results, empty)
    assert {r.table_name: r.inserted for r in first.counts().collect()} == {"manufacturers": 1, "price_books": 3, "finishes": 1, "product_families": 1, "products": 2, "product_options": 0, "change_logs": 0}
    assert first.tables["finishes"].first().name == "Brass" and first.tables["product_families"].first().category == "Hinges"
    again = load.load(results, {"manufacturers": first.tables["manufacturers"], "price_books": first.tables["price_books"], "finishes": first.tables["finishes"], "families": first.tables["product_families"]})
    assert {r.table_name: r.inserted for r in again.counts().collect() if r.table_name not in ("products",)} == {"manufacturers": 0, "price_books": 0, "finishes": 0, "product_families": 0, "product_options": 0, "change_logs": 0}


def test_pages_of_lists(spark):
    d = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3) for i in range(7)], "id int, n int")
    e = lookups.envelope(d, [F.col("n").desc_nulls_last(), F.col("id")], 2, 3, "id").first()
    assert (e.total, e.total_pages, e.has_next, e.has_previous, e.ids) == (7, 3, True, True, "3,6,0")
    assert lookups.envelope(d.limit(0), [F.col("id")], 1, 3, "id").first().total_pages == 0


def test_tables_by_ranges_of_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    path = spark.read.format("binaryFile").load(str(tmp_path)).first().path
    pages = spark.createDataFrame([(path, 60), ("none", 0)], "path string, page_count int")

    def decode(content, first, last):
        if first == 26:
            raise ValueError("broken")
        return [(p, 0, 0, 0, content.decode(), 0.9, "words") for p in range(first, last + 1)]

    got = documents.read_tables(spark, str(tmp_path), pages, decode).collect()
    assert sorted(r.page_number for r in got if r.error is None) == [*range(1, 26), *range(51, 61)]
    assert [(r.page_number, r.method) for r in got if r.error] == [(26, "failed")]


def test_readers_are_asked_in_turn(spark):
    rows = [(1, 1, "words", 0.9), (1, 1, "stream", 0.99), (1, 2, "words", 0.5), (1, 2, "stream", 0.8), (1, 2, "scan", 0.9), (1, 3, "scan", 0.6)]
    t = spark.createDataFrame(rows, "doc_id int, page int, method string, accuracy double")
    assert sorted((r.page, r.method) for r in documents.trusted_tables(t, ["words", "?stream", "?scan"]).collect()) == [(1, "words"), (2, "stream")]


def test_layers(spark):
    from pricewright.operators import layers

    s = "page int, sku string, confidence double"
    first = spark.createDataFrame([(1, "BB1100", 0.9), (1, "--", 0.9), (2, "X", 0.5)], s)
    g = layers.gates(first, first).first()
    assert (g.per_page, g.second, g.third) == (1.5, True, True)
    none = layers.gates(first.limit(0), first.limit(0)).first()
    assert (none.per_page, none.confidence, none.invalid, none.second) == (0.0, 0.0, 1.0, True)
    assert sorted(r.sku for r in layers.replaced(first, spark.createDataFrame([(1, "NEW", 0.8)], s)).collect()) == ["NEW", "X"]
    assert [round(r.confidence, 2) for r in layers.scanned(first, 0.6).collect()] == [0.99, 0.99]


def test_every_price(spark):
    from pricewright.operators import layers

    c = cells(spark, [["SL11 BR", "100", '7" 200', "300"], ["no model", "50", "60", "70"], ["SL12", "-", "CL 99", "SL12 -"]])
    got = sorted((r.row_index, r.col_index, r.sku, r.base_price) for r in layers.every_price(c, headers(spark, ["Model", '83"', "", "Black"])).collect())
    assert got == [(0, 0, "SL11_BR", 11.0), (0, 1, "SL11_BR_83", 100.0), (0, 2, 'SL11_BR_7"', 200.0), (0, 3, 'SL11_BK_7"', 300.0), (2, 2, "SL12_CL", 99.0)]
