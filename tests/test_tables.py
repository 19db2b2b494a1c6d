from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricewright.operators import grid, lines, lookups, merge, metrics, publish

T0 = datetime(2024, 1, 1)


def test_merge_sources(spark):
    s = "sku string, pos int, base_price double, method string, confidence double, finish string, sources int"
    df = spark.createDataFrame(
        [("A-1", 1, 100.0, "text", 0.8, None, 9), ("a 1", 2, 100.5, "table", 0.9, None, 9), ("A_1", 3, None, "model", 0.7, "US3", 9), ("B", 4, 10.0, "text", 0.9, "x", 9), ("B", 5, 20.0, "text", 0.8, "y", 9), ("C", 6, 5.0, "text", 0.3, None, 9), ("D", 7, 5.0, "text", 0.7, None, 9), (None, 8, 1.0, "text", 0.9, None, 9), ("B", 5, 20.0, "text", 0.8, "y", 9)], s
    )
    got = {r.item_key: r for r in merge.merge_sources(df.drop("sources"), ["finish"]).collect()}
    assert set(got) == {"A1", "B", "D"}
    a, b = got["A1"], got["B"]
    assert (a.base_price, a.finish, a.methods, a.price_conflict, a.confidence) == (100.25, "US3", 3, False, 1.0)
    assert (b.base_price, b.finish, b.price_conflict) == (10.0, "x", True)
    assert merge.merge_sources(df.limit(0), ["finish"]).count() == 0


def test_as_of_and_latest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), (None, 3)], "k string, at int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 20), ("b", 9, 30)], "k string, since int, v int")
    got = {(r.k, r.at): r.v for r in lookups.as_of(left, right, "k", "at", "since", "v").collect()}
    assert got == {("a", 5): 20, ("a", 1): 10, ("b", 3): None, (None, 3): None}
    last = lookups.latest(right, ["k"], ["since"], ["since", "v"])
    assert {(r.k, r.since, r.v) for r in last.collect()} == {("a", 4, 20), ("b", 9, 30)}


def test_grid_folds(spark):
    c = spark.createDataFrame([(1, r, 0, v) for r, v in enumerate(["", "a", None, "nan", "b"])], "table_id int, row_index int, col_index int, cell string")
    assert [r.filled for r in grid.fill_down(c).orderBy("row_index").collect()] == [None, "a", "a", "a", "b"]
    assert [(r.head_row, r.last_row) for r in grid.merged_regions(c).collect()] == [(1, 3)]
    w = spark.createDataFrame([(1, i, t, 0) for i, t in enumerate([0, 4, 10, 12, 30])], "page int, word_no long, top_ int, left_ int")
    assert [r.line_no for r in grid.word_lines(w).orderBy("word_no").collect()] == [0, 0, 0, 1, 2]
    # The head of a run decides: same fingerprint, same names, or seven of ten columns of the same kind.
    told = [(1, "x", "a|b", "NT", 2), (2, "y", "a|b", "TT", 0), (3, "x", "q", "N", 0), (5, "z", "c|d|e", "TTN", 0), (6, "w", "f|g|h", "TNN", 0), (7, "v", "i|j|k", "TNN", 0), (8, "v2", "l|m|n", "TNN", 2), (9, None, None, None, None)]
    t = spark.createDataFrame([(1, 1, p, f, n, k, r) for p, f, n, k, r in told], "doc_id int, d int, page int, fingerprint string, names string, patterns string, header_rows int")
    got = grid.stitch(t.withColumn("table_id", F.col("page").cast("long"))).orderBy("table_id").collect()
    assert [r.group_id for r in got] == [0, 0, 0, 1, 2, 2, 3, 4]
    assert grid.stitch(t.limit(0).withColumn("table_id", F.lit(1))).count() == 0


def test_unpivot_and_types(spark):
    c = spark.createDataFrame([(1, r, k, v) for r, row in enumerate([["A", "1", "$2,000"], ["", "3", "-"], ["C", "nan", "x"]]) for k, v in enumerate(row)], "table_id int, row_index int, col_index int, cell string")
    assert {(r.key, r.value) for r in grid.unpivot(c).collect()} == {("A", 1.0), ("A", 2000.0)}
    assert {r.col_index: r.kind for r in grid.column_types(c).collect()} == {0: "text", 1: "number", 2: "text"}


def test_lines(spark):
    ln = spark.createDataFrame([(1, 1, "SL11 US26D 4.5x4.5 $1,234.50"), (1, 2, "CTW-4 add $108"), (1, 3, None), (1, 4, "nothing"), (1, 5, "CTW-4 add $108")], "page_number int, line_no int, line string")
    got = lines.items(ln).where("line_no = 1").first()
    assert (got.sku, got.finish, got.size, got.base_price) == ("SL11", "US26D", "4.5x4.5", 1234.5)
    assert [tuple(r) for r in lines.adders(ln).collect()] == [(1, "CTW-4", 108.0, 2)]
    r = lines.runs(ln, F.col("line").rlike(r"\d")).collect()
    assert [(x.first_line, x.last_line) for x in r] == [(1, 2)]


def test_sessions_and_periods(spark):
    e = spark.createDataFrame([("u", T0 + timedelta(minutes=m), 1.0) for m in (0, 10, 50, 60)] + [(None, T0, None)], "user string, ts timestamp, value double")
    assert sorted(r.events for r in metrics.sessions(e, "user", "ts").collect()) == [1, 2, 2]
    assert {(r.period, r.n) for r in metrics.period_counts(e.withColumn("k", F.lit("k")), "ts", "k").collect()} == {("day", 5), ("week", 5), ("month", 5)}


def test_publish(spark):
    rule = publish.TableRule("t", ("k",), {"k": publish.FieldRule(required=True, max_length=3), "v": publish.FieldRule(number=True, low=0)})
    s = "k string, v string, pos int"
    src = spark.createDataFrame([("a", "1", 1), (" A ", "2", 2), ("b", "5", 3), ("c", "6", 4), (None, "x", 5), ("long", "-1", 6)], s)
    tgt = spark.createDataFrame([("b", "5", 1), ("c", "7", 1)], s)
    assert {(r.violation, r.n) for r in publish.violation_counts(src, rule).collect()} == {("k:missing", 1), ("k:length", 1), ("v:number", 1), ("v:low", 1)}
    plan = publish.upsert_plan(src.where("k in ('a', ' A ', 'b', 'c')"), tgt, rule, ["v"], "pos")
    assert {(r.v, r.action) for r in plan.collect()} == {("2", "create"), ("5", "same"), ("6", "update")}
    r = publish.deliver(plan, lambda rows: None, chunk=1).first()
    assert (r["rows"], r["chunks"]) == (2, 2)


def _grid(spark, table):
    return spark.createDataFrame([(1, r, k, v) for r, row in enumerate(table) for k, v in enumerate(row)], "table_id int, row_index int, col_index int, cell string")


def test_types_by_the_first_filled_cells(spark):
    c = _grid(spark, [["", "x"]] * 12 + [["5", "x"]] * 3 + [["nan", "1"]] * 20)
    assert {r.col_index: (r.filled, r.kind) for r in grid.column_types(c).collect()} == {0: (3, "number"), 1: (10, "text")}
    assert grid.typed(c).where("number is not null").count() == 3


def test_headers_of_one_to_three_rows(spark):
    heads = [["Model", "Price", "Size", "Name", "Qty", "", "x", "y"], ["Model", "2024", "25", "Part", "b", "", "x", "z"], ["Code", "a", "b", "Part", "c", "nan", "x", "y"]]
    data = [["A1", "1", "2", "3", "4", "5", "t", "u"]] * 12
    got = [{r.col_index: r.header for r in grid.weld_headers(_grid(spark, heads[:n] + data)).collect()} for n in range(4)]
    assert got[0] == {}
    assert (got[1][0], got[1][1], got[1][5]) == ("Model", "Price", "col_5")
    assert (got[2][0], got[2][1], got[2][3]) == ("Model", "Price 2024", "Name Part")
    assert (got[3][0], got[3][1], got[3][6], got[3][7]) == ("Model Code", "Price 2024 a", "x", "y z")
