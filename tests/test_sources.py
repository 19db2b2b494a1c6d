import os

import pytest

from pricewright.sources import documents, files
from pricewright.streaming import flows


def test_pages_and_tables(spark, tmp_path):
    (tmp_path / "book_2024.txt").write_text("Model  Price  Size\nA1  10.50  4\nA2  11  5\fsecond page")
    (tmp_path / "bad.txt").write_bytes(b"\xff")

    def decode(content):
        if content == b"\xff":
            raise ValueError("broken")
        return documents.plain_text(content)

    pages = documents.read_pages(spark, str(tmp_path), documents.first_that_works(decode), "*.txt")
    got = {(os.path.basename(r.path), r.page_number): r for r in pages.collect()}
    assert got["bad.txt", None].extraction_method == "failed" and "broken" in got["bad.txt", None].error
    assert got["book_2024.txt", 2].text == "second page"
    cells = documents.tables_in_text(pages).orderBy("row_index", "col_index").collect()
    assert [(c.header, c.cell) for c in cells][:3] == [("A1", "A1"), ("10.50", "10.50"), ("4", "4")]
    assert {r.edition for r in documents.read_metadata(spark, str(tmp_path)).collect()} == {"2024 Edition", "Unknown Edition"}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, None)], "a int, b array<int>")
    files.write_csv(df, str(tmp_path / "c"), single=True)
    assert {r.b for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"[1,2]", None}
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert files.write_report(df, str(tmp_path / "r"), "t") == 2
    assert spark.read.json(str(tmp_path / "r" / "about")).first().asDict() == {"title": "t", "count": 2, "columns": ["a", "b"]}
    assert files.read_export(spark, str(tmp_path / "c"), df).orderBy("a").collect() == df.orderBy("a").collect()
    (tmp_path / "g.csv").write_text("key,field,value,data_type\n1,a,12,integer\n1,b,x,integer\n1,c,2024-01-02,date\n")
    assert [r.as_integer for r in files.read_golden(spark, str(tmp_path / "g.csv")).orderBy("field").collect()] == [12, None, None]
    old = tmp_path / "old"
    old.mkdir()
    (old / "f").write_text("12345")
    assert files.remove_old(spark, str(old), 1) == (0, 0)
    assert files.remove_old(spark, str(old), 1, now=os.path.getmtime(old / "f") + 2 * 86400) == (1, 5)


def test_upsert_stream(spark, tmp_path):
    land, target, state = (str(tmp_path / x) for x in ("land", "target", "state"))
    schema = "k string, n int"
    for batch in ([("a", 1), ("b", 1)], [("a", 2), ("b", 0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(land)
        flows.upsert_stream(flows.read_stream(spark, land, schema), target, "k", "n", state).awaitTermination()
    assert {tuple(r) for r in flows.current(spark, target).collect()} == {("a", 2), ("b", 1)}
    # An unfinished version is none; nothing else says which one is current.
    os.makedirs(f"{target}/table/v9")
    spark.createDataFrame([("c", 5)], schema).coalesce(1).write.mode("append").parquet(land)
    flows.upsert_stream(flows.read_stream(spark, land, schema), target, "k", "n", state).awaitTermination()
    assert {tuple(r) for r in flows.current(spark, target).collect()} == {("a", 2), ("b", 1), ("c", 5)}
    assert sorted(os.listdir(f"{target}/table")) == ["v1", "v2", "v9"]


def test_a_table_that_cannot_be_read_ends_the_batch(spark, tmp_path):
    land, target, state = (str(tmp_path / x) for x in ("land", "target", "state"))
    for batch in (1, 2):
        spark.createDataFrame([("a", batch)], "k string, n int").coalesce(1).write.mode("append").parquet(land)
        q = flows.upsert_stream(flows.read_stream(spark, land, "k string, n int"), target, "k", "n", state)
        if batch == 1:
            q.awaitTermination()
            for f in os.listdir(f"{target}/table/v0"):
                if f.endswith(".parquet"):
                    open(f"{target}/table/v0/{f}", "w").close()
        else:
            with pytest.raises(Exception):  # noqa: B017
                q.awaitTermination()
    assert not os.path.exists(f"{target}/table/v1/_SUCCESS")


def test_workbook_holds_all_rows(spark, tmp_path):
    import zipfile

    df = spark.range(25).selectExpr("id", "concat('<', id, '>') AS t", "array(id) AS a")
    assert files.write_sheets({"x/y": df, "empty": df.limit(0)}, str(tmp_path / "b.xlsx"), rows_per_sheet=11) == {"x/y": 25, "empty": 0}
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        text = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3, 4)]
    assert [t.count("<row>") for t in text] == [11, 11, 6, 1]
    assert "&lt;24&gt;" in text[2] and "[24]" in text[2]


def test_pages_beyond_the_limit_are_told(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\f".join("abcdef"))
    got = [(r.page_number, r.extraction_method) for r in documents.read_pages(spark, str(tmp_path), max_pages=4).orderBy("page_number").collect()]
    assert got == [(1, "text"), (2, "text"), (3, "text"), (4, "text"), (5, "skipped")]
