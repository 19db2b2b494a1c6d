"""Table files in and out: CSV with declared types, JSON state, exports."""

from __future__ import annotations

import math
import re
import time
import zipfile
from collections.abc import Sequence
from decimal import Decimal
from itertools import islice
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden values from CSV, each read as the type its row declares in
    data_type; what doesn't read as it is null in the typed columns."""
    schema = "key string, field string, value string, data_type string"
    d = spark.read.schema(schema).option("header", True).csv(path)
    kind, v = F.lower("data_type"), F.col("value")
    return d.select(
        "key", "field", "value", "data_type", F.when(kind == "integer", v.try_cast("bigint")).alias("as_integer"), F.when(kind.isin("decimal", "number", "float"), F.replace(v, F.lit(","), F.lit("")).try_cast("decimal(18,4)")).alias("as_number"),
        F.when(kind == "date", F.call_function("try_to_date", v, F.lit("yyyy-MM-dd"))).alias("as_date"), F.when(kind == "boolean", v.try_cast("boolean")).alias("as_boolean"),
    )


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State kept as JSON, one document or one a line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = ("array", "struct", "map")
    return df.select(*(F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; single: in one file, for results of a bounded size."""
    flat = _flat(df)
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, title: str) -> int:
    """A report under a path: all rows as JSON lines in rows, and title, columns
    and number of rows in about. Returns that number."""
    df.write.mode("overwrite").json(f"{path}/rows")
    spark = df.sparkSession
    n = spark.read.text(f"{path}/rows").count()
    spark.createDataFrame([(title, n, df.columns)], "title string, count bigint, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    return n


#: Rows a sheet of a workbook can hold, its header included.
SHEET_ROWS = 1_048_576
_SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and math.isfinite(v):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROLS.sub("", str(v)))}</t></is></c>'


def write_sheets(sheets: dict[str, DataFrame], path: str, rows_per_sheet: int = SHEET_ROWS) -> dict[str, int]:
    """A workbook with all rows of each table, for people to open: a file on the
    driver, through which the rows stream one partition at a time. A table with
    more rows than a sheet holds goes on in further sheets. Rows per table."""
    written: dict[str, int] = {}
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, df in sheets.items():
            flat, written[name], part = _flat(df), 0, 0
            rows = iter(flat.toLocalIterator())
            while True:
                part += 1
                names.append(re.sub(r"[\[\]:*?/\\]", "_", name)[:24] + (f" ({part})" if part > 1 else ""))
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                    put = lambda x: f.write(x.encode())  # noqa: B023, E731
                    put(f'<worksheet xmlns="{_SPREADSHEET}"><sheetData><row>' + "".join(map(_cell, flat.columns)) + "</row>")
                    n = 0
                    for r in islice(rows, rows_per_sheet - 1):
                        put("<row>" + "".join(map(_cell, r)) + "</row>")
                        n += 1
                    put("</sheetData></worksheet>")
                written[name] += n
                if n < rows_per_sheet - 1:
                    break
        tabs = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_SPREADSHEET}" xmlns:r="{_RELATIONS}"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
    return written


def write_tables(tables: dict[str, DataFrame], path: str, formats: Sequence[str] = ("csv",)) -> dict[str, int]:
    """Tables as CSV or JSON folders path/name.format; rows of each."""
    n = {}
    for name, df in tables.items():
        for fmt in formats:
            {"csv": write_csv, "json": write_json}[fmt](df, f"{path}/{name}.{fmt}")
        n[name] = df.count()
    return n


def read_export(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """An exported CSV read back with the columns and types of a table; nested
    columns come back from their JSON text."""
    nested = ("array", "struct", "map")
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in like.columns)).option("header", True).csv(path)
    return raw.select(*(F.from_json(c, t).alias(c) if t.startswith(nested) else F.col(c).try_cast(t).alias(c) for c, t in like.dtypes))


def remove_old(spark: SparkSession, folder: str, days: float, now: float | None = None) -> tuple[int, int]:
    """Delete files under a folder, on any file system, that are older; their
    number and bytes."""
    before = ((time.time() if now is None else now) - days * 86400) * 1000
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = size = 0
    files = fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        if f.getModificationTime() < before and fs.delete(f.getPath(), False):
            n, size = n + 1, size + f.getLen()
    return n, size
