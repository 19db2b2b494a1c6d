"""Scans of documents: bytes to pages and words, by a hook that decodes.

Decoders of document formats are foreign code: a hook is a function from the
bytes of a file to its pages. The scan is distributed, a document that fails
gives a row with its error, and page numbers never shift."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.keys import is_blank
from pricewright.runtime import arrow_map

#: A hook: file content to (page number, text, method, confidence).
Decoder = Callable[[bytes], Iterable[tuple[int, str | None, str, float]]]

PAGES = "path string, page_number int, text string, extraction_method string, confidence double, error string"


def plain_text(content: bytes) -> Iterator[tuple[int, str, str, float]]:
    """The decoder for plain text: pages end with form feeds."""
    for n, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield n, text, "text", 1.0


def first_that_works(*decoders: Decoder) -> Decoder:
    """The pages of the first decoder that doesn't raise."""

    def decode(content: bytes) -> Iterable[tuple[int, str | None, str, float]]:
        last: Exception | None = None
        for d in decoders:
            try:
                return list(d(content))
            except Exception as e:  # any decoder may fail in its own way
                last = e
        raise last or ValueError("no decoder")

    return decode


def read_pages(spark: SparkSession, path: str, decoder: Decoder = plain_text, glob: str = "*", max_pages: int = 1000) -> DataFrame:
    """Pages of all files under a path. A file whose decoder raises gives one
    row of method failed. Pages beyond max_pages of a file are not read, for
    which it gets one row of method skipped with the first of them."""

    def first(content: bytes) -> Iterator[tuple]:
        for n, t, m, c in decoder(content):
            if n > max_pages:
                yield n, None, "skipped", 0.0, f"pages after {max_pages} not read"
                return
            yield n, t, m, c, None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows: list[tuple] = []
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(p, *page) for page in first(content)]
                except Exception as e:  # a bad document must not end the job
                    rows.append((p, None, None, "failed", 0.0, str(e)[:500]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "page_number", "text", "extraction_method", "confidence", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return arrow_map(files.select("path", "content"), run, PAGES)


def read_metadata(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, edition) of files, without reading their content."""
    from pricewright.functions.normalize import edition_of

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), edition_of(F.element_at(F.split("path", "/"), -1)).alias("edition"))


def tables_in_text(pages: DataFrame, least_rows: int = 2) -> DataFrame:
    """(path, page_number, row_index, col_index, header, cell): tables set with
    runs of blanks or tabs. A row has three fields and a digit; ragged rows are
    padded; the first row gives the headers."""
    line = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    d = pages.where(F.col("text").isNotNull()).select("path", "page_number", line)
    fields = F.filter(F.split(F.trim("line"), r"\s{2,}|\t"), lambda x: x != "")
    d = d.withColumn("fields", fields).where((F.size("fields") >= 3) & F.exists("fields", lambda x: x.rlike(r"\d")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "fields")))
    t = d.groupBy("path", "page_number").agg(rows.alias("rows")).where(F.size("rows") >= least_rows)
    wide = F.array_max(F.transform("rows", lambda r: F.size(r["fields"])))
    t = t.withColumn("wide", wide).withColumn("head", F.get("rows", F.lit(0))["fields"])
    r = t.select("path", "page_number", "wide", "head", F.posexplode("rows").alias("row_index", "row"))
    c = r.select("path", "page_number", "row_index", "head", "row", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("col_index"))
    at = lambda a: F.coalesce(F.get(a, F.col("col_index")), F.lit(""))
    return c.select("path", "page_number", "row_index", "col_index", at(F.col("head")).alias("header"), at(F.col("row.fields")).alias("cell"))


def best_method(candidates: DataFrame) -> DataFrame:
    """Of several extractions of a page the one whose tables score best."""
    best = F.max_by("extraction_method", F.struct("quality", "confidence", "extraction_method")).alias("extraction_method")
    return candidates.groupBy("path", "page_number").agg(best, F.max("quality").alias("quality"))


def page_batches(documents: DataFrame, key: str, pages: str, size: int = 25) -> DataFrame:
    """(key, batch, first_page, last_page): documents cut into ranges of pages, so
    that a long one is read by several tasks at once."""
    starts = F.sequence(F.lit(1), F.col(pages), F.lit(size))
    d = documents.where(F.col(pages) >= 1).select(key, pages, F.posexplode(starts).alias("batch", "first_page"))
    return d.select(key, "batch", "first_page", F.least(F.col("first_page") + size - 1, F.col(pages)).alias("last_page"))


#: A hook for tables: file content, first and last page to (page, table, row, column, cell, accuracy, method).
TableDecoder = Callable[[bytes, int, int], Iterable[tuple[int, int, int, int, str | None, float, str]]]

CELLS = "path string, page_number int, table_index int, row_index int, col_index int, cell string, accuracy double, method string, error string"


def read_tables(spark: SparkSession, path: str, pages: DataFrame, decoder: TableDecoder, glob: str = "*", batch: int = 25) -> DataFrame:
    """Cells of the tables in all files under a path, each range of pages a task
    of its own. pages: (path, page_count). A range that fails gives one row with
    its error, the others are read all the same. Save the result as a table to
    read it more than once."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows: list[tuple] = []
            for p, content, first, last in zip(*(b.column(c).to_pylist() for c in ("path", "content", "first_page", "last_page"))):
                try:
                    rows += [(p, *r, None) for r in decoder(content, first, last)]
                except Exception as e:  # a bad range must not end the job
                    rows.append((p, first, None, None, None, None, 0.0, "failed", str(e)[:500]))
            cols = list(zip(*rows)) or [()] * 9
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split(" ")[0] for c in CELLS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    work = page_batches(pages, "path", "page_count", batch).join(files, "path").repartition("path", "batch")
    return arrow_map(work, run, CELLS)


def priced_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, col_index, cell): lines of a scanned text that hold a price,
    cut at runs of blanks; lines of fewer than three parts are left out."""
    line = F.posexplode(F.split(text, "\n")).alias("pos", "line")
    parts = F.filter(F.split(F.trim("line"), r"\s{2,}|\t"), lambda x: x != "")
    d = texts.select(key, line).where(F.col("line").rlike(r"\d+\.\d+|\$\d+")).select(key, F.col("pos").alias("row_no"), parts.alias("parts")).where(F.size("parts") > 2)
    return d.select(key, "row_no", F.posexplode("parts").alias("col_index", "cell"))


def trusted_tables(tables: DataFrame, order: list[str], least: float = 0.7) -> DataFrame:
    """Tables of several readers put together: those of the first readers that are
    accurate enough; of the readers from `fallback` on only where a page has none
    of an earlier one. tables: (doc_id, page, method, accuracy, ...); order names
    the readers, a leading ? marks a fallback."""
    rank = {m.lstrip("?"): i for i, m in enumerate(order)}
    level, out = 0, {}
    for m in order:
        level += m.startswith("?")
        out[m.lstrip("?")] = level
    of = F.create_map(*(F.lit(x) for kv in out.items() for x in kv))
    d = tables.where(F.col("method").isin(*rank) & (F.col("accuracy") > least)).withColumn("_level", F.element_at(of, F.col("method")))
    first = d.groupBy("doc_id", "page").agg(F.min("_level").alias("_first"))
    return d.join(first, ["doc_id", "page"]).where(F.col("_level") == F.col("_first")).drop("_level", "_first")


def proxy_confidence(cells: DataFrame) -> DataFrame:
    """(table_id, by_size, by_filling): how far a table can be trusted whose reader
    doesn't say: by its size, and by its share of filled cells."""
    g = cells.groupBy("table_id").agg(F.count_distinct("row_index").alias("r"), F.count_distinct("col_index").alias("c"), F.count("*").alias("n"), F.count_if(~is_blank(F.col("cell"))).alias("f"))
    return g.select("table_id", F.round(F.least(F.lit(0.95), 0.5 + F.col("r") * F.col("c") / 100), 6).alias("by_size"), F.round(F.col("f") / F.col("n") * 0.85, 6).alias("by_filling"))


def page_texts(pages: DataFrame, key: str, page: str, text: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(key, text): the pages of a range as one text, each under its number."""
    p = pages.where(F.col(page) >= first) if last is None else pages.where(F.col(page).between(first, last))
    parts = F.array_sort(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t"))))
    return p.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: F.concat(F.format_string("--- PAGE %d ---\n", x[page]), x["t"])), "\n\n").alias("text"))
