"""Queries on pages, tables in texts, and what readers of documents give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.operators import grid
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry
from pricewright.runtime import table
from pricewright.sources import documents

QUERIES, ORACLE, query = registry()

_ROWS = """(SELECT page_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {0})"""
_PARTS = "list_filter(regexp_split_to_array(trim(line, ' '), '\\s{2,}|\\t'), lambda x: x <> '')"
_PAGES = oracle("text_pages")


@query(f"""WITH f AS (SELECT page_id, pos, {_PARTS} AS p FROM {_ROWS.format(_PAGES)}), t AS (SELECT page_id, p, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY page_id) AS n, max(len(p)) OVER (PARTITION BY page_id) AS w FROM f WHERE len(p) >= 3 AND len(list_filter(p, lambda x: regexp_matches(x, '\\d'))) > 0),
h AS (SELECT page_id, p AS head FROM t WHERE r = 0) SELECT page_id AS page_number, r AS row_index, c - 1 AS col_index, coalesce(head[c], '') AS header, coalesce(p[c], '') AS cell FROM t JOIN h USING (page_id), range(1, 30) x(c) WHERE n >= 2 AND c <= w""")
def text_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables set with runs of blanks in a page's text."""
    p = derived(spark, d, "text_pages").select(F.lit("p").alias("path"), F.col("page_id").alias("page_number"), "text")
    return documents.tables_in_text(p).drop("path")


@query(f"SELECT page_id, pos AS row_no, c - 1 AS col_index, p[c] AS cell FROM (SELECT page_id, pos, {_PARTS} AS p FROM {_ROWS.format(_PAGES)} WHERE regexp_matches(line, '\\d+\\.\\d+|\\$\\d+')), range(1, 30) x(c) WHERE len(p) > 2 AND c <= len(p)")
def priced_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned texts that hold a price, in columns."""
    return documents.priced_lines(derived(spark, d, "text_pages"), "page_id", "text")


@query("SELECT o_orderkey, b - 1 AS batch, (b - 1) * 25 + 1 AS first_page, least(b * 25, o_custkey % 130) AS last_page FROM orders, range(1, 10) r(b) WHERE (b - 1) * 25 + 1 <= o_custkey % 130")
def page_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into ranges of 25 pages."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 130).alias("pages"))
    return documents.page_batches(o, "o_orderkey", "pages")


_BLANK = "(cell IS NULL OR lower(trim(cell)) IN ('', 'nan', 'none'))"


@query(f"SELECT table_id, round(least(0.95, 0.5 + count(DISTINCT row_index) * count(DISTINCT col_index) / 100), 6) AS by_size, round(count_if(NOT {_BLANK}) / count(*) * 0.85, 6) AS by_filling FROM {oracle('cells')} GROUP BY 1")
def table_confidences(spark: SparkSession, d: str) -> DataFrame:
    return documents.proxy_confidence(derived(spark, d, "cells"))


_READ = "(SELECT l_orderkey AS doc_id, l_partkey % 3 AS page, l_linenumber AS table_no, CASE l_suppkey % 4 WHEN 0 THEN 'words' WHEN 1 THEN 'lattice' WHEN 2 THEN 'stream' ELSE 'scan' END AS method, cast(l_discount * 5 + 0.6 AS DOUBLE) AS accuracy FROM lineitem)"


def _read(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey") % 4
    method = F.when(k == 0, "words").when(k == 1, "lattice").when(k == 2, "stream").otherwise("scan")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 3).alias("page"), F.col("l_linenumber").alias("table_no"), method.alias("method"), (F.col("l_discount") * 5 + 0.6).cast("double").alias("accuracy"))


@query(f"SELECT doc_id, page, table_no, method FROM (SELECT *, min(lv) OVER (PARTITION BY doc_id, page) AS first_lv FROM (SELECT *, CASE method WHEN 'stream' THEN 1 WHEN 'scan' THEN 2 ELSE 0 END AS lv FROM {_READ} WHERE accuracy > 0.7)) WHERE lv = first_lv")
def trusted_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of several readers; some are asked only where the others have none."""
    return documents.trusted_tables(_read(spark, d), ["words", "lattice", "?stream", "?scan"]).select("doc_id", "page", "table_no", "method")


@query(f"SELECT doc_id AS path, page AS page_number, arg_max(method, (q, accuracy, method)) AS extraction_method, max(q) AS quality FROM (SELECT doc_id, page, method, max(accuracy) AS accuracy, count(*) * 10 AS q FROM {_READ} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def best_methods(spark: SparkSession, d: str) -> DataFrame:
    """Of several readers of a page the one whose tables score best."""
    r = _read(spark, d).groupBy("doc_id", "page", "method").agg(F.max("accuracy").alias("confidence"), (F.count("*") * 10).alias("quality"))
    return documents.best_method(r.select(F.col("doc_id").alias("path"), F.col("page").alias("page_number"), F.col("method").alias("extraction_method"), "confidence", "quality"))


@query("SELECT coalesce(manufacturer, '') AS maker, md5(string_agg('--- PAGE ' || doc_id || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id)) AS mark FROM documents WHERE doc_id BETWEEN 1 AND 1000000000 GROUP BY 1")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """A maker's documents as one text under their numbers, as digests."""
    p = table(spark, d, "documents").select(F.coalesce("manufacturer", F.lit("")).alias("maker"), "doc_id", "text")
    return documents.page_texts(p, "maker", "doc_id", "text", 1, 1_000_000_000).select("maker", F.md5("text").alias("mark"))


_WORDS = oracle("words")


@query(f"SELECT word_no, left_, top_, left_ + 9 AS right_, top_ + 7 AS bottom_ FROM {_WORDS}")
def word_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of words from their four corners."""
    w = derived(spark, d, "words")
    x, y = F.col("left_"), F.col("top_")
    corner = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    w = w.select("word_no", F.array(corner(x + 9, y), corner(x, y + 7), corner(x, y), corner(x + 9, y + 7)).alias("points"))
    return grid.normal_boxes(w).drop("points")


@query(f"""WITH s AS (SELECT page, left_ AS start FROM (SELECT page, left_, lag(left_) OVER (PARTITION BY page ORDER BY left_) AS b FROM (SELECT DISTINCT page, left_ FROM {_WORDS})) WHERE b IS NULL OR left_ - b >= 30)
SELECT word_no, greatest(len(list_filter(starts, lambda x: x <= w.left_ + 20)) - 1, 0) AS column_ FROM {_WORDS} w JOIN (SELECT page, list(start) AS starts FROM s GROUP BY 1) USING (page)""")
def word_columns(spark: SparkSession, d: str) -> DataFrame:
    """The column each word falls in."""
    w = derived(spark, d, "words")
    return grid.column_index(w, grid.column_starts(w)).select("word_no", "column_")


@query(f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top_, left_, word_no) AS i FROM {_WORDS}), heads AS (SELECT page, top_ AS head FROM w WHERE i = 1
  UNION SELECT h.page, (SELECT min(top_) FROM w WHERE w.page = h.page AND w.top_ > h.head + 10) FROM heads h WHERE h.head IS NOT NULL)
SELECT w.page, word_no, len(list_filter(hs, lambda x: x <= w.top_)) - 1 AS line_no FROM w JOIN (SELECT page, list(head) AS hs FROM heads WHERE head IS NOT NULL GROUP BY 1) USING (page)""")
def scanned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words put to lines."""
    return grid.word_lines(derived(spark, d, "words"))
