"""Inputs derived from the given tables by SQL that Spark and DuckDB both read.

Names in braces are tables: Spark gets them as DataFrames, the SQL oracle as names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pricewright.runtime import table

_PART = """
SELECT p_partkey AS pos, lower(p_brand) AS manufacturer, lower(p_type) AS family, 'P' || lpad(cast(p_partkey AS string), 6, '0') AS sku,
  substr(p_type, 1, 2) || '-' || p_partkey AS model, cast(p_size AS string) AS size, 'US' || (p_partkey % 30) AS finish, p_name AS description, cast(p_retailprice AS double) AS base_price
FROM {part}
"""

INPUTS = {
    "old_edition": f"SELECT * FROM ({_PART}) WHERE pos % 50 <> 7",
    "new_edition": f"""
SELECT pos, manufacturer, family, sku,
  CASE WHEN pos % 40 = 3 THEN model || 'A' WHEN pos % 40 = 5 THEN replace(model, '-', '_') ELSE model END AS model, size, finish,
  CASE WHEN pos % 25 = 4 THEN description || ' revised' ELSE description END AS description,
  CASE WHEN pos % 10 = 0 THEN round(base_price * 1.05, 2) ELSE base_price END AS base_price
FROM ({_PART}) WHERE pos % 50 <> 11""",
    # Two books of the goods of each brand, by sku: some skus get a suffix, some go, some come, some change state.
    "old_skus": f"SELECT pos, manufacturer, sku, model, description, base_price, pos % 9 <> 2 AS is_active FROM ({_PART}) WHERE pos % 50 <> 7",
    "new_skus": f"""
SELECT pos, manufacturer, CASE WHEN pos % 40 = 3 THEN sku || '-A' ELSE sku END AS sku, model, CASE WHEN pos % 25 = 4 THEN description || ' revised' ELSE description END AS description,
  CASE WHEN pos % 10 = 0 THEN round(base_price * 1.05, 2) WHEN pos % 33 = 6 THEN 0.0 ELSE base_price END AS base_price, pos % 9 <> 2 OR pos % 4 = 1 AS is_active
FROM ({_PART}) WHERE pos % 50 <> 11""",
    "old_options": "SELECT n_nationkey AS pos, upper(substr(n_name, 1, 3)) || n_nationkey AS option_code, cast(n_nationkey * 2 + 10 AS double) AS amount FROM {nation} WHERE n_nationkey % 7 <> 3",
    "new_options": "SELECT n_nationkey AS pos, upper(substr(n_name, 1, 3)) || n_nationkey AS option_code, cast(n_nationkey * 2 + 10 + CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 0 END AS double) AS amount FROM {nation} WHERE n_nationkey % 7 <> 4",
    "old_rules": "SELECT a.r_regionkey * 10 + b.r_regionkey AS pos, lower(a.r_name) || '|' || lower(b.r_name) || '|' || ((a.r_regionkey + b.r_regionkey) * 5) AS signature FROM {region} a JOIN {region} b ON a.r_regionkey <> b.r_regionkey WHERE a.r_regionkey <> 2",
    "new_rules": "SELECT a.r_regionkey * 10 + b.r_regionkey AS pos, lower(a.r_name) || '|' || lower(b.r_name) || '|' || ((a.r_regionkey + b.r_regionkey) * 5 + CASE WHEN b.r_regionkey = 4 THEN 1 ELSE 0 END) AS signature FROM {region} a JOIN {region} b ON a.r_regionkey <> b.r_regionkey WHERE b.r_regionkey <> 1",
    # Three extraction layers of the same goods, with their own prices and trust.
    "layers": """
SELECT 1 AS layer, p_partkey AS pos, 'P-' || p_partkey AS sku, cast(p_retailprice AS double) AS base_price, p_name AS description, cast(NULL AS string) AS finish, 'pdfplumber_digital' AS method, cast(70 + p_partkey % 20 AS double) / 100 AS confidence, p_partkey % 40 AS page FROM {part} WHERE p_partkey % 4 <> 1
UNION ALL SELECT 2, 10000000 + p_partkey, 'p ' || p_partkey, round(cast(p_retailprice AS double) * CASE WHEN p_partkey % 9 = 0 THEN 1.2 ELSE 1.004 END, 2), CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END, 'US' || (p_partkey % 30), 'camelot_lattice', cast(60 + p_partkey % 30 AS double) / 100, p_partkey % 40 FROM {part} WHERE p_partkey % 3 <> 2
UNION ALL SELECT 3, 20000000 + p_partkey, 'P_' || p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE cast(p_retailprice AS double) END, p_name, cast(NULL AS string), 'ocr_tesseract', cast(50 + p_partkey % 40 AS double) / 100, p_partkey % 40 FROM {part} WHERE p_partkey % 5 <> 3""",
    # What was found on pages, little on some and nothing on others; and what should have been.
    "found_items": "SELECT p_partkey AS pos, p_partkey % 40 AS page FROM {part} WHERE p_partkey % 40 % 7 <> 3 AND (p_partkey % 40 % 5 <> 1 OR p_partkey % 9 = 0)",
    "golden_items": "SELECT 'P' || p_partkey AS k, cast(p_retailprice AS double) + CASE WHEN p_partkey % 13 = 0 THEN 9.0 ELSE 0.0 END AS base_price FROM {part} WHERE p_partkey % 10 <> 6 UNION ALL SELECT 'Q' || s_suppkey, 5.0 FROM {supplier}",
    # One text line per part, as catalogs print them.
    "lines": """
SELECT p_partkey AS line_no, floor(p_partkey / 40) AS page_number,
  CASE WHEN p_partkey % 11 = 0 THEN 'Series BB' || p_partkey || ' - Full Mortise'
    WHEN p_partkey % 7 = 0 THEN upper(substr(p_type, 1, 2)) || p_partkey || ' US' || (p_partkey % 30) || ' 4.5x4.5 $' || cast(cast(p_retailprice AS decimal(10,2)) AS string)
    WHEN p_partkey % 5 = 0 THEN 'SL' || (p_partkey % 90 + 10) || ' CL HD' || (p_partkey % 9 + 1) || '00  ' || cast(cast(p_retailprice AS decimal(10,2)) AS string) || '  each'
    WHEN p_partkey % 3 = 0 THEN 'CTW-' || (p_partkey % 12) || ' add $' || (p_partkey % 200 + 5) || ' per door'
    ELSE p_name END AS line
FROM {part}""",
    # A cell grid: tables of at most ten rows and five columns, with blanks below the first column's heads.
    "cells": "\nUNION ALL ".join(
        f"SELECT floor(o_orderkey / 10) AS table_id, cast(o_orderkey % 10 AS int) AS row_index, {c} AS col_index, {e} AS cell FROM {{orders}}"
        for c, e in enumerate(
            [
                "CASE WHEN o_orderkey % 3 = 0 THEN 'M' || o_custkey ELSE '' END",
                "o_orderpriority",
                "CASE WHEN o_orderkey % 17 = 0 THEN 'call' ELSE cast(cast(o_totalprice AS decimal(12,2)) AS string) END",
                "CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE '$' || (o_custkey % 900 + 10) END",
                "CASE WHEN o_orderkey % 5 = 0 THEN 'nan' ELSE o_orderstatus END",
            ]
        )
    ),
    # Tables of forty rows and eight columns with none to three header rows; the second column is blank down to row 15.
    "tall_cells": "\nUNION ALL ".join(
        f"SELECT floor((p_partkey - 1) / 40) AS table_id, cast((p_partkey - 1) % 40 AS int) AS row_index, {c} AS col_index, CASE WHEN (p_partkey - 1) % 40 >= floor((p_partkey - 1) / 40) % 4 THEN {e} WHEN (p_partkey - 1) % 40 = 0 THEN '{h[0]}' WHEN (p_partkey - 1) % 40 = 1 THEN '{h[1]}' ELSE '{h[2]}' END AS cell FROM {{part}}"
        for c, (h, e) in enumerate(
            [
                (("Model", "Code", "Item"), "'M' || p_partkey"),
                (("Price", "2024", "each"), "CASE WHEN (p_partkey - 1) % 40 < 15 THEN '' ELSE cast(cast(p_retailprice AS decimal(10,2)) AS string) END"),
                (("Finish", "26", "Finish"), "cast(p_partkey % 900 AS string)"),
                (("Name", "Name", "Part"), "p_brand"),
                (("", "nan", ""), "'$' || (p_partkey % 70 + 5)"),
                (("Qty", "", "box"), "cast(p_size AS string)"),
                (("Size", "inches", ""), "CASE WHEN p_partkey % 3 = 0 THEN 'call' ELSE p_type END"),
                (("List", "net", "USD"), "cast(p_partkey % 50 AS string)"),
            ]
        )
    ),
    # Tables whose columns are lengths: descriptors that hold for rows below, dashes, slipped lengths, lines within cells.
    "length_tables": "\nUNION ALL ".join(
        f"SELECT floor((p_partkey - 1) / 12) AS table_id, cast((p_partkey - 1) % 12 AS int) AS row_index, {c} AS col_index, CASE WHEN (p_partkey - 1) % 12 = 0 THEN '{h}' ELSE {e} END AS cell FROM {{part}}"
        for c, (h, e) in enumerate(
            [
                ("Model #", "CASE WHEN p_partkey % 4 = 1 THEN 'SL' || cast(11 + floor(p_partkey / 12) % 3 AS int) || CASE WHEN p_partkey % 3 = 0 THEN ' CL HD600' WHEN p_partkey % 3 = 1 THEN ' BR LL' ELSE ' LL' END WHEN p_partkey % 8 = 3 THEN 'SL99' WHEN p_partkey % 4 = 2 THEN '  ' ELSE 'nan' END"),
                ('79"', "CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE cast(cast(p_retailprice AS decimal(10,2)) AS string) END"),
                ('83"/85"', "CASE WHEN p_partkey % 5 = 0 THEN 'SL24 500' WHEN p_partkey % 11 = 0 THEN '20000' ELSE '$' || (p_partkey % 900 + 100) || '.50' END"),
                ('95"', "CASE WHEN p_partkey % 6 = 0 THEN '95' WHEN p_partkey % 6 = 1 THEN '1/2' ELSE '—' || chr(10) || '1,' || (p_partkey % 800 + 100) END"),
                ('120"', "CASE WHEN p_partkey % 3 = 0 THEN 'min 500' WHEN p_partkey % 10 = 4 THEN '5' ELSE cast(p_size * 20 + 10 AS string) END"),
            ]
        )
    ),
    # The same with all lengths in the first header and the prices of a row in the lines of two cells.
    "packed_tables": "\nUNION ALL ".join(
        f"SELECT floor((p_partkey - 1) / 12) AS table_id, cast((p_partkey - 1) % 12 AS int) AS row_index, {c} AS col_index, CASE WHEN (p_partkey - 1) % 12 = 0 THEN {h} ELSE {e} END AS cell FROM {{part}}"
        for c, (h, e) in enumerate(
            [
                ("'79\"' || chr(10) || '83\" / 85\"' || chr(10) || '95\"' || chr(10) || '79\"'", "CASE WHEN p_partkey % 3 = 1 THEN 'SL14 BK HD300' WHEN p_partkey % 6 = 2 THEN 'SL11 CL' ELSE '' END"),
                ("'a'", "cast(p_size * 10 + 40 AS string) || chr(10) || CASE WHEN p_partkey % 4 = 0 THEN '–' ELSE '$' || (p_partkey % 700 + 20) END"),
                ("'b'", "CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE (p_partkey % 300 + 50) || '.25' || chr(10) || '777' END"),
            ]
        )
    ),
    # Tables that name models in any cell, with finishes and prices beside them.
    "loose_tables": "\nUNION ALL ".join(
        f"SELECT floor((p_partkey - 1) / 10) AS table_id, cast((p_partkey - 1) % 10 AS int) AS row_index, {c} AS col_index, {e} AS cell FROM {{part}}"
        for c, e in enumerate(
            [
                "CASE WHEN p_partkey % 5 = 0 THEN 'BR' ELSE p_brand END",
                "CASE WHEN p_partkey % 2 = 0 THEN 'SL ' || (p_partkey % 80 + 10) || CASE WHEN p_partkey % 3 = 0 THEN ' CL HD600' WHEN p_partkey % 3 = 1 THEN ' BK 95\"' ELSE '' END ELSE '' END",
                "CASE WHEN p_partkey % 4 = 0 THEN 'cl' WHEN p_partkey % 4 = 1 THEN '$' || p_size || '.00' ELSE '-' END",
                "CASE WHEN p_partkey % 6 < 4 THEN '$ ' || cast(cast(p_retailprice AS decimal(10,2)) AS string) ELSE 'call' END",
            ]
        )
    ),
    # Price matrices of twenty columns' worth of forms, with finishes for names.
    "matrix_cells": "\nUNION ALL ".join(
        f"SELECT floor((p_partkey - 1) / 8) AS table_id, cast((p_partkey - 1) % 8 AS int) AS row_index, {c} AS col_index, '{h}' AS name, {e} AS cell FROM {{part}}"
        for c, (h, e) in enumerate(
            [
                ("Model", "CASE WHEN p_partkey % 9 = 0 THEN 'nan' ELSE 'BB' || p_partkey END"), ("Size", "(p_size % 5 + 2) || 'x4'"), ("us3", "'$' || p_size || '.50'"), ("US26D", "CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE cast(p_partkey % 300 AS string) || '.00' END"), ("Weight", "'heavy'"),
            ]
        )
    ),
    # Pages of a price matrix, in the notations of two readers, some with part numbers.
    "matrix_pages": """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 10 = 9 THEN 'PART NUMBER' ELSE 'Price list' END || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'ECBB' || (1000 + p_partkey % 9000) || ' Full Mortise Electric Heavy Weight' WHEN 1 THEN 'BB' || (1000 + p_partkey % 9000) || ' Half Surface Ball Bearing Standard Weight' WHEN 2 THEN 'WT' || (1000 + p_partkey % 9000) ELSE 'no model' END
  || chr(10) || 'US4' || chr(10) || '4-1/2" x 4"' || chr(10) || 'US3' || chr(10) || cast(cast(p_retailprice AS decimal(10,2)) AS string) || chr(10) || '55.00' || chr(10) || '102 x 102 mm US3 9.99' || chr(10) || 'US26D list ' || p_size || ' net ' || p_size || '.75 or 9.99'
  || chr(10) || '5" x 5" US10B 77.10' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'US32D' || chr(10) || 'US15A 12.00' || chr(10) || '8.25' ELSE ' US10 ' END AS text
FROM {part}""",
    # Lines with options, finishes and dates as catalogs name them.
    "adder_texts": """
SELECT p_partkey AS text_id, 'CTW-' || (p_partkey % 12 + 1) || ' $' || (p_partkey % 200) || '.00, EPT prep ' || p_size || ' and TIPIT ' || CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'RIGHT' END || ' $' || (p_size + 7) || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '$108.00 net add per CTW-4; CTW-4 net add per CTW-4: $108.00; ' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'FR3 18 Hospital Tip = 25' WHEN p_partkey % 5 = 1 THEN 'Clear [CL], Dark  Bronze [br] or Black [XX]' ELSE 'ATW 8 $64.50 Black [BK]' END AS text
FROM {part}""",
    # Cells that hold several goods in their lines.
    "line_cells": """
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN 'ETM-4 (4 wire)' || chr(10) || 'BB' || (1000 + p_partkey) || ' hinge' || chr(10) || 'plain' WHEN p_partkey % 3 = 1 THEN 'WT' || (1000 + p_partkey) || ' wide throw' ELSE 'Description' END AS description,
  CASE WHEN p_partkey % 3 = 0 THEN '12.50' || chr(10) || ' $' || p_size || chr(10) || '7' WHEN p_partkey % 6 = 1 THEN '1,200.75' ELSE 'nan' END AS price
FROM {part}""",
    # Pages with tables set with runs of blanks, ragged, between lines of prose.
    "text_pages": """
SELECT p_partkey AS page_id, 'Catalog ' || p_name || chr(10) || 'Model  Price  Size' || chr(10) || '  BB' || p_partkey || '   $' || p_size || '.50  4x4   note' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'CTW' || chr(9) || '12.' || (p_partkey % 90 + 10) || chr(9) || 'US3' END
  || chr(10) || 'one  two  three' || chr(10) || CASE WHEN p_partkey % 4 = 0 THEN 'A1  B2' ELSE 'A1  B2  C3  D4  E' || p_size END AS text
FROM {part}""",
    # Words of a scanned page with their places.
    "words": """
SELECT floor(l_orderkey / 15) AS page, l_orderkey * 10 + l_linenumber AS word_no, cast(l_orderkey * 7 % 60 * 12 + l_linenumber % 5 AS int) AS top_, cast(l_suppkey * 13 % 600 AS int) AS left_, l_returnflag || l_linenumber AS word, cast(l_quantity * 2 AS double) AS conf
FROM {lineitem}""",
}


def derived(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A derived input."""
    sql = INPUTS[name]
    return spark.sql(sql, **{t: table(spark, d, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def oracle(name: str) -> str:
    """The same as a SQL subquery."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", INPUTS[name]).replace("AS string)", "AS VARCHAR)") + ")"
