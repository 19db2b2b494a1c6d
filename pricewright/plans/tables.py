"""Queries on recovered table structure and goods read out of tables and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions import scoring
from pricewright.operators import grid, sections
from pricewright.plans.inputs import derived, oracle
from pricewright.plans.registry import registry

QUERIES, ORACLE, query = registry()

_C, _T = oracle("cells"), oracle("tall_cells")
_BLANK = "(cell IS NULL OR lower(trim(cell)) IN ('', 'nan', 'none'))"
_NUM = "try_cast(regexp_extract(regexp_replace(trim(cell), '[$,\\s]', '', 'g'), '^-?\\d+(?:\\.\\d+)?$') AS DOUBLE)"


def _filled(source: str) -> str:
    down = f"SELECT table_id, row_index, col_index, coalesce(last_value(CASE WHEN NOT {_BLANK} THEN cell END IGNORE NULLS) OVER (PARTITION BY table_id, col_index ORDER BY row_index), cell) AS cell FROM {source}"
    return f"(SELECT table_id, row_index, col_index, CASE WHEN row_index < 3 THEN last_value(CASE WHEN NOT {_BLANK} THEN cell END IGNORE NULLS) OVER (PARTITION BY table_id, row_index ORDER BY col_index) ELSE cell END AS cell FROM ({down}))"


@query(f"SELECT table_id, row_index, col_index, cell AS filled FROM {_filled(_C)}")
def cells_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Merged cells recovered downwards, then to the right."""
    return grid.fill_merged(derived(spark, d, "cells")).drop("cell")


_STRUCTURES = f"""WITH RECURSIVE src AS (SELECT * FROM {_T}), r AS (SELECT table_id, row_index, lower(string_agg(coalesce(cell, ''), ' ' ORDER BY col_index)) AS t, count(*) AS n, count({_NUM}) AS k FROM src GROUP BY 1, 2),
h AS (SELECT table_id, row_index, regexp_matches(t, '{"|".join(grid.HEADER_WORDS)}') AND k < n * 0.3 AND coalesce(abs(lead(k) OVER (PARTITION BY table_id ORDER BY row_index) - k) >= 2, true) AS head FROM r),
f AS (SELECT table_id, min(row_index) AS a FROM h WHERE head AND row_index < 3 GROUP BY 1),
runs AS (SELECT f.table_id, a, coalesce(min(row_index), 3) AS b FROM f LEFT JOIN h ON f.table_id = h.table_id AND row_index BETWEEN a AND 2 AND NOT head GROUP BY 1, 2),
multi AS (SELECT * FROM runs WHERE b - a > 1),
parts AS (SELECT table_id, col_index, CASE WHEN NOT {_BLANK} THEN trim(cell) END AS t, min(row_index) AS pos FROM src JOIN multi USING (table_id) WHERE row_index >= a AND row_index < b GROUP BY 1, 2, 3),
heads AS (SELECT table_id, col_index, coalesce(string_agg(t, ' ' ORDER BY pos), 'col_' || col_index) AS name FROM parts GROUP BY 1, 2),
names AS (SELECT c.table_id, c.col_index, coalesce(h.name, cast(c.col_index AS VARCHAR)) AS name, coalesce(m.b - m.a, 0) AS header_rows FROM (SELECT DISTINCT table_id, col_index FROM src) c LEFT JOIN heads h USING (table_id, col_index) LEFT JOIN multi m USING (table_id)),
body AS (SELECT s.table_id, s.row_index - coalesce(m.b, 0) AS row_index, s.col_index, s.cell FROM src s LEFT JOIN multi m USING (table_id) WHERE s.row_index >= coalesce(m.b, 0)),
regions AS (SELECT table_id, count(*) AS merged FROM (SELECT table_id, col_index, g FROM (SELECT *, sum(CASE WHEN {_BLANK} THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, col_index ORDER BY row_index) AS g FROM body) WHERE g > 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
filled AS (SELECT *, max(row_index) OVER (PARTITION BY table_id) AS last_row FROM {_filled("body")}),
cols AS (SELECT table_id, col_index, count(*) AS n, count({_NUM}) AS numeric, count_if(NOT {_BLANK}) AS full_, string_agg(CASE WHEN {_NUM} IS NULL THEN 'T' ELSE 'N' END, '' ORDER BY row_index) FILTER (row_index < 3) AS signs,
  max(CASE WHEN row_index = last_row AND regexp_matches(lower(cell), 'total|subtotal|sum') THEN 1 ELSE 0 END) AS foot, count({_NUM}) FILTER (row_index < 3) AS n3, count_if(row_index < 3 AND NOT {_BLANK}) AS f3 FROM filled GROUP BY 1, 2),
tables AS (SELECT c.table_id, max(n) AS rows, count(*) AS cols, max(header_rows) AS header_rows, max(foot) AS foot, avg(CASE WHEN n > 1 THEN greatest(numeric / n, 1 - numeric / n) ELSE 0 END) AS one_kind, avg(CASE WHEN trim(name) IN ('', '0', '1', '2', 'col_0', 'col_1') THEN 0 ELSE 1 END) AS named, sum(full_) / sum(n) AS full_,
  string_agg(substr(lower(name), 1, 10), '|' ORDER BY col_index) AS short, string_agg(signs, ',' ORDER BY col_index) FILTER (col_index < 3) AS signs, string_agg(name, '|' ORDER BY col_index) AS names, string_agg(CASE WHEN n3 > f3 * 0.7 THEN 'N' ELSE 'T' END, '' ORDER BY col_index) AS patterns
  FROM cols c JOIN names USING (table_id, col_index) GROUP BY 1),
structures AS (SELECT t.table_id, rows, cols, header_rows, CASE WHEN rows > 2 AND foot = 1 THEN rows - 1 ELSE rows END AS data_rows, coalesce(merged, 0) AS merged, short || '#' || cols || 'x' || rows || '#' || signs AS fingerprint, names, patterns,
  round(least(1.0, (least(full_ * 2, 1.0) + CASE WHEN cols >= 2 AND rows >= 2 THEN one_kind ELSE 0 END + (1 - abs(rows - was) / was) + named) / CASE WHEN cols >= 2 AND rows >= 2 THEN 4 ELSE 3 END + CASE WHEN header_rows > 1 THEN 0.1 ELSE 0 END + CASE WHEN merged IS NOT NULL THEN 0.05 ELSE 0 END), 6) AS confidence
  FROM tables t JOIN (SELECT table_id, count(DISTINCT row_index) AS was FROM src GROUP BY 1) USING (table_id) LEFT JOIN regions USING (table_id))
"""


def _structures(spark: SparkSession, d: str) -> DataFrame:
    return grid.structures(derived(spark, d, "tall_cells"))


@query(_STRUCTURES + "SELECT * FROM structures")
def table_structures(spark: SparkSession, d: str) -> DataFrame:
    """Names, fingerprints, data rows and confidence of tables after welding and recovery."""
    return _structures(spark, d)


_STITCHED = _STRUCTURES + """, listed AS (SELECT floor(table_id / 12) AS doc_id, table_id, fingerprint, names, string_split(patterns, '') AS p, header_rows > 1 AS multi, row_number() OVER (PARTITION BY floor(table_id / 12) ORDER BY table_id % 12, table_id) AS i FROM structures),
folded AS (SELECT doc_id, table_id, 0 AS group_id, i, fingerprint AS f, names AS n, p, multi AS m FROM listed WHERE i = 1
  UNION ALL SELECT doc_id, table_id, CASE WHEN fits THEN group_id ELSE group_id + 1 END, i, CASE WHEN fits THEN f ELSE f1 END, CASE WHEN fits THEN n ELSE n1 END, CASE WHEN fits THEN p ELSE p1 END, CASE WHEN fits THEN m ELSE m1 END
  FROM (SELECT t.doc_id, t.table_id, g.group_id, t.i, g.f, g.n, g.p, g.m, t.fingerprint AS f1, t.names AS n1, t.p AS p1, t.multi AS m1, t.fingerprint = g.f OR t.names = g.n OR (t.multi = g.m AND len(t.p) = len(g.p) AND len(list_filter(list_zip(t.p, g.p), lambda z: z[1] = z[2])) >= 0.7 * len(g.p)) AS fits
    FROM folded g JOIN listed t ON t.doc_id = g.doc_id AND t.i = g.i + 1))
"""


def _stitched(spark: SparkSession, d: str) -> DataFrame:
    s = _structures(spark, d)
    return grid.stitch(s.select(F.floor(F.col("table_id") / 12).alias("doc_id"), "table_id", (F.col("table_id") % 12).alias("page"), "fingerprint", "names", "patterns", "header_rows"))


@query(_STITCHED + "SELECT doc_id, table_id, group_id FROM folded")
def stitched_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables put together over pages; the fold has a run's head as its state."""
    return _stitched(spark, d)


@query(_STITCHED + f""", sized AS (SELECT table_id, max(row_index) + 1 AS high, max(col_index) + 1 AS cols FROM src GROUP BY 1),
placed AS (SELECT doc_id, group_id, table_id, coalesce(sum(high) OVER (PARTITION BY doc_id, group_id ORDER BY table_id % 12, table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, first_value(cols) OVER (PARTITION BY doc_id, group_id ORDER BY table_id % 12, table_id) AS wide FROM folded JOIN sized USING (table_id))
SELECT doc_id, group_id, count(*) AS cells, max(row_index + above) AS last_row, sum((row_index + above) * length(coalesce(cell, ''))) AS mark FROM src JOIN placed USING (table_id) WHERE col_index < wide GROUP BY 1, 2""")
def stitched_cells(spark: SparkSession, d: str) -> DataFrame:
    """The rows of stitched tables under each other, as counts and marks of each run."""
    c = derived(spark, d, "tall_cells")
    rows = grid.stitched_rows(c, _stitched(spark, d), c.select("table_id", (F.col("table_id") % 12).alias("page")).distinct())
    return rows.groupBy("doc_id", "group_id").agg(F.count("*").alias("cells"), F.max("row_index").alias("last_row"), F.sum(F.col("row_index") * F.length(F.coalesce("cell", F.lit("")))).alias("mark"))


@query(f"SELECT table_id, coalesce(count(*) FILTER (row_index = 0 AND trim(cell) <> '' AND {_NUM} IS NULL) > count(*) FILTER (row_index = 0 AND trim(cell) <> '' AND {_NUM} IS NOT NULL), false) AS has_header FROM {_T} GROUP BY 1")
def header_presence(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table's first row has more text than numbers."""
    return grid.has_header(derived(spark, d, "tall_cells"))


_ROW = "lower(string_agg(cell, ' ' ORDER BY col_index))"
_TIDY = "nullif(CASE WHEN col_index = 0 THEN upper({0}) ELSE {0} END, '')".format("regexp_replace(regexp_replace(trim(replace(regexp_replace(cell, '\\s+', ' ', 'g'), ' | ', ' ')), '\\$\\s+(\\d)', '$\\1', 'g'), '(?i)(\\d+)\\s+TO\\s+(\\d+[A-Z0-9]*)', '\\1-\\2', 'g')")


@query(f"""WITH t AS (SELECT table_id, row_index, col_index, {_TIDY} AS cell FROM {oracle("length_tables")}), rows AS (SELECT table_id, row_index, coalesce({_ROW}, '') AS t FROM t GROUP BY 1, 2), cols AS (SELECT table_id, col_index FROM t GROUP BY 1, 2 HAVING count(cell) > 0)
SELECT t.* FROM t JOIN rows r USING (table_id, row_index) JOIN cols USING (table_id, col_index) WHERE r.t <> '' AND NOT (regexp_matches(r.t, '{"|".join(grid.NOISE)}') AND NOT regexp_matches(r.t, '\\$?\\d+\\.\\d{{2}}'))""")
def cells_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Cells closed up, without noise and blank rows and columns."""
    return grid.cleaned(derived(spark, d, "length_tables"))


# --- roles of columns -----------------------------------------------------------

_HAS = {r: "(" + " OR ".join(f"contains(name, '{w}')" for w in ws) + ")" for r, ws in grid.ROLES.items()}
_PACKED = """list_filter([{0}], lambda v: v IS NOT NULL)[1]""".format(
    ", ".join(
        ["CASE WHEN {0} BETWEEN 0.01 AND 100000 THEN {0} END".format(f"try_cast(replace(regexp_extract(regexp_replace(cell, '\\s+', '', 'g'), '{p}', 1), ',', '') AS DOUBLE)") for p in (r"\$(\d+[,\d]*\.?\d{0,2})", r"(\d+[,\d]*\.\d{2})USD", r"Price:\$?(\d+[,\d]*\.?\d{2})", r"(\d+[,\d]*\.\d{2})")]
        + ["CASE WHEN {0} BETWEEN 5 AND 100000 THEN {0} END".format(r"try_cast(regexp_extract(regexp_replace(cell, '\s+', '', 'g'), '(?:^|[^A-Za-z\d])(\d{1,6}(?:\.\d{1,2})?)$', 1) AS DOUBLE)")]
    )
)


def _roles(cells: str, names: str) -> str:
    free = lambda r: f"coalesce(a.{r}, 0) = 0"
    fits = {
        "sku": "(c.is_sku OR (c.texts > c.numeric AND c.col_index = 0))", "price": f"(c.is_price OR c.dollar > 0 OR (c.numeric >= 3 AND {free('sku')}))", "finish": "c.is_finish", "size": "(c.is_size OR c.cross_ > 0)", "description": "c.is_description",
    }
    order = list(grid.ROLES)
    mine = {r: " AND ".join([free(r), fits[r], *(f"NOT ({free(q)} AND {fits[q]})" for q in order[: order.index(r)])]) for r in order}
    return f"""WITH RECURSIVE feats AS (SELECT table_id, col_index, count_if(row_index < 5 AND trim(cell) <> '' AND regexp_matches(trim(cell), '^\\$?\\d+[,.\\d]*$')) AS numeric, count_if(row_index < 5 AND NOT regexp_matches(trim(cell), '^\\$?\\d+[,.\\d]*$') AND regexp_matches(trim(cell), '^[A-Za-z]')) AS texts,
  count_if(row_index < 5 AND contains(cell, '$')) AS dollar, count_if(row_index < 5 AND contains(lower(cell), 'x')) AS cross_, count_if(row_index < 5 AND {_PACKED} IS NOT NULL) AS priced FROM {cells} GROUP BY 1, 2),
c AS (SELECT f.*, {", ".join(f"{e} AS is_{r}" for r, e in _HAS.items())} FROM feats f JOIN (SELECT table_id, col_index, lower(trim(name)) AS name FROM {names}) USING (table_id, col_index)),
a AS (SELECT table_id, -1 AS step, {", ".join(f"NULL::INT AS {r}" for r in order)} FROM (SELECT DISTINCT table_id FROM c)
  UNION ALL SELECT a.table_id, a.step + 1, {", ".join(f"CASE WHEN {mine[r]} THEN c.col_index ELSE a.{r} END" for r in order)} FROM a JOIN c ON a.table_id = c.table_id AND c.col_index = a.step + 1),
done AS (SELECT table_id, coalesce(sku, 0) AS sku, price, finish, size, description FROM a QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY step DESC) = 1),
roles AS (SELECT d.table_id, sku, CASE WHEN coalesce(price, 0) = 0 THEN coalesce((SELECT min(col_index) FROM c WHERE c.table_id = d.table_id AND c.col_index <> d.sku AND priced >= 2), price) ELSE price END AS price, finish, size, description FROM done d)
"""


_MC = oracle("matrix_cells")
_MROLES = _roles(f"(SELECT table_id, row_index, col_index, cell FROM {_MC})", f"(SELECT DISTINCT table_id, col_index, name FROM {_MC})")
_TROLES = _roles(f"(SELECT * FROM {_T} WHERE row_index > 0)".replace("SELECT *", "SELECT table_id, row_index - 1 AS row_index, col_index, cell"), f"(SELECT table_id, col_index, coalesce(cell, '') AS name FROM {_T} WHERE row_index = 0)")


def _matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = derived(spark, d, "matrix_cells")
    return m.drop("name"), m.select("table_id", "col_index", "name").distinct()


def _tall(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = derived(spark, d, "tall_cells")
    return t.where("row_index > 0").withColumn("row_index", F.col("row_index") - 1), t.where("row_index = 0").select("table_id", "col_index", F.coalesce("cell", F.lit("")).alias("name"))


@query(_TROLES + "SELECT * FROM roles")
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    """Which columns hold skus, prices, finishes, sizes and descriptions."""
    return grid.column_roles(*_tall(spark, d))


@query(_MROLES + "SELECT * FROM roles")
def matrix_roles(spark: SparkSession, d: str) -> DataFrame:
    """The same of price matrices."""
    return grid.column_roles(*_matrix(spark, d))


@query(_TROLES + f""", sized AS (SELECT table_id, count(DISTINCT row_index) - 1 AS rows, count(DISTINCT col_index) AS cols FROM {_T} GROUP BY 1)
SELECT table_id, round(q, 6) AS quality, round(least(1.0, 0.9 + CASE WHEN q >= 0.9 THEN 0.06 WHEN q >= 0.7 THEN 0.04 WHEN q >= 0.5 THEN 0.02 ELSE 0 END), 6) AS boosted FROM (SELECT table_id, least(1.0, 0.30 + CASE WHEN price IS NULL THEN 0 ELSE 0.30 END + CASE WHEN description IS NULL THEN 0 ELSE 0.20 END
  + CASE WHEN rows BETWEEN 5 AND 500 THEN 0.10 WHEN rows BETWEEN 2 AND 4 THEN 0.05 ELSE 0 END + CASE WHEN cols BETWEEN 3 AND 15 THEN 0.10 WHEN cols = 2 THEN 0.05 ELSE 0 END) AS q FROM roles JOIN sized USING (table_id))""")
def table_qualities(spark: SparkSession, d: str) -> DataFrame:
    """Quality of tables by their known columns, and what it adds to a confidence of 0.9."""
    cells, names = _tall(spark, d)
    n = cells.groupBy("table_id").agg(F.count_distinct("row_index").alias("rows"), F.count_distinct("col_index").alias("cols"))
    q = scoring.table_quality(F.col("sku"), F.col("price"), F.col("description"), F.col("rows"), F.col("cols"))
    t = grid.column_roles(cells, names).join(n, "table_id").select("table_id", F.round(q, 6).alias("quality"))
    return t.withColumn("boosted", F.round(scoring.table_boost(F.lit(0.9), F.col("quality")), 6))


@query(_MROLES + f"""SELECT table_id, m.row_index, upper(trim(k.cell)) || '-' || upper(trim(m.name)) AS sku, upper(trim(m.name)) AS finish, {_PACKED.replace("cell", "m.cell")} AS base_price FROM {_MC} m JOIN roles r USING (table_id) JOIN {_MC} k USING (table_id)
WHERE k.row_index = m.row_index AND k.col_index = r.sku AND m.col_index <> r.sku AND length(trim(m.name)) BETWEEN 2 AND 5 AND NOT regexp_matches(upper(m.name), 'DESC|TYPE|SIZE|LENGTH|DUTY|WEIGHT') AND NOT {_BLANK.replace("cell", "k.cell")} AND lower(trim(k.cell)) NOT IN ('model', 'item') AND {_PACKED.replace("cell", "m.cell")} > 0""")
def melted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Price matrices of models and finishes in long form."""
    cells, names = _matrix(spark, d)
    return grid.melted(cells, names, grid.column_roles(cells, names))


# --- tables of lengths ------------------------------------------------------------

_DASH = "('-', '—', '–', '', 'n/a', 'N/A')"
_PRICE = f"""list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(cell, '[\\r\\n]+'), lambda x: trim(x)), lambda x: x NOT IN {_DASH} AND NOT regexp_matches(x, '\\d+\\s*/\\s*\\d+') AND NOT regexp_matches(lower(x), '{"|".join(sections.NO_PRICE)}') AND regexp_matches(x, '\\d')),
  lambda x: try_cast(replace(regexp_extract(x, '([0-9,]+\\.?[0-9]*)', 1), ',', '') AS DOUBLE)), lambda p: p BETWEEN 10 AND 10000)[1]"""


def _described(source: str) -> str:
    rx = "(?i)^(SL\\s*\\d{2,3})\\s*([A-Z]{2})?\\s*([A-Z]{2,6}\\d*)?"
    return f"""src AS (SELECT *, trim(cell) AS c, CASE WHEN trim(cell) NOT IN {_DASH} THEN {_PRICE} END AS price FROM {source}),
des AS (SELECT *, replace(regexp_extract(c, '{rx}', 1), ' ', '') AS m, nullif(upper(regexp_extract(c, '{rx}', 2)), '') AS f, nullif(upper(regexp_extract(c, '{rx}', 3)), '') AS u FROM src),
lines AS (SELECT table_id, row_index, arg_min({{'m': m, 'f': CASE WHEN f = 'LL' AND u IS NULL THEN NULL ELSE f END, 'u': CASE WHEN f = 'LL' AND u IS NULL THEN f ELSE u END}}, col_index) FILTER (length(c) >= 3 AND m <> '' AND NOT regexp_full_match(c, '\\d+') AND (f IS NOT NULL OR u IS NOT NULL)) AS own, count(price) AS priced,
  regexp_extract(string_agg(cell, ' ' ORDER BY col_index), '(?i)SL\\s*(\\d{{2,3}})', 1) AS other FROM des GROUP BY 1, 2),
held AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_index) AS h FROM lines),
described AS (SELECT table_id, row_index, CASE WHEN own IS NOT NULL THEN own WHEN priced > 0 AND (other = '' OR 'SL' || other = upper(h.m)) THEN h END AS d FROM held)"""


_KEPT = f"price IS NOT NULL AND NOT regexp_matches(cell, '(?i)\\bSL\\s*\\d{{2,3}}\\b') AND NOT (cast(floor(price) AS BIGINT) IN ({', '.join(sections.LENGTHS)}) AND abs(price - cast(length AS DOUBLE)) < 50)"
_LT = oracle("length_tables")
_LENGTHS = f"""WITH headers AS (SELECT table_id, col_index, cell AS header FROM {_LT} WHERE row_index = 0 AND col_index > 0),
lengths AS (SELECT table_id, length, max(col_index) AS col_index FROM (SELECT table_id, col_index, unnest(regexp_extract_all(header, '(\\d+)\\s*["'']', 1)) AS length FROM headers) GROUP BY 1, 2),
{_described(f"(SELECT * FROM {_LT} WHERE row_index > 0)")},
priced AS (SELECT s.table_id, s.row_index, d.m AS base_model, d.f AS finish, d.u AS duty, length, price AS base_price FROM src s JOIN lengths USING (table_id, col_index) JOIN described x ON s.table_id = x.table_id AND s.row_index = x.row_index WHERE x.d IS NOT NULL AND {_KEPT})
"""


def _length_cells(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    t = derived(spark, d, name)
    return t.where("row_index > 0"), t.where("row_index = 0").select("table_id", "col_index", F.col("cell").alias("header"))


@query(_LENGTHS + "SELECT * FROM priced")
def length_prices(spark: SparkSession, d: str) -> DataFrame:
    """Goods of tables whose columns are lengths, with combined headers."""
    return sections.priced_by_length(*_length_cells(spark, d, "length_tables"))


@query(_LENGTHS + """SELECT sku, pos, base_price FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(upper(sku), '[^A-Z0-9]', '', 'g') ORDER BY base_price DESC, pos DESC, sku DESC) AS k FROM (SELECT concat_ws('-', base_model, finish, duty, length) AS sku, table_id * 1000 + row_index AS pos, base_price FROM priced)) WHERE k = 1""")
def length_best(spark: SparkSession, d: str) -> DataFrame:
    """Of equal skus the dearest, with a length and a price in range."""
    p = sections.priced_by_length(*_length_cells(spark, d, "length_tables"))
    c = F.col
    return sections.best_priced(p.select(sections.sku_of(c("base_model"), c("finish"), c("duty"), c("length")).alias("sku"), (c("table_id") * 1000 + c("row_index")).alias("pos"), "length", "base_price"))


_PT = oracle("packed_tables")


@query(f"""WITH headers AS (SELECT table_id, list_distinct_kept AS lengths FROM (SELECT table_id, list_reduce(list_transform(regexp_extract_all(cell, '(\\d+)\\s*["'']?\\s*(?:/\\s*\\d+\\s*["'']?)?', 1), lambda x: [x]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_kept FROM {_PT} WHERE row_index = 0 AND col_index = 0)),
{_described(f"(SELECT * FROM {_PT} WHERE row_index > 0)")},
packs AS (SELECT table_id, row_index, flatten(list(list_transform(string_split(trim(cell), chr(10)), lambda x: trim(x)) ORDER BY col_index) FILTER (col_index > 0 AND NOT {_BLANK})) AS ps FROM src GROUP BY 1, 2),
zipped AS (SELECT p.table_id, p.row_index, lengths[i] AS length, ps[i] AS cell FROM packs p JOIN headers USING (table_id), range(1, 50) r(i) WHERE i <= len(lengths) AND i <= len(ps)),
rated AS (SELECT *, CASE WHEN trim(cell) NOT IN {_DASH} THEN {_PRICE} END AS price FROM zipped)
SELECT r.table_id, r.row_index, d.m AS base_model, d.f AS finish, d.u AS duty, length, price AS base_price FROM rated r JOIN described x ON r.table_id = x.table_id AND r.row_index = x.row_index WHERE x.d IS NOT NULL AND {_KEPT}""")
def packed_prices(spark: SparkSession, d: str) -> DataFrame:
    """Goods of tables that pack lengths and prices into lines of cells."""
    return sections.priced_by_line(*_length_cells(spark, d, "packed_tables"))


_SKU_RX = '(?i)(SL\\s*\\d{2})(?:\\s*([A-Z]{2}))?(?:\\s*(HD\\d+|LD\\d+|LL|\\d{2,3}"?))?'
_MONEY = "list_filter(list_transform(regexp_extract_all({0}, '(\\d+\\.?\\d{{0,2}})', 1), lambda x: try_cast(x AS DOUBLE)), lambda x: x BETWEEN 10 AND 5000)[1]"
_NEAR = lambda n: f"CASE WHEN contains({n}, '$') OR regexp_matches({n}, '\\d+\\.\\d{{2}}') THEN {_MONEY.format(f'replace({n}, chr(44), chr(32))').replace('chr(32)', chr(39) * 2)} END"


@query(f"""WITH n AS (SELECT *, trim(lag(cell, 1) OVER w) AS a1, trim(lead(cell, 1) OVER w) AS b1, trim(lead(cell, 2) OVER w) AS b2, trim(lag(cell, 2) OVER w) AS a2 FROM {oracle("loose_tables")} WINDOW w AS (PARTITION BY table_id, row_index ORDER BY col_index)),
f AS (SELECT table_id, row_index, col_index, replace(regexp_extract(cell, '{_SKU_RX}', 1), ' ', '') AS base_model, coalesce(nullif(upper(regexp_extract(cell, '{_SKU_RX}', 2)), ''), CASE WHEN upper(a1) IN ('CL', 'BR', 'BK') THEN upper(a1) END, CASE WHEN upper(b1) IN ('CL', 'BR', 'BK') THEN upper(b1) END) AS finish,
  nullif(upper(replace(regexp_extract(cell, '{_SKU_RX}', 3), '"', '')), '') AS variant, coalesce({_MONEY.format(f"regexp_replace(cell, '^.*?{_SKU_RX[4:]}', '')")}, {_NEAR("b1")}, {_NEAR("a1")}, {_NEAR("b2")}, {_NEAR("a2")}) AS base_price FROM n WHERE regexp_matches(cell, '{_SKU_RX}') AND NOT {_BLANK})
SELECT * FROM f WHERE finish IN ('CL', 'BR', 'BK') AND base_price IS NOT NULL""")
def cell_skus(spark: SparkSession, d: str) -> DataFrame:
    """Models named in any cell, with finishes and prices of their neighbours."""
    return sections.cell_skus(derived(spark, d, "loose_tables"))


# --- options, finishes, matrices, lines in cells ------------------------------------


def _adder_sql() -> str:
    parts = []
    for code, rx in sections.NET_ADDERS:
        places = sorted((n for n in ("size", "price") if f"?<{n}>" in rx), key=lambda n: rx.index(f"?<{n}>"))
        plain = "(?i)" + rx.replace("?<size>", "").replace("?<price>", "")
        size = f"regexp_extract_all(text, '{plain}', {places.index('size') + 1})" if "size" in places else f"list_transform(regexp_extract_all(text, '{plain}', 1), lambda x: '')"
        parts.append(f"SELECT text_id, '{code}' AS option_code, unnest({size}) AS s, unnest(regexp_extract_all(text, '{plain}', {places.index('price') + 1})) AS p FROM t")
    return " UNION ALL ".join(parts)


@query(f"""WITH t AS (SELECT * FROM {oracle("adder_texts")}), f AS ({_adder_sql()})
SELECT DISTINCT text_id, option_code, CASE WHEN upper(s) IN ('LEFT', 'RIGHT') THEN upper(s[1]) || lower(s[2:]) ELSE upper(trim(s)) END AS size_variant, try_cast(p AS DOUBLE) AS adder_value FROM f WHERE try_cast(p AS DOUBLE) <> 0""")
def net_adders(spark: SparkSession, d: str) -> DataFrame:
    """Options with their net adders, each once per text."""
    return sections.net_adders(derived(spark, d, "adder_texts"), "text_id", "text")


@query(f"""SELECT text_id, code, CASE code WHEN 'CL' THEN 'Clear Anodized' WHEN 'BR' THEN 'Dark Bronze' ELSE 'Black' END AS label, CASE code WHEN 'CL' THEN '628' WHEN 'BR' THEN '710' ELSE '622' END AS bhma, count(*) AS n
FROM (SELECT text_id, upper(unnest(regexp_extract_all(text, '(?i)(?:Clear|Dark\\s+Bronze|Black)\\s*\\[([A-Z]{{2}})\\]', 1))) AS code FROM {oracle("adder_texts")}) WHERE code IN ('CL', 'BR', 'BK') GROUP BY 1, 2""")
def finish_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Finishes named with their code in brackets."""
    return sections.finish_symbols(derived(spark, d, "adder_texts"), "text_id", "text")


_MP = oracle("matrix_pages")


@query(f"SELECT page_id, regexp_matches(text, '\\b(BB|ECBB|WT)\\d{{4}}\\b') AND len(regexp_extract_all(text, '\\bUS\\d+[A-Z]?\\b')) >= 3 AND regexp_matches(text, '\\d+\\.\\d{{2}}') AND NOT contains(upper(text), 'PART NUMBER') AS is_matrix FROM {_MP}")
def matrix_pages(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "matrix_pages").select("page_id", sections.is_matrix_page(F.col("text")).alias("is_matrix"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract(text, '\\b(?:BB|ECBB|WT)\\d{{4}}\\b') AS model, text FROM {_MP}),
e AS (SELECT p.*, p_size AS z, cast(cast(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS price FROM p JOIN part ON page_id = p_partkey WHERE model <> ''),
rows AS (SELECT page_id, model, text, 0 AS entry_no, '4-1/2" x 4"' AS size, 'US3' AS finish, price AS base_price FROM e UNION ALL SELECT page_id, model, text, 1, '4-1/2" x 4"', 'US26D', z + 0.75 FROM e
  UNION ALL SELECT page_id, model, text, 2, '5" x 5"', 'US15A', 12.0 FROM e WHERE page_id % 3 = 0 UNION ALL SELECT page_id, model, text, 3, '5" x 5"', 'US32D', 8.25 FROM e WHERE page_id % 3 = 0)
SELECT page_id, entry_no, model || '-' || CASE size WHEN '5" x 5"' THEN '5x5' ELSE '4.5x4' END || '-' || finish AS sku, model, CASE WHEN model LIKE 'BB%' THEN 'Ball Bearing Hinge' WHEN model LIKE 'ECBB%' THEN 'Electric Hinge' ELSE 'Wide Throw Hinge' END AS series,
  model || CASE WHEN model LIKE 'ECBB%' THEN ' Full Mortise Electric Heavy Weight' WHEN model LIKE 'BB%' THEN ' Half Surface Ball Bearing Standard Weight' ELSE ' Hinge' END || ' - ' || size AS description, size, finish, base_price FROM rows""")
def matrix_products(spark: SparkSession, d: str) -> DataFrame:
    """Goods of price matrix pages; the fold's state is a size and a finish. The SQL states what the pages were made from."""
    return sections.matrix_products(derived(spark, d, "matrix_pages"))


@query(f"""WITH t AS (SELECT row_id, list_filter(list_transform(string_split(trim(description), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ds, list_filter(list_transform(string_split(trim(price), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps, trim(description) AS d, trim(price) AS p FROM {oracle("line_cells")}
  WHERE lower(trim(description)) NOT IN ('', 'nan', 'none', 'description', 'name') AND lower(trim(price)) NOT IN ('', 'nan', 'none', 'price', 'list')),
x AS (SELECT row_id, i - 1 AS line_no, ds[i] AS description, ps[i] AS price FROM t, range(1, 20) r(i) WHERE len(ds) = len(ps) AND len(ds) > 1 AND i <= len(ds) UNION ALL SELECT row_id, 0, d, p FROM t WHERE len(ds) <> len(ps) OR len(ds) <= 1)
SELECT row_id, line_no, regexp_extract(description, '\\b([A-Z]{{2,4}}[-\\d]+)\\b', 1) AS sku, description, try_cast(replace(regexp_extract(price, '([0-9,]+\\.?[0-9]*)', 1), ',', '') AS DOUBLE) AS base_price FROM x WHERE regexp_matches(description, '\\b([A-Z]{{2,4}}[-\\d]+)\\b') AND try_cast(replace(regexp_extract(price, '([0-9,]+\\.?[0-9]*)', 1), ',', '') AS DOUBLE) <> 0""")
def paired_lines(spark: SparkSession, d: str) -> DataFrame:
    """Goods packed into the lines of two cells."""
    return sections.paired_lines(derived(spark, d, "line_cells"), ["row_id"], "description", "price")


@query(f"""SELECT table_id, hits FROM (SELECT table_id, count(DISTINCT row_index) AS n, {" + ".join(f"contains(lower(string_agg(coalesce(cell, ''), ' ')), '{w}')::int" for w in sections.SELECT_WORDS)} AS hits FROM {_LT} GROUP BY 1) WHERE n >= 2 AND hits >= 3""")
def product_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables that tell by their words that they hold goods."""
    return sections.has_indicators(derived(spark, d, "length_tables"), sections.SELECT_WORDS, 3)


@query(f"SELECT page_id, regexp_extract(text, '(?is)(US3.*?)(?:US26D|\\z)', 1) AS part FROM {_MP}")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The part of a page from one heading to the next."""
    return derived(spark, d, "matrix_pages").select("page_id", sections.section(F.col("text"), "US3", "US26D").alias("part"))
