"""Queries on two editions of a book: matches, changes, options, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.operators import diff
from pricewright.plans.inputs import derived, oracle
from pricewright.runtime import table


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return derived(spark, d, "old_edition"), derived(spark, d, "new_edition")


def edition_keys(spark: SparkSession, d: str) -> DataFrame:
    return diff.keyed(derived(spark, d, "new_edition")).select("pos", "match_key", "block", "search")


def edition_exact(spark: SparkSession, d: str) -> DataFrame:
    o, n = _both(spark, d)
    return diff.exact_matches(diff.keyed(o), diff.keyed(n)).select(F.col("o.pos").alias("old_pos"), F.col("n.pos").alias("new_pos"), F.col("o.match_key").alias("match_key"))


def edition_residuals(spark: SparkSession, d: str) -> DataFrame:
    o, n = _both(spark, d)
    a, b = diff.residuals(diff.keyed(o), diff.keyed(n))
    return a.select(F.lit("old").alias("side"), "pos").unionByName(b.select(F.lit("new").alias("side"), "pos"))


def edition_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    o, n = _both(spark, d)
    a, b = diff.residuals(diff.keyed(o), diff.keyed(n))
    return diff.fuzzy_pairs(a, b).select(F.col("o.pos").alias("old_pos"), F.col("n.pos").alias("new_pos"), "rank", F.round("score", 6).alias("score"))


def edition_matches(spark: SparkSession, d: str) -> DataFrame:
    o, n = _both(spark, d)
    m = diff.matches(o, n)
    return m.select(F.col("o.pos").alias("old_pos"), F.col("n.pos").alias("new_pos"), "method", F.round("confidence", 6).alias("confidence"), diff.confidence_level(F.col("confidence")).alias("level"))


def edition_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between exact matches only, with added and removed rows."""
    o, n = _both(spark, d)
    return diff.item_changes(diff.matches(o, n, fuzzy=False)).drop("confidence")


def edition_changes_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """All changes, renamed rows included."""
    o, n = _both(spark, d)
    c = diff.item_changes(diff.matches(o, n))
    return c.withColumns({"confidence": F.round("confidence", 6), "told": diff.percent_text(F.col("percent"))})


def edition_summary(spark: SparkSession, d: str) -> DataFrame:
    o, n = _both(spark, d)
    return diff.summary(diff.item_changes(diff.matches(o, n)))


def edition_match_summary(spark: SparkSession, d: str) -> DataFrame:
    """Matches by method and level."""
    return diff.match_summary(diff.matches(*_both(spark, d)))


def edition_review(spark: SparkSession, d: str) -> DataFrame:
    """Changes by confidence bucket and kind, prices up and down."""
    o, n = _both(spark, d)
    c = diff.item_changes(diff.matches(o, n))
    return c.groupBy("change", diff.confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"), F.count_if(F.col("percent") > 0).alias("up"), F.round(F.sum("percent"), 2).alias("sum_percent"))


def _by_sku(spark: SparkSession, d: str) -> DataFrame:
    o, n = (derived(spark, d, x) for x in ("old_skus", "new_skus"))
    return diff.sku_changes(o, n, block="manufacturer")


def edition_by_sku(spark: SparkSession, d: str) -> DataFrame:
    """The comparison by sku with its two fuzzy passes inside a manufacturer's book."""
    return _by_sku(spark, d).withColumn("percent", F.round("percent", 4))


def edition_by_sku_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.sku_summary(_by_sku(spark, d))


def item_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The first of several price columns that reads as a number."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    p = p.select("p_partkey", F.when(k % 4 == 1, None).otherwise(F.col("p_retailprice").cast("string")).alias("base_price"), F.when(k % 8 == 1, F.lit("call")).otherwise("12.50").alias("price"), F.when(k % 16 != 9, F.col("p_size").cast("string")).alias("list_price"))
    return p.select("p_partkey", diff.first_number(diff.PRICES, p.columns).alias("amount"))


def book_items(spark: SparkSession, d: str) -> DataFrame:
    """Items out of books that keep them under different names, some wrapped."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    each = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    g = p.groupBy("p_brand").agg(each.alias("i"))
    odd = F.substring("p_brand", -1, 1).cast("int") % 2 == 1
    books = g.select(F.when(odd, F.col("i")).alias("products"), F.when(~odd, F.transform("i", lambda x: F.struct(x.alias("value"), F.lit(0.9).alias("confidence")))).alias("items"))
    return diff.items_of(books)


def option_changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.keyed_changes(derived(spark, d, "old_options"), derived(spark, d, "new_options"), "option_code", "amount")


def rule_changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.keyed_changes(derived(spark, d, "old_rules"), derived(spark, d, "new_rules"), "signature").select("signature", "change")


QUERIES = {f.__name__: f for f in (edition_keys, edition_exact, edition_residuals, edition_fuzzy, edition_matches, edition_changes, edition_changes_fuzzy, edition_summary, edition_match_summary, edition_review, edition_by_sku, edition_by_sku_summary, item_amounts, book_items, option_changes, rule_changes)}

_KEYED = """SELECT *, manufacturer || '#' || family || '#' || regexp_replace(upper(model), '[\\s\\-_]', '', 'g') || '#' || size || '#' || finish AS match_key, manufacturer || '#' || family AS block,
  upper(concat_ws(' ', model, sku, description, family, size, finish)) AS search FROM """
_WITH = f"WITH RECURSIVE o AS ({_KEYED}{oracle('old_edition')}), n AS ({_KEYED}{oracle('new_edition')}),\n"
_WITH += """exact AS (SELECT o.pos AS op, n.pos AS np, o.match_key, o.base_price AS p0, n.base_price AS p1, o.description AS d0, n.description AS d1 FROM o JOIN (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY pos DESC) = 1) n USING (match_key)),
ro AS (SELECT * FROM o WHERE match_key NOT IN (SELECT match_key FROM n)), rn AS (SELECT * FROM n WHERE match_key NOT IN (SELECT match_key FROM o)),
"""
_CHANGES = """changes AS (
  SELECT match_key, 'price_changed' AS change, cast(round(p0, 4) AS VARCHAR) AS old_value, cast(round(p1, 4) AS VARCHAR) AS new_value, CASE WHEN p0 > 0 THEN round((p1 - p0) / p0 * 100, 4) END AS percent FROM exact WHERE p0 <> p1
  UNION ALL SELECT match_key, 'description_changed', trim(d0), trim(d1), NULL FROM exact WHERE trim(d0) <> trim(d1) AND trim(d0) <> '' AND trim(d1) <> ''
  UNION ALL SELECT match_key, 'removed', sku, NULL, NULL FROM ro UNION ALL SELECT match_key, 'added', NULL, sku, NULL FROM rn)
"""
# The table of the longest common subsequence, a row per step of the recursion.
def _lcs(name: str, pairs: str) -> str:
    """A table of (op, np, score) for pairs (op, np, a, b) of texts split into characters."""
    return f"""{name}_t AS (
  SELECT op, np, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0) AS row FROM {pairs}
  UNION ALL SELECT op, np, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: coalesce(list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k + 1], row[k] + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END))), 0)) FROM {name}_t WHERE i < len(a)),
{name} AS (SELECT op, np, CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE 200.0 * row[len(b) + 1] / (len(a) + len(b)) END AS score FROM {name}_t WHERE i = len(a))"""


_FUZZY = f"""pairs AS (SELECT ro.pos AS op, rn.pos AS np, string_split(ro.search, '') AS a, string_split(rn.search, '') AS b FROM ro JOIN rn USING (block)
  WHERE 200.0 * least(length(ro.search), length(rn.search)) / (length(ro.search) + length(rn.search)) >= 70),
{_lcs("scored", "pairs")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY score DESC, np) AS rank FROM scored),
cands AS (SELECT r.*, row_number() OVER (ORDER BY r.op, rank) AS i FROM ranked r JOIN ro ON r.op = ro.pos JOIN rn ON r.np = rn.pos
  WHERE rank <= 3 AND score >= 70 AND len(list_intersect(list_distinct(string_split(regexp_replace(upper(ro.model), '[\\s\\-_]', '', 'g'), '')), list_distinct(string_split(regexp_replace(upper(rn.model), '[\\s\\-_]', '', 'g'), ''))))
    >= 0.2 * least(length(regexp_replace(ro.model, '[\\s\\-_]', '', 'g')), length(regexp_replace(rn.model, '[\\s\\-_]', '', 'g'))))
"""
# One old row after the other takes its best candidate that is free.
_ASSIGNED = _FUZZY + """, greedy AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS os, []::BIGINT[] AS ns
  UNION ALL SELECT c.i, CASE WHEN free THEN list_append(os, c.op) ELSE os END, CASE WHEN free THEN list_append(ns, c.np) ELSE ns END
  FROM (SELECT c.*, os, ns, NOT list_contains(os, c.op) AND NOT list_contains(ns, c.np) AS free FROM greedy g JOIN cands c ON c.i = g.i + 1) c),
fuzzy AS (SELECT f.op, f.np, score FROM (SELECT unnest(os) AS op, unnest(ns) AS np FROM greedy ORDER BY i DESC LIMIT (SELECT count(*) FROM (SELECT unnest(os) FROM (SELECT os FROM greedy ORDER BY i DESC LIMIT 1)))) f JOIN scored s ON f.op = s.op AND f.np = s.np),
matches AS (SELECT op, np, 'exact' AS method, 1.0::DOUBLE AS confidence FROM exact UNION ALL SELECT op, np, 'fuzzy', least(score / 100, 0.95) FROM fuzzy
  UNION ALL SELECT pos, NULL, 'removed', 1.0 FROM ro WHERE pos NOT IN (SELECT op FROM fuzzy) UNION ALL SELECT NULL, pos, 'added', 1.0 FROM rn WHERE pos NOT IN (SELECT np FROM fuzzy)),
sides AS (SELECT m.*, coalesce(o.match_key, n.match_key) AS match_key, o.sku AS s0, n.sku AS s1, o.base_price AS p0, n.base_price AS p1, trim(o.description) AS d0, trim(n.description) AS d1, trim(o.model) AS m0, trim(n.model) AS m1 FROM matches m LEFT JOIN o ON m.op = o.pos LEFT JOIN n ON m.np = n.pos),
all_changes AS (
  SELECT match_key, 'price_changed' AS change, cast(round(p0, 4) AS VARCHAR) AS old_value, cast(round(p1, 4) AS VARCHAR) AS new_value, CASE WHEN p0 > 0 THEN round((p1 - p0) / p0 * 100, 4) END AS percent, confidence FROM sides WHERE method IN ('exact', 'fuzzy') AND p0 <> p1
  UNION ALL SELECT match_key, 'description_changed', d0, d1, NULL, confidence FROM sides WHERE method IN ('exact', 'fuzzy') AND d0 <> d1 AND d0 <> '' AND d1 <> ''
  UNION ALL SELECT match_key, 'renamed', m0, m1, NULL, confidence FROM sides WHERE method = 'fuzzy' AND m0 <> m1
  UNION ALL SELECT match_key, 'removed', s0, NULL, NULL, confidence FROM sides WHERE method = 'removed' UNION ALL SELECT match_key, 'added', NULL, s1, NULL, confidence FROM sides WHERE method = 'added')
"""
_LEVEL = "CASE WHEN confidence >= 0.98 THEN 'exact' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END"
_SKUS = f"""WITH RECURSIVE o AS (SELECT * FROM {oracle("old_skus")}), n AS (SELECT * FROM {oracle("new_skus")}),
gone AS (SELECT * FROM o WHERE sku NOT IN (SELECT sku FROM n)), come AS (SELECT * FROM n WHERE sku NOT IN (SELECT sku FROM o)),
both_new AS (SELECT g.pos AS op, c.pos AS np, g.sku AS s0, c.sku AS s1, g.description AS d0, c.description AS d1, g.model AS m0, c.model AS m1 FROM gone g JOIN come c USING (manufacturer)),
ps AS (SELECT op, np, string_split(s0, '') AS a, string_split(s1, '') AS b FROM both_new), pd AS (SELECT op, np, string_split(d0, '') AS a, string_split(d1, '') AS b FROM both_new), pm AS (SELECT op, np, string_split(m0, '') AS a, string_split(m1, '') AS b FROM both_new),
{_lcs("ls", "ps")}, {_lcs("ld", "pd")}, {_lcs("lm", "pm")},
rated AS (SELECT s0, s1, 0.5 * ls.score + 0.3 * ld.score + 0.2 * lm.score AS one, 0.5 * ls.score + 0.5 * ld.score AS two FROM both_new JOIN ls USING (op, np) JOIN ld USING (op, np) JOIN lm USING (op, np)),
first_pass AS (SELECT s0, s1, one AS score FROM rated WHERE one > 70 QUALIFY row_number() OVER (PARTITION BY s0 ORDER BY one DESC, s1) = 1),
second_pass AS (SELECT s0, s1, two AS score FROM rated WHERE two > 70 QUALIFY row_number() OVER (PARTITION BY s0 ORDER BY two DESC, s1) = 1),
changes AS (
  SELECT s1 AS sku, 'fuzzy_match' AS change, s0 AS old_value, s1 AS new_value, score AS percent FROM (SELECT * FROM first_pass UNION ALL SELECT * FROM second_pass)
  UNION ALL SELECT sku, 'retired_product', sku, NULL, NULL FROM gone WHERE sku NOT IN (SELECT s0 FROM first_pass) UNION ALL SELECT sku, 'new_product', NULL, sku, NULL FROM come WHERE sku NOT IN (SELECT s1 FROM first_pass)
  UNION ALL SELECT o.sku, 'price_change', cast(o.base_price AS VARCHAR), cast(n.base_price AS VARCHAR), (n.base_price - o.base_price) / o.base_price * 100 FROM o JOIN n USING (sku) WHERE o.base_price <> n.base_price AND o.base_price <> 0 AND n.base_price <> 0
  UNION ALL SELECT o.sku, 'description_change', o.description, n.description, NULL FROM o JOIN n USING (sku) WHERE o.description IS DISTINCT FROM n.description
  UNION ALL SELECT o.sku, 'status_change', cast(o.is_active AS VARCHAR), cast(n.is_active AS VARCHAR), NULL FROM o JOIN n USING (sku) WHERE o.is_active IS DISTINCT FROM n.is_active)
"""
ORACLE = {
    "edition_keys": _WITH.rstrip(",\n") + " SELECT pos, match_key, block, search FROM n",
    "edition_exact": _WITH.rstrip(",\n") + " SELECT op AS old_pos, np AS new_pos, match_key FROM exact",
    "edition_residuals": _WITH.rstrip(",\n") + " SELECT 'old' AS side, pos FROM ro UNION ALL SELECT 'new', pos FROM rn",
    "edition_fuzzy": _WITH + _FUZZY + "SELECT op AS old_pos, np AS new_pos, rank, round(score, 6) AS score FROM cands",
    "edition_matches": _WITH + _ASSIGNED + f"SELECT op AS old_pos, np AS new_pos, method, round(confidence, 6) AS confidence, {_LEVEL} AS level FROM matches",
    "edition_match_summary": _WITH + _ASSIGNED + f"""SELECT count(*) AS matches, count_if(method = 'exact') AS exact, count_if(method = 'fuzzy') AS fuzzy, count_if(method = 'added') AS added, count_if(method = 'removed') AS removed,
  {", ".join(f"count_if({_LEVEL} = '{x}') AS {x}_level" for x in ("exact", "high", "medium", "low", "very_low"))}, round(avg(confidence), 6) AS mean_confidence FROM matches""",
    "edition_changes_fuzzy": _WITH + _ASSIGNED + "SELECT match_key, change, old_value, new_value, percent, round(confidence, 6) AS confidence, CASE WHEN percent IS NOT NULL THEN printf('%+.1f', percent) || '%' END AS told FROM all_changes",
    "edition_changes": _WITH + _CHANGES + "SELECT match_key, change, old_value, new_value, percent FROM changes",
    "edition_summary": _WITH + _ASSIGNED + """SELECT count(*) AS changes, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed, count_if(change = 'price_changed') AS price_changed, count_if(change = 'description_changed') AS description_changed, count_if(change = 'renamed') AS renamed,
  count_if(percent > 0) AS increases, count_if(percent < 0) AS decreases, round(avg(percent), 4) AS avg_percent, round(min(percent), 4) AS min_percent, round(max(percent), 4) AS max_percent FROM all_changes""",
    "edition_review": _WITH + _ASSIGNED + f"SELECT change, {_LEVEL} AS level, count(*) AS n, count(*) FILTER (percent > 0) AS up, round(sum(percent), 2) AS sum_percent FROM all_changes GROUP BY 1, 2",
    "edition_by_sku": _SKUS + "SELECT sku, change, old_value, new_value, round(percent, 4) AS percent FROM changes",
    "edition_by_sku_summary": _SKUS + """SELECT count(*) AS total, count_if(change = 'new_product') AS new_product, count_if(change = 'retired_product') AS retired_product, count_if(change = 'price_change') AS price_change, count_if(change = 'description_change') AS description_change, count_if(change = 'status_change') AS status_change, count_if(change = 'fuzzy_match') AS fuzzy_match,
  round(avg(percent) FILTER (change = 'price_change' AND percent <> 0), 4) AS avg_percent, round(max(percent) FILTER (change = 'price_change' AND percent <> 0), 4) AS max_increase, round(min(percent) FILTER (change = 'price_change' AND percent <> 0), 4) AS max_decrease FROM changes""",
    "item_amounts": "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 1 THEN p_retailprice END, CASE WHEN p_partkey % 8 <> 1 THEN 12.5 END, CASE WHEN p_partkey % 16 <> 9 THEN p_size END, 0) AS amount FROM part",
    "book_items": "SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey, p_name FROM part",
    "option_changes": f"""SELECT coalesce(o.option_code, n.option_code) AS option_code, CASE WHEN o.pos IS NULL THEN 'added' WHEN n.pos IS NULL THEN 'removed' ELSE 'changed' END AS change, o.amount AS old_value, n.amount AS new_value
FROM {oracle("old_options")} o FULL JOIN {oracle("new_options")} n ON o.option_code = n.option_code WHERE o.pos IS NULL OR n.pos IS NULL OR o.amount IS DISTINCT FROM n.amount""",
    "rule_changes": f"""SELECT coalesce(o.signature, n.signature) AS signature, CASE WHEN o.pos IS NULL THEN 'added' ELSE 'removed' END AS change FROM {oracle("old_rules")} o FULL JOIN {oracle("new_rules")} n ON o.signature = n.signature WHERE o.pos IS NULL OR n.pos IS NULL""",
}
