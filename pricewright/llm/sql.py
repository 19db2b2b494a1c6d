"""SQL of the llm queries that SQL can express over whole tables."""

_GROUPS = """
WITH rows AS (
  SELECT export_id, nullif(translate(upper(regexp_replace(sku, '[^A-Za-z0-9]', '', 'g')), 'OILZSBG', '0112586'), '') AS grp,
    round(CASE WHEN coalesce(confidence, 0) > 1 THEN confidence / 100 ELSE coalesce(confidence, 0) END, 9) AS conf,
    (CASE WHEN trim(description, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END) + (CASE WHEN base_price IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN trim(finish, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END)
      + (CASE WHEN trim(finish_description, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(options, E' \\t\\n\\r') <> '' THEN 1 ELSE 0 END) AS filled
  FROM sample_products_export),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, filled DESC, export_id) AS k FROM rows WHERE grp IS NOT NULL)
"""

ORACLE = {
    "p5_found": _GROUPS + "SELECT export_id, CASE WHEN k = 1 THEN 'keep' ELSE 'drop' END AS verdict FROM ranked WHERE n > 1",
}
