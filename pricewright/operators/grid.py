"""Tables as long cell grids (table_id, row_index, col_index, cell): merged
cells, headers, column types, unpivoting, stitching, scanned words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.keys import is_blank
from pricewright.functions.normalize import price_packed


def number_of(cell: Column) -> Column:
    """A cell's number, dollar signs and commas aside."""
    return F.regexp_extract(F.regexp_replace(F.trim(cell), r"[$,\s]", ""), r"^-?\d+(?:\.\d+)?$", 0).try_cast("double")


def fill_down(cells: DataFrame) -> DataFrame:
    """Blank cells take the last filled one above in their column."""
    w = Window.partitionBy("table_id", "col_index").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("filled", F.last(F.when(~is_blank(F.col("cell")), F.col("cell")), ignorenulls=True).over(w))


def fill_right(cells: DataFrame, rows: int = 3) -> DataFrame:
    """Blank cells of a table's first rows take the last filled one to their left."""
    w = Window.partitionBy("table_id", "row_index").orderBy("col_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.last(F.when(~is_blank(F.col("cell")), F.col("cell")), ignorenulls=True).over(w)
    return cells.withColumn("filled", F.when(F.col("row_index") < rows, left).otherwise(F.col("cell")))


def merged_regions(cells: DataFrame) -> DataFrame:
    """(table_id, col_index, head_row, last_row): a filled cell and the blanks below it."""
    w = Window.partitionBy("table_id", "col_index").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = cells.withColumn("_b", is_blank(F.col("cell")))
    d = d.withColumn("_g", F.sum((~F.col("_b")).cast("int")).over(w)).where("_g > 0")
    g = d.groupBy("table_id", "col_index", "_g").agg(F.min("row_index").alias("head_row"), F.max("row_index").alias("last_row"), F.count("*").alias("n"))
    return g.where("n > 1").select("table_id", "col_index", "head_row", "last_row")


def column_types(cells: DataFrame, share: float = 0.7, first: int = 10) -> DataFrame:
    """(table_id, col_index, filled, numeric, kind) by a column's first cells that aren't blank."""
    w = Window.partitionBy("table_id", "col_index").orderBy("row_index")
    d = cells.where(~is_blank(F.col("cell"))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    g = d.groupBy("table_id", "col_index").agg(F.count("*").alias("filled"), F.count_if(number_of(F.col("cell")).isNotNull()).alias("numeric"))
    return g.withColumn("kind", F.when(F.col("numeric") > F.col("filled") * share, "number").otherwise("text"))


def typed(cells: DataFrame) -> DataFrame:
    """Cells of number columns with their numbers; what isn't one stays text."""
    kinds = column_types(cells).where("kind = 'number'").select("table_id", "col_index", F.lit(True).alias("_n"))
    return cells.join(kinds, ["table_id", "col_index"], "left").withColumn("number", F.when(F.col("_n"), number_of(F.col("cell")))).drop("_n")


def table_profile(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols, completeness, digit_cells, quality, fingerprint)."""
    blank = is_blank(F.col("cell"))
    sign = F.when(number_of(F.col("cell")).isNotNull(), "N").otherwise("T")
    corner = F.when((F.col("row_index") < 3) & (F.col("col_index") < 3), F.struct("col_index", "row_index", sign.alias("s")))
    g = cells.groupBy("table_id").agg(
        F.count_distinct("row_index").alias("rows"), F.count_distinct("col_index").alias("cols"), F.round(F.avg((~blank).cast("int")), 6).alias("completeness"),
        F.count_if(~blank & F.col("cell").rlike(r"\d")).alias("digit_cells"), F.array_sort(F.collect_list(corner)).alias("corner"),
    )
    mark = F.array_join(F.transform("corner", lambda c: c["s"]), "")
    return g.select("table_id", "rows", "cols", "completeness", "digit_cells", (F.col("cols") * 10 + F.col("digit_cells")).alias("quality"), F.concat_ws("#", F.concat_ws("x", "cols", "rows"), mark).alias("fingerprint"))


def header_row(cells: DataFrame, words: list[str], least: int = 2, first: int = 5) -> DataFrame:
    """(table_id, header_row): the first of a table's first rows that has at
    least so many of the words."""
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "cell"))), lambda c: F.coalesce(c["cell"], F.lit(""))), " "))
    rows = cells.where(F.col("row_index") < first).groupBy("table_id", "row_index").agg(text.alias("t"))
    hits = sum((F.contains("t", F.lit(w)).cast("int") for w in words), F.lit(0))
    return rows.where(hits >= least).groupBy("table_id").agg(F.min("row_index").alias("header_row"))


def unpivot(cells: DataFrame, key_col: int = 0) -> DataFrame:
    """(table_id, row_index, col_index, key, value): each number cell with its
    row's key cell, as the long form of a price matrix."""
    keys = cells.where((F.col("col_index") == key_col) & ~is_blank(F.col("cell"))).select("table_id", "row_index", F.trim("cell").alias("key"))
    values = cells.where(F.col("col_index") != key_col).select("table_id", "row_index", "col_index", number_of(F.col("cell")).alias("value")).where("value is not null")
    return values.join(keys, ["table_id", "row_index"])


def pivot_rows(cells: DataFrame, roles: dict[str, int]) -> DataFrame:
    """(table_id, row_index, *roles): the cells of chosen columns side by side."""
    return cells.groupBy("table_id", "row_index").agg(*(F.max(F.when((F.col("col_index") == i) & ~is_blank(F.col("cell")), F.col("cell"))).alias(n) for n, i in roles.items()))


def neighbours(cells: DataFrame, wanted: Column) -> DataFrame:
    """(table_id, row_index, col_index, cell, found): for each number cell the
    first neighbour that holds, looked for at +1, -1, +2, -2."""
    w = Window.partitionBy("table_id", "row_index").orderBy("col_index")
    ok = F.when(wanted, F.col("cell"))
    d = cells.withColumn("_ok", ok)
    found = F.coalesce(*(F.lead("_ok", k).over(w) if k > 0 else F.lag("_ok", -k).over(w) for k in (1, -1, 2, -2)))
    return d.withColumn("found", found).where(number_of(F.col("cell")).isNotNull()).select("table_id", "row_index", "col_index", "cell", "found")


#: Words of which a header row has one.
HEADER_WORDS = ["model", "description", "price", "series", "size", "finish", "code", "name", "qty", "quantity", "part", "sku", "item"]


def header_runs(cells: DataFrame, first: int = 3) -> DataFrame:
    """(table_id, first_row, last_row): the first run of header rows among a
    table's first rows. A header row has a header word, less than 30 % numbers,
    and at least two numbers more or less than the row below, if there is one."""
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "cell"))), lambda c: F.coalesce(c["cell"], F.lit(""))), " "))
    d = cells.where(F.col("row_index") <= first).groupBy("table_id", "row_index").agg(text.alias("t"), F.count("*").alias("n"), F.count_if(number_of(F.col("cell")).isNotNull()).alias("k"))
    below = F.lead("k").over(Window.partitionBy("table_id").orderBy("row_index"))
    d = d.withColumn("_d", F.coalesce(F.abs(below - F.col("k")) >= 2, F.lit(True))).where(F.col("row_index") < first)
    d = d.where(F.col("t").rlike("|".join(HEADER_WORDS)) & (F.col("k") < F.col("n") * 0.3) & F.col("_d"))
    w = Window.partitionBy("table_id")
    d = d.withColumn("_g", F.col("row_index") - F.row_number().over(w.orderBy("row_index")))
    d = d.withColumn("_a", F.min("_g").over(w)).where("_g = _a")
    return d.groupBy("table_id").agg(F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))


def weld_headers(cells: DataFrame) -> DataFrame:
    """(table_id, col_index, rows, header): the distinct texts of a table's
    header rows, joined per column; col_N where there are none."""
    c = cells.join(header_runs(cells), "table_id").where(F.col("row_index").between(F.col("first_row"), F.col("last_row")))
    found = F.array_sort(F.collect_list(F.when(~is_blank(F.col("cell")), F.struct("row_index", F.trim("cell").alias("t")))))
    header = F.array_join(F.array_distinct(F.transform(found, lambda x: x["t"])), " ")
    g = c.groupBy("table_id", "col_index").agg((F.max("last_row") - F.max("first_row") + 1).alias("rows"), header.alias("header"))
    return g.withColumn("header", F.when(F.col("header") == "", F.concat(F.lit("col_"), F.col("col_index"))).otherwise(F.col("header")))


def fill_merged(cells: DataFrame) -> DataFrame:
    """Merged cells recovered: blanks take the last filled cell above, then those
    still blank in a table's first rows the last filled one to their left."""
    down = fill_down(cells).select("table_id", "row_index", "col_index", F.coalesce("filled", "cell").alias("cell"))
    return fill_right(down)


def unwelded(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table's data and its columns' names: (table_id, row_index, col_index,
    cell) with rows counted anew, and (table_id, col_index, name, header_rows).
    Where two header rows or more run on, they are welded to the names; else all
    rows are data and columns go by their number."""
    heads = header_runs(cells).where("last_row > first_row")
    names = weld_headers(cells).where("rows > 1").select("table_id", "col_index", F.col("header").alias("_h"), F.col("rows").alias("_r"))
    columns = cells.select("table_id", "col_index").distinct().join(names, ["table_id", "col_index"], "left")
    names = columns.select("table_id", "col_index", F.coalesce("_h", F.col("col_index").cast("string")).alias("name"), F.coalesce("_r", F.lit(0)).cast("int").alias("header_rows"))
    start = F.coalesce(F.col("last_row") + 1, F.lit(0))
    data = cells.join(heads.select("table_id", "last_row"), "table_id", "left").where(F.col("row_index") >= start)
    return data.select("table_id", (F.col("row_index") - start).alias("row_index"), "col_index", "cell"), names


def structures(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols, header_rows, data_rows, merged, fingerprint, names,
    patterns, confidence): what a table looks like after its headers are welded
    and its merged cells recovered. A last row of totals is no data row. The
    fingerprint is names (ten letters), shape, and numbers or text in the first
    three rows of the first three columns; patterns say the same of each column.

    Confidence is the mean of completeness (twice, at most 1), of how much of one
    kind the columns are, of the rows kept, and of the columns named, raised for
    welded headers and recovered cells."""
    data, names = unwelded(cells)
    merged = merged_regions(data).groupBy("table_id").agg(F.count("*").alias("merged"))
    d = fill_merged(data).select("table_id", "row_index", "col_index", F.col("filled").alias("cell"))
    blank, number = is_blank(F.col("cell")), number_of(F.col("cell")).isNotNull()
    before = cells.groupBy("table_id").agg(F.count_distinct("row_index").alias("was"))
    last = Window.partitionBy("table_id")
    d = d.withColumn("_last", F.max("row_index").over(last))
    # Columns first: their kind and the sign of their first rows.
    sign = F.array_sort(F.collect_list(F.when(F.col("row_index") < 3, F.struct("row_index", F.when(number, "N").otherwise("T").alias("s")))))
    foot = F.max(F.when((F.col("row_index") == F.col("_last")) & F.lower("cell").rlike("total|subtotal|sum"), 1).otherwise(0))
    c = d.groupBy("table_id", "col_index").agg(
        F.count("*").alias("n"), F.count_if(number).alias("numeric"), F.count_if(~blank).alias("filled"), F.array_join(F.transform(sign, lambda x: x["s"]), "").alias("signs"), foot.alias("foot"),
        F.count_if((F.col("row_index") < 3) & number).alias("n3"), F.count_if((F.col("row_index") < 3) & ~blank).alias("f3"),
    )
    c = c.join(names, ["table_id", "col_index"])
    share = F.col("numeric") / F.col("n")
    c = c.withColumns({"one_kind": F.when(F.col("n") > 1, F.greatest(share, 1 - share)).otherwise(0.0), "named": (~F.trim("name").isin("", "0", "1", "2", "col_0", "col_1")).cast("int"), "pattern": F.when(F.col("n3") > F.col("f3") * 0.7, "N").otherwise("T")})
    each = F.array_sort(F.collect_list(F.struct("col_index", "name", "signs", "pattern")))
    t = c.groupBy("table_id").agg(
        F.max("n").alias("rows"), F.count("*").alias("cols"), F.max("header_rows").alias("header_rows"), F.max("foot").alias("foot"), F.avg("one_kind").alias("one_kind"), F.avg("named").alias("named"),
        (F.sum("filled") / F.sum("n")).alias("full"), each.alias("each"),
    ).join(before, "table_id").join(merged, "table_id", "left")
    signature = F.concat_ws("#", F.array_join(F.transform("each", lambda x: F.substring(F.lower(x["name"]), 1, 10)), "|"), F.concat_ws("x", "cols", "rows"), F.array_join(F.transform(F.slice("each", 1, 3), lambda x: x["signs"]), ","))
    both = (F.col("cols") >= 2) & (F.col("rows") >= 2)
    total = F.least(F.col("full") * 2, F.lit(1.0)) + F.when(both, F.col("one_kind")).otherwise(0.0) + (1 - F.abs(F.col("rows") - F.col("was")) / F.col("was")) + F.col("named")
    bonus = F.when(F.col("header_rows") > 1, 0.1).otherwise(0.0) + F.when(F.col("merged").isNotNull(), 0.05).otherwise(0.0)
    return t.select(
        "table_id", "rows", "cols", "header_rows", F.when((F.col("rows") > 2) & (F.col("foot") == 1), F.col("rows") - 1).otherwise(F.col("rows")).alias("data_rows"), F.coalesce("merged", F.lit(0)).alias("merged"),
        signature.alias("fingerprint"), F.array_join(F.transform("each", lambda x: x["name"]), "|").alias("names"), F.array_join(F.transform("each", lambda x: x["pattern"]), "").alias("patterns"),
        F.round(F.least(F.lit(1.0), total / F.when(both, 4).otherwise(3) + bonus), 6).alias("confidence"),
    )


def stitch(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, group_id): runs of tables that continue each other, in
    the order of page and table. A table joins the run if it fits the run's
    first table: by the same fingerprint, the same names of columns, or as many
    columns, the same kind of header and the same pattern in seven of ten.

    An ordered fold over a document's tables, as the run's head is state.
    tables: (doc_id, page, table_id, fingerprint, names, patterns, header_rows)."""
    t = tables.select("doc_id", F.struct(F.col("page").cast("int").alias("page"), F.col("table_id").cast("bigint").alias("table_id"), "fingerprint", "names", "patterns", (F.col("header_rows") > 1).alias("multi")).alias("t"))
    g = t.groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    kind = "struct<n:int,head:struct<page:int,table_id:bigint,fingerprint:string,names:string,patterns:string,multi:boolean>,out:array<struct<table_id:bigint,group_id:int>>>"
    first = F.struct(F.lit(-1), F.lit(None), F.array()).cast(kind)

    def step(a: Column, t: Column) -> Column:
        h = a["head"]
        same = F.size(F.filter(F.arrays_zip(F.split(h["patterns"], "").alias("a"), F.split(t["patterns"], "").alias("b")), lambda z: z["a"] == z["b"]))
        alike = (h["multi"] == t["multi"]) & (F.length(h["patterns"]) == F.length(t["patterns"])) & (same >= F.length(h["patterns"]) * 0.7)
        fits = F.coalesce((h["fingerprint"] == t["fingerprint"]) | (h["names"] == t["names"]) | alike, F.lit(False))
        n = F.when(fits, a["n"]).otherwise(a["n"] + 1)
        return F.struct(n.alias("n"), F.when(fits, h).otherwise(t).alias("head"), F.concat(a["out"], F.array(F.struct(t["table_id"].alias("table_id"), n.alias("group_id")))).alias("out"))

    return g.select("doc_id", F.inline(F.aggregate("t", first, step)["out"]))


def stitched_rows(cells: DataFrame, groups: DataFrame, order: DataFrame) -> DataFrame:
    """(doc_id, group_id, row_index, col_index, cell): the rows of stitched
    tables, one table's below the other's, cut to the columns of the first.
    groups: (doc_id, table_id, group_id); order: (table_id, page)."""
    rows = cells.groupBy("table_id").agg((F.max("row_index") + 1).alias("n"), (F.max("col_index") + 1).alias("cols"))
    w = Window.partitionBy("doc_id", "group_id").orderBy("page", "table_id")
    t = groups.join(rows, "table_id").join(order, "table_id")
    t = t.withColumns({"above": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "wide": F.first("cols").over(w)})
    d = cells.join(t, "table_id").where(F.col("col_index") < F.col("wide"))
    return d.select("doc_id", "group_id", (F.col("row_index") + F.col("above")).alias("row_index"), "col_index", "cell")


def has_header(cells: DataFrame) -> DataFrame:
    """(table_id, has_header): whether the first row has more text than numbers."""
    c = cells.where((F.col("row_index") == 0) & (F.trim("cell") != ""))
    n = F.count_if(number_of(F.col("cell")).isNotNull())
    g = c.groupBy("table_id").agg((F.count("*") - n > n).alias("has_header"))
    return cells.select("table_id").distinct().join(g, "table_id", "left").select("table_id", F.coalesce("has_header", F.lit(False)).alias("has_header"))


# Words of rows that are no data, unless they hold a price.
NOISE = ["list prices", "price variance", "effective", "copyright", "catalog", "remove", "august", "page"]


def cleaned(cells: DataFrame) -> DataFrame:
    """Cells with white space and amounts closed up, the first column in
    capitals, without noise rows and rows and columns that are blank throughout."""
    t = F.trim(F.replace(F.regexp_replace("cell", r"\s+", " "), F.lit(" | "), F.lit(" ")))
    t = F.regexp_replace(F.regexp_replace(t, r"\$\s+(\d)", r"\$$1"), r"(?i)(\d+)\s+TO\s+(\d+[A-Z0-9]*)", "$1-$2")
    d = cells.withColumn("cell", F.nullif(F.when(F.col("col_index") == 0, F.upper(t)).otherwise(t), F.lit("")))
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("col_index", "cell")))), lambda c: c["cell"]), " "))
    noise = F.col("t").rlike("|".join(NOISE)) & ~F.col("t").rlike(r"\$?\d+\.\d{2}")
    rows = d.groupBy("table_id", "row_index").agg(text.alias("t")).where((F.col("t") != "") & ~noise).select("table_id", "row_index")
    cols = d.groupBy("table_id", "col_index").agg(F.count("cell").alias("n")).where("n > 0").select("table_id", "col_index")
    return d.join(rows, ["table_id", "row_index"], "left_semi").join(cols, ["table_id", "col_index"], "left_semi").select("table_id", "row_index", "col_index", "cell")


# Words in a column's name that tell its role, in the order of the roles.
ROLES = {
    "sku": ["sku", "model", "item", "part", "cat", "catalog"], "price": ["price", "list", "cost", "retail", "msrp"], "finish": ["finish", "color", "bhma", "coating"],
    "size": ["size", "dimension", "width", "height", "length", '"', "inch", "mm"], "description": ["description", "desc", "name", "title", "type"],
}


def column_features(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(table_id, col_index, named_<role>..., numeric, texts, dollar, cross,
    priced): what a column's name and its first five rows tell."""
    first, c = F.col("row_index") < 5, F.trim("cell")
    filled = first & F.coalesce(c != "", F.lit(False))
    number = c.rlike(r"^\$?\d+[,.\d]*$")
    f = cells.groupBy("table_id", "col_index").agg(
        F.count_if(filled & number).alias("numeric"), F.count_if(filled & ~number & c.rlike("^[A-Za-z]")).alias("texts"), F.count_if(first & F.contains("cell", F.lit("$"))).alias("dollar"),
        F.count_if(first & F.contains(F.lower("cell"), F.lit("x"))).alias("cross"), F.count_if(first & price_packed(F.col("cell")).isNotNull()).alias("priced"),
    )
    name = F.lower(F.trim("name"))
    has = {r: F.coalesce(sum((F.contains(name, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0, F.lit(False)).alias(f"named_{r}") for r, ws in ROLES.items()}
    return f.join(names.select("table_id", "col_index", *has.values()), ["table_id", "col_index"])


def column_roles(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(table_id, sku, price, finish, size, description): the column of each
    role, or null. Columns are taken from the left; the first role that fits and
    isn't taken gets a column. A role held by the first column counts as not
    taken, so that a later column may replace it. Without a sku column the first
    is it, without a price the first of the others with two prices.

    A fold over a table's columns, as which roles are taken is state."""
    f = column_features(cells, names)
    each = F.array_sort(F.collect_list(F.struct("col_index", *(f"named_{r}" for r in ROLES), "numeric", "texts", "dollar", "cross", "priced")))
    none = F.lit(None).cast("int")

    def step(a: Column, x: Column) -> Column:
        free = {r: F.coalesce(a[r], F.lit(0)) == 0 for r in ROLES}
        fits = {
            "sku": x["named_sku"] | ((x["texts"] > x["numeric"]) & (x["col_index"] == 0)), "price": x["named_price"] | (x["dollar"] > 0) | ((x["numeric"] >= 3) & free["sku"]), "finish": x["named_finish"],
            "size": x["named_size"] | (x["cross"] > 0), "description": x["named_description"],
        }
        taken, out = F.lit(False), []
        for r in ROLES:
            mine = ~taken & free[r] & fits[r]
            out.append(F.when(mine, x["col_index"].cast("int")).otherwise(a[r]).alias(r))
            taken = taken | mine
        return F.struct(*out)

    g = f.groupBy("table_id").agg(each.alias("each"))
    g = g.select("table_id", "each", F.aggregate("each", F.struct(*(none.alias(r) for r in ROLES)), step).alias("a"))
    sku = F.when(F.coalesce("a.sku", F.lit(0)) == 0, 0).otherwise(F.col("a.sku"))
    other = F.get(F.filter("each", lambda x: (x["col_index"] != sku) & (x["priced"] >= 2)), F.lit(0))["col_index"].cast("int")
    price = F.when(F.coalesce("a.price", F.lit(0)) == 0, F.coalesce(other, F.col("a.price"))).otherwise(F.col("a.price"))
    return g.select("table_id", sku.alias("sku"), price.alias("price"), "a.finish", "a.size", "a.description")


def melted(cells: DataFrame, names: DataFrame, roles: DataFrame) -> DataFrame:
    """(table_id, row_index, sku, finish, base_price): price matrices in long
    form. A table is one if it has a sku column, three columns, and two or more
    others with names of two to five letters; these are finishes."""
    name = F.upper(F.trim("name"))
    short = F.length(name).between(2, 5) & ~name.isin("DESC", "TYPE", "SIZE")
    n = names.groupBy("table_id").agg(F.count("*").alias("cols"), F.count_if(short & (F.col("col_index") > 0)).alias("short")).where("cols >= 3 and short >= 2")
    told = name.rlike("DESC|TYPE|SIZE|LENGTH|DUTY|WEIGHT")
    finishes = names.where(F.length(name).between(2, 5) & ~told).select("table_id", "col_index", name.alias("finish")).join(n.select("table_id"), "table_id", "left_semi").join(roles.select("table_id", F.col("sku").alias("_s")), "table_id").where("col_index <> _s").drop("_s")
    models = cells.join(roles.select("table_id", F.col("sku").alias("col_index")), ["table_id", "col_index"]).where(~is_blank(F.col("cell")) & ~F.lower(F.trim("cell")).isin("model", "item")).select("table_id", "row_index", F.trim("cell").alias("model"))
    p = cells.join(finishes, ["table_id", "col_index"]).withColumn("base_price", price_packed(F.col("cell"))).where("base_price > 0")
    return p.join(models, ["table_id", "row_index"]).select("table_id", "row_index", F.upper(F.concat_ws("-", "model", "finish")).alias("sku"), "finish", "base_price")


def normal_boxes(words: DataFrame, points: str = "points") -> DataFrame:
    """Words with their box as left, top, right and bottom, from its four corners."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return words.withColumns({"left_": F.array_min(xs), "top_": F.array_min(ys), "right_": F.array_max(xs), "bottom_": F.array_max(ys)})


def column_index(words: DataFrame, starts: DataFrame, slack: int = 20) -> DataFrame:
    """Words with the column they fall in: the last start at or before their left
    edge plus the slack, counted from 0; the first two starts may collapse."""
    s = starts.groupBy("page").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    n = F.size(F.filter("starts", lambda x: x <= F.col("left_") + slack))
    return words.join(s, "page").withColumn("column_", F.greatest(n - 1, F.lit(0))).drop("starts")


def word_lines(words: DataFrame, tolerance: int = 10) -> DataFrame:
    """(page, word_no, line_no): words put to lines; a word belongs to the line
    whose first word is at most so far above it. An ordered fold per page."""
    g = words.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top_", "left_", "word_no"))).alias("w"))
    first = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("int").alias("head"), F.array().cast("array<struct<word_no:bigint,line_no:int>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        same = F.coalesce(w["top_"] - a["head"] <= tolerance, F.lit(False))
        n = F.when(same, a["n"]).otherwise(a["n"] + 1)
        return F.struct(n.alias("n"), F.when(same, a["head"]).otherwise(w["top_"]).alias("head"), F.concat(a["out"], F.array(F.struct(w["word_no"].cast("bigint").alias("word_no"), n.alias("line_no")))).alias("out"))

    return g.select("page", F.inline(F.aggregate("w", first, step)["out"]))


def column_starts(words: DataFrame, gap: int = 30) -> DataFrame:
    """(page, start): where columns begin: distinct left edges that lie at least
    `gap` from the one before."""
    x = words.select("page", "left_").distinct()
    w = Window.partitionBy("page").orderBy("left_")
    before = F.lag("left_").over(w)
    return x.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("left_") - F.col("_b") >= gap)).select("page", F.col("left_").alias("start"))
