"""Goods out of the tables and pages of makers' price books.

Cells are long grids (table_id, row_index, col_index, cell), pages have a text.
Descriptors such as "SL11 CL HD600", lengths in headers, prices that share a
cell, matrices of sizes and finishes, options with their net adders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import normalize
from pricewright.functions.keys import is_blank

# Finishes by the code in brackets, with name and number.
SELECT_FINISHES = {"CL": ("Clear Anodized", "628"), "BR": ("Dark Bronze", "710"), "BK": ("Black", "622")}
# Words of cells that hold no price.
NO_PRICE = ["mm", "bevel", "edge", "square", "clearance", "min", "web", "metric", "brochure", "site"]
# Lengths that are taken for prices where columns slip.
LENGTHS = ["79", "83", "85", "95", "120"]
#: The columns of a grid; others are ignored.
_GRID = ("table_id", "row_index", "col_index", "cell")
DASHES = ["-", "—", "–", "", "n/a", "N/A"]

# Patterns of options with a net adder, tried in this order; the
# named groups, which Java writes (?<name>...), are size and price.
NET_ADDERS = [
    ("CTW", r"CTW[-\s]*(?<size>\d+)\s*(?:net\s+add\s+(?:per\s+)?CTW[-\s]*\d+)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("CTW", r"\$?(?<price>\d+(?:\.\d{2})?)\s+net\s+add\s+(?:per\s+)?CTW[-\s]*(?<size>\d+)"),
    ("ATW", r"ATW[-\s]*(?<size>\d+)\s*(?:net\s+add\s+(?:per\s+)?ATW[-\s]*\d+)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("ATW", r"\$?(?<price>\d+(?:\.\d{2})?)\s+net\s+add\s+(?:per\s+)?ATW[-\s]*(?<size>\d+)"),
    ("EPT", r"EPT(?:\s+prep)?\s*(?:net\s+add\s+(?:per\s+)?prep)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("EPT", r"\$?(?<price>\d+(?:\.\d{2})?)\s+net\s+add\s+(?:per\s+)?EPT(?:\s+prep)?"),
    ("EMS", r"EMS\s*(?:net\s+add\s+(?:per\s+)?EMS)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("EMS", r"\$?(?<price>\d+(?:\.\d{2})?)\s+net\s+add\s+(?:per\s+)?EMS"),
    ("TIPIT", r"TIPIT\s+(?<size>LEFT|RIGHT)\s*(?:net\s+add\s+(?:per\s+)?TIPIT)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("TIPIT", r"TIPIT\s*(?:net\s+add\s+(?:per\s+)?TIPIT)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("HT", r"(?:HOSPITAL\s+TIP|HT)\s*(?:net\s+add\s+(?:per\s+)?tip)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("FR3", r"FR3\s*(?:net\s+add\s+(?:per\s+)?FR3)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("CMG", r"CMG\s*(?:net\s+add\s+(?:per\s+)?CMG)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("AP", r"AP\s*(?:net\s+add\s+(?:per\s+)?prep)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
    ("RP", r"RP\s*(?:net\s+add\s+(?:per\s+)?prep)?\s*(?:[:=]|-)?\s*\$?(?<price>\d+(?:\.\d{2})?)"),
]


def _adder(code: str) -> Callable[[Column, Column], Column]:
    return lambda size, price: F.struct(F.lit(code).alias("option_code"), size.alias("size"), price.alias("price"))


def net_adders(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, option_code, size_variant, adder_value): options with a net adder in
    a text, each (code, size, amount) once; amounts of nothing don't count."""
    found = []
    for code, pattern in NET_ADDERS:
        places = {n: i for i, n in enumerate(sorted((n for n in ("size", "price") if f"?<{n}>" in pattern), key=lambda n: pattern.index(f"?<{n}>")), 1)}
        rx = F.lit("(?i)" + pattern)
        prices = F.regexp_extract_all(text, rx, F.lit(places["price"]))
        sizes = F.regexp_extract_all(text, rx, F.lit(places["size"])) if "size" in places else F.transform(prices, lambda _: F.lit(""))
        found.append(F.zip_with(sizes, prices, _adder(code)))
    d = texts.select(key, F.explode(F.flatten(F.array(*(F.coalesce(x, F.slice(x, 1, 0)) for x in found)))).alias("f"))
    size = F.upper(F.replace(F.trim("f.size"), F.lit('"'), F.lit("")))
    d = d.select(key, "f.option_code", F.when(size.isin("LEFT", "RIGHT"), F.initcap(F.lower(size))).otherwise(size).alias("size_variant"), normalize.price(F.col("f.price")).cast("double").alias("adder_value"))
    return d.where("adder_value <> 0").distinct()


def finish_symbols(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, label, bhma, n): finishes named in a text as Clear [CL]."""
    rows = F.create_map(*(F.lit(x) for k, (name, bhma) in SELECT_FINISHES.items() for x in (k, f"{name}|{bhma}")))
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(?:CLEAR|DARK\s+BRONZE|BLACK)\s*\[([A-Z]{2})\]"), F.lit(1))
    d = texts.select(key, F.explode(found).alias("code")).withColumn("v", F.split(F.try_element_at(rows, F.col("code")), r"\|")).where("v is not null")
    return d.groupBy(key, "code").agg(F.first(F.col("v")[0]).alias("label"), F.first(F.col("v")[1]).alias("bhma"), F.count("*").alias("n"))


def descriptor(cell: Column) -> Column:
    """(base_model, finish, duty) of a descriptor as SL11 CL HD600; null for what
    isn't one or names a model alone."""
    t = F.trim(cell)
    rx = r"(?i)^(SL\s*\d{2,3})\s*([A-Z]{2})?\s*([A-Z]{2,6}\d*)?"
    got = lambda k: F.nullif(F.regexp_extract(t, rx, k), F.lit(""))
    finish, duty = F.upper(got(2)), F.upper(got(3))
    swapped = (finish == "LL") & duty.isNull()
    model = F.regexp_replace(got(1), " ", "")
    out = F.struct(model.alias("base_model"), F.when(~F.coalesce(swapped, F.lit(False)), finish).alias("finish"), F.when(swapped, finish).otherwise(duty).alias("duty"))
    return F.when(model.isNotNull() & ~t.rlike(r"^\d+$") & (finish.isNotNull() | duty.isNotNull()), out)


def cell_price(cell: Column) -> Column:
    """The first price of a cell's lines: no dash, fraction or measure, from 10 to 10,000."""
    whole = F.trim(cell)
    ok = lambda x: ~x.isin(*DASHES) & ~x.rlike(r"\d+\s*/\s*\d+") & ~F.lower(x).rlike("|".join(NO_PRICE)) & x.rlike(r"\d")
    lines = F.filter(F.transform(F.split(cell, r"[\r\n]+"), lambda x: F.trim(x)), ok)
    prices = F.filter(F.transform(lines, lambda x: normalize.price(x).cast("double")), lambda p: p.between(10, 10000))
    return F.when(~whole.isin(*DASHES), F.get(prices, F.lit(0)))


def _model_in(cell: Column) -> Column:
    return cell.rlike(r"(?i)\bSL\s*\d{2,3}\b")


def _kept(price: Column, length: Column, cell: Column) -> Column:
    """Whether a price in a length's place is one: not a model, not the length itself."""
    slipped = price.cast("bigint").cast("string").isin(*LENGTHS) & (F.abs(price - length.cast("double")) < 50)
    return price.isNotNull() & ~_model_in(cell) & ~slipped


def described_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row_index, base_model, finish, duty): of each row the
    descriptor in it, the leftmost, or the last one above that still holds: on
    rows with a price that name no other model."""
    d = cells.select(*_GRID, descriptor(F.col("cell")).alias("_d"), cell_price(F.col("cell")).alias("_p"))
    named = F.when(F.length(F.trim("cell")) >= 3, F.col("_d"))
    other = F.regexp_extract(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "cell"))), lambda c: c["cell"]), " "), r"(?i)SL\s*(\d{2,3})", 1)
    rows = d.groupBy("table_id", "row_index").agg(F.min_by(named, F.when(named.isNotNull(), F.col("col_index"))).alias("own"), F.count("_p").alias("priced"), other.alias("other"))
    w = Window.partitionBy("table_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("held", F.last("own", ignorenulls=True).over(w))
    same = (F.col("other") == "") | (F.concat(F.lit("SL"), "other") == F.upper(F.col("held.base_model")))
    used = F.when(F.col("own").isNotNull(), F.col("own")).when((F.col("priced") > 0) & same, F.col("held"))
    return rows.select("table_id", "row_index", used.alias("d")).where("d is not null").select("table_id", "row_index", "d.*")


def length_columns(headers: DataFrame) -> DataFrame:
    """(table_id, col_index, length): lengths of a table's columns, from headers
    as 83\"/85\"; a column may stand for several. headers: (table_id, col_index, header)."""
    return headers.where("col_index > 0").select("table_id", "col_index", F.explode(F.regexp_extract_all("header", F.lit(r"(\d+)\s*[\"']"), F.lit(1))).alias("length"))


def priced_by_length(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, row_index, base_model, finish, duty, length, base_price): a row
    per product of a table whose columns are lengths. Where two columns name a
    length, the last counts. Dashes and blanks are sizes that aren't made."""
    lengths = length_columns(headers).groupBy("table_id", "length").agg(F.max("col_index").alias("col_index"))
    rows = described_rows(cells)
    p = cells.select(*_GRID).join(lengths, ["table_id", "col_index"]).withColumn("base_price", cell_price(F.col("cell")))
    p = p.where(_kept(F.col("base_price"), F.col("length"), F.col("cell")))
    return p.join(rows, ["table_id", "row_index"]).select("table_id", "row_index", "base_model", "finish", "duty", "length", "base_price")


def priced_by_line(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The same of tables that pack lengths and prices into lines of one cell:
    the first header's distinct lengths, in order, meet the row's prices, in order."""
    every = F.regexp_extract_all("header", F.lit(r"(\d+)\s*[\"']?\s*(?:/\s*(\d+)\s*[\"']?)?"), F.lit(1))
    lengths = headers.where("col_index = 0").select("table_id", F.array_distinct(every).alias("lengths"))
    packed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("col_index") > 0) & ~is_blank(F.col("cell")), F.struct("col_index", "cell")))), lambda c: F.transform(F.split(F.trim(c["cell"]), "\n"), lambda x: F.trim(x))))
    prices = cells.groupBy("table_id", "row_index").agg(packed.alias("prices"))
    d = prices.join(lengths, "table_id").join(described_rows(cells), ["table_id", "row_index"])
    n = F.least(F.size("lengths"), F.size("prices"))
    d = d.where(n > 0).select("table_id", "row_index", "base_model", "finish", "duty", F.inline(F.arrays_zip(F.slice("lengths", F.lit(1), n).alias("length"), F.slice("prices", F.lit(1), n).alias("cell"))))
    d = d.withColumn("base_price", cell_price(F.col("cell"))).where(_kept(F.col("base_price"), F.col("length"), F.col("cell")))
    return d.drop("cell")


def sku_of(base_model: Column, finish: Column, duty: Column, length: Column) -> Column:
    """The sku a product's parts make, without those it lacks."""
    return F.concat_ws("-", base_model, finish, duty, length)


def best_priced(products: DataFrame) -> DataFrame:
    """Products with a length and a price from 10 to 10,000, of equal skus the
    dearest, of equal prices the last; sku letters and digits count alone."""
    key = F.regexp_replace(F.upper("sku"), "[^A-Z0-9]", "")
    best = F.max(F.struct("base_price", "pos", "sku")).alias("b")
    d = products.where(F.col("length").isNotNull() | F.col("sku").rlike(r"-\d{2,3}|\d{2,3}$")).groupBy(key.alias("k")).agg(best)
    return d.select("b.sku", "b.pos", "b.base_price").where(F.col("base_price").between(10, 10000))


def cell_skus(cells: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, base_model, finish, variant, base_price):
    cells that name a model, with the finish they or their neighbours name, and
    the price behind the name or in a neighbour that looks like one."""
    rx = r"(?i)(SL\s*\d{2})(?:\s*([A-Z]{2}))?(?:\s*(HD\d+|LD\d+|LL|\d{2,3}\"?))?"
    w = Window.partitionBy("table_id", "row_index").orderBy("col_index")
    near = lambda k: F.trim(F.lead("cell", k).over(w) if k > 0 else F.lag("cell", -k).over(w))
    d = cells.select(*_GRID).withColumns({f"n{i}": near(k) for i, k in enumerate((-1, 1, 2, -2))})
    d = d.where(F.col("cell").rlike(rx) & ~is_blank(F.col("cell")))
    got = lambda k: F.nullif(F.regexp_extract("cell", rx, k), F.lit(""))
    named = lambda c: F.when(F.upper(c).isin(*SELECT_FINISHES), F.upper(c))
    finish = F.coalesce(F.upper(got(2)), named(F.col("n0")), named(F.col("n1")))
    rest = F.element_at(F.split("cell", rx, 2), 2)
    inside = F.get(F.filter(F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+\.?\d{0,2})"), F.lit(1)), lambda x: x.try_cast("double")), lambda x: x.between(10, 5000)), F.lit(0))
    money = lambda c: F.when(F.contains(c, F.lit("$")) | c.rlike(r"\d+\.\d{2}"), F.get(F.filter(F.transform(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(r"(\d+\.?\d{0,2})"), F.lit(1)), lambda x: x.try_cast("double")), lambda x: x.between(10, 5000)), F.lit(0)))
    price = F.coalesce(inside, *(money(F.col(f"n{i}")) for i in (1, 0, 2, 3)))
    d = d.select("table_id", "row_index", "col_index", F.regexp_replace(got(1), " ", "").alias("base_model"), finish.alias("finish"), F.upper(F.replace(got(3), F.lit('"'), F.lit(""))).alias("variant"), price.alias("base_price"))
    return d.where(F.col("finish").isin(*SELECT_FINISHES) & F.col("base_price").isNotNull())


# --- pages and tables of the other maker ---------------------------------------


def series_of(model: Column) -> Column:
    """The series a model belongs to by how it begins."""
    return F.when(model.startswith("BB"), "Ball Bearing Hinge").when(model.startswith("ECBB"), "Electric Hinge").when(model.startswith("WT"), "Wide Throw Hinge").otherwise("Standard Hinge")


def matrix_size(size: Column) -> Column:
    """A size as skus hold it: 4-1/2" x 4" is 4.5x4."""
    t = F.replace(F.trim(F.replace(size, F.lit('"'), F.lit(""))), F.lit(" x "), F.lit("x"))
    for a, b in (("-1/2", ".5"), ("-3/4", ".75"), ("-1/4", ".25")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def matrix_description(text: Column, model: Column) -> Column:
    """What a matrix page says its model is."""
    has = lambda s: F.contains(text, F.lit(s))
    base = F.lit("Hinge")
    for s in ("Half Surface", "Full Surface", "Half Mortise", "Full Mortise"):
        base = F.when(has(s), s).otherwise(base)
    kind = F.when(has("Ball Bearing"), " Ball Bearing").when(has("Electric") | has("Concealed"), " Electric").otherwise("")
    weight = F.when(has("Heavy Weight"), " Heavy Weight").when(has("Standard Weight"), " Standard Weight").otherwise("")
    return F.concat(model, F.lit(" "), base, kind, weight)


def is_matrix_page(text: Column) -> Column:
    """A page with a model, three finishes, a price, and no part numbers."""
    return text.rlike(r"\b(BB|ECBB|WT)\d{4}\b") & (F.regexp_count(text, F.lit(r"\bUS\d+[A-Z]?\b")) >= 3) & text.rlike(r"\d+\.\d{2}") & ~F.contains(F.upper(text), F.lit("PART NUMBER"))


def matrix_products(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, entry_no, sku, model, series, description, size, finish, base_price):
    the products of matrix pages. A line sets the size; a finish line waits for
    the price line that follows; a line with both is a product by itself.

    The state is a size and a finish, so a page's lines are folded in order, as
    one array; a page is bounded by its text."""
    size_rx = "(\\d+(?:-\\d+/\\d+)?[\"”�]?\\s*[xX×]\\s*\\d+(?:-\\d+/\\d+)?[\"”�]?)"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda s: (F.length(s) >= 2) & ~F.contains(F.lower(s), F.lit("mm")))
    seen = F.transform(lines, lambda s: F.struct(
        F.nullif(F.trim(F.regexp_extract(s, size_rx, 1)), F.lit("")).alias("size"), F.nullif(F.regexp_extract(s, r"^\s*(US\d+[A-Z]?)\s*$", 1), F.lit("")).alias("finish"),
        F.nullif(F.regexp_extract(s, r"^(\d+\.\d{2})$", 1), F.lit("")).alias("price"), F.nullif(F.regexp_extract(s, r"\b(US\d+[A-Z]?)\b", 1), F.lit("")).alias("with_finish"),
        F.nullif(F.regexp_extract(s, r"\bUS\d+[A-Z]?\b(?:(?!\d+\.\d{2}).)*(?<!\d)(\d+\.\d{2})", 1), F.lit("")).alias("with_price"),
    ))
    entry = "array<struct<size:string,finish:string,price:string>>"
    first = F.struct(F.lit(None).cast("string").alias("size"), F.lit(None).cast("string").alias("finish"), F.array().cast(entry).alias("out"))

    def step(a: Column, s: Column) -> Column:
        sized = s["size"].isNotNull()
        waits = ~sized & s["finish"].isNotNull() & a["size"].isNotNull()
        ends = ~sized & ~waits & s["price"].isNotNull() & a["size"].isNotNull() & a["finish"].isNotNull()
        both = ~sized & ~waits & ~ends & s["with_finish"].isNotNull() & s["with_price"].isNotNull() & a["size"].isNotNull()
        new = lambda f, p: F.concat(a["out"], F.array(F.struct(a["size"].alias("size"), f.alias("finish"), p.alias("price"))))
        return F.struct(
            F.when(sized, s["size"]).otherwise(a["size"]).alias("size"), F.when(waits, s["finish"]).when(~ends, a["finish"]).alias("finish"),
            F.when(ends, new(a["finish"], s["price"])).when(both, new(s["with_finish"], s["with_price"])).otherwise(a["out"]).alias("out"),
        )

    model = F.regexp_extract(text, r"\b(?:BB|ECBB|WT)\d{4}\b", 0)
    d = pages.where(model != "").select(key, model.alias("model"), matrix_description(F.col(text), model).alias("about"), F.posexplode(F.aggregate(seen, first, step)["out"]).alias("entry_no", "e"))
    return d.select(
        key, "entry_no", F.concat_ws("-", "model", matrix_size(F.col("e.size")), "e.finish").alias("sku"), "model", series_of(F.col("model")).alias("series"), F.concat_ws(" - ", "about", "e.size").alias("description"),
        "e.size", "e.finish", F.col("e.price").cast("double").alias("base_price"),
    )


def paired_lines(rows: DataFrame, key: list[str], description: str, price: str) -> DataFrame:
    """(*key, line_no, sku, description, base_price): a row per line of cells that
    hold several goods, where both cells have as many lines; else the cell as a
    whole. The sku is the first code in the description."""
    lines = lambda c: F.filter(F.transform(F.split(F.trim(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = rows.where(~is_blank(F.col(description)) & ~F.lower(F.trim(description)).isin("description", "name") & ~is_blank(F.col(price)) & ~F.lower(F.trim(price)).isin("price", "list"))
    a, b = lines(description), lines(price)
    several = (F.size(a) == F.size(b)) & (F.size(a) > 1)
    parts = F.when(several, F.arrays_zip(a.alias("d"), b.alias("p"))).otherwise(F.array(F.struct(F.trim(description).alias("d"), F.trim(price).alias("p"))))
    d = d.select(*key, F.posexplode(parts).alias("line_no", "x"))
    code = F.nullif(F.regexp_extract("x.d", r"\b([A-Z]{2,4}[-\d]+)\b", 1), F.lit(""))
    d = d.select(*key, "line_no", normalize.sku(code, "hager").alias("sku"), F.col("x.d").alias("description"), normalize.price(F.col("x.p")).cast("double").alias("base_price"))
    return d.where("sku is not null and base_price <> 0")


def has_indicators(cells: DataFrame, words: list[str], least: int) -> DataFrame:
    """Tables of two rows or more whose text has at least so many of the words."""
    text = F.lower(F.concat_ws(" ", F.collect_list(F.coalesce("cell", F.lit("")))))
    g = cells.groupBy("table_id").agg(text.alias("t"), F.count_distinct("row_index").alias("n"))
    hits = sum((F.contains("t", F.lit(x)).cast("int") for x in words), F.lit(0))
    return g.where((F.col("n") >= 2) & (hits >= least)).select("table_id", hits.alias("hits"))


# Words that tell the two makers' product tables.
SELECT_WORDS = ["sl11", "sl14", "sl24", "sl41", "length", "duty", "finish", "cl", "br", "bk", "light", "medium", "heavy"]
HAGER_WORDS = ["bb1100", "bb1279", "bb1290", "ecbb1100", "wt1279", "us3", "us4", "us10b", "hager", "heavy", "standard"]


def section(text: Column, start: str, end: str) -> Column:
    """The part of a text from one pattern up to another or the end, regardless of case and over lines."""
    return F.nullif(F.regexp_extract(text, rf"(?is)({start}.*?)(?={end}|\z)", 1), F.lit(""))
