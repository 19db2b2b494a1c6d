"""Scalar normalisers of prices, skus, dates, units, text and scan errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names and their codes.
UNITS = {
    "each": "EA", "ea": "EA", "piece": "EA", "pcs": "EA", "set": "SET", "pair": "PR", "dozen": "DZ", "doz": "DZ", "linear foot": "LF", "lf": "LF", "square foot": "SF", "sf": "SF",
}

# Finish codes, their names and other codes for them.
FINISHES = {
    "US3": ("Satin Chrome", ["SC", "CR3"]), "US4": ("Bright Chrome", ["BC", "CR4"]), "US10B": ("Satin Bronze", ["SB", "BR10B"]), "US15": ("Satin Brass", ["SBR", "BR15"]),
    "US26D": ("Oil Rubbed Bronze", ["ORB", "RB"]), "US32D": ("Antique Brass", ["AB", "ANT"]), "US33D": ("Antique Copper", ["AC", "COP"]),
}

# Sku patterns by maker, tried before the general one.
SKU_PATTERNS = {
    "hager": ["^([A-Z]{2,4}[0-9]{2,6}[A-Z]?)$", "^([A-Z]+[0-9-]+[A-Z]*)$"],
    "select_hinges": ["^(SL[0-9]{2}[A-Z]*)$", "^([A-Z]{2,4}[0-9-]+)$"],
}
GENERAL_SKU = "^([A-Z0-9-]{3,20})$"

# Date notations.
DATE_FORMATS = ["MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "M/d/yyyy", "M-d-yyyy", "M/d/yy", "yyyy-MM-dd", "d MMMM yyyy"]

# Forms of prices, and those of prices in text without blanks, in this order.
PRICE_FORMS = [r"^\$?([0-9,]+\.?[0-9]*)$", r"^([0-9,]+\.?[0-9]*)\s*\$?$", r"([0-9,]+\.?[0-9]*)"]
PACKED_PRICES = [r"\$(\d+[,\d]*\.?\d{0,2})", r"(\d+[,\d]*\.\d{2})USD", r"Price:\$?(\d+[,\d]*\.?\d{2})", r"(\d+[,\d]*\.\d{2})"]

# Fixed value: marks that scans and broken encodings leave.
DEBRIS = "[�|]|\\\\x00"


def _got(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def price(c: Column) -> Column:
    """A price as decimal: a whole text that is one, else its first number.
    Commas fall away, so does a sign; nothing numeric gives null."""
    t = F.trim(c.cast("string"))
    number = F.coalesce(*(_got(t, p) for p in PRICE_FORMS))
    return F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(18,4)")


def price_usable(c: Column) -> Column:
    """Whether there is a price and it isn't zero."""
    return F.coalesce(price(c) != 0, F.lit(False))


def price_packed(c: Column) -> Column:
    """A price out of text with stray blanks: dollars, USD, two decimals, or a
    lone number from 5 on; null beyond 100,000."""
    t = F.regexp_replace(c, r"\s+", "")
    found = []
    for p in PACKED_PRICES:
        v = F.replace(F.regexp_extract(t, p, 1), F.lit(","), F.lit("")).try_cast("double")
        found.append(F.when(v.between(0.01, 100000), v))
    lone = F.regexp_extract(t, r"(?<![A-Za-z])(\d{1,6}(?:\.\d{1,2})?)(?![A-Za-z])", 1).try_cast("double")
    return F.coalesce(*found, F.when(lone.between(5, 100000), lone))


def sku(c: Column, maker: str | None = None) -> Column:
    """A sku that fits its maker's patterns or the general one, else what is
    left of letters, digits and hyphens if that is 2 to 20 characters."""
    t = F.upper(F.trim(c))
    tries = [_got(t, p) for p in [*SKU_PATTERNS.get((maker or "").lower(), []), GENERAL_SKU]]
    rest = F.regexp_replace(t, "[^A-Z0-9-]", "")
    return F.coalesce(*tries, F.when(F.length(rest).between(2, 20), rest))


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that reads another several times, which is worked out once."""
    return F.element_at(F.transform(F.array(c), lambda x: use(x)), 1)


def _dated(text: Column, fmt: str) -> Column:
    """A date in a format; years of two digits from 69 on are of the last century."""
    d = F.call_function("try_to_date", text, F.lit(fmt))
    return d if "yyyy" in fmt else F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)


def date(c: Column) -> Column:
    """A date named after "effective", in figures, or with its month in words."""
    found = F.coalesce(_got(c, r"(?i)effective\s+(\w+\s+\d{1,2},?\s+\d{4})"), _got(c, r"(\d{4}-\d{2}-\d{2})"), _got(c, r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"), _got(c, r"(\w+\s+\d{1,2},?\s+\d{4})"))
    return _once(found, lambda x: F.coalesce(*(_dated(F.initcap(x), f) for f in DATE_FORMATS)))


def finish(c: Column) -> Column:
    """The finish code for a code or one of its other names."""
    pairs = [(a, k) for k, (_, alts) in FINISHES.items() for a in (k, *alts)]
    table = F.create_map(*(F.lit(x) for p in pairs for x in p))
    t = F.upper(F.trim(c))
    return F.coalesce(F.try_element_at(table, t), t)


def unit(c: Column) -> Column:
    """The code of a unit; unknown ones in capitals, ten characters; none is EA."""
    table = F.create_map(*(F.lit(x) for p in UNITS.items() for x in p))
    t = F.lower(F.trim(c))
    return F.when(F.coalesce(t, F.lit("")) == "", "EA").otherwise(F.coalesce(F.try_element_at(table, t), F.substring(F.upper(F.trim(c)), 1, 10)))


def description(c: Column) -> Column:
    """One blank for each run of white space, odd characters gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)[^\w\s\-.,()/&]", ""))


def scan_digits(c: Column) -> Column:
    """O, I and l that stand after a digit and before one, or at the end, as the
    digits they are; debris gone."""
    t = F.regexp_replace(F.trim(c), DEBRIS, "")
    for a, b in (("O", "0"), ("I", "1"), ("l", "1")):
        t = F.regexp_replace(t, rf"(?<=\d){a}(?=\d|$)", b)
    return t


def clean_text(c: Column) -> Column:
    """Text without debris, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"�|\\x00|\|\||\|_", ""), r"\s+", " "))


def amount_spacing(c: Column) -> Column:
    """Blanks inside amounts closed up: "$ 1 ,145 .50" is "$1,145.50"."""
    t = F.regexp_replace(c, r"\$\s+(?=\d)", r"\$")
    return F.regexp_replace(t, r"(?<=\d)\s+(?=[.,]\d{2,3})", "")


def natural_key(*cols: Column) -> Column:
    """SHA-256 of the trimmed, lower-case values, joined by bars; null is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("")) for c in cols)), 256)


def edition_of(path: Column) -> Column:
    """The edition a file name tells: its first year, else unknown."""
    year = F.regexp_extract(path, r"(\d{4})", 1)
    return F.when(year != "", F.concat(year, F.lit(" Edition"))).otherwise("Unknown Edition")


def pattern_of(c: Column) -> Column:
    """A sku as the pattern its digits generalise to."""
    return F.concat(F.lit("^"), F.regexp_replace(c, r"\d+", r"\\d+"), F.lit("$"))


def keywords(c: Column) -> Column:
    """Words of more than three letters, in lower case, once each."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3))


def substitutions(a: Column, b: Column) -> Column:
    """(read, meant) characters where two texts of one length differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("read"), y.alias("meant")))
    return F.when(F.length(a) == F.length(b), F.filter(pairs, lambda p: p["read"] != p["meant"])).otherwise(F.slice(pairs, 1, 0))


def text_quality(c: Column) -> Column:
    """0 to 1: readable words, lines of a fair length, few marks of a bad scan."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    good = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Za-z0-9$.,%-]+$")))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    mean = F.aggregate(lines, F.lit(0), lambda acc, s: acc + F.length(s)) / F.greatest(F.lit(1), F.size(lines))
    bad = F.least(F.lit(0.3), F.regexp_count(c, F.lit("[|§¦¨©«»°±²³]")) / F.length(c))
    score = good / F.greatest(F.lit(1), F.size(words)) * 0.6 + F.least(F.lit(1.0), mean / 50) * 0.4 - bad
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def finish_entry(c: Column) -> Column:
    """(code, bhma, name) of a finish by its code or one of its other names; what
    isn't known keeps its code alone."""
    table = F.create_map(*(F.lit(x) for k, (name, alts) in FINISHES.items() for a in (k, *alts) for x in (a, f"{k}|{name}")))
    t = F.nullif(F.upper(F.trim(c)), F.lit(""))
    v = F.split(F.try_element_at(table, t), r"\|")
    return F.struct(t.alias("code"), v[0].alias("bhma"), v[1].alias("name"))


# Confidence of a normalised value that came out and of one that did not.
NORMALISED = {"price": (0.9, 0.3), "sku": (0.9, 0.4), "date": (0.95, 0.2)}


def normalised_score(value: Column, kind: str) -> Column:
    """Confidence in a normalised value of a kind."""
    good, bad = NORMALISED.get(kind, (0.5, 0.5))
    there = value.isNotNull() & (value != 0) if kind == "price" else value.isNotNull()
    return F.when(F.coalesce(there, F.lit(False)), good).otherwise(bad)


def loose_price(c: Column) -> Column:
    """A price whose comma may be a decimal mark: it is one if it is the only mark
    and has one or two digits behind it."""
    t = F.regexp_replace(c, r"[^\d.,-]", "")
    parts = F.split(t, ",")
    mark = (F.size(parts) == 2) & (F.length(F.element_at(parts, -1)) <= 2) & ~F.contains(t, F.lit("."))
    return F.when(mark, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))).try_cast("double")


def loose_sku(c: Column) -> Column:
    """A sku in capitals without marks at its ends; empty for none."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"(?U)^[^\w-]+", ""), r"(?U)[^\w-]+$", ""), F.lit(""))


# Where a text names its effective date in figures, in this order.
DATE_PLACES = [r"effective\s+date[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"effective[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"prices\s+effective[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"]
FIGURES = ["MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "MM/dd/yy", "MM-dd-yy"]


def date_in(text: Column) -> Column:
    """The effective date a text names in figures, as written."""
    return F.coalesce(*(_got(text, "(?i)" + p) for p in DATE_PLACES))


def date_or(c: Column, other: Column) -> Column:
    """A date in figures, or another where there is a text that isn't one."""
    pad = F.regexp_replace(F.regexp_replace(F.trim(c), r"^(\d)([/-])", "0$1$2"), r"([/-])(\d)([/-])", "$10$2$3")
    forms = list(zip(FIGURES, (r"^\d\d/\d\d/\d{4}$", r"^\d\d-\d\d-\d{4}$", r"^\d{4}-\d\d-\d\d$", r"^\d\d/\d\d/\d\d$", r"^\d\d-\d\d-\d\d$")))
    read = _once(pad, lambda x: F.coalesce(*(F.when(x.rlike(rx), _dated(x, f)) for f, rx in forms)))
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(read, other))


# Units as texts spell them out, and their marks.
UNIT_WORDS = [(r"\binches?\b", "in"), (r"\bfeet\b", "ft"), (r"\bpounds?\b", "lbs"), (r"\bkilograms?\b", "kg")]


def spacing(c: Column) -> Column:
    """Amounts closed up and units by their marks."""
    t = F.regexp_replace(c, r"\$\s+", r"\$")
    t = F.regexp_replace(F.regexp_replace(t, r"(\d)\s*,\s*(\d{3})", "$1,$2"), r"(\d)\s+\.(\d{2})", "$1.$2")
    for rx, mark in UNIT_WORDS:
        t = F.regexp_replace(t, "(?i)" + rx, mark)
    return t


# Makers that are known by a word in their texts, in this order.
MAKERS = ["select", "hager", "continental", "lockey", "alarlock", "dorma", "assa abloy", "yale", "schlage", "kwikset"]


def maker_in(text: Column) -> Column:
    """The first of the known makers a text names, or unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(m)), m) for m in MAKERS), F.lit("unknown"))


# How cells that hold a sku or a price look.
SKU_LOOKS = [r"^BB\d+", r"^BBH\d+", r"^[A-Z]{2,3}\d+", r"^[A-Z]+\d+[A-Z]*"]
PRICE_LOOKS = [r"^\$?\d+\.?\d*$", r"^\$?\d{1,3}(,\d{3})*(\.\d{1,2})?$", r"^\d+\.\d{2}$"]


def _one_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def looks_like_sku(c: Column) -> Column:
    """Whether a cell looks like a sku: capitals, then digits."""
    return F.coalesce(F.length(c) >= 3, F.lit(False)) & _one_of(F.upper(c), SKU_LOOKS)


def looks_like_price(c: Column) -> Column:
    """Whether a cell looks like a price."""
    return _one_of(c, PRICE_LOOKS)


def model_of(sku: Column) -> Column:
    """A sku without the finish at its end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(sku, F.lit("")), r"-US\d+[A-Z]*$", ""), "-+$", "")


def finish_in(sku: Column) -> Column:
    """The first of the known finishes a sku holds."""
    up = F.upper(sku)
    return F.coalesce(*(F.when(F.contains(up, F.lit(k)), k) for k in FINISHES))


# Sizes and finishes as lines name them, in this order.
SIZES = [r"(\d+\.?\d*\s*x\s*\d+\.?\d*)", r"(\d+\"\s*x\s*\d+\")", r"(\d+\.?\d*)\s*(in|inch|mm|cm)"]
FINISH_WORDS = [r"\bUS\s*\d+[A-Z]?\b", r"\b([A-Z]{2,3})\b", r"\b(BHMA\s*\d+[A-Z]?)\b"]


def size_in(text: Column) -> Column:
    """The first size of a text, the first notation first."""
    return F.trim(F.coalesce(*(_got(text, "(?i)" + p, 1) for p in SIZES)))


def finishes_in(text: Column) -> Column:
    """All finishes of a text, each once, sorted. The second notation is any word
    of two or three letters, as catalogs print codes."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in FINISH_WORDS)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(x))))


# Kinds of errors by words in their names.
ERRORS = {"validation": "valid|value|not_?found|missing", "security": "permission|auth", "network": "timeout|connection|http", "parsing": "parse|pdf|extract", "database": "sql|database|integrity"}


def error_category(name: Column) -> Column:
    """The category of an error by its name."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.rlike(rx), k) for k, rx in ERRORS.items()), F.lit("unknown"))
