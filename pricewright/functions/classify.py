"""What kind of page a text is: scores of pattern sets, and a ladder over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each kind of page, all regardless of case.
PATTERNS = {
    "title": [r"price\s+book", "catalog", r"effective\s+\d{1,2}[/\-]\d{1,2}[/\-]\d{4}", r"door\s+hardware", "hager|select"],
    "toc": [r"table\s+of\s+contents", "contents", "index", r"\.{3,}", r"\d+\s*$"],
    "finish": [r"finish\s+symbols?", r"architectural\s+finish", r"bhma\s+(?:symbol|code)", r"US\d+[A-Z]?", r"satin\s+(?:chrome|brass|bronze)", r"oil\s+rubbed\s+bronze"],
    "options": ["(?:CTW|EPT|EMS|TIPIT|HT|FR3)", r"preparation\s+add", r"electromagnetic\s+shielding", r"electric\s+thru[\-\s]wire", r"heavy\s+weight", r"add\s+\$\d+"],
    "price_rules": [r"pricing\s+rules?", r"use\s+price\s+of", r"\d+%\s+above", r"same\s+as", r"see\s+price\s+for"],
    "data_table": [r"\$\d+\.\d{2}", r"model\s*(?:number|#)?", "description", "series", "size"],
}
# Kinds in the order they are tried, with the score to exceed.
LADDER = [("title", 0.3), ("toc", 0.3), ("finish", 0.4), ("price_rules", 0.3), ("options", 0.4)]
PRICE, MARKER = r"\$\d+\.\d{2}", "(?i)model|description|price|series"


def scores(text: Column) -> dict[str, Column]:
    """The share of each set's patterns that a text has."""
    return {k: sum((text.rlike(f"(?i){p}").cast("int") for p in ps), F.lit(0)) / len(ps) for k, ps in PATTERNS.items()}


def page_class(text: Column) -> Column:
    """(kind, confidence) of a page. The first set of the ladder that scores
    enough decides; else two of four signs make a data table; else mixed, where
    scores add up to more than a half, or unknown. Null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    s = F.struct(*(c.alias(k) for k, c in scores(t).items()), t.rlike(PRICE).alias("priced"), t.rlike(MARKER).alias("marked"), density(t).alias("density"))

    def decide(x: Column) -> Column:
        out = lambda kind, conf: F.struct(F.lit(kind).alias("kind"), conf.alias("confidence"))
        rungs = F.lit(None)
        for kind, least in reversed(LADDER):
            rungs = F.when(x[kind] > least, out(kind, x[kind])).otherwise(rungs)
        signs = (x["data_table"] > 0.3).cast("int") + x["priced"].cast("int") + x["marked"].cast("int") + (x["density"] > 3).cast("int")
        sure = x["data_table"] + 0.2 * x["priced"].cast("int") + 0.2 * x["marked"].cast("int") + F.least(x["density"] / 10, F.lit(0.3))
        total = sum((x[k] for k in PATTERNS), F.lit(0.0))
        rest = F.when(signs >= 2, out("data_table", F.least(sure, F.lit(1.0)))).when(total > 0.5, out("mixed", total / len(PATTERNS))).otherwise(out("unknown", F.lit(0.1)))
        return F.coalesce(rungs, rest)

    # Bound once: every score is read in several places.
    return F.element_at(F.transform(F.array(s), decide), 1)


def density(text: Column) -> Column:
    """Words per line."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(words / F.size(F.split(text, "\n")))


# What a scan's words are read as, in the order of the rules; $1 is a pattern's first group.
SCAN_RULES = [
    (r"\b0(?=\w)", "O"), (r"(?<=\w)0\b", "O"), (r"\b1(?=\w)", "I"), ("rn", "m"), ("vv", "w"), (r"\|", "I"), (r"\$(\s+)(\d)", r"\$$2"), (r"(\d)\s+\.(\d{2})", "$1.$2"), (r"([A-Z]+)(\s+)(\d+)", "$1$3"),
]


def scan_fixes(text: Column, confidence: Column) -> Column:
    """(text, confidence) after all rules, each that changes the text costing a tenth."""
    acc = F.struct(text.alias("text"), confidence.cast("double").alias("confidence"))
    rules = F.array(*(F.struct(F.lit(a).alias("find"), F.lit(b).alias("put")) for a, b in SCAN_RULES))

    def step(x: Column, r: Column) -> Column:
        new = F.regexp_replace(x["text"], r["find"], r["put"])
        return F.struct(new.alias("text"), F.when(new != x["text"], x["confidence"] * 0.9).otherwise(x["confidence"]).alias("confidence"))

    return F.aggregate(rules, acc, step)
