"""Matching records of two sources without a shared key.

Candidates share the digits of a model as a scan may have read them. Labelling
functions look at each candidate's partial, noisy attributes and vote for a
match, against it, or not at all. A generative label model, fitted without
labels on the counts of vote patterns, learns how often each function is right
in either class and which functions depend on each other (a tree of the
strongest conditional dependences), and gives each pattern a posterior
confidence. The posterior decides: a listing goes to its likeliest candidate if
that is more likely a match than not. Patterns are few (at most 3 to the power
of the functions, whatever the data), so the model is fitted on the driver and
its table of posteriors is broadcast.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions.keys import SCAN_FROM, SCAN_TO, plain_sku
from pricewright.operators.snapshots import latest_in_snapshot
from pricewright.runtime import cut

# Finish codes with their number and name.
FINISHES = [
    ("USP", "600", "Primed"), ("US3", "605", "Bright Brass"), ("US4", "606", "Satin Brass"), ("US10", "612", "Satin Bronze"), ("US10B", "613", "Dark Bronze"),
    ("US15", "619", "Satin Nickel"), ("US19", "622", "Flat Black"), ("US26", "625", "Bright Chrome"), ("US26D", "626", "Satin Chrome"), ("US32D", "630", "Satin Stainless"),
]

# Words of goods that go with a model without being it.
ACCESSORY = r"\b(FOR|TO SUIT|SUITS?|FITS?|SPARE|KIT|PACK|JIG|REPLACEMENT|COMPATIBLE)\b"

AGAINST, ABSTAIN, MATCH = 0, 1, 2
#: The labelling functions; the last only ever votes against.
FUNCTIONS = ["prefix", "digits", "size", "finish", "weight", "type", "price", "goods"]
UNIPOLAR = {"goods"}
#: Votes counted in advance: a function is taken to be right in either class
#: until the data says otherwise.
RIGHT, WRONG = 1.0, 0.02
#: How seldom a function that only votes against does so for a match.
NEVER = 1e-4
#: Functions are better than chance: none votes against more matches than this.
MOST_WRONG = 0.05
_D = "[0-9OILSBGZ]"


def _folded(c: Column) -> Column:
    return F.translate(c, SCAN_FROM, SCAN_TO)


def _finish(text: Column) -> Column:
    """The finish code a text names: by code, by name, or by number."""
    code = F.regexp_extract(text, r"\bUS[- ]?(\d{1,2}[A-Z]?|P)\b", 1)
    out = F.when(code != "", F.concat(F.lit("US"), code))
    for c, _, name in FINISHES:
        first, _, rest = name.upper().partition(" ")
        words = rf"\b(?:{first}|{first[:3]}\.?) {rest}\b" if rest else rf"\b{first}\b"
        out = out.when(text.rlike(words), c)
    number = F.regexp_extract(text, r"(?<![\d.-])(6[0-3]\d)(?![\d.-]|\s?X|\s?MM)", 1)
    for c, n, _ in FINISHES:
        out = out.when(number == n, c)
    return out


def _size(text: Column) -> Column:
    """The size a text names, in tenths of an inch: 5 x 5, 4-1/2 sq, 127 x 127 mm."""
    mm = F.regexp_extract(text, r"(?<!\d)(\d{2,3})\s?X\s?\d{2,3}\s?MM\b", 1)
    num = r"(?<![\d./])(\d{1,2}(?:[- ]\d/\d|\.\d+)?)"
    inch = F.regexp_extract(text, num + r"""\s*(?:["”″]|''|IN\.?|INCH)?\s*(?:X|BY)\s*\d""", 1)
    square = F.regexp_extract(text, num + r"""\s*(?:["”″]|IN\.?)?\s*SQ\b""", 1)
    found = F.when(inch != "", inch).when(square != "", square)
    whole = F.regexp_extract(found, r"^(\d+)", 1).try_cast("double")
    part = F.coalesce(F.regexp_extract(found, r"(\d)/\d", 1).try_cast("double") / F.nullif(F.regexp_extract(found, r"\d/(\d)", 1).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    decimal = F.when(found.contains("."), found.try_cast("double"))
    metric = F.round(mm.try_cast("double") / 25.4 * 2) * 5
    return F.when(mm != "", metric).otherwise(F.coalesce(decimal, whole + part) * 10).cast("int")


def _weight(text: Column) -> Column:
    return (
        F.when(text.rlike(r"\b(HEAVY|HVY)\b|\bHW\b"), "H").when(text.rlike(r"\b(LIGHT|LT)\b|\bLW\b"), "L").when(text.rlike(r"\b(STANDARD|STD)\b"), "S")
    )


def offers(listings: DataFrame) -> DataFrame:
    """A row per listing and model number it may name."""
    model, item = F.upper(F.coalesce("model_text", F.lit(""))), F.upper(F.coalesce("item_text", F.lit("")))
    text = F.concat_ws(" ¦ ", model, item)
    named = rf"(?<![A-Z0-9])(?=((?:HG)?[A-Z][A-Z0-9][-. ]?{_D}{{3}}[-. ]?{_D}{{3}})(?![A-Z0-9]))"
    bare = rf"(?<![A-Z0-9])(?=((?:[OILSBGZ]*[0-9]){{3}}{_D}{{0,3}})(?![A-Z0-9]))(?={_D}{{6}}(?![A-Z0-9]))"
    raws = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(named), F.lit(1)), F.regexp_extract_all(text, F.lit(bare), F.lit(1))))
    rows = listings.where(F.col("listing_id").isNotNull()).select(F.col("listing_id").cast("bigint").alias("listing_id"), item.alias("item"), F.col("quoted_price").cast("double").alias("quoted"), F.explode(raws).alias("raw"))
    plain = F.regexp_replace(F.regexp_replace("raw", "[-. ]", ""), "^HG(?=.{8}$)", "")
    rows = rows.withColumn("plain", plain).where(F.length("plain").isin(6, 8))
    digits = F.substring("plain", -6, 6)
    rest = F.regexp_replace(F.replace(F.col("item"), F.col("raw"), F.lit(" ")), r"\s+", " ")
    return rows.withColumn("rest", rest).select(
        "listing_id", F.when(F.isnan("quoted"), None).otherwise(F.col("quoted")).alias("quoted"), digits.alias("read"), _folded(digits).alias("key"),
        F.when(F.length("plain") == 8, _folded(F.substring("plain", 1, 2))).alias("o_prefix"), _size(F.col("rest")).alias("o_size"), _finish(F.col("rest")).alias("o_finish"), _weight(F.col("rest")).alias("o_weight"),
        F.col("rest").alias("o_text"), F.when(F.col("rest").rlike(ACCESSORY), AGAINST).otherwise(ABSTAIN).alias("v_goods"),
    )


def goods(products: DataFrame) -> DataFrame:
    """The products of the last snapshot with what their sku, model and
    description tell. A sku is read as its model, a size if there is one, and a
    finish; the model as letters before and digits. What can't be read is null,
    its functions abstain; a product whose model has no digits can't be named
    by them and is no candidate."""
    rows = products.select(
        "snapshot_date", plain_sku(F.col("sku")).alias("sku"), "loaded_at", F.upper("description").alias("text"), F.col("base_price").cast("double").alias("price"), plain_sku(F.col("model")).alias("model"),
    )
    last = rows.agg(F.max("snapshot_date").alias("snapshot_date"))
    current = latest_in_snapshot(rows.join(F.broadcast(last), "snapshot_date"), "snapshot_date", "sku", "loaded_at", ["text", "price", "model"])
    # Without a model column's help, the model is the sku up to a size, square
    # ones first, or up to the finish.
    tries = [r"^([A-Z]*\d+)(?=(\d{2,3})X\2(?!\d))", r"^([A-Z]*\d+)(?=\d{2}X\d{2})", r"^([A-Z]*\d+)(?=[A-Z])"]
    read = F.coalesce(*(F.nullif(F.regexp_extract("key", t, 1), F.lit("")) for t in tries))
    model = F.when(F.startswith("key", F.col("model")), F.col("model")).otherwise(read)
    d = current.withColumn("model", model).withColumn("rest", F.expr("substring(key, length(model) + 1)"))
    got = lambda c, parts, k: F.nullif(F.regexp_extract(c, parts, k), F.lit(""))
    name, tail = r"^([A-Z]*)(\d+)$", r"^(?:(\d{2,3})X\d{2,3})?(.*)$"
    kind = F.regexp_extract("text", r"^\S+\s+([A-Z]+)(?:\s+[A-Z]+)*?\s+(?:HINGE|SET)\b", 1)
    return d.select(
        F.col("key").alias("sku"), "price", _folded(got("model", name, 1)).alias("prefix"), got("model", name, 2).alias("key"), F.coalesce(got("rest", tail, 1).try_cast("int"), _size(F.col("text"))).alias("size"),
        F.coalesce(got("rest", tail, 2), _finish(F.col("text"))).alias("finish"), _weight(F.col("text")).alias("weight"), F.nullif(F.substring(kind, 1, 4), F.lit("")).alias("kind"),
    ).where(F.col("key").isNotNull())


# How the kinds of goods begin.
KINDS = ["KNUC", "FULL", "HALF", "GEAR", "SLIP", "SPRI", "ANCH", "SWIN", "POCK", "PIVO"]


def candidates(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs of listing and product with the votes of all functions.

    A model's digits lead to its skus, one per size and finish; hot models
    are listings many times over, which the join may split, never many products."""
    p = offers(listings).join(goods(products), "key")

    def vote(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | b.isNull(), ABSTAIN).when(a == b, MATCH).otherwise(AGAINST)

    off = F.abs(F.col("quoted") - F.col("price")) / F.nullif(F.col("price"), F.lit(0.0))
    has = F.lit(False)
    for k in KINDS:
        has = has | F.col("o_text").rlike(rf"\b{k}")
    kind = F.when(F.col("kind").isNull(), ABSTAIN).when(F.contains(F.concat(F.lit(" "), "o_text"), F.concat(F.lit(" "), "kind")), MATCH).when(has, AGAINST).otherwise(ABSTAIN)
    votes = {
        "prefix": vote(F.col("o_prefix"), F.col("prefix")),
        "digits": F.when(F.col("read") == F.col("key"), MATCH).otherwise(ABSTAIN),
        "finish": vote(F.col("o_finish"), F.col("finish")),
        "weight": vote(F.col("o_weight"), F.col("weight")),
        "type": kind,
        "price": F.when(off.isNull(), ABSTAIN).when(off <= 0.04, MATCH).when(off > 0.2, AGAINST).otherwise(ABSTAIN),
        "goods": F.col("v_goods"),
    }
    # Texts end here: what follows carries votes and numbers only.
    p = p.select("listing_id", "sku", off.alias("off"), "o_size", "size", *(v.alias(f"v_{f}") for f, v in votes.items() if f != "goods"), "v_goods")
    # A listing that leaves the size out means that of the nearest price. Its
    # candidates, a model's skus, are few.
    open_ = F.col("o_size").isNull() & (F.col("v_prefix") != AGAINST) & (F.col("v_finish") != AGAINST)
    p = p.withColumn("_off", F.when(open_, F.col("off")))
    p = p.withColumn("_nearest", F.min("_off").over(Window.partitionBy("listing_id")))
    nearest = F.when(F.col("_off") <= F.col("_nearest"), MATCH).otherwise(AGAINST)
    p = p.withColumn("v_size", F.when(F.col("o_size").isNull() & F.col("_nearest").isNotNull(), nearest).otherwise(vote(F.col("o_size"), F.col("size"))))
    return p.select("listing_id", "sku", F.concat(*(F.col(f"v_{f}").cast("string") for f in FUNCTIONS)).alias("votes"), "off")


Votes = tuple[int, ...]


@dataclass
class LabelModel:
    """Class-conditional counts of the votes cast, along a tree of dependences:
    for every function, (class, vote of the function it hangs on, vote)."""

    prior: float
    parent: list[int]
    table: list[dict[tuple[int, int, int], float]]
    unipolar: frozenset[int]

    def _share(self, i: int, y: int, up: int, v: int, own: float) -> float:
        if i in self.unipolar and y:
            return NEVER
        n = self.table[i]
        cast = {x: max(0.0, n.get((y, up, x), 0.0) - (own if x == v else 0.0)) + (RIGHT if (x == MATCH) == bool(y) else WRONG) for x in (AGAINST, MATCH)}
        against = cast[AGAINST] / (cast[AGAINST] + cast[MATCH])
        if y:
            against = min(against, MOST_WRONG)
        return against if v == AGAINST else 1 - against

    def logs(self, votes: Votes, own: float | None = None) -> list[float]:
        """Logarithms of the joint probabilities of these votes with either class."""
        logs = []
        for y, p in ((0, 1 - self.prior), (1, self.prior)):
            s = math.log(max(p, 1e-12))
            mine = 0.0 if own is None else own if y else 1 - own
            for i, v in enumerate(votes):
                # Whether a function votes tells nothing; how one votes that only votes against, nothing in its absence.
                if v != ABSTAIN:
                    s += math.log(self._share(i, y, votes[self.parent[i]] if self.parent[i] >= 0 else 0, v, mine))
            logs.append(s)
        return logs

    def posterior(self, votes: Votes, own: float | None = None) -> float:
        """Confidence that a pair with these votes is a match. own: the
        confidence with which one such pair was counted; its own votes are
        taken out of the counts, so that it can't vouch for itself."""
        logs = self.logs(votes, own)
        d = max(-50.0, min(50.0, logs[0] - logs[1]))
        return 1 / (1 + math.exp(d))


def _tables(counts: dict[Votes, float], soft: dict[Votes, float], parent: list[int]) -> list[dict]:
    out = []
    for i, above in enumerate(parent):
        n: dict[tuple[int, int, int], float] = {}
        for v, c in counts.items():
            up = v[above] if above >= 0 else 0
            for y, w in ((0, 1 - soft[v]), (1, soft[v])):
                n[y, up, v[i]] = n.get((y, up, v[i]), 0.0) + c * w
        out.append(n)
    return out


def _tree(counts: dict[tuple[int, ...], float], soft: dict[tuple[int, ...], float], k: int, least: float) -> list[int]:
    """Maximum spanning forest of the conditional mutual information of votes."""
    total = sum(counts.values()) or 1.0

    def information(i: int, j: int) -> float:
        s = 0.0
        for y in (0, 1):
            joint: dict[tuple[int, int], float] = {}
            for v, c in counts.items():
                joint[v[i], v[j]] = joint.get((v[i], v[j]), 0.0) + c * (soft[v] if y else 1 - soft[v])
            n = sum(joint.values())
            if n <= 0:
                continue
            for (a, b), c in joint.items():
                pa = sum(x for (p, _), x in joint.items() if p == a)
                pb = sum(x for (_, q), x in joint.items() if q == b)
                if c > 0:
                    s += c / total * math.log(c * n / (pa * pb))
        return s

    edges = sorted(((information(i, j), i, j) for i, j in itertools.combinations(range(k), 2)), reverse=True)
    group, parent = list(range(k)), [-1] * k
    links: list[tuple[int, int]] = []
    for s, i, j in edges:
        if s >= least and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
            links.append((i, j))
    seen: set[int] = set()
    for root in range(k):
        if root in seen:
            continue
        stack = [root]
        seen.add(root)
        while stack:
            a = stack.pop()
            for i, j in links:
                for x, y in ((i, j), (j, i)):
                    if x == a and y not in seen:
                        parent[y] = a
                        seen.add(y)
                        stack.append(y)
    return parent


def _maximised(counts: dict[Votes, float], least_prior: float, most: float, functions: list[str], rounds: int, least: float) -> tuple[LabelModel, dict[Votes, float]]:
    k = len(functions)
    unipolar = frozenset(i for i, f in enumerate(functions) if f in UNIPOLAR)
    total = sum(counts.values()) or 1.0
    soft = {}
    for v in counts:
        s = sum(x - 1 for x in v) - (k - len(unipolar)) * 0.55
        soft[v] = 0.001 if any(v[i] == AGAINST for i in unipolar) else 1 / (1 + math.exp(-2 * s))
    parent = [-1] * k
    model = LabelModel(least_prior, parent, [{} for _ in range(k)], unipolar)
    for r in range(rounds):
        if r == rounds // 2:
            parent = _tree(counts, soft, k, least)
        prior = min(most, max(least_prior, sum(c * soft[v] for v, c in counts.items()) / total))
        model = LabelModel(prior, parent, _tables(counts, soft, parent), unipolar)
        soft = {v: model.posterior(v, soft[v]) for v in counts}
    return model, soft


def fit(counts: dict[Votes, float], most: float = 0.5, functions: list[str] = FUNCTIONS, rounds: int = 60, least: float = 0.01) -> LabelModel:
    """Expectation maximisation from a majority vote, first with independent
    functions, then along the tree of the dependences found. most: the share of
    pairs that can be matches, where a record has one counterpart at most; below
    it the share is learned.

    Where the functions vote as if independently of each other, nothing in the
    votes tells matches from coincidence and no pair comes out as one. Only
    then is every record taken to have a counterpart, which fixes the share."""
    model, soft = _maximised(counts, 1e-6, most, functions, rounds, least)
    if counts and max(soft.values()) < 0.5:
        model, _ = _maximised(counts, most, most, functions, rounds, least)
    return model


def confidences(pairs: DataFrame) -> tuple[DataFrame, LabelModel]:
    """(votes, confidence) of every pattern among candidates, and the model."""
    # At most 3 ** functions patterns.
    counts = {tuple(map(int, r.votes)): float(r["count"]) for r in pairs.groupBy("votes").count().collect()}
    # A listing offers one product at most.
    listed = pairs.agg(F.count_distinct("listing_id").alias("n")).first().n
    model = fit(counts, min(0.5, listed / max(1.0, sum(counts.values()))))
    known = [("".join(map(str, v)), round(model.posterior(v, model.posterior(v)), 6)) for v in counts]
    return pairs.sparkSession.createDataFrame(known, "votes string, confidence double"), model


def link(listings: DataFrame, products: DataFrame, least: float = 0.5) -> DataFrame:
    """(listing_id, sku, confidence): for each listing the product it offers.

    The candidate of the highest confidence is chosen, if that is at least
    `least`. Candidates of equal confidence, as those of all sizes where the
    listing names none, are told apart by the nearest price; where the listing
    has no price either, none is chosen.

    Listings without a readable model, prices that are null, empty tables and
    repeated rows are fine: they give no row, abstain, nothing, and one row."""
    # Read three times below, so worked out once; a listing has about as many
    # pairs as a model has skus.
    pairs = cut(candidates(listings, products))
    known, _ = confidences(pairs)
    likely = pairs.join(F.broadcast(known), "votes").where(F.col("confidence") >= least)
    off = F.coalesce("off", F.lit(math.inf))
    best = likely.groupBy("listing_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), off.alias("off"), "sku")).alias("b"), F.max(F.struct("confidence", "sku")).alias("hi"), F.min(F.struct((-F.col("confidence")).alias("c"), "sku")).alias("lo"),
    )
    best = best.where((F.col("b.off") < math.inf) | (F.col("lo.sku") == F.col("hi.sku")))
    return best.select("listing_id", F.col("b.sku").alias("sku"), (-F.col("b.c")).alias("confidence"))
