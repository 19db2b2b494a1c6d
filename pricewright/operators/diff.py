"""Differences between two editions of a book: matching, changes, summaries.

Rows carry `pos`, the place in their edition, as every rule about order needs
it. Matching is an equi-join on a composed key, then the best partners of what
is left inside blocks; there is no join without a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.runtime import arrow_map, cut


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# Where an item's and an option's amount is looked for, in this order.
PRICES = ("base_price", "price", "list_price", "net_price")
AMOUNTS = ("adder_value", "amount", "price", "cost")


def first_number(names: Sequence[str], columns: Sequence[str]) -> Column:
    """The first of the names among the columns that reads as a number, else 0."""
    return F.coalesce(*(F.col(n).try_cast("double") for n in names if n in columns), F.lit(0.0))


def items_of(books: DataFrame, keys: Sequence[str] = ("products", "items", "product_data")) -> DataFrame:
    """The items of books that hold them as an array under one of several names;
    the first name that is there and not null counts. An item may be wrapped in
    a struct with a field `value`. pos is the place in the array."""
    arrays = []
    for k in keys:
        if k in books.columns:
            inner = books.schema[k].dataType.elementType
            arrays.append(F.transform(k, lambda x: x["value"]) if "value" in getattr(inner, "names", []) else F.col(k))
    d = books.select(F.posexplode(F.coalesce(*arrays)).alias("pos", "item"))
    return d.select(F.col("pos").cast("bigint").alias("pos"), "item.*")


def match_key() -> Column:
    """manufacturer#family#model#size#finish in comparison form."""
    return F.concat_ws(
        "#", F.lower(_text("manufacturer")), F.lower(_text("family")), F.regexp_replace(F.upper(F.coalesce(F.nullif("model", F.lit("")), _text("sku"))), r"[\s\-_]", ""),
        F.regexp_replace(F.lower(_text("size")), "[\"']", ""), F.regexp_replace(F.upper(_text("finish")), "[^A-Z0-9]", ""),
    )


def block_key() -> Column:
    """manufacturer#family: what a renamed item must keep."""
    return F.concat_ws("#", F.lower(_text("manufacturer")), F.lower(_text("family")))


def search_text() -> Column:
    """What a fuzzy match looks at."""
    parts = (F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("model", "sku", "description", "family", "size", "finish"))
    return F.upper(F.concat_ws(" ", *parts))


def keyed(edition: DataFrame) -> DataFrame:
    """An edition's rows with their keys; rows without model and sku drop out."""
    named = (F.coalesce(F.col("model"), F.lit("")) != "") | (F.coalesce(F.col("sku"), F.lit("")) != "")
    return edition.where(named).withColumns({"match_key": match_key(), "block": block_key(), "search": search_text(), "amount": first_number(PRICES, edition.columns)})


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def exact_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (o, n) of equal match keys; of new rows with one key the last counts."""
    o = old.select("match_key", F.struct(*old.columns).alias("o"))
    n = last_by(new, "match_key", "pos").select("match_key", F.struct(*new.columns).alias("n"))
    return o.join(n, "match_key").select("o", "n", F.lit("exact").alias("method"), F.lit(100.0).alias("score"))


def residuals(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What exact matching leaves on either side."""
    return old.join(new.select("match_key"), "match_key", "left_anti"), new.join(old.select("match_key"), "match_key", "left_anti")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s\-_]", "")


def plausible(a: Column, b: Column) -> Column:
    """Models share at least a fifth of the shorter one's characters."""
    x, y = _stripped(a), _stripped(b)
    common = F.size(F.array_intersect(F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))))
    least = F.least(F.length(x), F.length(y))
    return (least == 0) | (common >= least * 0.2)


#: Rows of either side that are compared at once.
CHUNK = 1024


def _nearest(weights: tuple[float, ...], top: int, least: float, strict: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from pricewright.functions.similarity import ratios

        for b in batches:
            out: list[tuple] = []
            for olds, news in zip(b.column("olds").to_pylist(), b.column("news").to_pylist()):
                scorers = [ratios([n["texts"][i] for n in news]) for i in range(len(weights))]
                places = np.array([n["pos"] for n in news])
                for o in olds:
                    score = sum(w * f(t) for w, f, t in zip(weights, scorers, o["texts"]))
                    k = np.flatnonzero(score > least if strict else score >= least)
                    for j in k[np.lexsort((places[k], -score[k]))][:top]:
                        out.append((o["pos"], int(places[j]), float(score[j])))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["op", "np", "score"])

    return run


def nearest(old: DataFrame, new: DataFrame, block: str, texts: dict[str, float], top: int, least: float, strict: bool = False) -> DataFrame:
    """(op, np, score, rank): for each old row the `top` new rows of its block
    with the highest weighted similarity, from `least` on; ties go to the
    smaller pos. pos must be unique on either side; null texts count as empty.

    A block is cut into chunks of at most about CHUNK rows on either side; every
    pair of chunks is one row of work, whose scores never leave it but for each
    old row's best. A block of any size thus spreads over all tasks, and no
    pair of rows is ever a row of a table."""
    def chunked(d: DataFrame) -> DataFrame:
        n = d.groupBy(block).agg(F.count("*").alias("_rows"))
        cell = F.struct(F.col("pos").cast("bigint").alias("pos"), F.array(*(F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts)).alias("texts"))
        d = d.join(n, block).select(F.col(block).alias("block"), F.pmod(F.xxhash64("pos"), F.ceil(F.col("_rows") / CHUNK)).cast("int").alias("chunk"), cell.alias("cell"))
        return d.groupBy("block", "chunk").agg(F.collect_list("cell").alias("cells"))

    o = chunked(old).select("block", F.col("cells").alias("olds"))
    n = chunked(new).select("block", F.col("cells").alias("news"))
    work = o.join(n, "block").select("olds", "news")
    # As many tasks as cores can take: the rows are few and dear.
    work = work.repartition(4 * work.sparkSession.sparkContext.defaultParallelism)
    found = arrow_map(work, _nearest(tuple(texts.values()), top, least, strict), "op bigint, np bigint, score double")
    w = Window.partitionBy("op").orderBy(F.col("score").desc(), "np")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def fuzzy_pairs(old: DataFrame, new: DataFrame, threshold: float = 70.0, top: int = 3) -> DataFrame:
    """The best `top` candidates of each old row in its block, with scores of at
    least the threshold. Texts that occur more than once on the new side stand
    for their last row."""
    n = last_by(new.withColumn("_t", F.concat_ws("\u0001", "block", "search")), "_t", "pos").drop("_t")
    # Places and scores alone, at most `top` per old row, read twice by the assignment.
    p = cut(nearest(old, n, "block", {"search": 1.0}, top, threshold))
    p = p.join(old.select(F.col("pos").alias("op"), F.struct(*old.columns).alias("o")), "op").join(n.select(F.col("pos").alias("np"), F.struct(*new.columns).alias("n")), "np")
    return p.where(plausible(F.col("o.model"), F.col("n.model"))).select("o", "n", "score", "rank")


def assign(pairs: DataFrame) -> DataFrame:
    """Each old row, in order of pos, takes its best candidate not yet taken.

    Found in rounds, as the one stable matching in which every new row prefers
    the old row that comes first: each old row asks for the best candidate it
    has left, and whoever comes after the first to ask for a new row loses that
    candidate for good. It is done when nobody loses any. A round is a pass over
    candidates, at most `top` per old row; no block is ever gathered."""
    q = cut(pairs.select(F.col("o.pos").alias("op"), F.col("n.pos").alias("np"), "rank"))
    left = q.count()
    while True:
        asked = q.groupBy("op").agg(F.min_by("np", "rank").alias("np"))
        first = asked.groupBy("np").agg(F.min("op").alias("first"))
        q = cut(q.join(first, "np", "left").where(F.col("first").isNull() | (F.col("op") <= F.col("first"))).select("op", "np", "rank"))
        before, left = left, q.count()
        if left == before:
            break
    chosen = q.groupBy("op").agg(F.min_by("np", "rank").alias("np"))
    keyed_pairs = pairs.withColumns({"op": F.col("o.pos"), "np": F.col("n.pos")})
    return keyed_pairs.join(chosen, ["op", "np"]).select("o", "n", F.lit("fuzzy").alias("method"), "score")


def matches(old: DataFrame, new: DataFrame, fuzzy: bool = True, threshold: float = 70.0) -> DataFrame:
    """All rows of both editions, paired where they match: (o, n, method,
    score, confidence). Rows only in the old edition are removed, only in the
    new one added."""
    old, new = keyed(old), keyed(new)
    exact = exact_matches(old, new)
    ro, rn = residuals(old, new)
    # The assignment is read three times below and is small: at most a row per
    # residual. It is kept, not worked out again.
    found = cut(assign(fuzzy_pairs(ro, rn, threshold))) if fuzzy else None
    left = ro.join(found.select(F.col("o.pos").alias("pos")), "pos", "left_anti") if fuzzy else ro
    right = rn.join(found.select(F.col("n.pos").alias("pos")), "pos", "left_anti") if fuzzy else rn
    gone = left.select(F.struct(*old.columns).alias("o"), F.lit(None).cast(exact.schema["n"].dataType).alias("n"), F.lit("removed").alias("method"), F.lit(100.0).alias("score"))
    come = right.select(F.lit(None).cast(exact.schema["o"].dataType).alias("o"), F.struct(*new.columns).alias("n"), F.lit("added").alias("method"), F.lit(100.0).alias("score"))
    every = exact.unionByName(found) if fuzzy else exact
    every = every.unionByName(gone).unionByName(come)
    return every.withColumn("confidence", F.when(F.col("method") == "fuzzy", F.least(F.col("score") / 100, F.lit(0.95))).otherwise(1.0))


def confidence_level(c: Column, exact: float = 0.98, high: float = 0.8, medium: float = 0.6, low: float = 0.4) -> Column:
    """Level of a confidence by thresholds."""
    return F.when(c >= exact, "exact").when(c >= high, "high").when(c >= medium, "medium").when(c >= low, "low").otherwise("very_low")


def item_changes(m: DataFrame) -> DataFrame:
    """(match_key, change, old_value, new_value, percent, confidence): the rows
    each pair gives, and one per removed or added row."""
    price = lambda s: F.col(f"{s}.amount")
    text = lambda s, c: F.trim(F.coalesce(F.col(f"{s}.{c}"), F.lit("")))
    paired = F.col("method").isin("exact", "fuzzy")
    one = lambda when, change, a, b, pct=None: F.when(when, F.struct(F.lit(change).alias("change"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"), (pct if pct is not None else F.lit(None).cast("double")).alias("percent")))
    nil = F.lit(None).cast("string")
    rows = F.array(
        one(F.col("method") == "removed", "removed", F.col("o.sku"), nil),
        one(F.col("method") == "added", "added", nil, F.col("n.sku")),
        one(paired & (price("o") != price("n")), "price_changed", F.round(price("o"), 4), F.round(price("n"), 4), F.when(price("o") > 0, F.round((price("n") - price("o")) / price("o") * 100, 4))),
        one(paired & (text("o", "description") != text("n", "description")) & (text("o", "description") != "") & (text("n", "description") != ""), "description_changed", text("o", "description"), text("n", "description")),
        one((F.col("method") == "fuzzy") & (text("o", "model") != text("n", "model")), "renamed", text("o", "model"), text("n", "model")),
    )
    key = F.coalesce(F.col("o.match_key"), F.col("n.match_key"))
    return m.select(key.alias("match_key"), "confidence", F.explode(F.array_compact(rows)).alias("c")).select("match_key", "c.*", "confidence")


def keyed_changes(old: DataFrame, new: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(key, change, old_value, new_value): added, removed and, with a value
    column, changed keys by a full outer join; of repeated keys the last by pos
    counts. Null differs from any value."""
    o = last_by(old, key, "pos").select(F.col(key), F.lit(True).alias("_o"), (F.col(value) if value else F.lit(None).cast("double")).alias("old_value"))
    n = last_by(new, key, "pos").select(F.col(key), F.lit(True).alias("_n"), (F.col(value) if value else F.lit(None).cast("double")).alias("new_value"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return o.join(n, key, "full").select(key, change.alias("change"), "old_value", "new_value").where("change is not null")


def percent_text(percent: Column) -> Column:
    """A change in percent as people read it: +5.0%, -0.4%."""
    return F.when(percent.isNotNull(), F.format_string("%+.1f%%", percent))


def rule_signature() -> Column:
    """What makes two rules the same: type, source, target and percentage."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rule_type", "source_finish", "target_finish", "percentage"))
    return F.concat_ws("|", *parts)


def match_summary(m: DataFrame) -> DataFrame:
    """Counts of matches by method and level of confidence. Added and removed
    rows have full confidence, so they count as exact_level, but not as exact."""
    level = confidence_level(F.col("confidence"))
    n = lambda x: F.count_if(F.col("method") == x)
    return m.agg(
        F.count("*").alias("matches"), n("exact").alias("exact"), n("fuzzy").alias("fuzzy"), n("added").alias("added"), n("removed").alias("removed"),
        *(F.count_if(level == x).alias(f"{x}_level") for x in ("exact", "high", "medium", "low", "very_low")), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


def summary(changes: DataFrame) -> DataFrame:
    """Counts by kind of change and the spread of price changes."""
    n = lambda k: F.count_if(F.col("change") == k)
    p = F.col("percent")
    return changes.agg(
        F.count("*").alias("changes"), n("added").alias("added"), n("removed").alias("removed"), n("price_changed").alias("price_changed"), n("description_changed").alias("description_changed"), n("renamed").alias("renamed"),
        F.count_if(p > 0).alias("increases"), F.count_if(p < 0).alias("decreases"), F.round(F.avg(p), 4).alias("avg_percent"), F.round(F.min(p), 4).alias("min_percent"), F.round(F.max(p), 4).alias("max_percent"),
    )


def sku_changes(old: DataFrame, new: DataFrame, block: str | None = None, least: float = 70.0, second_pass: bool = True) -> DataFrame:
    """The plainer comparison on sku alone: (sku, change, old_value, new_value,
    percent). Of repeated skus the last row counts.

    Rows of either side without the other's are retired_product and
    new_product; common skus give price_change (where both prices are there and
    aren't zero), description_change and status_change. With a block column
    (the book's manufacturer), a sku that is gone is compared with those that
    are new by half its sku's similarity, three tenths of the description's and
    a fifth of the model's; the best above `least` is a fuzzy_match, and both
    sides then count as neither retired nor new. A new sku may serve several
    old ones; ties go to the smaller sku. The second pass gives further
    fuzzy_match rows by the mean of sku and description."""
    o = last_by(old.where("sku is not null"), "sku", "pos")
    n = last_by(new.where("sku is not null"), "sku", "pos")
    gone, come = o.join(n.select("sku"), "sku", "left_anti"), n.join(o.select("sku"), "sku", "left_anti")
    row = lambda change, a, b, pct=None: F.struct(F.lit(change).alias("change"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"), (F.lit(None).cast("double") if pct is None else pct).alias("percent"))
    nil = F.lit(None).cast("string")
    found = None
    if block:
        by_sku = lambda d: d.withColumn("pos", F.row_number().over(Window.partitionBy(block).orderBy("sku")).cast("bigint"))
        # pos is the rank of the sku in its block, which breaks ties; the block makes it unique.
        a, b = cut(_numbered(by_sku(gone), block)), cut(_numbered(by_sku(come), block))
        names = lambda p: p.join(a.select(F.col("pos").alias("op"), F.col("sku").alias("old_sku")), "op").join(b.select(F.col("pos").alias("np"), F.col("sku").alias("new_sku")), "np")
        found = cut(names(nearest(a, b, block, {"sku": 0.5, "description": 0.3, "model": 0.2}, 1, least, strict=True)).select("old_sku", "new_sku", "score"))
        gone = gone.join(found.select(F.col("old_sku").alias("sku")), "sku", "left_anti")
        come = come.join(found.select(F.col("new_sku").alias("sku")), "sku", "left_anti")
    both = o.select("sku", F.struct("base_price", "description", *(["is_active"] if "is_active" in o.columns else [])).alias("o")).join(n.select("sku", F.struct(*[c for c in ("base_price", "description", "is_active") if c in n.columns]).alias("n")), "sku")
    p0, p1 = F.col("o.base_price").cast("double"), F.col("n.base_price").cast("double")
    kinds = [
        F.when(~p0.eqNullSafe(p1) & F.coalesce((p0 != 0) & (p1 != 0), F.lit(False)), row("price_change", p0, p1, (p1 - p0) / p0 * 100)),
        F.when(~F.col("o.description").eqNullSafe(F.col("n.description")), row("description_change", F.col("o.description"), F.col("n.description"))),
    ]
    if "is_active" in o.columns:
        kinds.append(F.when(~F.col("o.is_active").eqNullSafe(F.col("n.is_active")), row("status_change", F.col("o.is_active"), F.col("n.is_active"))))
    out = both.select("sku", F.explode(F.array_compact(F.array(*kinds))).alias("c")).select("sku", "c.*")
    out = out.unionByName(gone.select("sku", row("retired_product", F.col("sku"), nil).alias("c")).select("sku", "c.*")).unionByName(come.select("sku", row("new_product", nil, F.col("sku")).alias("c")).select("sku", "c.*"))
    if found is not None:
        matched = lambda d: d.select(F.col("new_sku").alias("sku"), row("fuzzy_match", F.col("old_sku"), F.col("new_sku"), F.col("score")).alias("c")).select("sku", "c.*")
        out = out.unionByName(matched(found))
        if second_pass:
            out = out.unionByName(matched(names(nearest(a, b, block, {"sku": 0.5, "description": 0.5}, 1, least, strict=True))))
    return out


def _numbered(d: DataFrame, block: str) -> DataFrame:
    """pos made unique over blocks: the block's hash above the rank in it."""
    return d.withColumn("pos", F.call_function("shiftleft", F.pmod(F.xxhash64(block), F.lit(1 << 30)), F.lit(32)) + F.col("pos"))


def sku_summary(changes: DataFrame) -> DataFrame:
    """Counts by kind and the spread of price changes other than zero."""
    n = lambda k: F.count_if(F.col("change") == k).alias(k)
    p = F.when((F.col("change") == "price_change") & (F.col("percent") != 0), F.col("percent"))
    return changes.agg(
        F.count("*").alias("total"), *(n(k) for k in ("new_product", "retired_product", "price_change", "description_change", "status_change", "fuzzy_match")),
        F.round(F.avg(p), 4).alias("avg_percent"), F.round(F.max(p), 4).alias("max_increase"), F.round(F.min(p), 4).alias("max_decrease"),
    )
