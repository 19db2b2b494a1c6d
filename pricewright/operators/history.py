"""History of changing attributes: versions of an entity with the days each was valid.

Shape of the plan: one aggregation to the row that holds per entity and day
(partial on the map side, so an entity with a third of all rows shrinks before
it is shuffled), one to a sorted array per entity, a fold over that array that
appends a version only upon change, and an explode with end times. An
entity's array has at most one element per calendar day, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_rows(df: DataFrame, entity: str, day: str, attributes: list[str], rank: list[str]) -> DataFrame:
    """The row that holds for each entity and day: the last by rank, nulls
    first, full ties broken by the attributes' own order. Rows without entity
    or day can't be placed and have no part in the history."""
    order = F.struct(*(F.col(c) for c in [*rank, *attributes]))
    return (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).alias("day"))
        .agg(F.max(order).alias("row"))
        .select("entity", "day", *(F.col("row")[c].alias(c) for c in attributes))
    )


def _differs(a: Column, b: Column, attributes: list[str]) -> Column:
    same = F.lit(True)
    for c in attributes:
        same = same & a[c].eqNullSafe(b[c])
    return ~same


def fold_versions(held: DataFrame, attributes: list[str]) -> DataFrame:
    """Versions of each entity: (entity, version_no, valid_from, valid_to, *attributes).

    A version starts at the first row and wherever an attribute differs from
    the row before; null equals null. valid_to is the start of the next
    version, null for the last. Empty in, empty out."""
    rows = held.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("day", *attributes))).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        changed = (F.size(acc) == 0) | _differs(F.element_at(acc, -1), x, attributes)
        return F.when(changed, F.concat(acc, F.array(x))).otherwise(acc)

    empty = F.slice(F.col("rows"), 1, 0)
    folded = rows.select("entity", F.aggregate("rows", empty, step).alias("versions"))
    numbered = folded.select(
        "entity",
        F.inline(
            F.transform(
                "versions",
                lambda v, i: F.struct(
                    (i + 1).alias("version_no"),
                    v["day"].alias("valid_from"),
                    F.get(F.col("versions"), i + 1)["day"].alias("valid_to"),
                    *(v[c].alias(c) for c in attributes),
                ),
            )
        ),
    )
    return numbered


def attribute_history(df: DataFrame, entity: str, day: str, attributes: list[str], rank: list[str]) -> DataFrame:
    """Full history of the attributes; see held_rows and fold_versions.

    Columns beyond the named ones are ignored, so clashing names are harmless;
    repeated rows count once."""
    cols = list(dict.fromkeys([entity, day, *attributes, *rank]))
    return fold_versions(held_rows(df.select(*cols), entity, day, attributes, rank), attributes)


def dated(products: DataFrame, price_books: DataFrame) -> DataFrame:
    """Products with a day each: their own effective_date, else the one of their
    price book (the earliest, where copies of a book disagree). Only rows
    without a day meet the books; rows that find none have no day and drop out."""
    cols = ["id", "sku", "base_price", "is_active", "retired_date", "updated_at"]
    own = products.where(F.col("effective_date").isNotNull()).select(*cols, "effective_date")
    books = (
        price_books.where(F.col("effective_date").isNotNull())
        .groupBy(F.col("id").alias("price_book_id"))
        .agg(F.min("effective_date").alias("effective_date"))
    )
    bare = products.where(F.col("effective_date").isNull()).select(*cols, "price_book_id")
    lent = bare.join(books, "price_book_id")
    return own.unionByName(lent.select(*cols, "effective_date"))


def product_history(products: DataFrame, price_books: DataFrame) -> DataFrame:
    """Versions of every sku's base_price, is_active and retired_date. A version
    ends at the start of the next or at its own retired_date, if that is later
    than its start, whichever is earlier; null if neither exists."""
    from pricewright.functions.keys import plain_sku

    rows = dated(products, price_books).withColumn("entity", plain_sku(F.col("sku")))
    versions = attribute_history(rows, "entity", "effective_date", ["base_price", "is_active", "retired_date"], ["updated_at", "id"])
    own_end = F.when(F.col("retired_date") > F.col("valid_from"), F.col("retired_date"))
    return versions.withColumn("valid_to", F.least("valid_to", own_end))
