"""What changed between full snapshots.

Keys are mapped to persistent ordinals (bucket, number within the bucket) by a
dictionary that only ever grows. A snapshot is stored as words of 64 ordinals:
one bitmap word of the keys that are present, with the vectors of the compared
columns aligned to its set bits; words without a key are not stored, which is
the compression. Keys stand in the dictionary alone. Consecutive snapshots are
compared word by word: AND-NOT of the bitmaps gives additions and removals, and
the aligned vectors, read at the bits of the AND, give the changes among common
keys. All of it is JVM-side expressions.

Many snapshots at once are compared by snapshot_changes. For deliveries that
come one at a time, a Store keeps the dictionary and the words of the last
delivery as tables: Store.deliver compares a new delivery with them and writes
the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright.functions.keys import cents, plain_sku, text_form
from pricewright.runtime import cut, finished, forget

WORD = 64
#: Buckets of a dictionary. At 4 million keys a bucket they hold 4 billion.
BUCKETS = 1024


def latest_in_snapshot(df: DataFrame, day: str, key: str, loaded: str, values: list[str]) -> DataFrame:
    """Per snapshot and key the row loaded last; ties fall to the greater
    values. Rows without day or key are no records of a snapshot."""
    return (
        df.where(F.col(day).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(day).alias("day"), F.col(key).alias("key"))
        .agg(F.max(F.struct(loaded, *values)).alias("row"))
        .select("day", "key", *(F.col("row")[c].alias(c) for c in values))
    )


def with_ordinals(keyed: DataFrame, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add (bucket, ordinal) to rows with a key; rows of one key get the same.

    known: the dictionary (key, bucket, ordinal) of earlier deliveries; its keys
    keep their ordinals, new keys go on after the bucket's last, in key order.
    Rows and dictionary go to their buckets in one exchange, which later steps
    by bucket reuse. The number of buckets is part of the dictionary, must not
    change, and is the most tasks these steps can use."""
    df = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    if known is None:
        within = Window.partitionBy("bucket").orderBy("key")
        return df.repartition("bucket").withColumn("ordinal", F.dense_rank().over(within).cast("bigint") - 1)
    old = known.select("key", "bucket", F.col("ordinal").alias("_old"), F.lit(True).alias("_known"))
    both = df.withColumns({"_old": F.lit(None).cast("bigint"), "_known": F.lit(False)}).unionByName(old, allowMissingColumns=True).repartition("bucket")
    bucket = Window.partitionBy("bucket")
    both = both.withColumns({"_own": F.max("_old").over(Window.partitionBy("bucket", "key")), "_used": F.coalesce(F.max("_old").over(bucket) + 1, F.lit(0))})
    fresh = Window.partitionBy("bucket", F.col("_own").isNull()).orderBy("key")
    number = F.coalesce("_own", F.col("_used") + F.dense_rank().over(fresh) - 1).cast("bigint")
    return both.withColumn("ordinal", number).where(~F.col("_known")).drop("_old", "_own", "_used", "_known")


def dictionary(placed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, bucket, ordinal) of all keys known and new."""
    new = placed.select("key", "bucket", "ordinal")
    return (new if known is None else new.unionByName(known.select("key", "bucket", "ordinal"))).distinct()


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos)


def encode(rows: DataFrame, values: list[str]) -> DataFrame:
    """Words of each snapshot: (bucket, word, day, bits, cells), cells sorted by
    the bit they belong to. rows: (bucket, ordinal, day, *values)."""
    pos = (F.col("ordinal") % WORD).cast("int")
    return (
        rows.withColumn("pos", pos)
        .withColumn("word", F.floor(F.col("ordinal") / WORD))
        .groupBy("bucket", "word", "day")
        .agg(
            F.bit_or(_bit(F.col("pos"))).alias("bits"),
            F.array_sort(F.collect_list(F.struct("pos", *values))).alias("cells"),
        )
    )


def _at(bits: Column, cell: Column) -> Column:
    """Whether a bitmap word has the bit of this cell."""
    return bits.bitwiseAND(_bit(cell["pos"])) != 0


def compare(words: DataFrame, days: DataFrame, values: list[str]) -> DataFrame:
    """(bucket, ordinal, day, change) between each snapshot and the one before.

    days: (day, no, next_day), one row per snapshot."""
    by_word = Window.partitionBy("bucket", "word").orderBy("no")
    d = words.join(F.broadcast(days), "day")
    last = F.lag(F.struct("no", "bits", "cells")).over(by_word)
    nxt = F.lead(F.struct("no", "bits")).over(by_word)
    d = d.select("bucket", "word", "day", "no", "next_day", "bits", "cells", last.alias("p"), nxt.alias("n"))
    zero = F.lit(0).cast("bigint")
    before = F.when(F.col("p.no") == F.col("no") - 1, F.col("p.bits")).otherwise(zero)
    after = F.when(F.col("n.no") == F.col("no") + 1, F.col("n.bits")).otherwise(zero)
    d = d.select(
        "bucket", "word", "day", "next_day", "cells", F.col("p.cells").alias("was"),
        F.when(F.col("no") > 1, F.col("bits").bitwiseAND(F.bitwise_not(before))).otherwise(zero).alias("added"),
        F.when(F.col("no") > 1, F.col("bits").bitwiseAND(before)).otherwise(zero).alias("common"),
        F.when(F.col("next_day").isNotNull(), F.col("bits").bitwiseAND(F.bitwise_not(after))).otherwise(zero).alias("removed"),
    )
    # Words in which nothing came, went or differs end here.
    d = d.where((F.col("added") != 0) | (F.col("removed") != 0) | ((F.col("common") != 0) & ~F.col("cells").eqNullSafe(F.col("was"))))
    out = lambda cells, day, change: F.transform(cells, lambda c: F.struct(day.alias("day"), c["pos"].alias("pos"), F.lit(change).alias("change")))
    # Both vectors, cut to the common bits, are aligned: same length, same order.
    aligned = F.arrays_zip(
        F.filter("cells", lambda c: _at(F.col("common"), c)).alias("new"),
        F.filter("was", lambda c: _at(F.col("common"), c)).alias("old"),
    )

    def differs(z: Column) -> Column:
        any_ = F.lit(False)
        for v in values:
            any_ = any_ | ~z["new"][v].eqNullSafe(z["old"][v])
        return any_

    changed = F.when(F.col("common") != 0, F.transform(F.filter(aligned, differs), lambda z: z["new"]))
    found = F.concat(
        out(F.filter("cells", lambda c: _at(F.col("added"), c)), F.col("day"), "added"),
        out(F.filter("cells", lambda c: _at(F.col("removed"), c)), F.col("next_day"), "removed"),
        F.coalesce(out(changed, F.col("day"), "changed"), F.array()),
    )
    d = d.select("bucket", "word", F.inline(found))
    return d.select("bucket", (F.col("word") * WORD + F.col("pos")).alias("ordinal"), "day", "change")


def _ordered(days: DataFrame) -> DataFrame:
    """(day, no, next_day) of distinct days: bounded by the calendar, not by the data."""
    order = Window.orderBy("day")
    return days.select("day", F.row_number().over(order).alias("no"), F.lead("day").over(order).alias("next_day"))


def snapshot_changes(
    df: DataFrame, day: str, key: str, loaded: str, values: list[str], known: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """(day, key, change): added, removed or changed between consecutive
    snapshots. Null differs from any value, not from null. The first snapshot
    and an empty table give no rows; extra columns are ignored."""
    rows = latest_in_snapshot(df.select(day, key, loaded, *values), day, key, loaded, values)
    # Read for the words, the dictionary and the days; kept, so that neither the
    # input nor its aggregation is read again.
    placed = cut(with_ordinals(rows, known, buckets))
    words = encode(placed, values)
    days = _ordered(placed.select("day").distinct())
    found = compare(words, days, values)
    return found.join(dictionary(placed, known), ["bucket", "ordinal"]).select("day", "key", "change")


class Store:
    """The dictionary and the last delivery's words, kept under a path.

    A delivery is written as a new version in a folder of its own; one that was
    left unfinished has no _SUCCESS in its last table and is not seen, so a
    delivery may simply be given again."""

    def __init__(self, spark: SparkSession, path: str, values: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.values, self.buckets = spark, path.rstrip("/"), values, buckets

    def _version(self) -> int:
        return max(finished(self.spark, self.path, "words"), default=-1)

    def deliver(self, df: DataFrame, day: str, key: str, loaded: str) -> DataFrame:
        """(day, key, change) of a delivery, one or more days of snapshots, to
        the one before and within itself; no rows for the first day ever. Days
        up to the last stored one count as delivered and are ignored."""
        rows = latest_in_snapshot(df.select(day, key, loaded, *self.values), day, key, loaded, self.values)
        v = self._version()
        known = was = None
        if v >= 0:
            known, was = (self.spark.read.parquet(f"{self.path}/{t}/v{v}") for t in ("dictionary", "words"))
            rows = rows.where(F.coalesce(F.col("day") > was.agg(F.max("day")).scalar(), F.lit(True)))
        rows = cut(rows)
        placed = with_ordinals(rows, known, self.buckets)
        keys, words = f"{self.path}/dictionary/v{v + 1}", f"{self.path}/words/v{v + 1}"
        dictionary(placed, known).write.mode("overwrite").parquet(keys)
        fresh = encode(placed, self.values)
        every = cut(fresh if was is None else fresh.unionByName(was))
        days = _ordered(every.select("day").distinct())
        newest = days.where("next_day is null").select("day")
        every.join(F.broadcast(newest), "day", "left_semi").write.mode("overwrite").parquet(words)
        for t in ("words", "dictionary"):  # the version before stays, for readers of it
            forget(self.spark, f"{self.path}/{t}/v{v - 1}")
        return compare(every, days, self.values).join(self.spark.read.parquet(keys), ["bucket", "ordinal"]).select("day", "key", "change")


def product_rows(hager_products: DataFrame) -> DataFrame:
    """Deliveries in comparison form: plain sku, whole cents, and a 64-bit digest
    of the description regardless of case, spacing and quote marks. Only
    descriptions of one sku are compared, so a digest misses a change with
    probability 2**-64."""
    return hager_products.select(
        "snapshot_date", plain_sku(F.col("sku")).alias("sku"), "loaded_at", cents(F.col("base_price")).alias("cents"),
        F.when(F.col("description").isNotNull(), F.xxhash64(text_form(F.col("description")))).alias("text"),
    )


def product_changes(hager_products: DataFrame) -> DataFrame:
    """Changes of base_price and description between deliveries, by plain sku."""
    return snapshot_changes(product_rows(hager_products), "snapshot_date", "sku", "loaded_at", ["cents", "text"])


def latest_product_changes(hager_products: DataFrame, path: str) -> DataFrame:
    """The same for the last delivery alone, against a store that got all
    deliveries before it."""
    rows = product_rows(hager_products).where("snapshot_date is not null")
    last = rows.agg(F.max("snapshot_date")).scalar()
    store = Store(rows.sparkSession, path, ["cents", "text"])
    store.deliver(rows.where(F.col("snapshot_date") < last), "snapshot_date", "sku", "loaded_at")
    return store.deliver(rows, "snapshot_date", "sku", "loaded_at")
