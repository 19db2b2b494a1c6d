"""References to records that do not exist, or came into being too late.

Keys are cut into ranges of a fixed width. The parents of a range become one
row of sorted arrays (ids, when each came into being, ids logged as deleted),
at most WIDTH elements each, whatever the data. References follow their range,
sorted so that a task meets the arrays of a range right before the references
into it and probes them batch by batch with a binary search. Memory per task:
one range's arrays and one Arrow batch. Ranges that hold more references than
a fair share of a task are spread over several, with copies of their arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.runtime import arrow_map, cut, partitions

#: Keys per range: the most elements an array can have.
WIDTH = 1 << 14

#: Tags hold the number of a reference times this, plus year and month.
_MONTHS = 10_000_000
#: Slots per range: parent tables times the tasks a hot range may be spread
#: over. Ranges of 64-bit keys have 50 bits, which leaves this many.
_SLOTS = 1 << 13

_OUT = "ref_no int, record_id bigint, kind string, month int"


@dataclass(frozen=True)
class Reference:
    """A field of a child table that names a key of a parent table."""

    table_name: str
    field_name: str
    parent_name: str
    child_time: str = "created_at"
    parent_time: str = "created_at"
    child_id: str = "id"
    parent_id: str = "id"


def _range(key: Column) -> Column:
    return F.call_function("shiftright", key, F.lit(WIDTH.bit_length() - 1))


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _parents(tables: dict[str, DataFrame], deleted: DataFrame, names: list[tuple[int, str, str, str]]) -> DataFrame:
    """(parent_no, range, ids, times, gone): one row per range with a parent or a deletion."""
    alive = None
    for no, name, key, time in names:
        d = tables[name].where(F.col(key).isNotNull()).select(
            F.lit(no).alias("parent_no"), F.col(key).cast("bigint").alias("id"), _micros(time).alias("t"), F.lit(False).alias("gone")
        )
        alive = d if alive is None else alive.unionByName(d)
    number = F.create_map(*[x for no, name, _, _ in names for x in (F.lit(name), F.lit(no))])
    gone = deleted.where(F.col("record_id").isNotNull()).select(
        F.try_element_at(number, F.col("table_name")).alias("parent_no"), F.col("record_id").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("t"), F.lit(True).alias("gone")
    )
    both = alive.unionByName(gone.where(F.col("parent_no").isNotNull()))
    once = both.groupBy("parent_no", "id", "gone").agg(F.min("t").alias("t"))
    here = F.when(~F.col("gone"), F.struct("id", "t"))
    return (
        once.groupBy("parent_no", _range(F.col("id")).alias("range"))
        .agg(F.array_sort(F.collect_list(here)).alias("here"), F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("id")))).alias("gone"))
        .select("parent_no", "range", F.col("here.id").alias("ids"), F.transform("here", lambda x: F.coalesce(x["t"], F.lit(-(2**62)))).alias("times"), "gone")
    )


def _probe(batches: Iterator) -> Iterator:
    """Probe references against the arrays of their slot, a batch at once.
    Columns: slot, tag (-1: arrays; else number of the reference and month),
    key, record_id, t and blob. A row of arrays has the lengths of its ids and
    its deleted ids in key and record_id, and ids, times and deleted ids one
    after the other in blob.

    The arrays of all slots of a batch are laid end to end, each id as the
    number of its slot and its place in the range, which keeps them sorted; one
    binary search then serves the whole batch, however many slots it has."""
    import numpy as np
    import pyarrow as pa

    none = np.empty(0, "int64")
    open_slot, ids, times, gone = None, none, none, none  # the last slot's, for the next batch

    def spans(starts, lengths):
        """Positions of runs, one after the other."""
        before = np.cumsum(lengths) - lengths
        return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)

    def find(keys, sorted_):
        if not len(sorted_):
            return np.zeros(len(keys), bool), np.zeros(len(keys), "int64")
        k = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
        return sorted_[k] == keys, k

    for b in batches:
        if not b.num_rows:
            continue
        slot, tag, key, record, t = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        blobs = b.column(5)
        heads = np.flatnonzero(tag < 0)
        n, g = key[heads], record[heads]
        flat, starts = blobs.values.to_numpy(zero_copy_only=False), np.asarray(blobs.offsets)[heads]
        if len(heads):
            flat = flat.astype("int64", copy=False)
        at = spans(starts, n)
        place = np.concatenate([np.mod(ids, WIDTH), np.mod(flat[at], WIDTH) + np.repeat(np.arange(1, len(heads) + 1) * WIDTH, n)])
        when = np.concatenate([times, flat[at + np.repeat(n, n)]])
        at_gone = spans(starts + 2 * n, g)
        logged = np.concatenate([np.mod(gone, WIDTH), np.mod(flat[at_gone], WIDTH) + np.repeat(np.arange(1, len(heads) + 1) * WIDTH, g)])
        owner = np.cumsum(tag < 0)
        owners = np.concatenate([[-1 if open_slot is None else open_slot], slot[heads]])
        refs = np.flatnonzero(tag >= 0)
        of = owner[refs]
        mine = owners[of] == slot[refs]
        if open_slot is None:
            mine &= of > 0
        want = of * WIDTH + np.mod(key[refs], WIDTH)
        there, k = find(want, place)
        there &= mine
        late = there & (when[k] > t[refs]) if len(when) else there
        miss = np.flatnonzero(late | ~there)
        if len(heads):
            last = len(heads) - 1
            open_slot = slot[heads[last]]
            o, m, d = starts[last], n[last], g[last]
            ids, times, gone = (flat[x:y].copy() for x, y in ((o, o + m), (o + m, o + 2 * m), (o + 2 * m, o + 2 * m + d)))
        if len(miss):
            was_logged = find(want[miss], logged)[0] & mine[miss]
            kind = np.where(late[miss], 0, np.where(was_logged, 1, 2))
            tags = tag[refs][miss]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tags // _MONTHS, pa.int32()), pa.array(record[refs][miss], pa.int64()), pa.array(np.array(["late", "deleted", "missing"], dtype=object)[kind], pa.string()), pa.array(tags % _MONTHS, pa.int32())],
                names=["ref_no", "record_id", "kind", "month"],
            )


def orphans(tables: dict[str, DataFrame], deleted: DataFrame, references: list[Reference]) -> DataFrame:
    """(table_name, field_name, record_id, kind, period) for each record whose
    reference is late (the target came into being after the record), deleted
    (absent and logged as deleted) or missing (absent otherwise).

    Null references refer to nothing and are no orphans. A target without a
    time is never late, nor is a record without one; such a record's period is
    ''. Targets that occur more than once exist from their earliest time on.
    Records that occur more than once are reported once. An empty parent table
    leaves every reference missing or deleted."""
    names = sorted({(r.parent_name, r.parent_id, r.parent_time) for r in references})
    numbered = [(i, *x) for i, x in enumerate(names)]
    number = {x: i for i, x in enumerate(names)}
    parents = _parents(tables, deleted, numbered)
    refs = None
    for no, r in enumerate(references):
        d = tables[r.table_name].where(F.col(r.field_name).isNotNull()).select(
            F.lit(number[r.parent_name, r.parent_id, r.parent_time]).alias("parent_no"),
            _range(F.col(r.field_name).cast("bigint")).alias("range"),
            F.lit(no).alias("ref_no"),
            F.col(r.field_name).cast("bigint").alias("key"),
            F.col(r.child_id).cast("bigint").alias("record_id"),
            _micros(r.child_time).alias("t"),
            (F.year(r.child_time) * 100 + F.month(r.child_time)).alias("month"),
        )
        refs = d if refs is None else refs.unionByName(d)
    parts = partitions(refs.sparkSession)
    salts_most = min(_SLOTS // len(names), 4 * parts)
    if not salts_most:
        raise ValueError(f"more than {_SLOTS} parent tables")
    # References per range, counted once: a row per range, kept. Ranges with
    # more than a quarter of a fair share get more than one task; there can't
    # be more than 4 x parts of them, so their list is small.
    counts = cut(refs.groupBy("parent_no", "range").count())
    fair = counts.agg(F.sum("count") / (4 * parts)).scalar()
    split = counts.withColumn("fair", fair).where(F.col("count") > F.col("fair"))
    split = F.broadcast(split.select("parent_no", "range", F.least(F.ceil(F.col("count") / F.col("fair")), F.lit(salts_most)).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    slot = lambda salt: ((F.col("range") * len(names) + F.col("parent_no")) * salts_most + salt).cast("bigint").alias("slot")
    r = refs.join(split, ["parent_no", "range"], "left").select(
        slot(F.pmod(F.hash("record_id"), salts)), (F.col("ref_no").cast("bigint") * _MONTHS + F.coalesce("month", F.lit(0))).alias("tag"), "key", F.coalesce("record_id", F.lit(0)).alias("record_id"),
        F.coalesce("t", F.lit(2**62)).alias("t"), F.lit(None).cast("array<bigint>").alias("blob"),
    )
    p = parents.join(split, ["parent_no", "range"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    p = p.select(slot(F.col("salt")), F.lit(-1).cast("bigint").alias("tag"), F.size("ids").cast("bigint").alias("key"), F.size("gone").cast("bigint").alias("record_id"), F.lit(0).cast("bigint").alias("t"), F.concat("ids", "times", "gone").alias("blob"))
    placed = r.unionByName(p).repartition(parts, "slot").sortWithinPartitions("slot", "tag")
    probed = arrow_map(placed, _probe, _OUT)
    label = lambda field: F.element_at(F.array(*(F.lit(getattr(r, field)) for r in references)), F.col("ref_no") + 1)
    period = F.when(F.col("month") == 0, "").otherwise(F.format_string("%04d-%02d", F.floor(F.col("month") / 100), F.col("month") % 100))
    return probed.distinct().select(label("table_name").alias("table_name"), label("field_name").alias("field_name"), "record_id", "kind", period.alias("period"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field, kind and month."""
    return found.groupBy("table_name", "field_name", "kind", "period").agg(F.count("*").alias("records"))


CATALOG = [
    Reference("products", "price_book_id", "price_books", parent_time="upload_date"),
    Reference("products", "family_id", "product_families"),
    Reference("product_options", "product_id", "products"),
]


def catalog_orphans(tables: dict[str, DataFrame], deleted: DataFrame) -> DataFrame:
    """Orphans of the three references of the catalog."""
    return orphans(tables, deleted, CATALOG)
