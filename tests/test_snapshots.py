import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from pricewright.operators import snapshots

H = "snapshot_date date, sku string, loaded_at timestamp_ntz, base_price double, description string, day string, key string, word int"


def row(month, sku, price=1.0, text="x", loaded=1):
    return (date(2024, month, 1), sku, datetime(2024, 1, 1) + timedelta(minutes=loaded), price, text, "c", "c", 1)


def run(spark, data):
    return sorted((r.day.month, r.key, r.change) for r in snapshots.product_changes(spark.createDataFrame(data, H)).collect())


def test_added_removed_changed(spark):
    got = run(spark, [row(1, "a"), row(1, "b"), row(1, "c"), row(2, "A", 2.0), row(2, "C"), row(2, "d")])
    assert got == [(2, "A", "changed"), (2, "B", "removed"), (2, "D", "added")]


def test_cosmetic_differences_are_none(spark):
    assert run(spark, [row(1, "a-1", 1.001, '4" Hinge'), row(2, "A 1", 0.999, "4”  HINGE ")]) == []


def test_null_differs_from_values_but_not_from_null(spark):
    got = run(spark, [row(1, "a", None, None), row(1, "b", None), row(1, "c", 1.0, None), row(2, "a", None, None), row(2, "b", 1.0), row(2, "c", 1.0, "")])
    assert got == [(2, "B", "changed"), (2, "C", "changed")]


def test_the_row_loaded_last_holds(spark):
    assert run(spark, [row(1, "a", 1.0), row(2, "a", 9.0, loaded=1), row(2, "A", 1.0, loaded=5), row(2, "a", 1.0, loaded=5)]) == []


def test_no_rows_no_changes(spark):
    assert run(spark, []) == []
    assert run(spark, [row(1, "a"), row(1, None)]) == []


def test_a_word_that_vanishes_and_comes_back(spark):
    assert run(spark, [row(1, "a"), row(2, "b"), row(3, "a")]) == [(2, "A", "removed"), (2, "B", "added"), (3, "A", "added"), (3, "B", "removed")]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    data = [row(m, f"s{k}", float(rnd.randrange(2)), rnd.choice("xy")) for m in range(1, 6) for k in range(300) if rnd.random() < 0.7]
    at = {(r[0].month, r[1].upper()): (r[3], r[4]) for r in data}
    want = []
    for m in range(2, 6):
        for k in {k for _, k in at}:
            o, n = at.get((m - 1, k)), at.get((m, k))
            if o != n:
                want.append((m, k, "added" if o is None else "removed" if n is None else "changed"))
    assert run(spark, data) == sorted(want)


def test_ordinals_persist(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    first = snapshots.with_ordinals(keys(*"abcdef"), buckets=2).select("key", "bucket", "ordinal")
    second = snapshots.with_ordinals(keys(*"bdfxyz"), first, buckets=2).select("key", "bucket", "ordinal")
    old = {r.key: (r.bucket, r.ordinal) for r in first.collect()}
    new = {r.key: (r.bucket, r.ordinal) for r in second.collect()}
    assert all(new[k] == old[k] for k in "bdf")
    assert len(set(old.values()) | set(new.values())) == len(set(old) | set(new))


def test_bit_63_is_a_bit_like_others(spark):
    data = [row(m, f"k{i:03}", 1.0 + (m == 2 and i % 5 == 0)) for m in (1, 2) for i in range(200)]
    got = snapshots.snapshot_changes(
        spark.createDataFrame(data, H).select(F.col("snapshot_date").alias("d"), F.col("sku").alias("k"), F.col("loaded_at").alias("l"), F.col("base_price").alias("v")), "d", "k", "l", ["v"], buckets=1
    )
    assert {r.key for r in got.collect()} == {f"k{i:03}" for i in range(0, 200, 5)}


def test_a_store_takes_deliveries_one_at_a_time(spark, tmp_path):
    rnd = random.Random(9)
    data = [row(m, f"s{k}", float(rnd.randrange(2))) for m in range(1, 6) for k in range(200) if rnd.random() < 0.6]
    store = snapshots.Store(spark, str(tmp_path / "s"), ["cents", "text"], buckets=3)
    got, ordinals = [], {}
    for months in ([1, 2], [3], [3], [4, 5]):  # the third is a repeat
        rows = snapshots.product_rows(spark.createDataFrame([r for r in data if r[0].month in months], H))
        got += [(r.day.month, r.key, r.change) for r in store.deliver(rows, "snapshot_date", "sku", "loaded_at").collect()]
        # A version without _SUCCESS is no version.
        (tmp_path / "s" / "words" / "v99").mkdir(exist_ok=True)
        now = {r.key: (r.bucket, r.ordinal) for r in spark.read.parquet(f"{store.path}/dictionary/v{store._version()}").collect()}
        assert all(now[k] == v for k, v in ordinals.items())
        ordinals = now
    assert sorted(got) == run(spark, data)
    assert len(set(ordinals.values())) == len(ordinals) == len({r[1] for r in data})
