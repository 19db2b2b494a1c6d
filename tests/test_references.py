import random
from datetime import datetime, timedelta

from pricewright.operators import references

T0 = datetime(2024, 1, 1)
CHILD = "id bigint, price_book_id bigint, family_id bigint, created_at timestamp_ntz, range string, salt int"
BOOK = "id bigint, upload_date timestamp_ntz"
FAMILY = "id bigint, created_at timestamp_ntz"
OPTION = "id bigint, product_id bigint, created_at timestamp_ntz"
GONE = "table_name string, record_id bigint"


def run(spark, products=(), options=(), books=(), families=(), gone=()):
    f = spark.createDataFrame
    tables = {"products": f([(*p, "c", 1) for p in products], CHILD), "product_options": f(list(options), OPTION), "price_books": f(list(books), BOOK), "product_families": f(list(families), FAMILY)}
    return sorted(tuple(r) for r in references.catalog_orphans(tables, f(list(gone), GONE)).collect())


def at(n):
    return T0 + timedelta(days=n)


def test_kinds_and_periods(spark):
    got = run(spark, products=[(1, 10, None, at(40)), (2, 11, 5, at(1)), (3, 12, None, at(1)), (4, 10, None, at(1))], books=[(10, at(20))], gone=[("price_books", 12), ("price_books", 10), ("elsewhere", 11)])
    assert got == [("products", "family_id", 2, "missing", "2024-01"), ("products", "price_book_id", 2, "missing", "2024-01"), ("products", "price_book_id", 3, "deleted", "2024-01"), ("products", "price_book_id", 4, "late", "2024-01")]


def test_nulls_copies_and_empty_tables(spark):
    assert run(spark) == []
    two = (1, None, 7, None)
    assert run(spark, products=[two, two]) == [("products", "family_id", 1, "missing", "")]
    # A target without a time, or a record without one, is never late.
    assert run(spark, products=[(1, None, 7, at(1)), (2, None, 8, None)], families=[(7, None), (8, at(9)), (None, at(1))]) == []
    # Copies of a target exist from the earliest on.
    assert run(spark, products=[(1, None, 7, at(5))], families=[(7, at(9)), (7, at(2))]) == []


def test_against_brute_force_with_a_hot_key_and_far_keys(spark):
    rnd = random.Random(1)
    keys = [3, 16384, 16385, -5, 2**40, 2**40 + 1, 77]
    families = [(k, at(rnd.randrange(30))) for k in keys]
    products = [(i, None, 3 if i % 3 else rnd.choice([*keys, 99, -16385, 2**50]), at(rnd.randrange(30))) for i in range(3000)]
    options = [(i, rnd.randrange(4000), at(rnd.randrange(60))) for i in range(500)]
    gone = [("product_families", 99), ("products", 3500)]
    born, made = dict(families), {p[0]: p[3] for p in products}
    want = set()
    for table, field, refs, target, name in (("products", "family_id", [(p[0], p[2], p[3]) for p in products], born, "product_families"), ("product_options", "product_id", options, made, "products")):
        for i, k, t in refs:
            if k not in target:
                want.add((table, field, i, "deleted" if (name, k) in gone else "missing", t.strftime("%Y-%m")))
            elif target[k] > t:
                want.add((table, field, i, "late", t.strftime("%Y-%m")))
    assert run(spark, products, options, families=families, gone=gone) == sorted(want)


def test_sparse_wide_keys_and_arrays_that_span_batches(spark):
    rnd = random.Random(2)
    far = [rnd.randrange(-(2**62), 2**62) for _ in range(400)] + [2**53, 2**53 + 2]
    products = [(i, None, k + (i % 2), at(1)) for i, k in enumerate(far * 2)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run(spark, products, families=[(k, at(0)) for k in far] + [(7, at(0))] * 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    there = set(far)
    assert [r[2] for r in got] == [i for i, p in enumerate(products) if p[2] not in there]
