from datetime import date, datetime
from decimal import Decimal as D

from pricewright.operators import history

P = "id bigint, sku string, base_price decimal(10,2), is_active boolean, retired_date date, updated_at timestamp_ntz, effective_date date, price_book_id bigint, entity string, day string"
B = "id bigint, effective_date date"


def d(n):
    return date(2024, 1, n)


def t(n):
    return datetime(2024, 2, n)


def run(spark, products, books=()):
    h = history.product_history(spark.createDataFrame(products, P), spark.createDataFrame(list(books), B))
    return sorted((r.entity, r.version_no, r.valid_from, r.valid_to, r.base_price) for r in h.collect())


def row(i, sku, price, day, upd=1, active=True, retired=None, book=None):
    # The last two columns clash with names the operator uses itself.
    return (i, sku, None if price is None else D(price), active, retired, t(upd), day, book, "x", "y")


def test_a_version_starts_only_upon_change(spark):
    got = run(spark, [row(1, "a-1", "5", d(1)), row(2, "A1", "5", d(2)), row(3, "a 1", "6", d(3))])
    assert got == [("A1", 1, d(1), d(3), D(5)), ("A1", 2, d(3), None, D(6))]


def test_the_last_row_of_a_day_holds_and_copies_count_once(spark):
    a = row(2, "A", "7", d(1), upd=2)
    assert run(spark, [row(1, "A", "5", d(1), upd=1), a, a, row(3, "A", "8", d(1), upd=1)]) == [("A", 1, d(1), None, D(7))]


def test_ties_of_update_fall_to_the_greater_id(spark):
    assert run(spark, [row(5, "A", "1", d(1)), row(4, "A", "9", d(1))])[0][4] == D(1)


def test_null_equals_null_and_differs_from_values(spark):
    got = run(spark, [row(1, "A", None, d(1)), row(2, "A", None, d(2)), row(3, "A", "1", d(3)), row(4, "A", "1", d(4), active=None)])
    assert [(x[2], x[3]) for x in got] == [(d(1), d(3)), (d(3), d(4)), (d(4), None)]


def test_own_retirement_ends_a_version_if_later_than_its_start(spark):
    got = run(spark, [row(1, "A", "1", d(5), retired=d(9)), row(2, "B", "1", d(5), retired=d(5)), row(3, "C", "1", d(5), retired=d(20)), row(4, "C", "2", d(8))])
    assert [(x[0], x[3]) for x in got] == [("A", d(9)), ("B", None), ("C", d(8)), ("C", None)]


def test_rows_without_a_day_take_their_books(spark):
    got = run(spark, [row(1, "A", "1", None, book=7), row(2, "A", "2", None, book=8), row(3, "B", "1", None, book=None)], [(7, d(4)), (7, d(4)), (8, None)])
    assert got == [("A", 1, d(4), None, D(1))]


def test_rows_without_sku_and_empty_tables(spark):
    assert run(spark, [row(1, None, "1", d(1)), row(2, " - ", "1", d(1))]) == []
    assert run(spark, []) == []


def test_a_long_history_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    data = [row(i, "S%d" % rnd.randrange(3), str(rnd.randrange(3)), d(1 + rnd.randrange(28)), upd=1 + rnd.randrange(20), active=rnd.random() < 0.7) for i in range(400)]
    held = {}
    for r in data:
        k = (r[1], r[6])
        if k not in held or (r[5], r[0]) > (held[k][5], held[k][0]):
            held[k] = r
    want = []
    for sku in sorted({r[1] for r in data}):
        last, starts = None, []
        for day in sorted(k[1] for k in held if k[0] == sku):
            r = held[sku, day]
            if last is None or (r[2], r[3], r[4]) != (last[2], last[3], last[4]):
                starts.append((day, r[2]))
            last = r
        want += [(sku, i + 1, s, starts[i + 1][0] if i + 1 < len(starts) else None, p) for i, (s, p) in enumerate(starts)]
    assert run(spark, data) == want
