import random
from datetime import date, datetime

from pricewright.llm import linkage

L = "listing_id bigint, dealer string, model_text string, item_text string, quoted_price double, key string, votes string"
H = "snapshot_date date, sku string, model string, description string, base_price double, loaded_at timestamp_ntz, key string, size int"
NAMES = {c: n for c, _, n in linkage.FINISHES}


def product(model, size, finish, price, day=2, text="Knuckle Hinge", weight="Heavy Weight"):
    inch = f"{size / 10:g}"
    return (date(2024, day, 1), f"{model}-{size}X{size}-{finish}", model, f'{model} {text} {inch}" x {inch}" {weight} {NAMES[finish]}', price, datetime(2024, 1, 1), "c", 1)


def catalog():
    rnd = random.Random(4)
    out = []
    for i in range(60):
        model = f"{rnd.choice(['PC', 'MH', 'DX'])}{100000 + i * 7919 % 900000}"
        kind, weight = rnd.choice(["Knuckle Hinge", "Pivot Set", "Gear Hinge"]), rnd.choice(["Heavy Weight", "Light Weight"])
        for s in (40, 45, 50):
            for f in ("US3", "US26D", "US19"):
                out.append(product(model, s, f, round(20 + i + s * 1.7 + len(f), 2), text=kind, weight=weight))
    return out


def listings(products):
    rnd = random.Random(9)
    out, truth = [], {}
    for i in range(400):
        p = rnd.choice(products)
        model, size, finish = p[1].split("-")
        size = int(size[:2])
        kind = p[3].split(" ", 1)[1].split(' ')[0]
        said = rnd.choice([model, model[:2] + "-" + model[2:], model.lower()[:2] + "." + model[2:5] + "." + model[5:], model[2:], "HG" + model, model.replace("5", "S").replace("0", "O") if rnd.random() < 0.5 else model])
        how = rnd.choice([f'{size / 10:g}" x {size / 10:g}"', f"{size / 10:g}x{size / 10:g}", f"{round(size * 2.54)} x {round(size * 2.54)} mm"]) if rnd.random() < 0.9 else ""
        name = rnd.choice([finish, finish.replace("US", "US-"), NAMES[finish].upper(), next(n for c, n, _ in linkage.FINISHES if c == finish)])
        part = rnd.random() < 0.1
        text = f"{'spare pin to suit ' if part else ''}{kind} {how} {name}"
        price = p[4] if not how or rnd.random() < 0.8 else None
        inside = rnd.random() < 0.4
        out.append((i, "d", None if inside else said, f"{text} {said}" if inside else text, price, "c", "c"))
        if not part:
            truth[i] = p[1].replace("-", "").upper()
    return out, truth


def run(spark, ls, ps):
    return {r.listing_id: r.sku for r in linkage.link(spark.createDataFrame(ls, L), spark.createDataFrame(ps, H)).collect()}


def test_held_truth(spark):
    products = catalog()
    ls, truth = listings(products)
    got = run(spark, ls, products)
    right = sum(truth.get(i) == s for i, s in got.items())
    assert right / len(got) > 0.97 and right / len(truth) > 0.97


def test_odd_input(spark):
    products = catalog()
    ls, _ = listings(products)
    odd = [(9001, None, None, None, None, None, None), (9002, None, "", "", None, None, None), (9003, None, "PC999999", 'x 4" x 4" US3', 1.0, None, None), (None, None, "x", "y", 1.0, None, None), (9004, None, None, "a " * 50_000, None, None, None)]
    got = run(spark, ls + odd + ls[:5], [*products, *products[:3], (date(2024, 2, 1), None, None, None, None, None, None, None)])
    assert not {9001, 9002, 9003, 9004} & set(got)
    assert run(spark, [], products) == {} and run(spark, ls[:3], []) == {}


def test_only_the_last_snapshot_counts(spark):
    products = catalog()
    ls, truth = listings(products)
    old = [product("PC123456", 40, "US3", 9.0, day=1)]
    got = run(spark, [*ls, (9000, "d", "PC123456", '4" x 4" US3', 9.0, "c", "c")], products + old)
    assert 9000 not in got


def test_label_model_learns_accuracies():
    rnd = random.Random(0)
    counts = {}
    for _ in range(5000):
        y = rnd.random() < 0.2
        v = tuple((2 if (rnd.random() < a) == y else 0) if rnd.random() < 0.9 else 1 for a in (0.95, 0.9, 0.85, 0.9))
        counts[v] = counts.get(v, 0) + 1
    m = linkage.fit(counts, 0.5, ["a", "b", "c", "d"])
    assert m.posterior((2, 2, 2, 2)) > 0.9 and m.posterior((0, 0, 0, 0)) < 0.01
    assert abs(m.prior - 0.2) < 0.06


def _pairs(spark, ls, ps):
    return linkage.candidates(spark.createDataFrame(ls, L), spark.createDataFrame(ps, H))


def sparse():
    """A catalog in which models don't come in all sizes and finishes."""
    rnd = random.Random(11)
    return [p for p in catalog() if rnd.random() < 0.6]


def test_candidates_are_recalled_and_confidences_calibrated(spark):
    products = sparse()
    ls, truth = listings(products)
    pairs = _pairs(spark, ls, products).cache()
    known, _ = linkage.confidences(pairs)
    got = pairs.join(known, "votes").select("listing_id", "sku", "confidence").collect()
    found = {r.listing_id for r in got if truth.get(r.listing_id) == r.sku}
    assert len(found) / len(truth) > 0.97
    bins = {}
    for r in got:
        bins.setdefault(min(9, int(r.confidence * 10)), []).append((r.confidence, truth.get(r.listing_id) == r.sku))
    gap = sum(abs(sum(c for c, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(got)
    told = {k: (len(b), sum(c for c, _ in b) / len(b), sum(y for _, y in b) / len(b)) for k, b in sorted(bins.items())}
    assert gap < 0.1 and all(y >= c - 0.05 for _, c, y in told.values()), told


def test_few_pairs_are_matches():
    """The share of matches is learned, far below what it may be at most."""
    rnd = random.Random(3)
    counts, true = {}, {}
    for _ in range(40_000):
        y = rnd.random() < 0.01
        v = tuple((2 if rnd.random() < (0.97 if y else f) else 0) if rnd.random() < 0.9 else 1 for f in (0.3, 0.1, 0.25, 0.2, 0.15))
        counts[v] = counts.get(v, 0) + 1
        true[v] = true.get(v, 0) + y
    m = linkage.fit(counts, 0.2, list("abcde"))
    assert 0.005 < m.prior < 0.02
    chosen = [v for v in counts if m.posterior(v) >= 0.5]
    assert sum(true[v] for v in chosen) > 0.9 * sum(counts[v] for v in chosen) > 0


def test_the_model_decides(spark, monkeypatch):
    products = catalog()
    ls, _ = listings(products)
    got = run(spark, ls, products)

    def constant(pairs):
        return pairs.select("votes").distinct().selectExpr("votes", "0.9 AS confidence"), None

    monkeypatch.setattr(linkage, "confidences", constant)
    other = run(spark, ls, products)
    assert sum(got.get(i) != s for i, s in other.items()) > 20


def test_skus_of_other_forms(spark):
    forms = [("AB12345-40X40-BLK", "AB12345"), ("X1234567-100X100-US3", "X1234567"), ("QB4455 4X4", "QB4455"), ("MH777777-US26D", "MH777777"), ("999", "999"), ("ABC", "ABC")]
    rows = [(date(2024, 1, 1), sku, model, f'{model} Gear Hinge 4" x 4"', 1.0, datetime(2024, 1, 1)) for sku, model in forms]
    rows.append((date(2024, 1, 1), "PC123456-45X45-US3", None, None, None, None))
    got = {r.sku: (r.prefix, r.key, r["size"], r.finish) for r in linkage.goods(spark.createDataFrame(rows, "snapshot_date date, sku string, model string, description string, base_price double, loaded_at timestamp_ntz")).collect()}
    assert got["AB1234540X40BLK"] == ("A8", "12345", 40, "BLK")
    assert got["X1234567100X100US3"] == ("X", "1234567", 100, "US3")
    assert got["MH777777US26D"] == ("MH", "777777", 40, "US26D")
    assert got["PC12345645X45US3"] == ("PC", "123456", 45, "US3")
    assert "999" in got and "ABC" not in got
