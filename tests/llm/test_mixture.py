import pytest

from pricewright.llm import mixture
from pricewright.llm.mixture import Source


def test_plan_meets_targets_under_the_limits():
    s = [Source("a", 1000, 0.5, 1), Source("b", 100, 0.5, 4), Source("none", 0, 0.2, 9)]
    e, total, budgets = mixture.plan(s)
    assert (e, total, budgets) == (1.0, 800.0, [400.0, 400.0, 0.0])


def test_a_stated_size_bisects_the_exponent():
    s = [Source("a", 1000, 0.5, 1), Source("b", 100, 0.5, 4)]
    e, total, budgets = mixture.plan(s, 1000)
    assert 0 < e < 1 and budgets[1] <= 400 + 1e-6 and abs(budgets[1] - 400) < 1 and abs(sum(budgets) - 1000) < 1e-6
    assert mixture.plan(s, 10_000)[2] == [1000, 400]


def test_target_entropy():
    s = [Source("a", 900, 0.5, 9), Source("b", 100, 0.5, 9)]
    want = 0.5
    e, _, _ = mixture.plan(s, 1000, target_entropy=want)
    assert mixture.entropy(mixture.tilted(s, e)) == pytest.approx(want, abs=1e-6)
    assert mixture.plan([]) == (1.0, 0.0, [])


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id bigint, source string, text string, place string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m, s = mixture.mix(d, t, **kw)
    return m.collect(), {r.source: r for r in s.collect()}


def test_shares_and_repeats(spark):
    docs = [(i, "Big One", "some words of text here " * (1 + i % 5)) for i in range(300)] + [(1000 + i, " big-one ", "x y z") for i in range(20)] + [(2000 + i, "small", "a few words " * 3) for i in range(10)] + [(3000, None, "lost"), (3001, "unlisted", "lost"), (3002, "small", None), (3003, "small", "")]
    m, s = run(spark, docs, [("big_one", 0.6, 1), ("small", 0.3, 3), ("empty", 0.1, 2)])
    used = {}
    for r in m:
        used[r.doc_id] = max(used.get(r.doc_id, 0), r.use_no)
    assert len({(r.doc_id, r.use_no) for r in m}) == len(m)
    assert max(v for k, v in used.items() if k < 2000) == 1 and max(v for k, v in used.items() if k >= 2000) <= 3
    assert s["big_one"].share_reached == pytest.approx(0.6 / 0.9, abs=0.03) and s["small"].share_reached == pytest.approx(0.3 / 0.9, abs=0.03)
    assert s["empty"].share_reached == 0 and s["unlisted"].mixed_tokens == 0 and not {3000, 3001, 3002, 3003} & set(used)


def test_blocks_keep_budgets_and_runs_agree(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 50)
    docs = [(i, "a" if i % 4 else "b", "w " * (1 + i % 7)) for i in range(1000)]
    targets = [("a", 0.5, 2), ("b", 0.5, 4)]
    m, s = run(spark, docs, targets)
    again, _ = run(spark, docs, targets)
    assert sorted(map(tuple, m)) == sorted(map(tuple, again))
    assert s["a"].mixed_tokens == pytest.approx(s["a"].budget_tokens, rel=0.02)


def test_empty(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == []
    m, s = run(spark, [(1, "a", "x")], [])
    assert m == [] and s["a"].share_reached in (None, 0.0)


def test_plan_leaves_out_sources_without_allowed_repeats():
    s = [Source("a", 1000, 0.4, 1), Source("b", 100, 0.4, 4), Source("barred", 500, 0.2, 0)]
    assert mixture.plan(s) == (1.0, 800.0, [400.0, 400.0, 0.0])


def test_a_size_over_the_limits_is_cut_by_the_exponent(spark):
    docs = [(i, "big", "some words of text here") for i in range(400)] + [(1000 + i, "small", "a few words more") for i in range(40)]
    targets = [("big", 0.4, 2), ("small", 0.6, 3)]
    _, s = run(spark, docs, targets, size="corpus")
    have = sum(r.available_tokens for r in s.values())
    assert 0 < s["small"].exponent < 1 and s["small"].most_uses == 3
    # Brute force: the small source gives all it may, the big one the rest.
    most = 3 * s["small"].available_tokens
    assert s["small"].mixed_tokens == most and s["big"].mixed_tokens == pytest.approx(have - most, rel=0.02)


def test_an_entropy_is_reached(spark):
    docs = [(i, "abc"[i % 7 % 3], "w " * 20) for i in range(3000)]
    targets = [("a", 0.1, 50), ("b", 0.1, 50), ("c", 0.8, 50)]
    _, s = run(spark, docs, targets, target_entropy=0.9)
    assert 0 < s["a"].exponent < 1
    assert mixture.entropy([r.share_reached for r in s.values()]) == pytest.approx(0.9, abs=0.01)


def test_without_a_size_the_weights_of_an_entropy_hold_exactly():
    s = [Source("a", 900, 0.5, 1), Source("b", 100, 0.5, 2)]
    e, total, budgets = mixture.plan(s, None, 0.5)
    assert [b / total for b in budgets] == pytest.approx(mixture.tilted(s, e)) and max(b / x.tokens / x.max_repeats for b, x in zip(budgets, s)) == pytest.approx(1)
