import random

from pricewright.llm import survivor

S = "export_id bigint, sku string, description string, base_price double, finish string, finish_description string, options string, confidence double, grp string, rank int"


def rows(spark, data):
    return spark.createDataFrame([(*r, "g", 1) for r in data], S)


def row(i, sku, conf=0.5, text="Hinge", price=1.0, finish="US3", name="Brass", options="a"):
    return (i, sku, text, price, finish, name, options, conf)


def verdicts(spark, data):
    return dict(sorted((r.export_id, r.verdict) for r in survivor.verdicts(rows(spark, data)).collect()))


def test_scan_errors_group_and_confidence_decides(spark):
    assert verdicts(spark, [row(1, "DX-10 US3", 0.8), row(2, "dx1O-U53", 85.0), row(3, "DX10US4", 0.9), row(4, None), row(5, None), row(6, "--"), row(7, "--")]) == {1: "drop", 2: "keep"}


def test_percentages_nulls_and_ties(spark):
    assert verdicts(spark, [row(1, "A", 90.0), row(2, "A", 0.9), row(3, "A", None)]) == {1: "keep", 2: "drop", 3: "drop"}
    assert verdicts(spark, [row(1, "A", 0.9, text=" "), row(2, "A", 0.9)]) == {1: "drop", 2: "keep"}
    assert verdicts(spark, [row(1, "A", float("nan"), text=None, price=None), row(2, "A", 0.0)]) == {1: "drop", 2: "keep"}


def test_copies_of_one_row_are_no_group(spark):
    assert verdicts(spark, [row(1, "A"), row(1, "A")]) == {}
    assert verdicts(spark, [row(1, "A"), row(1, "A"), row(2, "A", 0.1)]) == {1: "keep", 2: "drop"}
    assert verdicts(spark, []) == {}


def test_survivors_fill_gaps_with_existing_values(spark):
    data = [row(1, "A", 0.9, "Full Mortise Hinge 4 Heavy", None, None), row(2, "A", 0.6, "Full Mortlse Hinge 4 Heavy", 5.0, "US3"), row(3, "A", 0.6, "Full Mortise Hinge 4 Hea", 5.0, "US3"), row(4, "B"), row(5, "C", options=None), row(6, "C", options=" ")]
    got = {r.grp: r for r in survivor.survivors(rows(spark, data)).collect()}
    assert set(got) == {"A", "C"}
    a = got["A"]
    assert (a.export_id, a.records, a.description, a.base_price, a.finish) == (1, 3, "Full Mortise Hinge 4 Heavy", "5.0", "US3")
    assert got["C"].options is None


def test_consensus_votes_by_column():
    seqs = [(tuple("abcde"), 1.0), (tuple("abxde"), 1.0), (tuple("abcd"), 1.0), (tuple("bcde"), 1.0)]
    assert survivor.profile(seqs) == (list("abcde"), 4.0)
    assert survivor.profile([]) == ([], 0.0)


def test_many_values_of_a_hot_group_are_chunked(spark):
    base = "the quick brown fox jumps over the lazy dog".split()
    data = []
    for i in range(400):
        words = list(base)
        words[i % 9] = f"w{i}"
        data.append(row(i, "A", 0.5, " ".join(words)))
    data.append(row(1000, "A", 0.5, " ".join(base)))
    assert survivor.survivors(rows(spark, data)).first().description == " ".join(base)


def test_long_values(spark):
    long = "word " * 20_000
    got = survivor.survivors(rows(spark, [row(1, "A", text=long), row(2, "A", text=long + "x"), row(3, "A", text=long)])).first()
    assert got.description == long


def test_the_middle_of_long_values_votes(spark):
    base = [f"w{i}" for i in range(1000)]
    one, other = list(base), list(base)
    one[480], other[520] = "x", "y"
    rubbish = base[:450] + [f"r{i}" for i in range(100)] + base[550:]
    got = survivor.survivors(rows(spark, [row(1, "A", 0.4, " ".join(one)), row(2, "A", 0.4, " ".join(other)), row(3, "A", 0.5, " ".join(rubbish))])).first()
    assert got.description in (" ".join(one), " ".join(other))


def test_long_alignments_are_the_short_ones(monkeypatch):
    r = random.Random(5)
    for n in range(60):
        words = [str(i) for i in range(r.choice([2, 6, 300]))]
        base = [r.choice(words) for _ in range(r.randrange(130))]
        seqs = []
        for _ in range(3):
            seq = [r.choice(words) if r.random() < 0.1 else t for t in base if r.random() < 0.9]
            cut = r.randrange(len(seq) + 1)
            seqs.append((tuple(seq if n % 3 else seq[cut:] + seq[:cut]), r.choice([0.15, 0.5, 0.95])))
        monkeypatch.setattr(survivor, "_CELLS", 10**9)
        short = survivor.profile(seqs)
        monkeypatch.setattr(survivor, "_CELLS", 0)
        assert survivor.profile(seqs) == short


def test_distance_is_exact(monkeypatch):
    def plain(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return line[-1]

    r = random.Random(3)
    for block in (1, 3, 8192):
        monkeypatch.setattr(survivor, "_BLOCK", block)
        for _ in range(300):
            a, b = ([r.choice("abc") for _ in range(r.randrange(14))] for _ in range(2))
            assert survivor.distance(a, b) == plain(a, b)


def test_minority_votes_of_chunks_count(spark):
    # 320 values are five chunks: "yes" wins three of them by 33 to 31, "no" has all of the other two.
    from pyspark.sql import functions as F

    texts = [(f"alpha {word} beta u{i}", word) for i in range(2000) for word in ("yes", "no")]
    want = {(c, w): n for c in range(5) for w, n in ((("yes", 33), ("no", 31)) if c < 3 else (("no", 64),))}
    taken = []
    for r in spark.createDataFrame(texts, "val string, word string").select("val", "word", F.pmod(F.xxhash64("val"), F.lit(5)).alias("at")).collect():
        if want.get((r["at"], r.word), 0) > 0:
            want[r["at"], r.word] -= 1
            taken.append(r.val)
    assert len(taken) == 320
    got = survivor.survivors(rows(spark, [row(i, "A", 0.5, v) for i, v in enumerate(taken)])).first()
    assert got.description.startswith("alpha no beta")


def test_merging_alignments_keeps_all_votes():
    parts = [survivor.aligned([(("a", "x", "c"), 51), (("a", "y", "c"), 49)]), survivor.aligned([(("a", "y", "c"), 60), (("a", "c"), 40)])]
    assert survivor.merged(parts) == ([{"a": 200}, {"x": 51, "y": 109, "": 40}, {"c": 200}], 200)


def test_merging_noisy_alignments(monkeypatch):
    r = random.Random(1)
    base = "full mortise heavy weight hinge five knuckle ball bearing steel".split()

    def value():
        return tuple(t if r.random() > 0.1 else t + str(r.randrange(1000)) for t in base for _ in range(r.choice([1] * 18 + [0, 2])))

    parts = [survivor.aligned([(value(), r.randrange(50, 1050)) for _ in range(64)]) for _ in range(12)]
    columns, weight = survivor.merged(parts)
    assert survivor.winners(columns) == base and {sum(c.values()) for c in columns} == {weight}
    monkeypatch.setattr(survivor, "_CELLS", 0)
    assert survivor.merged(parts) == (columns, weight)


def test_misread_skus_are_outvoted_and_agreement_is_counted(spark):
    data = [row(1, "MHl000-US3", 0.9), row(2, "MH1000-US3", 0.6), row(3, "MH10O0 U53", 0.6, text="Hlnge"), row(4, "MH1000-US3", 0.6, options=None)]
    got = survivor.survivors(rows(spark, data)).first()
    assert (got.export_id, got.sku, got.description) == (1, "MH1000US3", "Hinge")
    said = {r.export_id: (r.verdict, r.agrees) for r in survivor.verdicts(rows(spark, data)).collect()}
    assert said == {1: ("keep", 5), 2: ("drop", 6), 3: ("drop", 4), 4: ("drop", 5)}


def test_a_majority_is_what_alignment_finds():
    r = random.Random(8)
    met = 0
    for _ in range(400):
        seqs = {}
        for _ in range(r.randrange(2, 5)):
            seqs[tuple(r.choice("abcd") for _ in range(r.randrange(7)))] = r.randrange(1, 30)
        best = survivor.majority(seqs)
        if best is not None:
            met += 1
            assert tuple(survivor.winners(survivor.aligned(list(seqs.items()))[0])) == best
    assert met > 50
