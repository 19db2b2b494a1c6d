import pytest

import random

from pricewright.llm import leakage

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
ITEM = " ".join(WORDS)
HAN = "安装仓库的备用的垫片之前应先核对四十三个松动的门扇和八十九组垫片确认大厅内"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect())


def test_twelve_words_count_and_eleven_do_not(spark):
    docs = ["so " + " ".join(WORDS[3:15]) + " end", "so " + " ".join(WORDS[3:14]) + " end", ITEM, None, "", "x" + " ".join(WORDS[0:12]), " ".join(WORDS[0:12]) + "x"]
    assert run(spark, docs, [(7, ITEM), (8, "too short"), (9, None)]) == [(0, 7), (2, 7)]


def test_altered_forms(spark):
    docs = [ITEM.upper(), "** ".join(WORDS[:12]), "\n".join(WORDS[:12]), "".join(c + "​" for c in " ".join(WORDS[:12])), "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in " ".join(WORDS[:12])), " ".join(WORDS[:6]) + "­ ⁠" + " ".join(WORDS[6:12])]
    assert run(spark, docs, [(1, ITEM)]) == [(i, 1) for i in range(len(docs))]


def test_chinese_runs_of_24(spark):
    docs = ["见" + HAN[2:26] + "等", "见" + HAN[2:25] + "等", "，".join(HAN[:24]), " ".join(HAN[:24])]
    assert run(spark, docs, [(1, HAN)]) == [(0, 1), (2, 1), (3, 1)]


def test_items_with_common_text_and_repeats(spark):
    assert run(spark, [ITEM, ITEM], [(1, ITEM), (2, ITEM + " more"), (1, ITEM)]) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert run(spark, [ITEM], []) == []
    assert run(spark, [], [(1, ITEM)]) == []


def test_search_against_brute_force():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice("ab") for _ in range(300))
        patterns = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 9))): {1} for _ in range(20)}
        want = {(p, i) for p in patterns for i in range(len(text)) if text.startswith(p, i)}
        assert set(leakage.WuManber(patterns, 3).search(text)) == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(WORDS[i:] + WORDS[:i])) for i in range(5)]
    docs = [ITEM, " ".join(WORDS[4:] + WORDS[:4])]
    whole = run(spark, docs, items)
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 2)
    assert run(spark, docs, items) == whole and whole


# Words of twelve letters' worth of marks: Hindi with vowel signs, Arabic with
# harakat, Thai with tone marks (set with blanks, as the rule counts words).
MARKED = {
    "hi": "दरवाज़े की चौखट में कब्ज़ा लगाने से पहले पेंच ढीले करें और दीवार साफ़ करें".split(),
    "ar": "قَبْلَ تَرْكِيبِ المِفْصَلَةِ نَظِّفِ الإِطَارَ وَافْحَصِ البَرَاغِيَ ثُمَّ ثَبِّتِ اللَّوْحَ بِإِحْكَامٍ وَلَا تَتْرُكْ فَرَاغًا".split(),
    "th": "ก่อน ติดตั้ง บานพับ ให้ ทำความสะอาด กรอบ ประตู แล้ว ตรวจ สกรู ทุก ตัว ให้ แน่น ก่อน ใช้".split(),
}


@pytest.mark.parametrize("lang", MARKED)
def test_marks_are_part_of_their_words(lang):
    words = MARKED[lang]
    assert leakage.words_of(" ".join(words)) and len(leakage.words_of(" ".join(words))) == len(words)
    searches = leakage.compile_items(((1, " ".join(words)),))
    for n, leaks in ((11, set()), (12, {1})):
        assert leakage.leaks_of("xx yy " + " ".join(words[:n]) + " zz", searches) == leaks
    seven = leakage.leaks_of(" ".join(words[:7]), searches)
    assert seven == set()


def test_a_word_without_its_marks_is_another_word():
    searches = leakage.compile_items(((1, " ".join(MARKED["hi"])),))
    bare = [w.replace("ी", "").replace("े", "") for w in MARKED["hi"]]
    assert leakage.leaks_of(" ".join(bare), searches) == set()
