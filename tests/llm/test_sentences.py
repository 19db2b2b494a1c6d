import pytest

from pricewright.llm.sentences import sentences

CASES = {
    "en": ["We shipped 1,515 units of FE7476 in Q3.", "Mfr. Std. 60-2024 governs the barrel.", 'The label says "Do not paint. Keep it dry." in red.', "Cut the shim to 9 in.", "eLatch units need it.", "Is it dry?!", '"Use it first," he wrote, "then check."', "(Refer to p. 9 of Vol. II.)", "It kept its spindle cap.", "A latch may be drilled.", "See www.example.com/a.b for f.o.b. prices."],
    "de": ["Am 3. März 2013 wurde die 27. Auflage gedruckt.", "Das passt z. B. zu Türen, d. h. immer.", "Der Monteur fragte: „Wo ist der Stift?“", "Auf dem Etikett steht: „Nicht bohren. Trocken lagern.“ und die Nummer 58.", "Es kostet 898,22 EUR zzgl. MwSt. je Paar."],
    "fr": ["M. le chef a fini.", "L'étiquette indique : « Ne pas peindre. Garder au sec. » en rouge.", "La goupille est-elle serrée ?", "Voir fig. 69, p. 8 et l'annexe A.", "Le joint, c.-à-d. la pièce 51, se pose."],
    "es": ["¿Está bien?", "¡No taladre!", "El Sr. técnico revisó la pág. 25.", "Dice: «No pintar. Mantener seco.» en rojo."],
    "ru": ["На рис. 43 показан узел C.", "Двери выше 22 см.", "В коробке 91 шт. и т. д. для монтажа.", "Каталог вышел в 2022 г. в новом формате."],
    "hi": ["कीमत 142.62 रु. प्रति जोड़ी है।", 'लेबल पर लिखा है, "रंग न करें। सूखा रखें।" और 13 है।'],
    "ar": ["هل المسمار مشدود؟", "كتب: «لا تدهن. احفظه.» مع الرقم 9.", "السعر هو 8.85 مم."],
}
JOINED = {"zh": ["请先检查销钉，再安装门扇。", "标签上写着“请勿上漆。保持干燥。”并附有编号62。", "工程师问：“弹簧在哪里？”", "（详见第85章。）", "间隙为5.25毫米。"], "ja": ["ラベルには「塗装しないこと。乾燥。」と書かれています。", "ピンは締まっていますか？", "（図35を参照。）", "定価は4.70です。"]}


def units(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [[] for _ in texts]
    for r in sentences(df).orderBy("doc_id", "start_pos").collect():
        out[r.doc_id].append(texts[r.doc_id][r.start_pos : r.end_pos])
    return out


@pytest.mark.parametrize("gap", [" ", "\n", "  ", "\xa0"])
def test_sentences_by_language(spark, gap):
    texts = {k: gap.join(v) for k, v in CASES.items()} | {k: "".join(v) for k, v in JOINED.items()}
    for (k, t), got in zip(texts.items(), units(spark, *texts.values())):
        assert got == (CASES | JOINED)[k], k


def test_thai(spark):
    want = ["เปลี่ยนสปริงทุก 90 ปี", "บานพับรุ่น PC2594 มีให้เลือกในสี US26 เท่านั้น", "ห้ามเจาะรู"]
    assert units(spark, " ".join(want)) == [want]


def test_blocks_lists_and_headings(spark):
    text = "39. Finish adders\n\nOne\ntwo. Three\n \n- Check it. Then go.\n* b\n• c\n\n  Sec. 3.5 Gaps \n\nPRICE CHANGES 2019"
    assert units(spark, text) == [["39. Finish adders", "One\ntwo.", "Three", "- Check it. Then go.", "* b", "• c", "Sec. 3.5 Gaps", "PRICE CHANGES 2019"]]


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n \n", 5), (4, "no end", 5), (4, "no end", 5), (5, "a. B.", 5)], "doc_id int, text string, start_pos int")
    assert sorted(tuple(r) for r in sentences(df).collect()) == [(4, 0, 6), (4, 0, 6), (5, 1, 3), (5, 5, 7)]
    assert sentences(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    n = 3000
    got = units(spark, "This is it. " * n, "x" * 200_000, "(" * 5000 + "a. B" + ")" * 5000)
    assert len(got[0]) == n and len(got[1]) == 1


def test_positions_are_characters_beyond_the_first_plane(spark):
    text = "😀 one. 😀😀 Two."
    assert units(spark, text) == [["😀 one.", "😀😀 Two."]] or units(spark, text) == [[text]]


@pytest.mark.parametrize("pair", ["()", "“”", "„“", "«»", '""', "[]"])
def test_long_quotations_are_not_cut(spark, pair):
    inside = " ".join(f"Keep part {i} dry and clean. Do not paint it." for i in range(40))
    text = f"The label says {pair[0]}{inside}{pair[1]} in red."
    assert units(spark, f"{text} Next one.", f"One here. {text}") == [[text, "Next one."], ["One here.", text]]


@pytest.mark.parametrize("n", [10, 380, 420, 5000])
def test_pairs_of_any_length_and_marks_without_a_partner(spark, n):
    fill = "x" * n
    text = f'He says "Keep it dry. {fill} Do not paint." in red. Next one.'
    assert units(spark, text) == [[text[:-10], "Next one."]]
    assert units(spark, f"A ) mark. X{fill} More. End ) here.") == [["A ) mark.", f"X{fill} More.", "End ) here."]]
    assert units(spark, f"An ( open mark. X{fill} more. End here.") == [["An ( open mark.", f"X{fill} more.", "End here."]]
    nested = f"See (part one. [Note. {fill} It is.] And two. Three) now. Done."
    assert units(spark, nested) == [[nested[:-6], "Done."]]


def test_a_long_address_is_no_boundary(spark):
    url = "https://a.b/" + "c.D?e!" * 200 + "f"
    assert units(spark, f"See {url} first. Then go.") == [[f"See {url} first.", "Then go."]]
