import pytest

from tidewright.llm.sentences import sentence_spans, sentences

CASES = [
    ("en", ["The arm is sold in the U.S.", "A further aspect follows.", "See U.S. Pat. No. 51,947,141, which describes a head."], " "),
    ("en", ["pH is kept at 13.14 here.", "The ratio was 17 . 47 in the copy.", "31 ml of resin are added.", "J. R. Tavvic reports a loss (cf. Tab. 9).", "(See also FIG. 33.)", "8 ml follow."], " "),
    ("en", ['The display reads "Close the lid. Wait." until it cools.', '“Ready!” is then shown.', 'It is called a "carrier."', "Why does it slip?!", "It is not!", "The list goes on…", "Suitable fillers are chalk, mica, etc.", "Oil, grease, etc. may be held."], " "),
    ("en", ["The chamber turns ... and then rests.", "The test ran from 7 a.m. to 9 p.m.\non each head.", "The flow is λ?=?0.58?nm.", "With F !=  16, it holds."], "\n"),
    ("en", ["The stroke is limited.", "The user waits."], ""),
    ("de", ["Geeignet ist z. B. Messing oder d. h. ein Metall.", "Nach Dr. Felsquar bzw. Prof. Maddorin genügt ein Ring.", "Es ergeben sich ca. 75,19 mm, vgl. Fig. 16 u. 33.", "Der Kanal wurde am 3. Mai geprüft.", "Im 2. Schritt wird er entfernt.", "Die Anzeige meldet „Deckel zu. Bitte warten.“, bis er kühlt.", "Man nennt ihn »Träger.«", "Ist er dicht?"], " "),
    ("fr", ["L'afficheur indique « Fermez. Attendez. » tant que le noyau est chaud.", "Voir l'art. 51 et le n° 30, etc.", "On utilise p. ex. du laiton, c.-à-d. un alliage.", "Selon M. Tavvic et al., le boîtier suffit.", "Cela suffit !", "Env. 38 pièces, cf. p. 46, ont été essayées."], " "),
    ("es", ["¿Sigue estanco el soporte?", "En EE. UU. se vende un eje.", "El Sr. Orvane y la Dra. Quellon usan un eje.", "¡No lo está!", "Véase el núm. 19, pág. 44, del soporte.", "La pantalla muestra «Cierre. Espere.» hasta que se enfría."], " "),
    ("ru", ["Используют латунь, т. е. сплав, и др. материалы.", "По данным А. Б. Орванина, достаточно детали.", "Масса равна прибл. 4,59 кг.", "Он не герметичен!", "На экране надпись «Закройте. Ждите.», пока зажим горячий.", "См. п. 56 и табл. 57, где описан фильтр."], " "),
    ("ja", ["表示部には「蓋を閉じる。待つ。」と表示される。", "（図23も参照。）", "比率は１．54以上である．", "これを「担体。」と呼ぶ。", "密閉されているか？"], ""),
    ("zh", ["它并不密封！", "显示屏显示“请关盖。请等待。”，直到冷却。", "这种部件被称为“载体。”", "按照GB 59.15标准，传感器应干燥……并保持静止。", "（另见图44。）", "所述转子可拆卸。"], ""),
    ("ko", ['표시부는 "뚜껑을 닫으시오. 기다리시오."라고 표시한다.', "No. 34 규격의 클램프이 사용된다.", "밀봉되어 있는가?", "그렇지 않다!"], " "),
    ("ar", ["تعرض الشاشة «أغلق الغطاء. انتظر.» حتى يبرد الموصل.", "انظر ص. 55 من الجدول.", "وفقاً لما ذكره د. أورفان يكفي المرشح.", "هل يبقى الصمام محكماً؟", "ليس كذلك!"], " "),
    ("hi", ["अंतर लगभग 83.30 मि.मी. रहता है।", "सं. 37 और सं. 48 के संवेदक समान हैं।", "डॉ. तविका के अनुसार संवेदक पर्याप्त है।", "क्या रोटर बंद है?", 'पट पर "ढक्कन बंद करें। रुकें।" लिखा आता है।'], " "),
    ("th", ["ระยะห่างมีค่า 7.50 มม. และสปริงยังคงเคลื่อนที่ได้", "ดังแสดงในรูปที่ 56 โดยแผ่นยึดสัมผัสกับท่อ", "ตัวควบคุมรุ่น PX-17 ใช้ขับวาล์ว"], " "),
]


@pytest.mark.parametrize("lang,parts,sep", CASES)
def test_running_text(lang, parts, sep):
    text = sep.join(parts)
    assert [text[a:b] for a, b in sentence_spans(text, lang)] == parts
    assert [text[a:b] for a, b in sentence_spans(text, None)] == parts


def test_blocks_headings_claims_and_numbers():
    text = "﻿ABSTRACT\r\n \r\nOne line\nwraps here. Two.\n\n[0001] A paragraph.\n[0002] Next\nCLAIMS\n\n1. A method comprising: a) heating. b) Cooling, i.e. Waiting.\n2. The method of claim\n1. Or so.\n3、 Third\n\n4. Fourth.".replace("﻿", "")
    got = [text[a:b] for a, b in sentence_spans(text, "en")]
    assert got == ["ABSTRACT", "One line\nwraps here.", "Two.", "[0001] A paragraph.", "[0002] Next\nCLAIMS", "1. A method comprising: a) heating. b) Cooling, i.e. Waiting.", "2. The method of claim\n1. Or so.", "3、 Third", "4. Fourth."]


def test_japanese_and_korean_claims():
    ja = "【請求項１】弁体を備える装置。\n【請求項２】厚さが１．５ｍｍである。請求項１の装置。"
    assert len(sentence_spans(ja, "ja")) == 2
    ko = "청구항 1. 센서를 포함하는 장치. 그렇다.\n\n청구항 2. 제1항의 장치."
    assert len(sentence_spans(ko, "ko")) == 2


def test_defined_results_and_offsets(spark, small_dir):
    for t in (None, "", " \n　\t", " "):
        assert sentence_spans(t) == []
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    spans = {}
    for r in sentences(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for doc, text in texts.items():
        own = sorted(spans.get(doc, []))
        covered = set()
        for a, b in own:
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            assert covered.isdisjoint(range(a, b))
            covered |= set(range(a, b))
        assert all(c.isspace() or i in covered for i, c in enumerate(text or ""))
    assert sentences(docs.limit(0)).count() == 0


def test_very_long_and_odd_texts():
    long = "The valve opens. " * 50_000
    assert len(sentence_spans(long, "en")) == 50_000
    assert len(sentence_spans("a" * 10**6, "en")) == 1
    assert len(sentence_spans('"' * 2001 + ". A. B! 漢。字", "xx")) >= 1
    assert sentence_spans("𠮷。𠮷。", "zh") == [(0, 2), (2, 4)]
