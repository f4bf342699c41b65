import pytest

from codonlake.llm import sentences
from codonlake.llm.sentences import Model

M = Model(frozenset(), frozenset({"The", "We", "Then", "p-values", "train.csv", "数据", "日志", "モデ", "GC", "GC含", "Le"}), frozenset({"the", "we", "then"}))

CASES = {
    "plain": ["The run ended.", "We stopped."],
    "title": ["Ask Dr. Brastov.", "We did."],
    "initials": ["T. M. Ondelar left.", "L. undosa was kept.", "The end."],
    "decimal": ["The score rose to 3.14 in v2.4.1.", "Then it fell."],
    "etc at the end": ["The loader reads FASTA, CSV, etc.", "We read BED."],
    "etc inside": ["The tools (FASTA, etc. and so on) work.", "We use them."],
    "et al": ["The idea goes back to Ilvenne et al.", "We know.", "As Ondelar et al. (2009) say, no."],
    "hours": ["The run began at 3.14 p.m.", "p-values were low.", "train.csv was loaded at 3 a.m. by Q. Tell."],
    "ellipsis": ["The score fell ... and then rose.", "The job never ended…", "We left."],
    "exclamation in a name": ["We ran Kmerly! on the split.", "The end!!", "Really?!", "The rest."],
    "quotes": ["The log says \"row 1 has two labels.\"", "We saw “Is it? Yes,” in the margin.", "‘Never trust,’ says he."],
    "brackets": ["The state (see p. 5. It is short.) was pooled.", "An interval [1, 5) is open.", "The end."],
    "guillemets": ["Le journal dit : « deux lignes. »", "Le test reste."],
    "russian": ["Читает CSV, BED и т. д.", "Обе цепи, т. е. все, с 5 п. н. с каждой стороны.", "Это «В строке две метки.»", "Не надо!"],
    "german": ["Das lief am 3. Mai 2020 im 4. Stock.", "Viele, z. B. jene, fehlen."],
    "spanish": ["EE. UU. y otros.", "¿De verdad?", "¡No!"],
    "greek": ["Γιατί λείπει το X από το dev.csv;", "Το CSV, BED κ.λπ.", "Η τιμή· το όριο."],
    "hindi": ["डॉ. Tellwyn ने लेबल बदला।", "अंश 1.5 तक बढ़ा |", "पूछा, \"क्या यह है?\" और बदल दिया॥"],
    "arabic": ["قال: «هل هذا؟» ثم غير.", "لماذا يغيب؟", "كتب د. Ilvenne ذلك."],
    "korean": ["검토자는 \"인가?\"라고 적었다.", "GC 비율은 1.2에서 올랐다."],
    "thai": ["ถูกฝึกในปี พ.ศ. 2537 ที่ห้องทดลอง", "ยีน X อยู่บนสายลบ", "อ่าน CSV ฯลฯ ได้ทั้งหมด"],
}
CLOSE = {
    "chinese": ["日志写道：“第1行有两个标签。”", "数据已划分．", "审稿人问：“是吗？”随后改了。", "损失先下降……然后回升到0.5。", "真的吗？！"],
    "japanese": ["「見出しを信じるな。中身を見よ。」と手引きにあります。", "モデルX v3.1は学習しました（図2参照）。", "効果は小さい……と思われます。"],
    "no space": ["The states were pooled by mean.", "The reviewer asked.", "We left."],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("gap", [" ", "\n", "  "])
def test_spaced(name, gap):
    text = gap.join(CASES[name])
    assert [text[a:b] for a, b in sentences.split(text, M)] == CASES[name]


@pytest.mark.parametrize("name", CLOSE)
def test_without_spaces(name):
    text = "".join(CLOSE[name])
    assert [text[a:b] for a, b in sentences.split(text, M)] == CLOSE[name]


def test_headings_lists_and_blank_lines():
    text = "  Model card X v0.1\n \n5. Load dev.csv.\r\n\r\n• We need memory\n\n3) Count\nrows.\n\n\n"
    assert [text[a:b] for a, b in sentences.split(text, M)] == ["Model card X v0.1", "5. Load dev.csv.", "• We need memory", "3) Count\nrows."]


def test_the_document_decides():
    text = "We use a Qrz. 5 here. The Qrz. Abel value is high. Then we stop."
    assert [text[a:b] for a, b in sentences.split(text, M)] == ["We use a Qrz. 5 here.", "The Qrz. Abel value is high.", "Then we stop."]
    text = "We like the foo. Abel likes it. The foo was here."
    assert [text[a:b] for a, b in sentences.split(text, M)] == ["We like the foo.", "Abel likes it.", "The foo was here."]


def test_everything_but_white_space_is_in_a_sentence():
    for text in ["a.b.c ... ) ] ” x!!", "“ unclosed. The quote", "。。。", "...", "?", "((((", "﻿x. Y", ") . (", "«»", "𝔸 sentence. 𝔹 too."] + ["".join(v) for v in CASES.values()]:
        got = sentences.split(text, M)
        assert "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split())
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_table(spark):
    rows = [(1, "The end. We left.", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (None, "We.", 0), (5, "We go. " * 20_000, 0), (6, "The end. We left.", 0), (6, "The end. We left.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sent_start int")
    got = [tuple(r) for r in sentences.sentences(df).collect()]
    assert sorted(x for x in got if x[0] in (1, 6)) == [(1, 0, 8), (1, 9, 17), (6, 0, 8), (6, 0, 8), (6, 9, 17), (6, 9, 17)]
    assert (None, 0, 3) in got and sum(x[0] == 5 for x in got) == 20_000 and not any(x[0] in (2, 3, 4) for x in got)
    assert sentences.sentences(df.where("false")).collect() == []


def test_corpus_model(spark):
    texts = ["The zq. 5 of it.\n\nThe rest"] * 5 + ["A plain word. The word"] * 5
    model = sentences.corpus_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert "zq" in model.abbreviations and "word" not in model.abbreviations and "The" in model.starters and "word" in model.lower
