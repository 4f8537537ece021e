"""Problem 4: boundaries by hand, positions, and the corpus evidence."""

import pytest

from stanzaflow.llm import sentences as S

CORPUS = [
    "На вул. Вербинській, буд. 33, тане сніг. Вона знає вул. Сивогорську. Сніг тане.", "Проф. Журавлик співає. Проф. Лозина мовчить. Вона мовчить і знає.", "Ми чекали ще 86 хв. Вона повільно йде. Чекали 5 хв. Він іде, вона йде, він знає.",
    "Дим… бо ранок росте. Дим… бо вечір. Ранок росте.", "Ой! як тихо. Ой! як темно. Як ти знаєш дорогу?", "“Ти?” said the rain. “He?” said she. The rain fell.", "「今天？」她说。「明天？」她说。他在。", "В XIX в. здесь пусто. Он в поле. Мосты и т. д. Он знает.", "Снег идёт, и он знает, что он в поле, а он молчит. Коли вона йде, вона знає, а вона мовчить.",
] * 3


@pytest.fixture(scope="module")
def seg():
    return S.Segmenter(S.evidence(CORPUS))


def cut(seg, text):
    return [text[a:b] for a, b in seg.spans(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("Сніг тане. Вона знає.", ["Сніг тане.", "Вона знає."]),
    ("На вул. Сивогорській тане сніг. Вона мовчить.", ["На вул. Сивогорській тане сніг.", "Вона мовчить."]),
    ("Ми чекали 7 хв. Вона йде.", ["Ми чекали 7 хв.", "Вона йде."]),
    ("Проф. Журавлик о 9.58 мовчить.", ["Проф. Журавлик о 9.58 мовчить."]),
    ("Рядок без знака\n\nДругий рядок\nтриває.", ["Рядок без знака", "Другий рядок\nтриває."]),
    ("* * *\n\nТак.", ["Так."]), ("27.08.2016", ["27.08.2016"]), ("", []), ("— …", []),
    ("Дим… бо вечір.\nДим… Вона знає.", ["Дим… бо вечір.", "Дим…", "Вона знає."]),
    ("«Ти знаєш?» — сказала вона. Так.", ["«Ти знаєш?» — сказала вона.", "Так."]),
    ("«Ти знаєш!» Вона мовчить.", ["«Ти знаєш!»", "Вона мовчить."]),
    ("(Сніг тане.)\nВона знає?!", ["(Сніг тане.)", "Вона знає?!"]),
    ("「今天？」她说。他在桥上。好！", ["「今天？」她说。", "他在桥上。", "好！"]),
    ("“सुबह?” माँ ने पूछा। डॉ. मेघवन 3.2 कि.मी. दूर सो गईं।", ["“सुबह?” माँ ने पूछा।", "डॉ. मेघवन 3.2 कि.मी. दूर सो गईं।"]),
    ("Його звали О. Б. Журавлик, і сніг тане.", ["Його звали О. Б. Журавлик, і сніг тане."]),
    ("Мосты и т. д. Он знает.", ["Мосты и т. д.", "Он знает."]),
])
def test_boundaries(seg, text, want):
    assert cut(seg, text) == want


def test_capital_verse_uses_the_corpus(seg):
    text = "Вона знає\nРанок і дим…\nБо ранок росте\nНад полем.\nВона мовчить\nЗнову."
    assert cut(seg, text) == ["Вона знає\nРанок і дим…\nБо ранок росте\nНад полем.", "Вона мовчить\nЗнову."]


def test_positions_are_of_the_stored_text(seg):
    text = "Сн​іг тане.​ Вона знає⁠.  "
    assert [(b, text[b - 1]) for _, b in seg.spans(text)] == [(10, "."), (22, "⁠")] or [text[b - 1] for _, b in seg.spans(text)] == [".", "."]


def test_found(spark):
    d = spark.createDataFrame([("a", "Так. Ні."), ("a", "Так. Ні."), ("b", None), ("c", ""), (None, "Так.")], "ID string, text string")
    assert {tuple(r) for r in S.found(d).collect()} == {("a", 1, 4), ("a", 2, 8)}
    assert S.found(d.limit(0)).count() == 0


def test_whole_long_text(seg):
    assert len(seg.spans("Сніг тане. Вона знає. " * 5000)) == 10000


def test_rare_evidence_counts_in_a_large_corpus(spark):
    rows = [(f"r{i}", "Сьогодні акад. Журавлик мовчить, і сніг тане у полі.") for i in range(5)]
    rows += [(f"f{i}", "вона знає і мовчить у полі. " * 20000) for i in range(12)]  # more than 5 x 200,000 words
    d = spark.createDataFrame(rows, "ID string, text string")
    got = [tuple(r) for r in S.found(d).filter("poem_id like 'r%'").collect()]
    assert sorted(got) == [(f"r{i}", 1, 52) for i in range(5)]


def test_joined_evidence_is_the_whole_evidence(spark):
    texts = [" ".join(f"На вул. Слово{i % 7} тане сніг. Вона знає{'!' if i % 2 else '?'} Він пише… І мовчить." for i in range(k, k + 6)) for k in range(40)] + ["「今天？」她说。他在桥上。好！"]
    seg = S.Segmenter(S.evidence(texts))
    want = {(str(k), i, b) for k, t in enumerate(texts) for i, (_, b) in enumerate(seg.spans(t), 1)}
    assert {tuple(r) for r in S.found(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "ID string, text string")).collect()} == want
