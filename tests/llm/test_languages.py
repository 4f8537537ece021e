"""Problem 1: labels, filters, held-out accuracy and mixed texts."""

import pytest

from stanzaflow.llm import languages as L

UK = "Вона знає цю тиху дорогу за вікном. Ми читаємо старі листи у полі. Він пише і мовчить. Сніг тане над рікою."
RU = "Она знает эту тихую дорогу за окном. Мы читаем старые письма в поле. Он пишет и молчит. Снег тает над рекой."
EN = "She knows this quiet road behind the window. We read the old letters in the field. He writes and is silent."
PL = "Ona zna tę cichą drogę za oknem. Czytamy stare listy w polu. On pisze i milczy. Śnieg topnieje nad rzeką."


@pytest.fixture(scope="module")
def ident():
    sample = [(c, t) for c, t in (("uk", UK), ("ru", RU), ("en", EN), ("pl", PL)) for _ in range(4)] + [("uk", RU), ("en", PL)]  # two wrong labels
    return L.Identifier(L.fit(sample))


@pytest.mark.parametrize(("label", "want"), [
    (None, None), (" ", None), ("-", None), ("nan", None), ("unknown", None), ("Ukrainian", {"uk"}), ("Ukr.", {"uk"}), ("RU", {"ru"}), ("Russian, Ukrainian", {"ru", "uk"}), ("Belarusian (be)", {"be"}),
    ("qırımtatar", {"crh"}), ("Crimean Tatar", {"crh"}), ("Deutsch", {"de"}), ("中文", {"zh"}), ("हिन्दी", {"hi"}), ("русский", {"ru"}), ("Klingon", {"?"}),
    ("Nepali", {"?"}), ("Bengali", {"?"}), ("Polynesian", {"?"}), ("Nederlands", {"?"}), ("Rusyn", {"?"}), ("Беларуская мова", {"be"}), ("po polsku", {"?"}), ("język polski", {"pl"}), ("нем.", {"de"}), ("Qırım Tatar dili", {"crh"}),
    ("a label that goes on for more than two dozen characters, Ukrainian", {"?", "uk"}),
])
def test_labels(label, want):
    assert L.parse_label(label) == (None if want is None else frozenset(want))


def test_wrong_labels_are_seen_through(ident):
    for code, text in (("uk", UK), ("ru", RU), ("en", EN), ("pl", PL)):
        (got,) = ident.stretches([text])
        assert {x[2] for x in got} == {code} and all(0.5 < x[3] <= 1 for x in got)


def test_mixed_text_and_positions(ident):
    text = "Сніг тане над рікою.\n\nШе reads. ".replace("Ше", "She") + "We read the old letters in the field."
    (got,) = ident.stretches([text])
    assert [x[2] for x in got] == ["uk", "en"] and text[got[0][0] : got[0][1]] == "Сніг тане над рікою."


def test_none_of_the_languages(ident):
    other = "Le vent souffle sur la rivière et les enfants regardent la neige. Nous lisons de vieilles lettres dans le jardin. " * 6
    assert {x[2] for x in ident.stretches([other])[0]} == {L.OTHER}


def test_nothing_to_say(ident):
    assert ident.stretches([None, "", "12.03.2020", "* * *"]) == [[], [], [], []]


def test_false_positives_are_corrected(ident):
    hits, total, _ = ident.filters.popcounts([EN])
    assert (hits <= total[:, None, :] + 1e-9).all() and hits[0, L.LANGUAGES.index("zh")].max() == 0


def test_found(spark):
    rows = [(f"u{i}", "Ukrainian", UK) for i in range(4)] + [(f"r{i}", "Russian", RU) for i in range(4)] + [("x", "Russian", UK), ("y", None, RU), ("y", None, RU), ("z", "Ukrainian, Russian", UK + "\n\n" + RU), ("n", None, None)]
    d = spark.createDataFrame(rows, "ID string, language string, text string")
    assert {tuple(r) for r in L.found(d).collect()} == {("x", "uk"), ("y", "ru")}
    assert L.found(d.limit(0)).count() == 0
    s = [tuple(r)[:2] + (r["lang"],) for r in L.stretches(d).filter("doc_key = 'z'").orderBy("stretch").collect()]
    assert s == [("z", 1, "uk"), ("z", 2, "ru")]
