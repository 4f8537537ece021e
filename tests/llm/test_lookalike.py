"""Problem 3: the rewriting, and the found rows."""

import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stanzaflow.llm import lookalike as L

CORPUS = ["Я люблю тишу у полі, а вона співає з нами. Це ім’я. Він і вона.", "I love the silence, she rescues a page. He has a pen.", "Ой! ёлка и йод, ы", "«ａ０１» （ ） ，！　 oο Αа", "今天他在桥上！「好？」", "кíт é ñ ï ë ﬂ", "по‑своєму ім'я ʼ ­​‌‍⁠﻿     ‐"]


@pytest.fixture(scope="module")
def norm():
    usual = "".join(map(chr, range(32, 127))) + "абвгдеєжзиіїйклмнопрстуфхцчшщьюяёыэ’" + "АБВГДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯ"
    return L.Normaliser(dict(Counter("".join(CORPUS) + usual * 50 + "２０１５ｔｈｅ")))


@pytest.mark.parametrize(("bad", "good"), [
    ("нa полі", "на полі"), ("Tи знаєш", "Ти знаєш"), ("я люблю тишу", "я люблю тишу"), ("ти​ша", "тиша"), ("по‑своєму", "по-своєму"), ("мʼяч", "м’яч"), ("ім'я", "ім’я"),
    ("thе silence", "the silence"), ("２０１５", "2015"), ("ｔｈｅ silence", "the silence"), ("й", "й"), ("слово， і", "слово, і"), ("y полі вона", "у полі вона"), ("ﬂoats", "floats"), ("（так）", "(так)"), ("в 2О22 році", "в 2022 році"),
])
def test_rewrites(norm, bad, good):
    assert norm.normalise(bad) == good


@pytest.mark.parametrize("fine", ["Це — «так»… „ja“ “yes”", "У XIX ст. тут", "今天，他！「好？」。", "ру́ка", "क़लम पढ़ना", "I know, а вона каже", "Ой! як\nтихо", "", "km 17.9", "ok Ελλάδα"])
def test_leaves_alone(norm, fine):
    assert norm.normalise(fine) == fine


def test_classes_are_transitive():
    by = {m: r for r, ms in L.classes().items() for m in ms}
    assert by["a"] == by["а"] == by["ａ"] and by["o"] == by["ο"] == by["о"] and by["​"] == by["⁠"] == by[""]
    assert by["ё"] == by["ë"] == by["ё"]


def test_short_values_go_by_frequency(spark):
    d = spark.createDataFrame([(str(i), v) for i, v in enumerate(["He"] * 9 + ["Не"] + ["вона"] * 5 + ["вoна", None, "", " "])], "id string, pronoun string")
    got = {r["row_key"]: (r["value"], r["changed"]) for r in L.normalise_column(d, "id", "pronoun", *L.for_values(d, "pronoun")).collect()}
    assert got["9"] == ("He", True) and got["15"] == ("вона", True) and got["0"] == ("He", False)
    assert got["16"] == (None, False) and got["17"] == ("", False)


def test_found_and_empty(spark):
    p = spark.createDataFrame([("a", "нa полі"), ("a", "нa полі"), ("b", "на полі"), ("c", None), (None, "нa")], "ID string, text string")
    a = spark.createDataFrame([("1", "ми"), ("2", "ми​")], "id string, pronoun string")
    assert {tuple(r) for r in L.found(p, a).collect()} == {("poems_for_manual_annotation.text", "a"), ("annotations.pronoun", "2")}
    assert L.found(p.limit(0), a.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=40))
def test_one_form_is_stable(text):
    n = L.Normaliser(dict(Counter("".join(CORPUS) + text)))
    once = n.normalise(text)
    assert n.normalise(once) == once or unicodedata.normalize("NFKC", once) != once


def test_long_text(norm):
    assert norm.normalise("нa полі " * 20000) == "на полі " * 20000


def test_one_word_sentence_of_twins(spark):
    rows = [(str(i), "Снег идёт. Ах! Он молчит.") for i in range(5)] + [("p", "Снег идёт.\nAx! Он знает, и он молчит.")]
    d = spark.createDataFrame(rows, "ID string, text string")
    got = {r["row_key"]: r["value"] for r in L.normalise_column(d, "ID", "text", *L.for_text(d)).collect()}
    assert got["p"] == "Снег идёт.\nАх! Он знает, и он молчит." and got["0"] == rows[0][1]
    assert {tuple(r) for r in L.changed_rows(d, "ID", "text", *L.for_text(d)).collect()} == {("p",)}


def test_a_rare_spelling_decides_in_a_large_corpus(spark, monkeypatch):
    """Three occurrences of a word among 300,000 values tell its script, in chunks of any size; repeated rows stay."""
    rows = [(f"f{i}", "вона") for i in range(2000)] + [("a", "хор"), ("b", "хор"), ("c", "хор"), ("d", "xop"), ("d", "xop"), ("e", "Cap"), ("f", "Cap"), ("g", "Сар")]
    d = spark.createDataFrame(rows, "id string, pronoun string")
    d = d.unionByName(spark.range(298_000).selectExpr("concat('x', id) as id", "'вона' as pronoun"))
    norm, counts = L.for_values(d, "pronoun")
    assert {r["w"]: r["n"] for r in counts.collect()} == {"хор": 3, "xop": 2, "Cap": 2, "Сар": 1}
    whole = sorted(map(tuple, L.normalise_column(d, "id", "pronoun", norm, counts).filter("length(row_key) = 1").collect()))
    monkeypatch.setattr(L, "CHUNK", 5)
    assert whole == sorted(map(tuple, L.normalise_column(d, "id", "pronoun", *L.for_values(d, "pronoun")).filter("length(row_key) = 1").collect()))
    assert whole == [("a", "хор", False), ("b", "хор", False), ("c", "хор", False), ("d", "хор", True), ("d", "хор", True), ("e", "Cap", False), ("f", "Cap", False), ("g", "Cap", True)]
