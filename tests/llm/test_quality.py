"""Problem 8: figures by hand, the weighted median, and the verdicts."""

import numpy as np

from stanzaflow.llm import quality as Q

PROSE = ["Вона знає цю дорогу, а ми читаємо старі листи у полі. Він пише і мовчить, поки тане сніг.", "Ми йдемо до ріки, і вона співає. У полі тихо, а над рікою дим. Він знає нас.", "Я несу воду, бо ти просиш.\nА у саду темно,\nі ми чекаємо ранку."]
JUNK = ["сніг, дим, кіт, лист, стіл, ніч, міст, пес, гай, день", "- сніг\n- дим\n- кіт\n- міст\n- ніч", "| a | 1 | 2 |\n| b | 3 | 4 |\n| c | 5 | 6 |", "*" * 200, "2021-03-06 19:06:20 INFO rows=233 ms=951\n" * 6, "8BbDySe4TIyoPU9suv6HREkM4RpqR3wz\nPcf62skPzrJMIVy5voLg65W1whKCqYg0", " \n "]


def test_figures_by_hand():
    s = Q.Counter({})(["ab cde. 1\nx!", "", "今天"])
    assert s["n_words"].tolist() == [4, 0, 2] and s["n_lines"].tolist() == [2, 0, 1] and s["n_chars"].tolist() == [12, 0, 2]
    assert abs(s["mean_word_length"][0] - 7 / 4) < 1e-9 and s["end_mark_ratio"].tolist() == [0.5, 0.0, 0.0]
    assert abs(s["digit_ratio"][0] - 1 / 9) < 1e-9


def test_weighted_median():
    d, v, w = np.array([0, 0, 0, 2]), np.array([1.0, 5.0, 9.0, 4.0]), np.array([1.0, 1.0, 5.0, 2.0])
    assert Q._weighted_median(d, v, w, 3).tolist() == [9.0, 0.0, 4.0]


def test_hash_is_of_the_word():
    a = Q.document_words(["Сніг тане", "тане СНІГ"], np.array([0, 0]))
    assert a[0, 0] == 2 and sorted(n for k, n in a.items() if k[1]) == [2, 2]


def test_verdicts(spark):
    rows = [(i, PROSE[i % 3] + f" Слово{i % 17} тут.", "uk") for i in range(300)] + [(1000 + i, t, None) for i, t in enumerate(JUNK)] + [(2000, None, "uk"), (None, "x", "uk")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"] for r in Q.found(d).collect()}
    assert got == {1000 + i for i in range(len(JUNK))}
    r = {x["doc_key"]: x for x in Q.rate(d).collect()}
    assert r[0]["natural"] and not r[1001]["natural"] and r[2000]["natural"] is None
    assert abs(sum(r[0]["contributions"]) - r[0]["distance"]) < 1e-9 and r[0]["lang"] == "uk"
    assert Q.found(d.limit(0)).count() == 0


def test_the_greater_part_decides(spark):
    prose = " ".join(PROSE)
    rows = [(i, PROSE[i % 3] + f" Слово{i % 17} тут.", "uk") for i in range(300)] + [(900, prose + "\n- сніг\n- дим", "uk"), (901, "Вона знає нас.\n" + "| 1 | 2 | 3 |\n" * 20, "uk")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in Q.found(d).collect()} == {901}


def test_a_third_of_junk_stays_junk(spark):
    pool = [x + "." for t in PROSE for x in t.replace("\n", " ").rstrip(".").split(". ")] + ["Літо минає, і ми знову йдемо в гори", "Чому ти мовчиш, коли вона питає?", "Над містом довго стоїть тиха осіння ніч.", "Батько читає листи й не плаче.", "Хто там співає за рікою!"]
    rng = np.random.default_rng(1)
    prose = [(i, " ".join(rng.choice(pool, 3 + i % 4)), "uk") for i in range(200)]
    log = lambda i: "\n".join(f"2021-03-{d:02} 19:06:{(i * d) % 60:02} знає rows={i * 37 % 991} ms={i * d}" for d in range(10, 16 + i % 5))
    for junk in (lambda i: "вона знає, сніг, дим, кіт, лист, стіл, ніч, міст, пес, гай, день", log):
        d = spark.createDataFrame(prose + [(1000 + i, junk(i), "uk") for i in range(100)], "doc_id bigint, text string, lang string")
        got = {r["doc_id"] for r in Q.found(d).collect()}
        assert len(got & set(range(1000, 1100))) == 100 and len(got) <= 102
