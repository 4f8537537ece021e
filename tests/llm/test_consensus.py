"""Problem 5: recovery of simulated labels, alpha by hand, and the handling of records."""

import datetime

import numpy as np

from stanzaflow.llm import consensus as C


def simulated(n=400, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.choice(5, n, p=[0.4, 0.2, 0.2, 0.1, 0.1])
    rows = []
    for a in range(9):
        for i in range(n):
            if rng.random() < 0.55:
                good = {7: 0.0, 8: -1.0}.get(a, 0.85)
                y = 0 if a == 7 else (truth[i] + 1) % 5 if a == 8 and rng.random() < 0.7 else truth[i] if rng.random() < max(good, 0) else rng.integers(5)
                rows.append((f"i{i}", f"a{a}", int(y)))
    return truth, rows


def test_beats_the_majority(spark):
    truth, rows = simulated()
    v = spark.createDataFrame(rows, "item string, annotator string, label int")
    c = C.Consensus(v, passes=8)
    got = {r["item"]: C.OPTIONS.index(r["label"]) for r in c.labels().collect()}
    votes = {}
    for i, _, y in rows:
        votes.setdefault(i, []).append(y)
    acc = np.mean([got[i] == truth[int(i[1:])] for i in votes])
    maj = np.mean([np.bincount(y, minlength=5).argmax() == truth[int(i[1:])] for i, y in votes.items()])
    assert acc > 0.93 and acc >= maj
    rel = {r["annotator"]: r["reliability"] for r in c.annotators().collect()}
    assert min(rel[f"a{k}"] for k in range(7)) > 0.75 > max(rel["a7"], rel["a8"])


def test_the_dual_rises_and_sigma_as_a_table_gives_the_same(spark, monkeypatch):
    truth, rows = simulated(n=150, seed=5)
    v = spark.createDataFrame(rows, "item string, annotator string, label int")
    few = C.Consensus(v, passes=4)
    assert all(b > a for a, b in zip(few.dual, few.dual[1:])) and len(few.dual) == 4
    monkeypatch.setattr(C, "FEW", 0)
    monkeypatch.setattr(C, "CHUNK", 200)
    table = C.Consensus(v, passes=4)
    assert not table.few and np.allclose(few.dual, table.dual) and np.allclose(few.prior, table.prior)
    one, two = ({r[0]: r[1:] for r in c.labels().collect()} for c in (few, table))
    assert one.keys() == two.keys() and all(one[i][0] == two[i][0] and abs(one[i][1] - two[i][1]) < 1e-6 for i in one)
    one, two = ({r[0]: r[1:] for r in c.annotators().collect()} for c in (few, table))
    assert one.keys() == two.keys() and all(abs(one[a][1] - two[a][1]) < 1e-6 for a in one)
    assert np.allclose(few.agreement().first(), table.agreement().first())


def test_too_long_a_step_is_taken_back(spark):
    _, rows = simulated(n=60, seed=6)
    c = C.Consensus(spark.createDataFrame(rows, "item string, annotator string, label int"), passes=12, damping=40.0)
    assert c.damping < 40 and all(b >= a - 1e-7 * abs(a) for a, b in zip(c.dual, c.dual[1:]))


def test_many_annotators(spark):
    """A hundred thousand annotators with a judgment or two each: no parameter is collected or broadcast."""
    v = spark.range(200_000).selectExpr("concat('i', id % 40000) as item", "concat('a', id % 100003) as annotator", "cast(if(hash(id) % 5 = 0, id % 5, id % 40000 % 5) as int) as label").distinct()
    c = C.Consensus(v.groupBy("item", "annotator").agg({"label": "max"}).toDF("item", "annotator", "label"), passes=1)
    assert not c.few and c.labels().count() == 40_000 and c.annotators().count() == 100_003


def test_records(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [("1", "Ann ", "p", "1st person", t(1)), ("1", "Ann ", "p", "1st person", t(1)), ("2", " ann", "p", "MIXED", t(2)), ("3", "bo", "p", " 2nd  Person", t(1)), ("4", "cy", "p", None, t(1)), ("5", None, "p", "Other", t(1)), ("6", "di", "p", "rubbish", t(1)), ("7", "ed", None, "Other", t(1))]
    d = spark.createDataFrame(rows, "id string, annotator_id string, poem_id string, perspective_primary string, created_at timestamp")
    assert {tuple(r) for r in C.judgments(d).collect()} == {("p", "ann", 3), ("p", "bo", 1)}
    assert C.found(d).count() == 0 and C.found(d, least=2).count() == 1
    assert C.found(d.limit(0)).count() == 0


def test_alpha_by_hand(spark):
    v = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1), ("c", 1)], "item string, label int")
    r = C.krippendorff(v).first()
    # four paired judgments, three 0 and one 1: disagreement 2 observed, (16 - 10) / 3 = 2 expected
    assert (r["items"], r["judgments"], r["krippendorff_alpha"], r["pair_agreement"]) == (2, 4, 0.0, 0.5)
    assert C.krippendorff(v.limit(0)).first()["krippendorff_alpha"] is None
