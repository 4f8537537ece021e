"""Operators against enumeration and row-by-row refits; plans; failures that must be seen."""

import itertools
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import segment as S
from stanzaflow.operators import cohort, counts, models, posts, qa, ranks
from stanzaflow.plans import catalogue
from stanzaflow.plans.stages import Registry, Stage
from stanzaflow.sources import io

SF = "/root/testdata/sf0.001"


def test_stanza_exposure_takes_the_first_text(spark):
    d = spark.createDataFrame([("p", 1, 2, "d e"), ("p", 1, 1, "a b c"), ("p", 1, 0, None), ("p", 2, 0, "x"), ("q", None, 0, "y")], "poem_id string, stanza_index int, row int, text string")
    v = spark.createDataFrame([("p", 2, 5), ("z", 1, 9)], "poem_id string, stanza_index int, n_finite_verbs int")
    (r,) = counts.stanza_exposure(d, order=["row"], verbs=v).collect()
    assert (r["exposure_n_stanzas"], r["exposure_n_tokens"], r["exposure_n_finite_verbs"], r["has_index_gap"]) == (2, 4, 5, False)
    assert counts.stanza_exposure(d.limit(0), order=["row"]).count() == 0


def test_normal_and_exact_p(spark):
    z = [0.0, 1.96, -4.0, 10.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(ranks.two_sided_p("z")).collect()]
    assert got[:4] == [math.erfc(abs(x) / math.sqrt(2)) for x in z[:4]] and got[4] is None
    for n1, n2 in ((3, 3), (2, 5), (4, 3), (1, 6)):
        us = [sum(i < j for i, j in itertools.product(set(range(n1 + n2)) - set(c), c)) for c in itertools.combinations(range(n1 + n2), n1)]
        want = np.bincount(us, minlength=n1 * n2 + 1) / len(us)
        assert np.allclose(ranks.exact_u(n1, n2), want)
    d = spark.createDataFrame([("g", "x", float(v)) for v in (1, 2, 3)] + [("g", "y", float(v)) for v in (4, 5, 6)], "g string, s string, v double")
    assert ranks.mann_whitney(d, ["g"], "v", "s", "x", "y").first()["p"] == pytest.approx(0.1)
    tied = d.unionByName(spark.createDataFrame([("g", "x", 4.0)], d.schema))
    r = ranks.mann_whitney(tied, ["g"], "v", "s", "x", "y").first()
    assert r["p"] == math.erfc(r["z"] / math.sqrt(2))


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_wild_bootstrap_is_the_row_by_row_refit(spark, family):
    rng = np.random.default_rng(4)
    rows = [(f"a{i % 4}", "after" if i % 2 else "before", int(rng.integers(0, 9)), 10) for i in range(40)] + [(None, "after", 3, 10), ("a1", "other", 3, 10), ("a1", "after", 3, 0)]
    d = spark.createDataFrame(rows, "a string, per string, k int, n int").withColumn("g", F.lit("g"))
    draws = 64
    r = models.wild_bootstrap(d, ["g"], "k", "n", "per", "before", "after", "a", family, draws).first()
    used = [x for x in rows[:40]]
    k, n, post = (np.array([x[i] for x in used], float) if i != 1 else np.array([x[1] == "after" for x in used]) for i in (2, 3, 1))
    total = lambda y: [(y[post == s].sum(), n[post == s].sum()) for s in (False, True)]

    def t(y):
        (s1, n1), (s2, n2) = total(y)
        if family == "poisson":
            return (math.log(s2 / n2) - math.log(s1 / n1)) / math.sqrt(1 / s1 + 1 / s2)
        return (math.log(s2 / (n2 - s2)) - math.log(s1 / (n1 - s1))) / math.sqrt(1 / (s1 * (1 - s1 / n1)) + 1 / (s2 * (1 - s2 / n2)))

    (s1, n1), (s2, n2) = total(k)
    mu = n * np.where(post, s2 / n2, s1 / n1)
    sign = {(r["a"], r["d"]): 1 if r["u"] < 1 << 31 else -1 for r in spark.createDataFrame([(f"a{i}", d) for i in range(4) for d in range(1, draws + 1)], "a string, d int").withColumn("u", ranks.lot("a", 42, F.col("d"))).collect()}
    extreme = 0
    for i in range(1, draws + 1):
        y = mu + np.array([sign[x[0], i] for x in used]) * (k - mu)
        y = np.maximum(y, 1e-8) if family == "poisson" else n * np.clip(y / n, 1e-6, 1 - 1e-6)
        extreme += abs(t(y)) >= abs(t(k)) - 1e-9
    assert r["extreme"] == extreme and r["draws"] == draws and r["t"] == pytest.approx(t(k)) and r["p_wild"] == (extreme + 1) / (draws + 1)
    none = models.wild_bootstrap(d.withColumn("k", F.lit(0)), ["g"], "k", "n", "per", "before", "after", "a", family, 9).first()
    assert none["coef"] is None and none["draws"] == 0
    assert models.wild_bootstrap(d.limit(0), ["g"], "k", "n", "per", "before", "after", "a", family, 9).count() == 0


def test_separators_and_precedence(spark):
    body = "\n***\n".join("abcdefg")
    assert S.spaced_separators(body, 2) == ["a\n***\nb\n***\nc\n***\nd", "e\n***\nf\n***\ng"]
    assert S.spaced_separators(body, 7) == list("abcdefg") and S.spaced_separators(body, 8) is None and S.spaced_separators(body, 1) is None
    assert S.spaced_separators(body, 4) == ["a", "b\n***\nc", "d\n***\ne\n***\nf", "g"]
    text = "one\ntwo\nthree"
    assert S.resolved(text, 2, [0, 2], (3, [0, 1, 2])) == (["one\ntwo", "three"], "manual_csv", True, False, 2)
    assert S.resolved(text, 2, None, (3, [0, 1, 2])) == (["one", "two", "three"], "gpt_batch_linecuts", True, False, 3)
    assert S.resolved(text, 2, [0], (3, [0, 1, 2]))[1] not in ("manual_csv", "gpt_batch_linecuts")
    assert S.resolved(text, 2, None, (1, None)) == ([text], "single", True, False, 1) and S.resolved(None, 1, None, None)[1] == "empty"
    d = spark.createDataFrame([("a", text, 2), ("b", text, 2), ("c", None, 1), ("d", text, 1)], "k string, t string, n int")
    o = spark.createDataFrame([("a", [0, 2])], "k string, starts array<int>")
    v = spark.createDataFrame([("a", 3, [0, 1, 2]), ("b", 3, [0, 1, 2])], "k string, count int, starts array<int>")
    got = {r["k"]: (r["way"], r["expected"], len(r["parts"])) for r in posts.segmented(d, "k", "t", "n", o, v).collect()}
    assert got == {"a": ("manual_csv", 2, 2), "b": ("gpt_batch_linecuts", 3, 3), "c": ("empty", 1, 1), "d": ("single", 1, 1)}
    assert posts.segmented(d.limit(0), "k", "t", "n").count() == 0


def test_failed_completions_are_told(spark):
    def client():
        def ask(texts):
            raise OSError("no line")
        return ask

    (r,) = io.completions(spark.createDataFrame([("x",)], "t string"), "t", client, retries=1).collect()
    assert r["completion"] is None and r["failure"] == "OSError: no line"


def test_a_failing_stage_stops_the_run(spark):
    seen = []
    r = Registry()
    r.add(Stage("a", lambda s, x: seen.append("a") or s.range(3)))
    r.add(Stage("b", lambda s, x: x["a"].select(F.raise_error(F.lit("broken")).alias("e")), ("a",)))
    r.add(Stage("c", lambda s, x: seen.append("c") or x["b"], ("b",)))
    assert r.run(spark, ["c"], dry=True) == (["a", "b", "c"], {}) and seen == []
    with pytest.raises(RuntimeError, match="stage b failed; done before it: a"):
        r.run(spark, ["c"])
    assert seen == ["a"]


def test_small_result_operators(spark, tmp_path):
    d = spark.createDataFrame([(" x ", "1"), (None, "2"), ("unknown", "3"), ("x", "4"), ("b", "5")], "v string, `id ` string")
    got = [(r["level"], r["n"]) for r in counts.level_counts(d, "v").orderBy("position").collect()]
    assert got == [("x", 2), ("b", 1), ("missing", 2)] and counts.level_counts(d.limit(0), "v").count() == 0
    assert cohort.with_defaults(cohort.stripped_columns(d), {"id": 0, "q": "OK"}).columns == ["v", "id", "q"]
    s = spark.createDataFrame([("A. B b. C", " B b "), ("A.\n B b. C", "B"), ("A. B", "zz"), (None, "A"), ("A. B", None), ("A. B", "A")], "t string, c string")
    rows = [(r["context_-1"], r["context_+0"], r["context_+1"]) for r in qa.sentence_windows(s, "t", "c", 1).collect()]
    assert rows == [("A", "B b", "C"), ("A", "B b", "C"), ("", "", ""), ("", "", ""), ("", "", ""), ("", "A", "B")]
    for n in ("old", "new"):
        d.select("v").write.parquet(str(tmp_path / n))
    assert io.remove_stale(spark, str(tmp_path), ["new"]) == ["old"] and os.listdir(tmp_path) == ["new"]
    lo = spark.createDataFrame([(a, p, k, 10) for a, p, k in (("u", "b", 2), ("u", "a", 4), ("v", "b", 2), ("v", "a", 8), ("w", "b", 1), ("w", "a", 1))], "a string, p string, k int, e int").withColumn("g", F.lit(1))
    r = models.without_one(lo, ["g"], "k", "e", "p", "b", "a", "a").first()
    assert (r["n_variants"], r["least"], r["most"]) == (3, pytest.approx(5 / 3), pytest.approx(3.0))


@pytest.mark.parametrize("name", ["cell_rate_ratio", "period_reconciliation", "onset_filter", "ego_topk", "author_roster", "content_hash_keys"])
def test_text_is_no_shuffle_key_where_it_is_not_asked_for(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys
    assert not any("text#" in k for k in keys)


def test_small_series(spark):
    y = np.r_[np.full(6, 0.1), np.full(6, 5.0)] + np.random.default_rng(1).normal(0, 0.05, 12)
    r = models.change_point_interval(y, np.arange(2013, 2025, dtype=float), draws=50, penalty=1.0)
    assert r["detected"] == 2019 and r["low"] <= r["high"] and models.change_point_interval(y[:4], np.arange(4.0))["detected"] is None
    x = np.arange(30.0)
    assert np.allclose(models.weighted_loess(x, 2 * x + 1, np.ones(30), x), 2 * x + 1)
    assert np.allclose(models.weighted_loess(np.repeat(x, 2), np.repeat(x**2, 2), np.ones(60), x), models.weighted_loess(x, x**2, np.full(30, 2.0), x))
    for df_, v in ((1, 3.841459), (2, 5.991465), (5, 11.070498), (4, 9.487729)):
        assert models.chi2_tail(v, df_) == pytest.approx(0.05, abs=1e-6)
    d = spark.createDataFrame([(f"a{i % 7}", float(i % 12), 0.1 * (i % 12)) for i in range(400)], "a string, x double, y double")
    b = models.smooth_bands(d, "a", "x", "y", draws=20).orderBy("x").collect()
    assert len(b) == 12 and all(r["low"] - 1e-9 <= r["smooth"] <= r["high"] + 1e-9 and abs(r["smooth"] - 0.1 * r["x"]) < 1e-6 for r in b)
    assert models.smooth_bands(d.limit(0), "a", "x", "y", draws=3).count() == 0
    rng = np.random.default_rng(0)
    k = spark.createDataFrame([(int(rng.poisson(3 if i % 10 < 5 else 9)), 2010 + i % 10, 4) for i in range(500)], "k int, year int, e int")
    t = models.spline_test(k, "k", "year", "e")
    flat = models.spline_test(k.withColumn("k", F.lit(3)), "k", "year", "e")
    assert t["degrees"] == 5 and t["p"] < 1e-6 and flat["drop"] == pytest.approx(0, abs=1e-6) and flat["p"] == pytest.approx(1)
    n = [r["k"] for r in k.select("k").collect()]
    mean = np.mean(n)
    assert t["deviance_null"] == pytest.approx(2 * sum((v * math.log(v / mean) if v else 0) - (v - mean) for v in n))
