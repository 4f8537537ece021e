"""The model queries do all that they claim."""

import math

import numpy as np
import pytest

from stanzaflow.operators import models
from stanzaflow.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_mixed_model_has_both_models(spark):
    got = {(r["model"], r["term"]): r["value"] for r in catalogue.QUERIES["mixed_model"](spark, SF).collect()}
    assert {t for m, t in got if m == "binomial"} == {"intercept", "slope", "sd"} and all(map(math.isfinite, got.values()))


def test_binomial_intercepts_recovers(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(0, 0.5, 60)
    rows = [(f"a{i}", x, int(rng.binomial(200, 1 / (1 + math.exp(-(0.3 - 0.8 * x + u[i]))))), 200) for i in range(60) for x in (0, 1)]
    r = models.binomial_intercepts(spark.createDataFrame(rows, "author string, post int, k int, n int"), "author", "k", "n", "post")
    assert abs(r["slope"] + 0.8) < 0.1 and abs(r["intercept"] - 0.3) < 0.25 and r["sd"] == 0.5


def test_negative_binomial_uses_the_whole_grid(spark, monkeypatch):
    class Seen(Exception):
        pass

    def spy(*args, **options):
        assert "grid" not in options
        raise Seen

    monkeypatch.setattr(models, "negative_binomial", spy)
    with pytest.raises(Seen):
        catalogue.QUERIES["negative_binomial_glm"](spark, SF)


def test_change_points_as_in_the_reference(spark, monkeypatch):
    seen = []
    real = models.change_points
    monkeypatch.setattr(models, "change_points", lambda y, *options: seen.append(options) or real(y, *options))
    catalogue.QUERIES["change_points"](spark, SF).collect()
    assert seen == [()] and real.__defaults__ == (4.0, 2)


def test_conditional_likelihood_of_many_trials():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    for size in (2_000, 100_000_000):  # without effects the successes are hypergeometric
        n = np.array([size, size // 2, size // 3, size * 2])
        k = n * 2 // 5
        t, whole = int(k.sum()), int(n.sum())
        g, h = models.clogit_terms(x, k, n, np.zeros(2))
        share = n / whole
        v = t * (whole - t) / (whole - 1) * (np.diag(share) - np.outer(share, share))
        assert np.allclose(g, x.T @ (k - t * share), atol=1e-7) and np.allclose(h, x.T @ v @ x, rtol=1e-9)


def test_conditional_likelihood_where_nearly_all_succeed():
    for b, k, n in ((-2.5, (400, 299), (400, 300)), (9.0, (1, 999), (600, 1000)), (25.0, (0, 5), (5, 5))):
        t = sum(k)
        j = np.arange(max(0, t - n[0]), min(n[1], t) + 1)
        choose = lambda m, i: math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1)
        w = np.array([choose(n[1], i) + choose(n[0], t - i) + b * i for i in j])
        w = np.exp(w - w.max())
        less = j - k[1]
        mean = (w * less).sum() / w.sum()
        g, h = models.clogit_terms(np.array([[0.0], [1.0]]), np.array(k), np.array(n), np.array([b]))
        assert abs(g[0] + mean) < 1e-9 and np.isclose(h[0, 0], (w * (less - mean) ** 2).sum() / w.sum(), rtol=1e-9)


def test_conditional_logit_of_authors_with_many_trials(spark):
    rows = [("a", 0, 1200, 3000), ("a", 1, 2900, 5000), ("b", 0, 30, 40), ("b", 1, 20, 50), ("c", 0, 90_000, 200_000), ("c", 1, 500_000, 900_000)]
    r = models.conditional_logit(spark.createDataFrame(rows, "author string, post int, k int, n int"), "author", "k", "n", ["post"]).iloc[0]
    x = np.array([[0.0], [1.0]])
    terms = [models.clogit_terms(x, np.array(k), np.array(n), np.array([r["coef"]])) for k, n in (((1200, 2900), (3000, 5000)), ((30, 20), (40, 50)), ((90_000, 500_000), (200_000, 900_000)))]
    assert abs(sum(g[0] for g, _ in terms)) < 1e-5 and abs(r["se"] - sum(h[0, 0] for _, h in terms) ** -0.5) < 1e-9
    # with large strata the conditional estimate comes near the pooled odds ratio of Mantel and Haenszel
    strata = [(k2 * (n1 - k1) / (n1 + n2), k1 * (n2 - k2) / (n1 + n2)) for (_, _, k1, n1), (_, _, k2, n2) in zip(rows[::2], rows[1::2])]
    assert abs(r["coef"] - math.log(sum(a for a, _ in strata) / sum(b for _, b in strata))) < 0.01


def test_conditional_logit_on_a_table_with_a_hot_author(spark):
    got = catalogue.QUERIES["conditional_logit"](spark, "/root/testdata/sf0.1").collect()
    assert [r["term"] for r in got] == ["post"] and all(math.isfinite(v) for r in got for v in (r["coef"], r["se"])) and got[0]["se"] > 0
