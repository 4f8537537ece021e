"""Operators on small hand-made tables, and estimators against independent computations."""

import datetime
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import encode as E
from stanzaflow.functions import segment as S
from stanzaflow.functions import text as T
from stanzaflow.operators import cohort, colloc, counts, models, qa, ranks, temporal, vectors
from stanzaflow.plans.stages import Registry, Stage
from stanzaflow.sources import io
from stanzaflow.streaming import incremental


def one(spark, expr, schema, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expr).collect()]


def test_cells_and_periods(spark):
    rows = [("1st", "Singular"), ("2nd", "Plural"), ("3rd", "None"), (None, "Plural"), ("Impersonal", "Singular")]
    assert one(spark, E.six_way(F.col("p"), F.col("n")), "p string, n string", *rows) == ["1sg", "2pl", "", "", ""]
    assert one(spark, E.six_way(F.col("p"), F.col("n"), None), "p string, n string", *rows)[2:] == [None, None, None]
    reg = [("2pl", "polite_singular", None), ("2pl", "polite_singular", False), ("2pl", "ambiguous", True), ("1sg", "polite_singular", True)]
    assert one(spark, E.register_cell(F.col("c"), F.col("r"), F.col("a")), "c string, r string, a boolean", *reg) == [E.POLITE, E.TRUE_PLURAL, E.TRUE_PLURAL, "1sg"]
    years = [(2013,), (2014,), (2021,), (2022,), (None,)]
    assert one(spark, E.period_p1_p2(F.col("y")), "y int", *years) == [E.UNKNOWN, E.P1, E.P1, E.P2, E.UNKNOWN]
    days = [("2022-02-23",), ("2022-02-24",), ("2013-12-31",), (None,)]
    assert one(spark, E.period_by_date(F.col("d")), "d string", *days) == [E.P1, E.P2, E.UNKNOWN, E.UNKNOWN]
    assert one(spark, E.sane_year(F.col("y")), "y string", ("2014.0",), ("999",), ("20145",), (" 2020-01-01",), (None,)) == [2014, None, None, 2020, None]


def test_flags_and_languages(spark):
    assert one(spark, E.truthy(F.col("v")), "v string", ("yes",), (" TRUE",), ("0",), (None,), ("False",)) == [True, True, False, False, False]
    langs = [(None,), ("nan",), ("Ukrainian, Russian",), ("Qirimli",), ("Polish",), ("Klingon",), (" Russian ",)]
    got = one(spark, E.language_reason(F.col("l")), "l string", *langs)
    assert got == ["empty_language", "empty_language", "mixed_language_comma", "crimean_tatar_or_qirimli_family", "excluded_small_language_exact", "outside_pool_Ukrainian_Russian:Klingon", ""]


def test_text_functions(spark):
    assert one(spark, T.token_count(F.col("t")), "t string", ("a b c\n d ",), ("",), (None,)) == [4, 0, 0]
    assert one(spark, T.poem_count(F.col("t")), "t string", ("3 poems",), ("1 poem",), (None,), ("0 poems",), ("abc",)) == [3, 1, 1, 1, 1]
    assert one(spark, T.word_list(F.col("t"), ["ми"]), "t string", ("Ми й ґава об’єкт",)) == [["ґава", "об’єкт"]]
    assert one(spark, T.record_id(F.col("t")), "t string", ("12.0",), (" 12 ",), (None,)) == ["12", "12", ""]
    assert one(spark, T.int_list(F.col("t")), "t string", ("0|5|9",), ("0,5",), ("x",), ("",)) == [[0, 5, 9], [0, 5], [], []]
    assert one(spark, T.parsed_date(F.col("t")), "t string", ("2022-03-08",), ("8.3.2022",), ("2018",), ("31.02.2020",)) == [datetime.date(2022, 3, 8)] * 2 + [None, None]
    assert one(spark, T.middle_cut(F.col("t"), 9), "t string", ("abcdefghijkl",), ("abc",)) == ["abc … jkl", "abc"]
    assert one(spark, T.second_plural_form(F.col("t")), "t string", ("ви (IMPLIED)",), ("вашого",), ("мій",)) == [True, True, False]
    assert one(spark, T.tags(F.col("t")), "t string", ("* * *",), ("---",), ("II.",), ("2. text",), ("1.2.2022",), ("word",)) == ["asterisk", "rule", "number", "number_text", "date", None]


def test_segmentation():
    assert S.sub_poems("one\n***\ntwo", 2) == (["one", "two"], "asterisk_line", True, False)
    assert S.sub_poems("a\n\nb\n\nlonger\n\ntext here", 3) == (["a\n\nb", "longer", "text here"], "double_blank", True, True)
    assert S.sub_poems("a\n\nb\n\nc", 2) == (["a\n\nb\n\nc"], "asterisk_line", False, False)  # as near, and the earlier way
    assert S.sub_poems("I.\nx\nII.\ny", 2)[:2] == (["I.\nx", "II.\ny"], "number_line_only")
    assert S.sub_poems("", 1) == ([""], "empty", True, False) and S.sub_poems(None, 2)[2] is False
    assert S.sub_poems("a\r\nb", 1) == (["a\nb"], "single", True, False)
    assert S.spaced_separators("a\n***\nb\n***\nc\n***\nd", 3) is not None and S.spaced_separators("a", 2) is None
    assert S.at_line_starts("a\nb\nc", [1]) == ["a", "b\nc"]
    assert S.peeled("verse\n\nJane  Doe\n1.2.2022\n", "jane doe") == ("verse", "1.2.2022", "Jane  Doe")
    long = "x\ny\nz"
    assert S.stanzas(f"{long}\n\n* * *\n\n{long}")[0] == [long, long]
    assert S.stanzas("a\n\n***\n\nb")[0] == ["a\n***", "b"] and S.stanzas("***\n\nb")[0] == ["***\nb"]
    assert S.stanzas(None) == ([], "", "") and S.chunks("\n".join("ab"), 1) == ["a", "b"]
    assert S.checked_starts([0, 4], 2) == ([0, 4], 2) and S.checked_starts([3, 7], 2) == ([0, 3, 7], 3) and S.checked_starts([5, 2], 2) is None


def test_latest_and_first(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {tuple(r) for r in cohort.latest(d, ["k"], "t", ["v"]).collect()} == {("a", 2, "y"), ("b", 1, None)}
    assert {tuple(r) for r in cohort.first_by(d, ["k"], [F.col("t")]).collect()} == {("a", 1, "x"), ("b", 1, None)}
    m = cohort.merge_by_priority([d.filter("t = 1"), spark.createDataFrame([("b", 9, "z")], d.schema)], ["k"])
    assert {tuple(r) for r in m.collect()} == {("a", 1, "x"), ("b", 9, "z")}
    assert cohort.latest(d.limit(0), ["k"], "t", ["v"]).count() == 0


def test_counts(spark):
    tok = spark.createDataFrame([("p", "1sg")] * 3 + [("p", "1pl"), ("q", "3sg")], "poem_id string, cell string")
    t = {r["poem_id"]: r for r in counts.cell_table(tok, cells=("1sg", "1pl")).collect()}
    assert (t["p"]["1sg"], t["p"]["n_total"], t["q"]["n_total"]) == (3, 4, 0)
    st = spark.createDataFrame([("p", 1, "a b"), ("p", 3, "c"), ("p", 3, "c")], "poem_id string, stanza_index int, text string")
    r = counts.stanza_exposure(st).first()
    assert (r["exposure_n_stanzas"], r["exposure_n_tokens"], r["has_index_gap"]) == (2, 3, True)
    trials = counts.trials(spark.createDataFrame([(2, 5)], "k int, n int"), []).groupBy("y").count().collect()
    assert dict(map(tuple, trials)) == {1: 2, 0: 3}
    q = counts.quantiles(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 11)], "v double"), [], "v").first()
    assert (q["p25"], q["p50"], q["p75"]) == (2, 3, 10)
    mode = counts.mode_with_order(spark.createDataFrame([("k", "a"), ("k", "b")], "k string, v string"), ["k"], "v", ["b"]).first()
    assert mode["mode"] == "b"


def test_bh_and_holm(spark):
    d = spark.createDataFrame([("f", 0.01, 1), ("f", 0.04, 2), ("f", 0.03, 3), ("f", None, 4)], "f string, p double, i int")
    q = [r["q"] for r in ranks.bh(d, ["f"]).orderBy("i").collect()]
    assert [None if x is None else round(x, 10) for x in q] == [0.03, 0.04, 0.04, None]
    h = [r["p_holm"] for r in ranks.holm(d, ["f"]).orderBy("i").collect()]
    assert [None if x is None else round(x, 10) for x in h] == [0.03, 0.06, 0.06, None]


def test_mann_whitney_by_hand(spark):
    a, b = [1, 2, 2, 5], [2, 3, 4]
    d = spark.createDataFrame([("g", "x", float(v)) for v in a] + [("g", "y", float(v)) for v in b], "g string, s string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert ranks.mann_whitney(d, ["g"], "v", "s", "x", "y").first()["u"] == u
    p = spark.range(1).select(ranks.two_sided_p(F.lit(1.96))).first()[0]
    assert abs(p - math.erfc(1.96 / math.sqrt(2))) < 1e-6


@pytest.mark.parametrize("counts_in", [[(1, 5), (2, 40), (3, 7)], [(1, 3)], [(1, 30), (2, 30), (3, 4)], [(1, 1), (2, 1), (3, 1), (4, 90)]])
def test_merge_small(counts_in):
    to = temporal.merge_small(counts_in, 30)
    assert list(to) == [b for b, _ in counts_in] and list(to.values()) == sorted(to.values())
    sizes = {}
    for b, n in counts_in:
        sizes[to[b]] = sizes.get(to[b], 0) + n
    assert len(sizes) == 1 or min(sizes.values()) >= 30


def test_balanced_bins_partition(spark):
    d = spark.createDataFrame([(i, datetime.date(2020, 1, 1 + i // 3)) for i in range(10)], "k int, d date")
    b = temporal.balanced_bins(temporal.poem_days(d, "k", "d"), "k", 4).orderBy("day", "k").collect()
    assert [len(list(g)) for _, g in itertools.groupby(r["bin"] for r in b)] == [4, 3, 3]


def test_spline_basis_sums_to_one(spark):
    basis = temporal.bspline_basis(F.col("id") / 10.0, [0.0, 0.4, 1.0])
    for r in spark.range(11).select(sum(basis)).collect():
        assert abs(r[0] - 1) < 1e-9


def test_collocation_bounds(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(str(a), str(b)) for a, b in rng.integers(0, 4, (200, 2))], "cell string, head string").withColumn("s", F.lit(1))
    for r in colloc.measures(d, ["s"], "cell", "head").collect():
        assert r["log_dice"] <= 14 and r["g2"] >= -1e-9
    w = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "a"]), (3, ["c"])], "u int, w array<string>")
    assert {tuple(r) for r in colloc.cooccurrence(w, ["u"], "w", 2).collect()} == {("a", "b", 2)}
    assert one(spark, colloc.ngrams(F.col("w"), 2), "w array<string>", (["a", "b", "c"],), (["a"],)) == [["a b", "b c"], []]


def test_parsed_words(spark):
    words = "array<struct<id: int, text: string, lemma: string, upos: string, feats: string, head: int, deprel: string>>"
    d = spark.createDataFrame([("p", [(1, "Я", "я", "PRON", "Case=Nom", 2, "nsubj"), (2, "йду", "йти", "VERB", "Mood=Imp|VerbForm=Fin", 0, "root")])], f"poem_id string, words {words}")
    c = colloc.contexts(d, "words", ["poem_id"], {"я": "1sg"}).first()
    assert (c["cell"], c["deprel"], c["head_lemma"]) == ("1sg", "nsubj", "йти")
    f = colloc.finite_counts(d, "words", ["poem_id"]).first()
    assert (f["n_finite_verbs"], f["n_finite_verbs_excl_imperative"]) == (1, 0)


def test_rate_ratio_and_glm_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{i % 7}", "x" if i % 2 else "y", int(rng.poisson(3 if i % 2 else 5)), int(rng.integers(2, 9)), i % 2) for i in range(80)]
    d = spark.createDataFrame(rows, "a string, per string, k int, e int, x int").withColumn("g", F.lit("g"))
    closed = models.rate_ratio(d, ["g"], "k", "e", "per", "y", "x", "a").first()
    g = models.Glm(d, "k", ["x"], offset="e", cluster="a")
    t = g.table().set_index("term")
    assert abs(t.loc["x", "coef"] - closed["coef"]) < 1e-6 and abs(t.loc["x", "se"] - closed["se"]) < 1e-6
    assert abs(math.log((13 / 31) / (8 / 30)) - 0.452718) < 1e-6
    assert g.contrast({"nothing": 1.0})["estimate"] is None and g.converged


def test_binomial_glm_is_the_log_odds_ratio(spark):
    d = spark.createDataFrame([(0, 8, 30), (1, 13, 31)], "x int, k int, n int")
    b = models.Glm(d, "k", ["x"], "binomial", trials="n").table().set_index("term").loc["x", "coef"]
    assert abs(b - math.log((13 / 18) / (8 / 22))) < 1e-6


def test_conditional_likelihood_by_enumeration():
    x, k, n, b = np.array([[0.0], [1.0]]), np.array([1, 2]), np.array([2, 3]), np.array([0.3])
    g, h = models.clogit_terms(x, k, n, b)
    units = [0.0] * 2 + [1.0] * 3
    sums = [sum(c) for c in itertools.combinations(units, 3)]
    w = np.exp(0.3 * np.array(sums))
    mean = (w * sums).sum() / w.sum()
    var = (w * np.square(sums)).sum() / w.sum() - mean**2
    assert abs(g[0] - (2 - mean)) < 1e-9 and abs(h[0, 0] - var) < 1e-9


def test_small_estimators():
    x = np.column_stack((np.ones(20), np.arange(20.0)))
    b, v, r2 = models.wls_hc3(x, 2 + 3 * np.arange(20.0), np.ones(20))
    assert np.allclose(b, [2, 3]) and r2 > 0.999999 and np.all(np.diag(v) < 1e-9)
    assert models.change_points(np.array([0.0] * 8 + [5.0] * 8), 1.0) == [8]
    assert models.change_points(np.array([1.0])) == []
    at = np.linspace(0, 1, 9)
    assert np.allclose(models.loess(at, 2 * at + 1, at, 0.5), 2 * at + 1)


def test_procrustes_is_orthogonal(spark):
    rng = np.random.default_rng(0)
    r0, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    a = rng.normal(size=(40, 5))
    d = spark.createDataFrame([(i, v.tolist(), (v @ r0).tolist()) for i, v in enumerate(a)], "i int, a array<double>, b array<double>")
    r = vectors.procrustes(d, "a", "b")
    assert np.allclose(r @ r.T, np.eye(5)) and np.allclose(r, r0)
    same = d.select(vectors.cosine(vectors.rotated(F.col("a"), r), F.col("b"))).collect()
    assert all(abs(x[0] - 1) < 1e-9 for x in same)


def test_agreement(spark):
    full = spark.createDataFrame([(u, str(u % 2)) for u in range(6) for _ in range(3)], "u int, l string")
    assert qa.krippendorff(full, ["u"], "l").first()["alpha"] == 1.0
    s = {r["label"]: r for r in qa.class_scores(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, g string"), "t", "g").collect()}
    assert (s["a"]["precision"], s["a"]["recall"], s["b"]["precision"], s["b"]["support"]) == (1.0, 0.5, 0.5, 1)
    d = spark.createDataFrame([("x", 1, 2), ("x", 3, 3)], "k string, p_manual int, p_gpt int")
    assert [r["differs_p"] for r in qa.disagreements(d, ["p"]).collect()] == [True]


def test_bootstraps_repeat_themselves(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(f"a{i % 5}", "x" if i % 3 else "y", int(rng.poisson(4)), 5) for i in range(60)], "a string, per string, k int, e int").withColumn("g", F.lit("g"))
    w = lambda: models.wild_bootstrap(d, ["g"], "k", "e", "per", "y", "x", "a", draws=199).first()
    assert w() == w() and 0 < w()["p_wild"] <= 1
    b = models.poem_bootstrap(d, "a", "k", "e", "per", "y", "x", draws=99).collect()
    assert len(b) == 5 and all(r["low"] <= r["delta"] <= r["high"] for r in b)


def test_sources(spark, tmp_path):
    d = spark.createDataFrame([("1", "a, \"b\"\nc", None), ("2", "x", "y")], "id string, t string, n string")
    io.write_csv(d, str(tmp_path / "c"), blank=["n"])
    back = io.read_csv(spark, str(tmp_path / "c"), columns=["id", "t"])
    assert {tuple(r) for r in back.collect()} == {("1", "a, \"b\"\nc"), ("2", "x")}
    (tmp_path / "j.json").write_text(json.dumps([{"parent_id": "1", "verdict": "annotation_wrong", "true_poem_count": 2}, {"parent_id": "2", "verdict": "ambiguous", "true_poem_count": 1}, {"parent_id": "3", "error": "x"}]))
    assert [r["parent_id"] for r in io.read_adjudications(spark, str(tmp_path / "j.json")).collect()] == ["1"]
    assert io.read_adjudications(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(FileNotFoundError, match="make it"):
        io.read_required(lambda: None, spark, str(tmp_path / "none"), "make it")
    d.write.parquet(str(tmp_path / "t"))
    io.rewrite(spark, str(tmp_path / "t"), lambda x: x.filter("id = '2'"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and spark.read.parquet(str(tmp_path / "t.bak")).count() == 2
    got = io.completions(d.select("id", "t"), "t", lambda: lambda ts: [t.upper() for t in ts], 2).collect()
    assert {r["completion"] for r in got} == {"A, \"B\"\nC", "X"}
    b = io.bibtex(spark.createDataFrame([("Smith, J. (2020). Long title here. Press.",), ("Smith, J. (2020). Long title here. https://x.org",)], "l string"), F.col("l")).collect()
    assert len(b) == 1 and b[0]["url"] == "https://x.org"


def test_incremental(spark, tmp_path):
    work = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, t string")
    done = str(tmp_path / "done")
    assert incremental.resume(spark, work, "id", done).count() == 2
    incremental.mark_done(work.filter("id = '1'"), "id", done)
    assert [r["id"] for r in incremental.resume(spark, work, "id", done).collect()] == ["2"]
    calls = []

    def compute(df):
        calls.append(df.count())
        return df.select("cache_key", F.upper("t").alias("u"))

    path = str(tmp_path / "cache")
    incremental.through_cache(work, "t", path, compute)
    more = work.union(spark.createDataFrame([("3", "c"), ("4", None)], work.schema))
    got = incremental.through_cache(more, "t", path, compute)
    assert {(r["id"], r["u"]) for r in got.collect()} == {("1", "A"), ("2", "B"), ("3", "C"), ("4", None)} and calls == [2, 1]


def test_stream_is_the_batch(spark, tmp_path):
    d = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, 5), "c", 1.0) for h in (1, 1, 2)], "ts timestamp, kind string, value double")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_counts(stream, "ts", ["kind"], "value").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.windowed_counts(d, "ts", ["kind"], "value")
    assert {tuple(r) for r in spark.table("counted").collect()} == {tuple(r) for r in batch.collect()}


def test_stage_order():
    r = Registry()
    for n, needs in (("a", ()), ("b", ("c",)), ("c", ("a",)), ("d", ())):
        r.add(Stage(n, lambda s, x: None, needs))
    assert r.order(["b"]) == ["a", "c", "b"] and r.between("b", "d") == ["b", "c", "d"]
    r.add(Stage("e", lambda s, x: None, ("f",)))
    r.add(Stage("f", lambda s, x: None, ("e",)))
    with pytest.raises(ValueError, match="need each other"):
        r.order(["e"])


def test_terms_and_topics(spark):
    assert models.canonical_term("C(period)[T.post]") == "period=post" and models.canonical_term("(Intercept)") == "intercept"
    assert models.canonical_term("number:C(period, Treatment('pre'))[T.post]") == models.canonical_term("C(period)[T.post]:number")
    d = spark.createDataFrame([(i, ["сніг", "дим", "ліс"] if i % 2 else ["road", "sea", "boat"]) for i in range(20)], "k int, w array<string>")
    best, labels = colloc.topics(d, "k", "w", k=2)
    got = dict(best.select("k", "topic").collect())
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and got[0] != got[1] and labels.count() == 2
