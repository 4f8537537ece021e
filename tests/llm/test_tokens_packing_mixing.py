"""Problems 6 and 7: counts against the library, the rules of packing, shares and inclusion of mixing."""

import os
from collections import Counter

import pytest

from stanzaflow.llm import mixing as M
from stanzaflow.llm import packing as P
from stanzaflow.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZERS), reason="vocabulary files are not here")
WORDS = "тиша ніч сніг road letter window piła 今天 पानी".split()


def docs(spark, sizes, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, " ".join(WORDS[(i + k) % len(WORDS)] for k in range(n)), source(i)) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string")


def test_counts_as_the_library():
    c = T.TokenCounter(T.load(os.path.join(T.TOKENIZERS, T.VOCABULARY)))
    for t in (" ".join(WORDS), "  a\n\n b", "x" * 50, "", "it's 2020!"):
        assert c.count(t) == len(c.enc.encode_ordinary(t))


@pytest.mark.parametrize(("most", "waste"), [(25, 0.01), (50, 0.01), (90, 0.07)])  # 0 to 90 of 100 leaves few partners for large ones
def test_packer_rules(most, waste):
    items = [(i, f"s{i % 3}", 1 + (i * 37) % most) for i in range(600)] + [(1000, "s0", 257)]
    share = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    out = list(P.Packer(100, share, {}).pack(items))
    per, by_doc = Counter(), Counter()
    for k, s, piece, first, n, w, at in out:
        per[w] += n
        by_doc[k] += n
    assert by_doc == {k: n for k, _, n in items} and max(per.values()) <= 100
    assert sum(100 - v for v in per.values()) < waste * 100 * len(per) + 100
    assert Counter(k for k, *_ in out)[1000] == 3 and all(v == 1 for k, v in Counter(k for k, *_ in out).items() if k != 1000)


def test_windows_keep_the_mixture():
    items = [(i, "a" if i % 4 else "b", 10) for i in range(4000)]
    out = list(P.Packer(200, {"a": 0.75, "b": 0.25}, {}).pack(items))
    got = Counter()
    for _, s, _, _, n, w, _ in out:
        got[w, s] += n
    assert all(130 <= got[w, "a"] <= 170 for w in range(150))


def test_carried_deficits_at_the_usual_partition_size():
    """Partitions of 128 windows one after the other, each opened with what those before it owe: nine windows of ten stay near the targets."""
    items = [(i, "a" if i % 3 else "b" if i % 2 else None, 2 * (3 + (i * 7) % 30)) for i in range(20_000)]
    every = sum(n for _, _, n in items)
    share = {s: sum(n for _, t, n in items if t == s) / every for s in ("a", "b", None)}
    parts = -(-every // 128_000)
    before, off = Counter(), []
    for q in range(parts):
        mine = [x for x in items if x[0] * 2654435761 % 2**32 * parts >> 32 == q]
        given = sum(before.values())
        per, size = Counter(), Counter()
        for _, s, _, _, n, w, _ in P.Packer(1000, share, {s: x * given - before[s] for s, x in share.items()}).pack(mine):
            per[w, s] += n
            size[w] += n
        for _, s, n in mine:
            before[s] += n
        off += [max(abs(per[w, s] / size[w] - share[s]) for s in share) for w in size if w != max(size)]
    assert parts > 4 and sorted(off)[int(0.9 * len(off))] < 0.15


def test_pack(spark):
    d = docs(spark, [3, 40, 0, 7, 200, 5, 5, 5]).unionByName(spark.createDataFrame([(90, None, "s1"), (91, "тиша", None), (91, "тиша", None), (None, "ніч", "s1")], "doc_id bigint, text string, source string"))
    p = P.pack(d, 64, windows=2).collect()
    per = Counter()
    for r in p:
        per[r["container"]] += r["tokens"] if r["container"] else 0
    assert max(per.values()) <= 64 and {r["doc_id"] for r in p} == {0, 1, 2, 3, 4, 5, 6, 7, 90, 91}
    cut = [r for r in p if r["pieces"] > 1]
    assert {r["doc_id"] for r in cut} >= {4} and sum(r["tokens"] for r in p if r["doc_id"] == 4) > 64
    assert [r["container"] for r in p if r["doc_id"] == 90] == [None]
    assert P.pack(d.limit(0), 64).count() == 0


def test_many_partitions_keep_mixture_and_space(spark, monkeypatch):
    """Deficits are carried over partitions, the last containers are packed together, and prefix sums go by blocks."""
    monkeypatch.setattr(P, "BLOCK", 3)
    d = docs(spark, [3 + (i * 7) % 30 for i in range(3000)], lambda i: "a" if i % 3 else "b" if i % 2 else None)
    p = P.pack(d, 1000, windows=8)
    parts = {r["container"].split("-")[0] for r in p.select("container").distinct().collect()}
    assert len(parts) > 8 and p.count() == 3000
    m = P.mixture(p, 1000).collect()
    assert max(r["tokens"] for r in m) <= 1000
    assert sum(r["unused"] for r in m) <= 0.003 * 1000 * len(m) + 1000
    # carried deficits load a small partition's first windows, and its last ones lack what these took
    assert sorted(r["deviation"] for r in m)[len(m) // 2] < 0.2
    running = P._running(spark.createDataFrame([(i, s, i + 1) for i in range(10) for s in (None, "x")], "part int, source string, n bigint"), ["n"], ["source"])
    assert all(r["before_n"] == r["part"] * (r["part"] + 1) // 2 for r in running.collect())


def test_plan():
    assert M.plan_source(100, 40, 3) == (2, 20) and M.plan_source(100, 30, 3) == (3, 0.0)
    assert M.plan_source(90, 30, 3) == (3, 0) and M.plan_source(5, 0, 3) == (0, 0.0)


def test_mix(spark):
    d = docs(spark, [5 + i % 40 for i in range(600)], lambda i: "Big " if i % 3 else " small")
    t = spark.createDataFrame([("big", 0.4, 2), ("small", 0.5, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = M.Mix(d, t)
    r = {x["source"]: x for x in m.report().collect()}
    largest = 200
    for s in ("big", "small"):
        assert abs(r[s]["tokens"] - r[s]["target_share"] * m.size) <= largest and r[s]["reachable"]
    assert not r["none"]["reachable"] and r["none"]["tokens"] == 0
    c = m.copies().collect()
    assert max(x["copies"] for x in c) <= 3 and {x["source"] for x in c} == {"big", "small"}
    assert sum(x["copies"] * x["tokens"] for x in c) == sum(x["tokens"] for x in r.values())
    assert {x["doc_id"] for x in M.Mix(d, t).sample.withColumnRenamed("doc_key", "doc_id").collect()} == {x["doc_id"] for x in m.sample.withColumnRenamed("doc_key", "doc_id").collect()}
    assert {x["source"] for x in M.found(d, t).collect()} == {"none"}
    assert {x["source"] for x in M.found(d.limit(0), t).collect()} >= {"big", "small"}


def test_longer_documents_are_likelier(spark):
    d = docs(spark, [10] * 300 + [160] * 300, lambda i: "s")
    t = spark.createDataFrame([("s", 0.3, 1)], "source string, target_share double, max_repeats int")
    sizes = Counter(x["tokens"] > 200 for x in M.Mix(d, t).sample.collect())
    assert sizes[True] > 2 * sizes[False] > 0
