"""Problem 2: estimates, and groups against brute force."""

import itertools
import random
from collections import Counter

import numpy as np

from stanzaflow.llm import neardup as N


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values())


def edited(rng, words, share):
    w = list(words)
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    rng.shuffle(w)
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    vocab = [f"слово{i}" for i in range(400)]
    out = []
    for g in range(40):
        base = rng.choices(vocab, k=90)
        out.append((f"g{g}_0", " ".join(base)))
        for k in range(rng.randrange(3)):
            out.append((f"g{g}_{k + 1}", edited(rng, base, rng.choice([0.0, 0.05, 0.1, 0.4]))))
    return out


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.65, 0.8, 0.95):
        u = rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype(np.uint32)
        n = 2000
        both = int(n * j)
        a, b = u[:n], np.concatenate((u[:both], u[n : n + n - both]))
        true = both / (2 * n - both)
        s = N.odd_sketch(N.minhash([a, b]))
        ones = bin(int.from_bytes((s[0] ^ s[1]).tobytes(), "little")).count("1")
        assert abs(N.similarity_from_xor(ones) - true) < 0.1
        assert abs(N.similarity_from_xor(N.max_xor(true)) - true) < 0.02


def test_pairs_as_by_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame(rows + rows[:3], "ID string, text string")
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x, y) >= 0.65}
    got = {tuple(r) for r in N.found(d).collect()}
    assert got == want and len(want) > 10
    g = {r["doc_key"]: r for r in N.groups(d).collect()}
    assert len(g) == len(rows)
    for a, b in want:
        assert g[a]["group_id"] == g[b]["group_id"]


def test_form_and_edge_cases(spark):
    t = "Тиха ніч над рікою, і сніг тане за вікном"
    rows = [("a", t), ("b", t.upper().replace("а", "a").replace(",", " —")), ("c", None), ("d", ""), ("e", "!!!"), ("f", "слово"), ("g", "слово"), (None, t)]
    d = spark.createDataFrame(rows, "ID string, text string")
    assert {tuple(r) for r in N.found(d).collect()} == {("a", "b"), ("f", "g")}
    assert N.found(d.limit(0)).count() == 0 and N.groups(d.limit(0)).count() == 0


def test_chains_become_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 41)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 31), 40, 41, 50]], "cls bigint")
    comp = dict(map(tuple, N.components(links, nodes).collect()))
    assert {comp[i] for i in range(1, 31)} == {1} and comp[41] == 40 and comp[50] == 50


def test_a_hot_band_is_split(spark):
    """A band that a third of the classes share is read in parts by the join."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        bands = spark.range(0, 4000, 1, 8).selectExpr("xxhash64(id) as cls", "if(id % 3 = 0, 7L, xxhash64(id, 1)) as band")
        hot = spark.range(400).selectExpr("xxhash64(id * 3) as cls", "7L as band")
        pairs = N.band_pairs(bands.filter("band <> 7").unionByName(hot))
        assert pairs.count() == 400 * 399 // 2
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan or "skewed" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_many_copies_and_a_repeated_key(spark):
    t = "Тиха ніч над рікою, і сніг тане за вікном"
    rows = [(f"c{i}", t) for i in range(40)] + [("c0", t)] * 20 + [("k", t), ("k", "інший текст зовсім без збігів"), ("m", "Інший текст зовсім без збігів!")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "ID string, text string, cls int")
    got = {tuple(r) for r in N.found(d).collect()}
    same = sorted({k for k, x in rows if x == t})
    assert got == {(a, b) for a, b in itertools.combinations(same, 2)} | {("k", "m")}
