"""The pair queries against brute force on the smallest tables."""

import math
from collections import Counter
from itertools import combinations

import pytest

from stanzaflow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute(spark):
    freq, pairs = Counter(), Counter()
    for r in catalogue._words(spark, SF).collect():
        ws = sorted(set(r["ws"]))
        freq.update(ws)
        pairs.update(combinations(ws, 2))
    return {(a, b): (n, round(14 + math.log2(2 * n / (freq[a] + freq[b])), 5)) for (a, b), n in pairs.items()}


def test_all_pairs(spark, brute):
    got = {(r["a"], r["b"]): (r["n"], round(r["log_dice"], 5)) for r in catalogue.QUERIES["cooccurrence_pairs"](spark, SF).collect()}
    assert got.keys() == brute.keys() and all(got[k][0] == brute[k][0] and abs(got[k][1] - brute[k][1]) < 2e-5 for k in got)
    assert min(n for n, _ in got.values()) == 1


def test_ego_network(spark, brute):
    edges = {k: v for k, v in brute.items() if v[0] >= 3}
    nodes = set()
    got = {(r["focal"], r["neighbour"]): r["n"] for r in catalogue.QUERIES["ego_topk"](spark, SF).collect()}
    want = {}
    for f in catalogue._FOCAL:
        near = sorted((-d, -n, a if b == f else b) for (a, b), (n, d) in edges.items() if f in (a, b))[:30]
        want |= {(f, x): -n for _, n, x in near}
        nodes |= {x for _, _, x in near} | ({f} if near else set())
    assert got == want
    inner = {(r["a"], r["b"]): r["n"] for r in catalogue.QUERIES["ego_second_order"](spark, SF).collect()}
    assert inner == {k: v[0] for k, v in edges.items() if set(k) <= nodes}
