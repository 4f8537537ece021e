"""Problem 2: near-duplicate texts with small edits, insertions or reordering.

Method: odd sketches. A text is the multiset of its words (in the form of problem 3, without case and punctuation), each
occurrence an element of its own, so that the Jaccard similarity of two sets is the sum of the smaller counts over the sum of
the larger ones. MinHash values of the set give bands for candidates, and are folded into a parity bitmap (odd sketch): the
population count of two bitmaps' XOR estimates the similarity of a candidate pair precisely where it is high. An exact count of the
surviving pairs follows.

Texts with equal multisets are one class and take part once; links are found between classes and lose none to caps.
With 64 bands of 6 values a pair of similarity 0.65 is a candidate with probability 0.993, of 0.73 with 0.99997; the sketch is asked for
``threshold`` - 0.22, nearly four standard errors (8.9 bits of the sketch and 6.5 of the MinHash values) below a pair at the threshold.

MinHash runs once a document; its sketch and band keys are stored, its elements are not: the texts of likely pairs are read again. Copies leave
before the bands are shuffled, so the exchange meets the join directly and AQE's skew join splits a hot band.

Defined cases: a NULL or wordless text is in no class; a repeated (key, text) row counts once; copies are one class of many keys; empty tables
give no rows; texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from ._rows import int_lists, map_rows
from .lookalike import Normaliser, for_text, normalised_rows

BANDS, ROWS = 64, 6
BITS = 512
STEP = 2000  # documents hashed at once
SIGNED = ["doc_key", "cls", "row", "sketch", "keys"]
_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_CJK = re.compile(r"[⺀-鿿]")
_MARK = re.compile("[̀́]")  # stress that was written out
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    """The words that count of a text in the one form: lower case, no punctuation; each Chinese character is a word."""
    t = _MARK.sub("", text).lower()
    found = _WORD.findall(t)
    if _CJK.search(t):
        found = [x for w in found for x in (w if _CJK.search(w) else (w,))]
    return found


class Hashes(dict):
    """Word -> 32-bit hash, kept for words met before."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


def bags(found: list[list[str]], memo: Hashes) -> list[np.ndarray]:
    """Sorted 32-bit elements of each multiset of words: word and number of its occurrence, hashed. No list may be empty."""
    if len(memo) > 200_000:
        memo.clear()
    size = np.fromiter(map(len, found), np.int64, len(found))
    doc = np.repeat(np.arange(len(found)), size).astype(np.uint64) << np.uint64(32)
    key = doc | np.fromiter(map(memo.__getitem__, chain.from_iterable(found)), np.uint64, int(size.sum()))
    key.sort()
    at = np.arange(len(key))
    times = at - np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
    low = np.uint64(0xFFFFFFFF)
    key = key & ~low | (key + times.astype(np.uint64) * np.uint64(0x9E3779B9)) & low
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return np.split((key & low).astype(np.uint32), np.flatnonzero(np.diff(key >> np.uint64(32))) + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return x ^ (x >> np.uint64(27))


def minhash(bags: list[np.ndarray]) -> np.ndarray:
    """(document x value) MinHash values of 32 bits; no bag may be empty."""
    x = _mix((np.concatenate(bags).astype(np.uint64) + np.uint64(1)) * _MIX)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    out = np.empty((len(bags), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS):
        out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], starts)
    return out >> np.uint64(32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """(document x band) keys; the band's number is part of the key."""
    v = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * _MIX + v[:, :, r])
    return key.view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """(document x BITS / 64) parity words of the MinHash values, each hashed together with its position."""
    at = _mix(values * _MIX + np.arange(values.shape[1], dtype=np.uint64)) % np.uint64(BITS)
    n = len(values)
    parity = np.bincount((np.arange(n)[:, None] * BITS + at.astype(np.int64)).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view(np.int64).reshape(n, BITS // 64)


def similarity_from_xor(ones: float) -> float:
    """Similarity estimated from the number of bits in which two odd sketches differ."""
    p = min(2.0 * ones / BITS, 1 - 1e-9)
    return 1 + BITS / 2 * np.log(1 - p) / (2 * BANDS * ROWS)


def max_xor(similarity: float) -> int:
    """The number of differing bits expected at a similarity."""
    return int(BITS / 2 * (1 - np.exp(-2 * 2 * BANDS * ROWS * (1 - similarity) / BITS)))


def _bags(memo: Hashes, keys: list, texts: list) -> tuple[list[str], list[np.ndarray], list[int]]:
    """Keys, bags and classes (a hash of the multiset) of the texts that have words."""
    some = [(k, found) for k, t in zip(keys, texts) if (found := words(t))]
    made = bags([f for _, f in some], memo) if some else []
    return [k for k, _ in some], made, [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in made]


def _signatures() -> Callable[[list, list, list], Iterable[tuple]]:
    memo = Hashes()

    def work(keys: list, _: list, texts: list) -> Iterable[tuple]:
        for i in range(0, len(keys), STEP):
            ids, made, cls = _bags(memo, keys[i : i + STEP], texts[i : i + STEP])
            if ids:
                values = minhash(made)
                yield pa.table([pa.array(ids), pa.array(cls), pa.array([random.getrandbits(62) for _ in ids]), int_lists(odd_sketch(values)), int_lists(band_keys(values))], names=SIGNED)
    return work


def _elements() -> Callable[[list, list, list], Iterable[tuple]]:
    memo = Hashes()

    def work(keys: list, _: list, texts: list) -> Iterable[tuple]:
        for i in range(0, len(keys), STEP):
            _, made, cls = _bags(memo, keys[i : i + STEP], texts[i : i + STEP])
            yield from ((c, x.tobytes()) for c, x in zip(cls, made))
    return work


class Links:
    """Classes of equal multisets, and the links between classes at or above a similarity."""

    def __init__(self, df: DataFrame, key: str = "ID", text: str = "text", threshold: float = 0.65, slack: float = 0.22) -> None:
        norm, counts = for_text(df, text)
        rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
        every = normalised_rows(rows, "k", "t", norm, counts, _signatures, ", ".join(f"{c} {t}" for c, t in zip(SIGNED, ("string", "bigint", "bigint", "array<bigint>", "array<bigint>"))))
        self.members = every.select("doc_key", "cls").distinct()
        # classes of several rows: written down, so that their size decides how they are joined
        copies = materialise(every.groupBy("cls").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("cls", "keep"))
        one = every.join(copies, "cls", "left").filter("keep is null or row = keep")
        candidates = band_pairs(one.select("cls", F.explode("keys").alias("band")))
        pairs = candidates.join(one.select(F.col("cls").alias("a"), F.col("sketch").alias("sa")), "a").join(one.select(F.col("cls").alias("b"), F.col("sketch").alias("sb")), "b")
        ones = sum(F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64))
        likely = materialise(pairs.filter(ones <= max_xor(threshold - slack)).select("a", "b"))
        asked = likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        again = materialise(one.join(asked, "cls", "left_semi").select(F.col("doc_key").alias("k")).distinct())
        bag = normalised_rows(rows.join(again, "k", "left_semi"), "k", "t", norm, counts, _elements, "cls bigint, elements binary")
        bag = bag.groupBy("cls").agg(F.first("elements").alias("elements"))
        full = likely.join(bag.select(F.col("cls").alias("a"), F.col("elements").alias("ea")), "a").join(bag.select(F.col("cls").alias("b"), F.col("elements").alias("eb")), "b")
        self.links = materialise(_exact(full).filter(F.col("similarity") >= threshold))


def band_pairs(bands: DataFrame) -> DataFrame:
    """(a, b), a < b: classes that share a band, from distinct (cls, band) rows. Nothing lies between exchange and join, so a hot band is split."""
    a, b = bands.select("band", F.col("cls").alias("a")), bands.select("band", F.col("cls").alias("b"))
    return a.join(b.hint("shuffle_merge"), "band").filter("a < b").select("a", "b").distinct()


def _exact(pairs: DataFrame) -> DataFrame:
    def make():
        def work(a: list, b: list, ea: list, eb: list) -> Iterable[tuple]:
            for x, y, p, q in zip(a, b, ea, eb):
                u, v = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = len(np.intersect1d(u, v, assume_unique=True))
                yield x, y, both / (len(u) + len(v) - both)
        return work

    return map_rows(pairs.select("a", "b", "ea", "eb"), make, "a bigint, b bigint, similarity double")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, component) for every node: its component's least class, by alternating large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        last, edges = edges, materialise(edges.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct())
        if before is not None:
            discard(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == before:
            break
        before = state
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found.select(F.col("u").alias("cls"), "component"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"))


def found(poems: DataFrame) -> DataFrame:
    """p2_found: pairs of different keys with at least 0.65 of their words in common, all pairs of a group."""
    g = Links(poems)
    m = g.members
    one, two = m.select(F.col("doc_key").alias("x"), F.col("cls").alias("a")), m.select(F.col("doc_key").alias("y"), F.col("cls").alias("b"))
    across = g.links.join(one, "a").join(two, "b").select("x", "y")
    within = one.join(two.withColumnRenamed("b", "a"), "a").select("x", "y").filter("x < y")
    pairs = across.unionByName(within).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("poem_id_a"), F.greatest("x", "y").alias("poem_id_b")).distinct()


def groups(poems: DataFrame, key: str = "ID", text: str = "text", threshold: float = 0.65) -> DataFrame:
    """One row per document: (doc_key, class_id, group_id, class_size, links): links counts the other classes linked to its class."""
    g = Links(poems, key, text, threshold)
    nodes = g.members.groupBy("cls").agg(F.count(F.lit(1)).alias("class_size"))
    ends = g.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    comp = components(g.links, nodes.select("cls"))
    info = comp.join(nodes, "cls").join(ends, "cls", "left")
    return g.members.join(info, "cls").select("doc_key", F.col("cls").alias("class_id"), F.col("component").alias("group_id"), "class_size", F.coalesce("links", F.lit(0)).alias("links"))
