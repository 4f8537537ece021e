"""Problem 7: mixing sources to target weights.

Method: Pareto order sampling. A source whose target exceeds what it holds is first taken in whole copies (at most ``max_repeats``); the rest is a
sample of fixed size with unequal inclusion probabilities: documents are ranked by random odds over inclusion odds, U / (1 - U) over
p / (1 - p), and taken in this order. As shares are shares of tokens, the fixed size is one of tokens: the sample ends with the document that
brings it nearest to the rest. p grows with ``tokens ** alpha`` and is scaled so that the expected tokens equal the rest;
probabilities that reach one are certain and leave the scaling. U is a hash of the key, so a run repeats itself anywhere.

No source is gathered for its ranking: the last rank taken is found by refining histograms (source, bin) of tokens, each one aggregate with
1,024 bins a source, until the bin holds one rank.

Defined cases: a NULL or unknown source is outside the mix; source names count without case and outer blanks; a NULL or empty text has no tokens and is never
sampled but is part of whole copies; of repeated keys the row with most tokens counts; equal ranks go by key; a source with no documents reaches a share of 0;
empty tables give no copies and a report of the targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tokens import token_sizes

BINS = 1024
_SPAN = 1 << 62


def plan_source(target: float, supply: int, max_repeats: int) -> tuple[int, float]:
    """(whole copies, tokens still to sample) of one source."""
    if supply <= 0:
        return 0, 0.0
    if target > supply * max_repeats:
        return max_repeats, 0.0
    whole = min(int(target // supply), max_repeats)
    return whole, target - whole * supply


def _crossing(bins: list, n: float) -> tuple[int, int, float] | None:
    """(least, most, tokens still to take) of the bin in which n tokens are reached; None if they are not."""
    for r in sorted(bins, key=lambda r: r["bin"]):
        if n <= r["n"]:
            return r["least"], r["most"], n
        n -= r["n"]
    return None


class Mix:
    """The plan and the drawn copies. ``size``: tokens of the mix; default all tokens of documents with a source in the targets."""

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: int | None = None, alpha: float = 0.5, seed: int = 7) -> None:
        name = F.lower(F.regexp_replace(F.col("source"), r"(?U)^\s+|\s+$", ""))
        want = targets.select(name.alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        self.targets = {r["source"]: (r["target_share"] or 0.0, int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in want.collect()}  # one row a source of the mix
        every = token_sizes(documents.filter(F.col(key).isNotNull()), key, text, source).filter(F.col("source").isin(list(self.targets)))
        one = every.groupBy("doc_key").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_key", "m.source", "m.tokens")
        self.docs = materialise(one.withColumn("w", F.pow(F.col("tokens"), F.lit(float(alpha)))))
        self.seed = seed
        supply = self.docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
        self.supply = {r["source"]: r["tokens"] or 0 for r in supply}
        self.size = sum(self.supply.values()) if size is None else size
        self.plan = {s: plan_source(share * self.size, self.supply.get(s, 0), repeats) for s, (share, repeats) in self.targets.items()}
        self._draw()

    def _draw(self) -> None:
        rest = {s: t for s, (_, t) in self.plan.items() if t > 0}
        self.scale = self._scales(rest)
        p = F.least(F.lit(1.0), self._by_source(self.scale, F.col("source")) * F.col("w"))
        u = (F.pmod(F.xxhash64("doc_key", F.lit(self.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        odds = F.when(p >= 1, 0.0).otherwise(u / (1 - u) / (p / (1 - p)))
        # ranks as whole numbers in [0, 2^62): odds / (1 + odds), finely cut
        rank = F.least((odds / (1 + odds) * float(_SPAN)).cast("bigint"), F.lit(_SPAN - 1))
        drawn = self.docs.filter(F.col("source").isin(list(rest)) & (F.col("tokens") > 0)).withColumn("p", p).withColumn("rank", rank)
        drawn = materialise(drawn.select("doc_key", "source", "tokens", "p", "rank"))
        self.cut = self._thresholds(drawn, rest)
        taken = F.lit(False)
        for s, (bound, ties) in self.cut.items():
            taken = F.when(F.col("source") == s, (F.col("rank") < bound) | ((F.col("rank") == bound) & (F.col("doc_key") <= ties))).otherwise(taken)
        self.sample = drawn.filter(taken)

    @staticmethod
    def _by_source(values: dict[str, float], source) -> F.Column:
        out = F.lit(0.0)
        for s, v in values.items():
            out = F.when(source == s, F.lit(float(v))).otherwise(out)
        return out

    def _scales(self, rest: dict[str, float]) -> dict[str, float]:
        """c per source with sum(min(1, c w) tokens) = rest: a few rounds, as certain documents leave the scaling."""
        scale: dict[str, float] = {}
        certain = dict.fromkeys(rest, math.inf)
        for _ in range(8):
            limit = self._by_source(certain, F.col("source"))
            sums = self.docs.filter(F.col("source").isin(list(rest))).groupBy("source").agg(
                F.sum(F.when(F.col("w") < limit, F.col("w") * F.col("tokens")).otherwise(0.0)).alias("wt"), F.sum(F.when(F.col("w") >= limit, F.col("tokens")).otherwise(0)).alias("sure")).collect() if rest else []
            new = {}
            for r in sums:
                free = rest[r["source"]] - r["sure"]
                new[r["source"]] = free / r["wt"] if r["wt"] and free > 0 else scale.get(r["source"], 0.0)
            bounds = {s: 1 / c if c > 0 else math.inf for s, c in new.items()}
            same = all(math.isclose(bounds[s], certain[s], rel_tol=1e-9) for s in bounds)
            scale, certain = new, bounds
            if same:
                break
        return scale

    @staticmethod
    def _thresholds(drawn: DataFrame, rest: dict[str, float]) -> dict[str, tuple[int, int]]:
        """Per source the (rank, key) of the last document taken, in order of rank and key."""
        open_at = {s: (0, _SPAN, n) for s, n in rest.items()}  # interval [low, high) that holds it, and the tokens still to take there
        cut: dict[str, tuple[int, int]] = {}
        while open_at:
            low, width, inside = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(False)
            for s, (a, b, _) in open_at.items():
                at = F.col("source") == s
                low = F.when(at, F.lit(a)).otherwise(low)
                width = F.when(at, F.lit(max(1, -(-(b - a) // BINS)))).otherwise(width)
                inside = F.when(at, (F.col("rank") >= a) & (F.col("rank") < b)).otherwise(inside)
            bins = drawn.filter(inside).groupBy("source", F.floor((F.col("rank") - low) / width).cast("bigint").alias("bin"))
            hist = bins.agg(F.sum("tokens").alias("n"), F.min("rank").alias("least"), F.max("rank").alias("most")).collect()
            found = {s: _crossing([r for r in hist if r["source"] == s], n) for s, (_, _, n) in open_at.items()}
            open_at = {}
            for s, hit in found.items():
                if hit is None:  # everything is taken
                    cut[s] = (_SPAN, 0)
                elif hit[0] == hit[1]:
                    cut[s] = (hit[0], Mix._last_key(drawn.filter((F.col("source") == s) & (F.col("rank") == hit[0])), hit[2]))
                else:
                    open_at[s] = (hit[0], hit[1] + 1, hit[2])
        return cut

    @staticmethod
    def _last_key(df: DataFrame, n: float) -> int:
        """Among documents of one rank, in order of their keys, the last one taken; a key below all of them for none."""
        r = df.agg(F.min("doc_key").alias("a"), F.max("doc_key").alias("b")).first()
        a, b = r["a"], r["b"]
        while b > a:
            width = max(1, -(-(b - a + 1) // BINS))
            bins = df.filter((F.col("doc_key") >= a) & (F.col("doc_key") <= b)).groupBy(F.floor((F.col("doc_key") - a) / width).cast("bigint").alias("bin"))
            hit = _crossing(bins.agg(F.sum("tokens").alias("n"), F.min("doc_key").alias("least"), F.max("doc_key").alias("most")).collect(), n)
            if hit is None:
                return b
            a, b, n = hit
        size = df.filter(F.col("doc_key") == a).agg(F.sum("tokens")).first()[0]
        return a if n > size - n else a - 1

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, copies): how often each document is used; documents used no time are left out."""
        whole = self._by_source({s: w for s, (w, _) in self.plan.items()}, F.col("source")).cast("int")
        used = self.docs.select("doc_key", "source", "tokens").join(self.sample.select("doc_key", F.lit(1).alias("extra")), "doc_key", "left")
        return used.select(F.col("doc_key").alias("doc_id"), "source", "tokens", (whole + F.coalesce("extra", F.lit(0))).alias("copies")).filter("copies > 0")

    def report(self) -> DataFrame:
        """One row a source: target and reached share, supply, whole copies, sampled documents, tokens, and whether the target can be reached: it cannot
        where the drawn copies stay below it although every document is used as often as it may be."""
        got = {r["source"]: (r["n"], r["t"]) for r in self.sample.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
        tokens = {s: self.plan[s][0] * self.supply.get(s, 0) + got.get(s, (0, 0))[1] for s in self.targets}
        total = sum(tokens.values())
        rows = [(s, float(share), repeats, int(self.supply.get(s, 0)), self.plan[s][0], got.get(s, (0, 0))[0], int(tokens[s]), tokens[s] / total if total else 0.0, tokens[s] / self.size if self.size else 0.0, share <= 0 or 0 < tokens[s] >= share * self.size or tokens[s] < self.supply.get(s, 0) * repeats) for s, (share, repeats) in sorted(self.targets.items())]
        return self.docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, supply_tokens bigint, whole_copies int, sampled_docs bigint, tokens bigint, reached_share double, share_of_size double, reachable boolean")


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p7_found: sources whose drawn copies cannot reach their target."""
    return Mix(documents, targets).report().filter("not reachable").select("source")
