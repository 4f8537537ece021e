"""Rank statistics, multiplicity and samples (O-W02..W08, O-M02, M03, O-B01, B02, O-L08..L13).

Adjustments run over families of test results, which are small; ranks over token-scale values are counted, not windowed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def bh(df: DataFrame, family: list[str], p: str = "p", tie: list[str] | None = None, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg within families; NULL p stay NULL and do not count (O-B01, O-W05)."""
    fam = Window.partitionBy(*family, F.col(p).isNull())
    by = fam.orderBy(F.col(p).asc(), *(tie or []))
    raw = F.col(p) * F.count(p).over(fam) / F.row_number().over(by)
    back = by.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("_raw", raw).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(back)))).drop("_raw")


def holm(df: DataFrame, family: list[str], p: str = "p", tie: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Holm's step-down within families (O-B02, O-W06)."""
    fam = Window.partitionBy(*family, F.col(p).isNull())
    by = fam.orderBy(F.col(p).asc(), *(tie or []))
    raw = F.col(p) * (F.count(p).over(fam) - F.row_number().over(by) + 1)
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_raw", F.least(F.lit(1.0), raw)).withColumn(out, F.when(F.col(p).isNotNull(), F.max("_raw").over(run))).drop("_raw")


def mann_whitney(df: DataFrame, by: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """U of the first group, its normal score with tie and continuity correction, and the two-sided p (O-M02): exact where a side has at most
    eight values and no two are equal, else that of the score.

    Values are counted per (by, value) first, so the window runs over distinct values only."""
    w = Window.partitionBy(*by).orderBy(value)
    c = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second)).groupBy(*by, value).agg(F.sum((F.col(group) == first).cast("bigint")).alias("a"), F.count(F.lit(1)).alias("m"))
    r = c.withColumn("rank", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m") + (F.col("m") + 1) / 2)
    s = r.groupBy(*by).agg(F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum("a").alias("n1"), (F.sum("m") - F.sum("a")).alias("n2"), F.sum(F.col("m").cast("double") * F.col("m") * F.col("m") - F.col("m")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    s = s.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    d = F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2.0)
    s = s.withColumn("z", F.when(var > 0, F.greatest(F.lit(0.0), d - 0.5) / F.sqrt(var)))
    exact = (F.least("n1", "n2") <= 8) & (F.col("ties") == 0)
    p = F.when(exact, _exact_p(F.col("u"), F.col("n1"), F.col("n2"))).otherwise(two_sided_p(F.col("z")))
    return s.select(*by, "n1", "n2", "u", "z", p.alias("p"))


def exact_u(n1: int, n2: int) -> np.ndarray:
    """Probability of each U from 0 to n1 n2 without ties: the coefficients of the Gaussian binomial, by multiplying and dividing factors 1 - q^i."""
    few, many = sorted((n1, n2))
    c = np.zeros(n1 * n2 + 1)
    c[0] = 1.0
    for i in range(1, few + 1):
        up, down = many + i, i
        c[up:] -= c[:-up].copy() if up < len(c) else 0.0
        for start in range(down):
            c[start::down] = np.cumsum(c[start::down])
    return c / c.sum()


def exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U by its exact distribution."""
    p = exact_u(n1, n2)
    return min(1.0, 2 * float(p[: round(min(u, n1 * n2 - u)) + 1].sum()))


@F.pandas_udf(DoubleType())
def _exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """One row a test; rows that do not ask for it (ties, larger sides) are passed over."""
    return pd.Series([exact_p(float(a), int(b), int(c)) if min(b, c) <= 8 and min(b, c) > 0 and float(a).is_integer() else None for a, b, c in zip(u, n1, n2)], dtype="float64")


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p of |z|: the complementary error function itself, for result tables."""
    return z.map(normal_p, na_action="ignore").astype("float64")


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def cohens_d(df: DataFrame, by: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """Difference of means over the pooled deviation; NULL below two values a side or without spread (O-M03)."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.groupBy(*by).agg(*[f(pick(g)).alias(f"{n}{i}") for i, g in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return s.select(*by, "n1", "n2", F.when((F.col("n1") > 1) & (F.col("n2") > 1) & (pooled > 0), (F.col("m2") - F.col("m1")) / pooled).alias("cohens_d"))


def lot(key: str, seed: int, *more: Column) -> Column:
    """A number from 0 to 2^32 - 1 drawn by the key (and more) and the seed: the same anywhere, in SQL too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), *[c.cast("string") for c in more])), 1, 8), 16, 10).cast("bigint")


def quota_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum by seeded hash of the key: the same rows on every run (O-L08, L10, L11)."""
    order = Window.partitionBy(*strata).orderBy(lot(key, seed), key)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def proportional_sample(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """About ``total`` rows in proportion to the strata, topped up from the rest (O-L09)."""
    every = df.count()
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*strata).orderBy(lot(key, seed), key)
    quota = F.floor(F.col("_n") * total / F.lit(max(every, 1)))
    ranked = df.join(sizes, strata).withColumn("_k", F.row_number().over(order) - quota)
    # within quota first, then the next of each stratum, until the total is reached
    pick = ranked.withColumn("_o", F.greatest(F.lit(0), F.col("_k"))).orderBy("_o", lot(key, seed), key).limit(total)
    return pick.drop("_n", "_k", "_o")


def split(df: DataFrame, key: str, shares: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """Seeded split by hash of the key (O-L12, O-K09): independent of order and partitions."""
    u = lot(key, seed) / float(1 << 32)
    out, edge = F.lit(names[-1]), 1.0
    for share, name in reversed(list(zip(shares[:-1], names[:-1]))):
        edge = sum(shares[: names.index(name) + 1])
        out = F.when(u < edge, name).otherwise(out)
    return df.withColumn("split", out)
