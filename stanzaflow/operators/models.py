"""Regression on Spark: distributed IRLS with cluster-robust covariance, fixed effects in closed form, and small-table estimators
(O-M04..M25, O-B03..B10).

Each iteration is one aggregate of (p + p squared) numbers; per-cluster score sums give the sandwich. What needs a whole author's or interval
table at once (conditional likelihood, bootstraps, smoothing) runs per group in Arrow over rows that were aggregated before."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, ship
from .ranks import lot, normal_p, two_sided_p


# ---- closed forms ---------------------------------------------------------------------------------------------------------------


def rate_ratio(df: DataFrame, by: list[str], k: str, exposure: str, period: str, before: str, after: str, cluster: str) -> DataFrame:
    """Poisson rate ratio after / before with cluster-robust error (O-M04): with one binary regressor the likelihood's maximum is the ratio of
    the two rates (rows need a positive exposure), and the sandwich follows from each cluster's residual sums. Entirely in SQL."""
    side = lambda p, c: F.sum(F.when(F.col(period) == p, F.col(c)).otherwise(0).cast("double"))
    per = df.filter(F.col(period).isin(before, after) & (F.col(exposure) > 0)).groupBy(*by, cluster).agg(side(before, k).alias("k1"), side(after, k).alias("k2"), side(before, exposure).alias("e1"), side(after, exposure).alias("e2"), F.count(F.lit(1)).alias("rows"))
    tot = per.groupBy(*by).agg(*[F.sum(c).alias(f"t{c}") for c in ("k1", "k2", "e1", "e2")], F.count(F.lit(1)).alias("n_clusters"), F.sum("rows").alias("n"))
    j = per.join(tot, by)
    share = lambda i: F.try_divide(F.col(f"k{i}"), F.col(f"tk{i}")) - F.try_divide(F.col(f"e{i}"), F.col(f"te{i}"))  # noqa: E731  # a cluster's residual over the period's count
    meat = j.groupBy(*by).agg(F.sum((share(2) - share(1)) * (share(2) - share(1))).alias("v"))
    g = F.col("n_clusters").cast("double")
    small = F.try_divide(g, g - 1) * F.try_divide(F.col("n") - 1, F.col("n") - 2)
    ok = (F.col("tk1") > 0) & (F.col("tk2") > 0) & (F.col("te1") > 0) & (F.col("te2") > 0)
    coef = F.log(F.try_divide(F.col("tk2") * F.col("te1"), F.col("te2") * F.col("tk1")))
    out = tot.join(meat, by).withColumn("coef", F.when(ok, coef)).withColumn("se", F.when(ok & (F.col("n_clusters") > 1) & (F.col("n") > 2), F.sqrt(F.col("v") * small)))
    return out.select(*by, F.col("tk1").alias("k_before"), F.col("tk2").alias("k_after"), F.col("te1").alias("exposure_before"), F.col("te2").alias("exposure_after"), "n", "n_clusters", "coef", F.exp("coef").alias("rate_ratio"), "se")


def author_shifts(df: DataFrame, author: str, k: str, exposure: str, period: str, before: str, after: str) -> DataFrame:
    """Fixed effects author x period (O-M07): the saturated design's coefficients are log rate shifts per author, with HC3 errors from the
    leverages (mu over the cell's sum of mu)."""
    used = df.filter(F.col(period).isin(before, after) & (F.col(exposure) > 0))
    cell = used.groupBy(author, period).agg(F.sum(k).alias("K"), F.sum(exposure).alias("E"))
    j = used.join(cell, [author, period])
    mu = F.col(exposure) * F.col("K") / F.col("E")
    r = (F.col(k) - mu) / (1 - mu / F.col("K"))
    v = j.filter((F.col("K") > 0) & (F.col("E") > 0)).groupBy(author, period).agg(F.first("K").alias("K"), F.first("E").alias("E"), F.sum(F.when(mu < F.col("K"), r * r).otherwise(0.0)).alias("m"))
    pick = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))
    w = v.groupBy(author).agg(*[pick(p, c).alias(f"{c}{i}") for i, p in ((1, before), (2, after)) for c in ("K", "E", "m")]).filter("K1 is not null and K2 is not null")
    return w.select(author, F.log((F.col("K2") / F.col("E2")) / (F.col("K1") / F.col("E1"))).alias("shift"), F.sqrt(F.col("m1") / (F.col("K1") * F.col("K1")) + F.col("m2") / (F.col("K2") * F.col("K2"))).alias("se"), F.col("K1").cast("bigint").alias("k_before"), F.col("K2").cast("bigint").alias("k_after"))


def logit_shifts(df: DataFrame, author: str, k: str, n: str, period: str, before: str, after: str) -> DataFrame:
    """Per author log-odds shift with the half-count correction where a cell is empty or full (O-M08, O-B08)."""
    s = lambda p, c: F.sum(F.when(F.col(period) == p, F.col(c)).otherwise(0)).cast("double")
    w = df.groupBy(author).agg(s(before, k).alias("k1"), s(before, n).alias("n1"), s(after, k).alias("k2"), s(after, n).alias("n2")).filter("n1 > 0 and n2 > 0")
    fix = (F.col("k1") == 0) | (F.col("k2") == 0) | (F.col("k1") == F.col("n1")) | (F.col("k2") == F.col("n2"))
    h = F.when(fix, 0.5).otherwise(0.0)
    odds = lambda i: (F.col(f"k{i}") + h) / (F.col(f"n{i}") - F.col(f"k{i}") + h)
    inv = sum(1 / (c + h) for i in (1, 2) for c in (F.col(f"k{i}"), F.col(f"n{i}") - F.col(f"k{i}")))
    return w.select(author, F.log(odds(2) / odds(1)).alias("shift"), F.sqrt(inv).alias("se"), fix.alias("corrected"))


def shrunk(shifts: DataFrame, by: list[str], shift: str = "shift", se: str = "se") -> DataFrame:
    """Empirical-Bayes shrinkage of author shifts to their common mean (stands in for O-M20's sampled random slopes): method-of-moments
    between-author variance, posterior mean, deviation and probability of a positive shift."""
    ok = shifts.filter((F.col(se) > 0) & F.col(shift).isNotNull())
    w = 1 / (F.col(se) * F.col(se))
    tot = ok.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * F.col(shift)).alias("swy"), F.sum(w * F.col(shift) * F.col(shift)).alias("swyy"), F.sum(w * w).alias("sww"), F.count(F.lit(1)).alias("m"))
    q = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")
    tot = tot.withColumn("tau2", F.greatest(F.lit(0.0), (q - (F.col("m") - 1)) / (F.col("sw") - F.col("sww") / F.col("sw")))).withColumn("mu", F.col("swy") / F.col("sw")).select(*by, "tau2", "mu")
    j = ok.join(tot, by) if by else ok.crossJoin(tot)
    b = F.col("tau2") / (F.col("tau2") + F.col(se) * F.col(se))
    mean, sd = F.col("mu") + b * (F.col(shift) - F.col("mu")), F.sqrt(b) * F.col(se)
    z = F.when(sd > 0, mean / sd)
    tail = two_sided_p(z) / 2
    return j.withColumn("posterior_mean", mean).withColumn("posterior_sd", sd).withColumn("p_positive", F.when(z.isNull(), (mean > 0).cast("double")).when(z > 0, 1 - tail).otherwise(tail))


# ---- distributed IRLS -----------------------------------------------------------------------------------------------------------


def _map_sums(df: DataFrame, columns: list[str], f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the vectors f makes of each batch's matrix."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                s = f(np.stack([np.asarray(c.to_pylist(), float) for c in b.columns], 1))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    rows = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(max((r["i"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["i"]] = r["s"]
    return out


class Glm:
    """Poisson (log), negative binomial (log, ``dispersion``) or binomial (logit, successes of ``trials``) regression.

    ``predictors`` are numeric columns; an intercept is added. ``cluster`` gives a sandwich from score sums per cluster."""

    def __init__(self, df: DataFrame, y: str, predictors: list[str], family: str = "poisson", offset: str | None = None, trials: str | None = None, cluster: str | None = None, dispersion: float = 0.0, iterations: int = 25, ridge: float = 0.0) -> None:
        self.names, self.family, self.alpha = ["intercept", *predictors], family, dispersion
        zero, one = F.lit(0.0), F.lit(1.0)
        rows = df.select(F.col(y).cast("double").alias("_y"), (F.log(offset) if offset else zero).alias("_o"), (F.col(trials).cast("double") if trials else one).alias("_n"), *[F.col(p).cast("double").alias(f"_x{i}") for i, p in enumerate(predictors)], *([F.col(cluster).alias("_c")] if cluster else []))
        self.rows = materialise(rows.dropna())  # a few numbers a row, read once an iteration
        self.columns = ["_y", "_o", "_n", *[f"_x{i}" for i in range(len(predictors))]]
        p = len(self.names)
        self.beta = np.zeros(p)
        start = _map_sums(self.rows, self.columns, lambda m: np.array([m[:, 0].sum(), (np.exp(m[:, 1]) * m[:, 2]).sum(), len(m)]))
        self.n = int(start[2]) if len(start) else 0
        if not self.n:
            self.covariance = np.full((p, p), np.nan)
            self.converged = False
            return
        m0 = max(start[0], 0.5) / start[1]
        self.beta[0] = math.log(m0 / (1 - min(m0, 0.999))) if family == "binomial" else math.log(m0)
        self.converged = False
        for _ in range(iterations):
            s = _map_sums(self.rows, self.columns, self._sums(self.beta))
            h, g = s[:-p].reshape(p, p) + ridge * np.eye(p), s[-p:] - ridge * self.beta
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            self.beta = self.beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                self.converged = True
                break
        s = _map_sums(self.rows, self.columns, self._sums(self.beta))
        bread = np.linalg.pinv(s[:-p].reshape(p, p) + ridge * np.eye(p))
        self.covariance = bread
        if cluster:
            self.covariance = self._sandwich(bread)

    def _parts(self, m: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.column_stack((np.ones(len(m)), m[:, 3:]))
        eta = np.clip(x @ beta + m[:, 1], -30, 30)
        if self.family == "binomial":
            mu = 1 / (1 + np.exp(-eta))
            return x, m[:, 0] - m[:, 2] * mu, m[:, 2] * mu * (1 - mu)
        mu = np.exp(eta)
        v = 1 + self.alpha * mu
        return x, (m[:, 0] - mu) / v, mu * (1 + self.alpha * m[:, 0]) / v**2 if self.alpha else mu

    def _sums(self, beta: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        return Glm._sums_at(self.family, self.alpha, beta)

    @staticmethod
    def _sums_at(family: str, alpha: float, beta: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        bare = object.__new__(Glm)  # what the workers need of a model, without its DataFrame
        bare.family, bare.alpha = family, alpha

        def f(m: np.ndarray) -> np.ndarray:
            x, r, w = bare._parts(m, beta)
            return np.concatenate(((x.T @ (x * w[:, None])).ravel(), x.T @ r))

        return f

    def _sandwich(self, bread: np.ndarray) -> np.ndarray:
        p = len(self.names)
        x = [F.lit(1.0), *[F.col(c) for c in self.columns[3:]]]
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((c * float(b) for c, b in zip(x, self.beta)), F.lit(0.0)) + F.col("_o")))
        if self.family == "binomial":
            r = F.col("_y") - F.col("_n") / (1 + F.exp(-eta))
        else:
            r = (F.col("_y") - F.exp(eta)) / (1 + self.alpha * F.exp(eta))
        scores = self.rows.groupBy("_c").agg(*[F.sum(c * r).alias(f"s{i}") for i, c in enumerate(x)])
        sums = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p)]
        row = scores.agg(*sums, F.count(F.lit(1)).alias("g")).first()
        meat = np.array(row[:-1], float).reshape(p, p)
        g = row["g"]
        scale = g / (g - 1) * (self.n - 1) / (self.n - p) if g > 1 and self.n > p else math.nan
        return bread @ meat @ bread * scale

    def deviance(self) -> float:
        """Twice the log-likelihood's distance from the saturated model (Poisson)."""
        beta = self.beta

        def f(m: np.ndarray) -> np.ndarray:
            mu = np.exp(np.clip(np.column_stack((np.ones(len(m)), m[:, 3:])) @ beta + m[:, 1], -30, 30))
            y = m[:, 0]
            return np.array([2 * (y * np.log(np.where(y > 0, y, 1) / mu) * (y > 0) - (y - mu)).sum()])

        return _map_sums(self.rows, self.columns, f)[0]

    def table(self) -> pd.DataFrame:
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        z = np.divide(self.beta, se, out=np.full_like(se, np.nan), where=se > 0)
        return pd.DataFrame({"term": self.names, "coef": self.beta, "se": se, "z": z, "p": [normal_p(v) if np.isfinite(v) else math.nan for v in z]})

    def contrast(self, weights: dict[str, float]) -> dict[str, float | None]:
        """c'beta with its error, z, p and ratio; a missing term gives NULLs (O-M11)."""
        if any(t not in self.names for t in weights):
            return dict.fromkeys(("estimate", "se", "z", "p", "ratio"))
        c = np.array([weights.get(t, 0.0) for t in self.names])
        est, var = float(c @ self.beta), float(c @ self.covariance @ c)
        se = math.sqrt(max(var, 0))
        return {"estimate": est, "se": se, "z": est / se if se else None, "p": normal_p(est / se) if se else None, "ratio": math.exp(est)}


def negative_binomial(df: DataFrame, y: str, predictors: list[str], offset: str | None = None, cluster: str | None = None, grid: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0)) -> Glm:
    """Dispersion by profile likelihood over a grid, refined once (O-M05). All values of the grid are fitted together: an iteration is one aggregate for all."""
    first = Glm(df, y, predictors, offset=offset)
    p = len(first.names)

    def fits(alphas: list[float]) -> list[tuple[float, float]]:
        """(log-likelihood, dispersion) of each."""
        betas = [first.beta.copy() for _ in alphas]
        for _ in range(25):
            each = [Glm._sums_at("poisson", a, b) for a, b in zip(alphas, betas)]
            sums = _map_sums(first.rows, first.columns, lambda m: np.concatenate([f(m) for f in each])).reshape(len(alphas), -1)
            steps = [np.linalg.lstsq(s[:-p].reshape(p, p), s[-p:], rcond=None)[0] for s in sums]
            betas = [b + np.clip(d, -5, 5) for b, d in zip(betas, steps)]
            if max(np.abs(d).max() for d in steps) < 1e-8:
                break
        lg = np.vectorize(math.lgamma, otypes=[float])

        def loglik(m: np.ndarray) -> np.ndarray:
            x, k = np.column_stack((np.ones(len(m)), m[:, 3:])), m[:, 0]
            out = []
            for a, b in zip(alphas, betas):
                mu = np.exp(np.clip(x @ b + m[:, 1], -30, 30))
                out.append((lg(k + 1 / a) - lg(1 / a) - lg(k + 1) - (1 / a) * np.log1p(a * mu) + k * np.log(a * mu / (1 + a * mu))).sum())
            return np.array(out)

        return list(zip(_map_sums(first.rows, first.columns, loglik).tolist(), alphas))

    if not first.n:
        return first
    best = max(fits(list(grid)))[1]
    best = max(fits([best / 1.5, best, best * 1.5]))[1]
    discard(first.rows)
    return Glm(df, y, predictors, offset=offset, cluster=cluster, dispersion=best)


# ---- small tables: one row an interval, an author or a variant --------------------------------------------------------------------


def wls_hc3(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted least squares with HC3 covariance and R squared (O-M13, O-M15)."""
    xw = x * w[:, None]
    inv = np.linalg.pinv(x.T @ xw)
    b = inv @ (xw.T @ y)
    r = y - x @ b
    lev = np.clip(np.einsum("ij,jk,ik->i", x, inv, xw), 0, 1 - 1e-9)
    s = xw * (r / (1 - lev))[:, None]
    mean = np.average(y, weights=w)
    return b, inv @ (s.T @ s) @ inv, 1 - float((w * r**2).sum() / max((w * (y - mean) ** 2).sum(), 1e-300))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, frac: float = 0.3) -> np.ndarray:
    """Local linear smooth with tricube weights over the nearest share of points (O-M16)."""
    k = max(2, math.ceil(frac * len(x)))
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        h = max(np.sort(d)[min(k, len(x)) - 1], 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        sw = w.sum()
        mx, my = (w * x).sum() / sw, (w * y).sum() / sw
        vx = (w * (x - mx) ** 2).sum()
        out[i] = my + ((w * (x - mx) * (y - my)).sum() / vx * (a - mx) if vx > 1e-12 else 0.0)
    return out


def change_points(y: np.ndarray, penalty: float = 4.0, least: int = 2) -> list[int]:
    """Optimal partition under an RBF kernel cost (O-M18): exact dynamic programme over a few dozen points, pruned where it cannot win."""
    n = len(y)
    if n < 2 * least:
        return []
    d = (y[:, None] - y[None, :]) ** 2
    med = np.median(d[np.triu_indices(n, 1)])
    kern = np.exp(-d / med) if med > 0 else np.ones((n, n))
    cum = np.zeros((n + 1, n + 1))
    cum[1:, 1:] = kern.cumsum(0).cumsum(1)
    cost = lambda a, b: (b - a) - (cum[b, b] - cum[a, b] - cum[b, a] + cum[a, a]) / (b - a)
    best, last = [-penalty] + [math.inf] * n, [0] * (n + 1)
    open_at = [0]
    for b in range(least, n + 1):
        tried = [(best[a] + cost(a, b) + penalty, a) for a in open_at if b - a >= least]
        if tried:
            best[b], last[b] = min(tried)
        open_at = [a for a in open_at if b - a < least or best[a] + cost(a, b) <= best[b]] + [b - least + 1]
        open_at = sorted({a for a in open_at if best[a] < math.inf})
    out, b = [], n
    while last[b] > 0:
        b = last[b]
        out.append(b)
    return out[::-1]


def change_point_interval(y: np.ndarray, at: np.ndarray, draws: int = 500, penalty: float = 4.0, seed: int = 20260519) -> dict[str, float | int | None]:
    """The first change point with the 2.5 and 97.5 percentiles of those of resampled series (O-M18), one value a year; NULL without a change or under six points."""
    first = lambda v: next(iter(change_points(v, penalty)), None)
    none = {"detected": None, "low": None, "high": None, "n_points": len(y), "n_valid": 0}
    if len(y) < 6 or (here := first(y)) is None:
        return none
    rng = np.random.default_rng(seed)
    found = [float(at[b]) for b in (first(y[rng.integers(0, len(y), len(y))]) for _ in range(draws)) if b is not None]
    low, high = np.percentile(found, [2.5, 97.5]) if found else (None, None)
    return none | {"detected": float(at[here]), "low": low if low is None else float(low), "high": high if high is None else float(high), "n_valid": len(found)}


def weighted_loess(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, frac: float = 0.3) -> np.ndarray:
    """Local linear smooth whose points count ``w`` times: the span holds ``frac`` of the weight."""
    out = np.full(len(at), np.nan)
    used = w > 0
    x, y, w = x[used], y[used], w[used]
    for i, a in enumerate(at if len(x) else ()):
        d = np.abs(x - a)
        order = np.argsort(d, kind="stable")
        h = max(d[order][min(np.searchsorted(np.cumsum(w[order]), frac * w.sum()), len(x) - 1)], 1e-12)
        k = w * np.clip(1 - (d / h) ** 3, 0, None) ** 3
        if k.sum() <= 0:
            k = w * (d <= h)
        mx, my = np.average(x, weights=k), np.average(y, weights=k)
        vx = (k * (x - mx) ** 2).sum()
        out[i] = my + ((k * (x - mx) * (y - my)).sum() / vx * (a - mx) if vx > 1e-12 else 0.0)
    return out


def smooth_bands(df: DataFrame, author: str, x: str, y: str, frac: float = 0.3, draws: int = 200, seed: int = 20260511) -> DataFrame:
    """(x, smooth, low, high): a local linear smooth of the mean of ``y`` over ``x`` (months, years) with 95 % bands from resampled authors (O-M16).

    Each draw gives every author a Poisson weight drawn from its name, so draws are sums over authors in Spark; what is collected is one row a draw
    and value of x."""
    per = df.dropna(subset=[author, x, y]).groupBy(author, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(y).cast("double")).alias("s"))
    u = lot(author, seed, F.col("d")) / float(1 << 32)
    edges, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        edges.append(total)
    weight = sum(((u >= e).cast("int") for e in edges), F.lit(0))
    drawn = per.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("w", F.when(F.col("d") == 0, 1).otherwise(weight)).filter("w > 0")
    sums = drawn.groupBy("d", "x").agg(F.sum(F.col("w") * F.col("m")).alias("n"), F.sum(F.col("w") * F.col("s")).alias("s")).toPandas()
    grid = np.sort(sums.loc[sums["d"] == 0, "x"].to_numpy())
    curves = {}
    for d, g in sums.groupby("d"):
        g = g.sort_values("x")
        curves[d] = weighted_loess(g["x"].to_numpy(), (g["s"] / g["n"]).to_numpy(), g["n"].to_numpy(float), grid, frac)
    schema = "x double, smooth double, low double, high double"
    if not curves:
        return df.sparkSession.createDataFrame([], schema)
    bands = np.nanpercentile(np.array([c for d, c in curves.items() if d]), [2.5, 97.5], axis=0) if len(curves) > 1 else np.full((2, len(grid)), np.nan)
    return df.sparkSession.createDataFrame([tuple(map(float, r)) for r in zip(grid, curves[0], *bands)], schema)


def chi2_tail(x: float, degrees: int) -> float:
    """P(chi-square > x), by the recurrence of the incomplete gamma function in steps of two degrees."""
    half, k = x / 2, degrees % 2 or 2
    q = math.erfc(math.sqrt(half)) if k == 1 else math.exp(-half)
    while k < degrees:
        q += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1)) if half > 0 else 0.0
        k += 2
    return min(1.0, q)


def spline_test(df: DataFrame, y: str, x: str, offset: str, degrees: int = 5) -> dict[str, float | int]:
    """Poisson regression on a cubic B-spline of ``x`` against a constant rate: both deviances, their difference and its chi-square p (O-M17). Inner knots are
    quantiles of x and stay fixed; of the basis, which adds up to one, the first column is left out beside the intercept."""
    from .temporal import bspline_basis

    used = df.dropna(subset=[y, x, offset]).filter(F.col(offset) > 0)
    v = F.col(x).cast("double")
    inner = [i / (degrees - 2) for i in range(1, degrees - 2)]
    q = used.agg(F.percentile(v, F.array(*[F.lit(p) for p in [0.0, *inner, 1.0]])).alias("q")).first()["q"]
    if q is None or len(set(q)) < len(q):
        return {"deviance_smooth": math.nan, "deviance_null": math.nan, "drop": math.nan, "degrees": 0, "p": math.nan}
    basis = bspline_basis(v, list(q))
    names = [f"_b{i}" for i in range(1, len(basis))]
    rows = used.select(F.col(y).alias("_k"), F.col(offset).alias("_e"), *[b.alias(f"_b{i}") for i, b in enumerate(basis)])

    def deviance(predictors: list[str]) -> float:
        g = Glm(rows, "_k", predictors, offset="_e")
        out = float(g.deviance())
        discard(g.rows)
        return out

    smooth, null = deviance(names), deviance([])
    return {"deviance_smooth": smooth, "deviance_null": null, "drop": null - smooth, "degrees": len(names), "p": chi2_tail(max(0.0, null - smooth), len(names))}


def conditional_logit(df: DataFrame, group: str, k: str, n: str, x: list[str], iterations: int = 25) -> pd.DataFrame:
    """Exact conditional logistic regression (O-M10). Rows are binomial counts; a group's likelihood conditions on its successes, with the
    derivatives of its normaliser from Fourier sums. Groups without variation drop out."""
    p = len(x)
    beta = np.zeros(p)
    rows = materialise(df.groupBy(group, *x).agg(F.sum(k).alias("_k"), F.sum(n).alias("_n")))  # equal covariates pool: a group has few distinct rows
    ship(df.sparkSession)
    info = np.full((p, p), np.nan)
    for _ in range(iterations):
        b = beta.copy()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            g, h = clogit_terms(pdf[x].to_numpy(float), pdf["_k"].to_numpy(int), pdf["_n"].to_numpy(int), b)
            return pd.DataFrame({"i": np.arange(p + p * p), "s": np.concatenate((g, h.ravel()))})

        # collected at once, before b changes
        sums = rows.groupBy(group).applyInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        s = np.zeros(p + p * p)
        for r in sums:
            s[r["i"]] = r["s"]
        info = s[p:].reshape(p, p)
        step = np.linalg.lstsq(info, s[:p], rcond=None)[0]
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    se = np.sqrt(np.diag(np.linalg.pinv(info)))
    return pd.DataFrame({"term": x, "coef": beta, "se": se})


def clogit_terms(x: np.ndarray, k: np.ndarray, n: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and information of one group: moments of sum(x) over all ways to place the group's successes.

    Given their sum, the rows' successes are binomials whatever intercept they share; with the one that makes the observed sum the expected one, its
    probability is never small, and the moments are Fourier sums over the characteristic function, which neither overflow nor grow with the counts."""
    total, size, p = int(k.sum()), int(n.sum()), x.shape[1]
    if total == 0 or total == size:
        return np.zeros(p), np.zeros((p, p))
    eta = x @ beta
    level = math.log(total / (size - total))
    low, high = level - float(eta.max()), level - float(eta.min())
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.exp(-np.logaddexp(0, -eta - mid))).sum() < total else (low, mid)
    yes, no = np.exp(-np.logaddexp(0, -eta - high)), np.exp(-np.logaddexp(0, eta + high))
    over = np.where(yes <= 0.5, k - n * yes, n * no - (n - k))  # observed less expected, precise at both ends
    v = n * yes * no
    x = x - (v @ x / v.sum() if v.sum() > 0 else 0.0)
    # With more points than the sum has values the Fourier sums are exact; beyond the second bound (Bernstein's) a value's probability is zero in doubles.
    half = math.ceil(min(size, 250 + math.sqrt(62500 + 1500 * v.sum())) / 2)
    less, side = np.minimum(yes, no), np.where(yes <= 0.5, 1, -1)
    f, s, q = 0.0, np.zeros(p), np.zeros((p, p))
    block = 1 + 2**13 // len(n)
    for first in range(0, half + 1, block):
        at = np.arange(first, min(first + block, half + 1))
        u = 2 * math.pi / (2 * half + 1) * at[:, None]
        turn = 2j * np.sin(u / 2) * np.exp(0.5j * u)  # exp(iu) - 1
        z, r = 1 + yes * turn, -4 * yes * no * np.sin(u / 2) ** 2
        log_z = np.where(r > -0.5, np.log1p(np.maximum(r, -0.5)) / 2, np.log(np.abs(z)))
        phi = np.exp((n * (log_z + 1j * side * (np.angle(1 + less * turn) - less * u))).sum(1) - 1j * u[:, 0] * over.sum()) * np.where(at, 2, 1)
        d = (v * turn / z) @ x  # a row's successes less expected
        f += phi.sum().real
        s += (phi @ d).real
        q += ((d * phi[:, None]).T @ d).real + (x.T * (phi @ (v * (1 + turn) / z**2)).real) @ x
        if phi[-1] == 0:  # its size falls with u
            break
    mean = s / f
    return over @ x - mean, q / f - np.outer(mean, mean)


def random_intercept(df: DataFrame, group: str, y: str, x: list[str], iterations: int = 50) -> dict[str, object]:
    """Linear mixed model with a random intercept by EM over per-group sums (O-M19)."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    p = len(cols)
    v = F.col(y).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(v).alias("sy"), F.sum(v * v).alias("syy"), *[F.sum(c).alias(f"sx{i}") for i, c in enumerate(cols)], *[F.sum(c * v).alias(f"xy{i}") for i, c in enumerate(cols)], *[F.sum(a * b).alias(f"xx{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]]
    g = df.dropna(subset=[group, y, *x]).groupBy(group).agg(*aggs).toPandas()  # one row a group: authors
    n, sy = g["n"].to_numpy(float), g["sy"].to_numpy(float)
    sx = g[[f"sx{i}" for i in range(p)]].to_numpy(float)
    xy, xx, syy = g[[f"xy{i}" for i in range(p)]].to_numpy(float).sum(0), g[[f"xx{i}_{j}" for i in range(p) for j in range(p)]].to_numpy(float).sum(0).reshape(p, p), float(g["syy"].sum())
    beta, s2, t2 = np.linalg.lstsq(xx, xy, rcond=None)[0], max(syy / max(n.sum(), 1), 1e-9), 0.1
    for _ in range(iterations):
        var = 1 / (n / s2 + 1 / t2)
        u = var * (sy - sx @ beta) / s2
        beta = np.linalg.lstsq(xx, xy - sx.T @ u, rcond=None)[0]
        sse = syy - 2 * beta @ xy + beta @ xx @ beta - 2 * (u * (sy - sx @ beta)).sum() + (n * (u**2 + var)).sum()
        s2, t2 = max(float(sse) / max(n.sum(), 1), 1e-12), max(float((u**2 + var).mean()), 1e-12)
    return {"beta": dict(zip(["intercept", *x], beta.tolist())), "sigma2": s2, "tau2": t2, "effects": dict(zip(g[group], u.tolist()))}


def binomial_intercepts(df: DataFrame, group: str, k: str, n: str, x: str, sd: float | None = None) -> dict[str, float]:
    """Binomial mixed model with a random intercept (O-M09, approximated): Gauss-Hermite integration per group over rows pooled by the
    covariate; the deviation is profiled."""
    g = df.groupBy(group, x).agg(F.sum(k).alias("k"), F.sum(n).alias("n")).toPandas()
    node, weight = np.polynomial.hermite_e.hermegauss(15)
    logw = np.log(weight / weight.sum())
    groups = [(d["k"].to_numpy(float), d["n"].to_numpy(float), d[x].to_numpy(float)) for _, d in g.groupby(group)]

    def loglik(b: np.ndarray, s: float) -> float:
        out = 0.0
        for kk, nn, xx in groups:
            eta = (b[0] + b[1] * xx)[:, None] + s * node[None, :]
            out += float(np.logaddexp.reduce(logw + (kk[:, None] * eta - nn[:, None] * np.logaddexp(0, eta)).sum(0)))
        return out

    def climb(s: float) -> tuple[float, np.ndarray]:
        b, h = np.zeros(2), 1e-4
        for _ in range(30):
            e = np.eye(2) * h
            grad = np.array([(loglik(b + e[i], s) - loglik(b - e[i], s)) / (2 * h) for i in range(2)])
            hess = np.array([[(loglik(b + e[i] + e[j], s) - loglik(b + e[i] - e[j], s) - loglik(b - e[i] + e[j], s) + loglik(b - e[i] - e[j], s)) / (4 * h * h) for j in range(2)] for i in range(2)])
            step = np.linalg.lstsq(hess, -grad, rcond=None)[0]
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        return loglik(b, s), b

    best = max((climb(s) + (s,) for s in ([sd] if sd is not None else [0.05, 0.25, 0.5, 1.0, 1.5])), key=lambda r: r[0])
    return {"intercept": float(best[1][0]), "slope": float(best[1][1]), "sd": float(best[2])}


# ---- resampling -------------------------------------------------------------------------------------------------------------------


def _seed(*parts: object) -> int:
    import hashlib

    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def wild_bootstrap(df: DataFrame, by: list[str], k: str, size: str, period: str, before: str, after: str, cluster: str, family: str = "poisson", draws: int = 1999, seed: int = 42) -> DataFrame:
    """Wild cluster bootstrap p of the log rate ratio (Poisson, ``size`` the exposure; O-B05) or of the log odds ratio (binomial, ``size`` the trials, which
    weight the rows' shares; O-B06): (by, coef, t, p_wild, draws, extreme).

    A draw gives every cluster a sign; a row's response becomes fit plus or minus residual, kept above zero (and, as a share, below one), row by
    row. A refit needs only each period's sum of responses, and a cluster adds one of two sums to it, so a draw is an aggregate over two numbers a
    cluster and period. Counted are the draws whose studentised coefficient (by the refit's own error) is at least as large as the observed one, and the
    p is (extreme + 1) / (valid + 1) (O-B10). Signs are drawn by cluster, draw and seed, so they are the same anywhere."""
    used = df.filter(F.col(period).isin(before, after) & (F.col(size) > 0) & F.col(cluster).isNotNull())
    rows = used.select(*by, F.col(cluster).cast("string").alias("_g"), (F.col(period) == after).alias("_post"), F.col(k).cast("double").alias("_k"), F.col(size).cast("double").alias("_n"))
    total = rows.groupBy(*by, "_post").agg(F.sum("_k").alias("_tk"), F.sum("_n").alias("_tn"))
    over = F.try_divide
    mu = F.col("_n") * F.col("_tk") / F.col("_tn")
    if family == "poisson":
        keep = lambda y: F.greatest(y, F.lit(1e-8))
        error = lambda s, n: over(F.lit(1.0), s)
        link = lambda s, n: F.log(over(s, n))
    else:
        keep = lambda y: F.col("_n") * F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), y / F.col("_n")))
        error = lambda s, n: over(F.lit(1.0), s * (1 - over(s, n)))
        link = lambda s, n: F.log(over(s, n - s))
    sums = rows.join(total, [*by, "_post"]).groupBy(*by, "_g", "_post").agg(F.sum(keep(F.col("_k"))).alias("p"), F.sum(keep(2 * mu - F.col("_k"))).alias("m"))
    side = lambda post, c: F.coalesce(F.sum(F.when(F.col("_post") == post, F.col(c))), F.lit(0.0))
    per = sums.groupBy(*by, "_g").agg(*[side(post, c).alias(f"{c}{i}") for i, post in ((1, False), (2, True)) for c in ("p", "m")])
    whole = total.groupBy(*by).agg(*[side(post, c).alias(f"{c}{i}") for i, post in ((1, False), (2, True)) for c in ("_tk", "_tn")])
    ok = (F.col("_tk1") > 0) & (F.col("_tk2") > 0) & (F.lit(family == "poisson") | ((F.col("_tk1") < F.col("_tn1")) & (F.col("_tk2") < F.col("_tn2"))))
    whole = whole.withColumn("coef", F.when(ok, link(F.col("_tk2"), F.col("_tn2")) - link(F.col("_tk1"), F.col("_tn1"))))
    whole = whole.withColumn("t", over(F.col("coef"), F.sqrt(error(F.col("_tk1"), F.col("_tn1")) + error(F.col("_tk2"), F.col("_tn2")))))
    drawn = per.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_up", lot("_g", seed, F.col("_d")) < (1 << 31))
    pick = lambda i: F.sum(F.when(F.col("_up"), F.col(f"p{i}")).otherwise(F.col(f"m{i}"))).alias(f"s{i}")
    refit = drawn.groupBy(*by, "_d").agg(pick(1), pick(2)).join(whole, by)
    star = over(link(F.col("s2"), F.col("_tn2")) - link(F.col("s1"), F.col("_tn1")), F.sqrt(error(F.col("s1"), F.col("_tn1")) + error(F.col("s2"), F.col("_tn2"))))
    # equal up to rounding counts as equal: all signs up give the observed value again
    counted = refit.filter(F.col("t").isNotNull()).withColumn("_t", star).groupBy(*by).agg(F.count("_t").alias("draws"), F.sum((F.abs("_t") >= F.abs("t") - 1e-9).cast("bigint")).alias("extreme"))
    out = whole.select(*by, "coef", "t").join(counted, by, "left")
    return out.select(*by, "coef", "t", ((F.col("extreme") + 1) / (F.col("draws") + 1)).alias("p_wild"), F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("extreme", F.lit(0)).alias("extreme"))


def without_one(df: DataFrame, by: list[str], k: str, exposure: str, period: str, before: str, after: str, author: str) -> DataFrame:
    """Range of the rate ratio when each author in turn is left out (O-P27, O-A33): the totals less the author's own sums."""
    side = lambda p, c: F.sum(F.when(F.col(period) == p, F.col(c)).otherwise(0).cast("double"))
    per = df.filter(F.col(period).isin(before, after) & (F.col(exposure) > 0) & F.col(author).isNotNull()).groupBy(*by, author).agg(side(before, k).alias("k1"), side(after, k).alias("k2"), side(before, exposure).alias("e1"), side(after, exposure).alias("e2"))
    tot = per.groupBy(*by).agg(*[F.sum(c).alias(f"t{c}") for c in ("k1", "k2", "e1", "e2")])
    rest = per.join(tot, by).select(*by, *[(F.col(f"t{c}") - F.col(c)).alias(c) for c in ("k1", "k2", "e1", "e2")]).filter("k1 > 0 and k2 > 0 and e1 > 0 and e2 > 0")
    ratio = (F.col("k2") / F.col("e2")) / (F.col("k1") / F.col("e1"))
    return rest.groupBy(*by).agg(F.count(F.lit(1)).alias("n_variants"), F.min(ratio).alias("least"), F.max(ratio).alias("most"))


def cell_shifts(long: DataFrame, author: str, cell: str, k: str, n: str, period: str, before: str, after: str) -> DataFrame:
    """Per author and cell the shift of the cell's log odds with its 95 % bounds (O-M23): person, number and period saturate an author's binomial model, so its
    fits are the pooled shares. Cells that are empty or full in a period have no finite fit and are left out."""
    side = lambda p, c: F.sum(F.when(F.col(period) == p, F.col(c)).otherwise(0).cast("double"))
    w = long.filter(F.col(author).isNotNull()).groupBy(author, cell).agg(side(before, k).alias("k1"), side(before, n).alias("n1"), side(after, k).alias("k2"), side(after, n).alias("n2"))
    w = w.filter("k1 > 0 and k2 > 0 and k1 < n1 and k2 < n2")
    est = F.log(F.col("k2") / (F.col("n2") - F.col("k2"))) - F.log(F.col("k1") / (F.col("n1") - F.col("k1")))
    se = F.sqrt(1 / F.col("k1") + 1 / (F.col("n1") - F.col("k1")) + 1 / F.col("k2") + 1 / (F.col("n2") - F.col("k2")))
    return w.select(author, cell, est.alias("estimate_logit"), (est - 1.96 * se).alias("ci95_low"), (est + 1.96 * se).alias("ci95_high"))


def poem_bootstrap(df: DataFrame, author: str, k: str, exposure: str, period: str, before: str, after: str, draws: int = 1000, seed: int = 42, smooth: float = 0.5) -> DataFrame:
    """Within-author bootstrap of the log rate shift (O-B07). Poems are pooled by (count, exposure) before the draws, which become
    multinomial counts, so a hot author's rows never meet in one task."""
    pooled = df.filter(F.col(period).isin(before, after) & (F.col(exposure) > 0)).groupBy(author, period, F.col(k).cast("double").alias("k"), F.col(exposure).cast("double").alias("e")).agg(F.count(F.lit(1)).alias("m"))
    ship(df.sparkSession)
    dtype = dict(df.dtypes)[author]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[author].iloc[0]
        rng = np.random.default_rng(_seed(seed, name))
        logs = []
        for p in (before, after):
            d = pdf[pdf[period] == p].sort_values(["k", "e"])
            if d.empty:
                return pd.DataFrame({author: [name], "delta": [0.0], "low": [0.0], "high": [0.0]}).iloc[:0]
            m = d["m"].to_numpy()
            c = np.vstack([m, rng.multinomial(m.sum(), m / m.sum(), draws)])
            logs.append(np.log((c @ d["k"].to_numpy() + smooth) / np.maximum(c @ d["e"].to_numpy(), 1e-12)))
        b = logs[1] - logs[0]
        return pd.DataFrame({author: [name], "delta": [b[0]], "low": [np.percentile(b[1:], 2.5)], "high": [np.percentile(b[1:], 97.5)]})

    return pooled.groupBy(author).applyInPandas(run, f"{author} {dtype}, delta double, low double, high double")


def romano_wolf(df: DataFrame, family: list[str], z: str, key: str, rho: float = 0.5, draws: int = 5000, seed: int = 42) -> DataFrame:
    """Parametric step-down p over a family of exchangeably correlated statistics (O-B03); a family is a handful of specifications."""
    ship(df.sparkSession)
    dt = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.dropna(subset=[z]).copy()
        d["_a"] = d[z].abs()
        d = d.sort_values(["_a", key], ascending=[False, True])
        m = len(d)
        rng = np.random.default_rng(_seed(seed, *[pdf[c].iloc[0] for c in family]))
        sims = np.abs(math.sqrt(rho) * rng.standard_normal((draws, 1)) + math.sqrt(1 - rho) * rng.standard_normal((draws, m)))
        tail = np.maximum.accumulate(sims[:, ::-1], 1)[:, ::-1]  # the largest of this and all less extreme statistics
        p = np.maximum.accumulate((1 + (tail >= d["_a"].to_numpy()[None, :]).sum(0)) / (draws + 1)) if m else np.zeros(0)
        return d.assign(p_rw=p)[[*family, key, z, "p_rw"]]

    return df.select(*family, key, z).groupBy(*family).applyInPandas(run, ", ".join([*(f"{c} {dt[c]}" for c in family), f"{key} {dt[key]}", f"{z} {dt[z]}", "p_rw double"]))


def mean_bootstrap(df: DataFrame, by: list[str], value: str, draws: int = 1000, seed: int = 42, least: int = 3) -> DataFrame:
    """Mean with bootstrap bounds per group; NULL bounds under ``least`` rows (O-B09). Values are pooled before they are drawn."""
    pooled = df.filter(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value).cast("double"), 6).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    ship(df.sparkSession)
    dt = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        m, v = pdf["m"].to_numpy(), pdf["v"].to_numpy()
        n = int(m.sum())
        low = high = None
        if n >= least:
            b = np.random.default_rng(_seed(seed, *[pdf[c].iloc[0] for c in by])).multinomial(n, m / n, draws) @ v / n
            low, high = np.percentile(b, [2.5, 97.5])
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in by} | {"mean": [float(m @ v) / n], "low": [low], "high": [high], "n": [n]})

    return pooled.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {dt[c]}" for c in by), "mean double, low double, high double, n bigint"]))


def posterior_summary(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, 95 % interval, P(> 0) and the risk of a false sign of posterior draws (O-M21, O-R05)."""
    pos = F.avg((F.col(value) > 0).cast("double"))
    return draws.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), pos.alias("p_positive"), F.least(pos, 1 - pos).alias("false_sign_risk"))


def canonical_term(name: str) -> str:
    """One name for a model term, however an engine spells levels, references and interactions (O-M12):
    ``C(period)[T.post]`` becomes ``period=post``, factors of an interaction come in alphabetical order."""
    import re

    parts = []
    for p in re.split(r"\s*[:*]\s*(?![^\[]*\])", name.strip()):
        m = re.fullmatch(r"C?\(?(\w+?)(?:,.*)?\)?\[(?:T\.)?([^\]]+)\]", p)
        parts.append(f"{m[1]}={m[2]}" if m else p)
    return ":".join(sorted(parts)) if parts != ["(Intercept)"] and parts != ["Intercept"] else "intercept"
