"""Dense vectors: cosine, nearest neighbours, orthogonal alignment, drift (O-C06..C08, O-F27, O-L07)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL for a zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = 20_000) -> DataFrame:
    """(query, neighbour, similarity, rank): the k rows of ``base`` nearest to each query, itself excluded; of equally near ones the least ids.

    ``base`` is not moved: queries go in blocks of about ``block`` rows, each block is broadcast, and every task keeps the k best of its own rows for each
    query over all of its batches, so what is shuffled is k rows a query and task. The number of passes over ``base`` grows with the query set."""
    spark = base.sparkSession
    ship(spark)
    asked = queries.select(F.col(key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("q is not null and v is not null")
    n = max(1, -(-asked.count() // block))
    rows = base.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    schema = "query bigint, neighbour bigint, similarity double"
    scored = None
    for g in range(n):
        some = asked.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == g).collect()  # about ``block`` rows
        if not some:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["q"] for r in some], np.int64), _unit(np.array([r["v"] for r in some], float))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qi, q = sent.value
            best = np.full((len(qi), 0), -np.inf), np.zeros((len(qi), 0), np.int64)
            for b in batches:
                if b.num_rows:
                    order = np.argsort(b["id"].to_numpy(), kind="stable")
                    ids = b["id"].to_numpy()[order]
                    x = _unit(b["v"].flatten().to_numpy().reshape(b.num_rows, -1)[order])
                    near = [_best(q[i : i + 1024] @ x.T, ids, qi[i : i + 1024], k) for i in range(0, len(qi), 1024)]
                    s, j = (np.concatenate((a, np.vstack([t[c] for t in near])), 1) for c, a in enumerate(best))
                    top = np.lexsort((j, -s), axis=1)[:, :k]
                    best = np.take_along_axis(s, top, 1), np.take_along_axis(j, top, 1)
            s, j = best
            real = s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, real.sum(1))), pa.array(j[real]), pa.array(s[real])], names=["query", "neighbour", "similarity"])

        part = rows.mapInArrow(run, schema)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _best(s: np.ndarray, ids: np.ndarray, qi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k greatest similarities and their ids (which ascend), the least ids first among equal ones at the edge."""
    s[qi[:, None] == ids[None, :]] = -np.inf
    m = min(k, s.shape[1])
    at = np.argpartition(-s, m - 1, axis=1)[:, :m]
    edge = np.take_along_axis(s, at, 1).min(1)
    for i in np.flatnonzero((s >= edge[:, None]).sum(1) > m):
        over = np.flatnonzero(s[i] > edge[i])
        at[i] = np.concatenate((over, np.flatnonzero(s[i] == edge[i])[: m - len(over)]))
    return np.take_along_axis(s, at, 1), ids[at]


def procrustes(pairs: DataFrame, a: str, b: str) -> np.ndarray:
    """The orthogonal matrix that turns vectors ``a`` onto ``b`` best (O-C07): the sum of outer products is an aggregate of dimension squared
    numbers, its singular vectors are found on the driver."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = (np.array(batch.column(i).to_pylist(), float) for i in (0, 1))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not sums:
        return np.zeros((0, 0))
    m = np.zeros((max(r["i"] for r in sums) + 1, max(r["j"] for r in sums) + 1))
    for r in sums:
        m[r["i"], r["j"]] = r["s"]
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def rotated(v: Column, r: np.ndarray) -> Column:
    """A vector times the matrix, in Arrow batches."""

    def turn(batch: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, float) @ r for v in batch], index=batch.index, dtype=object)

    turn.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(turn, "array<double>")(v)


def drift(pairs: DataFrame, word: str, a: str, b: str) -> DataFrame:
    """1 - cosine of each word's two vectors and its percentile among all words (O-C08)."""
    d = pairs.select(word, (1 - cosine(F.col(a), F.col(b))).alias("drift")).filter("drift is not null")
    # percent of words with less drift, from counts per rounded value: the window runs over distinct values
    v = d.withColumn("drift", F.round("drift", 6)).groupBy("drift").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("drift").rowsBetween(Window.unboundedPreceding, -1)
    below = v.select("drift", (F.coalesce(F.sum("n").over(w), F.lit(0)) / F.sum("n").over(Window.partitionBy())).alias("percentile"))
    return d.withColumn("drift", F.round("drift", 6)).join(below, "drift").select(word, "drift", "percentile")


def train(sentences: DataFrame, words: str, size: int = 200, window: int = 8, least: int = 5, seed: int = 1) -> DataFrame:
    """(word, vector) by skip-gram (O-C06). Spark's trainer has no subword units: an approximation for rare inflected forms."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, inputCol=words, outputCol="_out").fit(sentences).getVectors()
