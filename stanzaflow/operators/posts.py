"""Posts cut into poems with the corrections that people and models made (O-G08, O-G09)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S


def segmented(posts: DataFrame, key: str, text: str, expected: str, overrides: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(key, expected, way, qc_ok, repaired, parts). ``overrides``: (key, starts array<int>), ``verdicts``: (key, count int, starts array<int>), one row a key; a post
    in both goes by its override. NULL starts in an override are an empty list."""
    df = posts.select(key, F.col(text).alias("_t"), F.col(expected).alias("_n"))
    none = F.lit(None)
    if overrides is not None:
        df = df.join(overrides.select(key, F.coalesce("starts", F.array().cast("array<int>")).alias("_o")), key, "left")
    if verdicts is not None:
        df = df.join(verdicts.select(key, F.col("count").alias("_c"), F.col("starts").alias("_s")), key, "left")
    df = df.withColumns({c: none.cast(t) for c, t in (("_o", "array<int>"), ("_c", "int"), ("_s", "array<int>")) if c not in df.columns})

    @F.pandas_udf("parts array<string>, way string, qc_ok boolean, repaired boolean, expected int")
    def cut(t: pd.Series, n: pd.Series, o: pd.Series, c: pd.Series, s: pd.Series) -> pd.DataFrame:
        given = lambda x: None if x is None else [int(i) for i in x]
        rows = [S.resolved(a, int(b), given(x), None if pd.isna(y) else (int(y), given(z))) for a, b, x, y, z in zip(t, n, o, c, s)]
        return pd.DataFrame(rows, columns=["parts", "way", "qc_ok", "repaired", "expected"])

    return df.select(key, cut("_t", "_n", "_o", "_c", "_s").alias("r")).select(key, "r.expected", "r.way", "r.qc_ok", "r.repaired", "r.parts")
