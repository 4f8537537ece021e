"""Cohorts: filters with audits, semi and anti joins, latest rows, rosters (O-P08, P09, P12..P15, P17, P23, P26, P27, J01..J10, U01..U07, A07, A15, A27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import text as T


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (O-U02): an aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """The newest row of each key (O-K06, O-J10, O-I06); ties go to the greatest tie columns."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *tie)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def merge_by_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which a later frame's row replaces an earlier one's (O-J10)."""
    every = frames[0].withColumn("_p", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.withColumn("_p", F.lit(k)), allowMissingColumns=True)
    return latest(every, keys, "_p", []).drop("_p")


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_anti")


def allowed_names(people: DataFrame, flag: str, names: list[str]) -> DataFrame:
    """Name keys of people marked public, over all their alias columns (O-U06)."""
    some = people.filter(E.public_flag(F.col(flag))).select(F.explode(F.array(*[T.name_key(F.col(n)) for n in names])).alias("name_key"))
    return some.filter("name_key <> ''").distinct()


def keep_names(df: DataFrame, author: str, allowed: DataFrame) -> DataFrame:
    """Rows whose author is allowed, by normalised name (O-J07, O-P09)."""
    return df.withColumn("name_key", T.name_key(F.col(author))).join(allowed.select("name_key"), "name_key", "left_semi").drop("name_key")


def without_repeats(poems: DataFrame, flags: DataFrame | None, key: str, repeat: str = "is_repeat", translation: str = "is_translation") -> DataFrame:
    """Repeats and translations out; flags from the table itself, else joined by key, else false (O-P12)."""
    if repeat not in poems.columns and flags is not None:
        one = flags.groupBy(key).agg(F.max(E.truthy(F.col(repeat))).alias(repeat), F.max(F.coalesce(F.col(translation), F.lit(False))).alias(translation))
        poems = poems.join(one, key, "left")
    for c in (repeat, translation):
        if c not in poems.columns:
            poems = poems.withColumn(c, F.lit(False))
    return poems.filter(~E.truthy(F.col(repeat)) & ~E.truthy(F.col(translation)))


def language_audit(df: DataFrame, key: str, language: str) -> tuple[DataFrame, DataFrame]:
    """(rows of eligible poems, dropped poems with reason): the poem's least non-NULL language decides (O-P14)."""
    poem = df.groupBy(key).agg(F.min(E.blank_to_null(F.col(language))).alias("language")).withColumn("reason", E.language_reason(F.col("language")))
    return keep_ids(df, poem.filter("reason = ''"), key), poem.filter("reason <> ''").select(key, "language", "reason")


def core_cohort(df: DataFrame, year: str = "year", flag: str | None = "qa_flag") -> DataFrame:
    """Rows of the two main periods, QA clean where a flag exists, with ``period3`` (O-P17)."""
    out = df.withColumn("period3", E.period_p1_p2(F.col(year))).filter(F.col("period3").isin(E.P1, E.P2))
    return out.filter(E.qa_bucket(F.col(flag)) == "OK") if flag and flag in df.columns else out


def passes_onset(df: DataFrame, author: str, year: str, latest_start: int = 2014) -> DataFrame:
    """Authors whose first year is at most ``latest_start`` (O-P08, O-W01); by join, so that a hot author needs no window."""
    start = df.filter(F.col(author).isNotNull()).groupBy(author).agg(F.min(year).alias("_start")).filter(F.col("_start") <= latest_start)
    return df.join(start.select(author), author, "left_semi")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a missing or unknown covariate (O-P26)."""
    keep = F.lit(True)
    for c in columns:
        v = F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
        keep = keep & ~v.isin("", "unknown", "nan")
    return df.filter(keep)


def model_gate(df: DataFrame, exposure: str, least: int = 5, roster: DataFrame | None = None) -> DataFrame:
    """Poems a model may use: main periods, enough counts, positive exposure, author on the roster (O-P23)."""
    out = df.filter(F.col("period3").isin(E.P1, E.P2) & (F.col("n_total") >= least) & (F.col(exposure) > 0))
    return keep_ids(out, roster, "author") if roster is not None else out


def leave_one_out(df: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """The rows once per variant without the variant's own key (O-P27); ``variants`` holds few rows and is named by ``variant``."""
    v = variants.select(F.col(key).alias("_out"), F.col("variant"))
    return df.join(v, F.col(key) != F.col("_out")).drop("_out")


def roster(poems: DataFrame, author: str, key: str, year: str, language: str, least: int = 5) -> DataFrame:
    """Author roster: poems per period, inclusion, dominant language per period (O-A07, O-A15, O-A27)."""
    p = poems.filter(F.col(author).isNotNull()).withColumn("period3", E.period_p1_p2(F.col(year))).filter(F.col("period3").isin(E.P1, E.P2))
    counts = p.groupBy(author, "period3", F.col(language).alias("lang")).agg(F.countDistinct(key).alias("n"))
    return _roster(counts, author, least)


def _roster(counts: DataFrame, author: str, least: int) -> DataFrame:
    n = lambda period: F.coalesce(F.sum(F.when(F.col("period3") == period, F.col("n"))), F.lit(0))
    # the most frequent language; ties go to the first in the alphabet
    top = lambda period: F.min_by(F.when(F.col("period3") == period, F.col("lang")), F.when((F.col("period3") == period) & F.col("lang").isNotNull(), F.struct(-F.col("n"), F.col("lang"))))
    out = counts.groupBy(author).agg(n(E.P1).alias("n_p1"), n(E.P2).alias("n_p2"), top(E.P1).alias("dominant_language_p1"), top(E.P2).alias("dominant_language_p2"))
    out = out.withColumn("min_per_period", F.least("n_p1", "n_p2")).withColumn("total", F.col("n_p1") + F.col("n_p2"))
    why = F.when(F.col("n_p1") == 0, "no_p1").when(F.col("n_p2") == 0, "no_p2").when(F.col("min_per_period") < least, "below_threshold").otherwise("")
    switch = F.coalesce(F.col("dominant_language_p1") != F.col("dominant_language_p2"), F.lit(False))
    return out.withColumn("exclusion_reason", why).withColumn("included", why == "").withColumn("is_bilingual_switcher", switch)


def union_lenient(frames: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Labelled union that tolerates missing columns (O-U01, O-S12)."""
    out = None
    for name, f in frames.items():
        g = f.withColumn(label, F.lit(name))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out


def longest_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key the longest value of each column; ties go to the first in order (O-U07)."""
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(-F.length(c), F.col(c)))).alias(c)
    return df.groupBy(key).agg(*[pick(c) for c in columns])


def ranked(df: DataFrame, part: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each part (O-L04, L05, L06): Spark limits each part before its shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(name) <= n)


def stripped_columns(df: DataFrame) -> DataFrame:
    """Column names without outer blanks (O-P33)."""
    return df.toDF(*[c.strip() for c in df.columns])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns added with a default; present ones stay as they are (O-P33)."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
