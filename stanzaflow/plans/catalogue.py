"""Query catalogue of the engine's own operators, each with its SQL where SQL can express it on whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import segment as S
from ..functions import text as T
from ..operators import cohort, colloc, counts, models, posts, qa, ranks, temporal, vectors
from ..session import materialise
from ..sources import io
from ..streaming import incremental
from .base import FOUR, POEM, SQL_A, SQL_P, SQL_PERIOD, SQL_PT, SQL_ST, SQL_TOK, annotations, poem_table, poem_texts, poems, stanzas, table, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = lambda c, n=6: F.round(c, n)
MAIN = ("Ukrainian", "Russian")


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# ---- rates, the flagship ----------------------------------------------------------------------------------------------------------

# the complementary error function in SQL, integrated by Simpson's rule
_ERFC = "(2 / sqrt(pi()) * 0.0035::DOUBLE / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x + 0.0035::DOUBLE * i, 2)))))"


def _strata(df: DataFrame) -> DataFrame:
    """Each row once per stratum it belongs to."""
    s = F.array_compact(F.array(*[F.when(E.stratum_keeps(F.col("language"), k), F.lit(k)) for k in E.STRATA]))
    return df.withColumn("stratum", F.explode(s))


def _cells_long(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"`{c}`").alias("k")) for c in FOUR])).alias("r")).select(*keep, "r.*")


def _rates(spark: SparkSession, sf_dir: str, exposure: str) -> DataFrame:
    long = _cells_long(_strata(poem_table(spark, sf_dir, *({exposure} - {"n_stanzas"}))), ["stratum", "author", "period3", exposure])
    rr = models.rate_ratio(long, ["stratum", "cell"], "k", exposure, "period3", E.P1, E.P2, "author")
    return ranks.bh(rr.withColumn("p", ranks.two_sided_p(F.try_divide("coef", "se"))), ["stratum"], tie=["cell"])


def _sql_rates(exposure: str) -> str:
    return f"""{SQL_PT}, s AS (SELECT * FROM pt, (VALUES ('pooled_Ukrainian_Russian'), ('Ukrainian'), ('Russian')) v(stratum) WHERE language IN ('Ukrainian', 'Russian') AND (stratum = language OR stratum LIKE 'pooled%')),
 l AS (SELECT stratum, author, period3, {exposure} AS e, unnest(['1sg','1pl','2sg','2pl']) AS cell, unnest(["1sg","1pl","2sg","2pl"]) AS k FROM s WHERE period3 <> 'unknown' AND {exposure} > 0),
 per AS (SELECT stratum, cell, author, coalesce(sum(k::DOUBLE) FILTER (period3 LIKE 'P1%'), 0) AS k1, coalesce(sum(k::DOUBLE) FILTER (period3 LIKE 'P2%'), 0) AS k2, coalesce(sum(e::DOUBLE) FILTER (period3 LIKE 'P1%'), 0) AS e1, coalesce(sum(e::DOUBLE) FILTER (period3 LIKE 'P2%'), 0) AS e2, count(*) AS r FROM l GROUP BY ALL),
 tot AS (SELECT stratum, cell, sum(k1) AS tk1, sum(k2) AS tk2, sum(e1) AS te1, sum(e2) AS te2, count(*) AS g, sum(r)::BIGINT AS n FROM per GROUP BY ALL),
 v AS (SELECT stratum, cell, sum(pow((k2 - e2 * tk2 / te2) / tk2 - (k1 - e1 * tk1 / te1) / tk1, 2)) AS v FROM per JOIN tot USING (stratum, cell) GROUP BY ALL),
 cr AS (SELECT *, ln((tk2 / te2) / (tk1 / te1)) AS coef, sqrt(v * g / (g - 1.0) * (n - 1.0) / (n - 2.0)) AS se FROM tot JOIN v USING (stratum, cell)),
 pv AS (SELECT *, {_ERFC} AS p FROM (SELECT *, abs(coef / se) / sqrt(2.0) AS x FROM cr)),
 bh AS (SELECT *, p * count(*) OVER (PARTITION BY stratum) / row_number() OVER (PARTITION BY stratum ORDER BY p, cell) AS raw FROM pv)"""


@query("WITH " + _sql_rates("n_stanzas") + " SELECT stratum, cell, round(tk1, 6) AS k_before, round(tk2, 6) AS k_after, round(te1, 6) AS exposure_before, round(te2, 6) AS exposure_after, n, g AS n_clusters, round(coef, 6) AS coef, round(exp(coef), 6) AS rate_ratio, round(se, 6) AS se, round(p, 6) AS p, round(least(1.0, min(raw) OVER (PARTITION BY stratum ORDER BY p, cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM bh")
def cell_rate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P01, O-P05, O-P15, O-A02, O-A19, O-M04, O-B01: rate ratio of each cell between the periods, with cluster errors and BH."""
    return _rounded(_rates(spark, sf_dir, "n_stanzas"))


@query(f"WITH st AS (WITH {_sql_rates('n_stanzas')} SELECT stratum, cell, exp(coef) AS rr FROM cr), tk AS (WITH {_sql_rates('n_tokens')} SELECT stratum, cell, exp(coef) AS rr FROM cr) SELECT stratum, cell, round(st.rr, 6) AS rr__stanzas, round(tk.rr, 6) AS rr__tokens FROM st JOIN tk USING (stratum, cell)")
def offset_comparison_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A30, O-P22, O-U01: the same ratios under two exposures, side by side."""
    both = cohort.union_lenient({k: _rates(spark, sf_dir, f"n_{k}").select("stratum", "cell", F.col("rate_ratio").alias("rr")) for k in ("stanzas", "tokens")}, "exposure")
    return _rounded(counts.wide_results(both, ["stratum", "cell"], "exposure", ["stanzas", "tokens"], ["rr"]))


@query(f'WITH {SQL_PT} SELECT poem_id, "1sg", "1pl", "2sg", "2pl", n_total, author, language, n_stanzas, n_tokens, period3 FROM pt')
def poem_cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A02..A04, O-J01, O-F06: cell counts, exposures and metadata per poem."""
    return poem_table(spark, sf_dir, "n_tokens").select("poem_id", *[F.col(f"`{c}`") for c in FOUR], "n_total", "author", "language", "n_stanzas", "n_tokens", "period3")


@query(f"WITH {SQL_ST}, e AS (SELECT poem_id, stanza_index, len(regexp_extract_all(stanza, '[^{T.SPACE}]+'))::BIGINT AS n FROM st) SELECT poem_id, count(*) AS exposure_n_stanzas, max(stanza_index) AS exposure_n_stanza_index_max, sum(n)::BIGINT AS exposure_n_tokens, min(n) AS min_tokens, max(n) AS max_tokens, count(*) <> max(stanza_index) AS has_index_gap FROM e GROUP BY poem_id")
def stanza_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A05, O-A06, O-G03: tokens per stanza, then per poem."""
    return _rounded(counts.stanza_exposure(stanzas(spark, sf_dir), text="stanza"))


@query(f"""WITH {SQL_PT} SELECT author, period3, sum("1sg")::BIGINT AS k, sum(n_stanzas)::BIGINT AS exposure, round(sum("1sg") / nullif(sum(n_stanzas), 0), 6) AS rate FROM pt WHERE author IS NOT NULL GROUP BY ALL""")
def author_period_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A19, O-A20."""
    return _rounded(counts.rate_per(poem_table(spark, sf_dir).filter("author is not null"), ["author", "period3"], "1sg", "n_stanzas"))


@query(f"""WITH {SQL_PT}, f AS (SELECT author, period3, sum("1sg")::DOUBLE AS K, sum(n_stanzas)::DOUBLE AS E FROM pt WHERE author IS NOT NULL AND period3 <> 'unknown' AND n_stanzas > 0 GROUP BY ALL),
 v AS (SELECT author, period3, max(K) AS K, max(E) AS E, sum(CASE WHEN n_stanzas * K / E < K THEN pow(("1sg" - n_stanzas * K / E) / (1 - n_stanzas / E), 2) ELSE 0.0 END) AS m FROM pt JOIN f USING (author, period3) WHERE K > 0 AND E > 0 AND n_stanzas > 0 GROUP BY ALL),
 w AS (SELECT author, max(K) FILTER (period3 LIKE 'P1%') AS K1, max(E) FILTER (period3 LIKE 'P1%') AS E1, max(m) FILTER (period3 LIKE 'P1%') AS m1, max(K) FILTER (period3 LIKE 'P2%') AS K2, max(E) FILTER (period3 LIKE 'P2%') AS E2, max(m) FILTER (period3 LIKE 'P2%') AS m2 FROM v GROUP BY author)
 SELECT author, round(ln((K2 / E2) / (K1 / E1)), 6) AS shift, round(sqrt(m1 / (K1 * K1) + m2 / (K2 * K2)), 6) AS se, K1::BIGINT AS k_before, K2::BIGINT AS k_after FROM w WHERE K1 IS NOT NULL AND K2 IS NOT NULL""")
def author_fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M07: within-author log rate shifts, HC3."""
    return _rounded(models.author_shifts(poem_table(spark, sf_dir).filter("author is not null"), "author", "1sg", "n_stanzas", "period3", E.P1, E.P2))


_SQL_LOGIT = f"""{SQL_PT}, w AS (SELECT author, coalesce(sum("1sg") FILTER (period3 LIKE 'P1%'), 0)::DOUBLE AS k1, coalesce(sum("1sg" + "1pl") FILTER (period3 LIKE 'P1%'), 0)::DOUBLE AS n1, coalesce(sum("1sg") FILTER (period3 LIKE 'P2%'), 0)::DOUBLE AS k2, coalesce(sum("1sg" + "1pl") FILTER (period3 LIKE 'P2%'), 0)::DOUBLE AS n2 FROM pt WHERE author IS NOT NULL GROUP BY author),
 x AS (SELECT *, (k1 = 0 OR k2 = 0 OR k1 = n1 OR k2 = n2) AS corrected, CASE WHEN k1 = 0 OR k2 = 0 OR k1 = n1 OR k2 = n2 THEN 0.5 ELSE 0.0 END AS h FROM w WHERE n1 > 0 AND n2 > 0),
 sh AS (SELECT author, ln(((k2 + h) / (n2 - k2 + h)) / ((k1 + h) / (n1 - k1 + h))) AS shift, sqrt(1 / (k1 + h) + 1 / (n1 - k1 + h) + 1 / (k2 + h) + 1 / (n2 - k2 + h)) AS se, corrected FROM x)"""


def _logit_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = poem_table(spark, sf_dir).filter("author is not null").withColumn("n1p", F.col("`1sg`") + F.col("`1pl`"))
    return models.logit_shifts(t, "author", "1sg", "n1p", "period3", E.P1, E.P2)


@query(f"WITH {_SQL_LOGIT} SELECT author, round(shift, 6) AS shift, round(se, 6) AS se, corrected FROM sh")
def author_logit_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M08, O-B08."""
    return _rounded(_logit_shifts(spark, sf_dir))


@query(f"""WITH {_SQL_LOGIT}, t AS (SELECT sum(1 / (se * se)) AS sw, sum(shift / (se * se)) AS swy, sum(shift * shift / (se * se)) AS swyy, sum(1 / pow(se, 4)) AS sww, count(*) AS m FROM sh),
 g AS (SELECT greatest(0.0, ((swyy - swy * swy / sw) - (m - 1)) / (sw - sww / sw)) AS tau2, swy / sw AS mu FROM t) SELECT author, round(mu + tau2 / (tau2 + se * se) * (shift - mu), 5) AS posterior_mean, round(sqrt(tau2 / (tau2 + se * se)) * se, 5) AS posterior_sd FROM sh, g""")
def shrunken_author_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M20, as empirical Bayes: declared substitute for the sampled hierarchy."""
    return _rounded(models.shrunk(_logit_shifts(spark, sf_dir), []).select("author", "posterior_mean", "posterior_sd"), 5)


# ---- cohorts, joins, set operations ----------------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_P}, f AS (SELECT poem_id, bool_or(coalesce(lower(trim("Is repeat")) IN ('true', '1', 'yes', 'y'), false)) AS r, bool_or(coalesce(trim("Original language (if post is a translation)") <> '' AND lower(trim("Original language (if post is a translation)")) <> 'nan', false)) AS t FROM layer0_poems_one_per_row GROUP BY poem_id)
 SELECT p.poem_id, author, language FROM p LEFT JOIN f USING (poem_id) WHERE NOT coalesce(r, false) AND NOT coalesce(t, false)""")
def repeat_filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P07, O-P11, O-P12: repeats and translations out, flags from the layer-0 table."""
    flags = table(spark, sf_dir, "layer0_poems_one_per_row").select("poem_id", F.col("Is repeat").alias("is_repeat"), E.is_translation(F.col("Original language (if post is a translation)")).alias("is_translation"))
    return cohort.without_repeats(poems(spark, sf_dir, "poem_id", "author", "language"), flags, "poem_id").select("poem_id", "author", "language")


@query(f"""WITH {SQL_P}, l AS (SELECT poem_id, min(CASE WHEN language = '' OR lower(language) = 'nan' THEN NULL ELSE language END) AS language FROM p GROUP BY poem_id), r AS (SELECT *, CASE WHEN language IS NULL THEN 'empty_language' WHEN contains(language, ',') THEN 'mixed_language_comma' WHEN language IN ('Crimean Tatar', 'Qirimli', 'Crimean Tatar (Qirimli)') THEN 'crimean_tatar_or_qirimli_family'
 WHEN language IN ('English', 'Hebrew', 'Polish', 'Spanish', 'French', 'German', 'Italian') THEN 'excluded_small_language_exact' WHEN language NOT IN ('Ukrainian', 'Russian') THEN 'outside_pool_Ukrainian_Russian:' || language ELSE '' END AS reason FROM l) SELECT poem_id, language, reason FROM r WHERE reason <> ''""")
def language_eligibility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P13, O-P14: dropped poems with reasons."""
    return cohort.language_audit(poems(spark, sf_dir, "poem_id", "language"), "poem_id", "language")[1]


@query(f"""WITH {SQL_P}, al AS (SELECT DISTINCT lower(trim(regexp_replace(author, '[{T.SPACE}]+', ' ', 'g'))) AS k FROM author_covariates WHERE coalesce(lower(trim(bilingual_switcher_corpus)) IN ('true', '1', 'yes', 'y'), false)) SELECT poem_id, author FROM p WHERE lower(trim(regexp_replace(author, '[{T.SPACE}]+', ' ', 'g'))) IN (SELECT k FROM al)""")
def allowlist_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P09, O-P10, O-J06, O-J07, O-U06, O-F04: poems of listed authors by normalised name."""
    listed = cohort.allowed_names(table(spark, sf_dir, "author_covariates"), "bilingual_switcher_corpus", ["author"])
    return cohort.keep_names(poems(spark, sf_dir, "poem_id", "author"), "author", listed).select("poem_id", "author")


@query(f"WITH {SQL_P} SELECT poem_id FROM p WHERE poem_id NOT IN (SELECT poem_id FROM annotations WHERE poem_id IS NOT NULL)")
def checkpoint_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J08, O-I01, O-U05: poems not annotated yet."""
    return cohort.drop_ids(poems(spark, sf_dir, "poem_id"), table(spark, sf_dir, "annotations"), "poem_id")


@query("SELECT annotator, poem_id, arg_max(perspective_primary, (created_at, id, perspective_primary)) AS perspective_primary FROM (SELECT lower(trim(annotator_id)) AS annotator, * FROM poem_perspectives) GROUP BY ALL")
def latest_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J10, O-K06, O-I06: current judgment of each annotator and poem."""
    v = table(spark, sf_dir, "poem_perspectives").select(F.lower(F.trim("annotator_id")).alias("annotator"), "poem_id", "created_at", "id", "perspective_primary")
    return cohort.latest(v, ["annotator", "poem_id"], "created_at", ["id", "perspective_primary"]).select("annotator", "poem_id", "perspective_primary")


@query(f"""WITH {SQL_P}, x AS (SELECT author, pr, language, count(DISTINCT poem_id) AS n FROM (SELECT *, {SQL_PERIOD} AS pr FROM p) WHERE author IS NOT NULL AND pr <> 'unknown' GROUP BY author, pr, language),
 d AS (SELECT author, pr, arg_min(language, (-n, language)) AS top FROM x WHERE language IS NOT NULL GROUP BY ALL), g AS (SELECT author, coalesce(sum(n) FILTER (pr LIKE 'P1%'), 0)::BIGINT AS n_p1, coalesce(sum(n) FILTER (pr LIKE 'P2%'), 0)::BIGINT AS n_p2 FROM x GROUP BY author)
 SELECT g.author, n_p1, n_p2, least(n_p1, n_p2) AS min_per_period, n_p1 + n_p2 AS total, least(n_p1, n_p2) >= 5 AS included, CASE WHEN n_p1 = 0 THEN 'no_p1' WHEN n_p2 = 0 THEN 'no_p2' WHEN least(n_p1, n_p2) < 5 THEN 'below_threshold' ELSE '' END AS exclusion_reason,
 d1.top AS dominant_language_p1, d2.top AS dominant_language_p2, coalesce(d1.top <> d2.top, false) AS is_bilingual_switcher FROM g LEFT JOIN d d1 ON d1.author = g.author AND d1.pr LIKE 'P1%' LEFT JOIN d d2 ON d2.author = g.author AND d2.pr LIKE 'P2%'""")
def author_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A07, O-A15, O-A27: roster with reasons."""
    return cohort.roster(poems(spark, sf_dir, *POEM), "author", "poem_id", "year", "language")


@query(f"WITH {SQL_P}, o AS (SELECT author FROM p WHERE author IS NOT NULL GROUP BY author HAVING min(year) <= 2014) SELECT poem_id, author, year::BIGINT AS year FROM p WHERE author IN (SELECT author FROM o)")
def onset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P08, O-W01."""
    return _rounded(cohort.passes_onset(poems(spark, sf_dir, "poem_id", "author", "year"), "author", "year").select("poem_id", "author", "year"))


@query(f"""WITH {SQL_P} SELECT poem_id, CASE WHEN year IS NOT NULL THEN {SQL_PERIOD} WHEN trim(temporal_period) <> '' THEN trim(temporal_period) ELSE 'unknown' END AS period, CASE WHEN year IS NULL THEN 'unknown' WHEN year < 2014 THEN 'pre_2014' WHEN year < 2022 THEN '2014_2021' ELSE 'post_2022' END AS period_three FROM p""")
def period_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P05, O-P06, O-P19."""
    return poems(spark, sf_dir, "poem_id", "year", "temporal_period").select("poem_id", E.reconciled_period(F.col("year"), F.col("temporal_period")).alias("period"), E.period_three(F.col("year")).alias("period_three"))


@query("""SELECT author, CASE WHEN trim(coalesce(gender, '')) IN ('f', 'm', 'nb') THEN trim(gender) ELSE '' END AS gender, CASE WHEN trim(coalesce(generation_cohort, '')) IN ('soviet', 'transition', 'independence') THEN trim(generation_cohort) ELSE '' END AS generation_cohort,
 (lower(trim(coalesce(gender, ''))) NOT IN ('', 'unknown', 'nan') AND lower(trim(coalesce(generation_cohort, ''))) NOT IN ('', 'unknown', 'nan')) AS complete FROM author_covariates""")
def covariate_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P26, O-P34: values outside the vocabulary become blank."""
    c = table(spark, sf_dir, "author_covariates")
    ok = F.lit(True)
    for x in ("gender", "generation_cohort"):
        ok = ok & ~F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("", "unknown", "nan")
    return c.select("author", E.vocabulary(F.col("gender"), ["f", "m", "nb"]).alias("gender"), E.vocabulary(F.col("generation_cohort"), ["soviet", "transition", "independence"]).alias("generation_cohort"), ok.alias("complete"))


@query(f"""WITH {SQL_PT} SELECT c.gender, period3, count(*) AS n_poems, round(avg("1sg" / n_total), 6) AS mean_share FROM pt LEFT JOIN author_covariates c USING (author) WHERE n_total > 0 GROUP BY ALL""")
def covariate_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J03, O-A23: mean shares by a small author dimension."""
    t = poem_table(spark, sf_dir).filter("n_total > 0").withColumn("share", F.col("`1sg`") / F.col("n_total"))
    return _rounded(t.join(table(spark, sf_dir, "author_covariates").select("author", "gender"), "author", "left").groupBy("gender", "period3").agg(F.count(F.lit(1)).alias("n_poems"), F.avg("share").alias("mean_share")))


# ---- modes, crosstabs, quantiles ---------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_A}, c AS (SELECT poem_id, sentence_id, trim(num) AS v, count(*) AS n FROM a WHERE num IS NOT NULL AND trim(num) <> '' GROUP BY ALL) SELECT poem_id, sentence_id, arg_min(v, (-n, CASE v WHEN 'Plural' THEN 1 WHEN 'Singular' THEN 2 ELSE 3 END, v)) AS mode, max(n) AS n_mode, sum(n)::BIGINT AS n FROM c GROUP BY ALL")
def modal_category_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A11, O-A12: modal number per sentence, ties by preference."""
    return counts.mode_with_order(annotations(spark, sf_dir, "poem_id", "sentence_id", "num"), ["poem_id", "sentence_id"], "num", ["Plural", "Singular"])


@query(f"""WITH {SQL_A}, c AS (SELECT poem_id, cell, count(*) AS n FROM a WHERE cell <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY poem_id ORDER BY n DESC, list_position(['1sg','1pl','2sg','2pl','3sg','3pl'], cell)) AS k, sum(n) OVER (PARTITION BY poem_id) AS t FROM c)
 SELECT poem_id, max(cell) FILTER (k = 1) AS "primary", max(cell) FILTER (k = 2 AND n / t >= 0.3) AS secondary, round(max(n / t) FILTER (k = 1), 6) AS confidence, max(t)::BIGINT AS n FROM r GROUP BY poem_id""")
def primary_secondary_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A13, O-A14."""
    return _rounded(counts.top_two(annotations(spark, sf_dir, "poem_id", "cell").filter("cell <> ''"), "poem_id", "cell", list(E.SIX_CELLS)))


@query(f"WITH {SQL_TOK}, c AS (SELECT person, language, count(*) AS n FROM tok WHERE person IS NOT NULL AND language IS NOT NULL GROUP BY ALL) SELECT person, language, n, round(100.0 * n / sum(n) OVER (PARTITION BY language), 6) AS pct FROM c")
def crosstab_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A16, O-A01."""
    return _rounded(counts.crosstab(tokens(spark, sf_dir, ("person",), ("language",)), "person", "language"))


@query(f"WITH {SQL_TOK}, g AS (SELECT * FROM (SELECT unnest(['1sg','1pl','2sg','2pl','3sg','3pl']) AS cell), (SELECT DISTINCT year::BIGINT AS year FROM tok WHERE year IS NOT NULL)), c AS (SELECT year::BIGINT AS year, cell, count(*) AS n FROM tok GROUP BY ALL) SELECT year, cell, coalesce(n, 0)::BIGINT AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY year), 6) AS pct FROM g LEFT JOIN c USING (year, cell)")
def interval_pct_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A17, O-J18: yearly percentages with zeros where a cell is absent."""
    from pyspark.sql import Window

    t = tokens(spark, sf_dir, ("cell",), ("year",)).filter("year is not null").withColumn("year", F.col("year").cast("bigint"))
    n = t.groupBy("cell", "year").agg(F.count(F.lit(1)).alias("n"))
    cells = spark.createDataFrame([(c,) for c in E.SIX_CELLS], "cell string")
    d = counts.dense(n, cells, t.select("year"), ["n"])
    return _rounded(d.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("year"))))


_WILSON = "100 * greatest(0.0, (k / n + z * z / (2 * n) - z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n)) / (1 + z * z / n))"


@query(f"WITH {SQL_TOK}, c AS (SELECT language, period3, coalesce(sum(is_dropped::INT), 0)::BIGINT AS k, count(*) AS n FROM tok GROUP BY ALL) SELECT language, period3, k, n, round(100.0 * k / n, 6) AS pct, round({_WILSON}, 6) AS wilson_low_pct FROM c, (SELECT 1.959963984540054 AS z)")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M01, O-A08, O-A18: share of dropped pronouns with its lower bound."""
    return _rounded(counts.share_table(tokens(spark, sf_dir, ("is_dropped",), ("language", "period3")), ["language", "period3"], F.col("is_dropped")))


@query(f"""WITH {SQL_PT}, x AS (SELECT period3, "1sg" / n_total AS s FROM pt WHERE n_total > 0) SELECT period3, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.75), 6) AS p75, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(avg((s = 0)::INT), 6) AS share_zero, round(avg((s = 1)::INT), 6) AS share_one, count(s) AS n FROM x GROUP BY period3""")
def exposure_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A09, O-A10."""
    t = poem_table(spark, sf_dir).filter("n_total > 0").withColumn("share", F.col("`1sg`") / F.col("n_total"))
    return _rounded(counts.quantiles(t, ["period3"], "share"))


_FOUR_CODES = {"1sg": (0, 0), "1pl": (0, 1), "2sg": (1, 0), "2pl": (1, 1)}
_SQL_LONG = f"""{SQL_PT}, lg AS (SELECT poem_id, author, period3, unnest(['1sg','1pl','2sg','2pl']) AS cell, unnest([0,0,1,1])::BIGINT AS person, unnest([0,1,0,1])::BIGINT AS number, unnest(["1sg","1pl","2sg","2pl"]) AS k, n_total AS n FROM pt WHERE n_total > 0)"""


@query(f"WITH {_SQL_LONG} SELECT poem_id, author, period3, cell, person, number, k, n, round(k / n, 6) AS y FROM lg")
def long_four_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R01, O-P24, D9."""
    return _rounded(counts.long_cells(poem_table(spark, sf_dir), _FOUR_CODES, ["poem_id", "author", "period3"]))


@query(f"WITH {_SQL_LONG} SELECT cell, period3, y::BIGINT AS y, count(*) AS n FROM (SELECT cell, period3, unnest(list_concat(list_transform(range(k), lambda x: 1), list_transform(range(n - k), lambda x: 0))) AS y FROM lg) GROUP BY ALL")
def trial_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R03, D10: a row per trial, counted."""
    t = counts.trials(counts.long_cells(poem_table(spark, sf_dir), _FOUR_CODES, ["poem_id", "period3"]), ["cell", "period3"])
    return _rounded(t.groupBy("cell", "period3", "y").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {SQL_PT} SELECT poem_id, "1sg" + "1pl" AS first_k, n_total AS first_n, round(("1sg" + "1pl") / nullif(n_total, 0), 6) AS first_p, "1pl" AS we_k, "1sg" + "1pl" AS we_n, round("1pl" / nullif("1sg" + "1pl", 0), 6) AS we_p FROM pt""")
def ratio_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11, O-F25, O-F31, O-A03."""
    return _rounded(counts.ratios(poem_table(spark, sf_dir), "poem_id", {"first": (["1sg", "1pl"], list(FOUR)), "we": (["1pl"], ["1sg", "1pl"])}))


@query(f"""WITH {SQL_PT} SELECT period3, count(*) AS n_start, count(*) FILTER (language IN ('Ukrainian', 'Russian')) AS n_language, count(*) FILTER (language IN ('Ukrainian', 'Russian') AND n_total >= 5) AS n_enough, count(*) FILTER (language IN ('Ukrainian', 'Russian') AND n_total >= 5 AND author IS NOT NULL) AS n_author FROM pt GROUP BY period3""")
def exclusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P23, O-P25, O-Q09: rows left after each gate."""
    gates = {"language": F.col("language").isin(*MAIN), "enough": F.col("n_total") >= 5, "author": F.col("author").isNotNull()}
    return qa.exclusion_audit(poem_table(spark, sf_dir), ["period3"], gates)


@query(f"""WITH {SQL_P}, c AS (SELECT author AS label, count(*) AS n FROM p WHERE author IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM c ORDER BY n DESC, label LIMIT 5), al AS (SELECT sum(n) AS a FROM c), u AS (SELECT * FROM t UNION ALL SELECT 'top_combined', sum(n) FROM t UNION ALL SELECT 'rest', max(a) - sum(n) FROM t, al) SELECT label, n::BIGINT AS n, round(100.0 * n / a, 6) AS pct FROM u, al""")
def top_authors_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A26, O-A29, O-L03: a top-five report."""
    return _rounded(counts.top_share(poems(spark, sf_dir, "poem_id", "author"), "author"))


@query(f"WITH {SQL_A} SELECT lemma, person, num, count(*) AS n, count(DISTINCT poem_id) AS n_poems FROM a WHERE lemma IS NOT NULL GROUP BY ALL")
def lemma_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A28."""
    return annotations(spark, sf_dir, "poem_id", "lemma", "person", "num").filter("lemma is not null").groupBy("lemma", "person", "num").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("poem_id").alias("n_poems"))


@query(f"WITH {SQL_TOK} SELECT 'annotations' AS key, count(*)::BIGINT AS value FROM tok UNION ALL SELECT 'poems', count(DISTINCT poem_id) FROM tok UNION ALL SELECT 'authors', count(DISTINCT author) FROM tok UNION ALL SELECT 'annotators', count(DISTINCT annotator) FROM tok UNION ALL SELECT 'sentences', count(DISTINCT (poem_id, sentence_id)) FROM tok")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A25."""
    one = tokens(spark, sf_dir, ("annotator", "sentence_id"), ("author",)).agg(F.count(F.lit(1)).alias("annotations"), F.countDistinct("poem_id").alias("poems"), F.countDistinct("author").alias("authors"), F.countDistinct("annotator").alias("annotators"), F.countDistinct(F.struct("poem_id", "sentence_id")).alias("sentences"))
    return one.unpivot([], one.columns, "key", "value")


# ---- ranks and multiplicity --------------------------------------------------------------------------------------------------------------


_SQL_TESTS = f"""{SQL_PT}, x AS (SELECT language, period3, unnest(['1sg','1pl','2sg','2pl']) AS feature, unnest(["1sg","1pl","2sg","2pl"]) / n_total AS v FROM pt WHERE n_total > 0 AND period3 <> 'unknown' AND language IN ('Ukrainian', 'Russian')),
 cv AS (SELECT language, feature, v, count(*) FILTER (period3 LIKE 'P1%') AS a, count(*) AS m FROM x GROUP BY ALL), r AS (SELECT *, sum(m) OVER (PARTITION BY language, feature ORDER BY v) - m + (m + 1) / 2.0 AS rk FROM cv),
 s AS (SELECT language, feature, sum(a * rk)::DOUBLE AS r1, sum(a)::DOUBLE AS n1, (sum(m) - sum(a))::DOUBLE AS n2, sum(m::DOUBLE * m * m - m) AS ties FROM r GROUP BY ALL),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM s), z AS (SELECT *, CASE WHEN var > 0 THEN greatest(0.0, abs(u - n1 * n2 / 2.0) - 0.5) / sqrt(var) END AS z FROM u),
 tp AS (SELECT *, {_ERFC} AS p FROM (SELECT *, abs(z) / sqrt(2.0) AS x FROM z))"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = poem_table(spark, sf_dir).filter((F.col("n_total") > 0) & F.col("language").isin(*MAIN))
    long = _cells_long(t, ["language", "period3", "n_total"]).withColumn("v", F.col("k") / F.col("n_total")).withColumnRenamed("cell", "feature")
    return ranks.mann_whitney(long, ["language", "feature"], "v", "period3", E.P1, E.P2)


@query(f"WITH {_SQL_TESTS} SELECT language, feature, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p FROM tp")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M02, O-W08."""
    return _rounded(_tests(spark, sf_dir))


@query(f"WITH {_SQL_TESTS}, w AS (SELECT *, p * count(*) OVER (PARTITION BY language) / row_number() OVER (PARTITION BY language ORDER BY p, feature) AS raw FROM tp) SELECT language, feature, round(p, 6) AS p, round(least(1.0, min(raw) OVER (PARTITION BY language ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM w")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B01, O-W05, O-B04."""
    return _rounded(ranks.bh(_tests(spark, sf_dir), ["language"], tie=["feature"]).select("language", "feature", "p", "q"))


@query(f"WITH {_SQL_TESTS}, w AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY language) - row_number() OVER (PARTITION BY language ORDER BY p, feature) + 1)) AS raw FROM tp) SELECT language, feature, round(p, 6) AS p, round(max(raw) OVER (PARTITION BY language ORDER BY p, feature ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM w")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B02, O-W06, O-W07."""
    return _rounded(ranks.holm(_tests(spark, sf_dir), ["language"], tie=["feature"]).select("language", "feature", "p", "p_holm"))


@query(f"""WITH {SQL_PT}, s AS (SELECT language, count(n_tokens) FILTER (period3 LIKE 'P1%') AS n1, avg(n_tokens) FILTER (period3 LIKE 'P1%') AS m1, var_samp(n_tokens) FILTER (period3 LIKE 'P1%') AS v1, count(n_tokens) FILTER (period3 LIKE 'P2%') AS n2, avg(n_tokens) FILTER (period3 LIKE 'P2%') AS m2, var_samp(n_tokens) FILTER (period3 LIKE 'P2%') AS v2 FROM pt GROUP BY language)
 SELECT language, n1, n2, CASE WHEN n1 > 1 AND n2 > 1 AND ((n1 - 1) * v1 + (n2 - 1) * v2) > 0 THEN round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) END AS cohens_d FROM s""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M03."""
    return _rounded(ranks.cohens_d(poem_table(spark, sf_dir, "n_tokens"), ["language"], "n_tokens", "period3", E.P1, E.P2))


_SQL_LOT = "('0x' || substr(md5('42|' || {}), 1, 8))::BIGINT"


@query(f"WITH {SQL_PT} SELECT poem_id, language, period3 FROM pt QUALIFY row_number() OVER (PARTITION BY language, period3 ORDER BY {_SQL_LOT.format('poem_id')}, poem_id) <= 10")
def stratified_sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-L08..L11: ten poems of each language and period by seeded hash, a sampling operator."""
    t = poem_table(spark, sf_dir).select("poem_id", "language", "period3")
    return ranks.quota_sample(t, ["language", "period3"], "poem_id", 10)


@query(f"WITH {SQL_P} SELECT poem_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT poem_id, {_SQL_LOT.format('poem_id')} / 4294967296.0 AS u FROM p)")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-L12."""
    return ranks.split(poems(spark, sf_dir, "poem_id"), "poem_id")


@query()
def romano_wolf_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B03."""
    return models.romano_wolf(_tests(spark, sf_dir).drop("p"), ["language"], "z", "feature")


def _sql_wild(rows: str, by: str, keep: str, link: str, error: str) -> str:
    """``rows``: (by, g, post, k, n). ``keep``, ``link`` and ``error`` are written with {y} or {s} and {n}."""
    k, m = keep.format(y="k"), keep.format(y="(2 * n * tk / tn - k)")
    at = lambda e, s, n: e.format(s=s, n=n)
    t = lambda a, b: f"({at(link, b, 'n2')} - {at(link, a, 'n1')}) / sqrt({at(error, a, 'n1')} + {at(error, b, 'n2')})"
    return f"""WITH {rows}, tt AS (SELECT {by}, post, sum(k) AS tk, sum(n) AS tn FROM l GROUP BY ALL), sm AS (SELECT {by}, g, post, sum({k}) AS p, sum({m}) AS m FROM l JOIN tt USING ({by}, post) GROUP BY ALL),
 per AS (SELECT {by}, g, coalesce(max(p) FILTER (NOT post), 0) AS p1, coalesce(max(m) FILTER (NOT post), 0) AS m1, coalesce(max(p) FILTER (post), 0) AS p2, coalesce(max(m) FILTER (post), 0) AS m2 FROM sm GROUP BY ALL),
 wh AS (SELECT {by}, max(tk) FILTER (NOT post) AS k1, max(tn) FILTER (NOT post) AS n1, max(tk) FILTER (post) AS k2, max(tn) FILTER (post) AS n2 FROM tt GROUP BY ALL), ob AS (SELECT *, {at(link, 'k2', 'n2')} - {at(link, 'k1', 'n1')} AS coef, {t('k1', 'k2')} AS t FROM wh),
 sg AS (SELECT g, d, ('0x' || substr(md5('42|' || g || '|' || d), 1, 8))::BIGINT < 2147483648 AS up FROM (SELECT DISTINCT g FROM per), range(1, 2000) r(d)),
 dr AS (SELECT {by}, d, sum(CASE WHEN up THEN p1 ELSE m1 END) AS s1, sum(CASE WHEN up THEN p2 ELSE m2 END) AS s2 FROM per JOIN sg USING (g) GROUP BY ALL)
 SELECT {by}, round(any_value(coef), 6) AS coef, round(any_value(t), 6) AS t, round((count(*) FILTER (abs({t('s1', 's2')}) >= abs(t) - 1e-9) + 1) / (count(*) + 1), 6) AS p_wild, count(*) AS draws, count(*) FILTER (abs({t('s1', 's2')}) >= abs(t) - 1e-9) AS extreme FROM dr JOIN ob USING ({by}) GROUP BY ALL"""


_SQL_STRATA = f"""{SQL_PT}, s AS (SELECT * FROM pt, (VALUES ('pooled_Ukrainian_Russian'), ('Ukrainian'), ('Russian')) v(stratum) WHERE language IN ('Ukrainian', 'Russian') AND (stratum = language OR stratum LIKE 'pooled%') AND period3 <> 'unknown' AND author IS NOT NULL)"""


@query(_sql_wild(f"""{_SQL_STRATA}, l AS (SELECT stratum, unnest(['1sg','1pl','2sg','2pl']) AS cell, author AS g, period3 LIKE 'P2%' AS post, unnest(["1sg","1pl","2sg","2pl"])::DOUBLE AS k, n_stanzas::DOUBLE AS n FROM s WHERE n_stanzas > 0)""", "stratum, cell", "greatest({y}, 1e-8)", "ln({s} / {n})", "1 / {s}"))
def wild_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B05, O-B10: studentised wild bootstrap of each cell's rate ratio."""
    t = _cells_long(_strata(poem_table(spark, sf_dir)), ["stratum", "author", "period3", "n_stanzas"])
    return _rounded(models.wild_bootstrap(t, ["stratum", "cell"], "k", "n_stanzas", "period3", E.P1, E.P2, "author"))


@query(_sql_wild(f"""{_SQL_STRATA}, l AS (SELECT * FROM (SELECT stratum, unnest(['first', 'second', 'overall']) AS ratio, author AS g, period3 LIKE 'P2%' AS post, unnest(["1pl", "2pl", "1pl" + "2pl"])::DOUBLE AS k, unnest(["1sg" + "1pl", "2sg" + "2pl", n_total])::DOUBLE AS n FROM s) WHERE n > 0)""", "stratum, ratio", "n * greatest(1e-6, least(1 - 1e-6, {y} / n))", "ln({s} / ({n} - {s}))", "1 / ({s} * (1 - {s} / {n}))"))
def wild_ratio_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B06, O-B10: the same for the plural's share of first, second and both persons, binomial."""
    c = lambda x: F.col(f"`{x}`")
    kinds = F.array(*[F.struct(F.lit(r).alias("ratio"), k.alias("k"), n.alias("n")) for r, k, n in (("first", c("1pl"), c("1sg") + c("1pl")), ("second", c("2pl"), c("2sg") + c("2pl")), ("overall", c("1pl") + c("2pl"), c("n_total")))])
    t = _strata(poem_table(spark, sf_dir)).select("stratum", "author", "period3", F.explode(kinds).alias("r")).select("stratum", "author", "period3", "r.*")
    return _rounded(models.wild_bootstrap(t, ["stratum", "ratio"], "k", "n", "period3", E.P1, E.P2, "author", "binomial"))


@query(f"WITH {_sql_rates('n_stanzas')}, b AS (SELECT stratum, cell, coef, se, sqrt(1 / tk1 + 1 / tk2) AS se0 FROM cr), cx AS (SELECT *, {_ERFC} AS p FROM (SELECT *, abs(coef / se0) / sqrt(2.0) AS x FROM b)), rx AS (SELECT stratum, cell, p, p * count(*) OVER (PARTITION BY stratum) / row_number() OVER (PARTITION BY stratum ORDER BY p, cell) AS raw FROM cx WHERE stratum NOT LIKE 'pooled%'), q2 AS (SELECT stratum, cell, least(1.0, min(raw) OVER (PARTITION BY stratum ORDER BY p, cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rx) SELECT c.stratum, c.cell, c.stratum NOT LIKE 'pooled%' AS primary_family, round(coef, 6) AS estimate, round(se, 6) AS se_clustered, round(coef / se, 6) AS z_clustered, round(se0, 6) AS se_naive, round(coef / se0, 6) AS z_naive, round(p, 6) AS p_naive, round(q, 6) AS q_naive FROM cx c LEFT JOIN q2 USING (stratum, cell)")
def contrast_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J16, O-P16: clustered and model-based errors of a contrast side by side, with q in the primary families only."""
    long = _cells_long(_strata(poem_table(spark, sf_dir)), ["stratum", "author", "period3", "n_stanzas"])
    rr = models.rate_ratio(long, ["stratum", "cell"], "k", "n_stanzas", "period3", E.P1, E.P2, "author")
    se0 = F.sqrt(F.try_divide(F.lit(1.0), F.col("k_before")) + F.try_divide(F.lit(1.0), F.col("k_after")))
    naive = rr.select("stratum", "cell", se0.alias("se_naive"), F.try_divide(F.col("coef"), se0).alias("z_naive")).withColumn("p_naive", ranks.two_sided_p(F.col("z_naive")))
    q = ranks.bh(naive.filter(E.primary_for_bh(F.col("stratum"))), ["stratum"], "p_naive", ["cell"], "q_naive").select("stratum", "cell", "q_naive")
    both = rr.select("stratum", "cell", F.col("coef").alias("estimate"), F.col("se").alias("se_clustered"), F.try_divide("coef", "se").alias("z_clustered")).join(naive, ["stratum", "cell"], "left").join(q, ["stratum", "cell"], "left")
    return _rounded(both.withColumn("primary_family", E.primary_for_bh(F.col("stratum"))))


@query(f"WITH {_sql_rates('n_stanzas')}, au AS (SELECT stratum, cell, tk1 - k1 AS a1, tk2 - k2 AS a2, te1 - e1 AS b1, te2 - e2 AS b2 FROM (SELECT stratum, cell, author, k1, k2, e1, e2 FROM per WHERE author IS NOT NULL) JOIN (SELECT stratum, cell, sum(k1) AS tk1, sum(k2) AS tk2, sum(e1) AS te1, sum(e2) AS te2 FROM per WHERE author IS NOT NULL GROUP BY ALL) USING (stratum, cell)) SELECT stratum, cell, count(*) AS n_variants, round(min((a2 / b2) / (a1 / b1)), 6) AS least, round(max((a2 / b2) / (a1 / b1)), 6) AS most FROM au WHERE a1 > 0 AND a2 > 0 AND b1 > 0 AND b2 > 0 GROUP BY ALL")
def leave_one_author_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A33, O-P27: least and greatest rate ratio over the leave-one-author-out variants."""
    long = _cells_long(_strata(poem_table(spark, sf_dir)), ["stratum", "author", "period3", "n_stanzas"])
    return _rounded(models.without_one(long, ["stratum", "cell"], "k", "n_stanzas", "period3", E.P1, E.P2, "author"))


@query(f"WITH st AS (WITH {_sql_rates('n_stanzas')} SELECT stratum, cell, coef FROM cr), tk AS (WITH {_sql_rates('n_tokens')} SELECT stratum, cell, coef FROM cr), u AS (SELECT * FROM st UNION ALL SELECT * FROM tk) SELECT cell, count(coef) AS n_specs, round(avg((coef > 0)::INT), 6) AS share_positive FROM u GROUP BY cell")
def specification_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A32: share of positive estimates over strata and exposures."""
    both = cohort.union_lenient({k: _rates(spark, sf_dir, f"n_{k}").select("stratum", "cell", "coef") for k in ("stanzas", "tokens")}, "exposure")
    return _rounded(counts.positive_share(both, ["cell"], "coef"))


@query(f"WITH {SQL_PT}, x AS (SELECT author, period3, unnest(['1sg','1pl','2sg','2pl']) AS cell, unnest([\"1sg\",\"1pl\",\"2sg\",\"2pl\"])::DOUBLE AS k, n_total::DOUBLE AS n FROM pt WHERE author IS NOT NULL), w AS (SELECT author, cell, coalesce(sum(k) FILTER (period3 LIKE 'P1%'), 0) AS k1, coalesce(sum(n) FILTER (period3 LIKE 'P1%'), 0) AS n1, coalesce(sum(k) FILTER (period3 LIKE 'P2%'), 0) AS k2, coalesce(sum(n) FILTER (period3 LIKE 'P2%'), 0) AS n2 FROM x GROUP BY ALL), e AS (SELECT author, cell, ln(k2 / (n2 - k2)) - ln(k1 / (n1 - k1)) AS est, sqrt(1 / k1 + 1 / (n1 - k1) + 1 / k2 + 1 / (n2 - k2)) AS se FROM w WHERE k1 > 0 AND k2 > 0 AND k1 < n1 AND k2 < n2) SELECT author, cell, round(est, 6) AS estimate_logit, round(est - 1.96 * se, 6) AS ci95_low, round(est + 1.96 * se, 6) AS ci95_high FROM e".replace('\\"', '"'))
def per_author_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M23: each author's shift of every cell, with bounds."""
    long = _cells_long(poem_table(spark, sf_dir), ["author", "period3", "n_total"])
    return _rounded(models.cell_shifts(long, "author", "cell", "k", "n_total", "period3", E.P1, E.P2))


@query()
def author_delta_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B07."""
    return models.poem_bootstrap(poem_table(spark, sf_dir).filter("author is not null"), "author", "1sg", "n_stanzas", "period3", E.P1, E.P2)


@query()
def yearly_share_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-B09."""
    t = poem_table(spark, sf_dir, "year").filter("n_total > 0 and year is not null").withColumn("share", F.col("`1sg`") / F.col("n_total"))
    return models.mean_bootstrap(t.withColumn("year", F.col("year").cast("int")), ["language", "year"], "share")


# ---- corpus-linguistic measures ------------------------------------------------------------------------------------------------------------


_G2 = "2 * ((CASE WHEN f > 0 THEN f * ln(f * n / (r * c)) ELSE 0 END) + (CASE WHEN r - f > 0 AND n - c > 0 THEN (r - f) * ln((r - f) * n / (r * (n - c))) ELSE 0 END) + (CASE WHEN c - f > 0 AND n - r > 0 THEN (c - f) * ln((c - f) * n / ((n - r) * c)) ELSE 0 END) + (CASE WHEN n - r - c + f > 0 THEN (n - r - c + f) * ln((n - r - c + f) * n / ((n - r) * (n - c))) ELSE 0 END))"


@query(f"""WITH {SQL_TOK}, n AS (SELECT language, period3, cell, lemma, count(*)::DOUBLE AS f FROM tok WHERE lemma IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(f) OVER (PARTITION BY language, period3, cell) AS r, sum(f) OVER (PARTITION BY language, period3, lemma) AS c, sum(f) OVER (PARTITION BY language, period3) AS n FROM n)
 SELECT language, period3, cell, lemma, f::BIGINT AS f, r::BIGINT AS f_cell, c::BIGINT AS f_head, n::BIGINT AS f_slice, round(14 + log2(2 * f / (r + c)), 6) AS log_dice, round(log2(f * n / (r * c)), 6) AS pmi, round({_G2}, 5) AS g2 FROM m WHERE language IS NOT NULL""")
def collocation_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C02, O-J17: log-Dice, PMI and G2 of lemma and cell in each language and period."""
    m = colloc.measures(tokens(spark, sf_dir, ("cell", "lemma"), ("language", "period3")).filter("language is not null"), ["language", "period3"], "cell", "lemma")
    return _rounded(m.withColumn("g2", F.round("g2", 5)))


@query(f"""WITH {SQL_TOK}, n AS (SELECT cell, lemma, count(*) FILTER (period3 LIKE 'P1%') AS f1, count(*) FILTER (period3 LIKE 'P2%') AS f2 FROM tok WHERE lemma IS NOT NULL AND period3 <> 'unknown' GROUP BY ALL),
 m AS (SELECT *, sum(f1) OVER (PARTITION BY cell) AS c1, sum(f2) OVER (PARTITION BY cell) AS c2, sum(f1) OVER (PARTITION BY lemma) AS h1, sum(f2) OVER (PARTITION BY lemma) AS h2, sum(f1) OVER () AS s1, sum(f2) OVER () AS s2 FROM n),
 x AS (SELECT *, log2((f2 + 1e-12) * s2 / (c2 * h2 + 1e-12)) - log2((f1 + 1e-12) * s1 / (c1 * h1 + 1e-12)) AS d FROM m WHERE f1 + f2 >= 5), y AS (SELECT cell, lemma, f1, f2, d, f2::DOUBLE AS f, c2::DOUBLE AS r, (f1 + f2)::DOUBLE AS c, (c1 + c2)::DOUBLE AS n FROM x)
 SELECT cell, lemma, f1, f2, round(d, 5) AS delta_pmi, round({_G2}, 5) AS g2 FROM y""")
def period_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C03, O-P37."""
    return _rounded(colloc.period_change(tokens(spark, sf_dir, ("cell", "lemma"), ("period3",)), [], "cell", "lemma", "period3", E.P1, E.P2), 5)


_STOP = ["і", "й", "та", "в", "у", "на", "з", "и", "с", "не", "the", "and", "of"]
_SQL_WORDS = f"""{SQL_ST}, w AS (SELECT poem_id, stanza_index, list_filter(list_transform(regexp_extract_all(stanza, '{T.WORD.replace("'", "''")}'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT list_contains([{', '.join(f"'{s}'" for s in _STOP)}], x)) AS ws FROM st)"""
_SQL_FREQ = f"""{_SQL_WORDS}, e AS (SELECT DISTINCT poem_id, stanza_index, unnest(ws) AS x FROM w), fr AS (SELECT x, count(*) AS n FROM e GROUP BY x)"""
_SQL_PAIRS = f"""{_SQL_FREQ}, pr AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM e a JOIN e b ON a.poem_id = b.poem_id AND a.stanza_index = b.stanza_index AND a.x < b.x GROUP BY ALL)"""
_FOCAL = ["ми", "ви", "мы", "вы"]
_SQL_EGO = f"""{_SQL_FREQ}, bo AS (SELECT a.x AS focal, b.x AS neighbour, count(*) AS n FROM e a JOIN e b ON a.poem_id = b.poem_id AND a.stanza_index = b.stanza_index AND a.x <> b.x WHERE a.x IN ({', '.join(f"'{x}'" for x in _FOCAL)}) GROUP BY ALL HAVING count(*) >= 3),
 eg AS (SELECT focal, neighbour, bo.n AS n, 14 + log2(2.0 * bo.n / (fa.n + fb.n)) AS log_dice, row_number() OVER (PARTITION BY focal ORDER BY log2(2.0 * bo.n / (fa.n + fb.n)) DESC, bo.n DESC, neighbour) AS rank FROM bo JOIN fr fa ON fa.x = focal JOIN fr fb ON fb.x = neighbour QUALIFY rank <= 30)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stanzas(spark, sf_dir).select("poem_id", "stanza_index", T.word_list(F.col("stanza"), _STOP).alias("ws"))


def _freq(words: DataFrame) -> DataFrame:
    return words.select("poem_id", "stanza_index", F.explode(F.array_distinct("ws")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SQL_WORDS} SELECT poem_id, stanza_index, len(ws)::BIGINT AS n_words, array_to_string(list_sort(list_distinct(ws)), ' ') AS words FROM w")
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F07, O-F26."""
    return _rounded(_words(spark, sf_dir).select("poem_id", "stanza_index", F.size("ws").alias("n_words"), F.array_join(F.array_sort(F.array_distinct("ws")), " ").alias("words")))


@query(f"WITH {_SQL_PAIRS} SELECT a, b, pr.n AS n, round(14 + log2(2.0 * pr.n / (fa.n + fb.n)), 6) AS log_dice FROM pr JOIN fr fa ON fa.x = a JOIN fr fb ON fb.x = b")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C04, O-J13: all word pairs of stanzas, however rare."""
    w = _words(spark, sf_dir)
    return _rounded(colloc.edge_dice(colloc.cooccurrence(w, ["poem_id", "stanza_index"], "ws", 1), _freq(w)).select("a", "b", "n", "log_dice"))


def _ego(w: DataFrame) -> DataFrame:
    return colloc.ego(colloc.focal_pairs(w, "ws", _FOCAL, 3), _freq(w), 30)


@query(f"WITH {_SQL_EGO} SELECT focal, neighbour, n, round(log_dice, 6) AS log_dice, rank FROM eg")
def ego_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C05, O-L04, O-L05: the 30 nearest neighbours over pairs of at least 3 stanzas, a top-k report."""
    return _rounded(_ego(_words(spark, sf_dir)))


@query(f"WITH {_SQL_EGO}, nd AS (SELECT focal AS x FROM eg UNION SELECT neighbour FROM eg), k AS (SELECT * FROM e WHERE x IN (SELECT x FROM nd)), pr AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM k a JOIN k b ON a.poem_id = b.poem_id AND a.stanza_index = b.stanza_index AND a.x < b.x GROUP BY ALL HAVING count(*) >= 3) SELECT a, b, pr.n AS n, round(14 + log2(2.0 * pr.n / (fa.n + fb.n)), 6) AS log_dice FROM pr JOIN fr fa ON fa.x = a JOIN fr fb ON fb.x = b")
def ego_second_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C05: edges of at least 3 stanzas among the ego network's nodes."""
    w = _words(spark, sf_dir)
    pairs = colloc.second_order(w, ["poem_id", "stanza_index"], "ws", materialise(_ego(w)), 3)
    return _rounded(colloc.edge_dice(pairs, _freq(w)).select("a", "b", "n", "log_dice"))


@query(f"""WITH {_SQL_WORDS}, v AS (SELECT word, count(*) FILTER (pr LIKE 'P1%') AS n_before, count(*) FILTER (pr LIKE 'P2%') AS n_after FROM (SELECT {SQL_PERIOD} AS pr, unnest(ws) AS word FROM w JOIN (SELECT DISTINCT poem_id, year FROM p) USING (poem_id)) GROUP BY word) SELECT * FROM v WHERE n_before >= 5 AND n_after >= 5""")
def vocabulary_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J15, O-U04: words met at least five times in each of two periods."""
    w = _words(spark, sf_dir).join(poems(spark, sf_dir, "poem_id", "period3"), "poem_id").select("period3", F.explode("ws").alias("word"))
    return colloc.shared_vocabulary(w, "word", "period3", E.P1, E.P2, 5)


@query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS neighbour, list_cosine_similarity(q.e::DOUBLE[], embeddings.embedding::DOUBLE[]) AS similarity FROM q, embeddings WHERE vec_id <> query)
 SELECT query, neighbour, round(similarity, 5) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s QUALIFY rank <= 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-L07: ten nearest of every row whose id is divisible by 50, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return _rounded(vectors.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10), 5)


@query("""WITH x AS (SELECT a.label AS word, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, round(1 - c, 6) AS drift FROM x) SELECT vec_id, drift, round((SELECT count(*) FROM d e WHERE e.drift < d.drift) / (SELECT count(*) FROM d), 6) AS percentile FROM d""")
def vector_drift_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C08, O-F27: drift between two vectors of a row (each and the next one)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return _rounded(vectors.drift(e.join(nxt, "vec_id"), "vec_id", "a", "b"))


@query()
def procrustes_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C07: rotation of each vector onto the next one, and each vector's cosine before and after."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    r = vectors.procrustes(pairs, "a", "b")
    return pairs.select("vec_id", vectors.cosine(F.col("a"), F.col("b")).alias("before"), vectors.cosine(vectors.rotated(F.col("a"), r), F.col("b")).alias("after"))


# ---- time ------------------------------------------------------------------------------------------------------------------------------


_SQL_DAYS = f"""{SQL_P}, dy AS (SELECT poem_id, min(d) AS day, greatest(sum(coalesce(n_stanzas, 0))::DOUBLE, 1.0) AS weight FROM (SELECT *, coalesce(CASE WHEN regexp_matches(trim(posted), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr(trim(posted), 1, 10) AS DATE) END, CASE WHEN regexp_full_match(trim(posted), '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN try_cast(try_strptime(trim(posted), '%d.%m.%Y') AS DATE) END) AS d FROM p) WHERE d IS NOT NULL GROUP BY poem_id)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poems(spark, sf_dir, "poem_id", "posted", "n_stanzas").withColumn("day", T.parsed_date(F.col("posted"))).withColumn("w", F.coalesce("n_stanzas", F.lit(0)))
    return temporal.poem_days(p, "poem_id", "day", "w")


@query(f"WITH {_SQL_DAYS} SELECT poem_id, day, (ntile(bins) OVER (ORDER BY day, poem_id) - 1)::BIGINT AS bin FROM dy, (SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT AS bins FROM dy)".replace("ntile(bins)", "ntile((SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT FROM dy))").replace(", (SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT AS bins FROM dy)", ""))
def balanced_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-T01, O-W11, O-F18."""
    return _rounded(temporal.balanced_bins(_days(spark, sf_dir), "poem_id", 200).select("poem_id", "day", "bin"))


@query(f"WITH {_SQL_DAYS}, k AS (SELECT greatest(1, ceil(count(*) / 200.0)) AS bins, sum(weight) AS tw FROM dy), c AS (SELECT *, sum(weight) OVER (ORDER BY day, poem_id) AS cum FROM dy) SELECT poem_id, day, least(bins - 1, greatest(0, ceil(cum * bins / tw) - 1))::BIGINT AS bin FROM c, k")
def weighted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-T01 by stanzas, O-W04."""
    return _rounded(temporal.balanced_bins(_days(spark, sf_dir), "poem_id", 200, weighted=True).select("poem_id", "day", "bin"))


@query(f"""WITH RECURSIVE {_SQL_DAYS}, b AS (SELECT ((year(day) * 12 + month(day) - 1) // 2)::INT AS bin, count(*) AS n FROM dy GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY bin) AS rn FROM b),
 m AS (SELECT rn, bin, n, 1 AS g, n AS held FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.bin, o.n, CASE WHEN held < 30 THEN g ELSE g + 1 END, CASE WHEN held < 30 THEN held + o.n ELSE o.n END FROM m JOIN o ON o.rn = m.rn + 1),
 z AS (SELECT max(g) AS top, arg_max(held, rn) AS left_over FROM m), a AS (SELECT bin, CASE WHEN g = top AND top > 1 AND left_over < 30 THEN g - 1 ELSE g END AS interval_id FROM m, z), t AS (SELECT interval_id, min(day) AS s, max(day) AS e, count(*) AS n_poems, sum(weight) AS n_weight FROM dy JOIN a ON a.bin = ((year(day) * 12 + month(day) - 1) // 2) GROUP BY interval_id)
 SELECT interval_id::INT AS interval_id, s AS start_date, e AS end_date, n_poems, n_weight, strftime(s, '%Y-%m') || ' to ' || strftime(e, '%Y-%m') AS interval_label FROM t""")
def min_count_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-T02, O-T03, O-F20, O-F21: two-month bins merged to at least thirty poems."""
    return temporal.adaptive_bins(_days(spark, sf_dir), "poem_id")[1]


_IV = [(1, "2013-01-01", "2015-12-31"), (2, "2015-06-01", "2018-12-31"), (3, "2019-01-01", "2021-12-31"), (4, "2022-02-24", "2025-12-31")]


@query(f"WITH {_SQL_DAYS}, iv AS (SELECT * FROM (VALUES {', '.join(f'({i}, DATE {a!r}, DATE {b!r})' for i, a, b in _IV)}) v(interval_id, s, e)) SELECT poem_id, day, min(interval_id)::BIGINT AS interval_id FROM dy JOIN iv ON day BETWEEN s AND e GROUP BY ALL")
def range_join_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J05, O-J04, O-T04: the first of overlapping intervals, met in month buckets."""
    iv = spark.createDataFrame(_IV, "interval_id int, start_date string, end_date string").select("interval_id", F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date"))
    return _rounded(temporal.interval_join(_days(spark, sf_dir).select("poem_id", "day"), "day", iv))


@query(f"WITH {_SQL_DAYS} SELECT poem_id, round(date_diff('day', DATE '2014-01-01', day) / 365.25::DOUBLE, 6) AS t, (day >= DATE '2022-02-24')::BIGINT AS step_war, round(greatest(0.0, date_diff('day', DATE '2022-02-24', day) / 365.25::DOUBLE), 6) AS since_war, ((year(day) * 12 + month(day) - 1) // 2)::BIGINT AS bucket FROM dy")
def segmented_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F20, O-F22."""
    d = _days(spark, sf_dir)
    return _rounded(d.select("poem_id", *[c.alias(n) for n, c in temporal.break_terms(F.col("day"), {"war": "2022-02-24"}, "2014-01-01").items()], temporal.month_bucket(F.col("day"), 2).alias("bucket")))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch form of the streaming counts."""
    w = incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- annotation checks ---------------------------------------------------------------------------------------------------------------------


_SQL_QA = f"""{SQL_A}, q AS (SELECT id, CASE WHEN no_pronoun AND coalesce(trim(pronoun), '') <> '' THEN 'INCONSISTENT: pronoun in a sentence without pronoun' WHEN NOT coalesce(no_pronoun, false) AND coalesce(trim(pronoun), '') = '' THEN 'INCONSISTENT: no pronoun' WHEN coalesce(trim(pronoun), '') <> '' AND person IS NULL THEN 'INCONSISTENT: person missing'
 WHEN coalesce(trim(pronoun), '') <> '' AND person IN ('1st','2nd','3rd') AND (num IS NULL OR num IN ('None', '')) THEN 'INCONSISTENT: number missing' WHEN lower(trim(regexp_replace(pronoun, '[\\[\\]()（）]', '', 'g'))) IN ('ви', 'вы', 'вас', 'вам', 'вами') AND person <> '2nd' THEN 'INCONSISTENT: second plural form with another person'
 WHEN is_dropped AND coalesce(trim(pronoun), '') <> '' AND NOT regexp_matches(pronoun, '[(（\\[]') THEN 'INCONSISTENT: dropped without brackets' ELSE 'OK' END AS qa_flag FROM a)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir, "pronoun", "person", "num", "is_dropped", "no_pronoun")
    return a.select("id", qa.first_failure(qa.annotation_rules(F.col("pronoun"), F.col("person"), F.col("num"), F.col("is_dropped"), F.col("no_pronoun"))).alias("qa_flag"))


@query(f"WITH {_SQL_QA} SELECT id, qa_flag FROM q")
def qa_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-Q01, O-F10, O-F15."""
    return _flags(spark, sf_dir)


@query(f"WITH {_SQL_QA} SELECT CASE WHEN qa_flag = 'OK' THEN 'OK' ELSE 'INCONSISTENT' END AS bucket, count(*) AS n FROM q GROUP BY ALL")
def qa_flag_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P18, O-P20, O-Q10."""
    return _flags(spark, sf_dir).groupBy(E.qa_bucket(F.col("qa_flag")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_A}, g AS (SELECT poem_id, sentence_id, pronoun, list_sort(list_distinct(list(person))) AS l, count(*) AS n_rows FROM a WHERE person IS NOT NULL AND pronoun IS NOT NULL GROUP BY ALL) SELECT poem_id, sentence_id, pronoun, array_to_string(l, '|') AS labels, n_rows FROM g WHERE len(l) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J12, O-Q05."""
    c = qa.label_conflicts(annotations(spark, sf_dir, "poem_id", "sentence_id", "pronoun", "person").filter("pronoun is not null"), ["poem_id", "sentence_id", "pronoun"], "person")
    return c.select("poem_id", "sentence_id", "pronoun", F.array_join("labels", "|").alias("labels"), "n_rows")


@query(f"""WITH {SQL_P}, x AS (SELECT {SQL_PERIOD} AS truth, trim(temporal_period) AS guess FROM p WHERE year IS NOT NULL AND temporal_period IS NOT NULL), l AS (SELECT truth AS label FROM x UNION SELECT guess FROM x), s AS (SELECT label, (SELECT count(*) FROM x WHERE truth = label) AS support, (SELECT count(*) FROM x WHERE guess = label) AS g, (SELECT count(*) FROM x WHERE guess = label AND truth = label) AS h FROM l),
 r AS (SELECT *, CASE WHEN g > 0 THEN h / g ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN h / support ELSE 0.0 END AS rc FROM s) SELECT label, round(pr, 6) AS "precision", round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1, support::BIGINT AS support FROM r""")
def confusion_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-Q02, O-Q03: the stored period label against the year's."""
    p = poems(spark, sf_dir, "poem_id", "year", "temporal_period").filter("year is not null and temporal_period is not null")
    return _rounded(qa.class_scores(p.select(E.period_p1_p2(F.col("year")).alias("truth"), F.trim("temporal_period").alias("guess")), "truth", "guess"))


_SQL_VOTES = "v AS (SELECT annotator, poem_id, arg_max(l, (created_at, id, l)) AS l FROM (SELECT lower(trim(annotator_id)) AS annotator, *, lower(trim(regexp_replace(perspective_primary, ' +', ' ', 'g'))) AS l FROM poem_perspectives) WHERE l IS NOT NULL AND l <> '' GROUP BY ALL)"


@query(f"""WITH {_SQL_VOTES}, c AS (SELECT poem_id, l, count(*) AS c FROM v GROUP BY ALL), u AS (SELECT poem_id, sum(c) AS m, sum(c * c) AS sq FROM c GROUP BY poem_id HAVING sum(c) > 1), s AS (SELECT count(*) AS units, sum(m) AS n, sum((m * m - sq) / (m - 1)) AS d FROM u), t AS (SELECT sum(t * t) AS tsq FROM (SELECT sum(c) AS t FROM c WHERE poem_id IN (SELECT poem_id FROM u) GROUP BY l))
 SELECT units, n::BIGINT AS judgments, round(1 - d / ((n * n - tsq) / (n - 1)), 6) AS alpha FROM s, t""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M25."""
    v = table(spark, sf_dir, "poem_perspectives").select(F.lower(F.trim("annotator_id")).alias("annotator"), "poem_id", "created_at", "id", F.lower(F.trim(F.regexp_replace("perspective_primary", " +", " "))).alias("l")).filter("l is not null and l <> ''")
    return _rounded(qa.krippendorff(cohort.latest(v, ["annotator", "poem_id"], "created_at", ["id", "l"]), ["poem_id"], "l"))


@query(f"WITH {SQL_P}, {SQL_A}, n AS (SELECT poem_id, count(DISTINCT annotator) AS n_annotators, count(DISTINCT sentence_id) AS n_sentences FROM a GROUP BY poem_id) SELECT p.poem_id, coalesce(n_annotators, 0)::BIGINT AS n_annotators, coalesce(n_sentences, 0)::BIGINT AS n_sentences FROM p LEFT JOIN n USING (poem_id)")
def annotation_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-Q11, O-P36."""
    n = annotations(spark, sf_dir, "poem_id", "annotator", "sentence_id").groupBy("poem_id").agg(F.countDistinct("annotator").alias("n_annotators"), F.countDistinct("sentence_id").alias("n_sentences"))
    return poems(spark, sf_dir, "poem_id").join(n, "poem_id", "left").select("poem_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_annotators", "n_sentences")])


# ---- text ------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_ST} SELECT poem_id, string_agg(stanza, chr(10) || chr(10) ORDER BY stanza_index, stanza) AS text, count(*) AS n_parts FROM st GROUP BY poem_id")
def poem_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A21, O-A22."""
    return counts.joined_text(stanzas(spark, sf_dir), "poem_id", "stanza_index", "stanza")


@query(f"WITH {SQL_P} SELECT poem_id, substr(sha256(text), 1, 32) AS sha256_32, substr(sha1(text), 1, 16) AS sha1_16, ('0x' || substr(md5(text), 1, 8))::BIGINT AS md5_seed FROM p")
def content_hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F14."""
    p = table(spark, sf_dir, "poems_for_manual_annotation")  # hashed before equal rows meet: the text is not shuffled
    return p.select(F.col("ID").alias("poem_id"), *[c.alias(n) for n, c in T.content_keys(F.col("text")).items()]).distinct()


@query("""SELECT DISTINCT poem_id, regexp_replace(trim(ID), '^(\\d+)\\.0$', '\\1') AS record_id, greatest(1, coalesce(try_cast(nullif(regexp_extract(lower(trim("Multiple poem info")), '^(\\d+)\\s*poem', 1), '') AS INT), 1))::BIGINT AS expected, len(regexp_replace("Poem full text (copy and paste)", '\\r\\n?', chr(10), 'g'))::BIGINT AS n_chars, coalesce(lower(trim("Is repeat")) IN ('true', '1', 'yes', 'y'), false) AS is_repeat FROM layer0_poems_one_per_row""")
def layer0_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F01..F03, O-P07."""
    d = table(spark, sf_dir, "layer0_poems_one_per_row")
    return _rounded(d.select("poem_id", T.record_id(F.col("ID")).alias("record_id"), T.poem_count(F.col("Multiple poem info")).alias("expected"), F.length(T.newlines(F.col("Poem full text (copy and paste)"))).alias("n_chars"), E.truthy(F.col("Is repeat")).alias("is_repeat")).distinct())


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F28: tolerant JSON decoding by schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT ID || '_' || sub_poem_index AS poem_id, list_reduce(list_prepend(0, string_split(layer0_expected_sub_poems::VARCHAR || '|' || layer0_obtained_sub_poems::VARCHAR, '|')::INT[]), lambda a, b: a + b)::BIGINT AS total, abs(layer0_expected_sub_poems - layer0_obtained_sub_poems) > 0 AS review FROM (SELECT DISTINCT ID, sub_poem_index, layer0_expected_sub_poems, layer0_obtained_sub_poems FROM layer0_poems_one_per_row WHERE NOT layer0_qc_count_match)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-Q07, O-F29, D3: parents whose parts disagree with the expected count."""
    d = table(spark, sf_dir, "layer0_poems_one_per_row").filter("not layer0_qc_count_match").select("ID", "sub_poem_index", "layer0_expected_sub_poems", "layer0_obtained_sub_poems").distinct()
    pair = T.int_list(F.concat_ws("|", F.col("layer0_expected_sub_poems").cast("string"), F.col("layer0_obtained_sub_poems").cast("string")))
    return d.select(F.concat_ws("_", "ID", F.col("sub_poem_index").cast("string")).alias("poem_id"), F.aggregate(pair, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), (F.abs(F.col("layer0_expected_sub_poems") - F.col("layer0_obtained_sub_poems")) > 0).alias("review"))


_PARTS = "array<struct<stanza_index: int, stanza_text: string>>"


@query()
def stanza_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-G10..G12, D4: stanzas of every layer-0 poem with trailing date and signature; poems without stanza keep one row."""
    @F.pandas_udf(f"stanzas {_PARTS}, trailing_date_line string, trailing_signature_line string")
    def cut(text: pd.Series, author: pd.Series) -> pd.DataFrame:
        rows = [S.stanzas(t, a) for t, a in zip(text, author)]
        return pd.DataFrame({"stanzas": [[{"stanza_index": i, "stanza_text": x} for i, x in enumerate(p, 1)] for p, _, _ in rows], "trailing_date_line": [d for _, d, _ in rows], "trailing_signature_line": [s for _, _, s in rows]})

    d = table(spark, sf_dir, "layer0_poems_one_per_row").select("poem_id", F.col("Author of poem").alias("author"), F.col("Poem full text (copy and paste)").alias("text")).distinct()
    c = d.select("poem_id", "author", cut(F.col("text"), F.col("author")).alias("c"))
    return c.select("poem_id", "author", "c.trailing_date_line", "c.trailing_signature_line", F.size("c.stanzas").alias("total_stanzas_in_poem"), F.explode_outer("c.stanzas").alias("s")).select("poem_id", "author", "trailing_date_line", "trailing_signature_line", "total_stanzas_in_poem", F.coalesce("s.stanza_index", F.lit(0)).alias("stanza_index"), F.concat(F.lit("s"), F.coalesce("s.stanza_index", F.lit(0)).cast("string")).alias("stanza_label"), "s.stanza_text")


@query()
def sub_poem_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-G01..G08, D2: documents cut into as many parts as their number of blank-line blocks asks for, with way and check."""
    @F.pandas_udf("parts array<string>, method string, qc_ok boolean, repaired boolean")
    def cut(text: pd.Series, expected: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(("parts", "method", "qc_ok", "repaired"), S.sub_poems(t, int(n)))) for t, n in zip(text, expected)])

    d = table(spark, sf_dir, "layer0_poems_one_per_row").select("poem_id", F.col("Poem full text (copy and paste)").alias("text"), T.poem_count(F.col("Multiple poem info")).alias("expected")).distinct()
    return d.select("poem_id", "expected", cut(F.col("text"), F.col("expected")).alias("c")).select("poem_id", "expected", "c.method", "c.qc_ok", "c.repaired", F.posexplode("c.parts").alias("i", "part")).select("poem_id", "expected", "method", "qc_ok", "repaired", (F.col("i") + 1).alias("sub_poem_index"), F.length("part").alias("n_chars"))


# ---- models ----------------------------------------------------------------------------------------------------------------------------------


def _frame(spark: SparkSession, glm: models.Glm, **tags: object) -> DataFrame:
    rows = [(*tags.values(), r.term, float(r.coef), None if math.isnan(r.se) else float(r.se), None if math.isnan(r.p) else float(r.p)) for r in glm.table().itertuples()]
    return spark.createDataFrame(rows, ", ".join([*(f"{k} string" for k in tags), "term string, coef double, se double, p double"]))


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = poem_table(spark, sf_dir).filter(F.col("language").isin(*MAIN) & (F.col("period3") != E.UNKNOWN) & F.col("author").isNotNull() & (F.col("n_stanzas") > 0))
    return t.withColumn("post", (F.col("period3") == E.P2).cast("int")).withColumn("n1p", F.col("`1sg`") + F.col("`1pl`")).withColumn("k1", F.col("`1sg`"))


_SQL_GLM = f"""{SQL_PT}, r AS (SELECT author, period3 LIKE 'P2%' AS post, "1sg"::DOUBLE AS k, ("1sg" + "1pl")::DOUBLE AS t, n_stanzas::DOUBLE AS e FROM pt WHERE language IN ('Ukrainian', 'Russian') AND period3 <> 'unknown' AND author IS NOT NULL AND n_stanzas > 0)"""


@query(f"""WITH {_SQL_GLM}, s AS (SELECT sum(k) FILTER (NOT post) AS k1, sum(k) FILTER (post) AS k2, sum(e) FILTER (NOT post) AS e1, sum(e) FILTER (post) AS e2, count(*)::DOUBLE AS n, count(DISTINCT author)::DOUBLE AS g FROM r), cl AS (SELECT author, coalesce(sum(k - e * k1 / e1) FILTER (NOT post), 0) / any_value(k1) AS a, coalesce(sum(k - e * k2 / e2) FILTER (post), 0) / any_value(k2) AS b FROM r, s GROUP BY author),
 v AS (SELECT sum(a * a) AS va, sum((b - a) * (b - a)) AS vb FROM cl), o AS (SELECT 'intercept' AS term, ln(k1 / e1) AS coef, sqrt(va * g / (g - 1) * (n - 1) / (n - 2)) AS se FROM s, v UNION ALL SELECT 'post', ln((k2 / e2) / (k1 / e1)), sqrt(vb * g / (g - 1) * (n - 1) / (n - 2)) FROM s, v) SELECT term, round(coef, 5) AS coef, round(se, 5) AS se, round({_ERFC}, 5) AS p FROM (SELECT *, abs(coef / se) / sqrt(2.0) AS x FROM o)""")
def poisson_glm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M04, O-M11 through the general solver, held against the closed form: coefficients, cluster errors and p."""
    g = models.Glm(_model_rows(spark, sf_dir), "k1", ["post"], offset="n_stanzas", cluster="author")
    return _rounded(_frame(spark, g), 5)


@query(f"""WITH {_SQL_GLM}, s AS (SELECT sum(k) FILTER (NOT post) AS k1, sum(k) FILTER (post) AS k2, sum(t) FILTER (NOT post) AS t1, sum(t) FILTER (post) AS t2, count(*)::DOUBLE AS n, count(DISTINCT author)::DOUBLE AS g FROM r WHERE t > 0), cl AS (SELECT author, coalesce(sum(k - t * k1 / t1) FILTER (NOT post), 0) / any_value(k1 * (1 - k1 / t1)) AS a, coalesce(sum(k - t * k2 / t2) FILTER (post), 0) / any_value(k2 * (1 - k2 / t2)) AS b FROM r, s WHERE t > 0 GROUP BY author),
 v AS (SELECT sum(a * a) AS va, sum((b - a) * (b - a)) AS vb FROM cl), o AS (SELECT 'intercept' AS term, ln(k1 / (t1 - k1)) AS coef, sqrt(va * g / (g - 1) * (n - 1) / (n - 2)) AS se FROM s, v UNION ALL SELECT 'post', ln(k2 / (t2 - k2)) - ln(k1 / (t1 - k1)), sqrt(vb * g / (g - 1) * (n - 1) / (n - 2)) FROM s, v) SELECT term, round(coef, 5) AS coef, round(se, 5) AS se, round({_ERFC}, 5) AS p FROM (SELECT *, abs(coef / se) / sqrt(2.0) AS x FROM o)""")
def binomial_glm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M06: share of singular among first persons, cluster errors by author."""
    g = models.Glm(_model_rows(spark, sf_dir).filter("n1p > 0"), "k1", ["post"], "binomial", trials="n1p", cluster="author")
    return _rounded(_frame(spark, g), 5)


@query()
def negative_binomial_glm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M05, O-M22."""
    return _frame(spark, models.negative_binomial(_model_rows(spark, sf_dir), "k1", ["post"], offset="n_stanzas", cluster="author"))


@query()
def conditional_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M10: exact conditional likelihood within authors."""
    return spark.createDataFrame(models.conditional_logit(_model_rows(spark, sf_dir).filter("n1p > 0").groupBy("author", "post").agg(F.sum("k1").alias("k"), F.sum("n1p").alias("n")), "author", "k", "n", ["post"]))


@query()
def interrupted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M13, O-M15: weighted segmented regression over the merged bins, HC3."""
    import numpy as np

    tagged, info = temporal.adaptive_bins(_days(spark, sf_dir), "poem_id")
    t = poem_table(spark, sf_dir).select("poem_id", F.col("`1sg`").alias("k"), "n_total").join(tagged.select("poem_id", "interval_id"), "poem_id")
    s = t.groupBy("interval_id").agg(F.sum("k").alias("k"), F.sum("n_total").alias("n")).join(info, "interval_id").filter("n > 0").orderBy("interval_id").toPandas()  # one row an interval
    if len(s) < 5:
        return spark.createDataFrame([], "term string, coef double, se double, r2 double")
    years = np.array([(d.toordinal() - 735234) / 365.25 for d in s["start_date"]])
    p = np.clip(s["k"] / s["n"], 1e-3, 1 - 1e-3)
    war = 8.15
    x = np.column_stack((np.ones(len(s)), years, years >= war, np.maximum(0, years - war)))
    b, v, r2 = models.wls_hc3(x, np.log(p / (1 - p)).to_numpy(), s["n"].to_numpy(float))
    return spark.createDataFrame([(n, float(c), float(np.sqrt(max(q, 0))), float(r2)) for n, c, q in zip(("intercept", "t", "step", "slope_change"), b, np.diag(v))], "term string, coef double, se double, r2 double")


@query()
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M18: change points of the yearly rate, with its smooth."""
    import numpy as np

    s = poem_table(spark, sf_dir, "year").filter("year is not null").groupBy(F.col("year").cast("int").alias("year")).agg((F.sum("1sg") / F.sum("n_stanzas")).alias("rate")).orderBy("year").toPandas()  # one row a year
    cut = set(models.change_points(s["rate"].to_numpy(float)))
    smooth = models.loess(s["year"].to_numpy(float), s["rate"].to_numpy(float), s["year"].to_numpy(float), 0.5) if len(s) > 2 else np.array(s["rate"])
    return spark.createDataFrame([(int(y), float(r), float(m), i in cut) for i, (y, r, m) in enumerate(zip(s["year"], s["rate"], smooth))], "year int, rate double, smooth double, starts_segment boolean")


@query()
def change_point_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M18: the first change point of the yearly rate and its bootstrap interval."""
    s = poem_table(spark, sf_dir, "year").filter("year is not null and n_stanzas > 0").groupBy(F.col("year").cast("int").alias("year")).agg((F.sum("1sg") / F.sum("n_stanzas")).alias("rate")).orderBy("year").toPandas()  # one row a year
    r = models.change_point_interval(s["rate"].to_numpy(float), s["year"].to_numpy(float))
    covers = None if r["low"] is None else r["low"] <= 2022 <= r["high"]
    return spark.createDataFrame([(*r.values(), covers)], "detected double, low double, high double, n_points int, n_valid int, covers_2022 boolean")


@query()
def smooth_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M16: smooth of the monthly share of first person singular, with bands from resampled authors."""
    d = poem_table(spark, sf_dir).filter("n_total > 0 and author is not null").withColumn("share", F.col("`1sg`") / F.col("n_total"))
    months = _days(spark, sf_dir).select("poem_id", temporal.month_bucket(F.col("day"), 1).alias("month"))
    return models.smooth_bands(d.join(months, "poem_id"), "author", "month", "share")


@query()
def smooth_year_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M17: does a smooth of the year explain a cell's rate better than a constant? A row a cell."""
    t = poem_table(spark, sf_dir, "year", "n_tokens").filter(F.col("language") == "Ukrainian")
    rows = [(c, *models.spline_test(t.withColumn("k", F.col(f"`{c}`")), "k", "year", "n_tokens").values()) for c in FOUR]
    return spark.createDataFrame([(c, *map(float, x[:3]), int(x[3]), float(x[4])) for c, *x in rows], "cell string, deviance_smooth double, deviance_null double, deviance_drop double, degrees int, p double")


@query()
def mixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M19, O-M09: random intercepts per author, linear and binomial."""
    rows = _model_rows(spark, sf_dir).filter("n1p > 0").withColumn("share", F.col("k1") / F.col("n1p"))
    lin = models.random_intercept(rows, "author", "share", ["post"])
    out = [("linear", k, float(v)) for k, v in lin["beta"].items()] + [("linear", "tau2", float(lin["tau2"])), ("linear", "sigma2", float(lin["sigma2"]))]
    out += [("binomial", k, v) for k, v in models.binomial_intercepts(rows, "author", "k1", "n1p", "post").items()]
    return spark.createDataFrame(out, "model string, term string, value double")


@query(f"""WITH {SQL_PT}, ro AS (SELECT author, least(count(DISTINCT poem_id) FILTER (period3 LIKE 'P1%'), count(DISTINCT poem_id) FILTER (period3 LIKE 'P2%')) AS n FROM (SELECT *, {SQL_PERIOD} AS period3 FROM p) WHERE author IS NOT NULL AND period3 <> 'unknown' GROUP BY author), inc AS (SELECT author FROM ro WHERE n >= 5)
 SELECT * FROM (VALUES (1, 'poems', (SELECT count(*) FROM p)), (2, 'annotations', (SELECT count(*) FROM a)), (3, 'cell_table', (SELECT count(*) FROM pt)), (4, 'roster', (SELECT count(*) FROM ro)), (5, 'rates', (SELECT count(*) FROM (SELECT DISTINCT author, period3 FROM pt WHERE author IN (SELECT author FROM inc))))) v(position, stage, n_rows)""")
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-X01..X05: stages that need each other, put in order, carried out and written one after the other, with the rows of each."""
    from .stages import Registry, Stage

    reg = Registry()
    reg.add(Stage("poems", lambda s, r: poems(s, sf_dir, "poem_id", "author", "year", "language", "n_stanzas", "period3")))
    reg.add(Stage("annotations", lambda s, r: annotations(s, sf_dir, "poem_id", "cell")))
    reg.add(Stage("cell_table", lambda s, r: counts.cell_table(r["annotations"], cells=FOUR).join(r["poems"], "poem_id"), ("poems", "annotations")))
    reg.add(Stage("roster", lambda s, r: cohort.roster(r["poems"], "author", "poem_id", "year", "language"), ("poems",)))
    reg.add(Stage("rates", lambda s, r: counts.rate_per(cohort.keep_ids(r["cell_table"], r["roster"].filter("included"), "author"), ["author", "period3"], "1sg", "n_stanzas"), ("cell_table", "roster")))
    reg.add(Stage("unused", lambda s, r: s.range(1)))
    plan, results = reg.run(spark, ["rates"])
    return spark.createDataFrame([(i, n, results[n].count()) for i, n in enumerate(plan, 1)], "position int, stage string, n_rows bigint")


# ---- small result operators, windows, round trips ---------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_PT}, ro AS (SELECT author FROM (SELECT DISTINCT poem_id, author, {SQL_PERIOD} AS pr FROM p) WHERE author IS NOT NULL GROUP BY author HAVING least(count(*) FILTER (pr LIKE 'P1%'), count(*) FILTER (pr LIKE 'P2%')) >= 5),
 x AS (SELECT CASE WHEN trim(coalesce(generation_cohort, '')) IN ('soviet', 'transition', 'independence') THEN trim(generation_cohort) ELSE '' END AS generation_cohort, pt.* FROM pt JOIN author_covariates USING (author) WHERE author IN (SELECT author FROM ro) AND period3 <> 'unknown')
 SELECT generation_cohort, period3, count(DISTINCT author) AS n_authors, count(*) AS n_poems, round(sum("1sg") / sum(n_total), 6) AS share_1sg, round(sum("1pl") / sum(n_total), 6) AS share_1pl, round(sum("2sg") / sum(n_total), 6) AS share_2sg, round(sum("2pl") / sum(n_total), 6) AS share_2pl FROM x WHERE generation_cohort <> '' GROUP BY ALL HAVING sum(n_total) > 0""")
def composition_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A24: weighted shares of the four cells per generation and period, for authors on the roster."""
    on = cohort.roster(poems(spark, sf_dir, *POEM), "author", "poem_id", "year", "language").filter("included")
    c = table(spark, sf_dir, "author_covariates").select("author", E.vocabulary(F.col("generation_cohort"), ["soviet", "transition", "independence"]).alias("generation_cohort"))
    t = cohort.keep_ids(poem_table(spark, sf_dir).filter(F.col("period3") != E.UNKNOWN), on, "author").join(c, "author").filter("generation_cohort <> ''")
    return _rounded(counts.composition(t, ["generation_cohort", "period3"], list(FOUR)))


@query("""WITH v AS (SELECT CASE WHEN lower(trim(coalesce(generation_cohort, ''))) IN ('', 'unknown', 'nan') THEN 'missing' ELSE trim(generation_cohort) END AS level FROM author_covariates) SELECT level, count(*) AS n, row_number() OVER (ORDER BY level = 'missing', count(*) DESC, level) AS position FROM v GROUP BY level""")
def covariate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A34: levels of a covariate by frequency, missing ones last."""
    return _rounded(counts.level_counts(table(spark, sf_dir, "author_covariates"), "generation_cohort"))


@query(f"""WITH {SQL_PT} SELECT language, sum(n_tokens) FILTER (period3 LIKE 'P1%')::BIGINT AS sum_before, round(avg(n_tokens) FILTER (period3 LIKE 'P1%'), 6) AS mean_before, sum(n_tokens) FILTER (period3 LIKE 'P2%')::BIGINT AS sum_after, round(avg(n_tokens) FILTER (period3 LIKE 'P2%'), 6) AS mean_after FROM pt GROUP BY language""")
def pivot_sum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-A31: sums and means of tokens per language, a column a period."""
    t = poem_table(spark, sf_dir, "n_tokens").withColumn("at", E.lookup(F.col("period3"), {E.P1: "before", E.P2: "after"}))
    return _rounded(counts.pivot_sums(t, ["language"], "at", ["before", "after"], "n_tokens"))


@query(f"""WITH {SQL_ST}, {SQL_A}, v AS (SELECT poem_id, sentence_id AS stanza_index, count(*) AS n_marks FROM a GROUP BY ALL), e AS (SELECT poem_id, stanza_index, len(regexp_extract_all(stanza, '[^{T.SPACE}]+'))::BIGINT AS n, coalesce(n_marks, 0) AS n_marks FROM st LEFT JOIN v USING (poem_id, stanza_index)) SELECT poem_id, count(*) AS n_stanzas, sum(n)::BIGINT AS n_tokens, sum(n_marks)::BIGINT AS n_marks FROM e GROUP BY poem_id""")
def stanza_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J02: counts joined to stanzas by poem and number, 0 where a stanza has none, then added up (records by number stand for verbs)."""
    marks = annotations(spark, sf_dir, "poem_id", "sentence_id").groupBy("poem_id", F.col("sentence_id").alias("stanza_index")).agg(F.count(F.lit(1)).alias("n_marks"))
    e = counts.stanza_exposure(stanzas(spark, sf_dir), text="stanza", verbs=marks)
    return e.select("poem_id", F.col("exposure_n_stanzas").alias("n_stanzas"), F.col("exposure_n_tokens").cast("bigint").alias("n_tokens"), F.col("exposure_n_marks").alias("n_marks"))


@query(f"WITH {_SQL_DAYS}, c AS (SELECT *, (ntile((SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT FROM dy)) OVER (ORDER BY day, poem_id)) AS bin FROM dy) SELECT bin::BIGINT AS interval_id, min(day) AS start_date, max(day) AS end_date, count(*) AS n_poems, sum(weight) AS n_weight FROM c GROUP BY bin")
def balanced_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-W12, O-L02: runs of balanced bins as intervals, in order of days."""
    return _rounded(temporal.bin_intervals(temporal.balanced_bins(_days(spark, sf_dir), "poem_id", 200)))


_BLANK = "' ' || chr(9) || chr(13) || chr(10)"


@query(f"""WITH {SQL_P}, x AS (SELECT DISTINCT poem_id, text, string_split(text, chr(10)) AS l FROM p WHERE text IS NOT NULL), c AS (SELECT poem_id, list_filter(list_transform(string_split(text, '.'), lambda y: trim(y, {_BLANK})), lambda y: y <> '') AS s, trim(l[2], {_BLANK}) AS c FROM x WHERE len(l) > 1), i AS (SELECT poem_id, s, coalesce(nullif(list_position(s, c), 0), nullif(list_position(list_transform(s, lambda y: contains(y, c) OR contains(c, y)), true), 0)) AS i FROM c)
 SELECT poem_id, {', '.join(f"coalesce(CASE WHEN i + ({k}) > 0 THEN s[i + ({k})] END, '') AS \"context_{k:+d}\"" for k in range(-2, 3))} FROM i""".replace('\\"', '"'))
def sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-W09, O-G14: the sentences around the one that holds each poem's second line."""
    p = poem_texts(spark, sf_dir).withColumn("context", F.get(F.split("text", "\n"), F.lit(1))).filter("context is not null")
    return qa.sentence_windows(p, "text", "context").select("poem_id", *[f"context_{i:+d}" for i in range(-2, 3)])


@query(f"""WITH {SQL_P}, x AS (SELECT DISTINCT poem_id, regexp_extract_all(text, '[^{T.SPACE}]+') AS w FROM p WHERE text IS NOT NULL), m AS (SELECT DISTINCT id, poem_id, position::BIGINT AS position FROM annotations WHERE position IS NOT NULL) SELECT id, array_to_string(list_slice(w, greatest(0, position - 5) + 1, least(len(w), position + 6)), ' ') AS "window" FROM m JOIN x USING (poem_id)""")
def token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-W10: five tokens before and after each annotated position."""
    marks = annotations(spark, sf_dir, "poem_id", "position")
    return qa.token_windows(marks, poem_texts(spark, sf_dir).filter("text is not null"), "poem_id", "id", "position", "text")


@query(f"""WITH {SQL_P}, {SQL_A}, d AS (SELECT poem_id, CASE WHEN is_dropped THEN 'dropped' ELSE 'said' END AS method, pronoun, lemma FROM a WHERE pronoun IS NOT NULL), q AS (SELECT DISTINCT poem_id FROM p) SELECT poem_id, method, pronoun, lemma, count(*) AS n FROM q LEFT JOIN d USING (poem_id) GROUP BY ALL""")
def detections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R02: two lists of detections a poem, said and dropped, as rows with columns; counted."""
    a = annotations(spark, sf_dir, "poem_id", "pronoun", "lemma", "is_dropped").filter("pronoun is not null")
    pick = lambda c: F.collect_list(F.when(c, F.struct("pronoun", "lemma")))
    lists = a.groupBy("poem_id").agg(pick(~F.coalesce("is_dropped", F.lit(False))).alias("s"), pick(F.col("is_dropped")).alias("d"))
    rows = qa.merged_detections(poems(spark, sf_dir, "poem_id").join(lists, "poem_id", "left"), ["poem_id"], {"said": "s", "dropped": "d"})
    return rows.groupBy("poem_id", "method", "pronoun", "lemma").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL_A}, c AS (SELECT coalesce(person, 'none') AS label, count(*) AS n FROM a GROUP BY ALL) SELECT label, n, row_number() OVER (ORDER BY coalesce(nullif(list_position(['1st', '2nd', '3rd'], label), 0), 4), lower(label), label) AS position FROM c""")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-L14, O-L15, O-W03: labels in their usual order, others after them without case, numbered."""
    c = annotations(spark, sf_dir, "person").groupBy(F.coalesce("person", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(counts.in_order(c, ["1st", "2nd", "3rd"], "label"))


@query(f"WITH {SQL_P} SELECT author, poem_id, row_number() OVER (PARTITION BY author ORDER BY poem_id) AS rank FROM (SELECT DISTINCT author, poem_id FROM p WHERE author IS NOT NULL) QUALIFY rank <= 3")
def spot_check_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-L13, O-L06: the first three ids of each author, a spot-check report."""
    return _rounded(cohort.ranked(poems(spark, sf_dir, "author", "poem_id").filter("author is not null"), ["author"], [F.col("poem_id")], 3))


@query(f"WITH {SQL_P} SELECT language, coalesce(max(code), language) AS code, count(*) AS n FROM p LEFT JOIN (VALUES ('Ukrainian', 'uk'), ('Russian', 'ru'), ('Polish', 'pl'), ('English', 'en')) m(name, code) ON name = language GROUP BY language")
def lookup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J09: labels through a small table, others unchanged."""
    code = E.lookup(F.col("language"), {"Ukrainian": "uk", "Russian": "ru", "Polish": "pl", "English": "en"}, F.col("language"))
    return poems(spark, sf_dir, "poem_id", "language").groupBy("language", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT qa_flag, is_repeat, count(*) AS n FROM (SELECT DISTINCT poem_id, "Is repeat" AS is_repeat, 'OK' AS qa_flag FROM layer0_poems_one_per_row) GROUP BY ALL""")
def padded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P33: blanks around column names removed, a missing column added with its default."""
    d = table(spark, sf_dir, "layer0_poems_one_per_row").select(F.col("poem_id").alias(" poem_id"), F.col("Is repeat").alias("is_repeat "))
    d = cohort.with_defaults(cohort.stripped_columns(d), {"qa_flag": "OK", "is_repeat": "none"})
    return d.distinct().groupBy("qa_flag", "is_repeat").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT DISTINCT poem_id, layer0_merge_repaired AS o, layer0_gpt_applied AS g, greatest(1, coalesce(try_cast(nullif(regexp_extract(lower(trim("Multiple poem info")), '^(\\d+)\\s*poem', 1), '') AS INT), 1)) AS e FROM layer0_poems_one_per_row) SELECT poem_id, CASE WHEN o THEN CASE WHEN e = 1 THEN 'manual_csv' ELSE 'rules' END WHEN g THEN 'gpt_batch_linecuts' ELSE 'rules' END AS way, (CASE WHEN g AND NOT coalesce(o, false) THEN 1 ELSE e END)::BIGINT AS expected FROM d""")
def segment_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-G09: starts set by hand before an adjudication before the rules (merged rows stand for the first, adjudicated ones for the second, both starting at line 0)."""
    d = table(spark, sf_dir, "layer0_poems_one_per_row").select("poem_id", F.col("Poem full text (copy and paste)").alias("text"), T.poem_count(F.col("Multiple poem info")).alias("expected"), F.col("layer0_merge_repaired").alias("o"), F.col("layer0_gpt_applied").alias("g")).distinct()
    overrides = d.filter("o").select("poem_id", F.array(F.lit(0)).alias("starts"))
    verdicts = d.filter("g").select("poem_id", F.lit(1).alias("count"), F.array(F.lit(0)).alias("starts"))
    out = posts.segmented(d.select("poem_id", "text", "expected"), "poem_id", "text", "expected", overrides, verdicts)
    way = F.when(F.col("way").isin("manual_csv", "gpt_batch_linecuts"), F.col("way")).otherwise("rules")
    return _rounded(out.select("poem_id", way.alias("way"), "expected"))


def _scratch(spark: SparkSession) -> str:
    import uuid

    from ..session import remove_at_exit, shared_dir

    path = f"{shared_dir(spark)}/stanzaflow-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


@query("SELECT author, coalesce(gender, '') AS gender, coalesce(notes, '') AS notes, coalesce(\"references\", '') AS refs FROM author_covariates".replace('\\"', '"'))
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S01, O-S03, O-K01, O-K02: a table written as CSV in two appended parts and read again, some columns, quotes and blanks included."""
    path, c = _scratch(spark), table(spark, sf_dir, "author_covariates")
    early = F.lower(F.substring("author", 1, 1)) < "m"
    io.write_csv(c.filter(early), path)
    io.write_csv(c.filter(~F.coalesce(early, F.lit(False))), path, append=True, blank=["gender"])
    back = io.read_csv(spark, path, columns=["author", "gender", "notes", "references"])
    return back.select("author", *[F.coalesce(x, F.lit("")).alias(y) for x, y in (("gender", "gender"), ("notes", "notes"), ("references", "refs"))])


@query(f"WITH {SQL_A} SELECT poem_id, pronoun, n FROM (SELECT poem_id, pronoun, count(*) AS n FROM a WHERE pronoun IS NOT NULL AND poem_id IS NOT NULL GROUP BY ALL)")
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-K03, O-S08: JSON lines with a nested list a poem, appended, read again as a row per element."""
    n = annotations(spark, sf_dir, "poem_id", "pronoun").filter("pronoun is not null and poem_id is not null").groupBy("poem_id", "pronoun").agg(F.count(F.lit(1)).alias("n"))
    path = _scratch(spark)
    io.append_json(n.groupBy("poem_id").agg(F.collect_list(F.struct("pronoun", "n")).alias("contexts")), path)
    return io.read_cache(spark, path, "poem_id string, contexts array<struct<pronoun: string, n: bigint>>", "contexts")


@query("SELECT DISTINCT trim(poem_id) AS id FROM annotations WHERE trim(coalesce(poem_id, '')) <> ''")
def done_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S09, O-S10: ids written as lines, blank and repeated ones too, read as a set; a missing file is no ids."""
    path = _scratch(spark)
    table(spark, sf_dir, "annotations").select(F.coalesce(F.concat(F.lit(" "), "poem_id"), F.lit(" ")).alias("value")).write.text(path)
    return io.read_done(spark, path).unionByName(io.read_done(spark, path + "-missing"))


# ---- encodings and forms, row by row ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_A} SELECT id, CASE WHEN cell <> '2pl' THEN cell WHEN no_pronoun IS NOT NULL AND coalesce(is_dropped, true) THEN '2pl_vy_polite_singular' ELSE '2pl_vy_true_plural' END AS register_cell, CASE WHEN cell <> '' THEN cell WHEN person = 'Impersonal' THEN 'Impersonal' ELSE 'ambiguous' END AS display, CASE WHEN person IN ('1st', '2nd') THEN person ELSE 'Other' END AS person_group, CASE WHEN cell = '' THEN NULL ELSE cell END AS row_cell FROM a""")
def cell_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P02..P04, O-P32, O-P35: the encodings of a record (a known sentence stands for a polite register, a dropped pronoun for a single addressee)."""
    a = annotations(spark, sf_dir, "person", "num", "cell", "no_pronoun", "is_dropped")
    polite = F.when(F.col("no_pronoun").isNotNull(), "polite_singular")
    return a.select("id", E.register_cell(F.col("cell"), polite, F.col("is_dropped")).alias("register_cell"), E.display_label(F.col("person"), F.col("num")).alias("display"), E.language_group(F.col("person"), ["1st", "2nd"]).alias("person_group"), E.six_way(F.col("person"), F.col("num"), None).alias("row_cell"))


@query(f"""WITH {SQL_P} SELECT poem_id, CASE WHEN y BETWEEN 1000 AND 2100 THEN y END AS posted_year, CASE WHEN d >= DATE '2022-02-24' THEN 'P2_2022_plus' WHEN d >= DATE '2014-01-01' THEN 'P1_2014_2021' ELSE 'unknown' END AS period, make_date(year::BIGINT, 7, 1) AS mid_year, round(ln(greatest(0.000001, least(0.999999, sh)) / greatest(0.000001, least(0.999999, 1 - sh))), 6) AS logit FROM (SELECT poem_id, year, try_cast(nullif(regexp_extract(trim(posted), '^(\\d{{4}})(?:\\.0+)?(?:\\D|$)', 1), '') AS BIGINT) AS y, CASE WHEN regexp_matches(trim(posted), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(substr(trim(posted), 1, 10) AS DATE) END AS d, (n_stanzas - 1) / 10.0::DOUBLE AS sh FROM (SELECT DISTINCT poem_id, year, posted, n_stanzas FROM p))""")
def date_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P06 by date, O-P21, O-F19, O-F23, O-F24: years and periods of post dates, and a clipped logit."""
    p = poems(spark, sf_dir, "poem_id", "year", "posted", "n_stanzas")
    s = F.trim("posted")
    day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10)).try_cast("date")
    share = (F.col("n_stanzas") - 1) / F.lit(10.0)
    return _rounded(p.select("poem_id", E.sane_year(F.col("posted")).alias("posted_year"), E.period_by_date(day).alias("period"), temporal.mid_year(F.col("year")).alias("mid_year"), E.clipped_logit(share).alias("logit")))


@query(f"""WITH {SQL_P}, x AS (SELECT poem_id, text, string_split(text, chr(10))[1] AS l, trim(regexp_replace(text, '[{T.SPACE}]+', ' ', 'g')) AS c FROM p WHERE text IS NOT NULL) SELECT DISTINCT poem_id, CASE WHEN regexp_full_match(l, '\\s*(?:\\*\\s*){{2,}}') THEN 'asterisk' WHEN regexp_full_match(l, '\\s*[-_=]{{3,}}\\s*') THEN 'rule' WHEN regexp_full_match(l, '\\s*(?:[IVXLCDM]{{1,8}}|[ivxlcdm]{{1,8}}|\\d{{1,2}})\\.\\s*') THEN 'number' WHEN regexp_full_match(l, '\\s*(?:\\d{{1,2}}|[IVXLCDM]{{1,8}}|[ivxlcdm]{{1,8}})\\.\\s+\\S.*') THEN 'number_text' WHEN regexp_full_match(l, '\\s*\\d{{1,2}}\\.\\d{{1,2}}\\.(?:\\d{{2}}|\\d{{4}})?\\s*') THEN 'date' END AS first_line, substr(c, 1, 180) AS preview, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 48) || ' … ' || right(text, 48) END AS cut, regexp_replace(poem_id, '[^A-Za-z0-9_-]+', '_', 'g') AS slug FROM x""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F05, O-F12, O-F13, O-F16: kind of the first line, preview, middle cut and slug of each poem."""
    p = poem_texts(spark, sf_dir).filter("text is not null")
    return p.select("poem_id", T.tags(F.get(F.split("text", "\n"), F.lit(0))).alias("first_line"), T.preview(F.col("text")).alias("preview"), T.middle_cut(F.col("text"), 100).alias("cut"), T.slug(F.col("poem_id")).alias("slug"))


@query(f"WITH {SQL_A}, w AS (SELECT DISTINCT id, lower(trim(regexp_replace(pronoun, '[\\[\\]()（）]', '', 'g'))) AS k FROM a WHERE pronoun IS NOT NULL) SELECT id, k AS pronoun_key, coalesce(m.lemma, k) AS lemma, regexp_matches(k, '(^|[^а-яіїєґА-ЯІЇЄҐa-zA-Z’''-])(ви|вы|вас|вам|вами|ваш[а-яіїєґ’''-]*)($|[^а-яіїєґА-ЯІЇЄҐa-zA-Z’''-])') AS second_plural FROM w LEFT JOIN (VALUES ('мене', 'я'), ('нас', 'ми'), ('вас', 'ви')) m(form, lemma) ON form = k")
def pronoun_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F08, O-F10, O-F11: key, lemma and second-plural test of every pronoun."""
    k = T.pronoun_key(F.col("pronoun"))
    return annotations(spark, sf_dir, "pronoun").filter("pronoun is not null").select("id", k.alias("pronoun_key"), T.lemma_of(k, {"мене": "я", "нас": "ми", "вас": "ви"}).alias("lemma"), T.second_plural_form(k).alias("second_plural"))


@query(f"""WITH {_SQL_LOGIT}, m AS (SELECT median(shift) AS a, median(se) AS b, stddev_pop(shift) AS sa, stddev_pop(se) AS sb FROM sh) SELECT author, CASE WHEN shift >= a THEN 'person_up' ELSE 'person_down' END || '_' || CASE WHEN se >= b THEN 'number_up' ELSE 'number_down' END AS type, sign(shift) * sign(se) < 0 AS discordant, abs(shift - a) > sa OR abs(se - b) > sb AS extreme FROM sh, m""")
def author_typology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-P31: quadrants of two author figures (shift and its error) around their medians."""
    return qa.typology(_logit_shifts(spark, sf_dir), "shift", "se").select("author", "type", "discordant", "extreme")


@query("""SELECT lower(trim("Author of poem")) AS author, arg_min("Language", (-length("Language"), "Language")) FILTER ("Language" IS NOT NULL) AS "Language", arg_min("Is repeat", (-length("Is repeat"), "Is repeat")) FILTER ("Is repeat" IS NOT NULL) AS "Is repeat" FROM layer0_poems_one_per_row GROUP BY ALL""")
def longest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-U07: per author the longest value of each column."""
    d = table(spark, sf_dir, "layer0_poems_one_per_row").withColumn("author", F.lower(F.trim("Author of poem")))
    return cohort.longest_values(d.select("author", "Language", "Is repeat"), "author", ["Language", "Is repeat"])


@query(f"WITH {SQL_A}, f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY poem_id, sentence_id ORDER BY created_at, id) = 1) SELECT poem_id, sentence_id, id, annotator FROM f")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-U02, O-L01: the first record of each sentence."""
    return cohort.first_by(annotations(spark, sf_dir, "poem_id", "sentence_id", "annotator", "created_at"), ["poem_id", "sentence_id"], [F.col("created_at"), F.col("id")]).select("poem_id", "sentence_id", "id", "annotator")


@query(f"WITH {SQL_P}, c AS (SELECT language, author, count(DISTINCT poem_id) AS n FROM p WHERE author IS NOT NULL AND language IS NOT NULL GROUP BY ALL) SELECT language, author, n, row_number() OVER (PARTITION BY language ORDER BY n DESC, author) AS rank FROM c QUALIFY rank <= 5")
def language_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-W02, O-L06: the five authors with most poems of each language, a report."""
    c = poems(spark, sf_dir, "poem_id", "author", "language").filter("author is not null and language is not null").groupBy("language", "author").agg(F.countDistinct("poem_id").alias("n"))
    return _rounded(cohort.ranked(c, ["language"], [F.desc("n"), F.col("author")], 5))


@query(f"WITH {_SQL_DAYS}, c AS (SELECT *, (ntile((SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT FROM dy)) OVER (ORDER BY day, poem_id)) AS bin FROM dy), i AS (SELECT bin::BIGINT AS interval_id, min(day) AS s, max(day) AS e, count(*) AS n FROM c GROUP BY bin) SELECT interval_id, round(sum(n / greatest(1, date_diff('day', s, e) + 1)) OVER (ORDER BY s, e, interval_id), 6) AS axis FROM i")
def density_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-T05: cumulative poems per day over balanced intervals."""
    i = temporal.bin_intervals(temporal.balanced_bins(_days(spark, sf_dir), "poem_id", 200))
    return _rounded(temporal.density_axis(i).select("interval_id", "axis"))


@query(f"WITH {_SQL_WORDS}, g AS (SELECT DISTINCT poem_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term, stanza_index FROM w) SELECT term, count(*) AS n_units FROM g GROUP BY term HAVING count(*) >= 3")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C11: words and pairs of neighbours that occur in at least three stanzas."""
    w = _words(spark, sf_dir)
    terms = w.select("poem_id", "stanza_index", F.explode(F.array_distinct(F.concat("ws", colloc.ngrams(F.col("ws"), 2)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_units")).filter("n_units >= 3")


@query(f"""WITH {SQL_PT}, w AS (SELECT author, coalesce(sum("1sg") FILTER (period3 LIKE 'P1%'), 0)::DOUBLE AS a1, coalesce(sum("1pl") FILTER (period3 LIKE 'P1%'), 0)::DOUBLE AS b1, coalesce(sum(n_total) FILTER (period3 LIKE 'P1%'), 0)::DOUBLE AS n1, coalesce(sum("1sg") FILTER (period3 LIKE 'P2%'), 0)::DOUBLE AS a2, coalesce(sum("1pl") FILTER (period3 LIKE 'P2%'), 0)::DOUBLE AS b2, coalesce(sum(n_total) FILTER (period3 LIKE 'P2%'), 0)::DOUBLE AS n2 FROM pt WHERE author IS NOT NULL GROUP BY author),
 e AS (SELECT author, CASE WHEN a1 > 0 AND a2 > 0 AND a1 < n1 AND a2 < n2 THEN round(ln(a2 / (n2 - a2)) - ln(a1 / (n1 - a1)), 6) END AS x, CASE WHEN b1 > 0 AND b2 > 0 AND b1 < n1 AND b2 < n2 THEN round(ln(b2 / (n2 - b2)) - ln(b1 / (n1 - b1)), 6) END AS y FROM w) SELECT author, x AS estimate_logit__1sg, y AS estimate_logit__1pl FROM e WHERE x IS NOT NULL OR y IS NOT NULL""")
def author_contrast_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R04, O-R06: authors against contrasts, a column a contrast."""
    long = _cells_long(poem_table(spark, sf_dir), ["author", "period3", "n_total"]).filter("cell in ('1sg', '1pl')")
    shifts = models.cell_shifts(long, "author", "cell", "k", "n_total", "period3", E.P1, E.P2)
    return _rounded(counts.wide_results(shifts, ["author"], "cell", ["1sg", "1pl"], ["estimate_logit"]))


@query(f"WITH {SQL_A}, k AS (SELECT poem_id, sentence_id, lower(trim(regexp_replace(pronoun, '[\\[\\]()（）]', '', 'g'))) AS pronoun_key, coalesce(person, '') AS person, coalesce(num, '') AS num, annotator < 'm' AS l FROM a WHERE pronoun IS NOT NULL AND annotator IS NOT NULL), r AS (SELECT poem_id, sentence_id, pronoun_key, min({{'p': person, 'n': num}}) AS v FROM k WHERE NOT l GROUP BY ALL) SELECT k.poem_id, k.sentence_id, k.pronoun_key, person AS person_manual, num AS num_manual, v.p AS person_gpt, v.n AS num_gpt, person IS DISTINCT FROM v.p AS differs_person, num IS DISTINCT FROM v.n AS differs_num FROM k LEFT JOIN r USING (poem_id, sentence_id, pronoun_key) WHERE l AND (person IS DISTINCT FROM v.p OR num IS DISTINCT FROM v.n)".replace('{{', '{').replace('}}', '}'))
def matched_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J11, O-Q04: two sets of records (by annotator's name) matched on three normalised keys; rows that differ, a flag a field."""
    a = annotations(spark, sf_dir, "poem_id", "sentence_id", "pronoun", "person", "num", "annotator").filter("pronoun is not null").select("poem_id", "sentence_id", "pronoun", F.coalesce("person", F.lit("")).alias("person"), F.coalesce("num", F.lit("")).alias("num"), "annotator")
    keys = {"poem_id": F.col("poem_id"), "sentence_id": F.col("sentence_id"), "pronoun_key": T.pronoun_key(F.col("pronoun"))}
    return qa.disagreements(qa.match_sides(a.filter("annotator < 'm'"), a.filter("annotator >= 'm'"), keys, ["person", "num"]), ["person", "num"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg((value > 0)::INT), 6) AS p_positive, round(least(avg((value > 0)::INT), 1 - avg((value > 0)::INT)), 6) AS false_sign_risk FROM events GROUP BY event_type")
def draw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-M21, O-R05: summary of draws (values of events stand for them) per term."""
    return _rounded(models.posterior_summary(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query(f"""WITH {SQL_P}, x AS (SELECT DISTINCT ID AS poem_id, regexp_extract_all(text, '[^{T.SPACE}]+') AS a, regexp_extract_all(text_en, '[^{T.SPACE}]+') AS b FROM poems_for_manual_annotation WHERE text IS NOT NULL AND text_en IS NOT NULL), y AS (SELECT sum(len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS NOT DISTINCT FROM b[i])))::BIGINT AS same, sum(greatest(len(a), len(b)))::BIGINT AS n FROM x) SELECT same, n, round(same / n, 6) AS rate FROM y""")
def position_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-Q06: share of positions at which two token lists of a poem (text and translation) agree."""
    p = table(spark, sf_dir, "poems_for_manual_annotation").filter("text is not null and text_en is not null").groupBy("ID").agg(F.min("text").alias("text"), F.min("text_en").alias("text_en"))
    words = lambda c: F.regexp_extract_all(c, F.lit(f"[^{T.SPACE}]+"), F.lit(0))
    return _rounded(qa.agreement_rate(p.select(words("text").alias("a"), words("text_en").alias("b")), "a", "b"))
