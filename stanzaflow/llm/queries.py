"""The pN queries: each problem's operator over its whole intended tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import languages

    return languages.found(_table(spark, sf_dir, "poems_for_manual_annotation"))


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import languages

    return languages.stretches(_table(spark, sf_dir, "poems_for_manual_annotation"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.found(_table(spark, sf_dir, "poems_for_manual_annotation"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.groups(_table(spark, sf_dir, "poems_for_manual_annotation"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lookalike

    return lookalike.found(_table(spark, sf_dir, "poems_for_manual_annotation"), _table(spark, sf_dir, "annotations"))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lookalike

    return lookalike.canonical(_table(spark, sf_dir, "poems_for_manual_annotation"), _table(spark, sf_dir, "annotations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentences

    return sentences.found(_table(spark, sf_dir, "poems_for_manual_annotation"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentences

    return sentences.sentences(_table(spark, sf_dir, "poems_for_manual_annotation"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import consensus

    return consensus.found(_table(spark, sf_dir, "poem_perspectives"))


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import consensus

    return consensus.Consensus(consensus.judgments(_table(spark, sf_dir, "poem_perspectives"))).annotators()


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import consensus

    a = consensus.krippendorff(consensus.judgments(_table(spark, sf_dir, "poem_perspectives")))
    return a.select("items", "judgments", *[F.round(c, 8).alias(c) for c in ("pair_agreement", "krippendorff_alpha")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pack_limits"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), packing.capacity_of(_table(spark, sf_dir, "pack_limits")))


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    capacity = packing.capacity_of(_table(spark, sf_dir, "pack_limits"))
    return packing.mixture(packing.pack(_table(spark, sf_dir, "documents"), capacity), capacity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.Mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets")).report()


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.Mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets")).copies()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.found(_table(spark, sf_dir, "documents"))


def p8_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.rate(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_stretches, p2_found, p2_groups, p3_found, p3_canonical, p4_found, p4_sentences, p5_found, p5_annotators, p5_agreement, p6_found, p6_packed, p6_mixture, p7_found, p7_report, p7_copies, p8_found, p8_rated)}
#: Where SQL can tell the same on whole tables: the cases of problems 6 and 7 are the same for any tokenizer, words and characters included.
ORACLES: dict[str, str] = {
    "p5_agreement": """WITH v AS (SELECT annotator, item, arg_max(l, (created_at, id, l)) AS l FROM (SELECT lower(trim(annotator_id)) AS annotator, poem_id AS item, created_at, id, lower(regexp_replace(trim(perspective_primary), '\\s+', ' ', 'g')) AS l FROM poem_perspectives) WHERE l IN ('1st person', '2nd person', '3rd person', 'mixed', 'other') GROUP BY annotator, item),
 c AS (SELECT item, l, count(*) AS c FROM v GROUP BY item, l), u AS (SELECT item, sum(c)::DOUBLE AS m, sum(c * c)::DOUBLE AS sq FROM c GROUP BY item HAVING sum(c) > 1), s AS (SELECT count(*) AS items, sum(m) AS n, sum((m * m - sq) / (m - 1)) AS d, avg((sq - m) / (m * (m - 1))) AS pa FROM u), t AS (SELECT sum(t * t)::DOUBLE AS tsq FROM (SELECT sum(c) AS t FROM c WHERE item IN (SELECT item FROM u) GROUP BY l))
 SELECT items, n::BIGINT AS judgments, round(pa, 8) AS pair_agreement, round(1 - d / ((n * n - tsq) / (n - 1)), 8) AS krippendorff_alpha FROM s, t""",
    "p6_found": r"SELECT DISTINCT doc_id FROM documents, pack_limits WHERE len(regexp_extract_all(text, '\S+')) > capacity_tokens",
    "p7_found": "WITH t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS share, max(max_repeats) AS r FROM mix_targets GROUP BY 1), d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1) SELECT source FROM t LEFT JOIN d USING (source) WHERE share * (SELECT sum(n) FROM d WHERE source IN (SELECT source FROM t)) > coalesce(n, 0) * r",
}
