"""The views that queries share, in Spark and in SQL: cleaned annotations joined to their poems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import text as T

FOUR = ("1sg", "1pl", "2sg", "2pl")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POEM = ("poem_id", "author", "year", "language")


def _poem_column(name: str) -> F.Column:
    if name == "n_tokens":
        return T.token_count(F.col("text")).cast("bigint").alias(name)
    if name == "period3":
        return E.period_p1_p2(F.col("year")).alias(name)
    source = {"poem_id": "ID", "posted": "date"}.get(name, name)
    c = F.trim(source) if name == "language" else F.col(source).cast("bigint") if name == "n_stanzas" else F.col(source)
    return c.alias(name)


def poems(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct poems; identical rows occur. Only the columns asked for are read and compared, so the text is shuffled only where it is asked for."""
    p = table(spark, sf_dir, "poems_for_manual_annotation")
    return p.select(*map(_poem_column, columns)).distinct()


def _annotation_column(name: str) -> F.Column:
    if name == "cell":
        return E.six_way(F.trim("person"), E.number_label(F.col("number"))).alias(name)
    if name == "num":
        return E.number_label(F.col("number")).alias(name)
    if name == "annotator":
        return F.lower(F.trim("annotator_id")).alias(name)
    return (F.trim("person") if name == "person" else F.col("sentence_id").cast("bigint") if name == "sentence_id" else F.col(name)).alias(name)


def annotations(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct records, labels in one spelling: the id and the columns asked for."""
    return table(spark, sf_dir, "annotations").select("id", *[_annotation_column(c) for c in columns if c != "id"]).distinct()


def tokens(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], poem: tuple[str, ...]) -> DataFrame:
    """Records with ``columns``, joined to what ``poem`` names of their poems; records without a poem stay."""
    return annotations(spark, sf_dir, "poem_id", *columns).join(poems(spark, sf_dir, "poem_id", *poem), "poem_id", "left")


def poem_table(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Annotated poems with their four cell counts, author, language, stanzas, period and what ``more`` names."""
    from ..operators.counts import cell_table

    counts = cell_table(annotations(spark, sf_dir, "poem_id", "cell"), cells=FOUR)
    return counts.join(poems(spark, sf_dir, "poem_id", "author", "language", "n_stanzas", "period3", *more), "poem_id")


def poem_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poem_id, text): one text a poem, the least where there are several; shuffled by the id alone."""
    p = table(spark, sf_dir, "poems_for_manual_annotation")
    return p.groupBy(F.col("ID").alias("poem_id")).agg(F.min("text").alias("text"))


def stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = poem_texts(spark, sf_dir).select("poem_id", F.posexplode(F.split("text", r"\n(?:[ \t]*\n)+")).alias("i", "stanza"))
    return s.select("poem_id", (F.col("i") + 1).cast("bigint").alias("stanza_index"), "stanza")


SQL_P = """p AS (SELECT DISTINCT ID AS poem_id, author, year, "date" AS posted, temporal_period, trim(language) AS language, n_stanzas::BIGINT AS n_stanzas, text FROM poems_for_manual_annotation)"""
SQL_PERIOD = "CASE WHEN year >= 2022 THEN 'P2_2022_plus' WHEN year >= 2014 THEN 'P1_2014_2021' ELSE 'unknown' END"
SQL_A = """a AS (SELECT *, CASE WHEN person IN ('1st','2nd','3rd') AND num LIKE '%Sing%' THEN substr(person,1,1) || 'sg' WHEN person IN ('1st','2nd','3rd') AND num LIKE '%Plur%' THEN substr(person,1,1) || 'pl' ELSE '' END AS cell
 FROM (SELECT DISTINCT id, lower(trim(annotator_id)) AS annotator, poem_id, sentence_id::BIGINT AS sentence_id, no_pronoun, pronoun, lemma, trim(person) AS person,
  CASE WHEN trim("number") IN ('Sg','Sing') THEN 'Singular' WHEN trim("number") IN ('Pl','Plur') THEN 'Plural' ELSE trim("number") END AS num, is_dropped, created_at FROM annotations))"""
SQL_TOK = f"{SQL_P}, {SQL_A}, tok AS (SELECT a.*, p.author, p.year, p.language, p.n_stanzas, {SQL_PERIOD} AS period3 FROM a LEFT JOIN p USING (poem_id))"
SPACE_CLASS = T.SPACE
SQL_PT = f"""{SQL_P}, {SQL_A}, c AS (SELECT poem_id, count(*) FILTER (cell = '1sg') AS "1sg", count(*) FILTER (cell = '1pl') AS "1pl", count(*) FILTER (cell = '2sg') AS "2sg", count(*) FILTER (cell = '2pl') AS "2pl" FROM a GROUP BY poem_id),
 pt AS (SELECT c.*, "1sg" + "1pl" + "2sg" + "2pl" AS n_total, author, year, posted, language, n_stanzas, {SQL_PERIOD} AS period3, len(regexp_extract_all(text, '[^{SPACE_CLASS}]+'))::BIGINT AS n_tokens FROM c JOIN p USING (poem_id))"""
SQL_ST = SQL_P + r""", st AS (SELECT poem_id, language, year, generate_subscripts(s, 1)::BIGINT AS stanza_index, unnest(s) AS stanza FROM (SELECT poem_id, language, year, regexp_split_to_array(text, '\n(?:[ \t]*\n)+') AS s FROM p))"""
