"""Scans and sinks (O-S01..S17, O-K01..K13)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

ADJUDICATION = "parent_id string, verdict string, true_poem_count int, line_starts_zero_based string, parse_error string, error string"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, skip_bad: bool = False, comment: str | None = None) -> DataFrame:
    """CSV with header, quotes and line breaks in fields (O-S01..S04); without a schema all columns are strings."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE")
    if comment:
        r = r.option("comment", comment)
    df = (r.schema(schema) if schema else r).csv(path)
    return df.select(*columns) if columns else df


def read_optional(read: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame | None:
    """None where the file is missing (O-S10)."""
    return read() if exists(spark, path) else None


def read_required(read: Callable[[], DataFrame], spark: SparkSession, path: str, remedy: str) -> DataFrame:
    """An error that says how to make the file (O-S11)."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: {remedy}")
    return read()


def read_adjudications(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of verdicts (O-S06): broken files and missing ones are empty, rows with errors are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], ADJUDICATION)
    df = spark.read.schema(ADJUDICATION + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    keep = df.filter("_corrupt is null and parse_error is null and error is null and trim(parent_id) <> '' and coalesce(verdict, '') <> 'ambiguous' and true_poem_count is not null")
    return keep.drop("_corrupt")


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """{items: [...]} JSON or CSV, by suffix (O-S07)."""
    if path.endswith(".json"):
        return spark.read.schema(f"items array<struct<{_struct(schema)}>>").option("multiLine", True).json(path).select(F.inline("items"))
    return read_csv(spark, path, schema)


def _struct(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(",")))


def read_cache(spark: SparkSession, path: str, schema: str, nested: str) -> DataFrame:
    """JSON lines with a nested array, a row per element (O-S08)."""
    df = spark.read.schema(schema).json(path)
    return df.select(*[c for c in df.columns if c != nested], F.explode(nested).alias("_e")).select("*", "_e.*").drop("_e")


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines (O-S09); none where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def read_table(spark: SparkSession, url: str, table: str, equal: dict[str, str] | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table with equality predicates, which JDBC pushes down (O-S13)."""
    df = spark.read.jdbc(url, table, properties=properties or {})
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    return df


def read_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Workbooks need a reader that is not bundled (O-S05); raises where there is none."""
    try:
        frame = pd.read_excel(path, dtype=str)
    except ImportError as e:
        raise RuntimeError("install an Excel reader for pandas, or convert the workbook to CSV") from e
    return spark.createDataFrame(frame, schema)


def completions(df: DataFrame, text: str, client: Callable[[], Callable[[list[str]], list[str | None]]], concurrency: int = 15, retries: int = 5) -> DataFrame:
    """Adds ``completion`` and ``failure`` from a model client (O-S14, O-S15, O-I05): ``client()`` is made once a task. A batch that fails is tried again with
    growing pauses; after the last try its rows carry the error in ``failure`` and no completion, so that missing answers can be told and counted.
    At most ``concurrency`` partitions call at once, fewer where fewer cores run."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        ask = client()
        for b in batches:
            got: list[str | None] = [None] * len(b)
            failure = None
            for attempt in range(retries):
                try:
                    got, failure = ask(b[text].tolist()), None
                    break
                except Exception as e:
                    failure = f"{type(e).__name__}: {e}"
                    if attempt + 1 < retries:
                        time.sleep(min(30.0, 0.1 * 2**attempt))
            yield b[names].assign(completion=got, failure=failure)

    schema = T.StructType([*df.schema.fields, T.StructField("completion", T.StringType()), T.StructField("failure", T.StringType())])
    return df.coalesce(concurrency).mapInPandas(run, schema)


def parsed(df: DataFrame, text: str, parser: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> DataFrame:
    """Adds ``words`` from a pluggable tagger, one model a worker (O-S17)."""
    ship(df.sparkSession)
    words = T.ArrayType(T.StructType.fromDDL("id int, text string, lemma string, upos string, feats string, head int, deprel string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        for b in batches:
            yield b.assign(words=parse(b[text].tolist()))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("words", words)]))


def scored(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str]], list[tuple[float, float]]]]) -> DataFrame:
    """Adds ``sentiment``, P(positive) - P(negative), from a pluggable scorer (O-C09)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for b in batches:
            yield b.assign(sentiment=[p - n for p, n in score(b[text].tolist())])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("sentiment", T.DoubleType())]))


# ---- sinks ----


def write_csv(df: DataFrame, path: str, append: bool = False, blank: list[str] | None = None) -> None:
    """CSV with header; NULLs of ``blank`` columns become empty strings (O-K01, O-K02)."""
    out = df.fillna("", blank) if blank else df
    out.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)  # O-K03


def write_json(rows: Iterable[dict], path: str, **more: object) -> None:
    """Pretty JSON with a row count, for small reports (O-K04)."""
    rows = list(rows)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"row_count": len(rows), **more, "items": rows}, ensure_ascii=False, indent=2), encoding="utf-8")


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], backup: bool = True) -> None:
    """Replace a Parquet table by a changed one (O-K05): written beside it first, then swapped; the old one stays as .bak."""
    new = f"{path}.new-{uuid.uuid4().hex[:8]}"
    change(spark.read.parquet(path)).write.parquet(new)
    fs, p = _fs(spark, path)
    hp = lambda s: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s)
    fs.delete(hp(path + ".bak"), True)
    fs.rename(p, hp(path + ".bak"))
    fs.rename(hp(new), p)
    if not backup:
        fs.delete(hp(path + ".bak"), True)


def write_graphml(nodes: Iterable[str], edges: Iterable[tuple[str, str, float]], path: str) -> None:
    """An ego network's few nodes and edges as GraphML (O-K07)."""
    body = [f"<node id={quoteattr(n)}/>" for n in nodes] + [f"<edge source={quoteattr(a)} target={quoteattr(b)}><data key=\"weight\">{w}</data></edge>" for a, b, w in edges]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    Path(path).write_text(head + "".join(body) + "</graph></graphml>", encoding="utf-8")


def write_batches(df: DataFrame, path: str, body: dict[str, str], key: str) -> DataFrame:
    """Request lines of a batch interface as JSON text, with a manifest of keys (O-K08)."""
    lines = df.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.struct(*[F.col(c).alias(n) for n, c in body.items()]).alias("body"))).alias("value"))
    lines.write.mode("overwrite").text(path)
    return df.select(key)


def label_map(df: DataFrame, label: str) -> dict[str, int]:
    """Label -> index in alphabetical order (O-K09); labels are a category list."""
    return {r[0]: i for i, r in enumerate(df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect())}


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """Report of small result tables (O-K10)."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        cols = df.columns
        parts += [f"\n## {name}\n", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(str(v) for v in r) + " |" for r in df.collect())]
    return "\n".join(parts) + "\n"


def bibtex(df: DataFrame, line: str) -> DataFrame:
    """Entries parsed from reference lines (O-K12): key, kind and fields; equal keys keep their longest values."""
    s = F.trim(F.regexp_replace(line, r"^\s*[-*]\s*", ""))
    year, doi, url = F.regexp_extract(s, r"\((\d{4})[a-z]?\)", 1), F.regexp_extract(s, r"(10\.\d{4,}/\S+?)[.\s]*$", 1), F.regexp_extract(s, r"(https?://\S+)", 1)
    author = F.trim(F.regexp_extract(s, r"^([^(]+)\(\d{4}", 1))
    title = F.trim(F.regexp_extract(s, r"\(\d{4}[a-z]?\)\.?\s*([^.]+)", 1))
    kind = F.when(s.rlike(r"(?i)\bIn\b.*\b(?:Eds?\.|Proceedings)"), "incollection").when(s.rlike(r",\s*\d+\s*\(\d+\)"), "article").when(url != "", "misc").otherwise("book")
    key = F.concat(F.lower(F.regexp_extract(author, r"(?U)^(\w+)", 1)), year, F.lower(F.regexp_extract(title, r"(?U)(\w{4,})", 1)))
    e = df.select(key.alias("key"), kind.alias("kind"), author.alias("author"), year.alias("year"), title.alias("title"), doi.alias("doi"), url.alias("url")).filter("year <> ''")
    longest = lambda c: F.max_by(c, F.struct(F.length(c), c)).alias(c)
    return e.groupBy("key").agg(*[longest(c) for c in ("kind", "author", "year", "title", "doi", "url")])


def remove_stale(spark: SparkSession, folder: str, keep: list[str]) -> list[str]:
    """Removes what lies in an output folder and is not named in ``keep`` (O-K13); returns the names removed."""
    fs, p = _fs(spark, folder)
    stale = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName() not in keep) if fs.exists(p) else []
    for name in stale:
        fs.delete(_fs(spark, f"{folder}/{name}")[1], True)
    return stale
