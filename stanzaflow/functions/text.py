"""Column -> Column text functions (O-F01..F17, F28, F29) that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import segment as S

#: Everything that Python and Unicode call white space, spelled out so that other engines' patterns agree.
SPACE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = "[A-Za-zА-Яа-яЁёІіЇїЄєҐґ’'ʼ-]+"


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def strip(c: Column) -> Column:
    """Outer white space of any kind."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    """White space runs become one blank, outer ones go."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def name_key(c: Column) -> Column:
    """Author key: collapsed, lower case (O-F04)."""
    return F.lower(collapse(c))


def record_id(c: Column) -> Column:
    """Outer blanks and a spurious .0 removed; NULL gives the empty string (O-F02)."""
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0$", "$1"), F.lit(""))


def poem_count(c: Column) -> Column:
    """"3 poems" -> 3, at least 1; anything else 1 (O-F03)."""
    n = F.regexp_extract(F.lower(F.trim(c)), r"^(\d+)\s*poem", 1)
    return F.greatest(F.lit(1), F.coalesce(F.when(n != "", n).cast("int"), F.lit(1)))


def token_count(c: Column) -> Column:
    """White-space separated tokens; 0 for NULL (O-F06)."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(f"[^{SPACE}]+"), F.lit(0))), F.lit(0))


def word_list(c: Column, stop: list[str], least: int = 2) -> Column:
    """Lower-case Cyrillic and Latin words without stop words and short ones (O-F07)."""
    words = F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)
    stops = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stops, w))


def lemma_of(c: Column, lemmas: dict[str, str]) -> Column:
    """Surface form to lemma through a literal map; unknown forms stay (O-F08)."""
    table = F.create_map(*[F.lit(x) for kv in lemmas.items() for x in kv])
    return F.coalesce(table[c], c)


def features(c: Column) -> Column:
    """"A=x|B=y" -> map (O-F09)."""
    return F.str_to_map(c, F.lit(r"\|"), F.lit("="))


def pronoun_key(c: Column) -> Column:
    """Lower case without brackets, also full-width ones, and outer blanks of any kind (O-F10)."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[\[\]()（）]", ""), r"(?U)^\s+|\s+$", ""))


def second_plural_form(c: Column) -> Column:
    """Does a source form list hold a second person plural form (O-F11)?"""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.exists(words, lambda w: w.isin("ви", "вы", "вас", "вам", "вами") | w.startswith("ваш"))


def middle_cut(c: Column, most: int, marker: str = " … ") -> Column:
    """Head and tail of an over-long text around a marker (O-F12)."""
    half = (most - len(marker)) // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, half), F.lit(marker), F.right(c, F.lit(half))))


def slug(c: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(c, r"(?U)[^\w\-]+", "_"), 1, most)


def preview(c: Column, most: int = 180) -> Column:
    return F.substring(collapse(c), 1, most)


def content_keys(c: Column) -> dict[str, Column]:
    """Cache keys and a seed of a text (O-F14)."""
    return {"sha256_32": F.substring(F.sha2(c, 256), 1, 32), "sha1_16": F.substring(F.sha1(c), 1, 16), "md5_seed": F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")}


def int_list(c: Column) -> Column:
    """"0|5|9" or "0,5" -> [0, 5, 9]; parts that are no integers are dropped (O-F29)."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,]"), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: x.rlike(r"^-?\d+$")), lambda x: x.cast("int"))


def parsed_date(c: Column) -> Column:
    """ISO or dd.mm.yyyy day; anything else NULL (O-F18)."""
    s = F.trim(c)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10))
    dmy = F.when(s.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.concat_ws("-", F.regexp_extract(s, r"(\d{4})$", 1), F.lpad(F.regexp_extract(s, r"^\d+\.(\d+)\.", 1), 2, "0"), F.lpad(F.regexp_extract(s, r"^(\d+)\.", 1), 2, "0")))
    return F.coalesce(iso, dmy).try_cast("date")


def tags(c: Column) -> Column:
    """Boundary kind of a line: asterisk, rule, number, number_text, date or NULL (O-F05), by the patterns of ``segment``."""
    kinds = dict(zip(("asterisk", "rule", "number", "number_text"), (p for p, _ in S.BOUNDARIES.values()))) | {"date": rf"\s*{S.TRAILING_DATE}\s*"}
    return F.coalesce(*[F.when(c.rlike(rf"^(?:{p})$"), name) for name, p in kinds.items()])
