"""Annotation checks, agreement and rule labels (O-Q01..Q11, O-M25, O-P28, P30, P31, O-J11, J12)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Pronoun forms of the second person plural, and the rule names in the order they are checked.
SECOND_PLURAL = ("ви", "вы", "вас", "вам", "вами")


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else OK; a NULL condition does not hold (O-Q01)."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules], F.lit("OK"))


def annotation_rules(pronoun: Column, person: Column, number: Column, dropped: Column, no_pronoun: Column) -> list[tuple[str, Column]]:
    """Consistency rules of an annotation row."""
    said = F.coalesce(F.trim(pronoun), F.lit("")) != ""
    key = T.pronoun_key(pronoun)
    return [
        ("INCONSISTENT: pronoun in a sentence without pronoun", no_pronoun & said),
        ("INCONSISTENT: no pronoun", ~F.coalesce(no_pronoun, F.lit(False)) & ~said),
        ("INCONSISTENT: person missing", said & person.isNull()),
        ("INCONSISTENT: number missing", said & person.isin("1st", "2nd", "3rd") & (number.isNull() | number.isin("None", ""))),
        ("INCONSISTENT: second plural form with another person", key.isin(*SECOND_PLURAL) & (person != "2nd")),
        ("INCONSISTENT: dropped without brackets", dropped & said & ~pronoun.rlike(r"[(（\[]")),
    ]


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n) (O-Q02)."""
    return df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, 0 where undefined (O-Q03): one pass over the confusion counts."""
    c = confusion(df, truth, guess)
    sides = c.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select("s.*")
    t = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    t = t.withColumn("precision", over("hit", "guessed")).withColumn("recall", over("hit", "support"))
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.select("label", "precision", "recall", f.alias("f1"), "support")


def disagreements(df: DataFrame, fields: list[str], a: str = "_manual", b: str = "_gpt") -> DataFrame:
    """Rows in which any field differs, with a flag per field (O-Q04)."""
    flags = {f"differs_{f}": ~F.col(f + a).eqNullSafe(F.col(f + b)) for f in fields}
    return df.withColumns(flags).filter(functools.reduce(Column.__or__, [F.col(c) for c in flags]))


def match_sides(left: DataFrame, right: DataFrame, keys: dict[str, Column], values: list[str]) -> DataFrame:
    """Left join of two annotation sets on normalised keys, values suffixed _manual and _gpt (O-J11). The right side keeps one row a key."""
    a = left.select(*[e.alias(k) for k, e in keys.items()], *[F.col(v).alias(f"{v}_manual") for v in values])
    b = right.groupBy(*[e.alias(k) for k, e in keys.items()]).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, *[F.col(f"_v.{v}").alias(f"{v}_gpt") for v in values])
    return a.join(b, list(keys), "left")


def label_conflicts(df: DataFrame, context: list[str], label: str) -> DataFrame:
    """Contexts with several labels: (context, labels, n_rows) (O-J12, O-Q05). An aggregate finds what a self join would, without pairs."""
    g = df.filter(F.col(label).isNotNull()).groupBy(*context).agg(F.sort_array(F.collect_set(label)).alias("labels"), F.count(F.lit(1)).alias("n_rows"))
    return g.filter(F.size("labels") > 1)


def krippendorff(votes: DataFrame, unit: list[str], label: str) -> DataFrame:
    """Nominal alpha over (unit, label) rows (O-M25) from coincidence sums: (units, judgments, alpha)."""
    per = votes.filter(F.col(label).isNotNull()).groupBy(*unit, label).agg(F.count(F.lit(1)).alias("c"))
    units = per.groupBy(*unit).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("m > 1")
    seen = units.agg(F.count(F.lit(1)).alias("units"), F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    t = per.join(units.select(*unit), unit, "left_semi").groupBy(label).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tsq"))
    e = (F.col("n") * F.col("n") - F.col("tsq")) / (F.col("n") - 1)
    return seen.crossJoin(t).select("units", F.col("n").alias("judgments"), F.when(e > 0, 1 - F.col("d") / e).alias("alpha"))  # one row each


def agreement_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of positions at which two equally long arrays agree, over all rows (O-Q06)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.agg(F.sum(same).alias("same"), F.sum(F.greatest(F.size(a), F.size(b))).alias("n")).withColumn("rate", F.when(F.col("n") > 0, F.col("same") / F.col("n")))


def incomplete(units: DataFrame, done: DataFrame, unit: list[str], group: str) -> DataFrame:
    """Per group how many units are, and are not, annotated (O-Q11)."""
    d = done.select(*unit).distinct().withColumn("_d", F.lit(1))
    j = units.select(group, *[u for u in unit if u != group]).distinct().join(d, unit, "left")
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("n_units"), F.count("_d").alias("n_done")).withColumn("complete", F.col("n_units") == F.col("n_done"))


def exclusion_audit(df: DataFrame, by: list[str], gates: dict[str, Column]) -> DataFrame:
    """Rows left after each gate in turn, per group (O-Q09, O-P25)."""
    held, aggs = F.lit(True), [F.count(F.lit(1)).alias("n_start")]
    for name, gate in gates.items():
        held = held & F.coalesce(gate, F.lit(False))
        aggs.append(F.sum(held.cast("bigint")).alias(f"n_{name}"))
    return df.groupBy(*by).agg(*aggs)


def report(df: DataFrame, label: str, confidence: str | None = None) -> DataFrame:
    """Counts, percentages and mean confidence of labels (O-Q10)."""
    every = df.agg(F.count(label).alias("all"))
    c = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), *([F.avg(confidence).alias("mean_confidence")] if confidence else []))
    return c.crossJoin(every).withColumn("pct", 100 * F.col("n") / F.col("all")).drop("all")


def lexicon_label(text: Column, lexicon: dict[str, list[str]], other: str = "unspecified") -> Column:
    """The first label one of whose markers occurs as a word beginning (O-P28); one alternation per label."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(other)
    for label, markers in reversed(list(lexicon.items())):
        out = F.when(t.rlike(r"(?U)\b(?:" + "|".join(markers) + ")"), label).otherwise(out)
    return out


def after_preposition(text: Column, pronoun: Column, prepositions: list[str]) -> Column:
    """Does the row's own pronoun follow a preposition in its text (O-F17)? The pattern is an expression of the row."""
    quoted = F.concat(F.lit(r"(?iU)\b(?:" + "|".join(prepositions) + r")\s+\Q"), pronoun, F.lit(r"\E\b"))
    return F.when(pronoun.isNotNull() & (pronoun != ""), F.regexp_like(F.coalesce(text, F.lit("")), quoted)).otherwise(False)


def dropped_subject(feats: Column) -> tuple[Column, Column]:
    """(person, number) that a verb's features imply for a dropped subject; past tense leaves the person open (O-P30)."""
    f = F.str_to_map(F.coalesce(feats, F.lit("")), F.lit(r"\|"), F.lit("="))
    person = F.when(f["Person"].isin("1", "2", "3"), F.element_at(F.array(F.lit("1st"), F.lit("2nd"), F.lit("3rd")), f["Person"].cast("int")))
    number = F.when(f["Number"] == "Sing", "Singular").when(f["Number"] == "Plur", "Plural")
    return person, number


def typology(df: DataFrame, person: str, number: str) -> DataFrame:
    """Quadrant of two author contrasts around the medians, with discordance and extremity (O-P31)."""
    m = df.agg(F.median(person).alias("_mp"), F.median(number).alias("_mn"), F.stddev_pop(person).alias("_sp"), F.stddev_pop(number).alias("_sn"))
    j = df.crossJoin(m)  # one row
    side = lambda c, mid, up, down: F.when(F.col(c) >= F.col(mid), up).otherwise(down)
    far = (F.abs(F.col(person) - F.col("_mp")) > F.col("_sp")) | (F.abs(F.col(number) - F.col("_mn")) > F.col("_sn"))
    return j.withColumn("type", F.concat_ws("_", side(person, "_mp", "person_up", "person_down"), side(number, "_mn", "number_up", "number_down"))).withColumn("discordant", F.signum(person) * F.signum(number) < 0).withColumn("extreme", far).drop("_mp", "_mn", "_sp", "_sn")


def sentence_windows(df: DataFrame, text: str, context: str, size: int = 2) -> DataFrame:
    """Adds context_-2 .. context_+2: the sentences (cut at full stops) around the one that equals ``context``, else the first that holds it or lies in it
    (O-W09, O-G14); empty strings outside the text or where nothing fits."""
    blank = F.lit(" \t\r\n")
    sentences = F.filter(F.transform(F.split(text, r"\."), lambda x: F.btrim(x, blank)), lambda x: x != "")
    at = F.btrim(F.col(context), blank)
    loose = F.array_position(F.transform(sentences, lambda x: F.contains(x, at) | F.contains(at, x)), True)
    exact = F.array_position(sentences, at)
    here = F.coalesce(F.when(exact > 0, exact).when(loose > 0, loose), F.lit(-size)).cast("int")
    near = lambda i: F.when((here > 0) & (here + i > 0), F.try_element_at(sentences, F.when(here + i > 0, here + i).otherwise(1)))
    return df.withColumns({f"context_{i:+d}": F.coalesce(near(i), F.lit("")) for i in range(-size, size + 1)})


def token_windows(marks: DataFrame, texts: DataFrame, key: str, id_: str, position: str, text: str, size: int = 5) -> DataFrame:
    """(id, window): the tokens up to ``size`` before and after each marked position (from 0) of its text, joined by blanks (O-W10). Marks are gathered
    per text first, so a text is moved once however many marks it has."""
    mine = marks.filter(F.col(position).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(id_, position)).alias("_m"))
    words = texts.select(key, F.regexp_extract_all(text, F.lit(f"[^{T.SPACE}]+"), F.lit(0)).alias("_w"))
    each = words.join(mine, key).select("_w", F.explode("_m").alias("m"))
    first = F.greatest(F.lit(0), F.col(f"m.{position}") - size)
    last = F.least(F.size("_w"), F.col(f"m.{position}") + size + 1)
    return each.select(F.col(f"m.{id_}").alias(id_), F.array_join(F.when(last > first, F.slice("_w", first + 1, F.greatest(last - first, F.lit(0)))).otherwise(F.array().cast("array<string>")), " ").alias("window"))


def merged_detections(df: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """Several arrays of detections as rows with their fields as columns and a ``method`` naming the array (O-R02); rows without any stay once."""
    def tagged(method: str, c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c])), lambda d: F.struct(d.alias("d"), F.lit(method).alias("method")))

    return df.select(*keys, F.explode_outer(F.concat(*[tagged(m, c) for m, c in lists.items()])).alias("e")).select(*keys, "e.method", "e.d.*")
