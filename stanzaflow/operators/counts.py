"""Counts, exposures, modes, crosstabs and reshaping (O-A01..A34, O-R01..R06, O-J02, J13, J17, J18, O-M01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import text as T

Z95 = 1.959963984540054


def cell_table(tokens: DataFrame, key: str = "poem_id", cell: str = "cell", cells: tuple[str, ...] = E.FREQUENTIST_CELLS, total: tuple[str, ...] | None = None) -> DataFrame:
    """Poem x cell counts with zeros, and their total (O-A02, O-A03); the cells are given, so no job looks for them."""
    out = tokens.groupBy(key).pivot(cell, list(cells)).agg(F.count(F.lit(1)))
    out = out.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in cells])
    return out.withColumn("n_total", sum((F.col(f"`{c}`") for c in (total or cells)), F.lit(0)))


def stanza_exposure(stanzas: DataFrame, key: str = "poem_id", index: str = "stanza_index", text: str = "text", order: list[str] | None = None, verbs: DataFrame | None = None) -> DataFrame:
    """Two levels: tokens of each stanza's first text (in ``order``; NULL texts do not count as one), then sums, bounds and index gaps per poem (O-A05,
    O-A06). ``verbs`` holds (key, index, n_finite_verbs, ...): its counts are joined by both and added up, 0 where a stanza has none (O-J02)."""
    n = T.token_count(F.col(text))
    rank = F.when(F.col(text).isNotNull(), F.struct(*(order or [text])))
    each = stanzas.filter(F.col(index).isNotNull()).groupBy(key, index).agg(F.coalesce(F.min_by(n, rank), F.lit(0)).alias("n"))
    more = [c for c in verbs.columns if c not in (key, index)] if verbs is not None else []
    if verbs is not None:
        each = each.join(verbs, [key, index], "left").fillna(0, more)
    out = each.groupBy(key).agg(
        F.count(F.lit(1)).alias("exposure_n_stanzas"), F.max(index).alias("exposure_n_stanza_index_max"), F.sum("n").alias("exposure_n_tokens"),
        F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), *[F.sum(c).alias(f"exposure_{c}") for c in more])
    return out.withColumn("has_index_gap", F.col("exposure_n_stanzas") != F.col("exposure_n_stanza_index_max"))


def first_known(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Each column's first non-NULL value in ``order`` (O-A04)."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def mode_with_order(df: DataFrame, keys: list[str], value: str, preferred: list[str]) -> DataFrame:
    """The most frequent value; ties go by preference, then alphabet (O-A11, O-A12). Two aggregates, no window."""
    counted = df.filter(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(*keys, F.trim(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    pos = F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("value"))
    pos = F.when(pos == 0, len(preferred) + 1).otherwise(pos)
    return counted.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("n"), pos, "value")).alias("mode"), F.max("n").alias("n_mode"), F.sum("n").alias("n"))


def top_two(df: DataFrame, key: str, value: str, preferred: list[str], second_share: float = 0.30) -> DataFrame:
    """Most frequent label, the second if it has its share, and the first one's share (O-A13)."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    pos = F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col(value))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.when(pos == 0, 999).otherwise(pos).alias("p"), F.col(value).alias("v"))))  # one entry a label
    out = counted.groupBy(key).agg(ranked.alias("r"), F.sum("n").alias("n"))
    share = lambda i: -F.get(F.col("r"), F.lit(i))["m"] / F.col("n")
    return out.select(key, F.col("r")[0]["v"].alias("primary"), F.when(share(1) >= second_share, F.get(F.col("r"), F.lit(1))["v"]).alias("secondary"), share(0).alias("confidence"), "n")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long crosstab with counts and percentages within columns (O-A16)."""
    n = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def dense(df: DataFrame, a: DataFrame, b: DataFrame, values: list[str]) -> DataFrame:
    """All combinations of two small dimensions, missing values 0 (O-J18, O-A17): the dimensions are category lists."""
    grid = a.distinct().crossJoin(b.distinct())
    out = grid.join(df, [*a.columns, *b.columns], "left")
    return out.select(*a.columns, *b.columns, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def wilson_low(k: Column, n: Column, z: float = Z95) -> Column:
    """Lower bound of a proportion in percent; NULL for no trials (O-M01)."""
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, 100 * F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)))


def share_table(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Share of rows with a flag, with its Wilson bound (O-A08, O-A18)."""
    out = df.groupBy(*by).agg(F.sum(F.coalesce(flag.cast("int"), F.lit(0))).alias("k"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", 100 * F.col("k") / F.col("n")).withColumn("wilson_low_pct", wilson_low(F.col("k"), F.col("n")))


def quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact quartiles, mean and the shares of zeros and ones (O-A09, O-A10)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.avg((F.col(value) == 0).cast("int")).alias("share_zero"), F.avg((F.col(value) == 1).cast("int")).alias("share_one"), F.count(value).alias("n"))
    return out.select(*by, F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "mean", "sd", "share_zero", "share_one", "n")


def long_cells(table: DataFrame, cells: dict[str, tuple[int, int]], keep: list[str]) -> DataFrame:
    """Wide cells to rows with person and number codes, trials and proportion (O-R01). ``cells``: name -> (person, number)."""
    total = sum(F.col(f"`{c}`") for c in cells)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(p).alias("person"), F.lit(n).alias("number"), F.col(f"`{c}`").alias("k")) for c, (p, n) in cells.items()]))
    out = table.withColumn("n", total).filter("n > 0").select(*keep, "n", rows.alias("r")).select(*keep, "r.*", "n")
    return out.withColumn("y", F.col("k") / F.col("n"))


def trials(df: DataFrame, keep: list[str], k: str = "k", n: str = "n") -> DataFrame:
    """k successes and n - k failures, a row each (O-R03)."""
    ones = F.concat(F.array_repeat(F.lit(1), F.col(k).cast("int")), F.array_repeat(F.lit(0), (F.col(n) - F.col(k)).cast("int")))
    return df.select(*keep, F.explode(ones).alias("y"))


def ratios(table: DataFrame, key: str, pairs: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Successes, trials and proportion of named cell groups (D11, O-F31)."""
    add = lambda cs: sum(F.col(f"`{c}`") for c in cs)
    cols = []
    for name, (num, den) in pairs.items():
        cols += [add(num).alias(f"{name}_k"), add(den).alias(f"{name}_n"), E.safe_ratio(add(num), add(den)).alias(f"{name}_p")]
    return table.select(key, *cols)


def rate_per(df: DataFrame, by: list[str], k: str, exposure: str) -> DataFrame:
    """Sum of counts over sum of exposure (O-A19, O-A20)."""
    out = df.groupBy(*by).agg(F.sum(k).alias("k"), F.sum(exposure).alias("exposure"))
    return out.withColumn("rate", E.safe_ratio(F.col("k"), F.col("exposure")))


def joined_text(df: DataFrame, key: str, index: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Texts of a key in order of their index (O-A21, O-A22); a key here is a poem, whose stanzas fit a row."""
    rows = F.sort_array(F.collect_list(F.struct(index, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[text]), sep).alias("text"), F.count(F.lit(1)).alias("n_parts"))


def top_share(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n largest groups, all of them combined, and the rest, with shares (O-A26)."""
    c = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), by).limit(n)
    every = c.agg(F.sum("n").alias("all"))
    one = top.select(F.col(by).alias("label"), "n")
    both = one.unionByName(top.agg(F.sum("n").alias("n")).select(F.lit("top_combined").alias("label"), "n"))
    rest = top.agg(F.sum("n").alias("t")).crossJoin(every).select(F.lit("rest").alias("label"), (F.col("all") - F.col("t")).alias("n"))
    return both.unionByName(rest).crossJoin(every).select("label", "n", (100 * F.col("n") / F.col("all")).alias("pct"))


def wide_results(df: DataFrame, keys: list[str], variant: str, variants: list[str], values: list[str]) -> DataFrame:
    """Result rows to one row with value__variant columns (O-A30, O-R04, O-R06)."""
    at = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c))).alias(f"{c}__{v}")
    return df.groupBy(*keys).agg(*[at(v, c) for v in variants for c in values])


def pct_deltas(df: DataFrame, group: str, period: str, value: str, before: str, after: str) -> DataFrame:
    """Mean shares before and after, and the difference (O-A23)."""
    m = lambda p: F.avg(F.when(F.col(period) == p, F.col(value)))
    return df.groupBy(group).agg(m(before).alias("mean_before"), m(after).alias("mean_after")).withColumn("delta", F.col("mean_after") - F.col("mean_before"))


def composition(df: DataFrame, by: list[str], cells: list[str], author: str = "author") -> DataFrame:
    """Shares of each cell in all counts of a group, weighted by tokens, with its authors and poems (O-A24); groups without counts are left out."""
    total = sum(F.sum(f"`{c}`") for c in cells)
    out = df.groupBy(*by).agg(F.countDistinct(author).alias("n_authors"), F.count(F.lit(1)).alias("n_poems"), total.alias("n"), *[F.sum(f"`{c}`").alias(f"_{c}") for c in cells])
    return out.filter("n > 0").select(*by, "n_authors", "n_poems", *[(F.col(f"`_{c}`") / F.col("n")).alias(f"share_{c}") for c in cells])


def level_counts(df: DataFrame, column: str, last: str = "missing") -> DataFrame:
    """(level, n, position): values by frequency then alphabet, blank and unknown ones as ``last`` at the end (O-A34)."""
    v = F.trim(F.coalesce(F.col(column), F.lit("")))
    level = F.when(F.lower(v).isin("", "unknown", "nan"), last).otherwise(v)
    c = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("position", F.row_number().over(Window.orderBy(F.col("level") == last, F.desc("n"), "level")))  # one row a level


def pivot_sums(df: DataFrame, row: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Sum and mean of a value per row and named column (O-A31)."""
    at = lambda f, v: f(F.when(F.col(column) == v, F.col(value)))
    return df.groupBy(*row).agg(*[at(f, v).alias(f"{n}_{v}") for v in values for n, f in (("sum", F.sum), ("mean", F.avg))])


def positive_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of specifications with a positive estimate (O-A32); missing estimates do not count."""
    return df.groupBy(*by).agg(F.count(value).alias("n_specs"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))


def in_order(df: DataFrame, preferred: list[str], value: str, *rest: Column) -> DataFrame:
    """Rows numbered from 1: preferred values first and in their order, the others after them, without case (O-L14, O-L15, O-W03). For category
    and result tables: all rows are numbered together."""
    first = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(value))
    order = [F.when(first > 0, first).otherwise(len(preferred) + 1), *rest, F.lower(value), F.col(value)]
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))
