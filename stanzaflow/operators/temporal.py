"""Temporal binning and interval joins (O-T01..T05, O-J04, J05, O-F19..F22, O-W04, W11, W12)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise


def month_bucket(day: Column, months: int) -> Column:
    """Number of the n-month period a day lies in (O-F20)."""
    return F.floor((F.year(day) * 12 + F.month(day) - 1) / months).cast("int")


def mid_year(year: Column) -> Column:
    return F.make_date(year, F.lit(7), F.lit(1))


def years_since(day: Column, origin: str) -> Column:
    return F.datediff(F.to_date(day), F.lit(origin).cast("date")) / F.lit(365.25)


def interval_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "yyyy-MM"), F.lit(" to "), F.date_format(end, "yyyy-MM"))


def poem_days(df: DataFrame, key: str, day: str, weight: str | None = None) -> DataFrame:
    """One row per poem: its first day and its summed weight (at least 1)."""
    w = F.greatest(F.sum(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return df.filter(F.col(day).isNotNull()).groupBy(key).agg(F.min(day).alias("day"), w.alias("weight"))


def balanced_bins(poems: DataFrame, key: str, target: int, weighted: bool = False) -> DataFrame:
    """(key, day, weight, bin): chronological bins of about ``target`` poems, balanced in poems or in weight (O-T01, O-W11).

    No task ranks all poems, nor all of one day: poems are cut into ranges of (day, key) of about equal size, counts and weights of the ranges are added
    up, and a poem's rank is its range's offset plus its rank within the range."""
    w = F.col("weight") if weighted else F.lit(1.0)
    parts = int(poems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(poems.select(key, "day", "weight").repartitionByRange(parts, "day", key).withColumn("_r", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranges = cut.groupBy("_r").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))  # one row a range
    ranges = ranges.select("_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"), F.sum("n").over(whole).alias("total"), F.sum("w").over(whole).alias("total_w"))
    within = Window.partitionBy("_r").orderBy("day", key)
    p = cut.join(F.broadcast(ranges), "_r").withColumn("pos", F.col("n0") + F.row_number().over(within) - 1).withColumn("cum", F.col("w0") + F.sum(w).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    bins = F.greatest(F.lit(1), F.ceil(F.col("total") / target))
    # bins of size q + 1 come first, then bins of size q
    q, r = F.floor(F.col("total") / bins), F.col("total") % bins
    even = F.when(F.col("pos") < r * (q + 1), F.floor(F.col("pos") / (q + 1))).otherwise(r + F.floor((F.col("pos") - r * (q + 1)) / F.greatest(q, F.lit(1))))
    by_weight = F.least(bins - 1, F.greatest(F.lit(0), F.ceil(F.col("cum") * bins / F.col("total_w")) - 1))
    return p.select(key, "day", "weight", (by_weight if weighted else even).cast("int").alias("bin"))


def merge_small(counts: list[tuple[int, int]], least: int) -> dict[int, int]:
    """Bin -> merged bin: a bin below ``least`` takes in the one after it, the last one goes to the one before (O-T02)."""
    groups: list[list] = []  # [count, bins]
    for b, n in sorted(counts):
        if groups and groups[-1][0] < least:
            groups[-1][0] += n
            groups[-1][1].append(b)
        else:
            groups.append([n, [b]])
    if len(groups) > 1 and groups[-1][0] < least:
        n, bins = groups.pop()
        groups[-1][0] += n
        groups[-1][1] += bins
    return {b: i for i, (_, bins) in enumerate(groups, 1) for b in bins}


def intervals(binned: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(key with interval_id, interval table) after merging small bins. The bins are counted in Spark; their few counts are merged on the driver."""
    counts = [(r["bin"], r["n"]) for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()]
    to = merge_small(counts, least)
    spark = binned.sparkSession
    table = spark.createDataFrame(sorted(to.items()), "bin int, interval_id int")
    tagged = binned.join(F.broadcast(table), "bin")  # one row a bin
    info = tagged.groupBy("interval_id").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count(F.lit(1)).alias("n_poems"), F.sum("weight").alias("n_weight"))
    return tagged, info.withColumn("interval_label", interval_label(F.col("start_date"), F.col("end_date")))


def bin_intervals(binned: DataFrame) -> DataFrame:
    """(interval_id, start_date, end_date, n_poems, n_weight): runs of equal bins in order of days (O-W12). Bins rise with the days, so a run is a bin; numbers
    start at 1 and leave nothing out."""
    runs = binned.groupBy("bin").agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"), F.count(F.lit(1)).alias("n_poems"), F.sum("weight").alias("n_weight"))
    return runs.withColumn("interval_id", F.row_number().over(Window.orderBy("bin"))).drop("bin")  # one row a bin


def adaptive_bins(poems: DataFrame, key: str, months: int = 2, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Calendar bins of n months, merged to at least ``least`` poems (O-T03)."""
    return intervals(poems.select(key, "day", "weight", month_bucket(F.col("day"), months).alias("bin")), least)


def interval_join(df: DataFrame, day: str, table: DataFrame, months: int = 1) -> DataFrame:
    """Rows with the first interval that holds their day, ends included (O-J05). Both sides meet in buckets of ``months`` months, whose few intervals are
    gathered on the small side, so a row meets one row of the other side: an equi-join however many intervals there are, without a shuffle after it. A row
    in several intervals keeps the least id."""
    span = F.sequence(month_bucket(F.col("start_date"), months), month_bucket(F.col("end_date"), months))
    spread = table.select(F.explode(span).alias("_b"), F.struct("interval_id", "start_date", "end_date").alias("i")).groupBy("_b").agg(F.sort_array(F.collect_list("i")).alias("_i"))
    d = F.to_date(day)
    met = df.withColumn("_b", month_bucket(d, months)).join(spread, "_b")
    first = F.get(F.filter("_i", lambda i: (i["start_date"] <= d) & (d <= i["end_date"])), F.lit(0))
    return met.withColumn("interval_id", first["interval_id"]).filter("interval_id is not null").drop("_b", "_i")


def break_terms(day: Column, cuts: dict[str, str], origin: str) -> dict[str, Column]:
    """Time since the origin, a step and years since each cut, for segmented regressions (O-F22)."""
    out = {"t": years_since(day, origin)}
    for name, cut in cuts.items():
        out[f"step_{name}"] = (F.to_date(day) >= F.lit(cut).cast("date")).cast("int")
        out[f"since_{name}"] = F.greatest(F.lit(0.0), years_since(day, cut))
    return out


def bspline_basis(x: Column, knots: list[float], degree: int = 3) -> list[Column]:
    """B-spline basis columns on frozen knots (O-M17): the same basis serves fit and prediction."""
    t = [knots[0]] * degree + list(knots) + [knots[-1]] * degree
    last = len(t) - degree - 2
    b = [F.when((x >= t[i]) & ((x < t[i + 1]) | ((x == t[i + 1]) & F.lit(i == last))), 1.0).otherwise(0.0) if t[i] < t[i + 1] else F.lit(0.0) for i in range(len(t) - 1)]
    for k in range(1, degree + 1):
        b = [
            (b[i] * (x - t[i]) / (t[i + k] - t[i]) if t[i + k] > t[i] else F.lit(0.0)) + (b[i + 1] * (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) if t[i + k + 1] > t[i + 1] else F.lit(0.0))
            for i in range(len(b) - 1)
        ]
    return b


def density_axis(days: DataFrame) -> DataFrame:
    """Cumulative poems per day over all intervals, the spacing of a density axis (O-T05); one row an interval."""
    w = Window.orderBy("start_date", "end_date", "interval_id").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("axis", F.sum(F.col("n_poems") / F.greatest(F.lit(1), F.datediff("end_date", "start_date") + 1)).over(w))


def empty_bins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "interval_id int, start_date date, end_date date, n_poems bigint")


def bins_needed(n: int, target: int) -> int:
    return max(1, math.ceil(n / max(1, target)))
