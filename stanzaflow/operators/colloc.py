"""Corpus-linguistic measures and graphs (O-C01..C05, O-C11, O-C12, O-J13..J15, O-K07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contexts(parsed: DataFrame, words: str, keep: list[str], cells: dict[str, str]) -> DataFrame:
    """A row per pronoun with its cell, relation and head from parsed words (O-C01, O-J14). ``cells``: lemma -> cell."""
    table = F.create_map(*[F.lit(x) for kv in cells.items() for x in kv])
    w = F.explode(words).alias("w")
    out = parsed.select(*keep, words, w).withColumn("cell", table[F.lower(F.col("w.lemma"))]).filter("cell is not null")
    head = F.filter(F.col(words), lambda x: x["id"] == F.col("w.head"))
    head = F.when(F.size(head) > 0, F.get(head, F.lit(0)))
    return out.select(*keep, F.lower("w.lemma").alias("pronoun_lemma"), F.col("w.text").alias("pronoun_form"), "cell", F.col("w.deprel").alias("deprel"), F.lower(head["lemma"]).alias("head_lemma"), head["upos"].alias("head_upos"))


def finite(word: Column, imperatives: bool = True) -> Column:
    """Is a parsed word a finite verb (O-P29)?"""
    f = F.str_to_map(F.coalesce(word["feats"], F.lit("")), F.lit(r"\|"), F.lit("="))
    yes = word["upos"].isin("VERB", "AUX") & (F.coalesce(f["VerbForm"], F.lit("")) == "Fin")
    return yes if imperatives else yes & (F.coalesce(f["Mood"], F.lit("")) != "Imp")


def finite_counts(parsed: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """Finite verbs per row, with and without imperatives, from one parse (O-C12)."""
    n = lambda imp: F.size(F.filter(F.col(words), lambda w: finite(w, imp)))
    return parsed.select(*keep, F.size(words).alias("n_tokens"), n(True).alias("n_finite_verbs"), n(False).alias("n_finite_verbs_excl_imperative"))


def g2(o11: Column, r1: Column, c1: Column, n: Column) -> Column:
    """Log-likelihood of a 2 x 2 table from a cell and its margins; empty cells add nothing."""
    term = lambda o, e: F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)
    o12, o21 = r1 - o11, c1 - o11
    o22 = n - r1 - c1 + o11
    return 2 * (term(o11, r1 * c1 / n) + term(o12, r1 * (n - c1) / n) + term(o21, (n - r1) * c1 / n) + term(o22, (n - r1) * (n - c1) / n))


def measures(pairs: DataFrame, slice_by: list[str], cell: str, head: str) -> DataFrame:
    """Co-occurrence counts with log-Dice, PMI and G2 within each slice (O-C02). Margins are aggregates joined back, not windows."""
    n = pairs.filter(F.col(cell).isNotNull() & F.col(head).isNotNull()).groupBy(*slice_by, cell, head).agg(F.count(F.lit(1)).alias("f"))
    fc = n.groupBy(*slice_by, cell).agg(F.sum("f").alias("f_cell"))
    fh = n.groupBy(*slice_by, head).agg(F.sum("f").alias("f_head"))
    fs = n.groupBy(*slice_by).agg(F.sum("f").alias("f_slice"))
    j = n.join(fc, [*slice_by, cell]).join(fh, [*slice_by, head]).join(fs, slice_by)
    x = {c: F.col(c).cast("double") for c in ("f", "f_cell", "f_head", "f_slice")}
    return j.withColumn("log_dice", 14 + F.log2(2 * x["f"] / (x["f_cell"] + x["f_head"]))).withColumn("pmi", F.log2(x["f"] * x["f_slice"] / (x["f_cell"] * x["f_head"]))).withColumn("g2", g2(x["f"], x["f_cell"], x["f_head"], x["f_slice"]))


def period_change(pairs: DataFrame, by: list[str], cell: str, head: str, period: str, before: str, after: str, least: int = 5) -> DataFrame:
    """PMI difference between periods and G2 of the head's share in the cell (O-C03, O-P37); eps 1e-12 stands for an absent count."""
    pick = lambda p: F.sum((F.col(period) == p).cast("bigint"))
    n = pairs.filter(F.col(period).isin(before, after) & F.col(cell).isNotNull() & F.col(head).isNotNull()).groupBy(*by, cell, head).agg(pick(before).alias("f1"), pick(after).alias("f2"))
    named = lambda p: [F.sum("f1").alias(f"{p}1"), F.sum("f2").alias(f"{p}2")]
    j = n.join(n.groupBy(*by, cell).agg(*named("c")), [*by, cell]).join(n.groupBy(*by, head).agg(*named("h")), [*by, head])
    j = j.join(n.groupBy(*by).agg(*named("s")), by) if by else j.crossJoin(n.agg(*named("s")))
    eps = F.lit(1e-12)
    pmi = lambda i: F.log2((F.col(f"f{i}") + eps) * F.col(f"s{i}") / (F.col(f"c{i}") * F.col(f"h{i}") + eps))
    d = lambda c: F.col(c).cast("double")
    out = j.filter(F.col("f1") + F.col("f2") >= least).withColumn("delta_pmi", pmi(2) - pmi(1))
    return out.withColumn("g2", g2(d("f2"), d("c2"), d("f1") + d("f2"), d("c1") + d("c2"))).select(*by, cell, head, "f1", "f2", "delta_pmi", "g2")


def cooccurrence(df: DataFrame, unit: list[str], words: str, least: int = 2) -> DataFrame:
    """(a, b, n), a < b: units in which both words occur (O-C04, O-J13). Words of fewer than ``least`` units are left out first, as no pair of
    theirs can reach it; pairs are made within the unit's own array, so no join and no gathering is needed."""
    seen = df.select(*unit, F.explode(F.array_distinct(words)).alias("w"))
    common = seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("w")
    kept = seen.join(common, "w", "left_semi").groupBy(*unit).agg(F.sort_array(F.collect_list("w")).alias("ws"))  # a unit is a sentence or stanza
    pairs = kept.select(F.explode(F.flatten(F.transform("ws", lambda x, i: F.transform(F.slice("ws", i + 2, F.greatest(F.lit(0), F.size("ws") - i - 1)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def edge_dice(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """Pairs with log-Dice from word frequencies (w, n)."""
    fa, fb = freq.select(F.col("w").alias("a"), F.col("n").alias("fa")), freq.select(F.col("w").alias("b"), F.col("n").alias("fb"))
    return pairs.join(fa, "a").join(fb, "b").withColumn("log_dice", 14 + F.log2(2 * F.col("n") / (F.col("fa") + F.col("fb")).cast("double")))


def focal_pairs(df: DataFrame, words: str, focal: list[str], least: int) -> DataFrame:
    """(focal, neighbour, n): units that hold a focal word and another word (O-C05). Units without a focal word leave before anything is paired."""
    ws = F.array_distinct(words)
    mine = df.select(ws.alias("ws"), F.array_intersect(ws, F.array(*[F.lit(f) for f in focal])).alias("fs")).filter(F.size("fs") > 0)
    met = mine.select("ws", F.explode("fs").alias("focal")).select("focal", F.explode("ws").alias("neighbour")).filter("focal <> neighbour")
    return met.groupBy("focal", "neighbour").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def ego(pairs: DataFrame, freq: DataFrame, k: int) -> DataFrame:
    """The k nearest neighbours of each focal word by log-Dice (O-C05, O-L05) from its pairs and the word frequencies (w, n)."""
    f = freq.join(pairs.select(F.col("focal").alias("w")).distinct(), "w", "left_semi").select(F.col("w").alias("focal"), F.col("n").alias("ff"))
    scored = pairs.join(freq.select(F.col("w").alias("neighbour"), F.col("n").alias("fn")), "neighbour").join(f, "focal")
    scored = scored.select("focal", "neighbour", "n", (14 + F.log2(2 * F.col("n") / (F.col("ff") + F.col("fn")).cast("double"))).alias("log_dice"))
    w = Window.partitionBy("focal").orderBy(F.desc("log_dice"), F.desc("n"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def second_order(df: DataFrame, unit: list[str], words: str, ego_edges: DataFrame, least: int) -> DataFrame:
    """(a, b, n) among the ego network's own nodes (O-C05): only their words are paired; nodes are focal words x (k + 1) at most."""
    nodes = ego_edges.select(F.explode(F.array("focal", "neighbour")).alias("w")).distinct()
    seen = df.select(*unit, F.explode(F.array_distinct(words)).alias("w")).join(nodes, "w", "left_semi")
    return cooccurrence(seen.groupBy(*unit).agg(F.collect_list("w").alias("_ws")), unit, "_ws", least)


def shared_vocabulary(df: DataFrame, word: str, period: str, before: str, after: str, least: int) -> DataFrame:
    """(word, n_before, n_after): words met at least ``least`` times in both periods (O-J15, O-U04). One aggregate finds what an intersection of two
    vocabularies joined to their counts would."""
    n = lambda p: F.sum((F.col(period) == p).cast("bigint"))
    return df.groupBy(word).agg(n(before).alias("n_before"), n(after).alias("n_after")).filter((F.col("n_before") >= least) & (F.col("n_after") >= least))


def ngrams(words: Column, n: int) -> Column:
    """n-grams of a word array, joined by blanks (O-C11)."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def topics(df: DataFrame, key: str, words: str, k: int = 10, least: int = 3, terms: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key with its leading topic and weight, topic labels) from words and their pairs (O-C10, O-C11). Spark has no density clustering of
    sentence embeddings; latent Dirichlet allocation over terms of at least ``least`` documents stands in, labelled by its leading terms."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    both = df.select(key, F.concat(F.col(words), ngrams(F.col(words), 2)).alias("_t"))
    counted = CountVectorizer(inputCol="_t", outputCol="_v", minDF=float(least)).fit(both)
    model = LDA(featuresCol="_v", k=k, seed=seed, maxIter=10).fit(counted.transform(both))
    share = model.transform(counted.transform(both)).select(key, vector_to_array("topicDistribution").alias("_d"))
    best = share.select(key, (F.array_position("_d", F.array_max("_d")) - 1).cast("int").alias("topic"), F.array_max("_d").alias("weight"))
    vocabulary = counted.vocabulary
    rows = [(r["topic"], ", ".join(vocabulary[i] for i in r["termIndices"])) for r in model.describeTopics(terms).collect()]  # k rows
    return best, df.sparkSession.createDataFrame(rows, "topic int, label string")
