"""Problem 8: per-document text quality statistics, and which documents are not natural writing.

Method: robust Mahalanobis distance from language-specific prose mean and covariance over all statistics, with each statistic's
contribution. Character classes, words and lines are counted for whole Arrow batches in numpy. As "the greater part" of a text decides, the
ratios enter the distance as medians over its lines, weighted by their length; the plain per-document figures come out beside them.
Mean and covariance are concentrated (as in the minimum covariance determinant): medians and deviations start it, then each step refits on
the ``keep`` share of each language's distinct vectors nearest to it, so copies count once and up to half of a language may be junk. The
covariance of the nearest half is carried to that of the nearest three quarters, the scale of ``cutoff``. Each step is an aggregate; only
(language x statistic) sums reach the driver.

A document's language here is the one whose common words cover most of its text; common words are those with the highest document frequency
among documents labelled with the language against all others, counted over the whole corpus.

Defined cases: NULL text gives NULL statistics and no verdict; empty or blank text has zero words and the verdict junk; a repeated key
is rated once; a language with fewer than ``least`` documents is measured against all languages together; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ._rows import count_rows, map_rows
from .languages import LANGUAGES, parse_label

#: Statistics of the distance: medians over lines unless said otherwise; each with the least standard deviation that counts as one.
#: These least deviations and ``cutoff`` were set by hand on the smallest test tables: template-like prose varies so little that a
#: covariance without them would take any new kind of verse for an outlier.
STATISTICS = {
    "letter_share": 0.04, "digit_share": 0.03, "symbol_share": 0.03, "separator_rate": 0.10, "word_length": 0.7, "odd_case_share": 0.03,
    "common_share": 0.10, "line_words": 3.0, "bullet_share": 0.15, "repeated_share": 0.12, "distinct_share": 0.08, "end_mark_share": 0.35,
}
NAMES = tuple(STATISTICS)
FLOOR = np.array(list(STATISTICS.values()))
COMMON = 40  # common words per language

_ENDS = ".!?…।。！？»”“\"」』)—:;,"
_CLASS: list[np.ndarray] = []
_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64))
_BULLETS = "-–•*·▪◦‣☐☑+"  # the long dash opens speech, not a list item
L_LETTER, L_DIGIT, L_SPACE, L_LINE, L_PUNCT, L_SEP, L_SYMBOL, L_CJK, L_UPPER = range(9)


def _classes() -> np.ndarray:
    """Class of each code point: letter, digit, space, line end, ordinary punctuation, separator, other symbol, ideograph, capital."""
    if not _CLASS:
        t = np.full(0x110000, L_SYMBOL, np.uint8)
        for k in range(0x30000):
            c = chr(k)
            g = unicodedata.category(c)
            if 0x2E80 <= k <= 0x9FFF and g == "Lo":
                t[k] = L_CJK
            elif g == "Lu":
                t[k] = L_UPPER
            elif g[0] in "LM":
                t[k] = L_LETTER
            elif g == "Nd":
                t[k] = L_DIGIT
            elif c == "\n":
                t[k] = L_LINE
            elif g[0] == "Z" or c in "\t\r" or g == "Cf":
                t[k] = L_SPACE
            elif c in ",;:，；：、":
                t[k] = L_SEP
            elif c in ".!?…'’‘\"«»“”„()—–-।。！？「」『』（）":
                t[k] = L_PUNCT
        _CLASS.append(t)
    return _CLASS[0]


def _weighted_median(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Per document the value at which half of the weight is reached; documents without lines get 0."""
    order = np.lexsort((value, doc))
    d, v, w = doc[order], value[order], weight[order]
    total = np.bincount(d, w, n)
    run = np.cumsum(w)
    start = np.concatenate(([0.0], np.cumsum(total)[:-1]))
    reached = run - start[d] >= total[d] / 2
    idx = np.flatnonzero(reached)
    out = np.zeros(n)
    dd, first = np.unique(d[idx], return_index=True)
    out[dd] = v[idx[first]]
    return out


class Counter:
    """Statistics of a batch of texts. ``common``: word hash -> mask of the languages it is common in."""

    def __init__(self, common: dict[int, int]) -> None:
        self.keys = np.array(sorted(common), np.uint64)
        self.masks = np.array([common[int(k)] for k in self.keys], np.uint16)

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        n = len(texts)
        classes = _classes()
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = classes[raw]
        size = np.fromiter(map(len, texts), np.int64, n)
        ends = np.cumsum(size + 1) - 1  # each text's closing line end
        line_end = np.flatnonzero(cls == L_LINE)
        line_start = np.concatenate(([0], line_end[:-1] + 1))
        doc = np.searchsorted(ends, line_end)
        m = len(line_end)
        line_of = np.repeat(np.arange(m), line_end - line_start + 1)
        per = lambda k: np.bincount(line_of[cls == k], minlength=m).astype(float)
        letters, digits, seps, symbols, cjk, upper, puncts = (per(k) for k in (L_LETTER, L_DIGIT, L_SEP, L_SYMBOL, L_CJK, L_UPPER, L_PUNCT))
        letters += cjk + upper
        visible = letters + digits + seps + symbols + puncts
        used = visible > 0
        # words: runs of letters, digits and marks; each ideograph is a word
        body = (cls == L_LETTER) | (cls == L_DIGIT) | (cls == L_UPPER)
        begin = body & ~np.concatenate(([False], body[:-1]))
        begin |= cls == L_CJK
        at = np.flatnonzero(begin)
        stop = np.minimum(np.append(at[1:], len(cls)), _run_ends(body | (cls == L_CJK))[at])
        w_line = line_of[at]
        w_len = (stop - at).astype(float)
        words = np.bincount(w_line, minlength=m).astype(float)
        w_chars = np.bincount(w_line, w_len, m)
        hashes = word_hashes(raw, cls, at, stop)
        pos = np.searchsorted(self.keys, hashes)
        pos[pos == len(self.keys)] = 0
        mask = np.where(self.keys[pos] == hashes, self.masks[pos], 0).astype(np.uint16) if len(self.keys) else np.zeros(len(at), np.uint16)
        w_doc = doc[w_line]
        n_words = np.bincount(w_doc, minlength=n).astype(float)
        cover = np.stack([np.bincount(w_doc, (mask >> k) & 1, n) for k in range(len(LANGUAGES))], 1)
        lang = cover.argmax(1)
        lang[cover.max(1) == 0] = -1
        # texts of several languages: a language with a quarter of the leading one's cover counts too
        spoken = ((cover >= 0.25 * np.maximum(cover.max(1, keepdims=True), 1)) << np.arange(len(LANGUAGES))).sum(1).astype(np.uint16)
        hit = (mask & spoken[w_doc]) > 0
        common = np.bincount(w_line, hit, m)
        # capitals or digits inside a word that has small letters or follows a digit: codes rather than words
        inner = np.concatenate(([False], body[1:] & body[:-1]))
        odd = inner & ((cls == L_UPPER) & (np.concatenate(([0], cls[:-1])) != L_UPPER) | (cls == L_DIGIT) & (np.concatenate(([0], cls[:-1])) <= L_LETTER))
        odd_words = np.bincount(line_of[odd], minlength=m)
        first = np.minimum(line_start + _leading(cls, line_start, line_end), line_end)
        other = np.flatnonzero(cls != L_DIGIT)
        after = np.append(other, len(cls) - 1)[np.searchsorted(other, first)]
        bullet = np.isin(raw[first], [ord(c) for c in _BULLETS + "[#@|"]) | ((cls[first] == L_DIGIT) & np.isin(raw[after], [46, 41]) & (cls[np.minimum(after + 1, len(raw) - 1)] == L_SPACE))
        last = _last_visible(cls, line_start, line_end)
        ends_well = np.isin(raw[last], [ord(c) for c in _ENDS])
        # share of the text in lines met before in it, and of distinct words
        line_hash = np.add.reduceat(hashes, np.searchsorted(at, line_start[words > 0])) if len(at) else np.zeros(0, np.uint64)
        rep = np.zeros(m, bool)
        lw = np.flatnonzero(words > 0)
        if len(lw):
            combo = np.stack([doc[lw].astype(np.uint64), line_hash], 1)
            o = np.lexsort((np.arange(len(lw)), combo[:, 1], combo[:, 0]))
            same = (combo[o][1:] == combo[o][:-1]).all(1)
            rep[lw[o[1:][same]]] = True
        weight = visible * used
        total = np.maximum(np.bincount(doc, weight, n), 1)
        o = np.lexsort((hashes, w_doc))
        d, h = w_doc[o], hashes[o]
        distinct = np.bincount(d[np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))], minlength=n) if len(at) else np.zeros(n, np.int64)
        safe = np.maximum
        med = lambda v: _weighted_median(doc[used], v[used], weight[used], n)
        wc = np.where(cjk > 0.3 * letters, w_chars * 0 + 5, w_chars / safe(words, 1))  # ideographs count as words of usual length
        mean = lambda v: np.bincount(doc, v, n)
        lines = np.bincount(doc, used, n)
        end_share = mean(ends_well & used) / safe(lines, 1)
        scale = np.where(cjk > 0.3 * letters, 2.0, 1.0)  # ideographs come about two to a word
        vector = np.stack([
            med(letters / safe(visible, 1)), med(digits / safe(visible, 1)), med(symbols / safe(visible, 1)), med(seps / safe(words / scale, 1)), med(wc), med(odd_words / safe(words, 1)),
            med(common / safe(words, 1)), np.minimum(med(words / scale), 15), med(bullet.astype(float)), mean(weight * rep) / total,
            np.where(n_words > 1, np.log(safe(distinct, 1)) / np.log(safe(n_words, 2)), 1.0), end_share,
        ], 1)
        return {
            "vector": vector, "lang": lang, "n_words": n_words.astype(np.int64), "n_lines": lines.astype(np.int64), "n_chars": size,
            "mean_word_length": mean(w_chars) / safe(n_words, 1), "symbol_ratio": mean(symbols) / safe(mean(visible), 1), "digit_ratio": mean(digits) / safe(mean(visible), 1),
            "end_mark_ratio": end_share, "common_ratio": mean(common) / safe(n_words, 1),
        }


def _run_ends(body: np.ndarray) -> np.ndarray:
    """For each position in a run of True: the end of the run."""
    stops = np.flatnonzero(~body)
    idx = np.searchsorted(stops, np.arange(len(body)))
    return np.append(stops, len(body))[idx]


def _leading(cls: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    solid = np.flatnonzero(cls != L_SPACE)
    k = np.searchsorted(solid, start)
    return np.append(solid, len(cls))[k] - start


def _last_visible(cls: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    solid = np.flatnonzero((cls != L_SPACE) & (cls != L_LINE))
    k = np.searchsorted(solid, end) - 1
    return np.where(k >= 0, np.maximum(solid[np.maximum(k, 0)] if len(solid) else start, start), start)


def word_hashes(raw: np.ndarray, cls: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [at, stop), lower case; positions past 63 repeat the powers."""
    if not len(at):
        return np.zeros(0, np.uint64)
    low = _lower()[raw]
    inside = np.zeros(len(raw), np.int64)
    inside[at] = 1
    word = np.cumsum(inside) - 1
    within = np.zeros(len(raw), bool)
    d = np.zeros(len(raw) + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, stop, -1)
    within = np.cumsum(d[:-1]) > 0
    k = np.flatnonzero(within)
    part = (low[k].astype(np.uint64) + np.uint64(7)) * _POWER[(k - at[word[k]]) & 63]
    return np.add.reduceat(part, np.searchsorted(k, at))


_LOWER: list[np.ndarray] = []


def _lower() -> np.ndarray:
    if not _LOWER:
        t = np.arange(0x110000, dtype=np.uint32)
        for k in range(0x20000):
            c = chr(k).lower()
            if len(c) == 1:
                t[k] = ord(c)
        _LOWER.append(t)
    return _LOWER[0]


def common_words(df: DataFrame, text: str = "text", label: str = "lang") -> dict[int, int]:
    """Hash -> language mask of each language's common words, from document frequencies over the whole corpus.

    Per (label, word hash) counts are aggregated before they are compared; what is collected is ``COMMON`` words a language."""
    def make():
        def work(texts: list, labels: list) -> dict:
            keep = [(t, LANGUAGES.index(next(iter(p)))) for t, v in zip(texts, labels) if t and (p := parse_label(v)) and len(p) == 1 and "?" not in p]
            out: dict = {}
            for i, j in _slices([t for t, _ in keep]):
                for w, n in document_words([t for t, _ in keep[i:j]], np.array([c for _, c in keep[i:j]])).items():
                    out[w] = out.get(w, 0) + n
            return out
        return work

    df_counts = count_rows(df.select(text, label), make, "lang int, word bigint")
    docs = df_counts.filter("word = 0").select("lang", F.col("n").alias("docs"))
    share = df_counts.filter("word <> 0").join(F.broadcast(docs), "lang").select("lang", "word", (F.col("n") / F.col("docs")).alias("share"))
    every = share.groupBy("word").agg(F.sum("share").alias("all_shares"))
    # a word of nearly no document cannot be common; leaving these out first keeps the shuffle small
    score = share.filter("share > 0.02").join(every, "word").withColumn("score", F.col("share") * F.col("share") / F.col("all_shares"))
    best = score.withColumn("rank", F.row_number().over(_window("lang", "score", "word"))).filter(F.col("rank") <= COMMON)
    out: dict[int, int] = {}
    for r in best.select("lang", "word").collect():
        k = r["word"] & 0xFFFFFFFFFFFFFFFF
        out[k] = out.get(k, 0) | 1 << r["lang"]
    return out


def _window(part: str, by: str, tie: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(F.desc(by), tie)


def _slices(texts: list[str | None], most: int = 600_000) -> Iterable[tuple[int, int]]:
    """Runs of texts of about ``most`` characters together, one text at least: what a worker holds as arrays at once."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size + n > most and i > begin:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def document_words(texts: list[str], lang: np.ndarray) -> dict[tuple, int]:
    """{(language, word hash): documents with the word}; hash 0 counts the documents."""
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[raw]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    body = (cls == L_LETTER) | (cls == L_UPPER) | (cls == L_DIGIT)
    begin = body & ~np.concatenate(([False], body[:-1])) | (cls == L_CJK)
    at = np.flatnonzero(begin)
    if not len(at):
        return {}
    stop = np.minimum(np.append(at[1:], len(cls)), _run_ends(body | (cls == L_CJK))[at])
    h = word_hashes(raw, cls, at, stop)
    doc = np.searchsorted(ends, at).astype(np.uint64)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    h, ll = h[new], lang[doc[new].astype(np.int64)]
    out: dict[tuple, int] = {}
    for k in range(len(LANGUAGES)):
        words, n = np.unique(h[ll == k], return_counts=True)
        out.update(zip(((k, int(w)) for w in words.view(np.int64)), n.tolist()))
        if (docs := int((lang == k).sum())):
            out[k, 0] = docs
    return out


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """One row per document: (doc_key, lang, n_words, n_lines, n_chars, mean_word_length, symbol_ratio, digit_ratio, end_mark_ratio, common_ratio, vector)."""
    common = common_words(df, text, label)

    def make():
        count = Counter(common)

        def work(keys: list, texts: list) -> Iterable[tuple]:
            for i, j in _slices(texts):
                k, t = keys[i:j], texts[i:j]
                s = count([x or "" for x in t])
                cols = [s[c].tolist() for c in ("n_words", "n_lines", "n_chars", "mean_word_length", "symbol_ratio", "digit_ratio", "end_mark_ratio", "common_ratio")]
                for a, x, lang, vec, *rest in zip(k, t, s["lang"].tolist(), s["vector"].tolist(), *cols):
                    yield (a, None, *[None] * 8, None) if x is None else (a, LANGUAGES[lang] if lang >= 0 else None, *rest, vec)
        return work

    return map_rows(df.select(F.col(key).cast("bigint"), F.col(text)), make, "doc_key bigint, lang string, n_words bigint, n_lines bigint, n_chars bigint, mean_word_length double, symbol_ratio double, digit_ratio double, end_mark_ratio double, common_ratio double, vector array<double>")


BINS = 144
_TRI = np.triu_indices(len(NAMES))


def _bin(d2: np.ndarray) -> np.ndarray:
    """Logarithmic bins of the squared distance, six to a power of two from 1/4 up; the last begins at about 4 million."""
    return np.clip(np.log2(np.maximum(d2, 0.25) * 4) * 6, 0, BINS - 1).astype(np.int32)


class Model:
    """Centre and precision per language; "" stands for all languages together."""

    def __init__(self, centre: dict[str, np.ndarray], precision: dict[str, np.ndarray]) -> None:
        self.centre, self.precision = centre, precision

    def group(self, lang: str | None) -> str:
        return lang if lang in self.centre else ""

    def distance(self, x: np.ndarray, group: str) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, and each statistic's share of them (they add up to the distance)."""
        y = x - self.centre[group]
        part = y * (y @ self.precision[group])
        return part.sum(1), part


def _shrinkage(keep: float) -> float:
    """Share of a normal distribution's variance that its nearest ``keep`` share has (0 < keep < 1)."""
    below = lambda x, half: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))  # noqa: E731  # chi-square of 2 * half degrees
    half, lo, hi = len(NAMES) // 2, 0.0, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, half) < keep else (lo, mid)
    return below(lo, half + 1) / keep


def fit(stats: DataFrame, keep: float = 0.5, steps: int = 5, least: int = 30) -> Model:
    """Concentration steps over all distinct vectors; what reaches the driver is (languages + 1) x bins rows of sums."""
    used = stats.filter("vector is not null and n_words > 0").select("lang", "vector").distinct()
    grouped = materialise(used.unionByName(used.select(F.lit("").alias("lang"), "vector").distinct()).filter("lang is not null"))
    quart = [F.percentile_approx(F.col("vector")[i], [0.25, 0.5, 0.75], 1000).alias(n) for i, n in enumerate(NAMES)]
    start = grouped.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *quart).collect()
    centre, precision = {}, {}
    for r in start:
        if r["n"] >= least or r["lang"] == "":
            q = np.array([r[n] for n in NAMES])
            sd = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)
            centre[r["lang"]], precision[r["lang"]] = q[:, 1], np.diag(1 / sd**2)
    if "" not in centre:
        return Model({"": np.zeros(len(NAMES))}, {"": np.diag(1 / FLOOR**2)})
    model = Model(centre, precision)
    for _ in range(steps):
        model = _step(grouped, model, keep)
    return model


def _step(grouped: DataFrame, model: Model, keep: float) -> Model:
    k, tri = len(NAMES), len(_TRI[0])

    def make():
        def work(langs: list, vectors: list) -> Iterable[tuple]:
            x = np.array(vectors, float).reshape(len(vectors), k)
            names = np.array([v for v in langs], object)
            for g in model.centre:
                rows = x[names == g]
                if len(rows):
                    b = _bin(model.distance(rows, g)[0])
                    for v in np.unique(b):
                        y = rows[b == v]
                        yield g, int(v), len(y), y.sum(0).tolist(), (y.T @ y)[_TRI].tolist()
        return work

    parts = map_rows(grouped, make, "g string, bin int, n bigint, s array<double>, p array<double>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(k)] + [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(tri)]
    rows = parts.groupBy("g", "bin").agg(F.sum("n").alias("n"), *sums).collect()
    centre, precision, scale = {}, {}, _shrinkage(0.75) / _shrinkage(keep)
    for g in model.centre:
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["bin"])
        total, n, s, p = sum(r["n"] for r in mine), 0, np.zeros(k), np.zeros(tri)
        for r in mine:
            part = min(1.0, (keep * total - n) / r["n"])  # of the bin with the cut, the share that is still wanted
            if part <= 0:
                break
            n += part * r["n"]
            s += part * np.array([r[f"s{i}"] for i in range(k)])
            p += part * np.array([r[f"p{i}"] for i in range(tri)])
        mean = s / n
        second = np.zeros((k, k))
        second[_TRI] = p / n
        second = second + second.T - np.diag(second.diagonal())
        centre[g], precision[g] = mean, np.linalg.inv((second - np.outer(mean, mean)) * scale + np.diag(FLOOR**2))
    return Model(centre, precision)


FIGURES = "doc_key bigint, lang string, n_words bigint, n_lines bigint, n_chars bigint, mean_word_length double, symbol_ratio double, digit_ratio double, end_mark_ratio double, common_ratio double"


def rate(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", cutoff: float = 18.0, keep: float = 0.5) -> DataFrame:
    """Every document with its figures, ``distance`` (squared), the contribution of each statistic, the strongest one, and ``natural``.

    ``cutoff`` is asked of the squared distance; where little text is natural (blank, or no words at all) ``natural`` is false."""
    stats = materialise(statistics(df, key, text, label))
    model = fit(stats, keep)

    def make():
        def work(*columns: list) -> Iterable[tuple]:
            *figures, vectors = columns
            by: dict[str, list[int]] = {}
            for i, (g, v) in enumerate(zip(figures[1], vectors)):
                if v is None:
                    yield (*(c[i] for c in figures), None, None, None, None)
                else:
                    by.setdefault(model.group(g), []).append(i)
            for g, at in by.items():
                d, part = model.distance(np.array([vectors[i] for i in at]), g)
                for i, x, p in zip(at, d.tolist(), part):
                    yield (*(c[i] for c in figures), x, p.tolist(), NAMES[int(p.argmax())], figures[2][i] > 0 and x <= cutoff)
        return work

    return map_rows(stats, make, FIGURES + ", distance double, contributions array<double>, strongest string, natural boolean").dropDuplicates(["doc_key"])


def found(documents: DataFrame) -> DataFrame:
    """p8_found: documents the greater part of whose text is not natural writing."""
    return rate(documents).filter("not natural and doc_key is not null").select(F.col("doc_key").alias("doc_id"))
