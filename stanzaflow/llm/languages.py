"""Problem 1: the language of each document and of each stretch of it.

Method: language-bitmask n-gram filters. For each n-gram order one bit-sliced Bloom filter maps an n-gram to a mask with one bit
per language; the masks of a sentence's n-grams give a popcount per language, corrected for the filter's false positives, and
a likelihood of these counts under each language decides, with the document's other sentences as prior. Where the decided language's popcounts over
the document stay under ``FAMILIAR`` of what it usually has, the outcome is ``und``, none of the languages.

The filters are fitted on a bounded sample of labelled rows (``per_label`` rows of each label, chosen by hash). Labels may be wrong:
n-gram counts relabel the sample's sentences a few times before the filters are filled. All else covers every row.

Defined cases: a NULL or empty text, or one without letters, has no stretch; an unknown label counts as wrong, a missing one as
missing; repeated rows give their stretches once per row (``found``: once); an empty table gives no rows and needs no filters;
texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import count_rows, map_rows
from .sentences import Segmenter, prepare

# Codes; other codes in use, and the languages' names in English, their own and their neighbours' (lower case, without endings).
LANGUAGES = ("uk", "ru", "be", "pl", "en", "de", "crh", "hi", "zh")
OTHER = "und"  # the outcome for text in none of them
CODES = {"uk": "ua", "be": "by", "de": "ger deu", "crh": "qt", "zh": "chi zho cn"}
NAMES = {
    "uk": "ukrain ukraiń ukraj україн украин украін",
    "ru": "russ rosyjsk русск рускі росій россий російськ",
    "be": "belarus belorus białorus weißruss weissruss беларус белорус білорус",
    "pl": "polish polsk polnisch polon польск польс",
    "en": "english angielsk englisch англий англій англ",
    "de": "german deutsch niemiec немец німец нямец",
    "crh": "qirim qırım crimean krymsk krimtatar kırım kirim kirimtatar крим крым къырым",
    "hi": "hindi हिन्दी हिंदी хинди хінді гінді",
    "zh": "chines 中文 汉语 漢語 华语 華語 китай кітай chińsk",
}
WORDS = {"language", "мова", "мовою", "язык", "языке", "język", "języku", "sprache", "dili", "tili", "tatar", "tatarca", "татарська", "татарский", "по", "на"}
MISSING = {"", "nan", "none", "null", "unknown", "unk", "und", "undefined", "unspecified", "missing", "n/a", "na", "n.a.", "невідомо", "неизвестно", "tbd", "xx"}

ORDERS = (2, 3, 4)
SLOTS = 1 << 20
_MUL = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_NOISE = 0.01  # share of n-grams that typing errors change
FAMILIAR = 0.75  # share of the expected hits below which, by more than two deviations, text is in none of the languages


def _named(part: str) -> str:
    """The language of one name: a code, a name with any ending, or an abbreviation (three letters at least) that fits one language only."""
    words = [w.strip(".-_") for w in part.split() if w.strip(".-_") not in WORDS]
    found = set()
    for w in words:
        fits = {k for k in LANGUAGES if w == k or w in CODES.get(k, "").split() or any(w.startswith(x) for x in NAMES[k].split())}
        fits = fits or {k for k in LANGUAGES if len(w) > 2 and any(x.startswith(w) for x in NAMES[k].split())}
        found |= fits if len(fits) == 1 else {"?"}
    return found.pop() if len(found) == 1 else "?"


def parse_label(label: str | None) -> frozenset[str] | None:
    """The languages a label names; None when it is missing; with "?" in it when it names something unknown."""
    if label is None:
        return None
    got = _PARSED.get(label)
    if got is None:
        if len(_PARSED) > 10_000:
            _PARSED.clear()
        got = _PARSED[label] = (_parse(label),)
    return got[0]


_PARSED: dict[str, tuple] = {}


def _parse(label: str) -> frozenset[str] | None:
    s = unicodedata.normalize("NFKC", label).strip().lower().replace("i\u0307", "i")
    if s in MISSING or not any(c.isalnum() for c in s):
        return None
    parts = [p.strip(" .-_") for p in re.split(r"[,;/&+|()\[\]]|\b(?:and|und|та|й|и|і|i|oraz|ve)\b", s)]
    return frozenset(_named(p) for p in parts if p) or None


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for k in range(0x30000):
        c = chr(k)
        table[k] = c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")
    return table


_LETTER: list[np.ndarray] = []


def ngrams(sentences: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per order: the n-grams of all sentences as 64-bit keys and each sentence's first position; and letters per sentence."""
    if not _LETTER:
        _LETTER.append(_letters())
    joined = " " + "  ".join(s.lower() for s in sentences) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][cp]
    sizes = np.array([len(s.lower()) for s in sentences]) if any(len(s) != len(s.lower()) for s in sentences) else np.fromiter(map(len, sentences), np.int64, len(sentences))
    starts = np.concatenate(([0], np.cumsum(sizes + 2)[:-1]))
    owner = np.zeros(len(cp), np.int32)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    n_letters = np.bincount(owner, letter, len(sentences))
    # one blank between words: drop non-letters that follow non-letters of the same sentence
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    code = np.where(letter, cp, 32)[keep].astype(np.uint64)
    own = owner[keep]
    out = []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            continue
        key = code[:m].copy()
        for j in range(1, n):
            key = key * np.uint64(0x110000 + 15) + code[j : j + m]
        same = own[:m] == own[n - 1 : n - 1 + m]
        key ^= key >> np.uint64(29)
        out.append((key[same], own[:m][same]))
    return out, n_letters


class Filters:
    """One table of language masks per order. ``rate[t, l, o]``: share of n-grams of language t found in filter l."""

    def __init__(self, tables: list[np.ndarray], fill: np.ndarray, rate: np.ndarray) -> None:
        self.tables, self.fill, self.rate = tables, fill, rate
        r = np.clip(rate, 1e-4, 1 - 1e-4)
        self.yes, self.no = np.log(r), np.log(1 - r)

    @staticmethod
    def slots(key: np.ndarray) -> list[np.ndarray]:
        return [((key * m) >> np.uint64(44)).astype(np.int64) for m in _MUL]

    def lookup(self, key: np.ndarray, order: int) -> np.ndarray:
        a, b = self.slots(key)
        t = self.tables[order]
        return t[a] & t[b]

    def popcounts(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence x language x order) hits corrected for false positives, n-grams per (sentence x order), letters."""
        grams, letters = ngrams(sentences)
        n = len(sentences)
        hits = np.zeros((n, len(LANGUAGES), len(ORDERS)))
        total = np.zeros((n, len(ORDERS)))
        for o, (key, own) in enumerate(grams):
            mask = self.lookup(key, o)
            total[:, o] = np.bincount(own, minlength=n)
            for k in range(len(LANGUAGES)):
                hits[:, k, o] = np.bincount(own, (mask >> np.uint16(k)) & np.uint16(1), n)
        fp = self.fill ** len(_MUL)  # languages x orders
        hits = np.clip((hits - total[:, None, :] * fp) / (1 - fp), 0, total[:, None, :])
        return hits, total, letters

    def likelihood(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood (sentence x language), damped as overlapping n-grams are not independent; letters; and the hits (sentence x language)
        there are and would be, if the sentence were of the language."""
        hits, total, letters = self.popcounts(sentences)
        miss = total[:, None, :] - hits
        ll = np.einsum("slo,tlo->st", hits, self.yes) + np.einsum("slo,tlo->st", miss, self.no)
        return ll / (len(LANGUAGES) * len(ORDERS) / 3), letters, hits.sum(2), total @ np.einsum("tto->ot", self.rate)


def fit(sample: list[tuple[str, str]]) -> Filters:
    """Filters from (code, text) rows with imperfect labels."""
    seg = Segmenter({})
    sentences, labels = [], []
    for code, text in sample:
        clean = prepare(text)[0]
        for a, b in seg.spans(clean):
            sentences.append(clean[a:b])
            labels.append(LANGUAGES.index(code))
    L, O = len(LANGUAGES), len(ORDERS)
    if not sentences:
        return Filters([np.zeros(SLOTS, np.uint16) for _ in ORDERS], np.zeros((L, O)), np.full((L, L, O), 0.5))
    y = np.array(labels)
    grams, _ = ngrams(sentences)
    n = len(sentences)
    ids = []
    for key, own in grams:
        uniq, inv = np.unique(key, return_inverse=True)
        ids.append((uniq, inv, own))

    def rates(y: np.ndarray) -> list[np.ndarray]:
        out = []
        for uniq, inv, own in ids:
            c = np.bincount(inv * L + y[own], minlength=len(uniq) * L).reshape(-1, L).astype(float)
            out.append(c)
        return out

    for _ in range(4):  # relabel by multinomial counts: robust while a label is right for most of its n-grams
        score = np.zeros((n, L))
        for (uniq, inv, own), c in zip(ids, rates(y)):
            size = c.sum(0)
            logp = np.log((c + 0.05) / (size + 0.05 * len(uniq)))
            logp[:, size == 0] = -30
            for k in range(L):
                score[:, k] += np.bincount(own, logp[inv, k], n)
        y = score.argmax(1)
    tables, fill, rate = [], np.zeros((L, O)), np.zeros((L, L, O))
    for o, ((uniq, inv, own), c) in enumerate(zip(ids, rates(y))):
        freq = c / np.maximum(c.sum(0), 1)
        put = (c >= 2) & (freq > 0.02 * freq.max(1, keepdims=True))
        mask = (put << np.arange(L)).sum(1).astype(np.uint16)
        table = np.zeros(SLOTS, np.uint16)
        for s in Filters.slots(uniq):
            np.bitwise_or.at(table, s, mask)
        tables.append(table)
        fill[:, o] = [((table >> k) & 1).mean() for k in range(L)]
        for t in range(L):
            # n-grams met once stand for those a new text would bring: they count as not found
            w = c[:, t]
            rate[t, :, o] = (w[:, None] * put).sum(0) / max(w.sum(), 1)
    rate = rate * (1 - _NOISE * np.arange(2, 2 + O)[None, None, :])
    return Filters(tables, fill, rate)


def sample_rows(df: DataFrame, label: str, text: str, key: str, per_label: int) -> list[tuple[str, str]]:
    """About ``per_label`` rows of each single language named, by hash of the key: bounded by languages x per_label (x 2)."""
    def make():
        def work(keys: list, labels: list, texts: list) -> Iterable[tuple]:
            for k, v, t in zip(keys, labels, texts):
                named = parse_label(v)
                if k and t and named and len(named) == 1 and "?" not in named:
                    yield next(iter(named)), k, t
        return work

    def codes():
        def work(labels: list, ns: list) -> dict:
            out: dict = {}
            for v, n in zip(labels, ns):
                named = parse_label(v)
                if named and len(named) == 1 and "?" not in named:
                    out[tuple(named)] = out.get(tuple(named), 0) + n
            return out
        return work

    spelt = df.groupBy(F.col(label).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = {r["code"]: r["n"] for r in count_rows(spelt, codes, "code string").collect()}  # one row a language
    share = F.lit(0.0)
    rows = map_rows(df.select(F.col(key).cast("string"), label, text), make, "code string, k string, t string")
    for code, n in counts.items():
        share = F.when(F.col("code") == code, min(1.0, per_label / n)).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share * 1_000_000)
    return [(r["code"], r["t"]) for r in picked.select("code", "t").collect()]


class Identifier:
    """``stretches(texts)`` gives, per text, merged stretches (start, end, code, confidence) in characters of the stored text."""

    def __init__(self, filters: Filters) -> None:
        self.filters, self.seg = filters, Segmenter({})

    def stretches(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        spans = [self._pieces(t) if t else [] for t in texts]
        flat = [prepare(t[a:b])[0] for t, sp in zip(texts, spans) for a, b in sp]
        if not flat:
            return [[] for _ in texts]
        figures = self.filters.likelihood(flat)
        out, at = [], 0
        for sp in spans:
            k = len(sp)
            out.append(self._document(sp, *(x[at : at + k] for x in figures)))
            at += k
        return out

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        """Sentences; a short piece before a full stop (an abbreviation, mostly) goes with what follows it."""
        out: list[tuple[int, int]] = []
        joined = False
        for a, b in self.seg.spans(text):
            if joined and "\n\n" not in text[out[-1][1] : a]:
                a = out.pop()[0]
            out.append((a, b))
            joined = text[b - 1] == "." and not text[max(a, b - 6) : b].strip().isalpha() and len(text[a:b].rsplit(None, 1)[-1]) <= 6 and b - a <= 24
        return out

    @staticmethod
    def _document(spans: list[tuple[int, int]], ll: np.ndarray, letters: np.ndarray, hits: np.ndarray, expected: np.ndarray) -> list[tuple[int, int, str, float]]:
        if not spans or not letters.any():
            return []
        n_lang = len(LANGUAGES)
        post = np.exp(ll - ll.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        prior = (post * letters[:, None]).sum(0) / letters.sum()
        ll = ll + np.log(prior * 0.9 + 0.1 / len(LANGUAGES))
        post = np.exp(ll - ll.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        out: list[list] = []
        best = post.argmax(1)
        # of each language, the hits in all of its sentences against those expected: too few, and they are in none of the languages
        rows = np.arange(len(best))
        due, met = np.bincount(best, expected[rows, best], n_lang), np.bincount(best, hits[rows, best], n_lang)
        known = met >= FAMILIAR * due - 2 * np.sqrt(due)
        for (a, b), p, n, k in zip(spans, post, letters, best.tolist()):
            if not n:
                continue
            if not known[k]:
                p, k = np.append(np.zeros(n_lang), 1 - met[k] / due[k]), n_lang
            if out and out[-1][2] == k:
                out[-1][1] = b
                out[-1][3] += p[k] * n
                out[-1][4] += n
            else:
                out.append([a, b, k, p[k] * n, n])
        return [(a, b, (*LANGUAGES, OTHER)[k], float(c / n)) for a, b, k, c, n in out]


def fit_on(df: DataFrame, key: str = "ID", label: str = "language", text: str = "text", per_label: int = 300) -> Filters:
    return fit(sample_rows(df, label, text, key, per_label))


def stretches(df: DataFrame, key: str = "ID", label: str = "language", text: str = "text", per_label: int = 300) -> DataFrame:
    """(doc_key, stretch, start_char, end_char, lang, confidence); positions are 1-based and inclusive."""
    filters = df.sparkSession.sparkContext.broadcast(fit_on(df, key, label, text, per_label))  # 6 MB whatever the data

    def make():
        ident = Identifier(filters.value)

        def work(keys: list, texts: list) -> Iterable[tuple]:
            for k, st in zip(keys, ident.stretches(texts)):
                for i, (a, b, code, conf) in enumerate(st, 1):
                    yield k, i, a + 1, b, code, conf
        return work

    return map_rows(df.select(F.col(key).cast("string"), text), make, "doc_key string, stretch int, start_char int, end_char int, lang string, confidence double")


def documents(df: DataFrame, key: str = "ID", label: str = "language", text: str = "text", per_label: int = 300) -> DataFrame:
    """(doc_key, named, langs, confidence): the label's state (missing, wrong, right), the languages of the text in order of
    size, and the confidence of the least certain of them."""
    filters = df.sparkSession.sparkContext.broadcast(fit_on(df, key, label, text, per_label))

    def make():
        ident = Identifier(filters.value)

        def work(keys: list, labels: list, texts: list) -> Iterable[tuple]:
            for k, v, st in zip(keys, labels, ident.stretches(texts)):
                size: dict[str, int] = {}
                sure: dict[str, float] = {}
                for a, b, code, conf in st:
                    size[code] = size.get(code, 0) + b - a
                    sure[code] = max(sure.get(code, 0.0), conf)
                named = parse_label(v)
                state = "missing" if named is None else "right" if named == size.keys() else "wrong"
                langs = sorted(size, key=lambda x: (-size[x], x))
                yield k, state, langs, min(sure.values(), default=None)
        return work

    return map_rows(df.select(F.col(key).cast("string"), label, text), make, "doc_key string, named string, langs array<string>, confidence double")


def found(poems: DataFrame) -> DataFrame:
    """p1_found: the languages of each poem whose label is missing or does not name exactly these."""
    docs = documents(poems).filter((F.col("named") != "right") & F.col("doc_key").isNotNull())
    return docs.select(F.col("doc_key").alias("poem_id"), F.explode("langs").alias("lang")).filter(F.col("lang") != OTHER).distinct()
