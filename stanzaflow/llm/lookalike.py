"""Problem 3: one form for text that looks the same.

Method: union-find over code points and strings builds transitive look-alike classes; corpus frequencies choose each
class's representative per script; a multi-pattern automaton (leftmost-longest) rewrites every other member.

Classes come from Unicode's own data (compatibility forms, canonical compositions, spaces, ignorable characters) and
from the fixed pairs below. Letters of different scripts share classes, so the script of the surrounding word, else of
its neighbours in the sentence, else the more frequent spelling of the word in the corpus, says which member is meant.

Corpus counts of words are a table. Only rows with a word that nothing else decides ask for them: these rows are kept apart and meet, in chunks of
about ``CHUNK`` characters, the counts of the spellings that they ask for; no task and no driver holds the counts of the whole corpus.

Defined cases: NULL stays NULL, empty text stays empty; texts of any length are read whole; repeated rows give repeated rows;
an empty corpus leaves the fixed order of preference (NFKC-stable member first); other columns are never looked at.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ._rows import arrow_table, columns_of, count_rows, map_rows

# Letters of Latin and Cyrillic, Latin and Greek that look alike; apostrophes, hyphens; joined letters.
LATIN_CYRILLIC = "aа cс eе iі jј oо pр sѕ xх yу hһ dԁ qԛ wԝ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ QԚ WԜ"
LATIN_GREEK = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ oο vν iι"
APOSTROPHES = "'ʼ´`′‛‘＇ʹ"
HYPHENS = "‐‑−﹣－˗"
JOINED = "ьі ьı ьl"  # all three look like ы
ORDINARY = "…—–’“”„«»№"  # typography that Unicode would decompose or that must stay

LETTERS = {"latin", "cyrillic", "greek"}  # scripts that share letters
CHUNK = 4_000_000  # characters of undecided rows that one task settles at once
_MARKS = "̧̨̀́̂̃̄̆̇̈̌"
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>"}
_LET = r"[^\W\d_]"
_WORD = re.compile(rf"{_LET}(?:{_LET}|[̀-ͯ])*")
_CJK = re.compile(r"[⺀-鿿豈-﫿「-】]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]")
_GREEK = re.compile(r"[Ͱ-Ͽ]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_ROMAN = re.compile(r"[IVXLCDM]{2,}")
_BREAK = re.compile(r"[!?…。！？]|\.(?!\w)|\n[ \t]*\n")
_CONTEXT_FORMS = set("（），！？：；．")  # normal beside Chinese characters
_APOS = re.compile(rf"(?<={_LET})[{re.escape(APOSTROPHES)}](?={_LET})|ʼ")
_ANY_APOS = re.compile(f"[{re.escape(APOSTROPHES)}]")
_NUM = re.compile(r"(?<!\w)(?=\w*\d)[\dOОΟoоοlIІЗ]{2,}(?!\w)")
_INWORD = re.compile(rf"(?<={_LET})[0361](?={_LET})")
_LETTER_DIGIT = re.compile(r"[0-9](?:(?=[^\W\d_])|(?<=[^\W\d_][0-9]))")
_NUM_TO = str.maketrans("OОΟoоοlIІЗ", "0000001113")


class UnionFind:
    """Disjoint sets of strings with path halving."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def script(s: str) -> str:
    """latin, cyrillic, greek or other, by the first character."""
    if s[0] < "\u0250":
        return "latin" if _LATIN.match(s) else "other"
    first = unicodedata.name(s[0], "").replace("FULLWIDTH ", "").replace("MATHEMATICAL ", "LATIN ").split(" ", 1)[0].lower()
    return first if first in ("latin", "cyrillic", "greek") else "other"


def invisible(c: str) -> bool:
    """Characters that cannot be seen: format, unassigned control and ignorable ones; line ends and tabs can."""
    return unicodedata.category(c) == "Cf" or (unicodedata.category(c) == "Cc" and c not in "\n\r\t") or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️"


@lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """All look-alike classes with more than one member; invisible characters share the class of the empty string."""
    u = UnionFind()
    for k in range(0x80, 0x1D800):
        c = chr(k)
        if 0x900 <= k <= 0x97F or 0xAC00 <= k <= 0xDFFF or c in ORDINARY:
            continue
        if invisible(c):
            u.union("", c)
        elif unicodedata.category(c) == "Zs":
            u.union(" ", c)
        elif d := unicodedata.decomposition(c):
            if d[0] != "<":
                u.union(c, unicodedata.normalize("NFD", c))
            elif d.split(" ", 1)[0] in _TAGS and not (n := unicodedata.normalize("NFKC", c)).startswith(" "):
                u.union(c, n)
    for pair in (LATIN_CYRILLIC + " " + LATIN_GREEK).split():
        u.union(pair[0], pair[1])
        for m in _MARKS:
            u.union(pair[0] + m, pair[1] + m)
    for c in HYPHENS:
        u.union("-", c)
    for s in JOINED.split():
        u.union("ы", s)
    return {r: sorted(m) for r, m in u.classes().items() if len(m) > 1}


def _preferred(s: str) -> tuple:
    """Order among equally frequent members: stable under NFC and NFKC, then short, then low code points."""
    return (unicodedata.normalize("NFKC", s) != s, len(s), s)


class Normaliser:
    """``normalise(text)`` gives the one form. ``chars``: corpus count of each character; ``words``: corpus counts of
    words whose every letter has a twin in another script, used where a word has no neighbour that tells its script (None: not known yet)."""

    def __init__(self, chars: dict[str, int], words: dict[str, int] | None = None) -> None:
        """Only members whose characters occur in the corpus get a pattern, which keeps the automata small."""
        self.words, self.asked = words, set()
        seen = chars.keys() | set(unicodedata.normalize("NFD", "".join(chars)))
        # a multi-character spelling is counted by no character; it wins only where its script has no single character
        freq = lambda m: chars.get(m, 0) if len(m) == 1 else -1
        self.to: dict[str, dict[str, str]] = {"latin": {}, "cyrillic": {}}
        own: dict[str, str] = {}
        self.weak: set[str] = set()
        for members in classes().values():
            occurring = [m for m in members if m and seen >= set(unicodedata.normalize("NFD", m))]
            if not occurring:
                continue
            by: dict[str, list[str]] = {}
            for m in members:
                by.setdefault(script(m) if m else "other", []).append(m)
            rep = {}
            for s, ms in by.items():
                stable = [m for m in ms if unicodedata.normalize("NFKC", m) == m] or ms
                rep[s] = "" if "" in members else min(stable, key=lambda m: (-freq(m), _preferred(m)))
            for m in occurring:
                s = script(m)
                if m != rep[s]:
                    own[m] = rep[s]
                for t in ("latin", "cyrillic"):
                    if t in rep and s in LETTERS and s != t:
                        self.to[t][m] = rep[t]
                # a letter proves its script unless a twin of another script is common beside it
                twin = max((freq(x) for t in LETTERS - {s} for x in by.get(t, ())), default=0)
                if len(m) == 1 and s in LETTERS and twin > 0.01 * freq(m):
                    self.weak.add(m)
        totals = {s: sum(n for c, n in chars.items() if script(c) == s) for s in ("latin", "cyrillic")}
        self.main = max(totals, key=lambda s: totals[s])
        self.own = {k: v for k, v in own.items() if k not in APOSTROPHES}
        for c in _CONTEXT_FORMS & seen:
            self.own.setdefault(c, unicodedata.normalize("NFKC", c))
        self.start()

    def start(self) -> None:
        self.kinds: dict[str, str] = {}
        single = "".join(sorted(k for k in self.own if len(k) == 1))
        pairs = "|".join(re.escape(k) for k in self.own if len(k) > 1 and not any(map(unicodedata.combining, k)))
        self.suspect = re.compile("[" + re.escape(single) + "\u0300-\u036f]" + ("|" + pairs if pairs else ""))
        self.auto = self._automaton(self.own)
        self.autos = {s: self._automaton(t) for s, t in self.to.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("words", "to", "own", "weak", "main")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.asked = set()
        self.start()

    @staticmethod
    def _automaton(patterns: dict[str, str]) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        a.add_word("\uffff", (1, "\uffff"))  # an automaton without words cannot search
        for k, v in patterns.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        return a

    def _rewrite(self, text: str, auto: ahocorasick.Automaton) -> str:
        parts, at = [], 0
        for end, (n, v) in auto.iter_long(text):
            i = end - n + 1
            c = text[i]
            if c in _CONTEXT_FORMS and n == 1 and self._beside_cjk(text, i):
                continue
            if c in "‌‍" and text[i - 1 : i] == "्":  # normal Hindi spelling
                continue
            parts += (text[at:i], v)
            at = end + 1
        return "".join((*parts, text[at:])) if parts else text

    @staticmethod
    def _beside_cjk(text: str, i: int) -> bool:
        a, b = text[max(0, i - 12) : i].rstrip(), text[i + 1 : i + 13].lstrip()
        a = a.rstrip("".join(_CONTEXT_FORMS)).rstrip()
        return bool((a and _CJK.match(a[-1])) or (b and _CJK.match(b[0])) or a[-1:] in "。「」、" and a)

    def normalise(self, text: str) -> str:
        """The form in which equal-looking texts are equal."""
        if not text:
            return text
        for _ in range(4):  # a full-width letter before a mark needs a second pass to compose
            if not self.suspect.search(text) or (new := self._rewrite(text, self.auto)) == text:
                break
            text = new
        if _ANY_APOS.search(text):
            text = _APOS.sub("’", text)
        if (_CYRILLIC.search(text) is not None) + (_LATIN.search(text) is not None) + (_GREEK.search(text) is not None) > 1 or len(text) < 24:
            text = self._scripts(text)
        if _LETTER_DIGIT.search(text):
            text = _NUM.sub(lambda m: m[0].translate(_NUM_TO), text)
            text = _INWORD.sub(lambda m: {"0": "о", "3": "з", "6": "б", "1": "і"}[m[0]] if _CYRILLIC.search(text[max(0, m.start() - 3) : m.end() + 3]) else {"0": "o", "1": "l"}.get(m[0], m[0]), text)
        return text

    def attempt(self, text: str) -> tuple[str, list[str]]:
        """The one form, and the spellings whose corpus counts would be needed to be sure of it (none if ``words`` are known)."""
        self.asked.clear()
        return self.normalise(text), sorted(self.asked)

    def _kind(self, w: str) -> str:
        """The script that a word's letters prove, or ?; kept for words met before."""
        kind = self.kinds.get(w)
        if kind is None:
            if len(self.kinds) > 50_000:
                self.kinds.clear()
            kind = self.kinds[w] = self._judge(w)
        return kind

    def _judge(self, w: str) -> str:
        if w.isascii():
            if not self.weak.issuperset(w):
                return "latin"
            return "keep" if _ROMAN.fullmatch(w) else "?"
        strong = {"latin": 0, "cyrillic": 0, "greek": 0, "other": 0}
        every = dict(strong)
        for c in w:
            if not unicodedata.combining(c):
                s = script(c)
                every[s] += 1
                strong[s] += c not in self.weak
        if strong["other"]:
            return "keep"
        most = max(strong, key=lambda s: (strong[s], every[s]))
        if not strong[most]:
            return "?"
        return "keep" if most == "greek" else most

    def _scripts(self, text: str) -> str:
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        kinds = [self._kind(w) for w in words]
        parts, at = [], 0
        for k, (w, kind, (a, b)) in enumerate(zip(words, kinds, spans)):
            if kind == "keep":
                continue
            if kind == "?":
                kind = self._from_context(text, words, kinds, spans, k) or self._from_corpus(w) or self._from_document(words, kinds)
                if not kind:
                    continue
            if kind in self.autos and any(c in self.to[kind] for c in w):
                new = self._rewrite(w, self.autos[kind])
                if new != w:
                    parts += (text[at:a], new)
                    at = b
        return "".join((*parts, text[at:])) if parts else text

    def _from_context(self, text: str, words: list[str], kinds: list[str], spans: list[tuple], k: int) -> str:
        """The script of the nearest telling word of the sentence, the following one first; initials end no sentence."""
        found = []
        for step in (1, -1):
            j = k
            while 0 <= j + step < len(words):
                a, b = (j, j + 1) if step == 1 else (j - 1, j)
                between = text[spans[a][1] : spans[b][0]]
                if _BREAK.search(between) and not (len(words[a]) == 1 and words[a].isupper() and between.strip() == "."):
                    break
                j += step
                if kinds[j] in ("latin", "cyrillic"):
                    found.append((abs(j - k), -step, kinds[j]))
                    break
        return min(found)[2] if found else ""

    @staticmethod
    def _from_document(words: list[str], kinds: list[str]) -> str:
        """The script of most letters of the text's telling words."""
        n = {s: sum(len(w) for w, k in zip(words, kinds) if k == s) for s in ("latin", "cyrillic")}
        return "" if n["latin"] == n["cyrillic"] else max(n, key=lambda s: n[s])

    def _from_corpus(self, w: str) -> str:
        """The script of the more frequent spelling; without evidence a mixed word goes by most of its letters."""
        spelt = {s: self._rewrite(w, self.autos[s]) for s in ("latin", "cyrillic")}
        if self.words is None and spelt["latin"] != spelt["cyrillic"]:
            self.asked.update(spelt.values())
        forms = {s: (self.words or {}).get(v, 0) for s, v in spelt.items()}
        if forms["latin"] != forms["cyrillic"]:
            return max(forms, key=lambda s: forms[s])
        letters = {s: sum(script(c) == s for c in w) for s in LETTERS}
        if max(letters.values()) == sum(letters.values()) and not letters["greek"]:
            return ""
        return max(("latin", "cyrillic"), key=lambda s: (letters[s], s == self.main))


def char_counts(df: DataFrame, col: str) -> dict[str, int]:
    """Corpus count of every character; collected, bounded by the number of Unicode code points."""
    def make():
        def work(texts: list) -> dict:
            joined = "".join(t for t in texts if t)
            n = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
            return {(int(k),): int(n[k]) for k in np.flatnonzero(n)}
        return work

    return {chr(r["cp"]): r["n"] for r in count_rows(df.select(F.col(col)), make, "cp int").collect()}


_TWINS = "".join(sorted({c for p in (LATIN_CYRILLIC + " " + LATIN_GREEK).split() for c in p}))
_TWIN_WORD = re.compile(rf"(?<!\w)[{_TWINS}]+(?!\w)")


def text_word_counts(df: DataFrame, col: str) -> DataFrame:
    """(w, n): counts of words made only of twin letters in running text, however rare."""
    def make():
        def work(texts: list) -> dict:
            out: dict = {}
            for t in texts:
                for w in _TWIN_WORD.findall(t or ""):
                    out[(w,)] = out.get((w,), 0) + 1
            return out
        return work

    return count_rows(df.select(F.col(col)), make, "w string")


def value_word_counts(df: DataFrame, col: str) -> DataFrame:
    """The same over short values, which are counted before they reach Python."""
    def make():
        def work(values: list, ns: list) -> dict:
            out: dict = {}
            for v, n in zip(values, ns):
                for w in _TWIN_WORD.findall(v or ""):
                    out[(w,)] = out.get((w,), 0) + n
            return out
        return work

    return count_rows(df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c")), make, "w string")


def normalised_rows(df: DataFrame, key: str, col: str, norm: Normaliser, counts: DataFrame, emit: Callable[[], Callable[[list, list, list], Iterable[tuple]]], schema: str) -> DataFrame:
    """``emit()(keys, values, forms)``, tuples or tables, over all rows, in batches. Every row is read once; rows with words that the corpus has to decide are
    written apart with the spellings they ask for, and settled with the counts of these."""
    names, width = columns_of(schema), len(columns_of(schema))

    def make():
        memo: dict[str | None, tuple[str | None, list[str]]] = {}
        out = emit()

        def work(keys: list, values: list) -> Iterable[tuple]:
            memo.clear()
            known: tuple[list, list, list] = ([], [], [])
            for k, v in zip(keys, values):
                got = memo.get(v)
                if got is None:
                    got = memo[v] = norm.attempt(v) if v else (v, [])
                if got[1]:
                    yield (*[None] * width, k, v, got[1])
                else:
                    for rows, x in zip(known, (k, v, got[0])):
                        rows.append(x)
            for x in out(*known):
                if isinstance(x, pa.Table):
                    for name, t in (("_k", pa.string()), ("_v", pa.string()), ("_asked", pa.list_(pa.string()))):
                        x = x.append_column(name, pa.nulls(len(x), t))
                    yield x
                else:
                    yield (*x, None, None, None)
        return work

    first = materialise(map_rows(df.select(F.col(key).cast("string"), F.col(col)), make, f"{schema}, _k string, _v string, _asked array<string>"))
    done = first.filter("_asked is null").select(*names)
    open_rows = first.filter("_asked is not null")
    chars = open_rows.agg(F.sum(F.length("_v"))).first()[0]
    if chars is None:
        return done
    rows = open_rows.select("_k", "_v", "_asked", F.pmod(F.xxhash64("_k", "_v"), F.lit(chars // CHUNK + 1)).cast("int").alias("chunk"))
    known = rows.select(F.col("chunk").alias("at"), F.explode("_asked").alias("w")).distinct().join(counts, "w")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        norm.words = dict(zip(right["w"].to_pylist(), right["n"].to_pylist()))
        keys, values = left["_k"].to_pylist(), left["_v"].to_pylist()
        return arrow_table(emit()(keys, values, [norm.normalise(v) for v in values]), schema)

    settled = materialise(rows.select("chunk", "_k", "_v").groupBy("chunk").cogroup(known.groupBy("at")).applyInArrow(settle, schema))
    return done.unionByName(settled)


def normalise_column(df: DataFrame, key: str, col: str, norm: Normaliser, counts: DataFrame) -> DataFrame:
    """(row_key, value, changed) for each row of ``df``."""
    def emit():
        return lambda keys, values, forms: ((k, f, v is not None and f != v) for k, v, f in zip(keys, values, forms))

    return normalised_rows(df, key, col, norm, counts, emit, "row_key string, value string, changed boolean")


def changed_rows(df: DataFrame, key: str, col: str, norm: Normaliser, counts: DataFrame) -> DataFrame:
    """(row_key): the rows whose value is not in the one form."""
    def emit():
        return lambda keys, values, forms: ((k,) for k, v, f in zip(keys, values, forms) if k is not None and v is not None and f != v)

    return normalised_rows(df, key, col, norm, counts, emit, "row_key string")


def for_text(df: DataFrame, col: str = "text") -> tuple[Normaliser, DataFrame]:
    """A normaliser fitted on the whole column of running text, and the counts of its words."""
    return Normaliser(char_counts(df, col)), text_word_counts(df, col)


def for_values(df: DataFrame, col: str) -> tuple[Normaliser, DataFrame]:
    """The same for a column of short values, whose words have no context."""
    return Normaliser(char_counts(df.groupBy(col).agg(F.count(F.lit(1))), col)), value_word_counts(df, col)


def _both(poems: DataFrame, annotations: DataFrame, rows: Callable[..., DataFrame]) -> DataFrame:
    texts, pronouns = rows(poems, "ID", "text", *for_text(poems)), rows(annotations, "id", "pronoun", *for_values(annotations, "pronoun"))
    return texts.select(F.lit("poems_for_manual_annotation.text").alias("field"), "*").unionByName(pronouns.select(F.lit("annotations.pronoun").alias("field"), "*"))


def canonical(poems: DataFrame, annotations: DataFrame) -> DataFrame:
    """(field, row_key, value, changed): every text and every pronoun in the one form."""
    return _both(poems, annotations, normalise_column)


def found(poems: DataFrame, annotations: DataFrame) -> DataFrame:
    """p3_found: the rows whose value the operator changes."""
    return _both(poems, annotations, changed_rows).distinct()
