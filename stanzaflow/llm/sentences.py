"""Problem 4: sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Whether a word before a full stop is an abbreviation, and whether the capitalised
word after it is a name, is decided first from unambiguous occurrences elsewhere in the document, then from corpus counts
of the same evidence; terminators depend on the script (no full stop ends a Devanagari sentence, Chinese needs no blanks).

A blank line always ends a sentence, a line break never does; a block without letter or digit is none; a quotation keeps
its reporting clause; a mark before lower case ends nothing. In verse that capitalises every line, the case at a line's
start says nothing, so the corpus decides whether the word continues such a mark.

Defined cases: NULL and empty texts have no sentences; texts are read whole; a repeated (key, text) row gives its sentences
once per distinct text; an empty corpus means fixed fallbacks only (single-letter initials, numbers, speech verbs).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from ._rows import _ARROW, map_rows
from .lookalike import APOSTROPHES, LATIN_CYRILLIC, LATIN_GREEK, invisible

# Last characters of reporting clauses in scripts without case (said, asked, answered, shouted).
SPEECH_ENDS = ("说", "問", "问", "道", "答", "喊", "पूछा", "कहा", "बोला", "बोली")

_FOLD = str.maketrans(dict(LATIN_CYRILLIC.split()) | {b: dict(LATIN_CYRILLIC.split()).get(a, a) for a, b in LATIN_GREEK.split()})
_TO_LATIN = str.maketrans({b: a for a, b in (LATIN_CYRILLIC + " " + LATIN_GREEK).split()})
_LATIN_ONLY = re.compile("[bfgklmnrtuvzDFGLRUVYZąęłńśźżçğşñöüäß]")
_HIDDEN = {k for k in range(0xA0, 0x10000) if invisible(chr(k))}
_SHAPE = {k: " " for k in range(0xA0, 0x3100) if unicodedata.category(chr(k)) == "Zs"} | {k: chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)} | {ord(c): "’" for c in APOSTROPHES if c != "'"} | {0x2010: "-", 0x2011: "-", 0xFF61: "。"}
_TABLE = _SHAPE | {k: None for k in _HIDDEN}
_HIDDEN_RE = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_HIDDEN)))) + "]")
_SHAPE_RE = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_SHAPE)))) + "]")
_BLANK = re.compile(r"\n[ \t\r]*\n\s*")
_MARK = re.compile(r"[.!?…。।॥]+[»”“’\")\]」』]*")
_PLACE = re.compile(r"([.!?…。।॥]+[»”“’\")\]」』]*)(\s*)([«“„\"‘(\[「『]*)([^\W_][\w\u0300-\u036f\u0900-\u094d’'-]*)?")
_PAIRS = re.compile(r"«[^»]*»|„[^“”]*[“”]|“[^”]*”|「[^」]*」|『[^』]*』|\([^)]*\)")
_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_WORD = re.compile(r"[^\W_][\ẁ-ͯऀ-ॿ’'-]*")
_COUNT = re.compile(r"([^\W_][\ẁ-ͯऀ-ॿ’'-]*)(\.?)")
_INNER = re.compile(r"(?:(?<=[^\W\d_] )|(?<=[^\W\d_], ))(?=[^\W\d_a-zа-яєіїґ])[^\W\d_][\w’-]+")
_VOWEL = re.compile("[aeiouyąęóäöüıаеиоуыэюяєіїё]")
_ALNUM = re.compile(r"[^\W_]")
_DEVA = re.compile(r"[ऀ-ॿ]")
_CASELESS = re.compile(r"[ऀ-ॿ⺀-鿿]")


CHUNK = 2_000_000  # characters whose sentences are cut by one task at once

_KEYS: dict[bool, dict[str, str]] = {True: {}, False: {}}  # words met before, bounded


def fold(word: str, cyrillic: bool) -> str:
    """The key of a word: lower case, composed; within text that has Cyrillic, look-alike letters are Cyrillic ones."""
    keys = _KEYS[cyrillic]
    key = keys.get(word)
    if key is None:
        if len(keys) > 100_000:
            keys.clear()
        key = word if word.isascii() else unicodedata.normalize("NFC", word)
        if cyrillic or not key.isascii():
            if _LATIN_ONLY.search(key):  # a letter that only Latin has: twins of other scripts are read as Latin
                key = key.translate(_TO_LATIN)
            elif cyrillic:
                key = key.translate(_FOLD)
        keys[word] = key = key.lower()
    return key


def capital_lines(text: str) -> bool:
    """Does the text capitalise each line, also within sentences?"""
    up = low = 0
    before = ""
    for line in text.split("\n"):
        line = line.strip()
        if before and line and before[-1] not in ".!?…。।»”“\")" and line[0].isalpha():
            if line[0].islower():
                low += 1
            elif line[0].isupper():
                up += 1
        before = line
    return up >= 2 and up > 4 * low


def _class(marks: str) -> str:
    """q: with a closing quote or bracket; else the kind of mark, 。 for full stops of scripts that use it for nothing else."""
    if marks[-1] not in ".!?…。।॥":
        return "q"
    return "…" if "…" in marks or marks.startswith("..") else "!" if "!" in marks else "?" if "?" in marks else "." if marks == "." else "。"


class _Candidate:
    __slots__ = ("at", "cls", "end", "nx", "newline", "spaced", "prev", "key", "dotted", "whole", "rest")


def _candidates(block: str, cyrillic: bool) -> Iterator[_Candidate]:
    """Places within a block where a sentence may end before more text."""
    begin, size = 0, len(block)
    for m in _PLACE.finditer(block):
        marks, space, openers, word = m.groups()
        c = _Candidate()
        c.at, c.end = m.start(), m.end(1)
        c.rest = m.end(2)
        if c.rest >= size:
            return
        c.spaced, c.newline = bool(space), "\n" in space
        c.nx = word[0] if word else block[m.end(3) : m.end(3) + 1] or block[c.rest]
        c.cls = "." if marks == "." else _class(marks)
        tail = block[max(0, c.at - 24) : c.at].split()
        c.prev = tail[-1].lstrip("«“„(\"[「—") if tail and not block[c.at - 1].isspace() else ""
        c.key = fold(word, cyrillic) if word else ""
        c.dotted = block[m.end() : m.end() + 1] == "."
        c.whole = ""
        if c.cls != ".":
            if c.at - begin < 12:  # the sentence so far, to know interjections
                c.whole = fold(block[begin : c.at].strip(" \n«“„\"(—-"), cyrillic)
            if space:
                begin = c.rest
        yield c


def _ending(block: str, at: int) -> str:
    m = _MARK.search(block, at)
    return _class(m[0].rstrip("»”“’\")]」』"))[:1] if m else ""


def _fragment(block: str, at: int) -> str:
    m = _MARK.search(block, at)
    return " ".join(block[at : m.start() if m else len(block)].split())


def prepare(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alike marks and blanks replaced one for one, hidden characters left out; positions if any were."""
    if _HIDDEN_RE.search(text):
        return text.translate(_TABLE), [i for i, c in enumerate(text) if ord(c) not in _HIDDEN]
    return text.translate(_SHAPE) if _SHAPE_RE.search(text) else text, None


class Gatherer:
    """Counts by (kind, key) over texts. l, t, d: lower-case, all and dotted occurrences of a word; x: dotted before what no sentence
    starts with; s: clear sentence starts, a: capital after a short dotted word, b: the two words; c, o: a word continues or opens after a mark
    (by context); f, g: a caseless fragment after a closing quote or elsewhere."""

    def __init__(self) -> None:
        self.n: Counter = Counter()
        self.words: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def add(self, raw: str | None, asks: set[tuple[str, str]] | None = None) -> None:
        """Adds a text's evidence, and to ``asks`` the (kind, key) that ``Segmenter.spans`` may look up for it."""
        if not raw:
            return
        n, text = self.n, prepare(raw)[0]
        capital = capital_lines(text)
        cyrillic = _CYRILLIC.search(text) is not None
        self.words[cyrillic].update(_COUNT.findall(text))
        scripts = not cyrillic and _CASELESS.search(text) is not None
        for _, block in _blocks(text):
            if (w := _WORD.search(block)) and w[0][0].isupper():
                n["s", fold(w[0], cyrillic)] += 1
            caseless = scripts and _CASELESS.search(block) is not None
            if caseless and len(f := _fragment(block, 0)) <= 24:
                n["g", f] += 1
            for c in _candidates(block, cyrillic):
                ways = () if c.cls == "." or c.nx.islower() and not c.key else _contexts(block, c)
                if asks is not None and not c.nx.islower():
                    _ask(block, c, cyrillic, ways, asks)
                if not c.spaced and not caseless:
                    continue
                if caseless and c.cls != "." and len(f := _fragment(block, c.rest)) <= 24:
                    n["f" if c.cls == "q" else "g", f] += 1
                blind = capital and c.newline
                if c.cls == ".":
                    if c.nx.islower() or c.nx.isdigit() or c.nx in ",;:":
                        n["x", fold(c.prev, cyrillic)] += 1
                    elif c.nx.isupper() and c.prev and (len(c.prev) <= 4 or "." in c.prev or c.prev[-1].isdigit()):
                        n["a", c.key] += 1
                        n["b", f"{fold(c.prev, cyrillic)} {c.key}"] += 1
                    elif c.nx.isupper() and not blind:
                        n["s", c.key] += 1
                elif c.key and not blind and block[c.rest] not in "—–-":
                    kind = "c" if c.nx.islower() else "o" if c.nx.isupper() else ""
                    if kind:
                        if kind == "o":
                            n["s", c.key] += 1
                        for k in ways if c.whole else ways[1:]:
                            n[kind, k] += 1

    def __len__(self) -> int:
        return len(self.n) + sum(map(len, self.words.values()))

    def counts(self) -> Counter:
        """The counts so far, which are then forgotten."""
        n = self.n
        for cyrillic, words in self.words.items():
            for (w, dot), k in words.items():
                key = fold(w, cyrillic)
                n["t", key] += k
                if dot:
                    n["d", key] += k
                if w[0].islower():
                    n["l", key] += k
        self.__init__()
        return n


def _contexts(block: str, c: _Candidate) -> tuple[str, str, str]:
    """The contexts by which the corpus tells whether a word continues after a mark, the most telling one first."""
    return f"{c.cls} {c.whole} > {c.key}", f"{c.cls} {c.key} {_ending(block, c.rest)}", f"{c.cls} {c.key}"


def _ask(block: str, c: _Candidate, cyrillic: bool, ways: tuple[str, ...], asks: set[tuple[str, str]]) -> None:
    if c.cls == ".":
        prev = fold(c.prev, cyrillic)
        asks.update((k, prev) for k in "tdxyz")
        asks.update((k, c.key) for k in "lsa")
        return
    for key in ways:
        asks.update((("c", key), ("o", key)))
    if c.cls == "q" and (_CASELESS.match(c.nx) or (c.prev and _CASELESS.match(c.prev[-1]))):
        f = _fragment(block, c.rest)
        asks.update((("f", f), ("g", f)))


def evidence(texts: Iterable[str | None]) -> Counter:
    """The evidence of some texts."""
    g = Gatherer()
    for t in texts:
        g.add(t)
    return g.counts()


def _blocks(text: str) -> Iterator[tuple[int, str]]:
    """Blocks between blank lines that have a letter or digit, with their places."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        raw = text[at : m.start() if m else len(text)]
        block = raw.strip()
        if block and _ALNUM.search(block):
            yield at + len(raw) - len(raw.lstrip()), block
        at = m.end() if m else at


class _Document:
    """Unambiguous evidence of one document, gathered when first asked for: words in lower case, words met without a full
    stop, capitals within a line."""

    def __init__(self, clean: str, cyrillic: bool) -> None:
        self.clean, self.cyrillic = clean, cyrillic

    def __getattr__(self, name: str) -> set:
        found = set(_COUNT.findall(self.clean))
        self.lower = {fold(w, self.cyrillic) for w, _ in found if w[0].islower()}
        self.bare = {fold(w, self.cyrillic) for w, dot in found if not dot and len(w) <= 5}
        self.names = {fold(w, self.cyrillic) for w in _INNER.findall(self.clean)}
        return self.__dict__[name]


class Segmenter:
    """``spans(text)`` gives (start, end) of each sentence in the stored text; ``counts`` as from ``evidence``."""

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        by: dict[str, dict[str, int]] = {k: {} for k in "ltdxsabcofgyz"}
        for (kind, key), n in counts.items():
            by[kind][key] = n
        self.by = by
        # how often a dotted word is followed by words that also begin sentences, rather than by names
        self.opens: dict[str, float] = {}
        seen: dict[str, list[int]] = {}
        for pair, n in by["b"].items():
            prev, _, nx = pair.partition(" ")
            both = seen.setdefault(prev, [0, 0])
            both[by["l"].get(nx, 0) + by["s"].get(nx, 0) > by["a"].get(nx, 0)] += n
        for k in by["y"].keys() | by["z"].keys():  # the same, already added up
            seen[k] = [by["z"].get(k, 0), by["y"].get(k, 0)]
        self.opens = {k: yes / (yes + no) for k, (no, yes) in seen.items()}

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        if not text:
            return []
        clean, where = prepare(text)
        capital = None
        out, at = [], 0
        cyrillic = _CYRILLIC.search(clean) is not None
        doc = _Document(clean, cyrillic)
        for block_at, block in _blocks(clean):
            begin = 0
            quotes = None
            for c in _candidates(block, cyrillic):
                if not c.nx.islower():
                    if capital is None:
                        capital = capital_lines(clean)
                    if self._ends(block, c, capital, doc):
                        if quotes is None:
                            quotes = [m.span() for m in _PAIRS.finditer(block)]
                        if not any(a < c.at and c.end < b for a, b in quotes) and _ALNUM.search(block, begin, c.end):
                            out.append((block_at + begin, block_at + c.end))
                            begin = c.rest
            if _ALNUM.search(block, begin):
                out.append((block_at + begin, block_at + len(block)))
            elif out and begin and block[begin:].strip():
                out[-1] = (out[-1][0], block_at + len(block))
        if where is not None:
            out = [(where[a], where[b - 1] + 1) for a, b in out]
        return out

    def _ends(self, block: str, c: _Candidate, capital: bool, doc: _Document) -> bool:
        nx, by = c.nx, self.by
        first = block[c.rest]
        if first in "—–" or first == "-":
            return c.newline and c.cls != "q"
        if nx.islower() or nx in ",;:":
            return False
        if _CASELESS.match(nx) or (c.prev and _CASELESS.match(c.prev[-1])):
            if c.cls == "." and (not c.spaced or _DEVA.search(c.prev)):
                return False
            if c.cls == "q" and block[c.at] != ".":
                f = _fragment(block, c.rest)
                after, alone = by["f"].get(f, 0), by["g"].get(f, 0)
                return not (after > alone if after + alone > 2 else f.endswith(SPEECH_ENDS))
            return True
        if not c.spaced:
            return c.cls not in ".q" and nx.isupper() and first not in "«“„(\"" 
        if c.cls == ".":
            return self._stop_ends(c, capital and c.newline, doc)
        if capital and c.newline and nx.isupper():
            if len(c.key) == 1 and c.key not in doc.lower:
                return True
            for k in _contexts(block, c):
                more, new = by["c"].get(k, 0), by["o"].get(k, 0)
                if more + new > 1:
                    return more <= new
        return True

    def _stop_ends(self, c: _Candidate, blind: bool, doc: _Document) -> bool:
        """Does the full stop after ``c.prev`` end the sentence, before a capital or a digit?"""
        by, prev = self.by, c.prev
        number = prev[-1:].isdigit()
        inner = "." in prev and not number
        if not number and not inner and (len(prev) > 5 or not prev.isalpha()):
            return True
        if len(c.key) == 1 and len(prev) == 1 and c.dotted:
            return False  # z. B., initials
        key = fold(prev, doc.cyrillic)
        initial = len(prev) == 1 and prev.isupper()
        low, start, after = by["l"].get(c.key, 0), by["s"].get(c.key, 0), by["a"].get(c.key, 0)
        if not (number or inner or initial):
            total, dotted, goes_on = by["t"].get(key, 0), by["d"].get(key, 0), by["x"].get(key, 0)
            own_word = goes_on >= max(2, 0.2 * dotted)  # met without its full stop too, but that often goes on
            share = 0.4 if after > 2 and low + start == 0 else 0.85  # less is asked before a word only met after such words
            rare = total < 4 and not goes_on and _VOWEL.search(key)  # too few occurrences to tell it from a short last word
            if not own_word and (rare or dotted <= share * total or key in doc.bare):
                return True
        if c.nx.isdigit():
            return number
        if not c.key:
            return True
        if low + start + after <= 2 and c.key not in doc.lower and key in self.opens:
            return self.opens[key] > 0.5  # an unknown word, a misspelt one mostly
        if low + start <= after * 5 and low <= after:
            if c.key in doc.lower:
                low += after + 1
            elif not blind and low == 0 and c.key in doc.names:
                return False
        return low + start > after * (5 if initial else 1)


def _reduced(got: DataFrame) -> DataFrame:
    """(kind, key, n). Pairs of words (b) are reduced to what is asked of them: y and z count, by the
    word before, the pairs whose second word rather begins sentences and the other ones."""
    pick = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    begins = got.filter("kind in ('l', 's', 'a')").groupBy(F.col("key").alias("nx")).agg((pick("l", "s") > pick("a")).alias("begins"))
    pairs = got.filter("kind = 'b'").select(F.substring_index("key", " ", 1).alias("key"), F.expr("substring(key, instr(key, ' ') + 1)").alias("nx"), "n")
    kind = F.when(F.coalesce("begins", F.lit(False)), "y").otherwise("z").alias("kind")
    opens = pairs.join(begins, "nx", "left").groupBy(kind, "key").agg(F.sum("n").alias("n"))
    return got.filter("kind <> 'b'").unionByName(opens)


_READ = "chunk bigint, kind string, key string, n bigint, k string, t string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over (k, t): the documents with the number of their chunk, what each chunk asks for, and the evidence, added up while it is small."""
    task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    chunk = size = 0
    asks: set[tuple[str, str]] = set()
    found = Gatherer()

    def table(**columns: list) -> pa.RecordBatch:
        m = len(next(iter(columns.values())))
        kinds = {"chunk": pa.int64(), "kind": pa.string(), "key": pa.string(), "n": pa.int64(), "k": pa.string(), "t": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(m, t) for c, t in kinds.items()], names=list(kinds))

    def counted() -> pa.RecordBatch:
        n = {x: c for x, c in found.counts().items() if x[1]}
        return table(kind=[x[0] for x in n], key=[x[1] for x in n], n=list(n.values()))

    def wanted() -> pa.RecordBatch:
        return table(chunk=[task + chunk] * len(asks), kind=[x[0] for x in asks], key=[x[1] for x in asks])

    for b in batches:
        keys, texts, at = b[0].to_pylist(), b[1].to_pylist(), []
        for t in texts:
            if size > CHUNK:
                yield wanted()
                chunk, size, asks = chunk + 1, 0, set()
            at.append(task + chunk)
            size += len(t or "")
            found.add(t, asks)
        yield table(chunk=at, k=keys, t=texts)
        if len(found) > 400_000:
            yield counted()
    yield wanted()
    yield counted()


def _segmented(df: DataFrame, key: str, col: str, row: Callable[[str, int, int, int, str], tuple], schema: str) -> DataFrame:
    """``row(key, i, begin, end, text)`` of each sentence. Documents meet, in chunks of about ``CHUNK`` characters, the evidence that they
    ask for: by joins, so no task holds more of the corpus counts than its chunk needs."""
    ship(df.sparkSession)
    read = materialise(df.select(F.col(key).cast("string").alias("k"), F.col(col).alias("t")).mapInArrow(_read, _READ))
    docs = read.filter("chunk is not null and kind is null").select("chunk", "k", "t")
    counts = materialise(read.filter("chunk is null").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    asks = read.filter("chunk is not null and kind is not null").select("chunk", "kind", "key")
    known = asks.join(_reduced(counts), ["kind", "key"]).select(F.col("chunk").alias("at"), "kind", "key", "n")
    names, types = zip(*(x.strip().split(" ") for x in schema.split(",")))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        seg = Segmenter(dict(zip(zip(right["kind"].to_pylist(), right["key"].to_pylist()), right["n"].to_pylist())))
        rows = [row(k, i, a, b, t) for k, t in zip(left["k"].to_pylist(), left["t"].to_pylist()) for i, (a, b) in enumerate(seg.spans(t), 1)]
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.table([pa.array(c, _ARROW[t]) for c, t in zip(cols, types)], names=list(names))

    return docs.groupBy("chunk").cogroup(known.groupBy("at")).applyInArrow(cut, schema)


def sentences(df: DataFrame, key: str = "ID", col: str = "text", segmenter: Segmenter | None = None) -> DataFrame:
    """(doc_key, sentence_id, start_char, end_char, sentence) for every row with a key; positions are 1-based and inclusive."""
    schema = "doc_key string, sentence_id int, start_char int, end_char int, sentence string"
    if segmenter is None:
        return _segmented(df, key, col, lambda k, i, a, b, t: (k, i, a + 1, b, t[a:b]), schema)

    def make():
        def work(keys: list, texts: list) -> Iterable[tuple]:
            for k, t in zip(keys, texts):
                for i, (a, b) in enumerate(segmenter.spans(t), 1):
                    yield k, i, a + 1, b, t[a:b]
        return work

    return map_rows(df.select(F.col(key).cast("string"), F.col(col)), make, schema)


def found(poems: DataFrame) -> DataFrame:
    """p4_found: every sentence of every poem."""
    rows = _segmented(poems, "ID", "text", lambda k, i, a, b, t: (k, i, b), "poem_id string, sentence_id int, end_char int")
    return rows.filter("poem_id is not null").distinct()
