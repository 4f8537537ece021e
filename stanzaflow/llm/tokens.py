"""Token counts by a public tokenizer."""

from __future__ import annotations

import ast
import base64
import hashlib
import os
from collections.abc import Iterable
from typing import NamedTuple

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import map_rows

#: Where the vocabulary files lie; STANZAFLOW_TOKENIZERS overrides it.
TOKENIZERS = os.environ.get("STANZAFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_LOADED: dict[bytes, tiktoken.Encoding] = {}


class Vocabulary(NamedTuple):
    """What the driver reads and sends to the workers, which need no files: less than a megabyte of ranks, and the pattern that splits texts before them."""

    ranks: bytes
    pattern: str


def load(path: str) -> Vocabulary:
    """A .tiktoken file with its folder's split pattern, which is read as a literal, not run."""
    with open(path, "rb") as f:
        ranks = f.read()
    with open(os.path.join(os.path.dirname(path), "__init__.py"), encoding="utf-8") as f:
        body = ast.parse(f.read()).body
    (pattern,) = (ast.literal_eval(x.value) for x in body if isinstance(x, ast.Assign) and getattr(x.targets[0], "id", "") == "PATTERN")
    return Vocabulary(ranks, pattern)


def encoding(vocabulary: Vocabulary) -> tiktoken.Encoding:
    """The byte-level BPE, made once per worker."""
    key = hashlib.sha256(vocabulary.ranks + vocabulary.pattern.encode()).digest()
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines())}
        _LOADED[key] = tiktoken.Encoding("stanzaflow", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


class TokenCounter:
    """Counts tokens of texts. Pieces of the split pattern are encoded once each while they are remembered (``most`` of them)."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000) -> None:
        self.enc, self.most, self.sizes = encoding(vocabulary), most, {}
        self.split = regex.compile(vocabulary.pattern)

    def count(self, text: str) -> int:
        sizes, n = self.sizes, 0
        for piece in self.split.findall(text):
            k = sizes.get(piece)
            if k is None:
                if len(sizes) >= self.most:
                    sizes.clear()
                k = sizes[piece] = len(self.enc.encode_ordinary(piece))
            n += k
        return n


def token_sizes(df: DataFrame, key: str, text: str, source: str, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_key, source, tokens): source without case and outer blanks; NULL text has 0 tokens; whole texts are counted."""
    sent = df.sparkSession.sparkContext.broadcast(load(os.path.join(folder or TOKENIZERS, vocabulary)))

    def make():
        counter = TokenCounter(sent.value)

        def work(keys: list, sources: list, texts: list) -> Iterable[tuple]:
            for k, s, t in zip(keys, sources, texts):
                yield k, s, counter.count(t) if t else 0
        return work

    name = F.nullif(F.lower(F.regexp_replace(F.col(source), r"(?U)^\s+|\s+$", "")), F.lit(""))
    return map_rows(df.select(F.col(key).cast("bigint"), name.alias("s"), F.col(text)), make, "doc_key bigint, source string, tokens bigint")
